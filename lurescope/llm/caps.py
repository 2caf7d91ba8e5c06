"""Embedding near-dedup by spherical-cap filters.

* Equal vectors are one class; only classes are compared.
* A filter is a cap ``<u, c> >= alpha`` around a direction c of a structured
  random product code: the coordinates are cut into ``m`` blocks, each with a
  random codebook of unit vectors, and a direction is one codeword of each
  block, divided by sqrt(m).  Each vector is *list-decoded* to all directions
  whose cap holds it: sorted inner products per block, extended block by block
  with the best that the rest can still add.
* The number of directions grows with the number of classes.  alpha gives each
  vector about ``PER_VECTOR`` caps by a Gaussian tail and is then lowered until
  pairs whose cosine is just the threshold share a cap with probability
  ``RECALL``: the height at which a pair's best shared direction stands is
  measured on the codes in use, for random pairs and for vectors of the table
  with a partner at the threshold, so the caps per vector grow with the table.
  A vector in fewer than ``LEAST`` caps of a code goes to its best ``LEAST``.
  As the caps of one code depend on one another, there are ``CODES`` codes with
  books of their own.
* The vectors of a cap are joined in blocks of about ``BLOCK`` rows: a cap with
  more rows is split, and each pair of blocks is a group of its own, so a cap
  that holds a third of all rows is spread over many tasks.  A pair is verified
  by its cosine in double precision and counted in the smallest cap that both
  share; a block returns link counts per vector and a spanning forest of its
  links, never the pairs.

Recall is measured against brute force in the tests; no pair below the
threshold is ever linked.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different length; null ids are
kept, with the smallest id of their class as component if it has one; repeated
rows are vectors of their own that link with each other; other columns are
ignored.  A cosine of exactly the threshold is a link; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import bounded_broadcast, components, ship, stage

THRESHOLD = 0.9
PER_VECTOR = 16
CODES = 2
LOAD = 64
BLOCK = 512
MAX_CODEWORDS = 4096
#: Share of the pairs at the threshold that have a cap in common.
RECALL = 0.99
#: Caps of a code that each vector has at least.
LEAST = 4
#: Random pairs, and vectors of the table, that alpha is measured on.
PAIRS = 500
SEED = 20_240_101
BROADCAST_ROWS = 1_000_000


class ProductCode:
    """Random product code over ``dim`` coordinates with about ``directions``
    directions; made from a seed, so every task has the same one."""

    def __init__(self, dim: int, directions: int, per_vector: float = PER_VECTOR, seed: int = SEED):
        self.m = 1
        while round(directions ** (1 / self.m)) > MAX_CODEWORDS and self.m < dim:
            self.m += 1
        self.m = min(max(self.m, 2), dim)
        self.size = max(2, round(directions ** (1 / self.m)))
        self.edges = np.linspace(0, dim, self.m + 1).astype(int)
        rng = np.random.default_rng([seed, dim, self.m, self.size])
        self.books = []
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            c = rng.standard_normal((self.size, b - a))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.m))
        share = min(0.5, per_vector / self.size ** self.m)
        self.alpha = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)
        self.step = 0.25 / np.sqrt(dim)

    def scored(self, u: np.ndarray, alpha: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector the numbers of the directions with an inner
        product of at least alpha, sorted, and these products."""
        scores = [u[:, a:b] @ c.T for a, b, c in zip(self.edges[:-1], self.edges[1:], self.books)]
        best = np.array([s.max(axis=1) for s in scores])            # (m, n)
        rest = np.concatenate([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(u)))])
        for i in range(len(u)):
            have, sums = np.zeros(1, np.int64), np.zeros(1)
            for b, s in enumerate(scores):
                total = sums[:, None] + s[i][None, :]
                at = np.nonzero(total + rest[b, i] >= alpha)
                have, sums = have[at[0]] * self.size + at[1], total[at]
            order = np.argsort(have)
            yield have[order], sums[order]

    def decode(self, u: np.ndarray, least: int = 0) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of the caps that hold it; of
        its ``least`` best directions if it is in fewer caps."""
        out = [have for have, _ in self.scored(u, self.alpha)]
        least = min(least, self.size ** self.m)
        for i in [i for i, have in enumerate(out) if len(have) < least]:
            alpha, have = self.alpha, out[i]
            while len(have) < least:
                alpha -= self.step
                have, sums = next(self.scored(u[i:i + 1], alpha))
            out[i] = np.sort(have[np.argsort(-sums, kind="stable")[:least]])
        return out


def _partners(u: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one at the given cosine, in a random direction."""
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    if u.shape[1] == 1:
        return u
    return cosine * u + np.sqrt(max(0.0, 1 - cosine * cosine)) * _unit(w)


def make_codes(dim: int, directions: int, threshold: float = THRESHOLD,
               sample: np.ndarray | None = None) -> list[ProductCode]:
    """``CODES`` codes with the largest alpha, up to the one of ``PER_VECTOR``,
    at which ``RECALL`` of the pairs at the threshold share a cap: of random
    pairs, and of the unit vectors in ``sample`` with a partner each."""
    codes = [ProductCode(dim, directions, seed=SEED + k) for k in range(CODES)]
    rng = np.random.default_rng([SEED, dim])
    alpha = codes[0].alpha
    for u in [_unit(rng.standard_normal((PAIRS, dim)))] + ([] if sample is None else [sample]):
        v = _partners(u, threshold, rng)
        missed = int(len(u) * (1 - RECALL))
        while True:
            height = np.full(len(u), -np.inf)       # of the best direction shared
            for code in codes:
                for i, ((a, x), (b, y)) in enumerate(zip(code.scored(u, alpha), code.scored(v, alpha))):
                    _, p, q = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    if len(p):
                        height[i] = max(height[i], np.minimum(x[p], y[q]).max())
            reached = np.sort(height)[missed] if len(u) else alpha
            if reached >= alpha:
                break
            alpha -= codes[0].step
        # the last step may have gone too far
        alpha = min(codes[0].alpha, reached)
        for code in codes:
            code.alpha = alpha
    return codes


def _decode(codes: list[ProductCode]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            u = _unit(_matrix(batch.column("v"), n))
            # numbers of the caps of all codes, one code's after the other's
            first = np.cumsum([0] + [c.size ** c.m for c in codes])
            each = [[ids + f for ids in c.decode(u, LEAST)] for c, f in zip(codes, first)]
            caps = [np.concatenate(ids) for ids in zip(*each)]
            offs = np.concatenate([[0], np.cumsum([len(c) for c in caps])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(caps)))],
                names=["node", "caps"])
    return run


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _link_group(group: pa.RecordBatch, cap: int, bi: int, bj: int, threshold: float):
    """(vectors, smallest vector of their component in this group, links) of one
    pair of blocks of a cap."""
    node = np.asarray(group.column("node"))
    one = np.unique(node, return_index=True)[1]
    if len(one) < len(node):
        group = group.take(pa.array(one))
        node = node[one]
    u = _unit(_matrix(group.column("v"), len(node)))
    own = np.asarray(group.column("block"))
    left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
    link = u[left] @ u[right].T >= threshold
    if bi == bj:
        link = np.triu(link, 1)
    if not link.any():
        return None
    # a pair counts in the smallest cap that both share
    column = group.column("caps")
    flat = np.asarray(column.flatten())
    row = np.repeat(np.arange(len(node)), np.diff(np.asarray(column.offsets)))
    lower, at = np.unique(flat[flat < cap], return_inverse=True)
    if len(lower):
        has = np.zeros((len(node), len(lower)), np.float32)
        has[row[flat < cap], at] = 1
        link &= (has[left] @ has[right].T) == 0
    a, b = np.nonzero(link)
    a, b = left[a], right[b]
    mult = np.asarray(group.column("mult"))
    count = np.bincount(a, weights=mult[b], minlength=len(node)) \
        + np.bincount(b, weights=mult[a], minlength=len(node))
    low = np.arange(len(node))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    on = np.flatnonzero(count > 0)
    return node[on], node[low[on]], count[on].astype(np.int64)


def _links(threshold: float):
    """Rows sorted by (cap, bi, bj) to links; the rows of one group, about two
    blocks, are held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def joined(found):
            parts = zip(*found) if found else ([np.zeros(0, np.int64)],) * 3
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(x))) for x in parts],
                                              names=["a", "b", "w"])

        def groups(rows, last):
            key = np.stack([np.asarray(rows.column(c), dtype=np.int64) for c in ("cap", "bi", "bj")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(rows)]
            stop = len(edges) - 1 if last else len(edges) - 2
            found = [_link_group(rows.slice(x, y - x), *key[x].tolist(), threshold)
                     for x, y in zip(edges[:stop], edges[1:stop + 1]) if y - x > 1]
            return joined([f for f in found if f is not None]), rows.slice(edges[stop])

        for batch in batches:
            if not len(batch):
                continue
            out, held = groups(batch if held is None else pa.concat_batches([held, batch]), False)
            yield out
        if held is not None and len(held):
            yield groups(held, True)[0]
    return run


def near_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``id, n_links, component``."""
    ship(vectors.sparkSession)
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.expr("""v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL
        AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)""")
    # + 0.0 makes -0.0 and 0.0 one value
    rows = raw.select("id", F.when(F.coalesce(good, F.lit(False)), F.transform(
        "v", lambda x: x + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = stage(rows.filter("v is not null").groupBy("node").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")),
        "vector-classes")
    dims = [r["dim"] for r in classes.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("c")).filter("c > 1").select("dim").toLocalIterator()]
    links = None
    for dim in dims:
        same = classes.filter(F.size("v") == dim)
        directions = max(1024, same.count() * PER_VECTOR // LOAD)
        # the nodes are hashes: the smallest ones are a uniform sample
        some = [r["v"] for r in same.orderBy("node").limit(PAIRS).select("v").collect()]
        codes = make_codes(dim, directions, threshold, _unit(np.array(some)))
        caps = stage(same.select("node", "v").mapInArrow(
            _decode(codes), "node bigint, caps array<bigint>"), "vector-caps")
        posted = caps.select("node", F.explode("caps").alias("cap"))
        load = (posted.groupBy("cap").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
                .select("cap", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
        load = stage(load, "vector-loads")
        placed = (posted.join(bounded_broadcast(load, BROADCAST_ROWS), "cap")
                  .withColumn("block", F.expr("pmod(xxhash64(node, cap), blocks)"))
                  .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select("node", "cap", "block", F.least("block", "other").alias("bi"),
                          F.greatest("block", "other").alias("bj")))
        full = placed.join(same.join(caps, "node"), "node")
        found = (full.select("cap", "bi", "bj", "block", "node", "mult", "v", "caps")
                 .repartition("cap", "bi", "bj").sortWithinPartitions("cap", "bi", "bj")
                 .mapInArrow(_links(threshold), "a bigint, b bigint, w bigint"))
        found = stage(found, "vector-links")
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, w bigint")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    comp = components(links.select("a", "b"), "vectors").withColumnRenamed("component", "root")
    named = (classes.select("node", "rep", "mult").join(comp, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    ids = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = stage(named.join(ids, "root").join(counts, "node", "left").select(
        "node", "component", (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_links")),
        "vector-components")
    return rows.select("id", "node").join(named, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
