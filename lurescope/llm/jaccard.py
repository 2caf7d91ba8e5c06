"""N-gram Jaccard join in the Jaccard metric space.

Documents are sets of word shingles, ``d = 1 - J`` is a metric, and two
documents link at ``100 * |A n B| >= percent * |A u B|``.

* **Classes.**  Documents with the same set are one class (a 128-bit sum over
  the set); only classes are compared, so a group of copies costs nothing.
* **Regions.**  Under one global order of the shingles (frequent ones last) a
  linked pair shares a shingle among the first ``n - ceil(p n / 100) + 1`` of
  each set.  The classes that share such a shingle are a region.  (Pivots drawn
  from the corpus alone cannot cut it up: nearly all texts are at distance 1
  from nearly all others.)
* **Pivots.**  Each region takes its smallest class as pivot.  The two prefixes
  hold all shingles of both sets up to the smaller of their last ones, which
  bounds the overlap from above; only pairs that the bound leaves within
  ``2 eps`` have their exact distance computed, once per (class, pivot).  The
  region falls into cells: *inner* classes (``d <= eps``) are linked to the pivot and so to
  one another's component -- no pair among them is formed, whatever the size of
  the group; *outer* ones (``d > eps``) are not.
* **Windows.**  By the triangle inequality an outer class y can only link to an
  inner class z if ``d(y) <= 2 eps`` and ``d(y) - d(z) <= eps``: these boundary
  classes are replicated to the inner cell and compared there.  A region stands for
  the first shingle that a linked pair shares, so its places in the two sets bound the
  overlap too: only what is left behind both can be shared.
* **Recursion.**  The outer classes of a region form a region of their own with
  a new pivot, which also meets the inner classes of the cell it comes from.
  After ``rounds`` rounds the pairs left within the windows are compared, but
  only those whose classes no link has joined yet.

Every step keeps exactly the pairs that can link, so components are exact.
Sets are built from whole texts; verification intersects whole sets.

Defined results: null or empty text, or text without words, has the empty set,
``n_shingles`` 0, and links with nothing; rows with the same set link.  Rows
that share an id are one node (the links of all its texts); null ids link like
any other and take the component's smallest id, or null if it has none.  Other
columns are ignored by ``similarity_classes`` and passed through by
``keep_one_of_each``, where all rows of a group's smallest id stay.  A similarity of
exactly the threshold is a link; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import textscan as T
from lurescope.llm.common import (bounded_broadcast, components, most_frequent, ship, stage,
                                  with_text)

SHINGLE = 4
PERCENT = 85
ROUNDS = 3
#: Bound of the list of frequent shingles, which only shapes the order.
FREQUENT = 1_000_000
FREQUENT_IN_BATCH = 3
_FLUSH = 4_000_000
#: Row bound of the small tables that may be broadcast.
BROADCAST_ROWS = 1_000_000
_NO_ID = 1 << 62


def _frequent_parts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else \
                (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            on = c >= FREQUENT_IN_BATCH
            return pa.RecordBatch.from_arrays(
                [pa.array(h[on].view(np.int64)), pa.array(c[on].astype(np.int64))],
                names=["token", "c"])

        for batch in batches:
            for _a, _b, s in T.column_scans(batch.column("text"), T.NOT_SPACE):
                h, _ = T.distinct_per_doc(*T.shingles(s, k))
                held.append(h)
                n += len(h)
                if n >= _FLUSH:
                    yield flush()
                    held, n = [], 0
        yield flush()
    return run


def frequent_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """At most FREQUENT shingles, rarest first, that stand in many documents."""
    parts = texts.select("text").mapInArrow(_frequent_parts(k), "token bigint, c bigint")
    counts = stage(parts.groupBy("token").agg(F.sum("c").alias("c")), "jaccard-frequent")
    top = most_frequent(counts, "c", FREQUENT).toPandas().sort_values(["c", "token"])
    return top["token"].to_numpy(np.int64).view(np.uint64)


def _sets(k: int, percent: int, frequent: np.ndarray):
    """Size, class and prefix of each text's set.  A prefix holds codes in the
    global order: 63 bits of the hash, or 2**63 + rank for frequent shingles."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in T.column_scans(batch.column("text"), T.NOT_SPACE):
                h, d = T.distinct_per_doc(*T.shingles(s, k))
                n = np.bincount(d, minlength=b - a)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(
                    T.mix(h ^ np.uint64(seed)), dtype=np.uint64)]) for seed in
                    (0x243F6A8885A308D3, 0x13198A2E03707344)]
                first = np.concatenate([[0], np.cumsum(n)])
                k1, k2 = ((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)
                code = h >> np.uint64(1)
                if len(known) and len(h):
                    at = np.searchsorted(known, h)
                    at[at == len(known)] = 0
                    hit = known[at] == h
                    code[hit] = rank[at[hit]] + np.uint64(1 << 63)
                by = np.lexsort((code, d))
                size = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                prefix = code[by[np.repeat(first[:-1], size) + take]]
                offs = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("rk").slice(a, b - a),
                     pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2),
                     pa.ListArray.from_arrays(offs, pa.array(prefix.view(np.int64)))],
                    names=["id", "rk", "n", "k1", "k2", "prefix"])
    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper bound of the overlap of each pair, from sizes and prefixes."""
    for batch in batches:
        out = []
        for x, y, n, m in zip(batch.column("prefix_a"), batch.column("prefix_b"),
                              batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()):
            x = np.asarray(x.values).view(np.uint64)
            y = np.asarray(y.values).view(np.uint64)
            last = min(x[-1], y[-1])
            x, y = (z[:np.searchsorted(z, last, side="right")] for z in (x, y))
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum()) if len(y) else 0
            out.append(common + min(n - len(x), m - len(y)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"),
             pa.array(out, pa.int64())], names=["a", "b", "n_a", "n_b", "most"])


def _set_bytes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in T.column_scans(batch.column("text"), T.NOT_SPACE):
                h, d = T.distinct_per_doc(*T.shingles(s, k))
                at = np.searchsorted(d, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a), batch.column("rk").slice(a, b - a),
                     pa.array([h[at[i]:at[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    names=["node", "rk", "bytes"])
    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column("bytes_a"), batch.column("bytes_b")
        inter, union = [], []
        for x, y in zip(sa, sb):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            y = np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            c = int((large[at] == small).sum()) if len(large) else 0
            inter.append(c)
            union.append(len(x) + len(y) - c)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()),
             pa.array(union, pa.int64())], names=["a", "b", "common", "all"])


class _Verifier:
    """Exact overlaps of pairs of classes whose prefixes leave ``least`` percent
    of similarity possible, over whole sets."""

    def __init__(self, prefixes: DataFrame, texts: DataFrame, k: int, percent: int):
        self.prefixes, self.texts, self.k, self.percent = prefixes, texts, k, percent

    def __call__(self, pairs: DataFrame, least: int) -> DataFrame:
        """(a, b) -> (a, b, d, linked) of the pairs that can reach ``least``
        percent, staged."""
        pairs = stage(pairs.select("a", "b").filter("a <> b").distinct(), "jaccard-pairs")
        few = bounded_broadcast(pairs, BROADCAST_ROWS)
        mine, theirs = (self.prefixes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"),
                                             F.col("prefix").alias(f"prefix_{c}")) for c in "ab")
        # of the many classes only those that are some pair's b are dealt by it
        theirs = theirs.join(few.select("b"), "b", "left_semi")
        can = (mine.join(few, "a").join(theirs, "b")
               .select("a", "b", "n_a", "n_b", "prefix_a", "prefix_b")
               .mapInArrow(_bounds, "a bigint, b bigint, n_a bigint, n_b bigint, most bigint")
               .filter(100 * F.col("most") >= least * (F.col("n_a") + F.col("n_b") - F.col("most")))
               .select("a", "b").distinct())
        can = stage(can, "jaccard-candidates")
        nodes = stage(can.select(F.col("a").alias("node")).unionByName(
            can.select(F.col("b").alias("node"))).distinct(), "jaccard-nodes")
        sets = (self.texts.withColumn("node", _own_node())
                .join(bounded_broadcast(nodes, BROADCAST_ROWS), "node").select("node", "rk", "text")
                .mapInArrow(_set_bytes(self.k), "node bigint, rk bigint, bytes binary"))
        sets = stage(sets, "jaccard-sets")
        left = sets.select(F.col("node").alias("a"), F.col("bytes").alias("bytes_a"))
        few = bounded_broadcast(can, BROADCAST_ROWS)
        right = sets.select(F.col("node").alias("b"), F.col("bytes").alias("bytes_b")).join(
            few.select("b"), "b", "left_semi")
        got = (left.join(few, "a").join(right, "b")
               .select("a", "b", "bytes_a", "bytes_b")
               .mapInArrow(_overlap, "a bigint, b bigint, common bigint, all bigint"))
        got = got.groupBy("a", "b").agg(
            F.min((1 - F.col("common") / F.col("all"))).alias("d"),
            F.max(100 * F.col("common") >= self.percent * F.col("all")).alias("linked"))
        return stage(got, "jaccard-distances")


def _own_node():
    """A row's node: its id, or a number beyond all ids where it has none."""
    return F.coalesce("id", F.lit(_NO_ID) + F.pmod("rk", F.lit(_NO_ID >> 1)))


def _met(region: DataFrame) -> DataFrame:
    """Pivot of each region of at least two classes."""
    return region.groupBy("token").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last"),
        F.min_by("n", "node").alias("pivot_n")).filter("last > pivot").drop("last")


def similarity_edges(rows: DataFrame, texts: DataFrame, reps: DataFrame, k: int, percent: int,
                     rounds: int) -> DataFrame:
    """Links (a, b) between classes that join all components, staged."""
    eps = 1 - percent / 100
    near = 100 - 2 * (100 - percent)              # at most 2 eps apart
    # one row per class (and text, where rows share an id)
    mine = (rows.join(bounded_broadcast(reps.select("k1", "k2", "n", "node"), BROADCAST_ROWS),
                      ["k1", "k2", "n"]).filter(_own_node() == F.col("node"))
            .select("node", "n", "prefix"))
    postings = mine.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    region = stage(postings.join(_met(postings), "token").distinct(), "jaccard-regions")
    verify = _Verifier(mine, texts, k, percent)

    def similar_size(x, y, p):
        return F.expr(f"100 * least({x}, {y}) >= {p} * greatest({x}, {y})")

    def side(rows: DataFrame, c: str, d: str) -> DataFrame:
        """The rows as side a or b of a join of pairs, with distance ``d``."""
        return rows.select("token", F.col("node").alias(c), F.col("n").alias(f"{c}n"),
                           F.col("pos").alias(f"{c}p"), F.col(d).alias(f"{c}d"),
                           *([F.col("c").alias(f"{c}c")] if "c" in rows.columns else []))

    # the token is the first that a linked pair shares: the rest of either set bounds the overlap
    left_over = "least(an - ap, bn - bp)"
    first_shared = F.expr(f"100 * {left_over} >= {percent} * (an + bn - {left_over})")
    window = F.col("ad") - F.col("bd") <= eps + 1e-9

    edges, cells, bridges, region_d = [], [], [], None
    for _ in range(rounds):
        dist = verify(region.filter(similar_size("n", "pivot_n", near)).select(
            F.col("node").alias("a"), F.col("pivot").alias("b")), near)
        edges.append(dist.filter("linked").select("a", "b"))
        close_to = dist.filter(F.col("d") <= 2 * eps + 1e-9).select(
            F.col("b").alias("pivot"), F.col("a").alias("node"), "d", F.col("linked").alias("inner"))
        # classes without a distance are further than 2 eps from the pivot
        cell = stage(region.filter("node <> pivot").join(close_to, ["node", "pivot"], "left")
                     .select("token", "node", "n", "pos", F.col("d").alias("d0"),
                             F.coalesce("inner", F.lit(False)).alias("inner")), "jaccard-cells")
        cells.append(cell.filter("d0 IS NOT NULL"))
        left = cell.filter("NOT inner").drop("inner")
        region_d = stage(left.join(_met(left), "token"), "jaccard-regions")
        if region_d.isEmpty():
            region_d = None
            break
        # the next pivots meet the inner classes of the cell they come from
        new = side(region_d.filter("node = pivot AND d0 IS NOT NULL"), "a", "d0")
        bridges.append(new.join(side(cell.filter("inner"), "b", "d0"), "token")
                       .filter(window & first_shared).select("a", "b"))
        region = region_d.drop("d0")
    if bridges:
        edges.append(verify(_union(bridges), percent).filter("linked").select("a", "b"))
    # pairs of one component need no comparison any more
    known = stage(components(_union(edges), "jaccard-first"), "jaccard-first-components")

    def named(rows: DataFrame) -> DataFrame:
        return (rows.join(known, "node", "left")
                .withColumn("c", F.coalesce("component", "node")).drop("component"))

    rest = []
    for cell in cells:
        cell = named(cell)
        rest.append(side(cell.filter("NOT inner"), "a", "d0").join(
            side(cell.filter("inner"), "b", "d0"), "token")
            .filter((F.col("ac") != F.col("bc")) & window & first_shared).select("a", "b"))
    if region_d is not None:
        # what is left of each region: pairs within the window of its last pivot
        last = named(region_d.select("token", "node", "n", "pos", "d0"))
        rest.append(side(last, "a", "d0").join(side(last, "b", "d0"), "token").filter(
            (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & first_shared
            & (F.coalesce(F.abs(F.col("ad") - F.col("bd")), F.lit(0.0)) <= eps + 1e-9))
            .select("a", "b"))
    edges.append(verify(_union(rest), percent).filter("linked").select("a", "b"))
    return _union(edges)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def similarity_classes(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE,
                       percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``id, rk, n_shingles, component``."""
    ship(docs.sparkSession)
    texts = with_text(docs, id_col, text_col)
    frequent = frequent_shingles(texts, shingle)
    rows = stage(texts.mapInArrow(_sets(shingle, percent, frequent),
                                  "id bigint, rk bigint, n bigint, k1 bigint, k2 bigint, "
                                  "prefix array<bigint>"), "jaccard-sets-of-documents")
    named = rows.select("id", "rk", "n", "k1", "k2").withColumn("own", _own_node())
    reps = stage(named.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("own").alias("node")),
                 "jaccard-classes")
    edges = similarity_edges(rows, texts, reps, shingle, percent, rounds)
    # rows that share an id are one node
    own = (named.filter("n > 0").join(reps, ["k1", "k2", "n"])
           .select(F.col("own").alias("a"), F.col("node").alias("b")))
    twice = named.filter("id is not null").groupBy("id").agg(
        F.countDistinct("rk").alias("c")).filter("c > 1").select("id")
    edges = edges.unionByName(own.join(twice, own["a"] == twice["id"], "left_semi"))
    comp = stage(components(edges, "jaccard"), "jaccard-components")
    node = named.join(reps, ["k1", "k2", "n"], "left")
    out = node.join(comp, "node", "left").select(
        "id", "rk", F.col("n").alias("n_shingles"),
        F.coalesce("component", "node", "own").alias("component"))
    return out.withColumn("component", F.when(F.col("component") < _NO_ID, F.col("component")))


def keep_one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The rows of ``docs`` without the later members of each group of similar
    texts: the row with the smallest id stays.  Rows with null id or an empty
    set always stay."""
    got = similarity_classes(docs, id_col, text_col, **kw)
    gone = stage(got.filter("n_shingles > 0 and id is not null and id <> component")
                 .select(F.col("rk").alias("_copy_rk")).distinct(), "jaccard-copies")
    rk = F.xxhash64(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, rk == gone["_copy_rk"], "left_anti")
