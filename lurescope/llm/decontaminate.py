"""Benchmark decontamination by SimHash windows.

A document is contaminated by a benchmark item when one of its *item-sized*
windows -- as many consecutive words as the item has -- is similar to it:

1. candidate windows are fingerprinted with a 128-bit SimHash over their word
   shingles (weighted by how often a shingle stands in the window) and compared
   with the items of the same size.  The fingerprint is cut into ``radius + 1``
   blocks; two fingerprints within ``radius`` bits must agree on one block whole
   (pigeonhole), so an index of the items by (size, block, block value) returns
   every item within the radius;
2. the exact weighted similarity of the shingle multisets (sum of minima over
   sum of maxima) of window and item decides, at ``threshold`` or more.

Only windows that hold at least one shingle of an item of their size are
fingerprinted: any other has similarity 0.  Windows move by single words over
whole texts.  The items are the broadcast side: they are read in chunks of at
most ``ITEMS_PER_PASS`` items and ``BYTES_PER_PASS`` bytes, and a larger
benchmark takes more passes over the documents.

Words are runs of non-space characters, lower-cased over A-Z, with ASCII
punctuation at either end removed; an all-punctuation word keeps its place as
an empty word.  An item with fewer words than a shingle is its whole word
sequence as one shingle; an item without a word matches nothing.

Defined results: null text counts as empty and is clean; equal items are
reported each; rows that share an id are judged each by their own text (one
report per (id, item), the best window of all); null ids are reported as such;
other columns are ignored by ``contaminated`` and passed through by
``clean_documents``.  Texts of any length are read whole; several windows of
one item are one report with the first start and the best similarity; an empty table, or no items, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import textscan as T
from lurescope.llm.common import ship, stage, with_text

SHINGLE = 5
THRESHOLD = 0.8
#: Hamming radius of 128-bit fingerprints.  Sets of similarity 0.8 have a
#: cosine of 0.89 on average, an angle of 0.15 * 128 = 19 expected bits with a
#: deviation of 4.
RADIUS = 36
BITS = 128
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20

_STRIP = np.zeros(256, bool)
_STRIP[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def words(s: T.Scan) -> np.ndarray:
    """Word hashes with the ASCII punctuation around each word taken off."""
    start, end = s.start.copy(), s.end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        live = live[_STRIP[s.data[end[live] - 1]]]
        end[live] -= 1
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live])]
        live = live[_STRIP[s.data[start[live]]]]
        start[live] += 1
    return T.span_hashes(s, start, end)


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Shingles of one word sequence; shorter than k: the whole as one."""
    m = min(k, len(w))
    if not m:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - m + 1, np.uint64)
    for j in range(m):
        h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - m + 1 + j])
    return h


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 / -1 for each of the 128 bits of each shingle."""
    parts = np.stack([T.mix(h + np.uint64(1)), T.mix(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    bits = np.unpackbits(parts.view(np.uint8).reshape(len(h), 16), axis=1)
    return bits.astype(np.int16) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return (sums > 0).astype(np.uint8)


def _blocks(bits: np.ndarray, radius: int) -> np.ndarray:
    """(rows, radius + 1) block values of 0/1 fingerprints."""
    edges = np.linspace(0, BITS, radius + 2).astype(int)
    out = np.zeros((len(bits), radius + 1), np.int64)
    for b in range(radius + 1):
        for c in range(edges[b], edges[b + 1]):
            out[:, b] = out[:, b] * 2 + bits[:, c]
    return out


class Items:
    """A bounded chunk of benchmark items, indexed for the search."""

    def __init__(self, ids: list, texts: list[str], k: int = SHINGLE, radius: int = RADIUS):
        self.k, self.radius = k, radius
        self.ids, self.size, self.sh = [], [], []
        col = pa.array(texts, pa.string())
        for a, b, s in T.column_scans(col, T.NOT_SPACE):
            h = words(s)
            for i in range(b - a):
                w = h[s.doc_first[i]:s.doc_first[i + 1]]
                if len(w):
                    self.ids.append(ids[a + i])
                    self.size.append(len(w))
                    self.sh.append(shingle_hashes(w, k))
        self.size = np.array(self.size, np.int64)
        self.bits = np.array([_fingerprints(_signs(x).sum(0, dtype=np.int32)) for x in self.sh]) \
            if self.sh else np.zeros((0, BITS), np.uint8)
        self.blocks = _blocks(self.bits, radius)
        self.counts = [dict(zip(*np.unique(x, return_counts=True))) for x in self.sh]
        # shingle length -> sorted shingle hashes; hash -> sizes of its items
        self.by_size = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size)}
        self.known, self.sizes_of = {}, {}
        for i, x in enumerate(self.sh):
            m = min(k, int(self.size[i]))
            self.known.setdefault(m, []).append(np.unique(x))
            for h in set(x.tolist()):
                self.sizes_of.setdefault((m, h), set()).add(int(self.size[i]))
        self.known = {m: np.unique(np.concatenate(x)) for m, x in self.known.items()}
        self.index: dict = {}
        for i in range(len(self.sh)):
            for b in range(radius + 1):
                self.index.setdefault((int(self.size[i]), b, int(self.blocks[i, b])), []).append(i)

    def hits(self, w: np.ndarray) -> dict[int, list[np.ndarray]]:
        """size -> positions of the text's shingles that an item of it has."""
        out: dict[int, list] = {}
        for m, known in self.known.items():
            if len(w) < m:
                continue
            h = shingle_hashes(w, m)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == h):
                for n in self.sizes_of[(m, int(h[p]))]:
                    out.setdefault(n, []).append(int(p))
        return out

    def search(self, w: np.ndarray, threshold: float) -> dict[int, tuple[int, int, float]]:
        """item -> (windows, first start, best similarity) for one text."""
        found: dict[int, tuple[int, int, float]] = {}
        for n, places in self.hits(w).items():
            m = min(self.k, n)
            if len(w) < n:      # the whole text is the window
                self._windows(w, n, m, np.zeros(1, np.int64), threshold, found)
                continue
            # starts of the windows that hold one of these shingles
            places = np.unique(places)
            lo = np.maximum(places - (n - m), 0)
            hi = np.minimum(places, len(w) - n)
            near = np.zeros(len(w) - n + 2, np.int64)
            ok = lo <= hi
            np.add.at(near, lo[ok], 1)
            np.add.at(near, hi[ok] + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for part in range(0, len(run), 2048):
                    self._windows(w, n, m, run[part:part + 2048], threshold, found)
        return found

    def _windows(self, w, n, m, starts, threshold, found) -> None:
        if not len(starts):
            return
        sh = shingle_hashes(w[starts[0]:starts[-1] + n], m)
        total = np.zeros((len(sh) + 1, BITS), np.int32)
        np.cumsum(_signs(sh), axis=0, out=total[1:])
        per = min(n, len(w)) - m + 1
        bits = _fingerprints(total[per:][:len(starts)] - total[:len(starts)])
        blocks = _blocks(bits, self.radius)
        items = self.by_size[n]
        # block agreement with the items of this size, then the distance
        for i in items:
            agree = np.flatnonzero((blocks == self.blocks[i]).any(axis=1))
            if not len(agree):
                continue
            agree = agree[(bits[agree] != self.bits[i]).sum(axis=1) <= self.radius]
            for a in agree:
                got = similarity(sh[a:a + per], self.counts[i], len(self.sh[i]))
                if got >= threshold:
                    c, first, best = found.get(i, (0, int(starts[a]), 0.0))
                    found[i] = (c + 1, min(first, int(starts[a])), max(best, got))


def similarity(sh: np.ndarray, item: dict, item_total: int) -> float:
    """Weighted Jaccard of two shingle multisets."""
    values, counts = np.unique(sh, return_counts=True)
    low = sum(min(int(c), int(item.get(v, 0))) for v, c in zip(values, counts))
    return low / (len(sh) + item_total - low)


def _search(items: Items, threshold: float):
    known = {m: k for m, k in items.known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a, b, s in T.column_scans(batch.column("text"), T.NOT_SPACE):
                h = words(s)
                # texts without any shingle of an item are done with
                live = np.zeros(b - a, bool)
                doc = s.doc_of_word()
                for m, k in known.items():
                    if len(h) < m:
                        continue
                    sh = shingle_hashes(h, m)
                    at = np.searchsorted(k, sh)
                    at[at == len(k)] = 0
                    hit = np.flatnonzero(k[at] == sh)
                    live[doc[hit[doc[hit] == doc[hit + m - 1]]]] = True
                for i in np.flatnonzero(live):
                    w = h[s.doc_first[i]:s.doc_first[i + 1]]
                    for item, (c, first, best) in items.search(w, threshold).items():
                        rows.append((a + int(i), items.ids[item], c, first, best))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("rk").take(at),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64()),
                 pa.array([r[4] for r in rows], pa.float64())],
                names=["id", "rk", "item_id", "n_windows", "first_word", "similarity"])
    return run


def item_chunks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Bounded chunks of the items, streamed to the driver partition by partition."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(
        "t is not null").distinct()
    for r in rows.toLocalIterator():
        if ids and (len(ids) >= ITEMS_PER_PASS or size + len(r["t"]) > BYTES_PER_PASS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text",
                 item_col="item_id", item_text="text", threshold: float = THRESHOLD,
                 radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, rk, item_id, n_windows, first_word, similarity) for each document
    and benchmark item it holds."""
    spark = docs.sparkSession
    ship(spark)
    schema = ("id bigint, rk bigint, item_id bigint, n_windows bigint, first_word bigint, "
              "similarity double")
    texts = with_text(docs, id_col, text_col)
    out = None
    for ids, item_texts in item_chunks(benchmark, item_col, item_text):
        found = texts.mapInArrow(_search(Items(ids, item_texts, shingle, radius), threshold), schema)
        found = stage(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text",
                    **kw) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminated(docs, benchmark, id_col, text_col, **kw).select(
        F.col("rk").alias("_leak_rk")).distinct()
    rk = F.xxhash64(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(bad, rk == bad["_leak_rk"], "left_anti")
