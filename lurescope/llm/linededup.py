"""Line dedup by winnowing over line hashes.

A document is its sequence of lines (split at line feeds).  The unit of a match
is a *window*: the shortest run of consecutive lines, starting at some line,
that holds ``min_words`` words.  The smallest line hash of each window is a
selected fingerprint, so any run of lines with at least ``min_words`` words
that two places share holds a window of the same lines and with it a shared
fingerprint: the guarantee of winnowing, with the window measured in words.

1. every window emits its fingerprint position, keyed by (fingerprint, window
   hash);
2. the first place of each key -- smallest (document, line) -- is found with
   ``min`` (a partial aggregate: a key may hold a third of all rows);
3. later places join that first place and are extended line by line both ways
   over the two documents' line hashes;
4. the union of a document's matched runs is deleted from its text.

Lines can be long, so repeated *passages* inside lines, or from the middle of
one line to the middle of another, are found the same way with words as the
units: every run of ``PASSAGE_WORDS`` words has a hash, the smallest of each
``PASSAGE_WINDOW`` consecutive hashes is a fingerprint, and a fingerprint's later
places are extended word by word from its first place.  A repeated run of more
than 50 words holds a fingerprint; extended runs of fewer than ``PASSAGE_LEAST``
words stay.  Passages are those of the input texts, so two pieces that only come
to stand together because what was between them is deleted are not one.

A deleted line or word has an equal one earlier in the corpus, and the first
occurrence is never deleted, up to hash collisions: lines are compared by 64 bits, the
words of a passage by 32 bits each (around a fingerprint of 64), so a passage may be one
word too long with a probability of 2^-32 at each end.

Order and defined results: places are ordered by (id, row key, line), null ids
first; the row key tells rows apart that share an id but differ in text.  Rows
equal in id and text are one document and get the same result.  Null text
counts as empty; an empty text has one empty line.  White space at the ends of
a line does not count for its hash, letter case does.  Lines without a word
count 0 words and go only inside a longer run.  Other columns pass through
unchanged, whatever their names; the text column holds the kept lines joined by
line feeds.  Texts of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import textscan as T
from lurescope.llm.common import free_name, ship, stage, unstage, with_text

#: Words of the shortest run that is deleted when it repeats.
MIN_WORDS = 8
#: Words that a fingerprint of a passage hashes, and hashes per window: any
#: PASSAGE_WORDS + PASSAGE_WINDOW - 1 = 51 words hold a fingerprint.
PASSAGE_WORDS = 12
PASSAGE_WINDOW = 40
#: Words of the shortest extended passage that is deleted inside lines.
PASSAGE_LEAST = 26


def line_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, lines per text, line hashes, words per line) for slices of a column."""
    for a, b, s in T.column_scans(column, T.NOT_SPACE, lower=False):
        n = b - a
        feeds = np.flatnonzero(s.data == 0x0A)
        per_doc = np.searchsorted(feeds, s.text_start[1:]) - np.searchsorted(feeds, s.text_start[:-1]) + 1
        first_line = np.concatenate([[0], np.cumsum(per_doc)])
        doc = s.doc_of_word()
        # line of a word: feeds before it, plus one line for each text border
        line = np.searchsorted(feeds, s.start) + doc
        m = int(first_line[-1])
        words = np.bincount(line, minlength=m)
        # order-sensitive sum over the words of a line
        begin = np.concatenate([[0], np.cumsum(words)])
        pos = np.arange(len(line)) - begin[line]
        mixed = T.mix(s.hashes + T.mix(pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        h = T.mix(total[begin[1:]] - total[begin[:-1]] + words.astype(np.uint64))
        assert m == int(per_doc.sum()) and len(per_doc) == n
        yield a, b, per_doc, h.view(np.int64), words


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, per_doc, h, words in line_hashes(batch.column("text")):
            offs = pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), batch.column("rk").slice(a, b - a),
                 pa.ListArray.from_arrays(offs, pa.array(h)),
                 pa.ListArray.from_arrays(offs, pa.array(words.astype(np.int32)))],
                names=["id", "rk", "h", "w"])


def windows(h: np.ndarray, w: np.ndarray, stop: np.ndarray, min_words: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, selected line, window hash) of each window of some texts, whose lines
    stand one after the other; ``stop`` is the end of each line's text."""
    total = np.concatenate([[0], np.cumsum(w)])
    end = np.searchsorted(total, total[:-1] + min_words, side="left")   # exclusive
    start = np.flatnonzero((end <= stop) & (w > 0))
    end = end[start]
    if not len(start):
        return start, start, np.zeros(0, np.int64)
    size = end - start
    best, pick = h[start].copy(), start.copy()
    u = h.view(np.uint64)
    acc = T.mix(u[start])
    for j in range(1, int(size.max())):
        on = np.flatnonzero(size > j)
        at = start[on] + j
        lower = h[at] < best[on]
        best[on[lower]] = h[at[lower]]
        pick[on[lower]] = at[lower]
        acc[on] = T.mix(acc[on] * np.uint64(0x9E3779B97F4A7C15) + u[at])
    return start, pick, acc.view(np.int64)


def _fingerprints(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_doc = batch.column("h").value_lengths().to_numpy(zero_copy_only=False)
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False)
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(per_doc)])
            doc = np.repeat(np.arange(len(batch)), per_doc)
            first, pick, key = windows(h, w, begin[1:][doc], min_words)
            take = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("rk").take(take),
                 pa.array(pick - begin[doc[first]]), pa.array(h[pick]), pa.array(key)],
                names=["id", "rk", "pos", "fp", "win"])
    return run


def _extend(min_words: int):
    """Lengthen each match both ways; one (id, rk, first, last) run per match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            lo, hi, keep = [], [], []
            for i in range(len(batch)):
                h, g = np.asarray(col["h"][i].values), np.asarray(col["src_h"][i].values)
                shift, done = col["shift"][i].as_py(), -1
                for p in sorted(col["at"][i].as_py()):
                    if p <= done:        # inside the run just found on this diagonal
                        continue
                    q = p - shift
                    n = min(len(h) - p, len(g) - q)
                    differ = np.flatnonzero(h[p:p + n] != g[q:q + n])
                    after = int(differ[0]) if len(differ) else n
                    n = min(p, q)
                    differ = np.flatnonzero(h[p - n:p][::-1] != g[q - n:q][::-1])
                    before = int(differ[0]) if len(differ) else n
                    done = p + after - 1
                    words = np.asarray(col["w"][i].values)[p - before:p + after]
                    if after and words.sum() >= min_words:
                        keep.append(i)
                        lo.append(p - before)
                        hi.append(done)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [col["id"].take(at), col["rk"].take(at), pa.array(lo, pa.int64()),
                 pa.array(hi, pa.int64())], names=["id", "rk", "first", "last"])
    return run


def repeated_runs(docs: DataFrame, id_col="doc_id", text_col="text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(rk, runs): for each document with repeated lines the runs of line
    numbers (from 0, both ends inclusive) that occur earlier."""
    ship(docs.sparkSession)
    lines = stage(with_text(docs, id_col, text_col).mapInArrow(
        _lines, "id bigint, rk bigint, h array<bigint>, w array<int>").dropDuplicates(["rk"]),
        "lines")
    fps = stage(lines.mapInArrow(_fingerprints(min_words),
                                 "id bigint, rk bigint, pos bigint, fp bigint, win bigint"),
                "line-fingerprints")
    # staged, so that both sides of the join are plain shuffles and a hot window
    # (a line in a third of all texts) is a skewed partition that Spark splits
    first = stage(fps.groupBy("fp", "win").agg(
        F.min(F.struct("id", "rk", "pos")).alias("src"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("fp", "win", "src"), "line-first-places")
    later = (fps.join(first, ["fp", "win"])
             .filter("struct(id, rk, pos) > src")
             # matches on one diagonal of two documents extend to one another
             .select("id", "rk", "pos", F.col("src.rk").alias("src_rk"),
                     F.col("src.pos").alias("src_pos"))
             .groupBy("id", "rk", "src_rk", F.expr("pos - src_pos").alias("shift"))
             .agg(F.collect_set("pos").alias("at")))
    later = stage(later, "line-matches")
    unstage(fps, first)
    mine = lines.select("rk", "h", "w")
    theirs = lines.select(F.col("rk").alias("src_rk"), F.col("h").alias("src_h"))
    found = (later.join(mine, "rk").join(theirs, "src_rk")
             .select("id", "rk", "at", "shift", "h", "w", "src_h")
             .mapInArrow(_extend(min_words), "id bigint, rk bigint, first bigint, last bigint"))
    found = stage(found.groupBy("rk").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "line-runs")
    unstage(lines, later)
    return found


def _picks(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the smallest hash (of equal ones the first) of each window; windows
    stay in one text."""
    n = len(h) - PASSAGE_WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, pick, size = h, np.arange(len(h)), 1

    def joined(shift):
        left, right = low[:-shift], low[shift:]
        later = right < left
        return np.where(later, right, left), np.where(later, pick[shift:], pick[:-shift])

    while size < PASSAGE_WINDOW:  # windows of twice the size from two of half of it
        shift = min(size, PASSAGE_WINDOW - size)
        low, pick = joined(shift)
        size += shift
    return np.unique(pick[doc[:n] == doc[PASSAGE_WINDOW - 1:]])


def _passage_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, s in T.column_scans(batch.column("text"), T.NOT_SPACE, lower=False):
            doc, n = s.doc_of_word(), len(s.hashes) - PASSAGE_WORDS + 1
            if n <= 0:
                continue
            h = np.zeros(n, np.uint64)
            for j in range(PASSAGE_WORDS):
                h = (h + s.hashes[j:n + j]) * np.uint64(T.BASE)
            whole = np.flatnonzero(doc[:n] == doc[PASSAGE_WORDS - 1:])
            h, doc = T.mix(h[whole]), doc[whole]
            at = _picks(h, doc)
            take = pa.array(doc[at] + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("rk").take(take),
                 pa.array((whole[at] - s.doc_first[doc[at]]).astype(np.int32)),
                 pa.array(h[at].view(np.int64))], names=["id", "rk", "pos", "fp"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, s in T.column_scans(batch.column("text"), T.NOT_SPACE, lower=False):
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk").slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(s.doc_first.astype(np.int32)),
                    pa.array((s.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))],
                names=["rk", "h"])


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common prefix, read in growing pieces."""
    n, a, step = min(len(x), len(y)), 0, 64
    while a < n:
        b = min(n, a + step)
        differ = np.flatnonzero(x[a:b] != y[a:b])
        if len(differ):
            return a + int(differ[0])
        a, step = b, step * 4
    return n


def _extend_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages that one text has from another, as (rk, first, last) word."""
    for batch in batches:
        keep, lo, hi = [], [], []
        for i in range(len(batch)):
            h, g = (np.asarray(batch.column(c)[i].values) for c in ("h", "src_h"))
            done = -1
            for p, q in sorted((x["pos"], x["src_pos"]) for x in batch.column("at")[i].as_py()):
                if p + PASSAGE_WORDS - 1 <= done:       # deleted already
                    continue
                after = _same(h[p:], g[q:])
                before = _same(h[:p][::-1], g[:q][::-1])
                # equal hash but other words, or too short a passage
                if after < PASSAGE_WORDS or before + after < PASSAGE_LEAST:
                    continue
                done = max(done, p + after - 1)
                keep.append(i)
                lo.append(p - before)
                hi.append(p + after - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rk").take(pa.array(keep, pa.int64())), pa.array(lo, pa.int64()),
             pa.array(hi, pa.int64())], names=["rk", "first", "last"])


def repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(rk, passages): for each document with repeated passages the runs of word
    numbers (from 0, both ends inclusive) that occur earlier."""
    ship(docs.sparkSession)
    texts = with_text(docs, id_col, text_col)
    fps = stage(texts.mapInArrow(_passage_fingerprints, "id bigint, rk bigint, pos int, fp bigint"),
                "passage-fingerprints")
    first = stage(fps.groupBy("fp").agg(
        F.min(F.struct("id", "rk", "pos")).alias("src"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("fp", "src"), "passage-first-places")
    later = stage(fps.join(first, "fp").filter("struct(id, rk, pos) > src")
                  .groupBy("rk", F.col("src.rk").alias("src_rk"))
                  .agg(F.collect_set(F.struct("pos", F.col("src.pos").alias("src_pos"))).alias("at")),
                  "passage-matches")
    unstage(fps, first)
    taking = later.select("rk").union(later.select("src_rk")).distinct()
    words = stage(texts.select("rk", "text").join(taking, "rk", "left_semi")
                  .mapInArrow(_words, "rk bigint, h array<int>").dropDuplicates(["rk"]), "passage-words")
    found = (later.join(words, "rk")
             .join(words.select(F.col("rk").alias("src_rk"), F.col("h").alias("src_h")), "src_rk")
             .select("rk", "at", "h", "src_h")
             .mapInArrow(_extend_passages, "rk bigint, first bigint, last bigint"))
    found = stage(found.groupBy("rk").agg(F.collect_set(F.struct("first", "last")).alias("passages")), "passage-runs")
    unstage(later, words)
    return found


def _covered(runs, n: int) -> np.ndarray:
    """Which of n units lie in a run."""
    drop = np.zeros(n + 1, np.int64)
    if runs.is_valid:
        np.add.at(drop, np.asarray(runs.values.field("first")), 1)
        np.add.at(drop, np.asarray(runs.values.field("last")) + 1, -1)
    return np.cumsum(drop)[:-1] > 0


def _without_passages(text: str, runs, drop: np.ndarray) -> list[str]:
    """The lines of a text without the words of its passages; lines of which
    nothing stays are marked in ``drop``."""
    raw = text.encode()
    s = T.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), T.NOT_SPACE, lower=False)
    gone = _covered(runs, len(s.start))
    edges = np.concatenate([[-1], np.flatnonzero(s.data == 0x0A), [len(raw)]])
    out = []
    for k, (a, b) in enumerate(zip(edges[:-1] + 1, edges[1:])):
        x, y = np.searchsorted(s.start, [a, b])
        cut = gone[x:y]
        if cut.all() and (y > x or (0 < x < len(gone) and gone[x - 1] and gone[x])):
            drop[k] = True
        if not cut.any():
            out.append(raw[a:b].decode())
            continue
        # a deleted word goes with the white space after it
        stop = np.append(s.start[x + 1:y], b)
        parts = [raw[a:s.start[x]]] + [raw[u:v] for u, v, c in zip(s.start[x:y], stop, cut) if not c]
        line = b"".join(parts)
        out.append((line.rstrip(b" \t\r\v\f") if cut[-1] else line).decode())
    return out


def _cut(text_at: str, runs_at: str, passages_at: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, passages = (batch.column(c) for c in (text_at, runs_at, passages_at))
            found = pc.or_(runs.is_valid(), passages.is_valid())
            total = pc.add(pc.count_substring(pc.fill_null(texts, ""), "\n"), 1).cast(pa.int64())
            out, gone = [], np.zeros(len(batch), np.int64)
            for i in np.flatnonzero(found.to_numpy(zero_copy_only=False)):
                text = texts[i].as_py() or ""
                lines = text.split("\n")
                drop = _covered(runs[i], len(lines))
                if passages[i].is_valid:
                    lines = _without_passages(text, passages[i], drop)
                out.append("\n".join(x for x, d in zip(lines, drop) if not d))
                gone[i] = drop.sum()
            texts = pc.replace_with_mask(texts, found, pa.array(out, texts.type))
            kept = [c for c in batch.schema.names if c not in (runs_at, passages_at)]
            arrays = [texts if c == text_at else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, total, pa.array(gone)], names=[*kept, *names])
    return run


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs and passages deleted from the text column,
    plus ``_n_lines`` and ``_n_removed``, the lines of which nothing is left.  A
    column of the input by one of these names stays, and the new one gets
    underscores in front until its name is free."""
    runs_at, passages_at, key, *counts = (
        free_name(c, docs) for c in ("_runs", "_passages", "_cut_rk", "_n_lines", "_n_removed"))
    runs = repeated_runs(docs, id_col, text_col, min_words)
    found = runs.join(repeated_passages(docs, id_col, text_col), "rk", "full").select(
        F.col("rk").alias(key), F.col("runs").alias(runs_at), F.col("passages").alias(passages_at))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], text))
    joined = keyed.join(found, key, "left").select(*docs.columns, runs_at, passages_at)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(_cut(text_col, runs_at, passages_at, counts),
                             ", ".join([*fields, *(f"{c} bigint" for c in counts)]))
