"""License scan: exact set-similarity join of text blocks with templates.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
characters.  A text is cut into overlapping blocks of 16, 32, 64, ... words,
each starting half a block after the one before, and a template belongs to the
smallest block length that is at least twice its own, so every passage of the
template's length lies whole in a block.  A block matches a template when it
holds at least ``ceil(threshold * |T|)`` of the template's distinct words.

The join is the prefix-filter one:

1. the words of all templates are counted over all documents and put in one
   global order, rarest first;
2. a block that reaches the overlap ``o`` must hold one of the first
   ``|T| - o + 1`` words of the template in that order: only blocks with such a
   word leave the scan;
3. these rows join the (broadcast, fixed) prefix index on the word, and the
   length filter (``distinct words of the block >= o``) and the positional
   filter (words of block and template left after the first common word) drop
   what cannot reach ``o``;
4. the whole overlap is counted for what remains, and a template's required run
   must stand in the block.

A required run (in brackets in the template) is the words that tell a licence
from its kin -- name, version, variant: they must stand side by side, or "version
2" would pass for "version 3" and "by nc sa" for "by nc".  Templates of fewer
than ``SHORT`` words need all of their words, as a few common words meet by
chance in prose.

Phrases are templates with threshold 1 whose words must also stand in order,
side by side; their places are read from the matching blocks, and the block in
whose first half a place starts owns it.

Defined results: null text counts as empty; a text without words has no block,
``n_words`` 0 and score 0; repeated rows are scanned each; other columns are
ignored.  Texts of any length are scanned whole, block by block; of templates that fit a
block equally well each gives its label; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import textscan as T
from lurescope.llm.common import ship, stage

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of public licence notices and their labels.
# In brackets: the run that a block must hold as it stands.
TEMPLATES = {
    "released under the [mit license]": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "licensed under the [apache license version 2 0]": "apache-2.0",
    "licensed under [cc by nc 4 0]": "cc-by-nc-4.0",
    "this work is licensed under a creative commons [attribution 4 0] international license":
        "cc-by-4.0",
    "this work is licensed under the [gnu general public license version 3]": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of "
    "the [gnu general public license] as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the [mozilla public license]": "mpl",
}
THRESHOLD = 0.8
SMALLEST_BLOCK = 16
#: Templates of fewer words need all of them.
SHORT = 8


@dataclass
class Template:
    words: list[str]
    label: str
    threshold: float
    phrase: bool
    required: list[str]

    @classmethod
    def of(cls, text: str, label: str, threshold: float) -> Template:
        """A template from its words, the required run in brackets."""
        inside = re.search(r"\[(.*)\]", text)
        words = text.replace("[", "").replace("]", "").split()
        return cls(words, label, 1.0 if len(words) < SHORT else threshold, False,
                   inside.group(1).split() if inside else [])

    @property
    def block(self) -> int:
        size = SMALLEST_BLOCK
        while size < 2 * len(self.words):
            size *= 2
        return size

    @property
    def need(self) -> int:
        return int(np.ceil(self.threshold * len(set(self.words)) - 1e-9))


def templates(phrases: dict[str, str], texts: dict[str, str], threshold: float) -> list[Template]:
    return [Template(p.split(), label, 1.0, True, []) for p, label in phrases.items()] + \
           [Template.of(t, label, threshold) for t, label in texts.items()]


def _word_hashes(vocabulary: list[str]) -> np.ndarray:
    out = []
    for _a, _b, s in T.column_scans(pa.array(vocabulary), T.WORD_CHARS):
        out.append(s.hashes)
    return np.concatenate(out)


def _lookup(known: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Word number of each hash, -1 for words of no template."""
    if not len(h):
        return np.zeros(0, np.int32)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, ids[at], -1).astype(np.int32)


def _count_words(known: np.ndarray, ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _a, _b, s in T.column_scans(batch.column("text"), T.WORD_CHARS):
                w = _lookup(known, ids, s.hashes)
                total += np.bincount(w[w >= 0], minlength=len(known))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(known), dtype=np.int32)), pa.array(total)], names=["word", "c"])
    return run


def _blocks(known: np.ndarray, ids: np.ndarray, prefix_of: dict[int, np.ndarray]):
    """A row (block size 0) with the word count of each text, and a row for each
    block that holds a prefix word of a template of its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in T.column_scans(batch.column("text"), T.WORD_CHARS):
                w = _lookup(known, ids, s.hashes)
                n = np.diff(s.doc_first)
                doc, size = [np.arange(b - a)], [np.zeros(b - a, np.int64)]
                start, count = [np.zeros(b - a, np.int64)], [n]
                held: list = [None] * (b - a)
                of_word = s.doc_of_word()
                pos = np.arange(len(w)) - s.doc_first[of_word]
                for length, is_prefix in prefix_of.items():
                    hit = np.flatnonzero((w >= 0) & is_prefix[w])
                    half = length // 2
                    at = np.concatenate([pos[hit] // half, pos[hit] // half - 1])
                    d = np.concatenate([of_word[hit], of_word[hit]])
                    pairs = np.unique(np.column_stack([d, at])[at >= 0], axis=0)
                    for i, k in pairs:
                        lo = s.doc_first[i] + k * half
                        hi = min(lo + length, s.doc_first[i + 1])
                        held.append(w[lo:hi])
                        doc.append([i])
                        size.append([length])
                        start.append([k * half])
                        count.append([len(np.unique(s.hashes[lo:hi]))])
                at = pa.array(np.concatenate(doc) + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").take(at), batch.column("id").take(at),
                     *(pa.array(np.concatenate(x).astype(np.int64)) for x in (size, start, count)),
                     pa.array(held, pa.list_(pa.int32()))],
                    names=["uid", "id", "block", "start", "n", "words"])
    return run


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text",
                  phrases: dict[str, str] | None = None, texts: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id, n_words, places`` (starts of phrases with
    their labels), ``matches`` (template label, block start, share of the
    template's words)."""
    spark = docs.sparkSession
    ship(spark)
    temps = templates(PHRASES if phrases is None else phrases,
                      TEMPLATES if texts is None else texts, threshold)
    assert all(re.fullmatch(r"[0-9a-z\u0080-\U0010ffff]+", w) for t in temps for w in t.words)
    vocabulary = sorted({w for t in temps for w in t.words})
    number = {w: i for i, w in enumerate(vocabulary)}
    h = _word_hashes(vocabulary)
    order = np.argsort(h)
    known, ids = h[order], order.astype(np.int32)

    source = docs.select(F.col(id_col).alias("id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = (source.select("text").mapInArrow(_count_words(known, ids), "word int, c bigint")
              .groupBy("word").agg(F.sum("c").alias("c")).collect())     # one row per template word
    freq = {r["word"]: r["c"] for r in counts}
    rank = {w: i for i, w in enumerate(sorted(range(len(vocabulary)),
                                              key=lambda w: (freq.get(w, 0), w)))}

    index, prefix_of = [], {}
    for k, t in enumerate(temps):
        words = sorted({number[w] for w in t.words}, key=rank.get)
        marks = prefix_of.setdefault(t.block, np.zeros(len(vocabulary) + 1, bool))
        for p, w in enumerate(words[:len(words) - t.need + 1]):
            marks[w] = True
            index.append((t.block, w, k, p, t.need, words, [number[w] for w in t.words],
                          [number[w] for w in t.required], t.label, t.phrase))
    scanned = stage(
        source.withColumn("uid", F.monotonically_increasing_id())
        .mapInArrow(_blocks(known, ids, prefix_of),
                    "uid bigint, id bigint, block bigint, start bigint, n bigint, words array<int>"),
        "license-blocks")

    prefix = F.broadcast(spark.createDataFrame(
        index, "block bigint, word int, template int, at int, need int, wanted array<int>, "
               "sequence array<int>, required array<int>, label string, phrase boolean"))
    by_rank = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    cand = (scanned.filter("block > 0")
            .withColumn("mine", F.array_distinct(F.filter("words", lambda w: w >= 0)))
            .withColumn("ranks", F.array_sort(F.transform("mine", lambda w: by_rank[w])))
            .withColumn("word", F.explode("mine"))
            .join(prefix, ["block", "word"])
            .filter("n >= need"))                                        # length filter
    # positional filter: the first common word decides what can still follow
    left = F.size("ranks") - F.array_position("ranks", by_rank[F.col("word")])
    cand = (cand.withColumn("reach", F.least(left, F.size("wanted") - F.col("at") - 1) + 1)
            .groupBy("uid", "block", "start", "template")
            .agg(F.min_by(F.struct("reach", "need", "wanted", "sequence", "required", "label",
                                   "phrase", "words", "mine"), "at").alias("c"))
            .select("uid", "block", "start", "c.*").filter("reach >= need"))
    found = (cand.withColumn("overlap", F.size(F.array_intersect("mine", "wanted")))
             .filter("overlap >= need")
             .filter("""size(required) = 0 OR size(words) >= size(required) AND exists(
                 sequence(0, size(words) - size(required)),
                 i -> slice(words, i + 1, size(required)) = required)""")
             .withColumn("share", F.col("overlap") / F.size("wanted")))
    at = F.expr("""
        CASE WHEN phrase AND size(words) >= size(sequence) THEN
          filter(sequence(0, least(size(words) - size(sequence), cast(block / 2 AS int) - 1)),
                 i -> slice(words, i + 1, size(sequence)) = sequence)
        ELSE array() END""")
    found = found.withColumn("starts", at).select(
        "uid", F.transform("starts", lambda i: F.struct(
            (F.col("start") + i).alias("start"), F.col("label").alias("label"))).alias("places"),
        F.when(~F.col("phrase"), F.struct("label", "start", "share")).alias("match"))
    per_text = found.groupBy("uid").agg(
        F.array_sort(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.collect_list("match")).alias("matches"))
    return (scanned.filter("block = 0").select("uid", "id", F.col("n").alias("n_words"))
            .join(per_text, "uid", "left").drop("uid"))
