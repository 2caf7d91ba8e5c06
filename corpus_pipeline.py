"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join,
benchmark decontamination, SentencePiece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and hands the reread table to the
next stage.  All stages but the last return the columns of ``documents``:

1. ``quality`` drops the documents that the classifier rejects;
2. ``line_dedup`` deletes repeated runs of lines from the texts (a document
   whose text is a copy throughout stays as a row with an empty text);
3. ``near_duplicates`` keeps the smallest id of each group of similar texts
   (sets of 5-word shingles, linked from a Jaccard similarity of 0.8 on);
4. ``decontaminate`` drops the documents that hold a benchmark item;
5. ``encode`` returns ``doc_id, n_tokens, ids, round_trip``.

Null and empty texts, repeated rows, empty tables and additional columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurescope.llm.common import stage, table


#: Words of a shingle and least similarity of near duplicates; the op4 query has
#: a contract of its own.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lurescope.llm.quality import keep_documents
    return keep_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lurescope.llm.linededup import dedup_lines
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lurescope.llm.jaccard import keep_one_of_each
    return keep_one_of_each(docs, shingle=NEAR_WORDS, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lurescope.llm.decontaminate import clean_documents
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lurescope.llm.pieces import encode_documents
    return encode_documents(docs).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("encode", encode)]

#: Neither the fitted classifier nor the searches are expressible in SQL; the
#: tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
