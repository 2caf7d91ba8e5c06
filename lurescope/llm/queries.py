"""The registered queries of the training-data operators: thin wrappers that
read whole tables, call the operator with production parameters and derive the
result columns.  ``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``,
``ORACLE`` the names that SQL can express to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm.common import table
from lurescope.llm.oracle import ORACLE


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated runs of lines, lines before, lines deleted."""
    from lurescope.llm.linededup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"))


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    from lurescope.llm.sanitise import KINDS, TERM, find_spans
    got = find_spans(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in [*KINDS, TERM]])

    def joined(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
            ":", F.get(names, x["k"]), x["s"], x["e"])), ",")

    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"),
                                                  x["e"].alias("e")))
    term = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"),
                                                   x["e"].alias("e")))
    return got.select(
        F.col("id").alias("doc_id"),
        *(F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)").alias(f"n_{kind}")
          for k, kind in enumerate(KINDS)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, term)).alias("spans"),
        F.size("terms").cast("long").alias("n_term"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, phrase places and licence labels of every document."""
    from lurescope.llm.licenses import scan_licenses
    got = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform(F.coalesce("places", F.array()), lambda p: p["start"])
    base = F.transform(F.coalesce("places", F.array()), lambda p: p["label"])
    more = F.transform(F.coalesce("matches", F.array()), lambda m: m["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return got.select(
        F.col("id").alias("doc_id"), "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(
            "matches", lambda m: m["share"])), F.lit(0.0))).alias("score"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size of its shingle set, smallest doc_id reachable by links."""
    from lurescope.llm.jaccard import similarity_classes
    return similarity_classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from lurescope.llm.html import extract_pages
    return extract_pages(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text",
        F.char_length("text").cast("long").alias("n_chars"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the files."""
    from lurescope.llm.common import stage_path
    from lurescope.llm.tokenfile import read_tokens, write_tokens
    path = stage_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every vector."""
    from lurescope.llm.caps import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, site posteriors, score and decision of every document."""
    from lurescope.llm.quality import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "host", "path", "n_words", "p_doc", "p_host", "p_path",
        "p_keep", "keep")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and whether they decode to its text."""
    from lurescope.llm.pieces import encode_documents
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids", "round_trip")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it holds."""
    from lurescope.llm.decontaminate import contaminated
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"),
        F.max("similarity").alias("similarity"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document; of those with an
    even checksum a copy without line feeds is what gets verified."""
    from lurescope.llm.merkle import fold, proof_digest, prove
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                      F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = prove(table(spark, sf_dir, "documents"), "doc_id", "source",
                ["doc_id", "source", "lang", "n_chars", "text"], claimed={"text": tampered})
    got = got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                     proof_digest().alias("proof_sha256"), fold(F.col("claimed")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector, one row per component."""
    from lurescope.llm.whiten import whiten
    got = whiten(table(spark, sf_dir, "embeddings"))
    each = got.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error",
                      F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, and of one
    conversation whose texts are control strings."""
    from lurescope.llm.chat import digests, format_conversations
    from lurescope.llm.common import stage
    planted = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', '{planted}'), "
                     f"(1L, 'assistant', '{planted}') AS t(turn, role, text)")
    parts = stage(format_conversations(turns.unionByName(more)), "chat-formatted")
    return digests(parts).withColumnRenamed("conv", "conv_id")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sanitise, op3_license, op4_jaccard, op5_html_text, op6_token_files,
                                  op7_near_vectors, op8_quality,
                                  op9_sentencepiece, op10_decontaminate,
                                  op11_merkle, op12_whiten, op13_chat)}
