"""Token-ID output: documents as separately compressed id arrays with a shared
zstandard dictionary.

Encoding: every text by a tokenizers vocabulary, then an end id.  For the
word vocabulary here a text's ids are the ids of its parts between ASCII white
space one after the other (its pattern never crosses white space), so each
different part is encoded once and remembered by the worker as long as it is
used, within a bound in bytes.

File format: a *shard* is a row of a Parquet table written by Spark (so lost
tasks are redone and half-written files never seen):

    shard      number of the shard; shards are in ascending id order
    first      ids before the shard's first document
    dict_hash  SHA-256 of the dictionary that the frames need
    doc_ids    document ids, ascending
    n_tokens   ids of each document
    offsets    start of each document's frame in ``frames``, and the end
    frames     zstandard frames, one per document: its ids as little-endian
               unsigned integers of ``width`` bytes

The dictionary is a table of its own beside the shards.  It is trained on the
serialized id arrays of a sample of at most ``SAMPLE_DOCS`` documents and
``SAMPLE_BYTES`` bytes; without enough data for a dictionary it is empty.  A
short document is read alone: pick its shard, take its frame by the offsets and
decompress only that.

Order: documents are dealt to shards by id ranges (quantiles of the id column),
sorted within, and written; the numbers of ids before a shard come from the
shards' totals, one row per shard.

Defined results: null text counts as empty (the end id alone); null ids come
first; rows with the same id are in the order of their row key, repeated rows
are written each; an empty table gives no shard; other columns are not written.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm.common import Remembered, bounded_broadcast, ship, with_text

END_ID = 1
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
DOCS_PER_SHARD = 2_048
BYTES_PER_SHARD = 8 << 20
LEVEL = 3
#: Bytes that a worker remembers in each generation, of parts and of words.
_PART_BYTES, _WORD_BYTES = 24 << 20, 48 << 20
_ROWS = 256

_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by the tokenizers library, remembering the parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.serial = [i.to_bytes(self.width, "little") for i in range(size)]
        self.parts = Remembered(self._part, _PART_BYTES)
        self.words = Remembered(self._word, _WORD_BYTES)

    def _word(self, word: bytes) -> bytes:
        """A run of lower-case letters or of punctuation: one pre-token, so the
        model's merges alone give its ids."""
        letters = word.decode("latin-1")
        if not word.isascii():
            letters = letters.translate(self.letters)
        serial = self.serial
        return b"".join([serial[t.id] for t in self.model.tokenize(letters)])

    def _part(self, part: bytes) -> bytes:
        core = part.rstrip(_MARKS)
        if core.isalpha():                              # of ASCII letters
            word = core.lower()
        elif _LETTERS.fullmatch(core.decode()):
            word = core.decode().lower().encode()
        else:
            ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
            return np.array(ids, self.dtype).tobytes()
        if len(core) == len(part):
            return self.words[word]
        return self.words[word] + self.words[part[len(core):]]

    def encode(self, text: bytes) -> bytes:
        """The serialized ids of a text in UTF-8, without the end id."""
        # bytes.split() cuts at ASCII white space alone
        return b"".join(map(self.parts.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch in UTF-8, a few rows at a time."""
    column = batch.column("text").cast(pa.binary())
    for at in range(0, len(column), _ROWS):
        yield from column.slice(at, _ROWS).to_pylist()


def train_dictionary(texts: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from a bounded sample of id arrays."""
    hashed = texts.filter("text <> ''").withColumn("k", F.xxhash64("rk"))
    # only hashes are sorted; then the texts up to the last of them are read
    last = hashed.select("k").orderBy("k").limit(SAMPLE_DOCS).agg(F.max("k")).first()[0]
    sample = hashed.filter(F.col("k") <= F.lit(last)).dropDuplicates(["k"]).select(
        "k", F.substring("text", 1, SAMPLE_BYTES).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"),
                 pa.array([e.encode(t) for t in _texts(batch)], pa.binary())],
                names=["k", "ids"])

    if last is None:
        return b""
    held, size = [], 0
    for r in sample.mapInArrow(run, "k bigint, ids binary").orderBy("k").toLocalIterator():
        if size < SAMPLE_BYTES:
            held.append(bytes(r["ids"]))
            size += len(held[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 8, 512)), held).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""                      # too little data for a dictionary


def _compressors(dictionary: bytes):
    d = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return (zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **d),
            zstandard.ZstdDecompressor(**d))


def _frames(path: str, dictionary: bytes, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([end_id], e.dtype).tobytes()
        pack = _compressors(dictionary)[0]
        for batch in batches:
            frames, count = [], []
            for text in _texts(batch):
                ids = e.encode(text) + end
                frames.append(pack.compress(ids))
                count.append(len(ids) // e.width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rk"), batch.column("part"),
                 pa.array(count, pa.int64()), pa.array(frames, pa.binary())],
                names=["id", "rk", "part", "n", "frame"])
    return run


def _shards(dict_hash: str):
    """Rows sorted by (part, id, rk) to shard rows of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, counts, frames, size = None, 0, [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "number": [number], "dict_hash": [dict_hash], "doc_ids": [ids],
                 "n_tokens": [counts], "offsets": [offsets.tolist()], "frames": [b"".join(frames)]},
                schema=pa.schema([("part", pa.int64()), ("number", pa.int64()),
                                  ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                                  ("n_tokens", pa.list_(pa.int64())),
                                  ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())]))

        for batch in batches:
            for i, p, n, f in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "n", "frame"))):
                if frames and (p != part or len(frames) >= DOCS_PER_SHARD
                               or size + len(f) > BYTES_PER_SHARD):
                    yield row()
                    number = number + 1 if p == part else 0
                    ids, counts, frames, size = [], [], [], 0
                elif p != part:
                    number = 0
                part = p
                ids.append(i)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if frames:
            yield row()
    return run


def write_tokens(docs: DataFrame, path: str, id_col="doc_id", text_col="text",
                 vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the token files of ``docs`` below ``path``: ``shards`` and
    ``dictionary``."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or default_vocabulary()
    texts = with_text(docs, id_col, text_col)
    dictionary = train_dictionary(texts, vocabulary)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary), encoder(vocabulary).width)],
                          "dict_hash string, bytes binary, width int").write.parquet(f"{path}/dictionary")
    # ranges of ids, from the id column alone
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = texts.filter("id is not null").approxQuantile(
        "id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else None
    part = F.size(F.filter(bounds, lambda c: c < F.col("id"))) if cuts else F.lit(0)
    texts = texts.withColumn("part", F.when(F.col("id").isNull(), -1).otherwise(part).cast("bigint"))
    frames = texts.mapInArrow(_frames(vocabulary, dictionary, end_id),
                              "id bigint, rk bigint, part bigint, n bigint, frame binary")
    shards = (frames.repartition("part").sortWithinPartitions("part", "id", "rk")
              .mapInArrow(_shards(dict_hash),
                          "part bigint, number bigint, dict_hash string, doc_ids array<bigint>, "
                          "n_tokens array<bigint>, offsets array<bigint>, frames binary"))
    shards.write.parquet(f"{path}/shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with their number and ``first``, the ids before them."""
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.select("part", "number", F.aggregate(
        "n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total"))
    # one narrow row per shard of thousands of documents; summed in two levels
    by_part = totals.groupBy("part").agg(F.sum("total").alias("total"),
                                         F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("p_first"),
                           F.coalesce(F.sum("c").over(before), F.lit(0)).alias("p_shard"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    at = (totals.withColumn("s_first", F.coalesce(F.sum("total").over(inside), F.lit(0)))
          .join(F.broadcast(parts), "part")               # one row per id range
          .select("part", "number", (F.col("p_first") + F.col("s_first")).alias("first"),
                  (F.col("p_shard") + F.col("number")).alias("shard")))
    return shards.join(bounded_broadcast(at, 1_000_000), ["part", "number"])


def _read(width: int, dictionary: bytes, dict_hash: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _compressors(dictionary)[1]
        for batch in batches:
            for r in range(len(batch)):
                get = lambda c, r=r: batch.column(c)[r]
                if get("dict_hash").as_py() != dict_hash:
                    raise ValueError("the shard needs another dictionary")
                frames, offsets = get("frames").as_buffer(), get("offsets").as_py()
                counts = np.array(get("n_tokens").as_py(), np.int64)
                ids = [np.frombuffer(unpack.decompress(frames[a:b]), f"<u{width}").astype("<u4")
                       for a, b in zip(offsets, offsets[1:])]
                if any(len(x) != n for x, n in zip(ids, counts)):
                    raise ValueError("a frame does not hold its document's ids")
                start = get("first").as_py() + np.concatenate([[0], np.cumsum(counts)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("doc_ids").as_py(), pa.int64()), pa.array(start.astype(np.int64)),
                     pa.array(counts), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                    names=["id", "start", "n_tokens", "ids", "crc32"])
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids, crc32) of every document in the files; ``ids``
    are little-endian unsigned 32-bit integers."""
    ship(spark)
    d = spark.read.parquet(f"{path}/dictionary").first()
    return read_shards(spark, path).select(
        "dict_hash", "first", "doc_ids", "n_tokens", "offsets", "frames").mapInArrow(
        _read(d["width"], bytes(d["bytes"]), d["dict_hash"]),
        "id bigint, start bigint, n_tokens bigint, ids binary, crc32 bigint")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document (one per row with that id): only its
    frames are cut out of their shards and decompressed."""
    d = spark.read.parquet(f"{path}/dictionary").first()
    rows = (spark.read.parquet(f"{path}/shards")
            .filter(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
            .select(F.posexplode("doc_ids").alias("i", "id"), "offsets", "frames")
            .filter(F.col("id") == doc_id)
            .select(F.expr("substring(frames, offsets[i] + 1, offsets[i + 1] - offsets[i])").alias("f"))
            .collect())
    unpack = _compressors(bytes(d["bytes"]))[1]
    return [np.frombuffer(unpack.decompress(bytes(r["f"])), f"<u{d['width']}") for r in rows]
