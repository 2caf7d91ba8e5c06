import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lurescope.llm import tokenfile as T
from lurescope.llm.common import ENTRY_BYTES, Remembered, stage_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(T.default_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID]


ODD = ["It's they'll WE'VE 'tis", "naïve Straße ÀÉÎ œuvre", "a b c\x1cd", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ",
       "é Å ño", "x<|endoftext|>y <|startoftext|>", "123 4,567.89 ½ ²", "日本語 テスト 🙂🙂", "!!! ... --- __a__",
       "\x00\x01 ﻿", "K Å ﬁ", "word,word;word", "  lead and trail \n\n", "don’t", "a'b'c's",
       "abc\x01 d\x7f, é\x02. x\x1cy Été?! (no) end.) it', '' [x]"]


def test_parts_give_the_ids_of_the_library(tokenizer):
    e = T.WordEncoder(T.default_vocabulary())
    for text in ODD + [" ".join(ODD), "".join(ODD)]:
        assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == ids_of(tokenizer, text)[:-1], text


def test_memory_is_bounded_and_keeps_what_is_used():
    made = []

    def make(key):
        made.append(key)
        return key.encode()

    m = Remembered(make, 10 * (ENTRY_BYTES + 10))
    for i in range(200):
        assert m["often"] == b"often" and m[f"rare{i}"] == f"rare{i}".encode()
        assert len(m) <= 11 and len(m.old) <= 11
    assert made.count("often") == 1 and len(made) == 201


def test_round_trip_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "DOCS_PER_SHARD", 7)
    rows = [(None, "null id"), (5, None), (3, ""), (9, "twice"), (9, "twice"), (-4, "negative id"),
            (7, "long text " * 40_000)] + [(100 + i, ODD[i % len(ODD)]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int")
    path = stage_path(spark, "test-tokens")
    T.write_tokens(df, path)
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.id for r in got] == [r[0] for r in want]
    at = 0
    for r, (_, text) in zip(got, want):
        ids = ids_of(tokenizer, text)
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    d = spark.read.parquet(f"{path}/dictionary").first()
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert {s.dict_hash for s in shards} == {hashlib.sha256(bytes(d["bytes"])).hexdigest()}
    assert all(len(s.offsets) == len(s.doc_ids) + 1 for s in shards)
    [one] = T.read_document(spark, path, 103)
    assert one.tolist() == ids_of(tokenizer, dict(rows)[103])
    assert len(T.read_document(spark, path, 9)) == 2


def test_empty_table(spark):
    path = stage_path(spark, "test-tokens-empty")
    T.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), path)
    assert T.read_tokens(spark, path).count() == 0


def test_whole_table(spark, tokenizer):
    from lurescope.llm.queries import op6_token_files
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_token_files(spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(ids_of(tokenizer, r.text), "<u4")
        assert tuple(got[r.doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
