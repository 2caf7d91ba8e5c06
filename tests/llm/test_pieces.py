import random

import pytest
import sentencepiece

from lurescope.llm import pieces as P
from pyspark.sql import functions as F

ODD = ["", " ", "   three  spaces ", "tab\tnew\nline\r\n", "naïve ÿ Straße", "日本語テスト 🙂", "▁literal▁mark", "<s> </s> <unk> <0x0A>",
       "\x00\x01﻿", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization's", "x" * 200,
       "THE QUICK!! brown... (fox)", "1234567890", "é", "https://example.org/a?b=c&d=e#f", "    " * 10 + "deep"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def table():
    return P.PieceTable.load(P.default_model())


def test_merges_equal_the_library(model, table):
    rnd = random.Random(1)
    for _ in range(400):
        unit = "".join(rnd.choice("thaeinrsoz▁.,A日") for _ in range(rnd.randint(1, 30)))
        assert table.ids(P.SPACE + unit.replace("▁", "")) == model.encode(unit.replace("▁", "")) or not unit.strip("▁")


def test_lattice_paths_equal_the_merges(spark, table):
    rnd = random.Random(2)
    units = {"".join(rnd.choice("theaionrsdl") for _ in range(rnd.randint(1, 24))) for _ in range(400)}
    units |= {P.SPACE * k + u for u in list(units)[:80] for k in (1, 2, 5)} | {"日", "ÿ", P.SPACE * 9}
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: r.path for r in P.lattice_paths(df, table).collect()}
    for u in units:
        want = [table.rank[s][1] if s in table.rank else -1 for s in table.merge(u)[0]]
        assert got[u] == want, u


@pytest.mark.parametrize("most", [0, 5, P.MAX_UNITS])
def test_ids_and_round_trip_for_any_dictionary_size(spark, model, most):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, "null id", 7), (50, None, 7), (51, "twice", 7), (51, "twice", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = P.encode_documents(df, max_units=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == model.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.round_trip, r
    back = P.decode_ids(P.encode_documents(df, max_units=most)).collect()
    assert all(r.decoded == (r.text or "").replace(P.SPACE, " ") for r in back)
    assert P.encode_documents(df.limit(0)).count() == 0


def test_a_lossy_chunk_marks_its_texts(table):
    """The round trip is judged chunk by chunk and equals that of whole texts."""
    broken = P.PieceTable(table.rank, table.byte_id, [b"?" if t == b" the" else t for t in table.text_of], table.pairs)
    for t in (table, broken):
        encoder = P._Encoder(t, {})
        for text in [*ODD, "of the things", "the", "theory", "of  the", "things", "the the"]:
            got, same = encoder.encode(text)
            ids = [int.from_bytes(got[i:i + 4], "little") for i in range(0, len(got), 4)]
            assert same == (P.decode(t, ids) == text.replace(P.SPACE, " ")), text


def test_long_text(spark, model):
    text = "The theory of these things, and others. " * 20_000
    [r] = P.encode_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert list(r.ids) == model.encode(text) and r.round_trip


def test_whole_table(spark, model):
    from lurescope.llm.queries import op9_sentencepiece
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_sentencepiece(spark, sf)
    assert got.filter(~F.col("round_trip")).count() == 0
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: model.encode(t or "") for i, t in texts.items()}
