import importlib
import subprocess
import sys
from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from lurescope.llm import pieces as P

sys.path.insert(0, str(Path(__file__).parent))
REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage over the whole smallest table."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        got = corpus_pipeline.stage(step(spark, docs, SF), f"test-{name}")
        out.append((name, docs, got))
        docs = got
    return {n: (a, b) for n, a, b in out}


def texts(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns_are_kept_until_the_last_stage(stages, spark):
    want = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, (_, out) in list(stages.items())[:-1]:
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in want], name


def test_quality_keeps_good_and_drops_bad(stages, spark):
    docs, kept = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {i for i, _ in texts(kept)}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in good) >= 0.98 * len(good)
    assert sum(i in ids for i in bad) <= 0.1 * len(bad)


def test_line_dedup_equals_brute_force(stages):
    brute = importlib.import_module("test_line_dedup").brute_all
    a, b = stages["line_dedup"]
    assert dict(texts(b)) == brute(texts(a))


def test_one_of_each_group_stays(stages):
    brute = importlib.import_module("test_jaccard").brute
    a, b = stages["near_duplicates"]
    want = brute(texts(a))
    assert [i for i, _ in texts(b)] == [i for i, _ in texts(a) if want[i][0] == 0 or want[i][1] == i]


def test_near_duplicates_are_those_of_five_words_and_80_percent(stages):
    brute = importlib.import_module("test_jaccard").brute
    a, b = stages["near_duplicates"]
    want = brute(texts(a), percent=80, k=5)
    assert [i for i, _ in texts(b)] == [i for i, _ in texts(a) if want[i][0] == 0 or want[i][1] == i]


def test_copy_with_an_inserted_block_goes(spark):
    """92 of 114 5-word shingles are shared (0.81), 94 of 114 4-word shingles (0.82)."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)),
            (2, " ".join([*words[:50], *(f"x{i}" for i in range(14)), *words[50:]])),
            (3, " ".join([*words[:50], *(f"y{i}" for i in range(16)), *words[50:]]))]     # 0.79
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert [i for i, _ in texts(got)] == [1, 3]


def test_decontamination_equals_brute_force(stages, spark):
    m = importlib.import_module("test_decontaminate")
    a, b = stages["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(m.words, items)]
    clean = []
    for i, t in texts(a):
        w = m.words(t)
        mine = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        if not any(mine & g and m.sims(t, x) >= 0.8 for x, g in zip(items, grams)):
            clean.append(i)
    assert [i for i, _ in texts(b)] == clean and len(clean) < a.count()


def test_encoding_equals_the_library(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    a, b = stages["encode"]
    got = {r.doc_id: (list(r.ids), r.n_tokens, r.round_trip) for r in b.collect()}
    want = {i: model.encode(t or "") for i, t in texts(a)}
    assert {i: v[0] for i, v in got.items()} == want
    assert all(n == len(ids) and ok for ids, n, ok in got.values())


def test_odd_rows(spark, tmp_path):
    long = "A fairly plain sentence with some words in it. " * 3
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (2, long, "en", "a", 9, 3),
            (2, long, "en", "a", 9, 3), (3, long + "x " * 100_000, None, "b", None, 4)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere at all")], "item_id bigint, text string") \
        .write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, step in corpus_pipeline.STAGES:
            d = corpus_pipeline.stage(step(spark, d, str(tmp_path)), "test-odd")
        assert d.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
        assert (d.count() == 0) == empty and d.filter("NOT round_trip").count() == 0


def test_entry_imports_without_the_operators():
    """The other queries stay when the optional files are gone."""
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('lurescope.llm', 'corpus_pipeline'):\n"
            "            raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) >= 100\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0
