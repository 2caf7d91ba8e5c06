import hashlib
import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lurescope.llm import merkle
from lurescope.llm.merkle import fold, proof_digest, prove

COLS = ["doc_id", "source", "lang", "n_chars", "text"]
sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLS))


def levels(nodes, arity=3):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def siblings(tree, at, arity=3):
    for nodes in tree[:-1]:
        start = at // arity * arity
        yield nodes[start:at], nodes[at + 1:start + arity]
        at //= arity


def tampered(row):
    odd = row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 2
    return row if odd or row["text"] is None else row | {"text": row["text"].replace("\n", "")}


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            at = leaf(tampered(r))
            for left, right in path:
                at = sha(*left, at, *right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root,
                        sha(*(x for left, right in path for x in left + right)), at, at == root))
    return sorted(out, key=str)


def run(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                  F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = prove(df, "doc_id", "source", COLS, {"text": text}).select(
        "id", "leaf", "subroot", "root", proof_digest().alias("p"), fold(F.col("claimed")).alias("f"))
    return sorted(((*r, r["f"] == r["root"]) for r in got.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars"))
                                  for r in rows], SCHEMA)


def some(n, sources, seed=0):
    rng = random.Random(seed)
    return [{"doc_id": i * 3 - 50, "text": rng.choice([None, "", "a\nb", "é\n", "x" * 40]), "lang": rng.choice(["en", None]),
             "source": rng.choice(sources), "n_chars": rng.choice([None, 7])} for i in range(n)]


@pytest.mark.parametrize("small", [0, 4000])
@pytest.mark.parametrize("n, sources", [(1, ["a"]), (2, ["a"]), (3, ["a"]), (4, ["a", None]), (10, ["a"]),
                                        (60, ["b", "a", None, "", "Z", "é", "hot", "hot", "hot", "hot"])])
def test_equals_brute_force(spark, monkeypatch, small, n, sources):
    monkeypatch.setattr(merkle, "SMALL", small)  # levels by shuffle and by broadcast
    monkeypatch.setattr(merkle, "SMALL_GROUPS", small)
    rows = some(n, sources, n)
    assert run(table(spark, rows)) == brute(rows)


def test_many_groups_of_one_row(spark):
    rows = some(30, [str(i) for i in range(1000)])
    assert run(table(spark, rows)) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = some(5, ["a", "b"])
    rows = rows + rows[:2] + [rows[0] | {"text": "other\n"}, rows[1] | {"doc_id": None}]
    assert run(table(spark, rows)) == brute(rows)


def test_long_text(spark):
    rows = some(3, ["a"]) + [{"doc_id": 1, "text": "word\n" * 400_000, "lang": "en", "source": "a", "n_chars": 1}]
    assert run(table(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert run(table(spark, [])) == []


def test_clashing_columns(spark):
    rows = some(9, ["a", "b"])
    df = table(spark, rows)
    for name in ("grp", "idx", "pos", "_place", "_part", "g", "m", "leaf", "digest", "root", "path", "id", "claimed"):
        df = df.withColumn(name, F.lit(1))
    assert run(df) == brute(rows)


def test_other_arity_and_a_changed_field_is_seen(spark):
    rows = some(9, ["a"])
    got = prove(table(spark, rows), "doc_id", "source", COLS, {"lang": F.lit("xx")}, arity=2)
    assert got.filter(fold(F.col("leaf")) != F.col("root")).count() == 0
    assert got.filter(fold(F.col("claimed")) == F.col("root")).count() == 0
    ordered = [leaf(r) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert got.first()["root"] == levels(ordered, 2)[-1][0]


def test_query_equals_sql(spark):
    from lurescope.llm.oracle import ORACLE
    from lurescope.llm.queries import QUERIES
    from oracle_check import compare, duck
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), "op11_merkle", QUERIES["op11_merkle"], ORACLE["op11_merkle"], sf)
