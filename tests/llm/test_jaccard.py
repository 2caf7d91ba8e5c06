import random

import pytest

from lurescope.llm.jaccard import keep_one_of_each, similarity_classes


def shingle_set(text, k=4):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (text or "").translate(low).split()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, percent=85, k=4):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.id: (r.n_shingles, r.component) for r in similarity_classes(df, **kw).collect()}


def corpus(seed, n, edits, vocabulary=400):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        t = list(rnd.choice(bases)) if rnd.random() < 0.8 else [rnd.choice(vocab) for _ in range(60)]
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        rows.append((i * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 3), (3, 6)])
def test_equals_brute_force(spark, seed, edits):
    """Groups with members on both sides of the pivot's windows."""
    rows = corpus(seed, 150, edits)
    assert run(spark, rows) == brute(rows)


def test_rounds_and_final_windows(spark):
    """A chain: every text links to the next only, so pivots resolve little."""
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 150])) for i in range(30)]
    for rounds in (1, 3):
        assert run(spark, rows, rounds=rounds) == brute(rows)


def test_defined_results(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (6, None, 3), (7, "", 4), (8, "A  b", 5),
            (9, "a B", 6), (9, "a B", 7), (10, " x y z w", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint")
    got = sorted(((r.id, r.n_shingles, r.component) for r in similarity_classes(df).collect()), key=str)
    assert got == sorted([(None, 3, 5), (5, 3, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (9, 1, 8),
                          (10, 1, 10)], key=str)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["10", "5", "6", "7", "8", "None"]
    assert similarity_classes(df.limit(0)).count() == 0 and keep_one_of_each(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    got = run(spark, [(1, a), (2, b), (3, a), (3, b)])
    assert got[1][1] == got[2][1] == got[3][1] == 1


def test_large_group_of_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(400)]
    rows += [(400 + i, " ".join([*base[:i % 199], f"x{i}", *base[i % 199 + 1:]])) for i in range(400)]
    assert {c for _, c in run(spark, rows).values()} == {0}


def test_very_long_text(spark):
    long = " ".join(f"w{i % 7001}x{i % 613}" for i in range(120_000))
    got = run(spark, [(1, long), (2, long + " one more"), (3, "short text of five words")])
    assert got[2][1] == 1 and got[3][1] == 3


def test_near_copies_form_few_pairs(spark, monkeypatch):
    """Pairs of one large group share a shingle that can be their first, or are not formed."""
    from pyspark.sql import functions as F
    from lurescope.llm import jaccard as J
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        t = list(base)
        for at in rnd.sample(range(300), 2 if i % 2 else rnd.randint(8, 9)):
            t[at] = f"x{i}y{at}"
        rows.append((i, " ".join(t)))
    formed, verify = [], J._Verifier.__call__

    def counted(self, pairs, least):
        if least == 85:
            formed.append(pairs.filter(F.col("a") != F.col("b")).distinct().count())
        return verify(self, pairs, least)
    monkeypatch.setattr(J._Verifier, "__call__", counted)
    assert run(spark, rows) == brute(rows)
    assert sum(formed) <= len(rows)
