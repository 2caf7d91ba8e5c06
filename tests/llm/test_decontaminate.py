import random
from collections import Counter

import numpy as np

from lurescope.llm import decontaminate as D

PUNCT = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.strip(PUNCT) for w in (text or "").translate(low).split()]


def sims(doc, item, k=D.SHINGLE):
    d, b = words(doc), words(item)
    m = min(k, len(b))
    if not b or len(d) < len(b):
        return 0.0
    def grams(x):
        return Counter(tuple(x[i:i + m]) for i in range(len(x) - m + 1))
    g, best = grams(b), 0.0
    for s in range(len(d) - len(b) + 1):
        h = grams(d[s:s + len(b)])
        best = max(best, sum((g & h).values()) / sum((g | h).values()))
    return best


def run(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bm = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.id, r.item_id): r.similarity for r in D.contaminated(df, bm).collect()}


def test_equals_brute_force_on_exact_and_edited_passages(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 60)))) for i in range(30)]
    docs = []
    for i in range(120):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if i % 2:
            part = items[rnd.randrange(30)][1].split()
            for _ in range(rnd.randint(0, 3)):
                part[rnd.randrange(len(part))] = rnd.choice(vocab)
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() + "," if rnd.random() < 0.2 else w for w in part]
        docs.append((i, " ".join(text)))
    got = run(spark, docs, items)
    want = {(d, b): s for d, t in docs for b, x in items if (s := sims(t, x)) >= D.THRESHOLD}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (200, D.BITS)).astype(np.uint8)
    b = a.copy()
    for r in b:
        r[rng.choice(D.BITS, D.RADIUS, replace=False)] ^= 1
    assert (D._blocks(a, D.RADIUS) == D._blocks(b, D.RADIUS)).any(axis=1).all()


def test_defined_results(spark):
    item = "the quick brown fox jumps over the lazy dog again and again today"
    df = spark.createDataFrame(
        [(None, f"x {item} y", 1), (1, None, 2), (2, "", 3), (3, item, 4), (3, item, 4), (4, "clean", 5),
         (5, "z " * 50_000 + item, 6)], "doc_id bigint, text string, item_id int")
    bm = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "Clean!")],
                               "item_id bigint, text string")
    got = sorted(((r.id, r.item_id) for r in D.contaminated(df, bm).distinct().collect()), key=str)
    assert got == sorted([(None, 1), (None, 2), (3, 1), (3, 2), (4, 5), (5, 1), (5, 2)], key=str) or \
        set(got) == {(None, 1), (None, 2), (3, 1), (3, 2), (4, 5), (5, 1), (5, 2)}
    clean = D.clean_documents(df, bm)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert D.contaminated(df.limit(0), bm).count() == 0
    assert D.contaminated(df, bm.limit(0)).count() == 0


def test_more_items_than_one_pass(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 2)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(5)]
    docs = [(i, "lead " + t) for i, t in items]
    assert set(run(spark, docs, items)) == {(i, i) for i in range(5)}


def test_text_shorter_than_the_item(spark):
    from lurescope.llm.decontaminate import clean_documents
    item = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(item[:-1])), (2, " ".join(item[3:])), (3, " ".join(item[:30])), (4, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert sorted(r.doc_id for r in clean_documents(docs, items).collect()) == [3, 4]
