import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lurescope.llm import sanitise as S


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15)]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE)
                  for m in re.finditer(p, text or "") if ok(m.group()))


def norm(k, v):
    return f"{k}:" + (v.lower() if k == 0 else v if k == 1 else digits(v))


def brute_terms(rows):
    """doc -> spans of disclosing terms, by the formulas of the module."""
    word = re.compile(r"[^\W_]{3,}")
    n_e, n_t, near = defaultdict(set), defaultdict(set), []
    for i, t in rows:
        for m in word.finditer((t or "").lower()):
            n_t[m.group()].add(i)
        spans = base(t)
        for s, k, e in spans:
            ent = norm(k, t[s:e])
            n_e[ent].add(i)
            b0 = max(s - S.WINDOW, 0)
            before, after = t[b0:s], t[e:e + S.WINDOW]
            got = [(m.start() + b0, m.end() + b0, m.group()) for m in word.finditer(before)
                   if m.start() > 0 or b0 == 0]
            got += [(m.start() + e, m.end() + e, m.group()) for m in word.finditer(after)
                    if m.end() < len(after) or e + m.end() == len(t)]
            for a, b, v in got:
                if not any(x < b and a < y for x, _, y in spans):
                    near.append((i, ent, (before, after), v.lower(), a, b))
    n_te, ctx = defaultdict(set), defaultdict(set)
    for i, ent, c, v, _, _ in near:
        n_te[ent, v].add((i, c))
        ctx[ent, v].add(c)
    total, strong = len(rows), set()
    for _, ent, _, v, _, _ in near:
        info = math.log2(total / len(n_e[ent]))
        if len(ctx[ent, v]) >= S.MIN_CONTEXTS and info > 0:
            shared = math.log2(total * len(n_te[ent, v]) / (len(n_t[v]) * len(n_e[ent])))
            if shared / info >= S.GENERALISE:
                strong.add(v)
    return {i: {m.span() for m in word.finditer(t or "") if m.group().lower() in strong
                and not any(x < m.end() and m.start() < y for x, _, y in base(t))} for i, t in rows}


CASES = ["a.b@c.d.e, x@y", "a@b.c@d.e%f@g.h", "..a+b@-x.y-..z", "a@b..c a@b.c.", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.2.3.4",
         "4111 1111 1111 1111", "4111-1111-1111-1111 5500005555555559x", "4111  1111 1111 1111", "1" * 25,
         "+1 (171) 555-2028 +12 3", "+1 234 567 890 123 456", "++49.30.1234567-", "call+4912345678901now", "é+1 234 567 8901é@x.yz",
         "0" * 16, "4111 1111 1111 1111-2", "@a.b a@.b", "x@1.2.3.4", "a@b.c\n+1 (000) 000-0000\n", " ab@c.d 12"]


def spans(df):
    return {r.id: (sorted((x.s, x.k, x.e) for x in r.base), {(x.s, x.e) for x in r.terms})
            for r in S.find_spans(df).collect()}


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(5)
    alphabet = "0123456789.+-@ ()ab%_é\n"
    rows = list(enumerate(CASES + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
                                   for _ in range(600)]
                          + ["".join(rnd.choice("0123456789 -") for _ in range(40)) for _ in range(200)]))
    got = spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for i, t in rows:
        assert got[i][0] == base(t), (i, t)


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_equal_the_formulas(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"word{i}" for i in range(120)] + ["the", "ünde", "of"]
    secrets = ["joe@mail.example.org", "+1 (171) 555-2028", "10.0.0.7"]
    rows = []
    for i in range(120):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(3, 60))]
        if rnd.random() < 0.5:
            k = rnd.randrange(3)
            at = rnd.randint(0, len(t))
            t[at:at] = [secrets[k]] + (["Project", f"name{k}"] if rnd.random() < 0.7 else [])
        rows.append((i, " ".join(t)))
    got = spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_terms(rows)
    assert sum(map(len, want.values())) > 20
    for i, _ in rows:
        assert got[i][1] == want.get(i, set()), i


def test_terms_are_marked_away_from_their_entity(spark):
    rows = [(i, f"Zorblaxian has joe@x.org for story{i} " + "and more follows here " * 30 + "by zorblaxian.")
            for i in range(4)]
    rows += [(10, "ZORBLAXIAN alone"), (11, "zorblaxians and azorblaxian are other words"),
             (12, "zorblaxian " * 2_000 + "é" * 50_000)]
    rows += [(20 + i, f"nothing has more here and follows story for by plain{i}") for i in range(300)]
    got = spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_terms(rows)
    for i, t in rows:
        assert got[i][1] == want[i], i
    assert got[10][1] == {(0, 10)} and got[11][1] == set() and len(got[12][1]) == 2_000
    assert (len(rows[0][1]) - 11, len(rows[0][1]) - 1) in got[0][1]


def test_sanitised_text(spark):
    rows = [(i, f"Mr Quintus wrote from joe@x.org about thing{i} and it went on", 1) for i in range(6)]
    rows += [(10 + i, f"nothing here but plain words {i}", 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {r.doc_id: r for r in S.sanitise(df).collect()}
    assert "joe@x.org" not in got[0].text and "[email]" in got[0].text
    assert "Quintus" not in got[0].text and "thing0" in got[0].text
    assert got[12].text == rows[8][1] and got[0].spans == 1


def test_defined_results(spark):
    df = spark.createDataFrame(
        [(None, "a@b.cd", 1), (1, None, 2), (2, "", 3), (3, "a@b.cd", 4), (3, "a@b.cd", 4),
         (4, "1 " * 100_000 + "+1 234 567 8901 " + "a." * 100_000 + "@" + "b." * 50_000, 5)],
        "doc_id bigint, text string, base int")
    got = sorted(((r.id, len(r.base)) for r in S.find_spans(df).collect()), key=str)
    assert got == sorted([(None, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, len(base(df.collect()[5].text)))], key=str)
    assert S.find_spans(df.limit(0)).count() == 0 and S.sanitise(df).count() == 6


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd says hi"), (2, "nothing")], "doc_id bigint, text string")
    names = ["_full", "_spans", "_span_rk", "rk", "base", "terms", "id"]
    for name in names:
        df = df.withColumn(name, F.lit(name))
    got = {r.doc_id: r for r in S.sanitise(df).collect()}
    assert got[1].text == "[email] says hi" and got[2].text == "nothing"
    assert all(r[n] == n for r in got.values() for n in names) and S.sanitise(df).columns == df.columns


def test_whole_table_digest(spark):
    from lurescope.llm.queries import op2_sanitise
    got = {r.doc_id: r for r in op2_sanitise(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    terms = brute_terms(rows)
    for i, t in rows:
        b = base(t)
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in b)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(
            sum(k == j for _, k, _ in b) for j in range(4))
        every = sorted([*b, *((s, 4, e) for s, e in terms.get(i, ()))])
        assert got[i].spans == ",".join(f"{[*(x[0] for x in BASE), 'term'][k]}:{s}:{e}" for s, k, e in every)


def test_main_path_is_native(spark):
    from lurescope.llm.queries import op2_sanitise
    plan = op2_sanitise(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
