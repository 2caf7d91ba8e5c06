import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurescope.llm import linededup as L
from lurescope.llm import textscan as T
from lurescope.llm.linededup import MIN_WORDS, dedup_lines


def brute_lines(rows, min_words=MIN_WORDS):
    """rows: sorted (id, text); the lines of each that go: per window that occurred
    earlier, the common run around its first occurrence."""
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    key = [[" ".join(x.split()) for x in lines] for _, lines in docs]
    words = [[len(x.split()) for x in k] for k in key]
    first, drop = {}, [set() for _ in docs]
    for d, k in enumerate(key):
        for p in range(len(k)):
            if not words[d][p]:
                continue
            e, total = p, 0
            while e < len(k) and total < min_words:
                total += words[d][e]
                e += 1
            if total < min_words:
                continue
            w = tuple(k[p:e])
            if w not in first:
                first[w] = (d, p)
                continue
            sd, sp = first[w]
            a = 0
            while p + a < len(k) and sp + a < len(key[sd]) and k[p + a] == key[sd][sp + a]:
                a += 1
            b = 0
            while p - b > 0 and sp - b > 0 and k[p - b - 1] == key[sd][sp - b - 1]:
                b += 1
            drop[d].update(range(p - b, p + a))
    return drop


def brute(rows, min_words=MIN_WORDS):
    """The texts without those lines: the rule for whole lines alone."""
    drop = brute_lines(rows, min_words)
    return {i: "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in drop[d])
            for d, (i, t) in enumerate(rows)}


def passages(rows):
    """Per document the words (numbers) that the passage rule deletes, written out
    naively: only the hash that picks the fingerprints is the module's."""
    words = [(t or "").split() for _, t in rows]
    hashes, first, gone = [], {}, [set() for _ in rows]
    for _, text in rows:
        own = [int(x) for _, _, s in T.column_scans(pa.array([text or ""]), T.NOT_SPACE, lower=False) for x in s.hashes]
        one = []
        for p in range(len(own) - L.PASSAGE_WORDS + 1):
            h = 0
            for x in own[p:p + L.PASSAGE_WORDS]:
                h = (h + x) * int(T.BASE) % 2 ** 64
            one.append(int(T.mix(np.array([h], np.uint64))[0]))
        hashes.append(one)
    for d, one in enumerate(hashes):
        picks = set()
        for p in range(len(one) - L.PASSAGE_WINDOW + 1):
            window = one[p:p + L.PASSAGE_WINDOW]
            picks.add(p + window.index(min(window)))
        for p in sorted(picks):
            sd, sp = first.setdefault(one[p], (d, p))
            if (sd, sp) == (d, p):
                continue
            a, b = 0, 0
            while p + a < len(words[d]) and sp + a < len(words[sd]) and words[d][p + a] == words[sd][sp + a]:
                a += 1
            while p > b and sp > b and words[d][p - b - 1] == words[sd][sp - b - 1]:
                b += 1
            if a >= L.PASSAGE_WORDS and a + b >= L.PASSAGE_LEAST:
                gone[d].update(range(p - b, p + a))
    return gone


def brute_all(rows, min_words=MIN_WORDS):
    """The whole rule: lines that go by ``brute``, then the words of passages; of the
    others what is left, with a line that has lost all its words gone too."""
    kept_lines, out = brute_lines(rows, min_words), {}
    for (i, text), gone, dropped in zip(rows, passages(rows), kept_lines):
        lines, n, result = (text or "").split("\n"), 0, []
        total = len((text or "").split())
        for k, line in enumerate(lines):
            size = len(line.split())
            cut = [w in gone for w in range(n, n + size)]
            inside = 0 < n < total and n - 1 in gone and n in gone
            n += size
            if k in dropped or (all(cut) and (size or inside)):
                continue
            if not any(cut):
                result.append(line)
                continue
            pieces = re.findall(r"[^ \t\r\v\f]+[ \t\r\v\f]*", line)
            lead = line[:len(line) - len(line.lstrip(" \t\r\v\f"))]
            rest = lead + "".join(x for x, c in zip(pieces, cut) if not c)
            result.append(rest.rstrip(" \t\r\v\f") if cut[-1] else rest)
        out[i] = "\n".join(result) if dropped or gone else text
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.text for r in dedup_lines(df, **kw).collect()}


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
NEXT = "one two three four five six seven eight nine ten"


def test_later_run_goes_first_stays(spark):
    rows = [(1, f"intro\n{LONG}\n{NEXT}\nend"), (2, f"other\n{LONG}\n{NEXT}\nlast"),
            (3, f"{NEXT}\nshort line"), (4, "short line\nshort line")]
    got = run(spark, rows)
    assert got == {1: rows[0][1], 2: "other\nlast", 3: "short line", 4: rows[3][1]}


def test_short_lines_go_only_as_part_of_a_run(spark):
    rows = [(1, "a b c\nd e f\ng h i"), (2, "x\na b c\nd e f\ng h i\ny"), (3, "a b c\nq")]
    got = run(spark, rows)
    assert got == {1: rows[0][1], 2: "x\ny", 3: "a b c\nq"}


def test_repeats_inside_one_text(spark):
    got = run(spark, [(1, "\n".join([LONG] * 5))])
    assert got == {1: LONG}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 9)))
            for _ in range(25)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    rows.append((60, rows[3][1]))
    assert run(spark, rows) == brute(rows)


def test_defined_results(spark):
    df = spark.createDataFrame(
        [(None, LONG, "x"), (1, None, None), (2, "", "y"), (3, LONG, "z"), (3, LONG, "w"),
         (4, f"{LONG} ", None)], "doc_id bigint, text string, rk string")
    got = sorted(((r.doc_id, r.text, r.rk, r._n_lines, r._n_removed) for r in dedup_lines(df).collect()),
                 key=str)
    assert got == sorted([(None, LONG, "x", 1, 0), (1, None, None, 1, 0), (2, "", "y", 1, 0),
                          (3, "", "z", 1, 1), (3, "", "w", 1, 1), (4, "", None, 1, 1)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_very_long_text(spark):
    lines = [f"line number {i} with some more words in it to count" for i in range(20_000)]
    got = run(spark, [(1, "\n".join(lines)), (2, "\n".join(["new start", *lines[5_000:15_000]]))])
    assert got[2] == "new start" and got[1] == "\n".join(lines)


def test_whole_table(spark):
    from lurescope.llm.queries import op1_line_dedup
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    got = op1_line_dedup(spark, "/root/testdata/sf0.001")
    assert got.filter(F.col("n_removed") > 0).count() > 0
    assert {r.doc_id: r.text for r in got.collect()} == brute_all(rows)


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [[f"w{rnd.randrange(50)}" for _ in range(rnd.choice([5, 20, 30, 45, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(40):
        words = [w for _ in range(rnd.randint(1, 5)) for w in rnd.choice([rnd.choice(pool), [f"u{i}"]])]
        text = "".join(w + rnd.choice([" "] * 20 + ["\n", "  ", " \n", "\n\n"]) for w in words)
        rows.append((i, text))
    assert run(spark, rows) == brute_all(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id bigint, text string")
    names = ["_runs", "_passages", "_n_lines", "_n_removed", "_cut_rk", "rk", "id", "h", "_RUNS2"]
    for name in names:
        df = df.withColumn(name, F.lit(name))
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert all(got[1][n] == n for n in names) and got[2]["text"] == "" and got[2]["__n_removed"] == 1


def shared(rows, out, k):
    """Documents whose result has k words in a row that an earlier result has too."""
    seen, bad = set(), []
    for i, _ in rows:
        w = (out[i] or "").split()
        mine = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
        if mine & seen:
            bad.append(i)
        seen |= mine
    return bad


def test_passages_inside_lines_go(spark):
    rnd = random.Random(9)
    word = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    head, tail, short, own = word(30), word(21), word(25), [word(60) for _ in range(6)]
    rows = [(1, f"{own[0]} {head} {tail} {own[1]} {short} a"),
            (2, f"b c\n{own[2]}  {head} {tail} {own[3]}\nd"),
            (3, f"{own[4]} {head}\n{tail} end"),
            (4, f"{own[5]} {short} e"),
            (5, "x " * 20_000)]
    got = run(spark, rows)
    assert got == {1: rows[0][1], 2: f"b c\n{own[2]}  {own[3]}\nd", 3: f"{own[4]}\nend",
                   4: rows[3][1], 5: "x"}
    assert shared(rows[:4], brute(rows[:4]), 51) == [2, 3] and shared(rows[:4], got, 51) == []


def test_no_passage_of_over_50_words_stays_twice(spark):
    from lurescope.llm.queries import op1_line_dedup
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r.text for r in op1_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert shared(rows, brute(rows), 51) and shared(rows, got, 51) == []
