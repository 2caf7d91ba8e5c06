import random
import re

import pytest

from lurescope.llm.licenses import PHRASES, TEMPLATES, scan_licenses, templates

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(WORD, (t or "").translate(LOW))


def brute(text, phrases=PHRASES, texts=TEMPLATES, threshold=0.8):
    w = words(text)
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(w))
                    if w[i:i + len(p.split())] == p.split())
    matches = set()
    for t in templates({}, texts, threshold):
        for start in range(0, len(w), t.block // 2):
            block, run = w[start:start + t.block], t.required
            have = len(set(t.words) & set(block))
            if have >= t.need and (not run or any(block[i:i + len(run)] == run for i in range(len(block)))):
                matches.add((t.label, start, round(have / len(set(t.words)), 9)))
    return len(w), places, matches


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.id: (r.n_words, [tuple(p) for p in r.places or []],
                   {(m.label, m.start, round(m.share, 9)) for m in r.matches or []})
            for r in scan_licenses(df, **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    every = [*PHRASES, *TEMPLATES]
    every = [t.replace("[", "").replace("]", "") for t in every]
    vocab = sorted({w for t in every for w in t.split()}) + ["the", "of", "größe", "x1"]
    rows = []
    for i in range(80):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            part = rnd.choice(every).split()
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = "other"
            at = rnd.randint(0, len(t))
            t[at:at] = part
        rows.append((i, rnd.choice([" ", "\n", ", "]).join(w.title() if rnd.random() < .2 else w for w in t)))
    got = run(spark, rows)
    for i, t in rows:
        assert got[i] == brute(t), i


def test_words_next_to_each_other_only(spark):
    got = run(spark, [(1, "CC-BY 4.0; all rights\nreserved."), (2, "cc x by. rights reserved all"),
                      (3, "ccby general public licenses")])
    assert [p for p in got[1][1]] == [(0, "cc-by"), (4, "reserved")]
    assert got[2][1] == [] and got[3][1] == []


NOT_NAMED = [
    "The album was released under the Sony license",
    "He was released from jail; under section nine the fishing license lapsed",
    "licensed under CC BY 4.0", "licensed under CC BY-NC-SA 4.0",
    "This work is licensed under the GNU General Public License version 2",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "This source code form is subject to the terms of the Eclipse Public License",
    "Licensed under the Apache License, Version 1.1; see section 2 part 0",
    "MIT students released a film; the driving license office is under the bridge"]
NAMED = {
    "Released under the MIT License.": "mit", "licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under Apache License, Version 2.0": "apache-2.0",
    "Work licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This code form is subject to the terms of the Mozilla Public License": "mpl"}


def test_versions_and_variants_are_told_apart(spark):
    pad = "some other words before and after it " * 4
    rows = [(i, f"{pad}{t} {pad}") for i, t in enumerate([*NOT_NAMED, *NAMED])]
    rows += [(100 + i, t) for i, t in enumerate([*NOT_NAMED, *NAMED])]
    got = run(spark, rows)
    for at in (0, 100):
        for i, t in enumerate(NOT_NAMED):
            assert got[at + i][2] == set(), t
        for i, (t, label) in enumerate(NAMED.items()):
            assert {m[0] for m in got[at + len(NOT_NAMED) + i][2]} == {label}, t


def test_defined_results(spark):
    df = spark.createDataFrame(
        [(None, "All rights reserved", 1), (1, None, 2), (2, "", 3), (3, "..!", 4),
         (4, "cc by", 5), (4, "cc by", 5), (5, "word " * 300_000 + "cc by " + "w " * 50, 6)],
        "doc_id bigint, text string, words int")
    got = sorted(((r.id, r.n_words, [tuple(p) for p in r.places or []])
                  for r in scan_licenses(df).collect()), key=str)
    assert got == sorted([(None, 3, [(0, "reserved")]), (1, 0, []), (2, 0, []), (3, 0, []),
                          (4, 2, [(0, "cc-by")]), (4, 2, [(0, "cc-by")]),
                          (5, 300_052, [(300_000, "cc-by")])], key=str)
    assert scan_licenses(df.limit(0)).count() == 0


def test_whole_table(spark):
    from lurescope.llm.queries import op3_license
    got = {r.doc_id: r for r in op3_license(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n, places, matches = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (n, len(places))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({p[1] for p in places}))
        assert g.labels == ",".join(sorted({p[1] for p in places} | {m[0] for m in matches}))
        assert abs(g.score - (1.0 if places else max([m[2] for m in matches], default=0))) < 1e-9
