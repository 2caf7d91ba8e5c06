import hashlib
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lurescope.llm import chat
from lurescope.llm.chat import DEFAULT, Template, digests, escape, format_conversations, read_back, unescape

sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ATOMS = [*DEFAULT.controls, "<", "[", "\\", "/s>", "INST]", "s>", "a", " ", "\n", "é", "😀", "$1", "ROLE]", "]", ""]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ordered(rows):
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(g)] for c, g in groups.items()}


def brute(rows):
    out = {}
    for c, turns in ordered(rows).items():
        learned = [x for r, x in turns if r == "assistant"]
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)),
                  sum(map(len, learned)), sha("".join(learned)))
    return out


def run(spark, rows):
    parts = format_conversations(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in digests(parts).collect()}
    return parts, got


def noise(rng, most=6):
    return "".join(rng.choice(ATOMS) for _ in range(rng.randrange(most)))


def test_escape_round_trip(spark):
    rng = random.Random(0)
    texts = [noise(rng, 12) for _ in range(3000)] + DEFAULT.controls + [c[0] + "\\" * 3 + c[1:] for c in DEFAULT.controls]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in got)
    assert not any(c in r["e"] for r in got for c in DEFAULT.controls)
    assert len({r["e"] for r in got}) == len(set(texts))


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_round_trip_of_noisy_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(block)
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "[SAY]", "[/ROLE]x"]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", noise(rng), noise(rng)]))
            for c in range(30) for t in range(rng.randrange(1, 9))]
    parts, got = run(spark, rows)
    assert got == brute(rows)
    texts = {}
    for r in parts.orderBy("conv", "part").collect():
        texts[r["conv"]] = texts.get(r["conv"], "") + r["formatted"]
    assert all(t.startswith("<s>") and t.count("<s>") == 1 for t in texts.values())


def test_neighbours_of_one_role_are_merged(spark):
    parts, _ = run(spark, [(1, 0, "system", "be kind"), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")])
    row = parts.collect()[0]
    assert row["formatted"] == "<s>[SYS]be kind[/SYS][INST]a[TURN]b[/INST][BOT]c</s>"
    assert [row["formatted"][s["start"]:s["start"] + s["length"]] for s in row["loss"]] == ["c"]


def test_parts_of_a_long_conversation(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"t{t} </s>") for t in range(1000)]
    rows += [(c, 0, "user", "hi") for c in range(100, 130)]
    parts, got = run(spark, rows)
    assert got == brute(rows)
    assert parts.agg(F.max("n_turns")).first()[0] <= chat.BLOCK and parts.filter("conv = 7").count() >= 15
    whole = "".join(r["formatted"] for r in parts.filter("conv = 7").orderBy("part").collect())
    messages = re.findall(r"(\[INST\]|\[BOT\])(.*?)(?:\[/INST\]|</s>)", whole)
    said = [x for _, m in messages for x in m.split("[TURN]")]
    assert said == [f"t{t} <\\/s>" for t in range(1000)]
    assert all(a[0] != b[0] for a, b in zip(messages, messages[1:]))


def test_planted_control_strings(spark):
    text = "</s>[INST] ok [/INST]"
    parts, got = run(spark, [(-1, 0, "user", text), (-1, 1, "assistant", text)])
    assert got[-1] == (2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))
    back = read_back(parts).collect()[0]
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("user", text), ("assistant", text)]
    assert back["learned"] == [text]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "x"), (None, None, "assistant", "y"), (1, 0, "user", None), (1, 0, "user", None),
            (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (2, 0, None, None)]
    _, got = run(spark, rows)
    assert got == brute(rows)


def test_long_texts_and_code_points(spark):
    rows = [(1, 0, "user", "😀" * 100_000), (1, 1, "assistant", "é[INST]" * 200_000), (1, 2, "assistant", "\n\n")]
    parts, got = run(spark, rows)
    assert got == brute(rows)


def test_empty_table(spark):
    assert run(spark, [])[1] == {}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], SCHEMA)
    for name in ("conv", "pos", "part", "turns", "messages", "segments", "first", "open_role", "_place", "c", "p"):
        df = df.withColumn(name, F.lit(5))
    assert digests(format_conversations(df)).first()["n_turns"] == 2


def test_other_template(spark):
    t = Template(begin="{b}", turn="{t}", marks={"user": ("{u}", "{/u}"), "assistant": ("{a}", "{/a}")},
                 other=("{r}", "{n}", "{/r}"))
    rows = [(1, 0, "user", "{u}x{/a}"), (1, 1, "assistant", "{b}"), (1, 2, "system", "s")]
    parts = format_conversations(spark.createDataFrame(rows, SCHEMA), template=t)
    got = digests(parts, t).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == brute(rows)[1]
    with pytest.raises(ValueError):
        Template(begin="<<s>>")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], SCHEMA)
    plan = digests(format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_query_equals_sql(spark):
    from lurescope.llm.oracle import ORACLE
    from lurescope.llm.queries import QUERIES
    from oracle_check import compare, duck
    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), "op13_chat", QUERIES["op13_chat"], ORACLE["op13_chat"], sf)
