r"""Chat formatting: conversations as one marked-up text with a loss mask.

Method: relational formatting, in Spark expressions only.  A distributed sort by
conversation and turn numbers all turns; those of a conversation in one block of
``BLOCK`` numbers are a part (most conversations are one part).  The turn structs of a
part are collected and sorted, neighbours of the same role are merged into one message
by array aggregation, and the messages are concatenated.  Whether a message goes on in
the next part is looked up by equijoins of the parts with the parts beside them, so a
conversation of any length is formatted by many tasks, and no group has more than
``BLOCK`` turns.  A conversation's parts, concatenated in order, are its text.

Template.  ``<s>``, then the messages: ``[SYS]..[/SYS]``, ``[INST]..[/INST]``,
``[BOT]..</s>`` for system, user and assistant, ``[ROLE]name[SAY]..[/ROLE]`` for any other
role.  The turns of a merged message are separated by ``[TURN]``, so that each stays
readable.  Every control string starts with ``<`` or ``[`` and has neither further on.

Escaping.  Inside texts and role names a backslash is put after the first character of
a control string, and one more where backslashes already stand there: ``<``, k
backslashes, ``/s>`` becomes ``<``, k + 1 backslashes, ``/s>`` (any first character with
any rest, in one pass).  Reading takes one away, so the two are inverse on every text,
and a control string in the output is always the template's own: none can start
inside another or span a border, because its rest holds no first character.

Loss mask: spans ``(start, length)`` in code points of the part's text, one per assistant
turn, covering exactly its (escaped) text.

Results by case.  Null text is empty, null role is the empty role, null turn comes
first, a null conversation id is a conversation of its own.  Turns of equal number are
ordered by role, then text; repeated rows are turns of their own.  Turns and texts of
any length are kept whole.  An empty table gives no rows.  Other columns are not read.

``read_back`` and ``digests`` parse the text alone, with the mask's spans.  A digest of a
whole conversation needs its whole text in one value, which is Spark's own bound (2 GB);
formatting does not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import positions, stage

#: Numbers in a block, so turns in a part at most.
BLOCK = 64


@dataclass(frozen=True)
class Template:
    """Control strings; each starts with a character that none holds further on."""
    begin: str = "<s>"
    turn: str = "[TURN]"
    marks: dict = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[BOT]", "</s>")})
    other: tuple = ("[ROLE]", "[SAY]", "[/ROLE]")
    learned: str = "assistant"

    def __post_init__(self):
        firsts = {c[0] for c in self.controls}
        if any(firsts & set(c[1:]) for c in self.controls):
            raise ValueError("a control string may hold its first character only once")

    @property
    def controls(self) -> list[str]:
        return [self.begin, self.turn, *[m for pair in self.marks.values() for m in pair], *self.other]

    @property
    def openers(self) -> list[str]:
        return [*[pair[0] for pair in self.marks.values()], self.other[0]]

    @property
    def closers(self) -> list[str]:
        return [*[pair[1] for pair in self.marks.values()], self.other[2]]


DEFAULT = Template()


def _any(strings) -> str:
    return "(?:" + "|".join(re.escape(s) for s in strings) + ")"


def escape(text: Column, t: Template = DEFAULT) -> Column:
    """One backslash more after the first character of every control string."""
    first = _any(sorted({c[0] for c in t.controls}))
    rest = _any(c[1:] for c in t.controls)
    return F.regexp_replace(text, rf"({first})(\\*{rest})", r"$1\\$2")


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    """The inverse of ``escape``."""
    first = _any(sorted({c[0] for c in t.controls}))
    rest = _any(c[1:] for c in t.controls)
    return F.regexp_replace(text, rf"({first})\\(\\*{rest})", "$1$2")


def _by_role(role: Column, t: Template, place: int, other: Column) -> Column:
    found = other
    for name, pair in t.marks.items():
        found = F.when(role == name, F.lit(pair[place])).otherwise(found)
    return found


def opener(role: Column, t: Template = DEFAULT) -> Column:
    return _by_role(role, t, 0, F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])))


def closer(role: Column, t: Template = DEFAULT) -> Column:
    return _by_role(role, t, 1, F.lit(t.other[2]))


def _merge(turns: str) -> Column:
    """Messages ``(role, texts)``: neighbours of the same role are one."""
    return F.expr(f"""aggregate({turns}, cast(array() AS array<struct<role: string, texts: array<string>>>),
        (done, x) -> CASE WHEN size(done) > 0 AND done[size(done) - 1].role = x.role
            THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
                'role', x.role, 'texts', concat(done[size(done) - 1].texts, array(x.text)))))
            ELSE concat(done, array(named_struct('role', x.role, 'texts', array(x.text)))) END)""")


def _segments(t: Template) -> Column:
    """The strings of a part in order, each with whether it is learned."""
    def segment(text, learned=F.lit(False)):
        return F.array(F.struct(text.alias("s"), learned.alias("learned")))

    def texts(m):
        said = F.transform(m["texts"], lambda x, j: F.concat(
            F.when(j > 0, segment(F.lit(t.turn))).otherwise(F.filter(segment(F.lit("")), lambda y: F.lit(False))),
            segment(escape(x, t), m["role"] == t.learned)))
        return F.flatten(said)

    def message(m, i):
        start = F.when((i == 0) & F.col("open_role").isNotNull(), F.lit(t.turn)).otherwise(opener(m["role"], t))
        goes_on = (i == F.size("messages") - 1) & F.coalesce(F.col("next_role") == m["role"], F.lit(False))
        return F.concat(segment(start), texts(m), segment(F.when(goes_on, F.lit("")).otherwise(closer(m["role"], t))))

    return F.concat(segment(F.when(F.col("first"), F.lit(t.begin)).otherwise(F.lit(""))),
                    F.flatten(F.transform("messages", message)))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", template: Template = DEFAULT) -> DataFrame:
    """Parts ``(conv, part, first, open_role, formatted, loss, n_turns)``; ``open_role``
    is the role of the message that goes on from the part before, else null."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = positions(rows, [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(),
                              F.col("role"), F.col("text")], "chat-turns")
    parts = (placed.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("part"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")))
    parts = stage(parts, "chat-parts")
    ends = parts.select(F.col("conv").alias("c"), F.col("part").alias("p"),
                        F.expr("turns[0].role").alias("head"),
                        F.expr("turns[size(turns) - 1].role").alias("tail"))
    before = ends.select("c", (F.col("p") + 1).alias("p"), F.col("tail").alias("role_before"))
    after = ends.select("c", (F.col("p") - 1).alias("p"), F.col("head").alias("next_role"))
    for beside in (before, after):
        parts = parts.join(beside, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")),
                           "left").drop("c", "p")
    parts = parts.select(
        "conv", "part", F.size("turns").cast("long").alias("n_turns"), _merge("turns").alias("messages"),
        F.col("role_before").isNull().alias("first"),
        F.when(F.col("role_before") == F.expr("turns[0].role"), F.col("role_before")).alias("open_role"),
        "next_role")
    parts = parts.withColumn("segments", _segments(template))
    loss = F.expr("""aggregate(segments,
        named_struct('at', 0, 'spans', cast(array() AS array<struct<start: int, length: int>>)),
        (done, x) -> named_struct('at', done.at + char_length(x.s), 'spans', CASE WHEN x.learned
            THEN concat(done.spans, array(named_struct('start', done.at, 'length', char_length(x.s))))
            ELSE done.spans END), done -> done.spans)""")
    return parts.select("conv", "part", "first", "open_role",
                        F.array_join(F.transform("segments", lambda x: x["s"]), "").alias("formatted"),
                        loss.alias("loss"), "n_turns")


def read_back(parts: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``parts`` with ``turns``, the ``(role, text)`` of every turn, and ``learned``, the
    texts under the loss mask, both read from ``formatted`` and unescaped."""
    t = template
    text = F.regexp_replace("formatted", rf"\A{re.escape(t.begin)}", "")
    text = F.when(F.col("open_role").isNull(), text).otherwise(F.concat(
        opener(F.col("open_role"), t), F.regexp_replace(text, rf"\A{re.escape(t.turn)}", "")))
    messages = F.filter(F.split(text, f"(?={_any(t.openers)})", -1), lambda m: m != "")
    name = rf"(?s)\A{re.escape(t.other[0])}(.*?){re.escape(t.other[1])}"
    marks = _any(pair[0] for pair in t.marks.values())

    def turns_of(m):
        role = unescape(F.regexp_extract(m, name, 1), t)
        for known, pair in t.marks.items():
            role = F.when(m.startswith(F.lit(pair[0])), F.lit(known)).otherwise(role)
        body = F.regexp_replace(F.regexp_replace(m, rf"\A{marks}", ""), name, "")
        body = F.regexp_replace(body, rf"{_any(t.closers)}\z", "")
        return F.transform(F.split(body, re.escape(t.turn), -1), lambda x: F.struct(
            role.alias("role"), unescape(x, t).alias("text")))

    learned = F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"]), t))
    return parts.withColumn("turns", F.flatten(F.transform(messages, turns_of))).withColumn("learned", learned)


def digests(parts: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation what its text says: ``conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    read = read_back(parts, template).select(
        "conv", "part", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda x: F.concat(
            x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"),
        F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv").agg(
        F.sum("n").alias("n_turns"), F.sum(F.char_length("learned")).alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("part", "said", "learned"))).alias("parts"))

    def sha(name):
        return F.sha2(F.array_join(F.transform("parts", lambda p: p[name]), ""), 256)

    return whole.select("conv", "n_turns", sha("said").alias("turns_sha256"), "loss_chars",
                        sha("learned").alias("loss_sha256"), "formatted_chars")
