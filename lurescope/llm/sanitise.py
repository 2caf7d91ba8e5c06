r"""Information-theoretic sanitisation of personal data, in Spark SQL functions
only.

**Protected entities** are the e-mail addresses, IP addresses, card and phone
numbers of the texts (patterns and checks as in ``KINDS``): leftmost,
non-overlapping matches per kind; a match that fails its check is dropped.

**Terms.**  The words within ``WINDOW`` code points of an entity may reveal it.
Over all N documents, with ``n(t)``, ``n(e)`` and ``n(t, e)`` the documents that
hold the term, the entity, and the term near the entity::

    information of e      I(e)    = log2(N / n(e))
    disclosure by t       I(e; t) = log2(N * n(t, e) / (n(t) * n(e)))
    strength              I(e; t) / I(e)

Strength 1 means that the term alone gives the entity away.  A term that stands
near the entity in at least ``MIN_CONTEXTS`` different contexts (copies of a
text are one context) is generalised from strength ``GENERALISE`` on and
removed from ``REMOVE`` on.  As it gives the entity away wherever it stands, every
occurrence in every text counts, whether the text names the entity or not; only
the evidence for it comes from the surroundings of entities.  A term is a whole
word; words that overlap an entity are the entity's.

The patterns run on a text in which separators inside a number and dots inside
a host name are replaced, one code point for one, by private-use characters;
each pattern then is a plain character-class run, which the regex engine
matches in linear time and without recursion on texts of any length.

Defined results: null text counts as empty, an empty text has no span; repeated
rows are reported each; null ids are kept; with one document or an entity in
all documents I(e) is 0 and no term discloses it; other columns are ignored by
``find_spans`` and passed through by ``sanitise``, whatever their names.  Texts of any
length are read whole; spans of one start are ordered by kind; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import bounded_broadcast, free_name, stage

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
WINDOW = 160
MIN_CONTEXTS = 2
GENERALISE = 0.6
REMOVE = 0.9
BROADCAST_ROWS = 200_000
FORM_ROWS = 20_000

_DOT, _SEP = "\ue001", "\ue000"
_LOCAL = rf"[A-Za-z0-9._%+{_DOT}-]"
#: kind -> (cheap test, preparation of the text, pattern)
_RUNS = {
    "email": ("@", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT,
              rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"),
    "ip": (r"[0-9]\.[0-9]", None, None,
           r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"(?<=[0-9])[ -](?=[0-9])", _SEP,
             rf"(?<![0-9{_SEP}])[0-9][0-9{_SEP}]{{13,}}+"),
    "phone": (r"\+[0-9]", None, None, r"\+[0-9][ ().0-9-]+[0-9]"),
}
_LETTER = r"[\p{L}\p{N}]"
_WORD = _LETTER + "{3,}"
_SPAN = "struct<s:int,e:int,v:string>"


def _placed(matches: str, gaps: str, offset: str = "0") -> Column:
    """Matches with their code-point places, from the texts between them."""
    return F.expr(f"""
        CASE WHEN size({matches}) > 0 THEN aggregate(
            sequence(1, size({matches})),
            named_struct('at', cast({offset} AS int), 'out', cast(array() AS array<{_SPAN}>)),
            (acc, i) -> named_struct(
                'at', acc.at + char_length({gaps}[i - 1]) + char_length({matches}[i - 1]),
                'out', concat(acc.out, array(named_struct(
                    's', acc.at + char_length({gaps}[i - 1]),
                    'e', acc.at + char_length({gaps}[i - 1]) + char_length({matches}[i - 1]),
                    'v', {matches}[i - 1])))),
            acc -> acc.out)
        ELSE cast(array() AS array<{_SPAN}>) END""")


_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_CHECKS = {
    "email": "true",
    "ip": r"forall(split(x.v, '\\.'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"""char_length({_DIGITS.format(v='x.v')}) BETWEEN 14 AND 19
        AND aggregate(transform(split(reverse({_DIGITS.format(v='x.v')}), ''), (c, i) ->
            CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN cast(c AS int)
                 WHEN c >= '5' THEN 2 * cast(c AS int) - 9 ELSE 2 * cast(c AS int) END),
            0, (a, b) -> a + b) % 10 = 0""",
    "phone": f"char_length({_DIGITS.format(v='x.v')}) BETWEEN 10 AND 15",
}
_NORMAL = {"email": f"lower(translate(x.v, '{_DOT}', '.'))", "ip": "x.v",
           "card": _DIGITS.format(v="x.v"), "phone": _DIGITS.format(v="x.v")}


def _clean(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("rk"),
                       text.alias("text"))


def entity_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, rk, text, base): ``base`` holds the checked matches as structs
    (s, k, e, v) -- start, kind number, end, normalised value -- sorted."""
    t = _clean(docs, id_col, text_col)
    parts = []
    for k, kind in enumerate(KINDS):
        test, mark, to, pattern = _RUNS[kind]
        has = F.col("text").contains(test) if kind == "email" else F.col("text").rlike(test)
        plain = F.translate("text", _DOT + _SEP, "\n\n")
        ready = plain if mark is None else F.regexp_replace(plain, F.lit(mark), F.lit(to))
        t = t.withColumn(f"_t_{kind}", F.when(has, ready))
        t = t.withColumn(f"_m_{kind}", F.when(
            F.col(f"_t_{kind}").isNotNull(),
            F.regexp_extract_all(f"_t_{kind}", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        t = t.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0,
                                              F.split(f"_t_{kind}", pattern, -1)))
        t = t.withColumn(f"_p_{kind}", _placed(f"_m_{kind}", f"_g_{kind}"))
        parts.append(F.expr(
            f"transform(filter(_p_{kind}, x -> {_CHECKS[kind]}), x -> "
            f"named_struct('s', x.s, 'k', {k}, 'e', x.e, 'v', {_NORMAL[kind]}))"))
    return t.select("id", "rk", "text", F.array_sort(F.concat(*parts)).alias("base"))


def near_terms(found: DataFrame) -> DataFrame:
    """(rk, entity, context, term, s, e): words near an entity that overlap no
    entity of the text."""
    near = (found.filter(F.size("base") > 0).dropDuplicates(["rk"])
            .select("rk", "text", "base", F.explode("base").alias("x"))
            .select("rk", "base", F.concat_ws(":", F.col("x.k"), "x.v").alias("entity"),
                    F.char_length("text").alias("n"), F.col("x.s").alias("xs"), F.col("x.e").alias("xe"),
                    F.greatest(F.col("x.s") - WINDOW, F.lit(0)).alias("b0"),
                    F.expr(f"substring(text, greatest(x.s - {WINDOW}, 0) + 1, "
                           f"least(x.s, {WINDOW}))").alias("before"),
                    F.expr(f"substring(text, x.e + 1, {WINDOW})").alias("after"))
            .withColumn("context", F.xxhash64("before", "after")))
    for side in ("before", "after"):
        near = near.withColumn(f"_m_{side}", F.regexp_extract_all(side, F.lit(_WORD), F.lit(0)))
        near = near.withColumn(f"_g_{side}", F.split(side, _WORD, -1))
    near = (near.withColumn("_p_before", _placed("_m_before", "_g_before", "b0"))
            .withColumn("_p_after", _placed("_m_after", "_g_after", "xe")))
    # a word cut by the window's border does not count
    words = F.expr("""
        concat(filter(_p_before, w -> w.s > b0 OR b0 = 0),
               filter(_p_after, w -> w.e < xe + char_length(after) OR w.e = n))""")
    return (near.withColumn("w", F.explode(words))
            .filter("NOT exists(base, x -> x.s < w.e AND w.s < x.e)")
            .select("rk", "entity", "context", F.lower("w.v").alias("term"),
                    F.col("w.s").alias("s"), F.col("w.e").alias("e")))


def disclosing_terms(docs_text: DataFrame, found: DataFrame, near: DataFrame,
                     min_contexts: int = MIN_CONTEXTS, threshold: float = GENERALISE) -> DataFrame:
    """(entity, term, strength) of the terms at or beyond the threshold."""
    pairs = (near.select("rk", "entity", "context", "term").distinct()
             .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("docs"))
             .groupBy("entity", "term").agg(F.sum("docs").alias("n_te"),
                                            F.count(F.lit(1)).alias("contexts"))
             .filter(F.col("contexts") >= min_contexts))
    pairs = stage(pairs, "pii-pairs")
    total = found.agg(F.count(F.lit(1))).first()[0]
    entities = (found.select("rk", F.explode("base").alias("x"))
                .select("rk", F.concat_ws(":", F.col("x.k"), "x.v").alias("entity")).distinct()
                .groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")))
    terms = stage(pairs.select("term").distinct(), "pii-terms")
    counts = (docs_text.select(F.explode(F.array_distinct(
                  F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("term"))
              .join(bounded_broadcast(terms, BROADCAST_ROWS), "term", "left_semi")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    information = F.log2(F.lit(float(total or 1)) / F.col("n_e"))
    shared = F.log2(F.lit(float(total or 1)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return (pairs.join(entities, "entity").join(counts, "term")
            .withColumn("strength", F.when(information > 0, shared / information).otherwise(0.0))
            .filter(F.col("strength") >= threshold).select("entity", "term", "strength"))


def term_spans(texts: DataFrame, bases: DataFrame, strong: DataFrame) -> DataFrame:
    """(rk, terms): every occurrence of a strong term in every text that overlaps
    no entity (``bases``: the entities of the texts that have any)."""
    forms = (texts.select("rk", F.explode(F.array_distinct(F.regexp_extract_all(
                 "text", F.lit(_WORD), F.lit(0)))).alias("form"))
             .withColumn("term", F.lower("form"))
             .join(bounded_broadcast(strong, BROADCAST_ROWS), "term")
             .groupBy("rk").agg(F.collect_set(F.struct("form", "strength")).alias("forms")))
    forms = stage(forms, "pii-forms")                   # at most a text's own words in a row
    # the forms are letters and digits: a pattern of their own, whole words only
    pattern = F.concat(F.lit(f"(?<!{_LETTER})(?:"),
                       F.array_join(F.transform("forms", lambda x: x["form"]), "|"),
                       F.lit(f")(?!{_LETTER})"))
    held = (texts.select("rk", "text").join(bounded_broadcast(forms, FORM_ROWS), "rk")
            .join(bases.dropDuplicates(["rk"]), "rk", "left")
            .withColumn("pattern", pattern)
            .withColumn("_m_term", F.expr("regexp_extract_all(text, pattern, 0)"))
            .withColumn("_g_term", F.expr("split(text, pattern, -1)"))
            .withColumn("_p_term", _placed("_m_term", "_g_term")))
    # strengths by form, so that a span finds its own
    found = held.withColumn("strengths", F.map_from_entries("forms")).select("rk", F.expr("""
        transform(filter(_p_term, w -> NOT coalesce(exists(base, x -> x.s < w.e AND w.s < x.e), false)),
                  w -> named_struct('s', w.s, 'e', w.e, 'strength', strengths[w.v]))""").alias("terms"))
    return found.dropDuplicates(["rk"])


def find_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``id, rk, base, terms``; ``terms`` are structs
    (s, e, strength) of disclosing terms."""
    spans = stage(entity_spans(docs, id_col, text_col).withColumn(
        "text", F.when(F.size("base") > 0, F.col("text"))), "pii-entities")
    near = stage(near_terms(spans), "pii-near")
    texts = _clean(docs, id_col, text_col)
    strong = stage(disclosing_terms(texts, spans, near)
                   .groupBy("term").agg(F.max("strength").alias("strength")), "pii-strong")
    hits = term_spans(texts, spans.filter(F.size("base") > 0).select("rk", "base"), strong)
    return spans.join(hits, "rk", "left").select(
        "id", "rk", "base", F.coalesce("terms", F.array().cast(
            "array<struct<s:int,e:int,strength:double>>")).alias("terms"))


def sanitise(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets and disclosing
    terms generalised to ``[term]`` or removed; overlapping spans merge and take
    the first one's replacement."""
    spans = find_spans(docs, id_col, text_col).dropDuplicates(["rk"])
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    spans = stage(spans.select(
        F.col("rk").alias("_span_rk"),
        F.array_sort(F.concat(
            F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"),
                                                   F.get(names, x["k"]).alias("r"))),
            F.transform("terms", lambda x: F.struct(
                x["s"].alias("s"), x["e"].alias("e"),
                F.when(x["strength"] >= REMOVE, "").otherwise(f"[{TERM}]").alias("r"))))
        ).alias("_spans")).filter(F.size("_spans") > 0), "pii-spans")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key, full, at = (free_name(c, docs) for c in ("_span_rk", "_full", "_spans"))
    spans = spans.withColumnRenamed("_span_rk", key).withColumnRenamed("_spans", at)
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], text)).withColumn(full, text)
    joined = keyed.join(spans, key, "left").drop(key)
    new = F.expr(f"""
        aggregate({at}, named_struct('at', 0, 'out', ''),
            (acc, x) -> CASE WHEN x.s >= acc.at THEN named_struct(
                    'at', x.e, 'out', concat(acc.out, substring({full}, acc.at + 1, x.s - acc.at), x.r))
                ELSE named_struct('at', greatest(acc.at, x.e), 'out', acc.out) END,
            acc -> concat(acc.out, substring({full}, acc.at + 1)))""")
    return joined.select(*(F.when(F.col(at).isNotNull(), new).otherwise(F.col(f"`{c}`"))
                           .alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
