"""Quality classifier: hierarchical empirical Bayes.

Three levels of evidence decide on a document:

1. a logistic document classifier over form features (letter, digit and symbol
   shares, repeated words and shingles, word and line lengths), fitted on at
   most ``max_fit_rows`` labelled rows -- the one bounded sample here;
2. the quality rate of its *path* (host section and language), shrunk to
3. the rate of its *host*, itself shrunk to the global rate.

Site counts cover every document: a labelled one counts with its label, an
unlabelled one with the classifier's probability.  How strongly a sparse site
is pulled to its parent (the prior's weight) is estimated from all sites by the
method of moments.  Both levels are plain grouped aggregates, so a host with a
third of all rows is combined in the map tasks.

Defined results: null text counts as empty; a text without a word gets
``p_doc`` 0 and is rejected; null source or language is a site of its own;
rows that share an id are judged each by their own text; repeated labels of an
id are averaged (a tie counts as good); without labels of both classes the
document evidence is 0.5 for every non-empty text and everything non-empty is
kept.  Other columns are ignored by ``classify`` and passed through by
``keep_documents``.  Texts of any length are read whole; a posterior of exactly the
threshold is kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm import textscan as T
from lurescope.llm.common import ship, stage

#: Bound of the labelled sample the document classifier is fitted on.
MAX_FIT_ROWS = 20_000
RIDGE = 1e-3
#: Bounds of the estimated prior weight, in documents.
WEIGHT_RANGE = (2.0, 1_000.0)
#: Log-odds a site may add to or take from a document's own evidence.
SITE_CAP = 2.0

_CLASSES = ["upper", "lower", "digit", "space", "newline", "bang", "bar", "mark", "stop", "wide"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("mark"))
    t[65:91] = 0
    t[97:123] = 1
    t[48:58] = 2
    t[[9, 11, 12, 13, 32]] = 3
    t[10] = 4
    t[ord("!")] = 5
    t[ord("|")] = 6
    for c in ".,;:?'\"()-":
        t[ord(c)] = 8
    t[128:] = 9
    return t


CLASS_OF = _class_table()
FEATURES = [f"share_{c}" for c in _CLASSES] + [
    "mean_word", "long_words", "distinct_words", "distinct_shingles", "log_words",
    "words_per_stop", "words_per_line"]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature matrix, words per text) of a string column."""
    rows, words = [], []
    for a, b, s in T.column_scans(column, T.NOT_SPACE, lower=False):
        n, k = b - a, len(_CLASSES)
        size = np.diff(s.text_start)
        key = np.repeat(np.arange(n) * k, size) + CLASS_OF[s.data]
        counts = np.bincount(key, minlength=n * k).reshape(n, k).astype(float)
        nw = np.diff(s.doc_first)
        doc = s.doc_of_word()
        length = s.end - s.start
        dw = np.bincount(T.distinct_per_doc(s.hashes, doc)[1], minlength=n)
        sh, sd = T.shingles(s, 3)
        ns = np.bincount(sd, minlength=n)
        ds = np.bincount(T.distinct_per_doc(sh, sd)[1], minlength=n)
        some = np.maximum(nw, 1)
        rows.append(np.column_stack([
            counts / np.maximum(size, 1)[:, None],
            np.bincount(doc, weights=length, minlength=n) / some,
            np.bincount(doc, weights=length >= 10, minlength=n) / some,
            dw / some, ds / np.maximum(ns, 1), np.log1p(nw),
            np.log1p(nw / (1 + counts[:, 8])), np.log1p(nw / (1 + counts[:, 4]))]))
        words.append(nw)
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(words)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, nw = features(batch.column("text"))
        flat = pa.array(x.astype(np.float32).ravel())
        offs = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("rk"), batch.column("host"), batch.column("path"),
             pa.array(nw, pa.int64()), pa.ListArray.from_arrays(offs, flat)],
            names=["id", "rk", "host", "path", "n_words", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; last weight is the bias.
    The inputs are standardised and the scaling is folded into the weights."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1.0
    z = np.column_stack([np.clip((x - mean) / sd, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + RIDGE * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w, mean, sd])


def predict(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    w, mean, sd = model[:k + 1], model[k + 1:2 * k + 1], model[2 * k + 1:]
    z = np.clip((x - mean) / sd, -8, 8) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _site_columns(docs: DataFrame, id_col, text_col, host_col, lang_col) -> dict:
    """Column expressions of a document's id, text, host, path and row key."""
    def text_of(c):
        return F.coalesce(docs[c].cast("string"), F.lit(""))
    host = F.regexp_extract(text_of(host_col), r"^(?:[a-z]+://)?([^/]*)", 1)
    path = F.concat_ws("|", F.regexp_extract(text_of(host_col),
                                             r"^(?:[a-z]+://)?[^/]*/([^/?#]*)", 1),
                       text_of(lang_col))
    out = {"id": docs[id_col], "text": text_of(text_col), "host": host, "path": path}
    return out | {"rk": F.xxhash64(*out.values())}


def document_features(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source",
                      lang_col="lang") -> DataFrame:
    """One staged row per document: id, row key, host, path, word count, features."""
    ship(docs.sparkSession)
    site = docs.select(*(c.alias(n) for n, c in _site_columns(
        docs, id_col, text_col, host_col, lang_col).items()))
    return stage(site.mapInArrow(
        _feature_batches, "id bigint, rk bigint, host string, path string, n_words bigint, "
                          "x array<float>"), "quality-features")


def shrink(stats: DataFrame, parent: DataFrame | None, key: list[str], rate: float,
           out: str) -> DataFrame:
    """Posterior mean of a level's rate: prior centred on the parent's
    posterior, prior weight from the method of moments over all sites.

    ``stats`` has ``n`` and ``k`` per site of the level; ``parent`` a column
    ``parent_rate`` by the site's leading key."""
    t = stats if parent is None else stats.join(parent, key[:-1])
    t = t if parent is not None else t.withColumn("parent_rate", F.lit(rate))
    dev = F.col("k") / F.col("n") - F.col("parent_rate")
    noise = F.col("parent_rate") * (1 - F.col("parent_rate"))
    big = t.filter("n >= 2").agg(
        F.sum(F.col("n") * dev * dev).alias("ss"), F.sum(noise).alias("expected"),
        F.sum(F.col("n") * noise).alias("spread"), F.sum("n").alias("n")).first()
    between = max(((big["ss"] or 0.0) - (big["expected"] or 0.0)) / max(big["n"] or 0.0, 1.0), 1e-9)
    weight = float(np.clip((big["spread"] or 0.0) / max(big["n"] or 0.0, 1.0) / between,
                           *WEIGHT_RANGE))
    return t.select(*key, ((F.col("k") + weight * F.col("parent_rate"))
                           / (F.col("n") + weight)).alias(out))


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text",
             host_col="source", lang_col="lang", label_id="doc_id", label_col="quality",
             max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row per document: ``id, rk, host, path, n_words, p_doc`` (document
    evidence), ``p_host``, ``p_path`` (site posteriors), ``p_keep``, ``keep``."""
    f = document_features(docs, id_col, text_col, host_col, lang_col)
    marks = (labels.select(F.col(label_id).alias("lid"), F.col(label_col).cast("double").alias("y"))
             .filter("lid is not null and y is not null").groupBy("lid")
             .agg((F.avg("y") >= 0.5).cast("double").alias("y")))
    known = stage(f.join(marks, f["id"] == marks["lid"]).select("id", "rk", "y"), "quality-labelled")
    sample = (known.dropDuplicates(["rk"]).orderBy(F.xxhash64("rk"), "rk").limit(max_fit_rows)
              .select("rk", "y"))
    got = (f.filter("n_words > 0").join(F.broadcast(sample), "rk")
           .dropDuplicates(["rk"]).orderBy("rk").select("x", "y").toPandas())
    model = None
    if len(got) and got["y"].nunique() == 2:
        model = fit_logistic(np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            x = np.asarray(b.column("x").flatten(), dtype=float).reshape(n, len(FEATURES))
            p = np.full(n, 0.5) if model is None else predict(model, x)
            p[np.asarray(b.column("n_words")) == 0] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "rk", "host", "path", "n_words")), pa.array(p)],
                names=["id", "rk", "host", "path", "n_words", "p_doc"])

    scored = stage(f.mapInArrow(score, "id bigint, rk bigint, host string, path string, "
                                       "n_words bigint, p_doc double"), "quality-scored")
    # The classifier speaks for a site's unlabelled documents; labels for the rest.
    seen = known.groupBy("rk").agg(F.max("y").alias("y"))
    counted = scored.join(seen, "rk", "left")
    paths = stage(counted.groupBy("host", "path").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.coalesce("y", "p_doc")).alias("k")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = float(np.clip((total["k"] or 0.0) / max(total["n"] or 0.0, 1.0), 1e-3, 1 - 1e-3))
    hosts = stage(shrink(hosts, None, ["host"], rate, "p_host"), "quality-hosts")
    sites = stage(shrink(paths, hosts.withColumnRenamed("p_host", "parent_rate"),
                         ["host", "path"], rate, "p_path").join(hosts, "host"), "quality-sites")

    def logit(c):
        c = F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.log(c / (1 - c))

    shift = logit(F.col("p_path")) - logit(F.lit(rate))
    shift = F.greatest(F.least(shift, F.lit(SITE_CAP)), F.lit(-SITE_CAP))
    score_col = F.when(F.col("n_words") == 0, 0.0).otherwise(
        1 / (1 + F.exp(-(logit(F.col("p_doc")) + shift))))
    out = scored.join(sites, ["host", "path"]).withColumn("p_keep", score_col)
    keep = (F.col("p_keep") >= 0.5) if model is not None else (F.col("n_words") > 0)
    return out.select("id", "rk", "host", "path", "n_words", "p_doc", "p_host", "p_path",
                      "p_keep", keep.alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text",
                   host_col="source", lang_col="lang", **kw) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    cols = (id_col, text_col, host_col, lang_col)
    rejected = stage(classify(docs, labels, *cols, **kw).filter("not keep")
                     .select(F.col("rk").alias("_rejected_rk")).distinct(), "quality-rejected")
    rk = _site_columns(docs, *cols)["rk"]
    return docs.join(rejected, rk == rejected["_rejected_rk"], "left_anti")
