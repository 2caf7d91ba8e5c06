import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.llm.whiten import leading_eigenpairs, whiten


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], 0)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def truth(vectors, most=16):
    """Ids, n, deviations, whitened (sign free), shares, by numpy's solver."""
    kept = [(i, v) for i, v in enumerate(vectors)
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    white = ((n * x - s) / n) @ q / np.sqrt(e)
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), white, e / np.trace(cov)


def compare(spark, vectors, most=16):
    got = {r["id"]: r for r in whiten(frame(spark, vectors), most=most).collect()}
    ids, n, deviation, white, share = truth(vectors, most)
    assert sorted(got) == ids
    have = np.array([got[i]["w"] for i in ids])
    sign = np.sign((have * white).sum(axis=0))
    assert np.abs(have * sign - white).max() < 1e-8
    assert [got[i]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in got.values()} == {n}
    assert np.allclose(got[ids[0]]["explained"], share, rtol=1e-10)
    assert max(r["identity_error"] for r in got.values()) < 1e-10


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 150])
def test_eigensolver(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, n)) * rng.choice([1e-3, 1.0, 1e6])
    a = a @ a.T
    e, q = leading_eigenpairs(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.abs(e - want).max() <= 1e-12 * want[0]
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-10
    assert np.abs(a @ q - q * e).max() <= 1e-12 * want[0] * n


@pytest.mark.parametrize("spectrum", [
    [5.0] * 20, [5.0] * 3 + [1.0] * 17, [1e6, 1e6 * (1 - 1e-13), 1.0] + [1e-9] * 17,
    [4.0, 4.0, 3.0, 3.0, 2.0, 2.0] + [0.0] * 14, list(range(20, 0, -1))])
def test_eigensolver_clusters(spectrum):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    for b in (basis, np.eye(20)):
        a = (b * np.array(spectrum)) @ b.T
        e, q = leading_eigenpairs((a + a.T) / 2, 16)
        assert np.abs(e - np.array(spectrum[:16])).max() <= 1e-12 * spectrum[0]
        assert np.abs(q.T @ q - np.eye(16)).max() < 1e-9
        assert np.abs(a @ q - q * e).max() <= 1e-10 * spectrum[0]


def test_equals_numpy(spark):
    rng = np.random.default_rng(0)
    mix = rng.standard_normal((20, 20)) * np.linspace(2, 0.2, 20)[:, None]
    vectors = (rng.standard_normal((300, 20)) @ mix).tolist()
    compare(spark, vectors + [vectors[0]] * 50)  # copies count once


def test_bad_rows_go(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 4)).tolist()
    bad = [None, [None, 1, 2, 3], [math.nan, 1, 2, 3], [math.inf, 0, 0, 0], [1, 2, 3, -math.inf]]
    compare(spark, bad + good + [[0, 0, 0, 0]])


def test_few_dimensions_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((30, 3)).tolist()
    compare(spark, vectors)
    got = whiten(frame(spark, vectors + [[1.0, 2.0], []])).collect()
    assert sorted(r["id"] for r in got) == list(range(30)) and len(got[0]["w"]) == 3


def test_components_without_variance(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in v] + [1.0, 2.0] for v in rng.standard_normal((50, 2))]
    got = whiten(frame(spark, vectors)).collect()
    assert {len(r["w"]) for r in got} == {2} and got[0]["identity_error"] < 1e-10
    assert abs(sum(got[0]["explained"]) - 1) < 1e-12


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance_at_all(spark, vectors):
    assert whiten(frame(spark, vectors)).collect() == []


def test_large_entries(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((30, 3)) * 1e12).tolist() + [[1e300, 0.0, 0.0]]
    got = whiten(frame(spark, vectors)).collect()
    assert sorted(r["id"] for r in got) == list(range(30))
    assert all(r["deviation"] is None for r in got)  # beyond a long
    assert max(r["identity_error"] for r in got) < 1e-9


def test_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((20, 3)).tolist()
    df = frame(spark, vectors, ids=[1] * 10 + [None] * 10)
    for name in ("id", "x", "w", "n", "v", "c", "explained"):
        df = df.withColumn(name, F.lit("z"))
    got = whiten(df).collect()
    assert len(got) == 20 and sum(r["id"] is None for r in got) == 10


def test_query(spark):
    from lurescope.llm.queries import QUERIES
    got = QUERIES["op12_whiten"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    ids, n, deviation, white, share = truth([r["embedding"] for r in rows])
    table = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(table) == 16 * len(ids)
    have = np.array([[table[i, c + 1]["whitened"] for c in range(16)] for i in ids])
    assert np.abs(have * np.sign((have * white).sum(axis=0)) - white).max() < 1e-7
    assert [table[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert np.allclose([table[ids[0], c + 1]["explained"] for c in range(16)], share)
    assert max(r["identity_error"] for r in table.values()) <= 1e-4
