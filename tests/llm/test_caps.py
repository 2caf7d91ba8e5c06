import numpy as np
import pytest

from lurescope.llm.caps import ProductCode, near_vectors


def run(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0)
            for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return near_vectors(df)


def truth(x, threshold=0.9):
    x = np.asarray(x, np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    return s


def test_list_decoding_is_exact():
    code, rng = ProductCode(16, 4000), np.random.default_rng(0)
    u = rng.standard_normal((50, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    directions = np.stack([np.concatenate([b[k] for b, k in zip(code.books, ks)])
                           for ks in np.ndindex(*[code.size] * code.m)])
    want = [np.flatnonzero(x @ directions.T >= code.alpha) for x in u]
    for got, w in zip(code.decode(u), want):
        assert got.tolist() == w.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_near_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((600, 64))
    near = base[:300] + rng.standard_normal((300, 64)) * rng.uniform(0.1, 0.55, (300, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    got = {r.id: r for r in run(spark, x).collect()}
    s = truth(x)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= s[i].sum() for i in range(len(x)))      # none below the threshold
    assert found >= 0.97 * s.sum() > 100


def test_components_and_counts_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    c = rng.standard_normal(64)
    x = np.concatenate([c + 0.05 * rng.standard_normal((1500, 64)), rng.standard_normal((100, 64)),
                        np.tile(c, (500, 1))]).astype(np.float32)
    got = {r.id: r for r in run(spark, x).collect()}
    s = truth(x).sum(1)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.999 * s.sum()
    assert {got[i].component for i in [*range(1500), *range(1600, 2100)]} == {0}
    assert all(got[i].component == i and got[i].n_links == 0 for i in range(1500, 1600))


def test_defined_results(spark):
    v = [1.0] + [0.5] * 7
    got = run(spark, [v, v, None, [0.0] * 8, [float("nan")] + v[1:], [None] + v[1:], [float("inf")] + v[1:],
                      v[:4], [], [-0.0] * 8, v], ids=[3, 2, 4, 5, 6, 7, 8, 9, 10, 11, None])
    rows = {r.id: (r.n_links, r.component) for r in got.collect()}
    assert rows == {3: (2, 2), 2: (2, 2), None: (2, 2)} | {i: (0, i) for i in range(4, 12)}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert near_vectors(empty).count() == 0


def test_whole_table(spark):
    from lurescope.llm.queries import op7_near_vectors
    got = op7_near_vectors(spark, "/root/testdata/sf0.1").toPandas().sort_values("vec_id")
    src = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    s = truth(np.array(src["embedding"].tolist()))
    assert got["n_links"].sum() >= 0.99 * s.sum()
    assert (got["n_links"].to_numpy() <= s.sum(1)).all()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


@pytest.mark.parametrize("n", [900, 10**6, 10**7])
def test_recall_with_directions_as_for_large_tables(n):
    from lurescope.llm import caps
    rng, s = np.random.default_rng(7), 0.9
    u, w = rng.standard_normal((2, 300, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = s * u + np.sqrt(1 - s * s) * w / np.linalg.norm(w, axis=1, keepdims=True)
    codes = caps.make_codes(64, max(1024, n * caps.PER_VECTOR // caps.LOAD), s)
    found = np.zeros(300, bool)
    for code in codes:
        a, b = code.decode(u, caps.LEAST), code.decode(v, caps.LEAST)
        assert min(map(len, a + b)) >= caps.LEAST
        found |= [len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]
    assert found.mean() >= 0.97


def test_uneven_blocks_keep_their_pairs():
    """Vectors that lie almost within one block of the code."""
    from lurescope.llm import caps
    rng, s = np.random.default_rng(8), 0.9
    u, w = rng.standard_normal((2, 600, 64))
    u[:, 8:] *= 0.02
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = s * u + np.sqrt(1 - s * s) * w / np.linalg.norm(w, axis=1, keepdims=True)
    codes = caps.make_codes(64, 10**6 // 4, s, u[300:])
    found = np.zeros(300, bool)
    for code in codes:
        a, b = code.decode(u[:300], caps.LEAST), code.decode(v[:300], caps.LEAST)
        found |= [len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]
    assert found.mean() >= 0.97


def test_at_least_the_best_caps():
    code, rng = ProductCode(16, 4000), np.random.default_rng(0)
    u = rng.standard_normal((20, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    directions = np.stack([np.concatenate([b[k] for b, k in zip(code.books, ks)])
                           for ks in np.ndindex(*[code.size] * code.m)])
    code.alpha = 0.99
    for x, got in zip(u, code.decode(u, 5)):
        assert got.tolist() == np.sort(np.argsort(-(directions @ x))[:5]).tolist()
