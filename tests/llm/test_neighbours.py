import numpy as np
import pytest

from tidemark.llm.neighbours import encode, estimate, most_similar, rotation, similar_pairs

SCHEMA = "result_id long, embedding array<float>, id long, v string"
DIM = 24


def brute(rows, k=5):
    ok = sorted({r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == DIM and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}.items())
    ids = np.array([i for i, _ in ok])
    x = np.array([np.asarray(v, np.float32) for _, v in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        s = np.round(x @ x[n], 6)
        s[n] = -9
        out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in most_similar(df, "result_id", "embedding", DIM, **options).collect():
        out.setdefault(r["id"], {})[r["place"]] = r["other"]
    return {i: [p[k] for k in sorted(p)] for i, p in out.items()}


def data(n, copies):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, DIM))
    vec = [(centre[rng.integers(12)] + 0.4 * rng.standard_normal(DIM)) * rng.choice([1, 7]) for _ in range(n)]
    rows = [(3 * i + 1, list(map(float, v)), 0, "") for i, v in enumerate(vec)]
    hot = rows[0][1]
    rows += [(100_000 - i, hot, 0, "") for i in range(copies)]  # copies of one vector
    bad = [None, [1.0] * (DIM - 1), [0.0] * DIM, [float("nan")] * DIM, [float("inf")] + [0.0] * (DIM - 1), [None] * DIM, []]
    return rows + [(200_000 + i, b, 0, "") for i, b in enumerate(bad)] + rows[:5] + [(None, hot, 0, "")]


def test_recall_ties_and_unusable(spark):
    rows = data(300, 150)
    want, got = brute(rows), run(spark, rows, lists=12, probes=6, block=40)
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    hot = [i for i in want if i > 90_000]
    assert all(got[i] == want[i] for i in hot)


def test_all_lists_probed_is_exact(spark):
    rows = data(120, 3)
    assert run(spark, rows, lists=4, probes=4) == brute(rows)


def test_small_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(7, [1.0] * DIM, 0, "")]) == {}
    df = spark.createDataFrame([(7, [1.0] * DIM, 0, ""), (5, [1.0] * DIM, 0, "")], SCHEMA)
    assert [tuple(r) for r in similar_pairs(most_similar(df, "result_id", "embedding", DIM)).collect()] == [(5, 7)]


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, rot = x[:20].mean(0), rotation(128)
    code, scalars = encode(x, c, rot)
    est, err = estimate(code, scalars, c, x[:50], rot)
    assert np.mean(np.abs(est - x[:50] @ x.T) <= err) > 0.93
    assert np.allclose(rot @ rot.T, np.eye(128), atol=1e-5) and code.shape == (400, 16)
    assert pytest.approx(0, abs=0.05) == float(np.mean(est - x[:50] @ x.T))
