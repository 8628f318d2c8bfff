import numpy as np
import pytest

from corpuskiln.llm import neighbours


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    out = {}
    for i, name in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 12), ids[j]))
        out[name] = [ids[j] for j in order[:k]]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in zip(ids, x)], "id string, v array<float>, key int")


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def test_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 64))
    x = (centres[rng.integers(0, 150, 3000)] + 0.25 * rng.normal(size=(3000, 64))).astype(np.float32)
    ids = [f"v{k:05}" for k in range(3000)]
    want = brute(ids, x.astype(float), 5)
    got = found(neighbours.nearest_vectors(table(spark, ids, x), "id", "v", bucket_rows=64))
    hits = sum(len(set(want[i]) & set(got[i])) for i in ids)
    assert hits / (5 * 3000) > 0.97


def test_exact_in_one_bucket_and_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    ids = [f"v{k:03}" for k in range(300)]
    want = brute(ids, x.astype(float), 5)
    # two cells per table and all probes: every pair meets, in blocks of at most fifty rows
    got = found(neighbours.nearest_vectors(table(spark, ids, x), "id", "v", tables=1, probes=1, bucket_rows=200, hot_rows=50))
    assert got == want


def test_equal_vectors_and_ties(spark):
    ids = [f"c{k}" for k in range(9)] + ["x", "y"]
    x = np.zeros((11, 64), dtype=np.float32)
    x[:9, 0], x[9, 1], x[10, 1] = 2, 1, 3
    got = found(neighbours.nearest_vectors(table(spark, ids, x), "id", "v"))
    assert got["c0"] == ["c1", "c2", "c3", "c4", "c5"] and got["c8"] == ["c0", "c1", "c2", "c3", "c4"]
    assert got["x"][0] == "y" and got["x"][1:] == ["c0", "c1", "c2", "c3"]


@pytest.mark.parametrize("rows", [[], [("a", [1.0] * 64)], [("a", None), ("b", [0.0] * 64), ("c", [1.0] * 63), ("d", [float("nan")] * 64), (None, [1.0] * 64)]])
def test_unusable(spark, rows):
    df = spark.createDataFrame(rows, "id string, v array<float>")
    assert neighbours.nearest_vectors(df, "id", "v").count() == 0


def test_repeated_rows_count_once(spark):
    x = np.eye(3, 64, dtype=np.float32) + 0.1
    got = found(neighbours.nearest_vectors(table(spark, ["a", "b", "c", "a"], np.vstack([x, x[:1]])), "id", "v"))
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
