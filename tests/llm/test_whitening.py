"""Operator 11 against plain numpy, and its edge cases."""

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from missive.llm import whitening
from missive.llm.registry import QUERIES


def brute(vectors):
    """Whitened rows and the rest, from the contract's words alone."""
    x = np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    centred = once - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = brute([r.embedding for r in rows])
    got = QUERIES["op11_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    assert set(got.n) == {n} and got.component.tolist() == list(range(1, 17)) * len(rows)
    assert got.deviation.tolist()[::16] == deviation.tolist()
    mine = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert got.explained.tolist()[:16] == pytest.approx(explained.tolist(), rel=1e-9) and got.identity_error.max() < 1e-9


def test_tiles_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(300, 11)))]
    x = spark.createDataFrame(data, "vec_id long, embedding array<double>").select(whitening.entries(F.col("embedding")).alias("x"))
    want = whitening.fit(x, 5)
    for tile, block in ((4, 7), (11, 300), (1, 1000), (3, 64)):
        monkeypatch.setattr(whitening, "TILE", tile)
        monkeypatch.setattr(whitening, "BLOCK", block)
        got = whitening.fit(x, 5)
        assert np.allclose(got.values, want.values, rtol=1e-12) and got.identity_error < 1e-9
        assert (got.whole == want.whole).all() and (got.part == want.part).all()


def test_hot_vectors_count_once(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in row] for row in rng.normal(size=(40, 3))]
    rows = vectors + [vectors[0]] * 400
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("x", whitening.entries(F.col("embedding")))
    model = whitening.fit(df)
    found = whitening.whiten(df, model)
    assert model.n == 40 and found.count() == 440 and found.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    assert found.filter("vec_id = 0 OR vec_id >= 40").select("whitened").distinct().count() == 1


def test_edge_cases(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 1.0]),
        (9, [1.0, 2.0, 3.0]), (None, [3.0, 2.0]), (10, [1e30, 1.0]), (11, [-0.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("x", "whitened_", "n", "component", "at")})
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (1, 1, 2, None, 11) for c in (1, 2))
    assert all((r.whitened is None) == (r.component == 2) for r in got) and {r.n for r in got} == {4}
    for name, keep in (("none", []), ("one", [(1, [1.0, 2.0])])):
        spark.createDataFrame(keep, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
        found = QUERIES["op11_whitening"](spark, str(tmp_path / name)).collect()
        assert [(r.whitened, r.explained, r.deviation) for r in found] == [(None, None, 0)] * (2 * len(keep))


def test_deviations_beyond_a_long(spark):
    model = whitening.Model(3, np.array([0]), np.array([1]), np.array([1.0]), np.eye(1), 1.0)
    got = whitening._deviation(model, np.array([[2], [1 << 50]]))
    assert [int(v) for v in got.to_pylist()] == [25, (3 * (1 << 50) - 1) ** 2]
