import numpy as np
import pytest

from folium.llm import queries, whitening
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")


def plain(rows, most=8):
    """Whitening by numpy of (vec_id, vector) rows, signs apart."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in good], dtype=np.int64)
    n, total = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(width, width))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    white = (x - total / n) @ vectors[:, :most] / np.sqrt(values[:most])
    return [i for i, _ in good], [int(((n * r - total).astype(object) ** 2).sum()) for r in x], white, values / values.sum()


def check(df, rows):
    ids, deviations, white, explained = plain(rows)
    got = df.collect()
    k = min(8, white.shape[1])
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    for c in range(k):
        of = sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["vec_id"], r["deviation"], abs(r["whitened"])))
        want = sorted(zip(ids, deviations, white[:, c]), key=lambda r: (r[0], r[1], abs(r[2])))
        assert [(r["vec_id"], r["deviation"]) for r in of] == [(i, d) for i, d, _ in want]
        a, b = np.array([r["whitened"] for r in of]), np.array([w for _, _, w in want])
        sign = np.sign(a @ b)
        assert np.allclose(a * sign, b, atol=1e-6) and np.allclose([r["explained"] for r in of], explained[c], rtol=1e-9)


def written(spark, folder, rows, schema="vec_id long, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, SF), rows)


def test_odd_vectors(spark, tmp_path):
    """Nulls, parts of a vector, rows that repeat, equal ids, more dimensions than a tile, columns of the operator's names."""
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.normal(size=70).astype(np.float32)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (900, rows[0][1][:5]), (901, None), (902, [NAN] * 70), (903, [None] * 70), (904, [INF] + [0.0] * 69)]
    folder = written(spark, tmp_path, [(i, v, 1, 5, 6.0) for i, v in rows], "vec_id long, embedding array<float>, x int, deviation int, whitened double")
    check(queries.op12_whitening(spark, folder), rows)


def test_no_rows_and_no_variance(spark, tmp_path):
    none = queries.op12_whitening(spark, written(spark, tmp_path / "none", [(1, None, 0), (2, [NAN], 0)]))
    assert none.count() == 0 and set(none.columns) == set("vec_id component n deviation whitened explained identity_error".split())
    same = queries.op12_whitening(spark, written(spark, tmp_path / "same", [(i, [0.5, 0.25], 0) for i in range(5)])).collect()
    assert len(same) == 10 and {(r["deviation"], r["whitened"], r["explained"]) for r in same} == {(0, 0.0, 0.0)}


def test_deviations_beyond_a_long():
    x = np.array([[1 << 45, 0], [3, 4]], dtype=np.int64)
    assert whitening.deviations(x, 2, [(1 << 45) + 3, 4]) == [None, None]
    assert whitening.deviations(np.array([[3, 4], [5, 8]]), 2, [8, 12]) == [4 + 16, 4 + 16]


def test_covariance_of_many_tasks(spark):
    pick = np.random.default_rng(5)
    x = pick.integers(-1000, 1000, size=(5000, 65))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7)
    model = whitening.fit(df, "x")
    assert model.sums.totals == x.sum(0).tolist()
    assert np.allclose((model.vectors * model.values) @ model.vectors.T, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-6)
    with pytest.raises(Exception):
        whitening.fit(df, "absent")
