import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import hard_negatives, queries

NAN = float("nan")


def plain(rows, positives=5, negatives=10):
    """rows: vec_id -> (label, whole vector); anchors are the ids that 100 divides."""
    out = []
    for a, (label, v) in rows.items():
        if a % 100:
            continue
        scored = sorted(((int(v @ w), i, other) for i, (other, w) in rows.items() if i != a), key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(s, j) for s, j, other in scored if other != label and 30 * p <= 100 * s <= 90 * p]
            out += [(a, i, rank + 1, j, p, s) for rank, (s, j) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n, width, clusters, seed):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(clusters, width)) * 60
    labels = pick.integers(0, clusters, n)
    return {i: (int(labels[i]) // 2, np.floor(centres[labels[i]] + pick.normal(size=width) * 25)) for i in range(n)}


def mined(spark, rows):
    df = spark.createDataFrame([(i, label, v.tolist()) for i, (label, v) in rows.items()], "vec_id long, label int, v array<double>")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())


def test_several_nodes_and_levels(spark):
    """More rows than a node holds, in clusters, so that whole nodes are pruned."""
    rows = vectors(9_000, 6, 12, 1)
    assert mined(spark, rows) == plain(rows)


def test_one_vector_is_a_third_of_all_rows(spark):
    rows = vectors(6_000, 4, 6, 2)
    rows = {i: rows[3] if i % 3 == 0 else r for i, r in rows.items()}
    assert mined(spark, rows) == plain(rows)


def test_pairs_of_nodes_are_pruned(spark):
    rows = vectors(20_000, 6, 12, 3)
    df = spark.createDataFrame([(i, label, v.tolist()) for i, (label, v) in rows.items()], "vec_id long, label long, v array<double>")
    width, cells = hard_negatives._fitted(df)
    sides = [hard_negatives._packed(hard_negatives._with_cells(d, width, cells), width, "t", n) for d, n in ((df.where("vec_id % 10 = 0"), hard_negatives.ANCHOR_ROWS), (df, hard_negatives.NODE_ROWS))]
    nodes = [side.chunks.select(side.node()).distinct().count() for side in sides]
    low = sides[0].chunks.select(sides[0].node().alias("node"), F.lit(60_000.0).alias("low"), F.lit(1e18).alias("high")).distinct()
    levels = hard_negatives._levels(sides[0], low), hard_negatives._levels(sides[1])
    assert nodes[1] >= 8 and len(levels[1]) > 1
    pairs = hard_negatives._opened(*levels, True, None).count()
    assert 0 < pairs < nodes[0] * nodes[1] // 2


@pytest.mark.parametrize("same", [True, False])
def test_a_block_against_brute_force_and_its_pruned_leaves(same):
    pick = np.random.default_rng(7)
    centres = pick.normal(size=(16, 8)) * 100
    rows = np.floor(np.repeat(centres, 100, axis=0) + pick.normal(size=(1600, 8)) * 5)
    labels = np.repeat(np.arange(16) // 2, 100)
    block = hard_negatives.Block(np.arange(1600), labels, rows)
    some = hard_negatives.Block(*[x[::20] for x in block])
    scores = (some.v @ rows.T).astype(int)
    windows = {int(i): [(1, 20_000, 60_000), (2, 50_000, 2**62)] for i in some.ids}
    want = []
    for i, at in enumerate(some.ids.tolist()):
        for tag, low, high in windows[at]:
            fits = [(-scores[i, j], j) for j in range(1600) if low <= scores[i, j] <= high and (labels[j] == some.labels[i]) == same and not (same and j == at)]
            want += [(at, tag, j, -s) for s, j in sorted(fits)[:4]]
    assert sorted(hard_negatives.searched(some, windows, block, 4, same)) == sorted(want)
    left, right = hard_negatives._Tree(some.v, hard_negatives.ANCHOR_LEAF), hard_negatives._Tree(rows)
    alive = hard_negatives._alive(left, right, np.full(80, 60_000.0), np.full(80, 1e18))
    assert alive.shape == (len(left.levels[-1]) - 1, len(right.levels[-1]) - 1) and alive.mean() < 0.5


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, ids that repeat, ties, shorter vectors, columns of the operator's names."""
    rows = [(0, [1.0, 0.0], 0), (100, [1.0, 0.0], 2), (1, [0.5, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.5, 0.0], 1), (3, [0.25, 0.5], 3), (4, [0.25, -0.5], 4), (5, [0.25], 5), (8, [0.9, 0.1], None), (9, None, 3), (10, [NAN, 0.0], 3), (11, [None, 0.0], 3), (None, [0.3, 0.0], 3), (200, [0.0, -1.0], 9)]
    spark.createDataFrame([(*r, 5, 5, 5) for r in rows], "vec_id long, embedding array<float>, label int, rank int, score int, anchor int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    assert got == [(0, i, r + 1, j, 32768, 16384) for i in (1, 2) for r, j in enumerate((3, 4, 5))]


def test_empty_table_and_no_anchors(spark, tmp_path):
    for name, rows in (("none", []), ("no_anchor", [(1, [1.0], 1), (2, [1.0], 2)]), ("no_width", [(100, [], 1), (2, [], 1), (3, [], 2)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    assert queries.op13_hard_negatives(spark, f"{tmp_path}/none").count() == 0
    assert queries.op13_hard_negatives(spark, f"{tmp_path}/no_anchor").count() == 0
    assert [tuple(r) for r in queries.op13_hard_negatives(spark, f"{tmp_path}/no_width").collect()] == [(100, 2, 1, 3, 0, 0)]
