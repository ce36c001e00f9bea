"""Hard negatives of anchors by dual-tree search over anchors and candidates.

All rows are put in the order of label and of the cell of a k-d tree that is fitted on a bounded sample, by
range, so that equal cells are split by a hash; each partition is packed into chunks. Chunks are the lowest
nodes of a tree whose upper nodes join neighbours: each node has a centre, a radius and the labels that it
reaches from and to. Anchors have a tree of their own, made alike, whose nodes also know the lowest and the
highest score that any of their anchors still looks for.

A search starts with the pair of both roots and opens pairs level by level, as joins of tables of nodes. The
inner products of two nodes lie within an interval about the product of their centres; where it lies
outside what the anchors look for, or the labels cannot fit, the pair goes with all anchors below it. The
pairs of lowest nodes that are left meet in tasks, where a k-d tree within each side prunes by the same
intervals, and what is left of its leaves is scored exactly.

What anchors look for comes from a first search that follows each anchor node to its nearest candidates alone.

Rows without vec_id, label or a whole vector take no part; of rows that repeat a vec_id the one of the least
label and vector counts. Shorter vectors count as filled up with zeros. Ties in score go to the smaller
vec_id. Other columns are dropped. Without anchors, or of an empty table, there are no rows.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.storage import written
from folium.llm.topk_search import _matrix, _products

#: Rows of a chunk and of a lowest node, more or less, and of a leaf of the tree within a task; of anchors fewer,
#: as a node is pruned for all of its anchors or for none.
NODE_ROWS, ANCHOR_ROWS = 2048, 512
LEAF_ROWS, ANCHOR_LEAF = 32, 8
#: Rows that the k-d tree of the order is fitted on, and its levels.
SAMPLE_ROWS = 4096
CELL_LEVELS = 8
#: Partitions of the order at most; longer ones hold more chunks.
MOST_PARTITIONS = 4096
#: Candidate nodes that an anchor node is followed to in the first search.
NEAREST = 2
#: Bits of a chunk's number within its partition; nodes are joined by 8.
CHUNK_BITS = 20
NODE_BITS = 3

NONE, ALL = -(2**63 - 1), 2**63 - 1
CHUNK = "seq long, n int, low_label long, high_label long, centre array<double>, radius double, ids binary, labels binary, vectors binary, width int"
NODE = "node long, parent long, n long, low_label long, high_label long, centre array<double>, radius double, low double, high double"
FOUND = "anchor long, anchor_id long, tag long, other_id long, score long"


def _cells(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dimension and threshold of each inner node of a k-d tree in breadth-first order."""
    dims, cuts = np.zeros(2**CELL_LEVELS, dtype=np.int64), np.full(2**CELL_LEVELS, np.inf)
    todo = {1: np.arange(len(sample))}
    for node in range(1, 2**CELL_LEVELS):
        rows = sample[todo[node]]
        if len(rows) > 1:
            dims[node] = int((rows.max(0) - rows.min(0)).argmax())
            cuts[node] = np.median(rows[:, dims[node]])
        right = rows[:, dims[node]] > cuts[node]
        todo[2 * node], todo[2 * node + 1] = todo[node][~right], todo[node][right]
    return dims, cuts


def _fitted(rows: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The longest vector's dimensions, and the k-d tree of a bounded sample of rows (vec_id, v)."""
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if not width:
        return 0, (np.zeros(2**CELL_LEVELS, dtype=np.int64), np.zeros(2**CELL_LEVELS))
    some = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    return width, _cells(_matrix(some["v"], width))


def _with_cells(rows: DataFrame, width: int, cells: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (vec_id, label, v) with cell."""
    dims, cuts = cells

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = _matrix(pa.chunked_array([batch.column("v")]), width), np.ones(len(batch), dtype=np.int64)
            if width:
                for _ in range(CELL_LEVELS):
                    at = 2 * at + (v[np.arange(len(v)), dims[at]] > cuts[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(walk, "vec_id long, label long, v array<double>, cell long")


def _ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = v.mean(0)
    return centre, float(np.sqrt(((v - centre) ** 2).sum(1).max(initial=0.0)))


class Side(NamedTuple):
    """Chunks of one side, its lowest nodes' bits, and the shifts from level to level above them."""

    chunks: DataFrame
    bits: int
    shifts: list[int]

    def node(self) -> Column:
        return F.shiftright("seq", self.bits)


def _packed(rows: DataFrame, width: int, name: str, node_rows: int = NODE_ROWS) -> Side:
    """rows in order of label and cell as chunks, written."""
    n = rows.count()
    parts = max(1, min(MOST_PARTITIONS, -(-n // node_rows)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, size = TaskContext.get().partitionId() << CHUNK_BITS, [], 0

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            v, labels = _matrix(rows["v"], width), rows["label"].to_numpy()
            centre, radius = _ball(v)
            one = {"seq": [seq], "n": pa.array([len(v)], pa.int32()), "low_label": [int(labels.min())], "high_label": [int(labels.max())], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]}
            return pa.RecordBatch.from_pydict(one | {"ids": [rows["vec_id"].to_numpy().tobytes()], "labels": [labels.tobytes()], "vectors": [v.tobytes()], "width": pa.array([width], pa.int32())})

        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            while size >= node_rows:
                table = pa.Table.from_batches(held)
                yield chunk(table.slice(0, node_rows))
                seq, held, size = seq + 1, table.slice(node_rows).to_batches(), size - node_rows
        if size:
            yield chunk(pa.Table.from_batches(held))

    order = ["label", "cell", F.xxhash64("vec_id"), "vec_id"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "v")
    chunks = written(dealt.mapInArrow(pack, CHUNK), name)
    most, last, full = chunks.agg(F.max(F.col("seq").bitwiseAND((1 << CHUNK_BITS) - 1)), F.max("seq"), F.countDistinct(F.shiftright("seq", CHUNK_BITS))).first()
    if most is None:
        return Side(chunks, 0, [])
    # many small partitions make one lowest node, a large one several
    bits = 0 if most else CHUNK_BITS + max(0, int(np.log2(max(1.0, node_rows * full / n))))
    at, shifts = bits, []
    while last >> at:
        up = NODE_BITS if at >= CHUNK_BITS or most >> at else CHUNK_BITS - at
        shifts.append(up)
        at += up
    return Side(chunks, bits, shifts)


def _merged(nodes: pa.Table) -> pa.Table:
    """Nodes of one parent as one node: a ball about the balls, the labels and scores of all."""
    n = nodes["n"].to_numpy().astype(np.float64)
    centres = np.array(nodes["centre"].to_pylist(), dtype=np.float64).reshape(len(n), -1)
    centre = (centres * n[:, None]).sum(0) / n.sum()
    radius = float((np.sqrt(((centres - centre) ** 2).sum(1)) + nodes["radius"].to_numpy()).max())
    of = lambda c, f: f(nodes[c].to_numpy()).item()
    return pa.table({
        "node": [nodes["parent"][0].as_py()], "parent": [0], "n": [int(n.sum())], "low_label": [of("low_label", np.min)], "high_label": [of("high_label", np.max)],
        "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "low": [of("low", np.min)], "high": [of("high", np.max)],
    })


def _levels(side: Side, wanted: DataFrame | None = None) -> list[DataFrame]:
    """Tables of nodes from the lowest level up to the root. wanted: node, low, high of anchor nodes that look
    for something; the others are left out."""
    ends = [F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")]
    chunk = side.chunks.select(F.lit(0).cast("long").alias("node"), side.node().alias("parent"), F.col("n").cast("long").alias("n"), "low_label", "high_label", "centre", "radius", *ends)
    lowest = chunk.groupBy("parent").applyInArrow(_merged, NODE)
    if wanted is not None:
        lowest = lowest.drop("low", "high").join(wanted, "node")
    levels = [lowest]
    for shift in side.shifts:
        below = levels[-1].withColumn("parent", F.shiftright("node", shift))
        levels[-1] = below
        levels.append(below.groupBy("parent").applyInArrow(_merged, NODE))
    return [level.select(*[c.split()[0] for c in NODE.split(", ")]) for level in levels]


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _named(level: DataFrame, p: str) -> DataFrame:
    return level.select(*[F.col(c).alias(f"{p}_{c}") for c in level.columns])


def _opened(anchors: list[DataFrame], candidates: list[DataFrame], same: bool, nearest: int | None) -> DataFrame:
    """a_node, c_node: pairs of lowest nodes that may hold what is looked for. nearest: follow each anchor node
    to so many candidate nodes with the highest products of centres alone."""
    pairs = None
    for level in range(max(len(anchors), len(candidates)) - 1, -1, -1):
        a, c = _named(anchors[min(level, len(anchors) - 1)], "a"), _named(candidates[min(level, len(candidates) - 1)], "c")
        if pairs is None:
            pairs = a.crossJoin(F.broadcast(c))  # one root each
        else:
            # a side that has no lower level yet waits at its root
            for side, p, depth in ((a, "a", len(anchors)), (c, "c", len(candidates))):
                pairs = pairs.join(side, F.col(f"up_{p}") == (F.col(f"{p}_parent") if level < depth - 1 else F.col(f"{p}_node"))).drop(f"up_{p}")
        middle, norm = _dot("a_centre", "c_centre"), lambda p: F.sqrt(_dot(f"{p}_centre", f"{p}_centre"))
        spread = F.col("a_radius") * norm("c") + F.col("c_radius") * norm("a") + F.col("a_radius") * F.col("c_radius")
        pairs = pairs.withColumn("_middle", middle).withColumn("_spread", spread * (1 + 1e-9) + 1e-6 * (1 + F.abs("_middle")))
        reach = (F.col("_middle") + F.col("_spread") >= F.col("a_low")) & (F.col("_middle") - F.col("_spread") <= F.col("a_high"))
        one_label = (F.col("a_low_label") == F.col("a_high_label")) & (F.col("c_low_label") == F.col("c_high_label")) & (F.col("a_low_label") == F.col("c_low_label"))
        labels = (F.col("a_low_label") <= F.col("c_high_label")) & (F.col("c_low_label") <= F.col("a_high_label")) if same else ~one_label
        pairs = pairs.where(reach & labels)
        if nearest is not None:
            best = F.row_number().over(Window.partitionBy("a_node").orderBy(F.desc("_middle"), "c_node"))
            pairs = pairs.withColumn("_place", best).where(F.col("_place") <= nearest)
        pairs = pairs.select(F.col("a_node").alias("up_a"), F.col("c_node").alias("up_c"))
    return pairs.select(F.col("up_a").alias("a_node"), F.col("up_c").alias("c_node"))


class _Tree:
    """A balanced k-d tree over rows: rows in the order of its leaves, and the balls of each level's nodes."""

    def __init__(self, v: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order, edges = np.arange(len(v)), np.array([0, len(v)])
        self.levels = []
        while True:
            self.levels.append(edges)
            if np.diff(edges).max() <= leaf_rows:
                break
            middle = (edges[:-1] + edges[1:]) // 2
            for s, m, e in zip(edges[:-1], middle, edges[1:]):
                rows = v[self.order[s:e]]
                axis = int((rows.max(0) - rows.min(0)).argmax()) if rows.size else 0
                if rows.size:
                    self.order[s:e] = self.order[s:e][np.argpartition(rows[:, axis], m - s)]
            edges = np.sort(np.concatenate([edges, middle]))
        v = v[self.order]
        self.balls = []
        for edges in self.levels:
            balls = [_ball(v[s:e]) if e > s else (np.zeros(v.shape[1]), 0.0) for s, e in zip(edges[:-1], edges[1:])]
            self.balls.append((np.array([c for c, _ in balls]), np.array([r for _, r in balls])))


def _alive(anchors: _Tree, candidates: _Tree, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Leaf of anchors x leaf of candidates: whether the pair may hold a score from low to high, by anchor in the
    order of the leaves. Pairs of nodes are opened level by level; a node's end closes what is below."""
    alive = np.ones((1, 1), dtype=bool)
    for level in range(max(len(anchors.levels), len(candidates.levels))):
        i, j = min(level, len(anchors.levels) - 1), min(level, len(candidates.levels) - 1)
        alive = alive.repeat(2, 0) if level and i == level else alive
        alive = alive.repeat(2, 1) if level and j == level else alive
        (ca, ra), (cc, rc) = anchors.balls[i], candidates.balls[j]
        middle = ca @ cc.T
        spread = ra[:, None] * np.sqrt((cc * cc).sum(1)) + np.sqrt((ca * ca).sum(1))[:, None] * rc + ra[:, None] * rc
        spread = spread * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
        starts, sizes = anchors.levels[i][:-1], np.diff(anchors.levels[i])
        of = lambda f, x, none: np.where(sizes > 0, f.reduceat(np.append(x, none), starts), none)
        alive = alive & (middle + spread >= of(np.minimum, low, np.inf)[:, None]) & (middle - spread <= of(np.maximum, high, -np.inf)[:, None])
    return alive


class Block(NamedTuple):
    """Rows of some chunks."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(chunks: pa.Table) -> "Block":
        width = chunks["width"][0].as_py()
        whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in chunks[c]])
        ids = whole("ids", np.int64)
        return Block(ids, whole("labels", np.int64), whole("vectors", np.float64).reshape(len(ids), width))


def searched(anchors: Block, windows: dict[int, list[tuple[int, int, int]]], candidates: Block, k: int, same: bool) -> list[tuple[int, int, int, int]]:
    """(anchor_id, tag, other_id, score): for each anchor and each of its windows (tag, low, high) the k highest
    scores from low to high among candidates of the same label (other than itself), or of another one."""
    asks = np.array([i in windows for i in anchors.ids.tolist()], dtype=bool)
    anchors = Block(*[x[asks] for x in anchors])
    if not len(anchors.ids) or not len(candidates.ids):
        return []
    left, right = _Tree(anchors.v, ANCHOR_LEAF), _Tree(candidates.v)
    anchors, candidates = Block(*[x[left.order] for x in anchors]), Block(*[x[right.order] for x in candidates])
    asked = [windows[i] for i in anchors.ids.tolist()]
    low, high = np.array([min(w[1] for w in a) for a in asked], dtype=np.float64), np.array([max(w[2] for w in a) for a in asked], dtype=np.float64)
    alive = _alive(left, right, low, high)
    edges, leaf = left.levels[-1], np.repeat(np.arange(len(right.levels[-1]) - 1), np.diff(right.levels[-1]))
    out = []
    for at, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
        rows = np.flatnonzero(alive[at][leaf])
        if e == s or not len(rows):
            continue
        ids, scores = candidates.ids[rows], _products(anchors.v[s:e], candidates.v[rows])
        fits = (anchors.labels[s:e, None] == candidates.labels[rows]) == same
        if same:
            fits &= anchors.ids[s:e, None] != ids
        for one in range(s, e):
            mine = scores[one - s]
            bottom, top = min(w[1] for w in asked[one]), max(w[2] for w in asked[one])
            good = np.flatnonzero(fits[one - s] & (mine >= bottom) & (mine <= top))
            good = good[np.lexsort((ids[good], -mine[good]))]
            falling = -mine[good]
            for tag, a, b in asked[one]:
                first, last = np.searchsorted(falling, -b), np.searchsorted(falling, -a, side="right")
                for x in good[first : min(last, first + k)].tolist():
                    out.append((int(anchors.ids[one]), tag, int(ids[x]), int(mine[x])))
    return out


def _search(anchors: Side, candidates: Side, below: list[DataFrame], windows: DataFrame, k: int, same: bool, nearest: int | None) -> DataFrame:
    """FOUND rows: for windows (anchor, anchor_id, tag, low, high; anchor is the lowest node) the k best of each."""
    wanted = windows.groupBy(F.col("anchor").alias("node")).agg(F.min("low").cast("double").alias("low"), F.max("high").cast("double").alias("high"))
    # the pairs are read for either side, so the way to them is gone once
    pairs = written(_opened(_levels(anchors, wanted), below, same, nearest), "negatives-pairs")
    packs = ["ids", "labels", "vectors", "width"]
    asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("anchor_id", "tag", "low", "high")).alias("windows"))  # of the anchors of one node
    left = pairs.join(anchors.chunks.select(anchors.node().alias("a_node"), *packs), "a_node").join(asked.withColumnRenamed("anchor", "a_node"), "a_node")
    right = pairs.join(candidates.chunks.select(candidates.node().alias("c_node"), *packs), "c_node").select(F.col("a_node").alias("of_a"), F.col("c_node").alias("of_c"), *packs)

    def meet(key: tuple, a: pa.Table, c: pa.Table) -> pa.Table:
        node, found = key[0].as_py(), []
        if a.num_rows and c.num_rows:
            asked: dict[int, list[tuple[int, int, int]]] = {}
            for w in a["windows"][0].as_py():  # the same with each chunk of the node
                asked.setdefault(w["anchor_id"], []).append((w["tag"], w["low"], w["high"]))
            found = searched(Block.of(a), asked, Block.of(c), k, same)
        columns = list(zip(*found)) or [[]] * 4
        names = ("anchor_id", "tag", "other_id", "score")
        return pa.table({"anchor": pa.array([node] * len(found), pa.int64())} | {c: pa.array(x, pa.int64()) for c, x in zip(names, columns)})

    return left.groupBy("a_node", "c_node").cogroup(right.groupBy("of_a", "of_c")).applyInArrow(meet, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "anchor_id", "tag").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _two_searches(anchors: Side, candidates: Side, below: list[DataFrame], windows: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each window: near candidates first, whose k-th is a floor of the search of all others."""
    near = _best(_search(anchors, candidates, below, windows, k, same, NEAREST), k)
    floors = near.groupBy("anchor", "anchor_id", "tag").agg(F.when(F.count("*") >= k, F.min("score")).alias("_floor"))
    raised = windows.join(floors, ["anchor", "anchor_id", "tag"], "left").withColumn("low", F.greatest("low", F.coalesce("_floor", F.lit(NONE)))).drop("_floor")
    return _best(_search(anchors, candidates, below, written(raised, "negatives-floors"), k, same, None), k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (array of whole doubles). An anchor's positives are the rows of its label with the
    highest inner products, and for each of them the first negatives are the rows of other labels whose product
    is from low to high percent of the positive's."""
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("_row"))
    one = one.select("vec_id", "_row.label", "_row.v")
    width, cells = _fitted(one)
    candidates = _packed(_with_cells(one, width, cells), width, "negatives-candidates")
    anchors = _packed(_with_cells(one.where(is_anchor), width, cells), width, "negatives-anchors", ANCHOR_ROWS)
    below = [written(level, "negatives-nodes") for level in _levels(candidates)]

    ids = anchors.chunks.select(anchors.node().alias("anchor"), "ids").mapInArrow(_unpacked_ids, "anchor long, anchor_id long")
    any_score = ids.select("anchor", "anchor_id", F.lit(0).cast("long").alias("tag"), F.lit(NONE).alias("low"), F.lit(ALL).alias("high"))
    chosen = _two_searches(anchors, candidates, below, any_score, positives, same=True).where("score >= 0")  # below it no score fits
    chosen = written(chosen.select("anchor", "anchor_id", F.col("other_id").alias("tag"), F.col("score").alias("positive_score")), "negatives-positives")
    whole, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100
    windows = chosen.select("anchor", "anchor_id", "tag", (whole * low + F.ceil(rest * low / 100)).alias("low"), (whole * high + F.floor(rest * high / 100)).alias("high"))
    found = _two_searches(anchors, candidates, below, windows, negatives, same=False)
    named = found.select("anchor_id", F.col("tag").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    scores = chosen.select("anchor_id", F.col("tag").alias("positive_id"), "positive_score")
    return named.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _unpacked_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, packed in zip(batch["anchor"].to_pylist(), batch["ids"]):
            ids = np.frombuffer(packed.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([node] * len(ids), pa.int64()), "anchor_id": pa.array(ids)})
