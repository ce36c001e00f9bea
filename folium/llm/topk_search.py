"""Exact top-k search by inner product over buckets of vectors of like length.

Vectors are dealt by falling length and packed into buckets, neighbours of which share a shelf. A first pass over
the shelf of the longest vectors gives every query a score that its k-th result cannot be below. Chunks of
queries and shelves are paired by a table of lengths alone: only where a query of the chunk can reach its floor
with the shelf's longest vector do their rows meet. There, bucket by bucket, the floor over the lengths of the
query and of the bucket's longest vector is a local cosine threshold: above 1 the bucket is passed over; if
high, candidates must lie within a range in the query's largest coordinate; otherwise only those long enough
remain. Products of the candidates are then verified, and the floors rise with what is found.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.storage import written

#: Vectors in a bucket, about so many on a shelf, and queries in a chunk.
BUCKET_ROWS = 256
SHELF_ROWS = 4096
QUERY_ROWS = 2048
#: Partitions that vectors are dealt to at most; longer ones hold more buckets.
MOST_PARTITIONS = 4096
#: Bits of a bucket's number within its partition.
BUCKET_BITS = 20
#: From this local cosine on, one coordinate prunes better than the length.
COORDINATE_FROM = 0.75
BUCKET = "seq long, n int, longest double, ids binary, vectors binary, width int"
RESULT = "query_id long, vec_id long, score long"


def grid(embedding: Column) -> Column:
    """floor(256 * x) of each component x, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(embedding: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to width."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    if len(lists):
        out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers; beyond them they stop at the largest or smallest."""
    bound = np.sqrt((q * q).sum(1).max(initial=0.0)) * np.sqrt((v * v).sum(1).max(initial=0.0))
    if bound < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Rows(NamedTuple):
    """Ids, vectors and lengths."""

    ids: np.ndarray
    v: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, v: np.ndarray) -> "Rows":
        return Rows(ids, v, np.sqrt((v * v).sum(1)))


class Best:
    """The k best so far of each query, and its floor: what a result cannot be below. Counts what was multiplied."""

    def __init__(self, queries: Rows, floor: np.ndarray, k: int):
        self.queries, self.floor, self.k, self.multiplied = queries, floor.copy(), k, 0
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)

    def keep(self, one: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = (score >= self.floor[one]) & (ids != self.queries.ids[one])
        if not good.any():
            return
        ids, score = np.append(self.found[one][0], ids[good]), np.append(self.found[one][1], score[good])
        if len(ids) > self.k:
            top = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]  # with all ties
            ids, score = ids[top], score[top]
        best = np.lexsort((ids, -score))[: self.k]
        self.found[one] = ids[best], score[best]
        if len(best) == self.k:
            self.floor[one] = max(self.floor[one], float(score[best[-1]]))

    def meet(self, bucket: Rows) -> None:
        """What a bucket has for each query, pruned by its local threshold."""
        if not len(bucket.ids) or not len(self.queries.ids):
            return
        q, v, longest = self.queries.v, bucket.v, bucket.length.max()
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.queries.length * longest > 0, self.floor / (self.queries.length * longest), np.where(self.floor > 0, 2.0, -2.0)) - 1e-9
        unit = v / np.maximum(bucket.length, 1e-300)[:, None]
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for one in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1)):
            axis = int(np.abs(q[one]).argmax())
            if axis not in sorted_by:
                rank = np.argsort(unit[:, axis])
                sorted_by[axis] = rank, unit[rank, axis]
            rank, values = sorted_by[axis]
            x, c = q[one, axis] / self.queries.length[one], cosine[one]
            room = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-9
            # a vector of this cosine or more with the query lies this near to it in the coordinate
            low, high = x * c - room if -c < x else -1.0, x * c + room if x < c else 1.0
            at = rank[np.searchsorted(values, low) : np.searchsorted(values, high, side="right")]
            at = at[bucket.length[at] * self.queries.length[one] >= self.floor[one] - 1e-6 * abs(self.floor[one])]
            if len(at):
                self.multiplied += len(at)
                self.keep(one, bucket.ids[at], _products(q[one : one + 1], v[at])[0])
        rest = np.flatnonzero(cosine < COORDINATE_FROM)
        if len(rest):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((self.floor[rest] > 0) & (self.queries.length[rest] > 0), self.floor[rest] / self.queries.length[rest] * (1 - 1e-9), 0.0).min()
            at = np.flatnonzero(bucket.length >= shortest)
            self.multiplied += len(rest) * len(at)
            for one, score in zip(rest, _products(q[rest], v[at])):
                self.keep(one, bucket.ids[at], score)

    def table(self) -> pa.Table:
        n = [len(ids) for ids, _ in self.found]
        whole = lambda i: np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(np.repeat(self.queries.ids, n), pa.int64()), "vec_id": pa.array(whole(0), pa.int64()), "score": pa.array(whole(1), pa.int64())})


class Shelves(NamedTuple):
    """Buckets, and the bits of their numbers that a shelf shares."""

    buckets: DataFrame
    bits: int

    def shelf(self) -> Column:
        return F.shiftright("seq", self.bits)


def _shelved(vectors: DataFrame, width: int) -> Shelves:
    """vectors (vec_id, v) by falling length as buckets, written; equal lengths are split by id."""
    n = vectors.count()
    parts = max(1, min(MOST_PARTITIONS, -(-n // SHELF_ROWS)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, size = TaskContext.get().partitionId() << BUCKET_BITS, [], 0

        def bucket(rows: pa.Table) -> pa.RecordBatch:
            v = _matrix(rows["v"], width)
            longest = float(np.sqrt((v * v).sum(1)).max())
            return pa.RecordBatch.from_pydict({"seq": [seq], "n": pa.array([len(v)], pa.int32()), "longest": [longest], "ids": [rows["vec_id"].to_numpy().tobytes()], "vectors": [v.tobytes()], "width": pa.array([width], pa.int32())})

        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            while size >= BUCKET_ROWS:
                table = pa.Table.from_batches(held)
                yield bucket(table.slice(0, BUCKET_ROWS))
                seq, held, size = seq + 1, table.slice(BUCKET_ROWS).to_batches(), size - BUCKET_ROWS
        if size:
            yield bucket(pa.Table.from_batches(held))

    order = [F.desc("length"), F.xxhash64("vec_id"), F.col("vec_id")]
    measured = vectors.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    dealt = measured.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "v")
    buckets = written(dealt.mapInArrow(pack, BUCKET), "topk-buckets")
    full = buckets.agg(F.countDistinct(F.shiftright("seq", BUCKET_BITS))).first()[0]
    per_part = n / max(1, full)
    # some buckets of a long partition, or some short partitions, make a shelf
    bits = int(np.log2(SHELF_ROWS / BUCKET_ROWS)) if per_part > SHELF_ROWS else BUCKET_BITS + int(np.log2(max(1.0, SHELF_ROWS / max(1.0, per_part))))
    return Shelves(buckets, bits)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    vectors: vec_id, v (array of whole doubles); other columns are dropped. Rows without vec_id take no part, nor
    does a row with the query's own id; of rows that repeat an id and vector one counts. Shorter vectors count as
    padded with zeros. An empty table, or one without queries, gives no rows."""
    vectors = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v").dropDuplicates()
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    shelves = _shelved(vectors, width)
    asked = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_chunks = max(1, -(-asked.count() // QUERY_ROWS))
    queries = written(asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_chunks)).cast("int")), "topk-queries")
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    longest = shelves.buckets.groupBy(shelves.shelf().alias("shelf")).agg(F.max("longest").alias("longest"))
    first = longest.agg(F.min("shelf").alias("shelf"))  # of the longest vectors

    def run(key: tuple, q: pa.Table, buckets: pa.Table) -> pa.Table:
        rows = Rows.of(q["query_id"].to_numpy(), _matrix(q["q"], width))
        best = Best(rows, q["floor"].to_numpy(zero_copy_only=False) if len(q) else np.zeros(0), k)
        if len(q):
            for at in np.argsort(-buckets["longest"].to_numpy(), kind="stable"):
                ids, packed = (np.frombuffer(buckets[c][at].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("vectors", np.float64)))
                best.meet(Rows.of(ids, packed.reshape(len(ids), width)))
        return best.table()

    def meet(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        left = asked.join(pairs, "chunk").select("chunk", "shelf", "query_id", "q", "floor")
        right = pairs.join(shelves.buckets.withColumn("shelf", shelves.shelf()), "shelf").select(F.col("chunk").alias("of_chunk"), F.col("shelf").alias("of_shelf"), "longest", "ids", "vectors")
        return left.groupBy("chunk", "shelf").cogroup(right.groupBy("of_chunk", "of_shelf")).applyInArrow(run, RESULT)

    chunks = queries.groupBy("chunk").agg(F.max(length).alias("reach"))
    seeds = written(meet(queries.withColumn("floor", F.lit(float("-inf"))), chunks.select("chunk").crossJoin(F.broadcast(first))), "topk-seeds")  # one shelf
    floors = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("_floor"))
    raised = written(queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("_floor", F.lit(float("-inf")))).drop("_floor"), "topk-floors")
    # what a query's floor asks of a shelf, at least over its chunk, against the shelf's longest vector
    asks = raised.groupBy("chunk").agg(F.min(F.when((length > 0) & (F.col("floor") > 0), F.col("floor") / length * (1 - 1e-9)).when(F.col("floor") > 0, float("inf")).otherwise(0.0)).alias("least"))
    others = longest.join(F.broadcast(first.withColumnRenamed("shelf", "_first")), F.col("shelf") != F.col("_first")).select("shelf", F.col("longest").alias("_longest"))
    pairs = written(asks.join(others, F.col("_longest") >= F.col("least")).select("chunk", "shelf"), "topk-pairs")
    found = seeds.unionByName(meet(raised, pairs))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
