"""Whitening of embeddings by a covariance that is worked out tile by tile.

Rows are cut into row-blocks and their dimensions into column blocks, which are shuffled by row-block. Where
the column blocks of a row-block meet, each pair of them is multiplied: a tile, keyed by the two numbers of
its dimensions' blocks. Tiles of a key are summed within a task, then across tasks in two steps, so that no
task takes a tile from every other. The driver gets the sums alone, dimensions x dimensions numbers however
many rows there are, assembles them and takes eigenvectors.

Whole numbers come in as longs; they are centred before they are multiplied. Rows with fewer dimensions than
the longest count as if filled up with a value that the caller names. Of no rows nothing comes out.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Rows of a row-block at most, dimensions of a column block.
BLOCK_ROWS = 1024
TILE = 32
#: Groups in which the tiles of a key are summed before they meet.
FIRST_SUMS = 32
#: Whole numbers stop at this size either way; an embedding's entries are nowhere near it.
LARGEST = 1 << 45
#: An eigenvalue that is smaller than the largest by this factor is no direction, but rounding.
NOTHING = 1e-13


def grid(embedding: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry c, c as double."""
    x = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return F.transform(embedding, lambda c: x(c) + 100_000)


def matrix(column: pa.ListArray, width: int, fill: float) -> np.ndarray:
    """The lists as rows of width, in the type of their values."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.full((len(column), width), fill, dtype=values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


@dataclass(frozen=True)
class Sums:
    """Rows, dimensions, the sum of each dimension (whole numbers stay exact), and what short rows are filled with."""

    n: int
    totals: list
    fill: float

    @property
    def width(self) -> int:
        return len(self.totals)

    @property
    def means(self) -> np.ndarray:
        return np.array([t / self.n for t in self.totals])


def sums(rows: DataFrame, column: str, fill: float = 0) -> Sums:
    """Of an array column: one partial sum for each task, and theirs by dimension."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    whole = rows.schema[column].dataType.elementType.typeName() != "double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for s in range(0, len(batch), BLOCK_ROWS):
                part = matrix(batch.column(0).slice(s, BLOCK_ROWS), width, fill).sum(0)
                total = [a + (int(b) if whole else float(b)) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_pylist([{"at": i, "total": str(t)} for i, t in enumerate(total)], pa.schema([("at", pa.int32()), ("total", pa.string())]))

    if not n or not width:
        return Sums(n, [], fill)
    parts = rows.select(column).mapInArrow(add, "at int, total string")
    added = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)" if whole else "double")).alias("total")).orderBy("at").collect()
    return Sums(n, [(int if whole else float)(r["total"]) for r in added], fill)


def _column_blocks(rows: DataFrame, column: str, of: Sums) -> DataFrame:
    """block, at, data: the column blocks of each row-block, as doubles less their means."""
    width, fill, means, tile = of.width, of.fill, of.means, TILE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for s in range(0, len(batch), BLOCK_ROWS):
                x = matrix(batch.column(0).slice(s, BLOCK_ROWS), width, fill) - means
                for at in range(0, width, tile):
                    data = np.ascontiguousarray(x[:, at : at + tile]).tobytes()
                    yield pa.RecordBatch.from_pydict({"block": [block], "at": pa.array([at // tile], pa.int32()), "data": [data]})
                block += 1

    return rows.select(column).mapInArrow(cut, "block long, at int, data binary")


def _tiles(blocks: DataFrame, width: int) -> DataFrame:
    """a, b, part, data: products of column blocks a <= b, summed over the row-blocks of a task."""
    sizes = [min(TILE, width - at) for at in range(0, width, TILE)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        block, held = None, []

        def add() -> None:
            for a, x in held:
                for b, y in held:
                    if a <= b:
                        found[a, b] = found.get((a, b), 0.0) + x.T @ y

        for batch in batches:
            for number, at, data in zip(batch["block"].to_pylist(), batch["at"].to_pylist(), batch["data"]):
                if number != block:
                    add()
                    block, held = number, []
                held.append((at, np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(-1, sizes[at])))
        add()
        part = TaskContext.get().partitionId() % FIRST_SUMS
        for (a, b), tile in found.items():
            yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "data": [tile.tobytes()]})

    return blocks.repartition("block").sortWithinPartitions("block", "at").mapInArrow(multiply, "a int, b int, part int, data binary")


def _added(tiles: DataFrame, *key: str) -> DataFrame:
    """One tile for each key, a stream of them held one at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, total = None, None

        def out() -> pa.RecordBatch:
            a, b, part = one
            return pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "data": [total.tobytes()]})

        for batch in batches:
            for a, b, part, data in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["part"].to_pylist(), batch["data"]):
                now, tile = (a, b, part if "part" in key else 0), np.frombuffer(data.as_buffer(), dtype=np.float64)
                if now == one:
                    total = total + tile
                else:
                    if one is not None:
                        yield out()
                    one, total = now, tile
        if one is not None:
            yield out()

    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(add, "a int, b int, part int, data binary")


def covariance(rows: DataFrame, column: str, of: Sums) -> np.ndarray:
    """The covariance of an array column, with divisor n, from tiles."""
    out = np.zeros((of.width, of.width))
    if not of.width:
        return out
    tiles = _added(_added(_tiles(_column_blocks(rows, column, of), of.width), "a", "b", "part"), "a", "b")
    for r in tiles.collect():  # dimensions x dimensions numbers
        i, j = r["a"] * TILE, r["b"] * TILE
        tile = np.frombuffer(bytes(r["data"])).reshape(min(TILE, of.width - i), -1)
        out[i : i + TILE, j : j + TILE] = tile
        out[j : j + TILE, i : i + TILE] = tile.T
    return out / of.n


@dataclass(frozen=True)
class Whitening:
    """Sums, and unit eigenvectors (columns) with their eigenvalues by falling eigenvalue."""

    sums: Sums
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total > 0 else np.zeros(len(self.values))

    def matrix(self, most: int) -> np.ndarray:
        """What centred rows are multiplied with; a direction without variance gives 0."""
        some = self.values > NOTHING * self.values.max(initial=0.0)
        return (self.vectors * np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0))[:, :most]


def fit(rows: DataFrame, column: str, fill: float = 0) -> Whitening:
    """The whitening of an array column over all rows."""
    of = sums(rows, column, fill)
    if not of.width:
        return Whitening(of, np.zeros(0), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(covariance(rows, column, of))
    order = np.argsort(-values, kind="stable")
    return Whitening(of, np.maximum(values[order], 0.0), vectors[:, order])


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - total)^2 for each row of whole numbers; null beyond a long."""
    largest = max([n * abs(int(m)) + abs(t) for m, t in zip(np.abs(x).max(0, initial=0), totals)], default=0)
    if largest * largest * max(1, len(totals)) < 1 << 63:
        d = n * x - np.array(totals, dtype=np.int64)
        return (d * d).sum(1).tolist()
    spread = n * x.astype(object) - np.array(totals, dtype=object)
    return [s if s < 1 << 63 else None for s in (spread * spread).sum(1).tolist()]


def whiten(rows: DataFrame, column: str, model: Whitening, most: int = 8) -> DataFrame:
    """rows with whitened, an array of at most most components, and deviation, a long: the sum over
    dimensions of (n * x - total)^2. rows' column holds whole numbers; columns of these names are replaced."""
    rows = rows.drop(*[c for c in ("whitened", "deviation") if c != column])
    means, by, n, totals, width, fill = model.sums.means, model.matrix(most), model.sums.n, model.sums.totals, model.sums.width, model.sums.fill

    at = rows.columns.index(column)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                x = matrix(part.column(at), width, fill)
                done = pa.array(list((x - means) @ by), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, done, pa.array(deviations(x, n, totals), pa.int64())], names=[*part.schema.names, "whitened", "deviation"])

    schema = StructType([*rows.schema, StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    rows = rows if width else rows.limit(0)
    return rows.mapInArrow(project, schema)


def identity_error(white: DataFrame, model: Whitening, most: int = 8) -> float:
    """The largest entry, without sign, of the covariance of whitened less the identity."""
    k = min(most, model.sums.width)
    if not k:
        return 0.0
    return float(np.abs(covariance(white, "whitened", sums(white, "whitened")) - np.eye(k)).max())
