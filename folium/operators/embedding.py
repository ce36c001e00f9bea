"""A slot for embedders: chunks of new documents become vectors of length 1, document by document."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import text as text_functions

#: Texts in, one row of a matrix for each.
Embedder = Callable[[list[str]], np.ndarray]
SCHEMA = "model string, hash string, chunk_index int, embedding array<float>"


def letter_counts(size: int = 8) -> Embedder:
    """A stand-in for a model: how many characters have each remainder of their code point by size."""

    def embed(texts: list[str]) -> np.ndarray:
        points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) % size for t in texts]
        return np.stack([np.bincount(p, minlength=size) for p in points]).astype(np.float64) if texts else np.zeros((0, size))

    return embed


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row of zeros stays."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def worklist(texts: DataFrame, held: DataFrame, models: list[str]) -> DataFrame:
    """model, hash, text, chunks of the documents that a model has no vectors of."""
    rows = texts.select("hash", "text").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    todo = rows.join(held.select("model", "hash").distinct(), ["model", "hash"], "left_anti")
    return todo.withColumn("chunks", text_functions.chunk_count(F.col("text")))


def embedded(texts: DataFrame, held: DataFrame, embedders: dict[str, Embedder], batch: int = 64, recoveries: int = 2) -> DataFrame:
    """model, hash, chunk_index, embedding of all documents (hash, text) that a model lacks, all models in one pass.

    batch: chunks given to an embedder at once; where it runs out of memory the batch is halved, recoveries times.
    A document that still fails is left without any vector, and the next run finds it on the worklist again. A
    null or empty text has no chunks."""

    def encode(embed: Embedder, chunks: list[str]) -> np.ndarray | None:
        size = batch
        for _ in range(recoveries + 1):
            try:
                return unit(np.concatenate([embed(chunks[i : i + size]) for i in range(0, len(chunks), size)]))
            except MemoryError:
                size = max(1, size // 2)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for model, hash_, chunks in zip(*[rows[c] for c in ("model", "hash", "chunks")]):
                vectors = encode(embedders[model.as_py()], chunks.as_py())
                if vectors is not None and len(vectors):
                    n = len(vectors)
                    columns = [pa.array([model.as_py()] * n), pa.array([hash_.as_py()] * n), pa.array(np.arange(n), pa.int32()), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["model", "hash", "chunk_index", "embedding"])

    todo = worklist(texts, held, list(embedders)).where("chunks > 0").select("model", "hash", text_functions.chunks(F.col("text")).alias("chunks"))
    return todo.mapInArrow(run, SCHEMA)


def windows_embedded(windows: DataFrame, embed: Embedder) -> DataFrame:
    """windows (key, windows: array of texts) with vectors, one for each window, of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = [unit(embed(w)).tolist() if w else [] for w in rows["windows"].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["key"], pa.array(lists, pa.list_(pa.list_(pa.float64())))], names=["key", "vectors"])

    kind = windows.schema["key"].dataType.simpleString()
    return windows.select("key", "windows").mapInArrow(run, f"key {kind}, vectors array<array<double>>")
