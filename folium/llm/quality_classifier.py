"""Quality classifier: a linear support-vector machine on naive-Bayes features.

Features are indicators of token n-grams (one and two tokens; hashed into BUCKETS), each scaled by its
log-count ratio between the classes over all labelled training texts. Dual coordinate descent fits the
hinge loss on a sample of at most FIT_ROWS of them; up to CALIBRATION_ROWS others turn margins into
probabilities. A token is a run of letters, digits and bytes beyond ASCII, or a run of one other byte
class; a token that repeats the one before it also gives a feature of its own.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.storage import written
from folium.llm.words import BYTE_KEYS, LOWER, SPACE, U64, Stretches, document_of, flat, mix, sliced

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bounds of what is fitted on the driver: the rows whose hashed ids are smallest.
FIT_ROWS = 12_000
CALIBRATION_ROWS = 6_000
#: Bits of the filter of labelled ids (4 MB), whatever their number; where they fill it, it lets more pass.
FILTER_BITS = 1 << 25
#: A text's features are summed up from so many rows of counts a task.
PARTS = 16

_RUN = np.full(256, 2, dtype=np.uint8)
_RUN[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = 1
_RUN[SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising pairs (document, bucket) of the indicators that are set."""
    kind = _RUN[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    cut = np.flatnonzero(first)
    ends = np.append(cut[1:], len(data))
    filled = kind[cut] > 0
    starts, ends = cut[filled], ends[filled]
    document = np.searchsorted(offsets, starts, side="right") - 1
    hashes = Stretches(BYTE_KEYS[LOWER[data]]).of(starts, ends)
    together = document[1:] == document[:-1]
    pairs = mix(hashes[:-1] * U64(3) + mix(hashes[1:]))[together]
    again = document[1:][together & (hashes[1:] == hashes[:-1])]
    keys = [(document << BUCKET_BITS) | (hashes >> U64(64 - BUCKET_BITS)).astype(np.int64), (document[1:][together] << BUCKET_BITS) | (pairs >> U64(64 - BUCKET_BITS)).astype(np.int64), again << BUCKET_BITS]
    found = np.unique(np.concatenate(keys))
    return found >> BUCKET_BITS, found & (BUCKETS - 1)


@dataclass
class Classifier:
    """Weights by bucket: margin = (sum of weight) / sqrt(sum of square) + bias; score = 1 / (1 + exp(-(a * margin + b)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, document: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(document, weights=self.square[bucket], minlength=n))
        return np.bincount(document, weights=self.weight[bucket], minlength=n) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, document: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(document, bucket, n) + self.b, -50, 50)))


def _filter_places(column: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(salt), column), F.lit(FILTER_BITS)).cast("int") for salt in (1, 2)])


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column, eight bits a byte. The driver gets FILTER_BITS / 64 rows at most."""
    bits = ids.select(F.explode(_filter_places(column)).alias("bit"))
    word = F.shiftright("bit", 6)
    found = bits.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found["word"]] = found["bits"]
    return out.view(np.uint8)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label, buckets (rising 32-bit numbers) of every labelled text; others are dropped.

    A filter of fixed size keeps most texts without a label from being shuffled; the join decides."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    passing = docs.sparkSession.sparkContext.broadcast(id_filter(marks, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch["places"].flatten().to_numpy().reshape(-1, 2)
            passes = ((passing.value[place >> 3] >> (place & 7)) & 1).all(1)
            for part in sliced(batch.filter(pa.array(passes))):
                document, bucket = features(*flat(part["text"]))
                edges = np.searchsorted(document, np.arange(part.num_rows + 1))
                blobs = [bucket[s:e].astype(np.int32).tobytes() for s, e in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "buckets"])

    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _filter_places("doc_id").alias("places"))
    return chosen.mapInArrow(run, "doc_id long, buckets binary").join(marks, "doc_id").select("doc_id", "label", "buckets")


def class_counts(found: DataFrame) -> np.ndarray:
    """A (2, BUCKETS) array: how many labelled texts of each class set each bucket. Each task sends at
    most PARTS rows; the driver gets PARTS rows, 4 MB in all, whatever the input."""
    step = BUCKETS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for label, blob in zip(batch["label"].to_pylist(), batch["buckets"]):
                total[label, np.frombuffer(blob.as_py(), dtype=np.int32)] += 1
        blobs = [total[:, i * step : (i + 1) * step].tobytes() for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table["counts"])
        return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = found.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for row in rows:
        out[:, row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["counts"], dtype=np.int64).reshape(2, step)
    return out


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost * hinge loss. rows: (bucket, value)."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            bucket, value = rows[i]
            slope = y[i] * (w[bucket] @ value + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[bucket] += step * value
                bias += step
                moved, alpha[i] = max(moved, abs(step)), new
        if moved < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve through margins and labels, by Newton steps on smoothed targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        d, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([d @ margin, d.sum()])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", cost: float = 1.0, epochs: int = 20) -> Classifier:
    """The classifier of the labelled rows of docs. Labels other than 0 and 1 are left out; of several
    labels of one id the smallest counts. Without both classes every score is the smoothed base rate."""
    found = written(labelled_features(docs, labels, label), "classifier-features")
    counts = class_counts(found)
    sizes = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    constant = Classifier(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, math.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return constant
    p = 1 + counts.astype(np.float64)
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())

    draw = F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id"), 11) / float(1 << 53)
    fit_share = min(0.7, FIT_ROWS / (n0 + n1))
    all_share = min(1.0, fit_share + CALIBRATION_ROWS / (n0 + n1))
    # both bounds hold in the mean; the sample is a few 10 MB
    sample = found.withColumn("draw", draw).where(F.col("draw") < all_share).orderBy("doc_id").toPandas()
    rows = []
    for blob in sample["buckets"]:
        bucket = np.frombuffer(blob, dtype=np.int32)
        value = ratio[bucket]
        rows.append((bucket, value / max(np.sqrt(value @ value), 1e-9)))
    y, fitted = sample["label"].to_numpy(), (sample["draw"] < fit_share).to_numpy()
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        fitted = np.ones(len(y), dtype=bool)
    if len(set(y)) < 2:
        return constant
    own = [r for r, f in zip(rows, fitted) if f]
    sign = np.where(y[fitted] == 1, 1.0, -1.0)
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    w, bias = dual_coordinate_descent(own, sign, BUCKETS, cost * 0.5 / share, epochs)
    held = ~fitted if (~fitted).any() else fitted
    margin = np.array([w[b] @ v + bias for (b, v), h in zip(rows, held) if h])
    return Classifier(w * ratio, ratio * ratio, bias, *_platt(margin, y[held]))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of every row, from its whole text alone. A text without tokens gets the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                scores = shared.value.scores(*features(*flat(part["text"])), part.num_rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
