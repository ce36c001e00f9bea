"""Near duplicates by MinHash bands, odd sketches and an exact check.

Texts with the same set of shingles form a class, and one text stands for it from there on. Its
MinHash samples give band keys; texts that share a key are candidates. Within a bucket every text is
first paired with the least one, so pairs stay in proportion to the texts. Buckets whose texts are then
still in different components are gathered into groups, and each task compares two blocks of a group:
it looks only at texts of different components, and gives only links that join two. Odd sketches (parity
bitmaps of the samples) drop pairs far below the limit; the rest is checked on the full sets.

With 40 bands of 6 samples a pair at similarity 0.85 shares no key with probability 3e-9 (0.8: 5e-6), and
one at 0.3 shares one with probability 0.03, so that texts of one template seldom make one large group.
A sketch drops a pair only if its estimate is SLACK below the limit, some 5 standard deviations.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.components import components
from folium.llm.storage import written
from folium.llm.words import BYTE_KEYS, LOWER, U64, Stretches, document_of, flat, give_back, mix, sliced, words

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SLACK = 0.2
#: Shingles in a block of a group, and texts in it at most, about.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 4096

_FACTORS = mix(np.arange(1001, 1001 + SAMPLES, dtype=U64)) | U64(1)
_SEEDS = mix(np.arange(5001, 5001 + SAMPLES, dtype=U64))
_POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in rising order within each document, and n + 1 offsets.

    A-Z are lower-cased. A document of fewer than k words has its whole sequence as its one shingle;
    one without words has none."""
    starts, ends, of_words = words(data, offsets)
    hashes = Stretches(BYTE_KEYS[LOWER[data]]).of(starts, ends)
    document = document_of(of_words)
    series = Stretches(hashes)
    grams = series.grams(k)
    inside = document[: len(grams)] == document[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    sizes = np.diff(of_words)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    found = np.concatenate([grams[inside], series.of(of_words[short], of_words[short + 1])])
    owner = np.concatenate([document[: len(grams)][inside], short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def minhash(found: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SAMPLES values for each document that has a shingle; the others get zeros."""
    out = np.zeros((len(edges) - 1, SAMPLES), dtype=U64)
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        for j in range(SAMPLES):
            out[filled, j] = np.minimum.reduceat(found * _FACTORS[j], edges[filled])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """One bitmap of SKETCH_BITS for each row: every sample flips the bit that it hashes to."""
    n = len(samples)
    bit = (mix(samples ^ _SEEDS) % U64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From the population count of the XOR of two rows of bitmaps; -1 where it is saturated."""
    odd = _POPCOUNT[a ^ b].sum(1)
    share = 1 - 2 * odd / SKETCH_BITS
    return np.where(share > 0, 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(share, 1e-9)), -1.0)


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.empty((len(samples), BANDS), dtype=U64)
    for band in range(BANDS):
        key = np.full(len(samples), band + 1, dtype=U64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + samples[:, j])
        out[:, band] = key
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_high, set_low (a 128-bit hash of the set), bands, sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found, edges = shingles(*flat(part["text"]), k)
                samples = minhash(found, edges)
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(found + U64(salt))))) for salt in (1, 2)]
                both = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(band_keys(samples).view(np.int64).ravel()))
                maps = pa.array([x.tobytes() for x in odd_sketches(samples)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(np.diff(edges)), *map(pa.array, both), keys, maps], names=["doc_id", "n_shingles", "set_high", "set_low", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>, sketch binary")


def _sketched(pairs: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """The pairs whose sketches do not rule them out."""
    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                maps = [np.frombuffer(b"".join(batch[f"sketch_{c}"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in "ab"]
                near = estimated_similarity(*maps) >= limit / 100 - SLACK
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles (sorted, 8 bytes each) of the rows whose doc_id is in wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found, edges = shingles(*flat(part["text"]), k)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array([found[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary())], names=["doc_id", "shingles"])

    chosen = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.mapInArrow(run, "doc_id long, shingles binary")


def _hashes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=U64)


def _confirmed(pairs: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """The pairs with 100 * intersection >= limit * union, on the full sets."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = _hashes(x.as_py()), _hashes(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * common >= limit * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near, pa.bool_()))
            give_back()

    return both.mapInArrow(run, "a long, b long")


def joining_links(block: np.ndarray, component: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], limit: int) -> list[tuple[int, int]]:
    """Rows of two blocks (or of one) whose sets are linked, one link for each two components that meet."""
    names = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, dtype=np.int64)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    maps = sketch.view(U64)
    across = block.min(initial=0) != block.max(initial=0)
    component = component.copy()
    marked = np.zeros(len(names) + 1, dtype=bool)
    links = []
    for one in range(len(sets)):
        rest = slice(one + 1, None)
        other = component[rest] != component[one]
        if across:
            other &= block[rest] != block[one]
        other &= 100 * np.minimum(size[rest], size[one]) >= limit * np.maximum(size[rest], size[one])
        at = np.flatnonzero(other) + one + 1
        if not len(at):
            continue
        odd = np.bitwise_count(maps[at] ^ maps[one]).sum(1, dtype=np.int64)
        share = 1 - 2 * odd / SKETCH_BITS
        at = at[1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(share, 1e-9)) >= limit / 100 - SLACK]
        if not len(at):
            continue
        own = names[start[one] : start[one + 1]]
        marked[own] = True
        place = np.repeat(start[at] - np.concatenate(([0], np.cumsum(size[at])[:-1])), size[at]) + np.arange(size[at].sum())
        common = np.add.reduceat(marked[names[place]].astype(np.int64), np.concatenate(([0], np.cumsum(size[at])[:-1])))
        marked[own] = False
        for two in at[100 * common >= limit * (size[at] + size[one] - common)]:
            if component[two] != component[one]:
                links.append((one, int(two)))
                component[component == component[two]] = component[one]
    return links


def _links_across(placed: DataFrame, sketches: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Links between texts that share a bucket (key, doc_id, component) and are of different components."""
    heads = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("head")).where("low < high")
    mixed = written(placed.join(heads.select("key", "head"), "key"), "mixed-buckets")
    groups = components(mixed, "doc_id", "head").withColumnsRenamed({"node": "doc_id", "component": "group"})
    sized = groups.join(sketches.select("doc_id", "n_shingles"), "doc_id").groupBy("group")
    counts = sized.agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = mixed.select("doc_id", "component").distinct().join(groups, "doc_id").join(counts, "group")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(sketches, "doc_id").join(sets, "doc_id").select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "component", "block", "sketch", "shingles")

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        maps = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        sets = [_hashes(x.as_py()) for x in table["shingles"]]
        found = np.array(joining_links(table["block"].to_numpy(), table["component"].to_numpy(), maps, sets, limit), dtype=np.int64).reshape(-1, 2)
        del sets, maps
        give_back()
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return rows.groupBy("group", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, limit: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents are linked if their sets of
    k-word shingles have a similarity of limit hundredths or more.

    component_id: the least doc_id that links reach, the own one included; kept: it is the own one.
    A text without words is linked with nothing. A row without doc_id is linked with nothing, has no
    component_id and is kept. Rows of one doc_id count as one document for links; each keeps its row."""
    found = written(signatures(docs, k), "signatures")
    linked = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = linked.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("class_id"))
    known = linked.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = known.select("doc_id", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(keyed.join(pivots, "key"), "shared-bands")  # rows of buckets with two texts or more
    sketches = known.select("doc_id", "n_shingles", "sketch")

    stars = shared.where("doc_id != pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = written(_sketched(stars, sketches, limit), "star-pairs")
    members = shared.select("doc_id").distinct()
    sets = written(full_sets(docs, members, k), "full-sets")
    links = written(_confirmed(pairs, sets, limit), "star-links")
    so_far = components(links)

    placed = shared.join(so_far.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    more = written(_links_across(placed, sketches, sets, limit), "links-across")
    reached = components(links.unionByName(more))

    of_class = classes.join(reached.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_high", "set_low", F.coalesce("component", "class_id").alias("component"))
    out = found.join(of_class, ["set_high", "set_low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
