"""Stretches of text that may hold a repeated window, brought together by shard.

Windows are so many consecutive units (bytes, or words) of one document. Of the k-grams of a window the
least by hash is its anchor, so equal windows have equal anchors at the same place. The least document
that holds an anchor is the anchor's home. A document sends, for each home, the stretches around its
anchors of that home; so all occurrences of a window that occurs twice meet in the shard of one home.
Documents without repeated anchors send nothing, and every text is shuffled once. Of the stretches of a
home with one body only the earliest is searched: every window of another one starts earlier there, so
that one is removed whole.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.storage import written
from folium.llm.words import BYTE_KEYS, U64, Stretches, document_of, flat, give_back, sliced, word_hashes, words

#: About so many units of stretches for each shard.
SHARD_UNITS = {"bytes": 2 << 20, "words": 1 << 19}
#: Texts are worked on in slices of about so many bytes: each byte takes some 100 bytes of arrays here, none of which
#: may reach OWN_MEMORY (slices of 1 << 18 bytes took 4 to 6 times as long, for the pages of their arrays).
SLICE = 1 << 16

#: Given the bodies of stretches, their documents and first units: document, start, end of removed ranges.
Finder = Callable[[Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def units(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each unit, and n + 1 offsets of the documents' units."""
    data, offsets = flat(texts)
    if unit == "bytes":
        return BYTE_KEYS[data], offsets
    starts, ends, of_words = words(data, offsets)
    return word_hashes(data, starts, ends), of_words


def places(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, n + 1 offsets of the documents' units, and each unit's first and last byte + 1."""
    data, offsets = flat(texts)
    if unit == "bytes":
        at = np.arange(len(data) + 1)
        return data, offsets, at[:-1], at[1:]
    starts, ends, of_words = words(data, offsets)
    return data, of_words, starts, ends


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows, and the hashes of their k-grams."""
    grams = Stretches(values).grams(k)
    n, span = len(values) - window + 1, window - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    bits = U64(max(24, int(len(grams)).bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U64)  # ties go to the first
    done = 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    document = document_of(offsets)
    inside = document[:n] == document[window - 1 :]
    at = (least[:n][inside] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    return at[new], grams[at[new]]


def _anchor_rows(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                values, offsets = units(part["text"], unit)
                at, grams = anchors(values, offsets, window, k)
                document = np.searchsorted(offsets, at, side="right") - 1
                ids = part["doc_id"].to_numpy(zero_copy_only=False)[document]
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(ids, pa.int64()), pa.array(at - offsets[document], pa.int32())], names=["gram", "doc_id", "at"])

    return docs.mapInArrow(run, "gram long, doc_id long, at int")


def _stretches(docs: DataFrame, homes: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """home, doc_id, start and n (in units), body of every stretch. The body is null, and the home is the
    document's own, if the task has had the same stretch of an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[int, tuple[int, int]] = {}  # place of a stretch by the hash of its home and body
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                data, offsets, first, last = places(part["text"], unit)
                lists = part["anchors"]
                at_home = lists.flatten()
                at, home = at_home.field("at").to_numpy().astype(np.int64), at_home.field("home").to_numpy()
                document = document_of(lists.offsets.to_numpy() - lists.offsets[0].as_py())
                order = np.lexsort((at, home, document))
                at, home, document = at[order], home[order], document[order]
                size = np.diff(offsets)[document]
                low, high = np.maximum(at - (window - k), 0), np.minimum(at + window, size)
                new = np.ones(len(at), dtype=bool)
                new[1:] = (document[1:] != document[:-1]) | (home[1:] != home[:-1]) | (low[1:] > high[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
                low, high, document, home = low[begin], high[end], document[begin], home[begin]
                long = high - low >= window
                low, high, document, home = low[long], high[long], document[long], home[long]
                shift = offsets[document]
                bodies = [data[s:e].tobytes() for s, e in zip(first[shift + low], last[shift + high - 1])] if len(low) else []
                ids = part["doc_id"].to_numpy(zero_copy_only=False)[document]
                for i, place in enumerate(zip(ids.tolist(), low.tolist())):
                    key = hash((int(home[i]), bodies[i]))
                    if earliest.setdefault(key, place) < place:
                        bodies[i] = None
                    else:
                        earliest[key] = place
                home = np.where([b is None for b in bodies], ids, home) if len(bodies) else home
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (home, ids, low, high - low)], pa.array(bodies, pa.binary())], names=["home", "doc_id", "start", "n", "body"])

    return docs.join(homes, "doc_id").mapInArrow(run, "home long, doc_id long, start long, n long, body binary")


def _searched_once(stretches: DataFrame) -> DataFrame:
    """The same over all tasks, which send one another a copy of each stretch at most, or few."""
    copy = F.expr("row_number() over (partition by home, n, xxhash64(body) order by doc_id, start)")
    first = F.col("_copy") == 1
    return stretches.withColumn("_copy", copy).select(F.when(first, F.col("home")).otherwise(F.col("doc_id")).alias("home"), "doc_id", "start", "n", F.when(first, F.col("body")).alias("body"))


def merged(document: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that touch or overlap in one document become one."""
    if not len(start):
        return document, start, end
    order = np.lexsort((start, document))
    document, start, end = document[order], start[order], end[order]
    base = np.cumsum(np.concatenate(([0], document[1:] != document[:-1]))) * (int(end.max()) + 2)
    top = np.maximum.accumulate(end + base)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] + base[1:] > top[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    return document[begin], start[begin], (top - base)[last]


def with_removed_ranges(docs: DataFrame, unit: str, window: int, k: int, find: Finder) -> DataFrame:
    """docs with ranges, an array of (start, end) in units: what windows cover that start earlier too.

    Earlier: in a smaller doc_id, or at a smaller place of the same document. Rows of one doc_id and
    text count as one document; of one doc_id with other texts, as documents in the order of the texts'
    hashes; rows without doc_id come last, in that order too. The other columns may be any."""
    docs = docs.withColumn("_text_key", F.xxhash64("text"))
    sums = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    unique = sums[0] == sums[1]  # so no null and no id twice
    if unique:
        order = docs.withColumn("_order", F.col("doc_id"))
    else:
        ranked = docs.select("doc_id", "_text_key").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_text_key")
        ranked = written(ranked.withColumn("_order", F.monotonically_increasing_id()), "document-order").withColumnsRenamed({"doc_id": "_d", "_text_key": "_t"})
        order = docs.join(ranked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_t"))).drop("_d", "_t")
    order = order.drop("_text_key")
    plain = order.select(F.col("_order").alias("doc_id"), "text")
    once = plain if unique else plain.dropDuplicates(["doc_id"])

    # gram by gram: the least document, and whether there is another occurrence
    found = _anchor_rows(once, unit, window, k)
    marks = found.selectExpr("doc_id", "at", "min(doc_id) over (partition by gram) as home", "count(*) over (partition by gram) as n").where("n > 1")
    homes = written(marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "home")).alias("anchors")), "repeated-anchors")
    n_units = (homes.agg(F.sum(F.size("anchors"))).first()[0] or 0) * (window - k + 2) // 2
    shards = max(1, -(-n_units // SHARD_UNITS[unit]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = [np.zeros((3, 0), dtype=np.int64)]

        def rows() -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
            for b in batches:
                whole = b.filter(b["body"].is_null())
                place, n = (whole["doc_id"].to_numpy(), whole["start"].to_numpy()), whole["n"].to_numpy()
                copies.append(np.stack([*place, place[1] + n]))
                for part in sliced(b.filter(b["body"].is_valid()), "body", SLICE):
                    yield part["doc_id"].to_numpy(), part["start"].to_numpy(), part["body"].to_pylist()

        found = np.stack(find(rows()))
        document, start, end = merged(*np.concatenate([found, *copies], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (document, start, end)], names=["doc_id", "start", "end"])
        give_back()

    stretches = _searched_once(_stretches(once, homes, unit, window, k)).repartition(shards, "home")
    ranges = stretches.mapInArrow(run, "doc_id long, start long, end long")
    of_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return order.join(of_doc.withColumnRenamed("doc_id", "_order"), "_order", "left").drop("_order")


def range_arrays(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end of the merged ranges of a batch's lists; a null list has none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    rows, pairs = np.repeat(np.arange(len(lists)), sizes), lists.flatten()
    return merged(rows, pairs.field("start").to_numpy(), pairs.field("end").to_numpy())
