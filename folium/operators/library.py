"""Library operators: joins of files, texts, metadata and caches; inventories; snapshots of a sync."""

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from folium.functions import keys as key_language
from folium.functions import text as text_functions


def first_claims(files: DataFrame, hash_: str = "hash", order: str = "ord") -> DataFrame:
    """files with claim: 1 for the first file of a content, 2 and on for its copies."""
    return files.withColumn("claim", F.row_number().over(Window.partitionBy(hash_).orderBy(order)))


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left without a partner: worklists, debris, orphans."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def present(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_semi")


def keyword_search(metadata: DataFrame, library: DataFrame, query: str, source: str | None = None) -> DataFrame:
    """descriptor, hash, summary of the entries whose title, authors, tags, description and context meet all
    keys, and whose first representation with a hash is in the library. An empty query finds nothing."""
    keys = query.split()
    if not keys:
        return metadata.select("descriptor", F.lit("").alias("hash"), F.lit("").alias("summary")).limit(0)
    blob = F.concat_ws(" ", "title", F.concat_ws(" ", "authors"), F.concat_ws(" ", "tags"), "description", "context")
    found = metadata.where(key_language.matches(blob, keys))
    if source is not None:
        found = found.where(F.lower(text_functions.descriptor_source(F.col("descriptor"))) == source.lower())
    hash_ = F.get(F.filter("representations", lambda r: r["hash"] != ""), F.lit(0))["hash"]
    summary = F.concat(F.substring("description", 1, 200), F.lit("..."))
    held = found.select("descriptor", hash_.alias("hash"), summary.alias("summary"))
    return held.join(library.select("hash"), "hash", "left_semi").select("descriptor", "hash", "summary")


def with_metadata(items: DataFrame, metadata: DataFrame, *columns: str) -> DataFrame:
    """items with columns of the metadata of their descriptor, or else of its directory."""
    one = metadata.groupBy("descriptor").agg(F.min(F.struct(*columns)).alias("_own"))  # a descriptor may stand there twice
    own, parent = one, one.withColumnsRenamed({"descriptor": "_dir", "_own": "_parent"})
    both = items.withColumn("_dir", text_functions.directory(F.col("descriptor"))).join(own, "descriptor", "left").join(parent, "_dir", "left")
    picked = F.coalesce("_own", "_parent")
    return both.select(*items.columns, *[picked[c].alias(c) for c in columns])


def source_extensions(files: DataFrame) -> DataFrame:
    """source, ext, n with the sums of each source, each extension and all (null where summed over)."""
    return files.cube("source", "ext").agg(F.count("*").alias("n"))


def reconcile(local: DataFrame, target: DataFrame) -> DataFrame:
    """rel_path, action of every file on either side (rel_path, size, modified): copy what is new, update
    what differs in size or is newer, delete what is gone, else keep."""
    a = local.select("rel_path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    b = target.select("rel_path", F.col("size").alias("_t_size"), F.col("modified").alias("_t_modified"))
    differs = (F.col("_size") != F.col("_t_size")) | (F.col("_modified") > F.col("_t_modified"))
    action = F.when(F.col("_t_size").isNull(), "copy").when(F.col("_size").isNull(), "delete").when(differs, "update").otherwise("keep")
    return a.join(b, "rel_path", "full_outer").select("rel_path", action.alias("action"))


def sync_actions(files: DataFrame, library: DataFrame) -> DataFrame:
    """hash, descriptor, action: insert a new content, duplicate of one, unchanged, debris in the library."""
    ranked = first_claims(files)
    held = library.select("hash", F.col("descriptor").alias("_held"))
    both = ranked.join(held, "hash", "full_outer")
    action = F.when(F.col("descriptor").isNull(), "debris").when(F.col("claim") > 1, "duplicate").when(F.col("_held").isNull(), "insert").otherwise("unchanged")
    return both.select("hash", F.coalesce("descriptor", "_held").alias("descriptor"), action.alias("action"))


def synced(files: DataFrame, library: DataFrame) -> DataFrame:
    """The library after a sync: what it holds of the files, and the first file of each new content."""
    columns = ["hash", "source_name", "descriptor", "text"]
    kept = present(library, files, "hash").select(*columns)
    # who is first is found out without texts, and the texts of those alone are fetched
    order = F.min(F.struct("ord", "descriptor")).alias("_first")
    firsts = missing(files.select("hash", "ord", "descriptor"), library, "hash").groupBy("hash").agg(order).select("hash", "_first.*")
    new = files.join(firsts, ["hash", "ord", "descriptor"], "left_semi").dropDuplicates(["hash"]).select(*columns)
    return kept.unionByName(new)


def metadata_actions(notes: DataFrame, metadata: DataFrame) -> DataFrame:
    """descriptor, action (new, changed, unchanged, orphan) by the hash of the note."""
    a, b = notes.select("descriptor", F.col("hash").alias("_now")), metadata.select("descriptor", F.col("hash").alias("_was"))
    action = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "orphan").when(F.col("_now") != F.col("_was"), "changed").otherwise("unchanged")
    return a.join(b, "descriptor", "full_outer").select("descriptor", action.alias("action"))


def update_required(local: Column, remote: Column) -> Column:
    """Whether a shared snapshot must be fetched: it is newer, or was never numbered."""
    return (remote > local) | (remote == 0)


def without_shadowed_pdfs(files: DataFrame) -> DataFrame:
    """Files (dir, base, ext) but for PDFs that have a text of the same name beside them."""
    texts = files.where(F.col("ext").isin("txt", "md", "org")).select("dir", "base", F.lit("pdf").alias("ext")).distinct()
    return files.join(texts, ["dir", "base", "ext"], "left_anti")


def cache_report(cache: DataFrame, library: DataFrame) -> DataFrame:
    """entries, failures, orphans (of no text in the library) of a cache (hash, previous_failure)."""
    marked = cache.join(library.select("hash", F.lit(True).alias("_held")).distinct(), "hash", "left")
    return marked.agg(F.count("*").alias("entries"), F.count_if("previous_failure").alias("failures"), F.count_if(F.col("_held").isNull()).alias("orphans"))


def cache_statistics(cache: DataFrame, library: DataFrame, files: DataFrame) -> DataFrame:
    """entries, failures, orphans (of no text in the library), missing (texts without an entry), deleted (entries
    whose cached file is gone) of a cache (hash, previous_failure)."""
    held, there = library.select("hash", F.lit(1).alias("_held")).distinct(), files.select("hash", F.lit(1).alias("_file")).distinct()
    both = cache.withColumn("_entry", F.lit(1)).join(held, "hash", "full_outer").join(there, "hash", "left")
    entry = F.col("_entry").isNotNull()
    return both.agg(F.count("_entry").alias("entries"), F.count_if(entry & F.col("previous_failure")).alias("failures"), F.count_if(entry & F.col("_held").isNull()).alias("orphans"), F.count_if(~entry).alias("missing"), F.count_if(entry & F.col("_file").isNull()).alias("deleted"))


def to_hash(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, length, modified) with the hash that the cache has for the same length and time, or null: those
    are read and hashed anew."""
    known = cache.select("path", "length", "modified", F.col("hash").alias("_hash"))
    return files.join(known, ["path", "length", "modified"], "left").withColumnRenamed("_hash", "hash")


def to_extract(files: DataFrame, cache: DataFrame, retry: bool = False) -> DataFrame:
    """PDF files (path, length) whose text is not cached for that length; earlier failures of the same length
    count as cached unless they are to be tried again."""
    done = cache.where(~F.col("previous_failure")) if retry else cache
    return files.join(done.select("path", "length").distinct(), ["path", "length"], "left_anti")


def listing(entries: DataFrame, parts: list[str]) -> DataFrame:
    """Entries whose descriptor has all parts in it."""
    found = entries
    for part in parts:
        found = found.where(F.contains("descriptor", F.lit(part)))
    return found


def pruned(work: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows of a worklist, as many as one run may import."""
    return work.orderBy(*order).limit(most)


def read_performance(shared: DataFrame, local: DataFrame) -> DataFrame:
    """The shared records where there are any, else the local ones, by task and timing."""
    some = shared.limit(1).agg((F.count("*") > 0).alias("_some"))
    either = shared.withColumn("_shared", F.lit(True)).unionByName(local.withColumn("_shared", F.lit(False)))
    return either.crossJoin(F.broadcast(some)).where(F.col("_shared") == F.col("_some")).drop("_shared", "_some").orderBy("task", "timing")


def coerced(value: Column, kind: Column) -> Column:
    """The canonical text of a variable of a kind (int, float, bool); null where it is none of the kind."""
    low = F.lower(value)
    whole = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long").cast("string"))
    return F.when(kind == "int", whole).when(kind == "float", F.trim(value).try_cast("double").cast("string")).when((kind == "bool") & low.isin("true", "false"), low)


def normalised_metadata(raw: DataFrame) -> DataFrame:
    """Metadata columns with aliases resolved and defaults filled in: nulls become empty, the context
    defaults to the folders of the descriptor, the uuid to one made of the hash."""
    d, h = F.col("descriptor"), F.col("hash")
    folders = F.regexp_extract(d, r"/(.*)/[^/]*$", 1)
    uuid = F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fill = lambda *c: F.coalesce(*c, F.lit(""))
    return raw.select("descriptor", fill("title").alias("title"), fill("creation_date", "creation").alias("creation_date"), fill("publication_date", "pubdate").alias("publication_date"), F.coalesce("context", folders).alias("context"), F.coalesce("uuid", uuid).alias("uuid"))


def _step(old: float, value: float) -> float:
    return (old * 4 + value) / 5


class _Stretch:
    """Values of one key that stand in one task, in order.

    alone is what they come to by themselves, from the last null on. Where the key may begin in an earlier task and no
    null stands among them, they also tell exactly what any average before them comes to: each step keeps the order
    of averages, so after the first values, head, all lie among a few neighbouring numbers, states, and of each of
    these ends says what the other values make of it. Without states head is all there is."""

    #: Values after which head is looked at again, and the most neighbours that end it.
    PART, NEIGHBOURS = 512, 256

    def __init__(self, follows: bool):
        self.alone, self.open, self.head, self.states, self.ends = None, follows, [], [], []
        self._low, self._high = -sys.float_info.max / 4, sys.float_info.max / 4

    def add(self, values: list[float | None]) -> None:
        if None in values:
            values = values[len(values) - values[::-1].index(None) :]
            self.alone, self.open, self.head, self.states, self.ends = None, False, [], [], []
        if self.open:
            self._carry(values)
        if values:
            self.alone = reduce(_step, values) if self.alone is None else reduce(_step, values, self.alone)

    def _carry(self, values: list[float]) -> None:
        while values and not self.states:
            part, values = values[: self.PART], values[self.PART :]
            self.head += part
            self._low, self._high = reduce(_step, part, self._low), reduce(_step, part, self._high)
            self.states = self.ends = self._between()
        if values:
            to = {x: reduce(_step, values, x) for x in self.ends}
            self.ends = [to[x] for x in self.ends]

    def _between(self) -> list[float]:
        found = [self._low]
        while found[-1] < self._high and len(found) < self.NEIGHBOURS:
            found.append(math.nextafter(found[-1], math.inf))
        return [] if found[-1] < self._high else [*found, math.inf, -math.inf, math.nan]


def moving_average(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """timing of each key: the first value, then (4 * old + new) / 5 for each one after it, in order.

    A null value makes the average start anew. Stretches of the order are folded one by one, and each key's
    stretches, a task's worth each, put together as `_Stretch` tells, so that the result is that of one fold to the
    last bit."""
    by = [*keys, "_order", "_value"]
    rows = samples.select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))
    many = ArrayType(DoubleType())
    parts = {"alone": DoubleType(), "open": BooleanType(), "head": many, "states": many, "ends": many}
    schema = StructType([*rows.schema, *[StructField(name, kind) for name, kind in parts.items()]])
    kinds = [pa.float64(), pa.bool_(), *[pa.list_(pa.float64())] * 3]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, None  # of the stretch that is not ended yet

        def ended(firsts: pa.RecordBatch, found: list[_Stretch]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*firsts.columns, *[pa.array([getattr(x, name) for x in found], kind) for name, kind in zip(parts, kinds)]], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # the row before each one, which is the last batch's for the first
            before = pa.Table.from_batches([first if first is not None else batch.slice(0, 1), batch.slice(0, len(batch) - 1)])
            new = np.zeros(len(batch), dtype=bool)
            for key in keys:
                a, b = before[key].combine_chunks(), batch.column(key)
                same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
                none = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
                new |= ~(same | none)
            new[0] |= first is None
            starts = np.flatnonzero(np.append(True, new[1:]))
            if new[0] and first is not None:
                yield ended(first, [held])
            # rows of a key in earlier tasks can only go before a task's first stretch
            found = [_Stretch(first is None and i == 0) if i or new[0] else held for i in range(len(starts))]
            values = batch.column("_value").to_pylist()
            for one, start, end in zip(found, starts, [*starts[1:], len(values)]):
                one.add(values[start:end])
            firsts = batch.take(pa.array(starts))
            if not new[0]:
                firsts = pa.Table.from_batches([first, firsts.slice(1)]).combine_chunks().to_batches()[0]
            if len(found) > 1:
                yield ended(firsts.slice(0, len(found) - 1), found[:-1])
            first, held = firsts.slice(len(found) - 1), found[-1]
        if first is not None:
            yield ended(first, [held])

    def after(old: Column, x: Column) -> Column:
        state = F.aggregate(x["head"], old, _step)
        return F.when(F.size(x["states"]) == 0, state).otherwise(F.element_at(x["ends"], F.array_position(x["states"], state).cast("int")))

    stretches = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(folded, schema)
    in_order = F.array_sort(F.collect_list(F.struct("_order", "_value", *parts)))
    whole = F.aggregate(in_order, F.lit(None).cast("double"), lambda old, x: F.when(old.isNull() | ~x["open"], x["alone"]).otherwise(after(old, x)))
    return stretches.groupBy(*keys).agg(whole.alias("timing"))
