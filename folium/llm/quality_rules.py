"""Quality rules: counts within a text, and bands of n-gram perplexity for each language.

Each language has a modified Kneser-Ney model of order 4 over characters. Its alphabet are the 254 characters that
it uses most, as counted by Spark, in any script; further ones share a symbol. Spark counts the n-grams over all
texts and builds each language's model in a task of its own, as arrays of n-grams sorted by hash with their
probabilities and backoff weights, one row and one partition for each language. Texts are scored with the models
of as many languages at once as fit a broadcast of MODEL_BYTES; further languages take another pass over their texts.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.storage import written
from folium.llm.words import SPACE, U64, Stretches, document_of, flat, give_back, mix, per_document, sliced, word_hashes, words

ORDER, SYMBOLS = 4, 256
#: 0 stands before a text, 1 for characters beyond the alphabet, and the rest for the alphabet.
START, OTHER, FIRST = 0, 1, 2
#: Languages with fewer texts than one in so many share a model, so there are no more models than this and one.
LANGUAGES = 1024
#: Models are broadcast together up to so many bytes.
MODEL_BYTES = 96 << 20
#: Texts are worked on in slices of about so many bytes.
SLICE = 1 << 20
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, A-Z in lower case, and n + 1 offsets of the texts' characters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    begins = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    return points, begins[offsets]


def _model_of(lang: Column, shares: DataFrame) -> Column:
    """The name of a text's model: its language if it has one of its own, else nothing (a null language too)."""
    own = [r["lang"] for r in shares.collect()]  # LANGUAGES at most
    return F.when(lang.isin(own), lang).otherwise("") if own else F.lit("")


def _by_model(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, rows, code points, offsets) of the texts of each model."""
    names = np.array(part["model"].to_pylist(), dtype=object)
    points, offsets = characters(*flat(part["text"]))
    for name in sorted(set(names)):
        rows = np.flatnonzero(names == name)
        sizes = np.diff(offsets)[rows]
        at = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        yield name, rows, points[at], np.concatenate(([0], np.cumsum(sizes)))


def alphabets(docs: DataFrame) -> DataFrame:
    """model, alphabet: the most frequent characters, by code point, of each model's texts (model, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                for name, _, points, _ in _by_model(part):
                    n = np.bincount(points)  # as long as the largest code point
                    held = total.setdefault(name, np.zeros(0x10000, dtype=np.int64))
                    if len(n) > len(held):
                        held = total[name] = np.append(held, np.zeros(0x110000 - len(held), dtype=np.int64))
                    held[: len(n)] += n
        for name, counts in total.items():
            keys, n = np.flatnonzero(counts), counts[counts > 0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(n)], names=["model", "point", "n"])

    counts = docs.select("model", "text").mapInArrow(run, "model string, point int, n long").groupBy("model", "point").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "point")))
    return ranked.where(F.col("rank") <= SYMBOLS - FIRST).groupBy("model").agg(F.array_sort(F.collect_list("point")).alias("alphabet"))


def gram_codes(points: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """For each character the code of the n-gram that ends there."""
    at = np.minimum(np.searchsorted(alphabet, points), max(len(alphabet) - 1, 0))
    now = np.where(alphabet[at] == points, at + FIRST, OTHER).astype(np.uint32) if len(alphabet) else np.full(len(points), OTHER, dtype=np.uint32)
    out = now.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(now)
        before[back:] = now[:-back]
        for i in range(back):
            first = offsets[:-1] + i
            before[first[first < len(now)]] = START
        out |= before << np.uint32(8 * back)
    return out


def gram_counts(docs: DataFrame, letters: dict[str, np.ndarray]) -> DataFrame:
    """model, gram long, n long: how many texts have each n-gram, added up in each task before they are shuffled.

    A text counts once for an n-gram, so what one text repeats a hundred times is not taught a hundred times."""
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                for name, _, points, offsets in _by_model(part):
                    codes = gram_codes(points, offsets, shared.value[name]).astype(np.int64) | document_of(offsets) << 32
                    found, n = np.unique(np.unique(codes).astype(np.uint32), return_counts=True)
                    held = total.get(name, (found[:0], n[:0]))
                    keys, at = np.unique(np.concatenate((held[0], found)), return_inverse=True)
                    total[name] = keys, np.bincount(at, weights=np.concatenate((held[1], n))).astype(np.int64)
        for name, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["model", "gram", "n"])
        give_back()

    return docs.select("model", "text").mapInArrow(run, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


class SortedHashes:
    """Values by 64-bit hash: two parallel arrays in the order of the hashes."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> "SortedHashes":
        hashes = mix(keys.astype(U64))
        order = np.argsort(hashes)
        return cls(hashes[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default)
        if len(self.hashes):
            hashes = mix(keys.astype(U64))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.values[at[hit]]
        return out


class KneserNey:
    """Interpolated modified Kneser-Ney probabilities of n-gram codes, highest order first in levels."""

    def __init__(self, levels: list[tuple[SortedHashes, SortedHashes]]):
        self.levels = levels

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> "KneserNey":
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append(cls._level(grams, counts))
            # the next lower order counts the different characters that come before
            grams, counts = np.unique(grams % SYMBOLS ** (order - 1), return_counts=True)
        return cls(levels)

    @staticmethod
    def _level(grams: np.ndarray, counts: np.ndarray) -> tuple[SortedHashes, SortedHashes]:
        n = [int((counts == i).sum()) for i in range(1, 5)]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            drop = [max(0.0, min(i, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        else:
            drop = [0.5, 1.0, 1.5]  # too few n-grams to estimate from
        discount = np.array([0.0, *drop])[np.minimum(counts, 3)]
        contexts, at = np.unique(grams // SYMBOLS, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(contexts))
        left = np.bincount(at, weights=discount, minlength=len(contexts))
        return SortedHashes.of(grams, (counts - discount) / total[at]), SortedHashes.of(contexts, left / total)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each code after those before it: from the lowest order up."""
        out = np.full(len(grams), 1.0 / (SYMBOLS - 1))
        for order, (own, rest) in enumerate(reversed(self.levels), 1):
            code = grams % SYMBOLS**order
            out = own.get(code, 0.0) + rest.get(code // SYMBOLS, 1.0) * out
        return out


_LEVEL = ["hashes", "shares", "contexts", "rests"]


def train(docs: DataFrame) -> DataFrame:
    """model, alphabet, size and the levels' arrays of each model, a written table in partitions by model, from
    all texts (model, text)."""
    letters = written(alphabets(docs), "alphabets")
    known = {r["model"]: np.array(r["alphabet"], dtype=np.uint32) for r in letters.collect()}  # 254 characters for each model
    arrays = [f"{c}_{n}" for n in range(ORDER, 0, -1) for c in _LEVEL]

    def build(table: pa.Table) -> pa.Table:
        grams, counts = table["gram"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(grams)
        made = [x for pair in KneserNey.of(grams[order], counts[order]).levels for half in pair for x in (half.hashes.tobytes(), half.values.tobytes())]
        return pa.table([table["model"][:1], pa.array([sum(map(len, made))], pa.int64()), *[pa.array([x], pa.binary()) for x in made]], names=["name", "size", *arrays])

    built = gram_counts(docs, known).groupBy("model").applyInArrow(build, "name string, size long, " + ", ".join(f"{c} binary" for c in arrays))
    return written(built.join(letters.withColumnRenamed("model", "name"), "name").withColumn("model", F.concat(F.lit("of-"), "name")), "character-models", ("model",))


def _loaded(row: dict) -> tuple[np.ndarray, KneserNey]:
    read = lambda name, n, kind: np.frombuffer(row[f"{name}_{n}"], dtype=kind)
    pairs = [[SortedHashes(read(h, n, U64), read(v, n, np.float32)) for h, v in (_LEVEL[:2], _LEVEL[2:])] for n in range(ORDER, 0, -1)]
    return np.array(row["alphabet"], dtype=np.uint32), KneserNey([tuple(p) for p in pairs])


def _groups(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Names of models that are broadcast together."""
    out, held = [], MODEL_BYTES
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if held + size > MODEL_BYTES:
            out, held = [*out, []], 0
        out[-1].append(name)
        held += size
    return out


def repeated_within(keys: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more in its document."""
    keys = mix(keys + document.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, of_words = words(data, offsets)
    bound = offsets
    in_word = ~SPACE[data]
    count = lambda flag: per_document(flag.astype(np.int64), bound)
    out = {"n_words": np.diff(of_words), "word_chars": count(in_word & (data & 0xC0 != 0x80)), "n_symbols": count(SYMBOL[data])}

    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first[1:][data == 10] = True
    line_start = np.flatnonzero(first[:-1]) if len(data) else np.zeros(0, dtype=np.int64)
    line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10)) if len(line_start) else line_end
    filled = np.concatenate(([0], np.cumsum(in_word)))
    has_word = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    keys = mix(word_hashes(data, line_start, line_end) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, one = np.unique(keys, return_index=True)
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[one], minlength=n)

    window = 8
    document = document_of(of_words)
    grams = Stretches(word_hashes(data, starts, ends)).grams(window)
    at = np.flatnonzero(document[: len(grams)] == document[window - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    at = at[repeated_within(grams[at], document[at])] if len(at) else at
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    out["n_repeat_words"] = per_document((np.cumsum(cover)[:-1] > 0).astype(np.int64), of_words)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, lang, the counts, n_chars, bits (the model's bits a character; null: no character) of the texts
    (doc_id, lang, model, text) of some models."""
    rows = [r.asDict() for r in models.where(F.col("name").isin(names)).collect()]  # MODEL_BYTES at most, or one model
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_chars long, bits double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {r["name"]: _loaded(r) for r in shared.value}
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                total, size = np.zeros(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
                for name, chosen, points, offsets in _by_model(part):
                    alphabet, model = known[name]
                    codes, at = np.unique(gram_codes(points, offsets, alphabet), return_inverse=True)
                    total[chosen] = per_document(-np.log2(model.probability(codes.astype(np.int64)))[at], offsets)
                    size[chosen] = np.diff(offsets)
                counts = text_counts(*flat(part["text"]))
                columns = [part["doc_id"].cast(pa.int64()), part["lang"].cast(pa.string()), *[pa.array(counts[c], pa.int64()) for c in COUNTS], pa.array(size), pa.array(total / np.maximum(size, 1), mask=size == 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *COUNTS, "n_chars", "bits"])

    return docs.where(F.col("model").isin(names)).select("doc_id", "lang", "model", "text").mapInArrow(run, schema)


#: Texts of one language and length class that a band of its own takes.
CLASS_TEXTS = 200
#: How far from the median a text may lie, in distances of its side's quartile, and in bits a character at least.
WIDTH, LEAST_BITS = 7.0, 0.05


def _bands(found: DataFrame, by: list[str]) -> DataFrame:
    """middle, below, above (the median of bits, and the distances of its quartiles) and texts, for each by.

    Quartiles are taken over all texts that pass the base rules, from counts by thousandth of a bit, so they do
    not depend on the order of rows."""
    bins = found.where(~F.col("base_failed") & F.col("bits").isNotNull()).groupBy(*by, F.round(F.col("bits") * 1000).cast("int").alias("bin")).count()
    group = Window.partitionBy(*by)
    upto = F.sum("count").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(group)
    ranked = bins.withColumn("share", upto)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) / 1000
    quartiles = ranked.groupBy(*by).agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"), F.sum("count").alias("texts"))
    return quartiles.select(*[F.col(c).alias(f"_{c}") for c in by], "middle", (F.col("middle") - F.col("low")).alias("below"), (F.col("high") - F.col("middle")).alias("above"), "texts")


def length_class(n_chars: Column) -> Column:
    """Texts of up to 128 characters, then up to each power of two, and beyond 16384."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(n_chars, F.lit(1)))), F.lit(7)), F.lit(15)).cast("int")


def judge(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits.

    A text is rejected if it fails the base rules, or if its bits a character lie outside the band of its language
    and length class; classes of fewer than CLASS_TEXTS texts take the band of the language, wider by the factor
    1 + sqrt(2000 / n) for n characters, as short texts scatter more. A null or empty text has no words, so it
    fails. Null languages, and those of few texts, share a model; null languages share a band. Rows without doc_id
    and rows that repeat one are judged each for itself. Other columns of docs may be any, and are not returned."""
    shares = docs.groupBy("lang").count().withColumn("all", F.expr("sum(count) over ()")).where(F.col("lang").isNotNull() & (F.col("count") * LANGUAGES >= F.col("all")))
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", _model_of(F.col("lang"), shares).alias("model"))
    models = train(docs)
    groups = _groups([(r["name"], r["size"]) for r in models.select("name", "size").collect()])
    if not groups:  # no text has a character
        groups = [[]]
    parts = [scored(docs, models, names) for names in groups]
    trained = [x for names in groups for x in names]
    found = reduce(DataFrame.unionByName, parts)
    bare = docs.where(~F.col("model").isin(trained)) if trained else docs
    empty = bare.select("doc_id", "lang", *[F.lit(0).cast("long").alias(c) for c in [*COUNTS, "n_chars"]], F.lit(None).cast("double").alias("bits"))
    found = found.unionByName(empty).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    found = written(found.withColumn("length_class", length_class(F.col("n_chars"))), "quality-rules")
    own = _bands(found, ["lang", "length_class"]).where(F.col("texts") >= CLASS_TEXTS)
    whole = _bands(found, ["lang"]).select("_lang", *[F.col(c).alias(f"whole_{c}") for c in ("middle", "below", "above")])
    of_lang = F.col("lang").eqNullSafe(F.col("_lang"))
    judged = found.join(own, of_lang & (F.col("length_class") == F.col("_length_class")), "left").drop("_lang").join(whole, of_lang, "left")
    spread = F.when(F.col("middle").isNull(), 1 + F.sqrt(2000 / F.greatest(F.col("n_chars"), F.lit(1)))).otherwise(2.0)
    of = lambda c: F.coalesce(c, f"whole_{c}")
    off = F.col("bits") - of("middle")
    side = lambda c: F.greatest(F.lit(width) * of(c), F.lit(LEAST_BITS)) * spread / 2
    inside = (off >= -side("below")) & (off <= side("above"))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "bits")
