import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import language_model, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Plain:
    """Katz backoff of order 3 over dictionaries, by recursion."""

    def __init__(self, texts):
        self.counts = [None, *(collections.Counter() for _ in range(3))]
        self.starts = len(texts)
        for tokens in texts:
            line = ["<s>", *tokens]
            self.counts[1].update((t,) for t in tokens)
            for n in (2, 3):
                self.counts[n].update(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.shares = [None, *(language_model.discounts(collections.Counter(c.values())) for c in self.counts[1:])]
        mass = sum(self.kept((w,)) for (w,) in self.counts[1])
        self.unknown = max(1 - mass / self.n, 0.5 / self.n)
        self.single = (1 - self.unknown) / mass
        self.sums = collections.defaultdict(lambda: [0.0, 0.0])
        for n in (2, 3):
            for g in self.counts[n]:
                s = self.sums[g[:-1]]
                s[0] += self.kept(g)
                s[1] += self.p(g[-1], g[1:-1])

    def kept(self, g):
        c = self.counts[len(g)][g]
        return c * (self.shares[len(g)][c - 1] if c <= 5 else 1.0)

    def p(self, w, history):
        if not history:
            return self.kept((w,)) * self.single if (w,) in self.counts[1] else self.unknown
        g = (*history, w)
        if history not in self.sums:
            return self.p(w, history[1:])
        n = self.starts if history == ("<s>",) else self.counts[len(history)][history]
        kept, lower = self.sums[history]
        factor = 1.0 if kept < n else (n - 0.5) / kept
        if g in self.counts[len(g)]:
            return self.kept(g) * factor / n
        return (1 - kept * factor / n) / (1 - lower) * self.p(w, history[1:])

    def score(self, tokens):
        line = ["<s>", *tokens]
        return sum(math.log10(self.p(line[j], tuple(line[max(0, j - 2) : j]))) for j in range(1, len(line)))


def _texts():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))).title() for _ in range(150)] + ["", None, "the same line", "the same line"]


def _tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


def _frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema).repartition(4)


@pytest.mark.parametrize("slice_tokens, shard_bytes", [(language_model.SLICE_TOKENS, language_model.SHARD_BYTES), (200, 3000)])
def test_scores_and_normalisation(spark, monkeypatch, slice_tokens, shard_bytes):
    monkeypatch.setattr(language_model, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(language_model, "SHARD_BYTES", shard_bytes)
    texts = _texts()
    docs = _frame(spark, texts)
    got = language_model.learned_and_scored(docs, F.col("doc_id") % 3 != 0)
    plain = Plain([_tokens(t) for i, t in enumerate(texts) if i % 3])
    assert sum(c == 1 for c in plain.counts[3].values()) > len(plain.counts[3]) / 2
    for history in [("<s>",), *list(plain.sums)[:40]]:
        assert sum(plain.p(w, history) for (w,) in plain.counts[1]) + plain.p("unseen", history) == pytest.approx(1, abs=1e-9)
    rows = {r["doc_id"]: r for r in got.scores.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        tokens, r = _tokens(text), rows[i]
        base = sum(math.log10((plain.counts[1][(t,)] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum((t,) in plain.counts[1] for t in tokens), plain.n)
        assert r["score"] == pytest.approx(plain.score(tokens)) and r["base_score"] == pytest.approx(base)
    # the stored model has every n-gram once, and the backoff weight of histories that occur twice or more
    held = got.model.collect()
    count = lambda name, kind: [x for r in held for x in language_model._numbers(r[name], kind)]
    assert sorted(count("n2", "i4")) == sorted(plain.counts[2].values()) and sorted(count("n3", "i4")) == sorted(plain.counts[3].values())
    alpha = lambda h: (1 - plain.sums[h][0] / (plain.counts[2][h] if len(h) == 2 else plain.counts[1][h] or plain.starts)) / (1 - plain.sums[h][1])
    often = [h for h in plain.sums if len(h) == 2 and plain.counts[2][h] > 1]
    free = [h for h in often if plain.sums[h][0] < plain.counts[2][h]]
    stored = np.sort(count("backoff2", "f8"))
    assert len(stored) == len(often)
    assert np.abs(stored[np.searchsorted(stored, [alpha(h) - 1e-9 for h in free]).clip(0, len(stored) - 1)] - [alpha(h) for h in free]).max() < 1e-6


def test_query_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 5000} The" for i in range(120_000))
    rows = [*enumerate(_texts()), (None, "a b"), (None, "a b"), (7, "the same line"), (200, ""), (201, None), (202, long)]
    frame = spark.createDataFrame([(*r, "en", 1.0, 2) for r in rows], "doc_id long, text string, lang string, score double, slice int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_katz_backoff(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([_tokens(t) for i, t in rows if not held(i)])
    want = sorted((str(i), held(i), len(_tokens(t)), round(plain.score(_tokens(t)), 5 if len(t or "") < 10_000 else 2)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["score"], 5 if r["n_tokens"] < 10_000 else 2)) for r in got) == want


def test_no_rows_and_no_learning_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert language_model.learned_and_scored(docs.limit(0), F.lit(True)).scores.count() == 0
    rows = language_model.learned_and_scored(docs, F.lit(None).cast("boolean")).scores.collect()
    assert [r["score"] for r in rows] == [0.0] * 4 and all(r["n_known"] == r["train_tokens"] == 0 for r in rows)


def test_words_are_counted_once_for_the_common_ones(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(f"the word w{i}",) for i in range(40)], "text string").mapInArrow(seen, "text string")
    assert len(language_model._common_words(docs)) == 42 and read.value == 40


@pytest.mark.parametrize("n", [0, 1, language_model.APART_FROM - 1, language_model.APART_FROM, 20_000])
@pytest.mark.parametrize("kind", [np.int32, np.int64, np.uint64, np.float64])
def test_numbers_come_back_as_they_were(n, kind):
    numbers = (np.random.default_rng(n).random(n) * 3000).astype(kind)
    blob = language_model._squeezed(numbers)
    assert language_model._numbers(blob, kind).tolist() == numbers.tolist()
    if n == 20_000 and kind == np.int32:  # 11.6 bits each at best
        assert len(blob) < 1.5 * n


def test_shards_tell_each_other_neither_common_words_nor_counts_of_one():
    shards, rng = 3, np.random.default_rng(4)
    often, rare = (language_model.mix(np.arange(s, s + n, dtype=np.uint64)) for s, n in ((10**6, 400), (10**7, 3000)))
    common = type("Listed", (), {"value": often})
    texts = [rng.permutation(np.concatenate((often, rare[i::10]))) for i in range(10)]
    held = [(np.concatenate(texts), np.full(10, 700), pa.array(range(10), pa.int64()), np.arange(10) != 3)]
    asked = pa.Table.from_batches([language_model._slice_rows(held, 0, shards, often)])
    told = pa.concat_tables([language_model._counts(shards, common)(asked.filter(pa.compute.equal(asked["shard"], i))) for i in range(shards)])
    replies = pa.concat_tables([language_model._replies(shards, common)(told.filter(pa.compute.equal(told["to"], i))) for i in range(shards)])
    of_word, listed = {}, set(often.tolist())
    for row in told.to_pylist():
        keys = language_model._unpack(row["keys"]).tolist() if row["keys"] else []
        if row["counts"]:
            of_word |= dict(zip(keys, language_model._numbers(row["counts"], np.int64).tolist()))
        else:
            assert not listed & set(keys)
    end = int(language_model.END)
    assert of_word == {end: 9} | dict.fromkeys(often.tolist(), 9) | dict.fromkeys(rare[3::10].tolist(), 0)
    got = {(r["shard"], r["home"]): language_model._numbers(r["counts"], np.int64).tolist() for r in replies.to_pylist() if r["counts"]}
    for i in range(shards):
        own = language_model._Shard(asked.filter(pa.compute.equal(asked["shard"], i)), often)
        for to, _, first, second in language_model._needed(own, shards, often):
            assert got[i, to] == [of_word.get(x, 1) for x in [*first.tolist(), *second.tolist()]]
    assert sum(len(x or b"") for c in ("common", "keys", "counts") for x in told[c].to_pylist()) < 8.5 * len(rare) + 10 * len(often)


def test_texts_are_read_for_counting_words_and_for_slices_alone(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [*enumerate(_texts()), (None, " \t"), (3, "the same line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(seen, "doc_id long, text string")
    assert language_model.learned_and_scored(docs, F.lit(True)).scores.count() == len(rows)
    assert read.value == 2 * len(rows)


def test_word_counts_of_tasks_add_up(spark):
    texts = ["a b a", None, "", "b c", " \n ", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found, tokens, size = language_model._word_counts(docs)
    assert sorted(r["n"] for r in found.collect()) == [1, 2, 3]
    assert (tokens, size) == (6, sum(len(t or "") for t in texts))
    rng = np.random.default_rng(5)
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    parts = [np.zeros(0, dtype=np.uint64), *[rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58) for n in (1, 40, 300)]]
    for part in parts:
        keys, counts = language_model._added(keys, counts, *np.unique(part, return_counts=True))
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert keys.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_values_are_numbered_in_rising_order(n):
    values = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)[np.random.default_rng(1).integers(0, max(n // 3, 1), n)]
    different, place = language_model._numbered(values)
    want = np.unique(values, return_inverse=True)
    assert different.tolist() == want[0].tolist() and place.tolist() == want[1].tolist()


def test_slices_deal_pairs_to_their_shards_among_many():
    shards, none = 1 << 20, np.zeros(0, dtype=np.uint64)
    tokens = language_model.mix(np.arange(1, 4001, dtype=np.uint64))
    rows = language_model._slice_rows([(tokens, np.array([4000]), pa.array([1], pa.int64()), np.array([True]))], 0, shards, none).to_pylist()
    of_row = [language_model._unpack(r["words"])[language_model._unpack(r["first"], np.int32) - 1] for r in rows]
    assert sum(map(len, of_row)) == 4001 and len({r["shard"] for r in rows}) == len(rows)
    assert all((language_model._home(words, shards) == r["shard"]).all() for words, r in zip(of_row, rows))
