"""Katz backoff n-gram model of order 3, counted, normalised and evaluated by shards of tokens.

A document is a start, its words without case, and an end. Counts of r = 1 to 5 keep the share d(r) by Good and
Turing. A token w behind the history h has P(w|h) = d * count(hw) / count(h) if hw occurs in the learned texts, else
alpha(h) * P(w|h'), h' without h's first token, down to single tokens; alpha(h) is what the n-grams of h leave over
what their suffixes leave, so that all P(w|h) sum to 1 exactly. An unknown token has the mass that discounting
single tokens frees. Every n-gram counts, those that occur once too.

Slices of a million tokens or two send each shard the different trigrams (a, b, c) whose middle token b lives there,
with the documents of their occurrences. What the recursion needs for them is then in one place: the counts of
(a, b, c), (b, c) and b, and all successors of the histories (a, b) and b. Only the counts of the last tokens c are
asked from their own shards. The shuffle of the slices serves the counting and the scoring; the model goes into a
table with one partition for each shard, the scores come back as sums by document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.storage import written
from folium.llm.words import BYTE_KEYS, LOWER, U64, Stretches, document_of, flat, give_back, kept_memory, mix, sliced, words

START, END = mix(np.array([0xA11CE, 0xB0B], dtype=U64))
#: Counts above this are kept whole.
LARGEST_DISCOUNTED = 5
#: Tokens of a slice, and bytes of text for each shard.
SLICE_TOKENS = 1_500_000
SHARD_BYTES = 12 << 20
#: A word that is one of so many tokens, or more, is sent by its number in a list that all tasks have; there
#: can be no more such words than this. A word less common costs its hash in three shards, 7 bytes each.
COMMON_ONE_IN = 1 << 21
#: A shard's sums for a document are sent in steps of one in so many, which is 3e-8 off at most for each shard.
STEPS = 1 << 24
#: Of so many numbers or more all first bytes are compressed by themselves, all second ones, and so on: each place has
#: a code of its own then.
APART_FROM = 1024


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed, all first bytes first."""
    if not len(values):
        return zstandard.compress(b"", 1)
    places = values.view(np.uint8).reshape(len(values), -1).T
    return b"".join(zstandard.compress(np.ascontiguousarray(x), 1) for x in (places if len(values) >= APART_FROM else [places]))


def _numbers(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().stream_reader(blob, read_across_frames=True).readall(), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack(rising: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return _squeezed(np.diff(rising, prepend=rising.dtype.type(0)))


def _unpack(blob: bytes, dtype: type = U64) -> np.ndarray:
    return np.cumsum(_numbers(blob, dtype), dtype=dtype)


def _home(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> U64(33)) % U64(shards)).astype(np.int32)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in rising order, and the place of each value among them: np.unique for lists whose values
    come often, of which only the different ones are sorted."""
    found = pa.array(values).dictionary_encode()
    different = found.dictionary.to_numpy()
    order = np.argsort(different)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    return different[order], place[found.indices.to_numpy()]


def _dealt(home: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a list shard by shard, in order within each, and where each shard's begin."""
    by_home = np.argsort(home, kind="stable")
    return by_home, np.searchsorted(home[by_home], np.arange(shards + 1))


def discounts(counts: dict[int, int]) -> list[float]:
    """d(1) to d(5) from the numbers of types by count: r* / r by Good and Turing, scaled so that counts
    above 5 keep all and the total given away is that of types seen once. Where the numbers do not allow
    it (some are 0, or a share leaves (0, 1]), absolute discounts of a half stand in."""
    k = LARGEST_DISCOUNTED
    n = [counts.get(r, 0) for r in range(1, k + 2)]
    if all(n):
        tail = (k + 1) * n[k] / n[0]
        if tail < 1:
            out = [((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail) for r in range(1, k + 1)]
            if all(0 < d <= 1 for d in out):
                return out
    return [(r - 0.5) / r for r in range(1, k + 1)]


def _kept(counts: np.ndarray, shares: list[float]) -> np.ndarray:
    """What is left of counts by their shares."""
    share = np.array([0.0, *shares, 1.0])
    return share[np.minimum(counts, LARGEST_DISCOUNTED + 1)] * counts


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising keys with their counts after more such keys with theirs; those that are known keep their places."""
    at = np.searchsorted(keys, more)
    known = np.zeros(len(more), dtype=bool)
    inside = at < len(keys)
    known[inside] = keys[at[inside]] == more[inside]
    counts[at[known]] += by[known]
    return np.insert(keys, at[~known], more[~known]), np.insert(counts, at[~known], by[~known])


def _word_counts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The words that are one of COMMON_ONE_IN tokens of a task at least, key and n; the tokens and bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0
        with kept_memory():
            for batch in batches:
                for part in sliced(batch):
                    data, offsets = flat(part["text"])
                    starts, ends, _ = words(data, offsets)
                    of_part = np.unique(Stretches(BYTE_KEYS[LOWER[data]]).of(starts, ends), return_counts=True)
                    keys, counts = _added(keys, counts, *of_part)
                    size += len(data)
        tokens = counts.sum()
        often = counts * COMMON_ONE_IN >= tokens
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[often].view(np.int64)), "n": counts[often], "tokens": np.zeros(often.sum(), np.int64), "bytes": np.zeros(often.sum(), np.int64)})
        yield pa.RecordBatch.from_pydict({"key": pa.array([None], pa.int64()), "n": [0], "tokens": [int(tokens)], "bytes": [size]})

    found = docs.select("text").mapInArrow(run, "key long, n long, tokens long, bytes long")
    found = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "bytes")])
    found = written(found, "common-words")  # else the words are counted twice
    tokens, size = found.where("key is null").agg(F.sum("tokens"), F.sum("bytes")).first()
    return found.where("key is not null").select("key", "n"), tokens or 0, size or 0


def _common_words(docs: DataFrame, counted: tuple[DataFrame, int, int] | None = None) -> np.ndarray:
    """The hashes of the words that are one of COMMON_ONE_IN tokens of a task at least, and of all tokens, by
    count; counted: the _word_counts. The list only shortens what is sent: whatever it holds, the scores are the same."""
    found, total, _ = counted or _word_counts(docs)
    found = found.where(F.col("n") * COMMON_ONE_IN >= total).orderBy(F.desc("n"), "key").select("key").toPandas()
    return found["key"].to_numpy(np.int64).view(U64)


_ASKED = "shard int, slice long, words binary, first binary, second binary, n_third binary, third binary, times binary, document binary, learns binary, ids array<long>, sizes binary"


def _slice_rows(held: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]], number: int, shards: int, common: np.ndarray) -> pa.RecordBatch:
    """A slice's trigrams by shard: the hashes of the words in use that are not common, the pairs (b, c) by their
    numbers (from 1: common words, then those of the row), the first tokens a of each pair (0: none, behind the
    start), how often each trigram occurs, and where."""
    sizes = np.concatenate([x[1] for x in held]) + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    document = document_of(offsets).astype(np.int32)
    token = np.full(offsets[-1], END, dtype=U64)
    last = np.zeros(len(token), dtype=bool)
    last[offsets[1:] - 1] = True
    token[~last] = np.concatenate([x[0] for x in held])
    vocabulary, c = _numbered(np.append(token, START))
    del token, last
    begin, c = c[-1], c[:-1]
    n_words = len(vocabulary)
    # words by shard, then by number: common ones by theirs, then others by hash
    home = _home(vocabulary, shards)
    by_hash = np.argsort(common)
    found = np.minimum(np.searchsorted(common, vocabulary, sorter=by_hash), max(len(common) - 1, 0))
    code = np.full(n_words, -1) if not len(common) else np.where(common[by_hash[found]] == vocabulary, by_hash[found], -1)
    rare = code < 0
    by_home = np.argsort(home.astype(np.int64) * (len(common) + n_words + 1) + np.where(rare, len(common) + np.arange(n_words), code), kind="stable")
    place = np.empty(n_words, dtype=np.int64)
    place[by_home] = np.arange(n_words)
    b, a = np.empty_like(c), np.full_like(c, -1)
    b[1:], a[2:] = c[:-1], c[:-2]
    b[offsets[:-1]], a[offsets[:-1]] = begin, -1
    second = offsets[:-1][sizes > 1] + 1
    a[second] = begin
    if n_words**2 * (n_words + 1) < 1 << 62:
        order = np.argsort((place[b] * n_words + c) * (n_words + 1) + a + 1)
    else:
        order = np.lexsort((a, c, place[b]))
    a, b, c, document = a[order], b[order], c[order], document[order]
    del order
    pair_new = np.ones(len(a), dtype=bool)
    pair_new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    new = pair_new.copy()
    new[1:] |= a[1:] != a[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(a))).astype(np.int32)
    pair_at = np.flatnonzero(pair_new[at])  # by trigram
    n_third = np.diff(np.append(pair_at, len(at))).astype(np.int32)
    a, b, c = a[at], b[at][pair_at], c[at][pair_at]
    cut = np.searchsorted(home[b], np.arange(shards + 1))
    ids, learns = pa.concat_arrays([x[2] for x in held]), np.packbits(np.concatenate([x[3] for x in held])).tobytes()
    # the numbers of common words; those of others change from shard to shard, and only those that it uses are set
    rank, used = (code + 1).astype(np.int32), np.zeros(n_words, dtype=bool)
    rows = []
    for shard in np.flatnonzero(np.diff(cut)):
        s, e = cut[shard], cut[shard + 1]
        t = pair_at[s], pair_at[e] if e < len(pair_at) else len(at)
        o = at[t[0]], at[t[1]] if t[1] < len(at) else len(document)
        used[:] = False
        used[b[s:e]] = used[c[s:e]] = True
        third = a[t[0] : t[1]]
        used[third[third >= 0]] = True
        used &= rare
        others = np.flatnonzero(used)
        rank[others] = np.arange(len(common) + 1, len(common) + 1 + len(others))
        row = [int(shard), number, _pack(vocabulary[others]), _pack(rank[b[s:e]]), _squeezed(rank[c[s:e]]), _squeezed(n_third[s:e])]
        row += [_squeezed(np.where(third >= 0, rank[third], 0).astype(np.int32)), _squeezed(times[t[0] : t[1]]), _squeezed(document[o[0] : o[1]]), learns]
        rows.append([*row, None, None] if rows else [*row, ids.to_pylist(), _squeezed(sizes.astype(np.int32))])
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8, pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ASKED.split(", ")])


def _asked(docs: DataFrame, shards: int, common: Broadcast) -> DataFrame:
    """The trigrams of docs (doc_id, text, learns), slice by slice and shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        with kept_memory():
            for batch in batches:
                for part in sliced(batch):
                    data, offsets = flat(part["text"])
                    starts, ends, of_words = words(data, offsets)
                    held.append((Stretches(BYTE_KEYS[LOWER[data]]).of(starts, ends), np.diff(of_words), part["doc_id"].cast(pa.int64()), part["learns"].to_numpy(zero_copy_only=False).astype(bool)))
                    n += len(starts) + part.num_rows
                    if n >= SLICE_TOKENS:
                        yield _slice_rows(held, number, shards, common.value)
                        held, n, number = [], 0, number + 1
                        give_back()
            if held:
                yield _slice_rows(held, number, shards, common.value)

    return docs.mapInArrow(run, _ASKED)


class _Shard:
    """What all slices ask of one shard, with equal trigrams merged."""

    def __init__(self, asked: pa.Table, common: np.ndarray):
        column = lambda name, read: [read(x.as_py()) for x in asked[name]]
        hashes = column("words", _unpack)
        shift = np.concatenate(([0], np.cumsum([len(x) for x in hashes])))[:-1]
        self.words, place = np.unique(np.concatenate([common, *hashes]), return_inverse=True)
        del hashes
        place = place.astype(np.int32)
        self.common = place[: len(common)].copy()  # the common words among them
        at = lambda s, number: place[np.where(number > len(common), number + s, number) - 1]
        n_words = len(self.words)
        numbers = lambda name: column(name, lambda x: _numbers(x, np.int32))
        pair = np.concatenate([at(s, x).astype(np.int64) * n_words + at(s, y) for s, x, y in zip(shift, column("first", lambda x: _unpack(x, np.int32)), numbers("second"))])
        pairs, pair = np.unique(pair, return_inverse=True)
        self.b, self.c = (pairs // n_words).astype(np.int32), (pairs % n_words).astype(np.int32)
        del pairs
        pair = np.repeat(pair.astype(np.int32), np.concatenate(numbers("n_third")))
        third = numbers("third")
        self.edges = np.concatenate(([0], np.cumsum([len(x) for x in third])))
        trigram = pair.astype(np.int64) * (n_words + 1)
        del pair
        for s, e, x, shifted in zip(self.edges, self.edges[1:], third, shift):
            trigram[s:e] += np.where(x > 0, at(shifted, np.maximum(x, 1)) + 1, 0)
        del third, place
        trigrams, self.at = np.unique(trigram, return_inverse=True)
        del trigram
        self.at = self.at.astype(np.int32)
        self.pair, self.a = (trigrams // (n_words + 1)).astype(np.int32), (trigrams % (n_words + 1)).astype(np.int32) - 1  # -1: none
        del trigrams
        self.times = numbers("times")
        self.document = numbers("document")
        learned = np.empty(len(self.at), dtype=np.int32)
        for s, e, flags, d, t in zip(self.edges, self.edges[1:], asked["learns"], self.document, self.times):
            learns = np.unpackbits(np.frombuffer(flags.as_py(), dtype=np.uint8)).astype(np.int32)
            learned[s:e] = np.add.reduceat(learns[d], np.concatenate(([0], np.cumsum(t)[:-1])))
        summed = lambda at, x, n: np.bincount(at, weights=x, minlength=n).astype(np.int64)
        self.n3 = summed(self.at, learned, len(self.pair))
        self.n2 = summed(self.pair, self.n3, len(self.b))
        self.n1 = summed(self.b, self.n2, n_words)  # as a history


def _needed(own: _Shard, shards: int, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The last tokens whose counts a shard needs, by the shard that counts them: its number, which of the common words
    there are needed (true or false), these words, and the others."""
    needed = np.zeros(len(own.words), dtype=bool)
    needed[own.c] = True
    asked_for = needed[own.common]
    needed[own.common] = False
    rare = own.words[needed]
    by_home, of_common = _dealt(_home(common, shards), shards)
    rare_by_home, of_rare = _dealt(_home(rare, shards), shards)
    for to in range(shards):
        there = by_home[of_common[to] : of_common[to + 1]]
        others = rare[rare_by_home[of_rare[to] : of_rare[to + 1]]]
        if len(others) or asked_for[there].any():
            yield to, asked_for[there], common[there[asked_for[there]]], others


def _counts(shards: int, common: Broadcast):
    """What a shard tells and asks before it can normalise: counts of its tokens, the last tokens whose counts
    it needs, and how many n-grams have each count (7: and all above, with the sum of their counts). The count of a
    token that occurs once is not told: it is what a shard replies for tokens that it was told nothing of."""

    def made(asked: pa.Table) -> pa.Table:
        own = _Shard(asked, common.value)
        shard = asked["shard"][0].as_py()
        rows = []
        token = np.flatnonzero((_home(own.words, shards) == shard) & (own.words != START) & (own.words != END))
        counted = [(shard, own.words[token], own.n1[token])]
        if _home(np.array([START]), shards)[0] == shard:  # a text that starts ends once
            counted.append((int(_home(np.array([END]), shards)[0]), np.array([END]), own.n1[own.words == START]))
        for to, keys, counts in counted:
            other = counts != 1
            rows.append((to, None, None, _pack(keys[other]), _squeezed(counts[other]), None, None, None, None))
        for to, asked_for, _, rare in _needed(own, shards, common.value):
            rows.append((to, shard, np.packbits(asked_for).tobytes(), _pack(rare), None, None, None, None, None))
        single = np.concatenate([x[2] for x in counted])
        for order, n in ((1, single), (2, own.n2), (3, own.n3[own.a >= 0])):
            n = n[n > 0]
            of_class = np.minimum(n, LARGEST_DISCOUNTED + 2)
            types, total = np.bincount(of_class, minlength=1), np.bincount(of_class, weights=n, minlength=1)
            rows += [(0, None, None, None, None, order, int(r), int(types[r]), int(total[r])) for r in np.flatnonzero(types)]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["to", "origin", "common", "keys", "counts", "order", "r", "types", "total"])

    def run(asked: pa.Table) -> pa.Table:
        with kept_memory():
            return made(asked)

    return run


def _replies(shards: int, common: Broadcast):
    """The counts that other shards ask of one, in the order in which they ask; the numbers of n-grams by count pass."""

    def run(told: pa.Table) -> pa.Table:
        rows, shard = told.to_pylist(), told["to"][0].as_py()
        known = [(_unpack(r["keys"]), _numbers(r["counts"], np.int64)) for r in rows if r["counts"] is not None]
        keys, counts = (np.concatenate(x) for x in zip(*known)) if known else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        listed = common.value[_home(common.value, shards) == shard]
        out = []
        for r in rows:
            if r["origin"] is not None:
                asked_for = np.unpackbits(np.frombuffer(r["common"], dtype=np.uint8), count=len(listed)).astype(bool)
                asked = np.concatenate((listed[asked_for], _unpack(r["keys"])))
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                n = np.where(keys[at] == asked, counts[at], 1) if len(keys) else np.ones(len(asked), np.int64)
                out.append((r["origin"], shard, _squeezed(n), None, None, None, None))
            elif r["order"] is not None:
                out.append((None, None, None, r["order"], r["r"], r["types"], r["total"]))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = zip(*out) if out else [[]] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["shard", "home", "counts", "order", "r", "types", "total"])

    return run


@dataclass
class _Single:
    """The shares of all orders, and the probabilities of single tokens."""

    shares: dict[int, list[float]]
    tokens: int
    types: int
    unknown: float
    factor: float

    @classmethod
    def of(cls, stats: list[dict]) -> "_Single":
        types = {n: {x["r"]: x["types"] for x in stats if x["order"] == n} for n in (1, 2, 3)}
        shares = {n: discounts(types[n]) for n in types}
        single = [x for x in stats if x["order"] == 1]
        tokens = sum(x["total"] for x in single)
        mass = sum(x["total"] * ([*shares[1], 1.0, 1.0][x["r"] - 1]) for x in single)
        unknown = max(1 - mass / tokens, 0.5 / tokens) if tokens else 1.0
        return cls(shares, tokens, sum(x["types"] for x in single), unknown, (1 - unknown) / mass if tokens else 0.0)


def _backoff(history: np.ndarray, n: int, counts: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each history its count, the factor on what its n-grams keep, and alpha; 1 where it does not occur.

    A history whose n-grams keep all leaves half a token for the others."""
    seen = counts > 0
    total, keep = np.bincount(history, weights=counts, minlength=n), np.bincount(history, weights=kept, minlength=n)
    below = np.bincount(history, weights=np.where(seen, lower, 0.0), minlength=n)
    some = total > 0
    whole = np.where(some, total, 1.0)
    factor = np.where(some & (keep >= whole), (whole - 0.5) / np.where(keep > 0, keep, 1.0), 1.0)
    alpha = np.where(some, (1 - keep * factor / whole) / np.maximum(1 - below, 1e-12), 1.0)
    return whole, factor, alpha


_MODEL = ["words", "n1", "backoff1", "first", "second", "n2", "history_first", "history_second", "backoff2", "pair", "third", "n3"]
_ANSWER = ["documents", "unknown", "base", "score"]
_TOLD = "kind string, shard int, slice long, ids array<long>, sizes binary, tokens long, " + ", ".join(f"{c} binary" for c in [*_ANSWER, *_MODEL])


def _evaluated(smooth: float, stored: bool, shards: int, common: Broadcast):
    """The normalised n-grams of a shard, and the sums over its tokens for each document of each slice."""

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), *[pa.binary()] * (len(_ANSWER) + len(_MODEL))]
    names = [x.split()[0] for x in _TOLD.split(", ")]

    def made(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.schema(list(zip(names, kinds))).empty_table()
        own = _Shard(asked, common.value)
        single = _Single.of(next((x for x in told["stats"].to_pylist() if x is not None), []))
        of_word = np.zeros(len(own.words), dtype=np.int64)
        counts = {home: n for home, n in zip(told["home"].to_pylist(), told["counts"].to_pylist()) if home is not None}
        for home, _, listed, rare in _needed(own, shards, common.value):
            of_word[np.searchsorted(own.words, np.concatenate((listed, rare)))] = _numbers(counts[home], np.int64)
        p1 = np.where(of_word > 0, _kept(of_word, single.shares[1]) * single.factor, single.unknown)

        kept = _kept(own.n2, single.shares[2])
        total, factor, alpha1 = _backoff(own.b, len(own.words), own.n2, kept, p1[own.c])
        p2 = np.where(own.n2 > 0, kept * factor[own.b] / total[own.b], alpha1[own.b] * p1[own.c])
        del p1, kept, total, factor

        real = np.flatnonzero(own.a >= 0)
        pair = own.pair[real]
        histories, history = np.unique(own.a[real].astype(np.int64) * len(own.words) + own.b[pair], return_inverse=True)
        history = history.astype(np.int32)
        n3, lower = own.n3[real], p2[pair]
        del pair
        kept = _kept(n3, single.shares[3])
        total, factor, alpha2 = _backoff(history, len(histories), n3, kept, lower)
        kept *= factor[history]
        kept /= total[history]
        lower *= alpha2[history]
        np.copyto(lower, kept, where=n3 > 0)
        del kept, total, factor
        p = p2[own.pair]
        p[real] = lower
        del p2, lower, real

        # each asked trigram's own values, and their sums by document
        np.log10(p, out=p)
        of_base = np.log10((of_word + smooth) / (single.tokens + smooth * (single.types + 1)))
        rows = []
        for i, (slice_id, ids, sizes) in enumerate(zip(*[asked[c].to_pylist() for c in ("slice", "ids", "sizes")])):
            at = own.at[own.edges[i] : own.edges[i + 1]]
            last = own.c[own.pair[at]]
            document, times = own.document[i], own.times[i]
            sums = [np.bincount(document, weights=np.repeat(x, times)) for x in (of_word[last] == 0, of_base[last], p[at])]
            some = np.flatnonzero(np.bincount(document))
            blobs = [_pack(some.astype(np.int32)), _squeezed(sums[0][some].astype(np.int32)), *[_squeezed(np.rint(-x[some] * STEPS).astype(np.int64)) for x in sums[1:]]]
            rows.append(["answer", int(asked["shard"][0].as_py()), slice_id, ids, sizes, single.tokens, *blobs, *[None] * len(_MODEL)])
        del p, of_base
        own.at = own.times = own.document = None
        if stored:
            held = [np.flatnonzero(x) for x in (own.n1 > 0, own.n2 > 0, (own.n3 > 0) & (own.a >= 0))]
            often = np.flatnonzero(np.bincount(history, weights=n3, minlength=len(histories)) > 1)
            small = lambda x: _squeezed(x.astype(np.int32))
            of_pair = np.cumsum(own.n2 > 0) - 1
            used = np.zeros(len(own.words), dtype=bool)
            used[own.b[held[1]]] = used[own.c[held[1]]] = used[own.a[held[2]]] = True
            place = np.cumsum(used) - 1
            model = [_pack(own.words[used]), small(own.n1[used]), _squeezed(alpha1[used]), small(place[own.b[held[1]]]), small(place[own.c[held[1]]]), small(own.n2[held[1]])]
            model += [small(place[histories[often] // len(own.words)]), small(place[histories[often] % len(own.words)]), _squeezed(alpha2[often])]
            model += [_pack(of_pair[own.pair[held[2]]].astype(np.int32)), small(place[own.a[held[2]]]), small(own.n3[held[2]])]
            rows.append(["model", int(asked["shard"][0].as_py()), None, None, None, single.tokens, *[None] * len(_ANSWER), *model])
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        with kept_memory():
            return made(asked, told)

    return run


def _summed(answers: pa.Table) -> pa.Table:
    """The scores of a slice's documents, from those of its tokens in all shards."""
    home = next(i for i, x in enumerate(answers["sizes"]) if x.is_valid)
    ids, sizes = answers["ids"][home].values.cast(pa.int64()), _numbers(answers["sizes"][home].as_py(), np.int32)
    sums = np.zeros((3, len(sizes)))
    for row in zip(*[answers[c] for c in _ANSWER]):
        documents, *parts = (x.as_py() for x in row)
        at = _unpack(documents, np.int32)
        for total, part, kind in zip(sums, parts, (np.int32, np.int64, np.int64)):
            total[at] += _numbers(part, kind)
    tokens = pa.array(np.full(len(sizes), answers["tokens"][home].as_py(), dtype=np.int64))
    columns = [ids, pa.array(sizes, pa.int64()), pa.array(sizes - sums[0].astype(np.int64)), tokens, pa.array(0.0 - sums[1] / STEPS), pa.array(0.0 - sums[2] / STEPS)]
    return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


@dataclass
class KatzScores:
    """scores: doc_id, n_tokens, n_known, train_tokens, base_score, score of every row. model: one row and one
    partition for each shard, with the hashes of its words, the counts of its n-grams by places among them, and
    the backoff weights of histories of one token and of two; that of two tokens that occur once follows from the
    one n-gram that they begin, and is left out."""

    scores: DataFrame
    model: DataFrame


def learned_and_scored(docs: DataFrame, learns: Column, smooth: float = 0.1, stored: bool = True) -> KatzScores:
    """Learns a model from the rows where learns is true, and scores all rows of docs (doc_id, text).

    A null text has its end as its only token. Rows without doc_id and rows that repeat one are texts of their
    own, and each keeps its row; of no row at all there are no scores. If no row learns, every token is unknown
    with probability 1. base_score: the sum of the logarithms of (count + smooth) / (tokens + smooth * (types + 1)).
    stored: whether the model's rows are written; the scores are the same. All logarithms are to base 10.
    Other columns of docs may be any, and are not returned."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learns, F.lit(False)).alias("learns"))
    counted = _word_counts(docs)
    shards = max(1, -(-counted[2] // SHARD_BYTES))
    common = spark.sparkContext.broadcast(_common_words(docs, counted))
    asked = _asked(docs, shards, common)
    told = asked.groupBy("shard").applyInArrow(_counts(shards, common), "to int, origin int, common binary, keys binary, counts binary, order int, r int, types long, total long")
    replies = told.groupBy("to").applyInArrow(_replies(shards, common), "shard int, home int, counts binary, order int, r int, types long, total long")
    by_count = replies.where(F.col("order").isNotNull()).groupBy("order", "r").agg(F.sum("types").alias("types"), F.sum("total").alias("total"))
    stats = by_count.agg(F.collect_list(F.struct("order", "r", "types", "total")).alias("stats"))  # 21 entries at most
    to_all = spark.range(shards).select(F.col("id").cast("int").alias("shard")).crossJoin(stats)
    known = replies.where(F.col("shard").isNotNull()).select("shard", "home", "counts", F.lit(None).cast(stats.schema["stats"].dataType).alias("stats"))
    known = known.unionByName(to_all.select("shard", F.lit(None).cast("int").alias("home"), F.lit(None).cast("binary").alias("counts"), "stats"))
    # one job: Spark shuffles what the slices ask once and reads it for the counts and for the scores
    done = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_evaluated(smooth, stored, shards, common), _TOLD)
    table = written(done, "katz", ("kind", "shard"))
    answers = table.where("kind = 'answer'").select("slice", "ids", "sizes", "tokens", *_ANSWER)
    scores = answers.groupBy("slice").applyInArrow(_summed, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return KatzScores(scores, table.where("kind = 'model'").select("shard", "tokens", *_MODEL))
