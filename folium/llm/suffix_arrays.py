"""Repeated windows of bytes by external induced suffix sorting.

A shard's stretches form one text, each ended by a separator. Its suffixes are of type S (smaller than
the next suffix) or L. The leftmost S suffixes of each run are sorted by naming the substrings between
them and sorting the shorter sequence of names, by induction again where it has few different names.
Two scans then induce all others: a suffix that leaves the queue puts its predecessor into the queue of
its first symbol, with the length of the prefix that it shares with the one put there before (one more
than the least shared on the way). The queue's tuples (place, shared length) stand in files once they
outgrow memory, as do the arrays. Shared lengths stop at the window, deeper order is left open.
"""

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from folium.llm.repeats import SLICE, merged, range_arrays, with_removed_ranges
from folium.llm.words import flat, kept_memory, sliced

#: Arrays of more bytes stand in unlinked files of the task; so do a queue's tuples beyond so many.
FILE_FROM = 8 << 20
QUEUE_TUPLES = 1 << 19
#: Suffixes that a scan takes from the queue at once.
BLOCK = 1 << 18
#: A sequence with more different names is sorted by doubling its ranks: a bucket for each name makes induction some
#: six times slower there (12.1 s against 1.9 s for a MB of text with some 20,000 names), beyond any budget.
INDUCE_NAMES = 4096
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def room(n: int, dtype: type) -> np.ndarray:
    """An array, in a file that vanishes with it if it is large."""
    if n * np.dtype(dtype).itemsize <= FILE_FROM:
        return np.empty(n, dtype=dtype)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype=dtype, mode="r+", shape=(n,))


class BucketQueue:
    """A priority queue of (place, shared length) by first symbol, then by arrival, which is the order
    of the suffixes of one symbol. Tuples beyond QUEUE_TUPLES are written to a file, bucket by bucket."""

    def __init__(self, symbols: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.filed: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.count, self.file = 0, None

    def push(self, symbol: np.ndarray, place: np.ndarray, shared: np.ndarray) -> None:
        """Rising symbols; within one symbol in order of arrival."""
        cut = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(symbol)]):
            self.held[symbol[s]].append((place[s:e], shared[s:e]))
        self.count += len(symbol)
        if self.count > QUEUE_TUPLES:
            self._file()

    def _file(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for symbol, parts in enumerate(self.held):
            if parts:
                n = sum(len(p) for p, _ in parts)
                self.filed[symbol].append((self.file.seek(0, 2), n))
                self.file.write(np.concatenate([p for p, _ in parts]).astype(np.int64).tobytes())
                self.file.write(np.concatenate([x for _, x in parts]).astype(np.uint16).tobytes())
                parts.clear()
        self.count = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the bucket holds now, in order; what arrives meanwhile is left for the next call."""
        filed, held = self.filed[symbol], self.held[symbol]
        self.filed[symbol], self.held[symbol] = [], []
        self.count -= sum(len(p) for p, _ in held)
        for at, n in filed:
            for s in range(0, n, BLOCK):
                m = min(BLOCK, n - s)
                self.file.seek(at + 8 * s)
                place = np.frombuffer(self.file.read(8 * m), dtype=np.int64)
                self.file.seek(at + 8 * n + 2 * s)
                yield place, np.frombuffer(self.file.read(2 * m), dtype=np.uint16)
        if held:
            place, shared = (np.concatenate(x) for x in zip(*held))
            for s in range(0, len(place), BLOCK):
                yield place[s : s + BLOCK], shared[s : s + BLOCK]


class _Minima:
    """Minima of ranges of an array."""

    def __init__(self, values: np.ndarray):
        levels, width = [values], 1
        while 2 * width <= len(values):
            low = levels[-1].copy()
            low[:-width] = np.minimum(low[:-width], levels[-1][width:])
            levels.append(low)
            width *= 2
        self.levels = np.stack(levels)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.levels[k, first], self.levels[k, last - (1 << k) + 1])


class _Scan:
    """One scan over suffixes in order, which puts the predecessors of the wanted type into the queue."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, symbols: int, cap: int):
        self.text, self.small, self.wanted, self.cap = text, small, wanted, cap
        self.queue = BucketQueue(symbols)
        self.least = np.full(symbols, cap, dtype=np.uint16)  # shared by all since the last one put there
        self.fresh = np.ones(symbols, dtype=bool)

    def take(self, place: np.ndarray, shared: np.ndarray) -> None:
        """place: the next suffixes; shared: with the one before each, across calls too."""
        before = place - 1
        put = np.flatnonzero((place > 0) & (self.small[before] == self.wanted))
        if not len(put):
            np.minimum(self.least, shared.min(), out=self.least)
            return
        minima = _Minima(shared)
        symbol = self.text[before[put]].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        put, symbol = put[order], symbol[order]
        first = np.ones(len(put), dtype=bool)
        first[1:] = symbol[1:] != symbol[:-1]
        low = np.zeros(len(put), dtype=np.int64)
        low[1:] = put[:-1] + 1
        low[first] = 0
        value = minima.of(low, put)
        own = symbol[first]
        value[first] = np.minimum(value[first], self.least[own])
        value = np.minimum(value + 1, self.cap).astype(np.uint16)
        value[first] = np.where(self.fresh[own], 0, value[first])
        np.minimum(self.least, shared.min(), out=self.least)
        last = np.append(first[1:], True)
        end = put[last]
        inner = end < len(place) - 1
        rest = np.full(len(end), self.cap, dtype=np.uint16)
        rest[inner] = minima.of(end[inner] + 1, np.full(int(inner.sum()), len(place) - 1))
        self.least[own], self.fresh[own] = rest, False
        self.queue.push(symbol, before[put], value)

    def bucket(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queue's suffixes of one symbol, each taken as it leaves."""
        more = True
        while more:
            more = False
            for place, shared in self.queue.pop(symbol):
                more = True
                self.take(place, shared)
                yield place, shared


def _types(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and how often its first symbol stands at its start (cap at most)."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    sizes = np.diff(np.concatenate(([-1], ends)))
    run = np.minimum(np.repeat(ends, sizes) - np.arange(n) + 1, cap).astype(np.uint16)
    return np.repeat(rising, sizes), run


def _refined(rank: np.ndarray, key: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Ranks, where members of equal rank are told apart by key. A rank is the number of smaller ones.

    members: all of the ranks that more than one has. Returns those that still share a rank."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    # rank and key as one number; a key by its place among the different ones
    both = rank[members[order]] * len(key) + (np.cumsum(new) - 1)
    last = np.argsort(both)
    members, both = members[order[last]], both[last]
    old = both // len(key)
    group = np.ones(len(members), dtype=bool)
    group[1:] = old[1:] != old[:-1]
    new = np.ones(len(members), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    at = np.arange(len(members))
    rank[members] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    alone = new & np.append(new[1:], True)
    return members[~alone]


def _packed(symbols: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The next width symbols at each place and behind the last, each plus one, as one number; 0 where there is none."""
    out = room(len(symbols) + 1, np.uint64)
    out[:] = 0
    for s in range(0, len(symbols), BLOCK):
        part = symbols[s : s + BLOCK + width].astype(np.uint64) + np.uint64(1)
        block = out[s : min(s + BLOCK, len(symbols))]
        for i in range(width):
            block <<= np.uint64(bits)
            block[: max(len(part) - i, 0)] |= part[i : i + len(block)]
    return out


def sorted_leftmost(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int, cap: int) -> np.ndarray:
    """The leftmost S suffixes in order, as far as their first cap symbols tell."""
    m = len(leftmost)
    length = np.append(np.diff(leftmost) + 1, 1)  # with the first symbol of the next substring
    bits = int(2 * symbols + 2).bit_length()
    width = 63 // bits
    typed = text.astype(np.uint32) * 2 + small
    packed = _packed(typed, width, bits)
    rank, members, done = np.zeros(m, dtype=np.int64), np.arange(m), 0
    while len(members) and done <= cap:
        beyond = (np.maximum(width - (length[members] - done), 0) * bits).astype(np.uint64)  # of the next substring
        members = _refined(rank, packed[leftmost[members] + done] >> beyond << beyond, members)
        members = members[length[members] > done + width]
        done += width
    shared = np.bincount(rank, minlength=m)[rank] > 1
    if shared.any():
        names, level = np.unique(rank, return_inverse=True)
        if len(names) <= INDUCE_NAMES and m > 4 * len(names):
            # the sequence of names ends with its one least name, as the text does
            small_names, run = _types(level, cap)
            order = room(m, np.int64)
            at = m
            for place, _ in suffixes(level, len(names), cap, small_names, run):
                at -= len(place)
                order[at : at + len(place)] = place[::-1]
            return leftmost[order]
        members, step = np.flatnonzero(shared), 1
        while len(members) and step < cap:  # a substring has two symbols of its own or more
            ahead = members + step
            key = np.where(ahead < m, rank[np.minimum(ahead, m - 1)] + 1, 0)
            members = _refined(rank, key, members)
            step *= 2
    return leftmost[np.argsort(rank, kind="stable")]


def _shared_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, bits: int) -> np.ndarray:
    """How many symbols the suffixes at a and b share, cap at most."""
    width = 63 // bits
    packed = _packed(text, width, bits)
    out = np.full(len(a), cap, dtype=np.int64)
    active, done = np.arange(len(a)), 0
    while len(active) and done < cap:
        differ = packed[a + done] ^ packed[b + done]
        ends = differ != 0
        last = differ[ends]
        same = np.full(len(last), done)
        for i in range(width):
            same += (last >> np.uint64(bits * (width - 1 - i))) == 0
        out[active[ends]] = same
        a, b, active = a[~ends], b[~ends], active[~ends]
        done += width
    return np.minimum(out, cap)


def suffixes(text: np.ndarray, symbols: int, cap: int, small: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, with the length that each shares with the one before.

    text: numbers below symbols; its last is 0, the least, behind a larger one. The order goes by cap
    symbols at least."""
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = sorted_leftmost(text, small, leftmost, symbols, cap)
    shared = np.zeros(len(order), dtype=np.uint16)
    shared[1:] = _shared_prefixes(text, order[:-1], order[1:], cap, int(symbols).bit_length())
    edges = np.searchsorted(text[order], np.arange(symbols + 1))

    scan = _Scan(text, small, False, symbols, cap)
    large = [(0, 0)] * symbols
    n_large = int(len(text) - small.sum())
    store, store_shared, filled = room(n_large, np.int64), room(n_large, np.uint16), 0
    for symbol in range(symbols):
        start = filled
        for place, common in scan.bucket(symbol):
            store[filled : filled + len(place)], store_shared[filled : filled + len(place)] = place, common
            filled += len(place)
        large[symbol] = (start, filled)
        for s in range(edges[symbol], edges[symbol + 1], BLOCK):
            e = min(s + BLOCK, edges[symbol + 1])
            common = shared[s:e].copy()
            if s == edges[symbol]:
                # behind the last L suffix of the symbol, or a smaller symbol
                common[0] = min(run[store[filled - 1]], run[order[s]]) if filled > start else 0
            scan.take(order[s:e], common)

    scan = _Scan(text, small, True, symbols, cap)
    for symbol in range(symbols - 1, -1, -1):
        last = -1
        for place, common in scan.bucket(symbol):
            last = place[-1]
            yield place, common
        start, end = large[symbol]
        for e in range(end, start, -BLOCK):
            s = max(start, e - BLOCK)
            common = np.empty(e - s, dtype=np.uint16)
            common[1:] = store_shared[s + 1 : e][::-1]
            common[0] = store_shared[e] if e < end else (0 if last < 0 else min(run[last], run[store[e - 1]]))
            place = np.array(store[s:e][::-1])
            scan.take(place, common)
            yield place, common
    # the text's end has no successor to be induced from; it is the least suffix
    yield np.array([len(text) - 1]), np.array([(text[:-1] == 0).any()], dtype=np.uint16)


def repeated_windows(window: int):
    """A finder for with_removed_ranges over bytes."""

    def searched(rows: Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, dtype=np.int64)
        ids, starts, sizes = [none], [none], [none]
        with tempfile.SpooledTemporaryFile(FILE_FROM) as spool:
            for document, start, bodies in rows:
                ids.append(document)
                starts.append(start)
                sizes.append(np.array([len(b) for b in bodies], dtype=np.int64))
                spool.writelines(bodies)
            ids, starts, sizes = map(np.concatenate, (ids, starts, sizes))
            if not len(ids):
                return none, none, none
            offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
            text = room(int(offsets[-1]), np.uint16)
            spool.seek(0)
            text[:] = 0
            for s, n in zip(offsets, sizes):
                text[s : s + n] = np.frombuffer(spool.read(int(n)), dtype=np.uint8).astype(np.uint16) + 1
        different, number = np.unique(ids, return_inverse=True)
        place_key = number.astype(np.int64) << 40 | starts  # order of documents, then places

        out_key: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close(place: np.ndarray, common: np.ndarray) -> None:
            """Whole groups of suffixes that share a window."""
            head = common < window
            head[0] = True
            group = np.cumsum(head) - 1
            many = np.bincount(group)[group] > 1
            place, head = place[many], head[many]
            if len(place):
                body = np.searchsorted(offsets, place, side="right") - 1
                key = place_key[body] + (place - offsets[body])
                whole = place + window <= offsets[body] + sizes[body]
                edge = np.flatnonzero(head)
                least = np.repeat(np.minimum.reduceat(key, edge), np.diff(np.append(edge, len(key))))
                out_key.append(key[whole & (key != least)])

        for place, common in suffixes(text, 257, window, *_types(text, window)):
            cut = np.flatnonzero(common < window)
            if len(cut):
                if held or cut[0]:
                    held.append((place[: cut[0]], common[: cut[0]]))
                    close(*map(np.concatenate, zip(*held)))
                close(place[cut[0] : cut[-1]], common[cut[0] : cut[-1]]) if cut[-1] > cut[0] else None
                held = [(place[cut[-1] :], common[cut[-1] :])]
            else:
                held.append((place, common))
        close(*map(np.concatenate, zip(*held)))
        key = np.sort(np.concatenate(out_key)) if out_key else none
        document = different[key >> 40]
        start = key & ((1 << 40) - 1)
        return merged(document, start, start + window)

    def find(rows: Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with kept_memory():
            return searched(rows)

    return find


def remove_repeats(docs: DataFrame, window: int = 100, k: int | None = None) -> DataFrame:
    """docs with kept (the bytes that stay, binary), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a run of window bytes that covers it also starts earlier, in a smaller doc_id or
    before it in the same text; a null text has no bytes. n_spans: runs of removed bytes that do not
    touch. What rows without doc_id, and rows that repeat one, count as is told at with_removed_ranges.
    Columns of docs with the names of the new ones are replaced."""
    k = k or max(1, window // 3)
    docs = docs.drop("ranges", "kept", *ADDED)
    ranged = with_removed_ranges(docs, "bytes", window, k, repeated_windows(window))
    names = docs.columns
    schema = StructType([*docs.schema, *StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                data, offsets = flat(part["text"])
                row, start, end = range_arrays(part["ranges"])
                raw, size = data.tobytes(), np.diff(offsets)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                kept = []
                for i in range(part.num_rows):
                    s, e = start[edges[i] : edges[i + 1]] + offsets[i], end[edges[i] : edges[i + 1]] + offsets[i]
                    kept.append(b"".join([raw[a:b] for a, b in zip([offsets[i], *e], [*s, offsets[i + 1]])]))
                gone = np.bincount(row, weights=end - start, minlength=part.num_rows).astype(np.int64)
                columns = [*[part[c] for c in names], pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (size, gone, np.diff(edges))], pa.array([hashlib.sha256(b).hexdigest() for b in kept])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "kept", *ADDED])

    return ranged.select(*names, "ranges").mapInArrow(run, schema)
