"""Batches of whole texts as flat byte arrays, their words, and 64-bit hashes of any stretch of them.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo 2**64 over
fixed random keys, finished by a mixer: two different stretches share one with probability about
2**-64, so equal hashes are taken as equal content wherever a caller says so.
"""

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are worked on in slices of about so many bytes, to bound the memory of a task.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_libc = ctypes.CDLL(None)
_trim = getattr(_libc, "malloc_trim", None)
#: Arrays of a MB or more stand in memory of their own, which goes back to the system when they go. Each takes its
#: pages anew, which costs more time than most of what is done with them.
OWN_MEMORY = 1 << 20
_set = getattr(_libc, "mallopt", lambda *_: 0)
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1
_set(_MMAP_THRESHOLD, OWN_MEMORY)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on, and the next stage should not pay for this one."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


@contextmanager
def kept_memory() -> Iterator[None]:
    """Within, freed arrays up to 32 MB leave their memory to the next ones; all is given back at the end."""
    _set(_MMAP_THRESHOLD, 32 << 20)
    _set(_TRIM_THRESHOLD, 256 << 20)
    try:
        yield
    finally:
        _set(_MMAP_THRESHOLD, OWN_MEMORY)
        _set(_TRIM_THRESHOLD, 128 << 10)
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * U64(pow(base, done, 1 << 64))
        done += m
    return out


_up, _down = _powers(_BASE, 1), _powers(_INVERSE, 1)
#: Powers for sequences of so many values stay in each Python worker; those for longer ones go with them.
KEPT_POWERS = 1 << 20


class Stretches:
    """Hashes of stretches [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        global _up, _down
        n = len(values) + 1
        up, down = _up, _down
        if len(up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            up, down = _powers(_BASE, size), _powers(_INVERSE, size)
            if size <= KEPT_POWERS:
                _up, _down = up, down
        self.sums = np.zeros(n, dtype=U64)
        np.cumsum(values * up[: n - 1], out=self.sums[1:])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= self.down[start]
        return mix(out)

    def grams(self, k: int) -> np.ndarray:
        """Of every stretch of k values, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        out = self.sums[k:] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each; a longer text is a run by itself."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n + 1 offsets of the documents' words."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = SPACE[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    first[1:] = gap[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = True
    first &= ~gap
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[bounds[bounds > 0] - 1] = True
    last &= ~gap
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Stretches(BYTE_KEYS[data]).of(starts, ends)


def document_of(offsets: np.ndarray) -> np.ndarray:
    """The document of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values within each document."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
