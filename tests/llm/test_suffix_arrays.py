import numpy as np
import pytest

from folium.llm import repeats, suffix_arrays, words


def _shared(a, b, cap):
    n = 0
    while n < cap and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("names", [0, 4096])
@pytest.mark.parametrize("small", [False, True])
def test_all_suffixes_in_order_with_shared_prefixes(monkeypatch, names, small):
    monkeypatch.setattr(suffix_arrays, "INDUCE_NAMES", names)
    if small:  # many blocks, and a queue that spills to its file
        monkeypatch.setattr(suffix_arrays, "BLOCK", 3)
        monkeypatch.setattr(suffix_arrays, "QUEUE_TUPLES", 4)
    rng = np.random.default_rng(names + small)
    for trial in range(60):
        kinds, n, cap = int(rng.integers(2, 6)), int(rng.integers(3, 60)), int(rng.integers(3, 30))
        text = rng.integers(1, kinds + 1, n)
        if trial % 3 == 0:
            text = np.tile(text[: max(1, n // 6)], 6)
        if trial % 4 == 0:
            text[rng.integers(0, len(text), 3)] = 0
        text[-1] = max(text[-1], 1)
        text = np.append(text, 0).astype(np.uint16)
        found = list(suffix_arrays.suffixes(text, kinds + 1, cap, *suffix_arrays._types(text, cap)))
        place, shared = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])
        whole = text.tolist()
        assert sorted(place.tolist()) == list(range(len(whole)))
        for i in range(len(place) - 1):
            a, b = whole[place[i] :], whole[place[i + 1] :]
            assert shared[i + 1] == _shared(a, b, cap)
            assert shared[i + 1] == cap or a > b


def test_arrays_and_queues_beyond_memory_stand_in_files(monkeypatch):
    monkeypatch.setattr(suffix_arrays, "FILE_FROM", 8)
    monkeypatch.setattr(suffix_arrays, "QUEUE_TUPLES", 2)
    find = suffix_arrays.repeated_windows(4)
    rows = [(np.array([1, 2]), np.array([0, 5]), [b"abcdefgh", b"xxbcdefgh"])]
    document, start, end = find(iter(rows))
    assert list(zip(document.tolist(), start.tolist(), end.tolist())) == [(2, 7, 14)]


def test_a_shard_of_the_usual_size_is_sorted_through_files(monkeypatch):
    """With the constants as they are: the queues write to files and the arrays stand in files."""
    spilled, filed = [], []
    file_, room = suffix_arrays.BucketQueue._file, suffix_arrays.room
    monkeypatch.setattr(suffix_arrays.BucketQueue, "_file", lambda self: spilled.append(self.count) or file_(self))
    monkeypatch.setattr(suffix_arrays, "room", lambda n, kind: filed.append(n * np.dtype(kind).itemsize > suffix_arrays.FILE_FROM) or room(n, kind))
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(3000)]
    body = " ".join(rng.choice(words, 400_000)).encode()[: repeats.SHARD_UNITS["bytes"] - 1000]
    bodies = [body, b"x" + body[5000:6000]]
    document, start, end = suffix_arrays.repeated_windows(100)(iter([(np.array([1, 2]), np.array([0, 0]), bodies)]))
    assert list(zip(document.tolist(), start.tolist(), end.tolist())) == [(2, 1, 1001)]
    assert spilled and any(filed)


def test_symbols_are_packed_once_however_long_the_shared_prefixes(monkeypatch):
    packed, numbers = suffix_arrays._packed, []
    monkeypatch.setattr(suffix_arrays, "_packed", lambda *a: numbers.append(len(out := packed(*a))) or out)
    body = bytes(np.random.default_rng(2).integers(97, 123, 3000, dtype=np.uint8))
    document, start, end = suffix_arrays.repeated_windows(100)(iter([(np.arange(4), np.zeros(4, dtype=np.int64), [body] * 4)]))
    assert list(zip(document.tolist(), start.tolist(), end.tolist())) == [(i, 0, 3000) for i in (1, 2, 3)]
    assert sum(numbers) <= 3 * (4 * 3001 + 1)  # the names between leftmost suffixes are packed too


@pytest.mark.parametrize("kind", [np.uint16, np.int64])
def test_packed_symbols_across_blocks_and_behind_the_end(monkeypatch, kind):
    monkeypatch.setattr(suffix_arrays, "BLOCK", 5)
    text = np.random.default_rng(3).integers(0, 257, 23).astype(kind)
    for width in (1, 3, 7):
        want = [sum(int(x + 1) << 9 * (width - 1 - j) for j, x in enumerate(text[i : i + width].tolist())) for i in range(24)]
        assert suffix_arrays._packed(text, width, 9).tolist() == want


def test_arrays_of_a_slice_need_no_memory_of_their_own():
    assert 8 * (repeats.SLICE + 1) < words.OWN_MEMORY
