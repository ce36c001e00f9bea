"""Repeated windows of words by prefix-partitioned suffix trees.

The suffixes of a shard are split by their first words: prefixes grow word by word until each holds no
more suffixes than fit in memory. Below each group of prefixes the subtree is built from the top down: a
node's suffixes are dealt out by their next word, single suffixes are leaves and drop out, and what is
still together at the depth of a window hangs below a deep internal node, a repeat of that many words
or more. All its leaves but the earliest start repeated windows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from folium.llm.repeats import SLICE, merged, range_arrays, with_removed_ranges
from folium.llm.words import flat, sliced, word_hashes, words

#: Suffixes whose subtrees are built at once.
GROUP_SUFFIXES = 1 << 16
ADDED = ["kept_text", "n_words", "n_removed", "kept_sha256"]


def _branch(node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by node and next word, and the number of each one's child node; -1 for leaves."""
    order = np.lexsort((symbol, node))
    a, b = node[order], symbol[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    child = np.cumsum(new) - 1
    alone = np.bincount(child)[child] == 1 if len(child) else np.zeros(0, dtype=bool)
    return order, np.where(alone, -1, child)


def prefix_groups(symbols: np.ndarray, suffixes: np.ndarray, depth: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of prefix, node, suffixes): sets of whole prefixes with at most limit suffixes in all. A prefix
    with more is split by one word more; at depth words it is given out whole, as it is one repeat then."""
    waiting = [(0, suffixes)]
    while waiting:
        length, held = waiting.pop()
        if len(held) <= limit or length == depth:
            yield length, np.zeros(len(held), dtype=np.int64), held
            continue
        order, child = _branch(np.zeros(len(held), dtype=np.int64), symbols[held + length])
        held, child = held[order][child >= 0], child[child >= 0]
        edges = np.append(np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1]))), len(child)) if len(child) else np.zeros(1, dtype=np.int64)
        begin = 0
        for i in range(1, len(edges)):
            # prefixes that fit together go together
            if i + 1 == len(edges) or edges[i + 1] - edges[begin] > limit:
                if i == begin + 1:
                    waiting.append((length + 1, held[edges[begin] : edges[i]]))
                else:
                    yield length + 1, child[edges[begin] : edges[i]], held[edges[begin] : edges[i]]
                begin = i


def deep_nodes(symbols: np.ndarray, suffixes: np.ndarray, depth: int, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, suffix) pairs: the leaves below internal nodes at depth words or deeper."""
    for length, node, held in prefix_groups(symbols, suffixes, depth, limit or GROUP_SUFFIXES):
        while length < depth and len(held):
            order, child = _branch(node, symbols[held + length])
            held, node = held[order][child >= 0], child[child >= 0]
            length += 1
        if len(held) > 1:
            yield node, held


def repeated_windows(window: int):
    """A finder for with_removed_ranges over words."""

    def find(rows: Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        symbols, place, document, inside = [], [], [], []
        for ids, starts, bodies in rows:
            data, offsets = flat(pa.array(bodies, pa.binary()))
            first, last, of_words = words(data, offsets)
            sizes = np.diff(of_words)
            symbols.append(word_hashes(data, first, last))
            index = np.arange(len(first)) - np.repeat(of_words[:-1], sizes)
            place.append(np.repeat(starts, sizes) + index)
            document.append(np.repeat(ids, sizes))
            inside.append(np.repeat(sizes, sizes) - index >= window)
        none = np.zeros(0, dtype=np.int64)
        if not symbols:
            return none, none, none
        symbols, place, document, inside = map(np.concatenate, (symbols, place, document, inside))
        _, names = np.unique(symbols, return_inverse=True)
        out_document, out_start = [], []
        for node, leaf in deep_nodes(names, np.flatnonzero(inside), window):
            order = np.lexsort((place[leaf], document[leaf], node))
            node, leaf = node[order], leaf[order]
            edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            earliest = np.repeat(leaf[edge], np.diff(np.append(edge, len(node))))
            # stretches of two homes may overlap: the earliest window may be here twice
            later = (document[leaf] != document[earliest]) | (place[leaf] != place[earliest])
            out_document.append(document[leaf[later]])
            out_start.append(place[leaf[later]])
        if not out_start:
            return none, none, none
        start = np.concatenate(out_start)
        return merged(np.concatenate(out_document), start, start + window)

    return find


def remove_repeats(docs: DataFrame, window: int = 50, k: int | None = None, layout: bool = False) -> DataFrame:
    """docs with kept_text (the kept words joined by a space), n_words, n_removed, kept_sha256. With layout,
    kept_text is the text without the removed words and the gaps before them, so lines stay lines.

    A word goes if a run of window words that covers it also starts earlier, in a smaller doc_id or
    before it in the same text; a null text has no words. The order of rows without doc_id and of rows
    that repeat one is told at with_removed_ranges. Columns of docs with the names of ADDED are replaced."""
    k = k or max(1, window * 2 // 5)
    docs = docs.drop("ranges", *ADDED)
    ranged = with_removed_ranges(docs, "words", window, k, repeated_windows(window))
    names = docs.columns
    schema = StructType([*docs.schema, *StructType.fromDDL("kept_text string, n_words long, n_removed long, kept_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, limit=SLICE):
                data, offsets = flat(part["text"])
                first, last, of_words = words(data, offsets)
                row, start, end = range_arrays(part["ranges"])
                gone = np.zeros(len(first) + 1, dtype=np.int64)
                np.add.at(gone, of_words[row] + start, 1)
                np.add.at(gone, of_words[row] + end, -1)
                kept = np.cumsum(gone)[:-1] == 0
                raw = data.tobytes()
                texts = [b" ".join([raw[s:e] for s, e in zip(first[a:b][kept[a:b]], last[a:b][kept[a:b]])]) for a, b in zip(of_words, of_words[1:])]
                digests = [hashlib.sha256(t).hexdigest() for t in texts]
                if layout:
                    texts = []
                    edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                    for i in range(part.num_rows):
                        a, b = of_words[i] + start[edges[i] : edges[i + 1]], of_words[i] + end[edges[i] : edges[i + 1]]
                        cut = np.where(a > of_words[i], last[a - 1], first[a]) if len(a) else a
                        upto = last[b - 1] if len(b) else b
                        texts.append(b"".join([raw[s:e] for s, e in zip([offsets[i], *upto], [*cut, offsets[i + 1]])]))
                n_words = np.diff(of_words)
                n_kept = np.array([kept[a:b].sum() for a, b in zip(of_words, of_words[1:])], dtype=np.int64)
                columns = [*[part[c] for c in names], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *ADDED])

    return ranged.select(*names, "ranges").mapInArrow(run, schema)
