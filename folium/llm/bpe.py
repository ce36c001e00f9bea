"""Byte-level BPE by dynamic programming over prefixes.

A sequence of tokens is what BPE gives for its bytes exactly if every two neighbours are what BPE
gives for their own bytes. So every prefix of a piece has one last token: among the tokens that the
prefix ends with, the one that is compatible with the last token of what lies before it. An automaton
finds the tokens that end at each byte; lengths of last tokens lead back from the end of the piece to its ids.
New pieces go many at once, their different prefixes of one length in one step.
"""

import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folium.llm.words import sliced

#: The pattern that splits a text before byte-level BPE.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: So many different pieces are kept encoded in each Python worker, some 300 bytes each; those that do not come again go.
KEPT_PIECES = 200_000
#: Pieces of more bytes are not kept.
KEPT_BYTES = 64
#: Pieces of about one length are encoded at once if there are so many, up to so many bytes of them; the others, and
#: those that are longer than that, one by one.
STEP_LEAST, STEP_BYTES, STEP_LENGTH = 64, 1 << 19, 1 << 10
#: 2 to this power tested pairs of tokens are kept, 8 bytes each.
PAIR_BITS = 20
PLACES = 0x9E3779B97F4A7C15
NO_TOKEN = "the vocabulary lacks a byte of the text, or its merges are not those of BPE"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for those from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_pieces() -> re.Pattern:
    """PIECES for texts without characters above U+FFFF, with its classes spelt out for the re module, which is faster;
    all that begins with a letter or number comes first."""
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, space = ("".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(kind + "+", chars)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Endings:
    """An automaton (Aho-Corasick) that tells the tokens that a text ends with. Its state, from 0 on, is a beginning
    of tokens; the longest token that ends there is longest[state], the next shorter one shorter[token], -1 for none.
    Ways lie sorted by 256 * state + byte; where a state has none for a byte, that of back[state] holds."""

    def __init__(self, tokens: dict[bytes, int], size: int):
        states = sorted({token[:k] for token in tokens for k in range(len(token) + 1)} | {b""}, key=len)
        number = {state: n for n, state in enumerate(states)}
        above = np.array([number[state[:-1]] for state in states])
        byte = np.array([state[-1] if state else 0 for state in states])
        own = np.array([tokens.get(state, -1) for state in states])
        ways = 256 * above[1:] + byte[1:]
        order = np.argsort(ways)
        self.ways, self.to = np.append(ways[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        self.way_list = self.ways.tolist()
        self.back = np.zeros(len(states), dtype=np.int64)
        self.longest, self.shorter = np.full(len(states), -1), np.full(size, -1)
        levels = np.searchsorted([len(state) for state in states], np.arange(1, len(states[-1]) + 2))
        for a, b in pairwise(levels.tolist()):
            back = np.where(above[a:b] > 0, self.after(self.back[above[a:b]], byte[a:b]), 0)
            self.back[a:b], token = back, own[a:b] >= 0
            self.longest[a:b] = np.where(token, own[a:b], self.longest[back])
            self.shorter[own[a:b][token]] = self.longest[back[token]]

    def after(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after a byte each."""
        found, todo = np.zeros(len(states), dtype=np.int64), np.arange(len(states))
        while len(todo):
            way = 256 * states + byte[todo]
            at = np.searchsorted(self.ways, way)
            there = self.ways[at] == way
            found[todo[there]] = self.to[at[there]]
            further = ~there & (states > 0)
            todo, states = todo[further], self.back[states[further]]
        return found

    def after_one(self, state: int, byte: int) -> int:
        while self.way_list[at := bisect_left(self.way_list, 256 * state + byte)] != 256 * state + byte:
            if state == 0:
                return 0
            state = self.back.item(state)
        return self.to.item(at)


class Kept:
    """Encoded pieces by number: ids in decimal, joined by commas, and the bytes that they decode to."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.ids: list[str] = []
        self.data: list[bytes] = []


class PrefixEncoder:
    """Encodes and decodes by the contents of a tokenizer file (JSON with model.vocab, model.merges, added_tokens)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        byte = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.rank = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[bytes(byte[c] for c in left), bytes(byte[c] for c in right)] = n
        self.split, self.plain_split = regex.compile(PIECES), plain_pieces()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Before a piece's first token stands this number, which is no token's.
        self.size = max(self.bytes) + 1
        self.lengths = np.zeros(self.size, dtype=np.int64)
        self.lengths[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.endings = Endings(self.ids, self.size)
        self._halve()
        self.whole: dict[int, bool] = {}
        #: At its place each tested pair, as 2 * (left * (size + 1) + right) + fits; one that takes its place drives it out.
        self.pairs = np.full(1 << PAIR_BITS, -2, dtype=np.int64)
        self.decimals = [str(i) for i in range(self.size)]
        self.kept, self.kept_before = Kept(), Kept()

    def _halve(self) -> None:
        """The two tokens that each is merged from, and by which merge (-1: a byte). in_order: every token is made by
        one merge, of tokens made before it, as in any list that was learnt; merges then go by rising rank."""
        self.made, self.halves, self.joint = [-1] * self.size, [(0, 0)] * self.size, {}
        self.in_order = True
        for (left, right), n in self.rank.items():
            a, b, both = (self.ids.get(x, -1) for x in (left, right, left + right))
            if min(a, b, both) < 0 or self.made[both] >= 0 or any(len(x) > 1 and self.made[i] < 0 for x, i in ((left, a), (right, b))):
                self.in_order = False
                break
            self.made[both], self.halves[both], self.joint[a * self.size + b] = n, (a, b), n

    def merged(self, data: bytes) -> list[bytes]:
        """What the merges make of some bytes, lowest rank first; used on two tokens at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merged(self.bytes[token]) == [self.bytes[token]]
        return self.whole[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay as they are side by side. Their merges along the seam are undone from the last on;
        none of the pairs that then meet there may have been merged before the merge that was undone."""
        if left == self.size:
            return self.reachable(right)
        if not self.in_order:
            return self.merged(self.bytes[left] + self.bytes[right]) == [self.bytes[left], self.bytes[right]]
        if not self.reachable(right):
            return False
        limit = never = len(self.rank)
        while self.joint.get(left * self.size + right, never) >= limit:
            a, b = self.made[left], self.made[right]
            if a > b:
                limit, left = a, self.halves[left][1]
            elif b >= 0:
                limit, right = b + 1, self.halves[right][0]
            else:
                return True
        return False

    def compatible_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for many pairs."""
        pairs = left.astype(np.int64) * (self.size + 1) + right
        place = _places(pairs)
        known = self.pairs[place]
        fits, new = (known & 1).astype(bool), (known >> 1) != pairs
        if new.any():
            tested, which = np.unique(pairs[new], return_inverse=True)
            found = np.array([self.compatible(*divmod(pair, self.size + 1)) for pair in tested.tolist()])
            self.pairs[_places(tested)] = 2 * tested + found
            fits[new] = found[which]
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix first, then back from the end."""
        after, longest, shorter = self.endings.after_one, self.endings.longest.item, self.endings.shorter.item
        pairs, lengths = self.pairs, self.lengths.item
        last, state = [self.size], 0
        for end, byte in enumerate(piece, 1):
            state = after(state, byte)
            token = longest(state)
            while True:
                if token < 0:
                    raise ValueError(NO_TOKEN)
                left = last[end - lengths(token)]
                pair = left * (self.size + 1) + token
                place = (pair * PLACES & (1 << 64) - 1) >> 64 - PAIR_BITS
                known = pairs.item(place)
                if known >> 1 != pair:
                    known = pairs[place] = 2 * pair + self.compatible(left, token)
                if known & 1:
                    break
                token = shorter(token)
            last.append(token)
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= lengths(last[at])
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted pieces in turn, and how many each has: as encode_piece, by prefixes of one length at a time.
        A prefix that the piece before has too is not encoded again."""
        longest, shorter = self.endings.longest, self.endings.shorter
        size = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
        most = int(size.max())
        data = np.frombuffer(b"".join([p.ljust(most, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, most)
        differs = np.ones(data.shape, dtype=bool)
        differs[1:, :-1] = data[1:, :-1] != data[:-1, :-1]
        differs[0] = True
        shared = differs.argmax(axis=1)
        shared[1:] = np.minimum(shared[1:], size[:-1])
        data = np.ascontiguousarray(data.T)
        last = np.full((most + 1, len(pieces)), self.size, dtype=np.int32)
        rows, state = np.arange(len(pieces)), np.zeros(len(pieces), dtype=np.int64)
        for end in range(1, most + 1):
            still = size[rows] >= end
            rows, state = rows[still], state[still]
            new = shared[rows] < end
            heads = rows[new]
            states = self.endings.after(state[new], data[end - 1][heads])
            token = longest[states]
            todo = np.arange(len(heads))
            while len(todo):
                tried = token[todo]
                if tried.min() < 0:
                    raise ValueError(NO_TOKEN)
                todo = todo[~self.compatible_pairs(last[end - self.lengths[tried], heads[todo]], tried)]
                token[todo] = shorter[token[todo]]
            spread = np.cumsum(new) - 1
            state, last[end, rows] = states[spread], token[spread]
        taken = np.zeros((len(pieces), most + 1), dtype=bool)
        rows, at = np.arange(len(pieces)), size
        while len(rows):
            taken[rows, at] = True
            at = at - self.lengths[last[at, rows]]
            rows, at = rows[at > 0], at[at > 0]
        return last.T[taken], taken.sum(axis=1)

    def _as_text(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join([self.decimals[i] for i in ids]), b"".join([self.bytes[i] for i in ids])

    def _keep(self, kept: Kept, new: list[str]) -> list[str]:
        """Encodes the pieces that were numbered last; tells those that are too long to stay."""
        before, alike, long = self.kept_before, defaultdict(list), []
        first = len(kept.ids)
        kept.ids += [""] * len(new)
        kept.data += [b""] * len(new)
        for n, piece in enumerate(new, first):
            if piece in before.number:
                known = before.number[piece]
                kept.ids[n], kept.data[n] = before.ids[known], before.data[known]
            elif piece in self.added:
                kept.ids[n], kept.data[n] = self._as_text([self.added[piece]])
            else:
                data = piece.encode("utf-8", "surrogatepass")
                if len(data) > KEPT_BYTES:
                    long.append(piece)
                alike[max(5, len(data).bit_length())].append((data, n))
        for bits, found in alike.items():
            if len(found) < STEP_LEAST or 1 << bits > STEP_LENGTH:
                for data, n in found:
                    kept.ids[n], kept.data[n] = self._as_text(self.encode_piece(data))
                continue
            found.sort()
            for at in range(0, len(found), STEP_BYTES >> bits):
                data, numbers = zip(*found[at : at + (STEP_BYTES >> bits)])
                ids, counts = self.encode_pieces(data)
                ids, edges = ids.tolist(), [0, *np.cumsum(counts).tolist()]
                for n, (a, b) in zip(numbers, pairwise(edges)):
                    kept.ids[n], kept.data[n] = self._as_text(ids[a:b])
        return long

    def pieces(self, text: str) -> list[str]:
        if not any(token in text for token in self.added):
            plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
            return (self.plain_split if plain else self.split).findall(text)
        return list(chain.from_iterable([part] if part in self.added else self.split.findall(part) for part in self.special.split(text)))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by commas, and the bytes that they decode to."""
        if len(self.kept.ids) >= KEPT_PIECES // 2:
            self.kept, self.kept_before = Kept(), self.kept
        kept, self.kept = self.kept, Kept()  # an error on the way leaves nothing half done
        number, ids, data = kept.number, kept.ids, kept.data
        known = len(number)
        cut = [[number[piece] for piece in self.pieces(text)] for text in texts]
        long = self._keep(kept, [*islice(reversed(number), len(number) - known)][::-1])
        self.kept = kept
        try:
            for pieces in cut:
                yield ",".join([ids[n] for n in pieces]), b"".join([data[n] for n in pieces])
        finally:
            for piece in long:
                n = number.pop(piece)
                ids[n], data[n] = "", b""


def _places(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(PLACES)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


_encoders: dict[str, PrefixEncoder] = {}


def encoder(content: str) -> PrefixEncoder:
    """One encoder for each Python worker and file."""
    name = hashlib.sha256(content.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = PrefixEncoder(content)
    return _encoders[name]


def encode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, of every row.

    tokenizer: path of the tokenizer file, read on the driver (a vocabulary of fixed size) and broadcast.
    A null text is an empty one: no ids, and the hash of nothing. Repeated rows stay repeated."""
    with open(tokenizer, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        for batch in batches:
            for part in sliced(batch):
                counts, hashes, decoded, ids = [], [], [], [np.zeros(0, dtype=np.int32)]
                for joined, data in bpe.encode([text or "" for text in part["text"].to_pylist()]):
                    counts.append(joined.count(",") + bool(joined))
                    hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids and joined:
                        ids.append(np.fromiter(map(int, joined.split(",")), dtype=np.int32, count=counts[-1]))
                columns = [part["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    edges = np.cumsum([0, *counts], dtype=np.int32)
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
