import hashlib
import json
import random

import pytest
import regex
from tokenizers import Tokenizer

from folium.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"
PARTS = ["a", "The", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "é", "中", "1", "²", "'s", "'ll", "!", "#", "😀", "́", "<|endoftext|>", "<|end", "ing", "tion", "\x00"]


def _texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_and_text_equal_the_library(spark):
    known = Tokenizer.from_file(PATH)
    texts = ["", None, "x" * 3000, "ab " * 5000, *_texts(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in bpe.encode(docs, PATH, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = known.encode(text or "", add_special_tokens=False).ids
        back = known.decode(ids, skip_special_tokens=False)
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = bpe.encode(docs, PATH).collect()
    assert len(rows) == 3 and len({r["ids_sha256"] for r in rows}) == 1
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def _content():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def _equal_to_the_library(encoder, slices):
    known = Tokenizer.from_file(PATH)
    for texts in slices:
        for text, (joined, data) in zip(texts, encoder.encode(texts), strict=True):
            ids = known.encode(text, add_special_tokens=False).ids
            assert joined == ",".join(map(str, ids)) and data.decode("utf-8", "replace") == known.decode(ids, skip_special_tokens=False)


def _words(n, syllables, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(["the", "ing", "an", "ti", "on", "er", "é", "ö", "中", "ción", "q", "Z"], k=syllables)) for _ in range(n)]


def test_new_words_cost_no_merges_of_every_pair(monkeypatch):
    """half of the time that new pieces took went into merging the bytes of pairs of tokens anew."""
    merged, calls = bpe.PrefixEncoder.merged, []
    monkeypatch.setattr(bpe.PrefixEncoder, "merged", lambda self, data: calls.append(data) or merged(self, data))
    encoder = bpe.PrefixEncoder(_content())
    _equal_to_the_library(encoder, [[" ".join(_words(3000, 5))]])
    assert len(calls) == len(set(calls)) and all(data in encoder.ids for data in calls)


def test_pieces_that_come_again_stay_and_long_ones_go(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 200)
    encoded, encode_piece = [], bpe.PrefixEncoder.encode_piece
    monkeypatch.setattr(bpe.PrefixEncoder, "encode_piece", lambda self, piece: encoded.append(piece) or encode_piece(self, piece))
    encoder, rare = bpe.PrefixEncoder(_content()), iter(_words(2000, 6))
    slices = [[f"often {' '.join(next(rare) for _ in range(40))}", "x" * 2000 + "<|endoftext|> 😀" + "中" * 30] for _ in range(40)]
    _equal_to_the_library(encoder, slices)
    assert encoded.count(b"often") == 1 and encoded.count(b"x" * 2000) == 40
    assert len(encoder.kept.number) + len(encoder.kept_before.number) < 300
    assert max(len(p.encode()) for k in (encoder.kept, encoder.kept_before) for p in k.number) <= bpe.KEPT_BYTES


def test_pieces_at_once_and_one_by_one():
    encoder = bpe.PrefixEncoder(_content())
    _equal_to_the_library(encoder, [[" ".join(_words(300, n, seed=n)), "\x00 \x00\x00 a\x00 a"] for n in (1, 2, 5, 12, 40, 90, 200)])
    pieces = sorted({w.encode() for n in (1, 2, 5) for w in _words(300, n)} | {b"a", b"a\0", b"a\0\0", b"\0"})
    ids, counts = encoder.encode_pieces(pieces)
    ids = iter(ids.tolist())
    assert [[next(ids) for _ in range(n)] for n in counts] == [encoder.encode_piece(p) for p in pieces]


def test_pairs_as_merging_their_bytes_tells():
    encoder, rng = bpe.PrefixEncoder(_content()), random.Random(6)
    runs = [i for b, i in encoder.ids.items() if len(set(b)) <= 2 and len(b) < 9]
    every = list(encoder.ids.values())
    for pool in (runs, every):
        for _ in range(5000):
            left, right = rng.choice(pool), rng.choice(pool)
            whole = [encoder.bytes[left], encoder.bytes[right]]
            assert encoder.compatible(left, right) == (encoder.merged(b"".join(whole)) == whole)


def test_merges_out_of_order_are_noticed():
    spec = json.loads(_content())
    assert bpe.PrefixEncoder(json.dumps(spec)).in_order
    spec["model"]["merges"].reverse()
    encoder = bpe.PrefixEncoder(json.dumps(spec))
    assert not encoder.in_order
    left, right = encoder.ids[b"t"], encoder.ids[b"h"]
    assert not encoder.compatible(left, right) and encoder.compatible(right, left) == (encoder.merged(b"ht") == [b"h", b"t"])


def test_a_byte_without_a_token_stops_and_leaves_nothing_behind():
    spec = json.loads(_content())
    del spec["model"]["vocab"]["q"]
    encoder = bpe.PrefixEncoder(json.dumps(spec))
    with pytest.raises(ValueError, match="lacks a byte"):
        list(encoder.encode(["a b", "c zq"]))
    with pytest.raises(ValueError, match="lacks a byte"):
        list(encoder.encode([" ".join(_words(500, 4))]))
    assert [data for _, data in encoder.encode(["a b", "c z"])] == [b"a b", b"c z"]


def test_both_patterns_cut_alike():
    whole, plain = regex.compile(bpe.PIECES), bpe.plain_pieces()
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for between in ("", " ", "a", " a", "1 ", "\n", "'", "'s", "'ll ", "!  "):
        text = between.join(chars)
        assert whole.findall(text) == plain.findall(text)
