import random
import re

import numpy as np

from folium.llm import components, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _components(texts, k, limit):
    sets = [_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= limit * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def _texts():
    rng = random.Random(8)
    out = ["", None, "one", "One", "two words", " \n ", "two  words"]
    for _ in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(900)}"
            out.append(" ".join(copy))
    return out


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)  # groups of several blocks
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component string").repartition(4)
    for k, limit in ((3, 85), (5, 80)):
        want, sizes = _components(texts, k, limit)
        rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, k, limit).collect()}
        assert [rows[i]["component_id"] for i in range(len(texts))] == want
        assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(rows[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_null_and_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(None, None, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    same = rng.random((400, near_dedup.SAMPLES)) < 0.9
    a = rng.integers(0, 1 << 63, (400, near_dedup.SAMPLES), dtype=np.uint64)
    b = np.where(same, a, rng.integers(0, 1 << 63, a.shape, dtype=np.uint64))
    found = near_dedup.estimated_similarity(near_dedup.odd_sketches(a), near_dedup.odd_sketches(b))
    assert abs(found.mean() - 0.9) < 0.01 and np.abs(found - same.mean(1)).max() < 0.08


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 1 for i in range(1, 61)} | {100: 100} | {200 + i: 100 for i in range(30)}
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
