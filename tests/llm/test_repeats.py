import hashlib
import random
import re

import numpy as np

from folium.llm import repeats, suffix_arrays, suffix_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _removed(units_by_doc, window):
    """Plain Python: which units a window covers that starts earlier too, documents in order."""
    seen, out = set(), {}
    for key, units in units_by_doc:
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            gram = tuple(units[i : i + window]) if isinstance(units, list) else units[i : i + window]
            if gram in seen:
                gone[i : i + window] = [True] * window
            seen.add(gram)
        out[key] = gone
    return out


def _corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "==="]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts + ["", None, "a " * 400, "b" * 700, "b" * 650, texts[3], texts[3], "short"]


def test_bytes(spark):
    texts, window = _corpus(), 30
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in suffix_arrays.remove_repeats(docs, window).collect()}
    raw = [(i * 3, (t or "").encode()) for i, t in enumerate(texts)]
    for (key, data), gone in zip(raw, _removed(raw, window).values()):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        r = rows[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(gone), spans)
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_words(spark, monkeypatch):
    monkeypatch.setattr(suffix_trees, "GROUP_SUFFIXES", 50)  # prefixes of several lengths
    texts, window = _corpus(), 12
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(5)
    rows = {r["doc_id"]: r for r in suffix_trees.remove_repeats(docs, window).collect()}
    words = [(i * 3, WORD.findall(t or "")) for i, t in enumerate(texts)]
    for (key, found), gone in zip(words, _removed(words, window).values()):
        kept = " ".join(w for w, g in zip(found, gone) if not g)
        r = rows[key]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(found), sum(gone), kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_rows_without_id_and_repeated_ids(spark):
    long = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long), (7, long), (7, long), (7, "other " + long), (8, long)], "doc_id long, text string")
    rows = suffix_trees.remove_repeats(docs, 10).collect()
    assert len(rows) == 5
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows)
    # the two equal rows of id 7 are one document; one of the two texts of id 7 comes first
    assert removed[3] == (False, 8, 40, 40) and removed[4] == (True, 0, 40, 40)
    assert {x[3] for x in removed[:3]} in ({0, 40}, {0}) and removed[0][3] == removed[1][3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_trees.remove_repeats(docs, 5).count() == 0
    assert suffix_arrays.remove_repeats(docs, 5).count() == 0


def test_a_shard_of_the_usual_size_is_split_by_prefixes():
    """With the constants as they are: prefixes of one word and more, none of them with too many suffixes."""
    rng = np.random.default_rng(0)
    n = repeats.SHARD_UNITS["words"]
    names = np.where(rng.random(n) < 0.3, 0, rng.zipf(1.3, n) % 20_000)
    groups = list(suffix_trees.prefix_groups(names, np.arange(n - 20), 20, suffix_trees.GROUP_SUFFIXES))
    assert len(groups) > 4 and max(length for length, _, _ in groups) > 1
    assert all(len(held) <= suffix_trees.GROUP_SUFFIXES for _, _, held in groups)
