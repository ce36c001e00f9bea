"""What a worker holds while it looks for repeats, and afterwards."""

import numpy as np

from folium.llm import repeats, words


def test_a_finder_is_given_bodies_in_slices(spark):
    """A shard's stretches come in one batch; its bodies reach the finder in slices, as arrays over them are large."""
    texts = [" ".join(f"{side}{i}x{j}" for j in range(30)) + " " + " ".join(f"p{i}y{j}" for j in range(150)) for i in range(200) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    limit = repeats.SLICE

    def find(rows):
        sizes = [(ids, sum(map(len, bodies)), max(map(len, bodies))) for ids, _, bodies in rows]
        assert all(held <= max(limit, longest) for _, held, longest in sizes)
        ids = np.unique(np.concatenate([x[0] for x in sizes]))
        return ids, np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=np.int64)

    rows = repeats.with_removed_ranges(docs, "words", 50, 20, find).collect()
    assert sum(map(len, texts)) > 4 * limit and all(len(r["ranges"]) == 1 for r in rows)


def test_powers_for_long_texts_do_not_stay():
    n = words.KEPT_POWERS + 5
    values = np.arange(n, dtype=np.uint64)
    long, short = words.Stretches(values), words.Stretches(values[-100:])
    assert len(words._up) <= words.KEPT_POWERS and len(words._down) <= words.KEPT_POWERS
    assert (long.grams(7)[-94:] == short.grams(7)).all()
    assert long.of(np.array([n - 50]), np.array([n])) == short.of(np.array([50]), np.array([100]))
