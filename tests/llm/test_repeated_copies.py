import random

import numpy as np
import pytest

from folium.llm import repeats, suffix_arrays, suffix_trees
from tests.llm.test_repeats import WORD, _removed


def _texts():
    """Half of all rows are copies of one text; a third has one passage."""
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    copied, passage = line(200), line(60)
    return [copied if i % 2 else passage + " " + line(rng.randrange(30)) if i % 3 == 0 else line(80) for i in range(120)]


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_copies_are_removed_whole_without_being_searched(spark, unit):
    texts, window = _texts(), 40 if unit == "bytes" else 12
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    op = suffix_arrays if unit == "bytes" else suffix_trees
    rows = {r["doc_id"]: r["n_removed"] for r in op.remove_repeats(docs, window).collect()}
    parts = [(i, t.encode() if unit == "bytes" else WORD.findall(t)) for i, t in enumerate(texts)]
    assert rows == {i: sum(gone) for i, gone in _removed(parts, window).items()}

    def counted(batches):
        """A finder that finds nothing, but tells how many units it was given."""
        for ids, starts, bodies in batches:
            searched.add(sum(len(b) for b in bodies))
        return repeats.merged(*[np.zeros(0, dtype=np.int64)] * 3)

    searched = spark.sparkContext.accumulator(0)
    repeats.with_removed_ranges(docs, unit, window, window // 3, counted).collect()
    assert 0 < searched.value < len(texts[1]) * 20
