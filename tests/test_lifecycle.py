import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.functions import text
from folium.operators import embedding, events, extraction
from folium.sources import assembly, snapshots

FILE = "hash string, source_name string, descriptor string, text string, ord int"


def test_stored_library_follows_random_edits(spark, tmp_path):
    rng, root, state = random.Random(2), f"file://{tmp_path}", {}
    for turn in range(1, 7):
        for _ in range(8):  # add, modify, delete, none
            name, what = f"f{rng.randrange(10)}", rng.choice(["add", "modify", "delete", "none"])
            if what == "delete":
                state.pop(name, None)
            elif what != "none":
                state[name] = f"text {rng.randrange(6)}"
        rows = [(f"h{t}", "s", n, t, i) for i, (n, t) in enumerate(sorted(state.items()))]
        assert snapshots.sync(spark, root, spark.createDataFrame(rows, FILE)) == turn
        stored = snapshots.read(spark, root, "texts").collect()
        assert sorted(r["hash"] for r in stored) == sorted({r[0] for r in rows})
    assert snapshots.version(spark, root) == 6 and snapshots.version(spark, root + "/none") == 0
    with pytest.raises(ValueError):
        snapshots.read(spark, root, "metadata")


def test_bad_entries_are_told_and_passed_over(spark, tmp_path):
    (tmp_path / "library.json").write_text('{"hash": "a", "n": 1}\n{"hash": "b", "n": "many"}\nnot json\n{"n": 4}\n{"hash": "c", "n": 2}\n')
    good, bad = snapshots.load_json(spark, f"file://{tmp_path}/library.json", "hash string, n int", "hash")
    assert sorted(r["hash"] for r in good.collect()) == ["a", "c"] and bad.count() == 3


def test_documents_that_do_not_fit_stay_on_the_worklist(spark):
    texts = spark.createDataFrame([("a", "x" * 4000), ("b", "y" * 9000), ("c", ""), ("d", None)], "hash string, text string")
    held = spark.createDataFrame([], "model string, hash string")

    def tight(chunks):
        if len(chunks) > 2 or any(c.startswith("y") for c in chunks):
            raise MemoryError
        return np.ones((len(chunks), 2))

    made = embedding.embedded(texts, held, {"m": tight}, batch=8, recoveries=2)
    rows = made.collect()
    assert {(r["hash"], r["chunk_index"]) for r in rows} == {("a", 0), ("a", 1)}
    assert rows[0]["embedding"] == pytest.approx([0.5**0.5] * 2)
    left = embedding.worklist(texts, made, ["m"]).where("chunks > 0").collect()
    assert [(r["hash"], r["chunks"]) for r in left] == [("b", 4)]


def test_replies_that_are_no_json_are_salvaged(spark):
    docs = spark.createDataFrame([(1, "In 1900 a. In 1901 b."), (2, "In 1902 c."), (3, ""), (4, None)], "doc_id long, text string")
    found = sorted(tuple(r) for r in extraction.extracted(docs, extraction.year_clauses).collect())
    assert found == [(1, 0, 0, "1900", "a"), (1, 0, 1, "1901", "b"), (2, 0, 0, "1902", "c")]
    cut = extraction.pieces(spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string"), 4, 9).orderBy("piece").collect()
    assert [r["text"] for r in cut] == ["abcd", "efgh", "i"]


def test_assembled_notes_and_names(spark):
    row = spark.range(1).select(
        assembly.with_front_matter({"b": F.lit("yes"), "a": F.lit("plain words"), "c": F.lit("")}, {"d": F.array(F.lit("x: y"))}, F.lit("body")).alias("md"),
        assembly.with_drawer(F.lit("p\n"), {"title": F.lit("one"), "creation": F.lit("2020")}, {"tags": F.array(F.lit("a b"), F.lit("c"))}, F.lit("body")).alias("org"),
        text.human_filename(F.lit("War and Peace II"), F.lit("War and Peace"), F.lit("Leo"), F.lit("Classics")).alias("name"),
        text.cut_title(F.lit("a" * 35 + ", " + "b" * 60)).alias("cut"), text.cut_title(F.lit("word " * 20)).alias("words"), text.cut_title(F.lit("x" * 90)).alias("hard"),
    ).first()
    assert row["md"] == "---\na: plain words\nb: 'yes'\nd:\n- 'x: y'\n---\nbody"
    assert row["org"] == 'p\n:PROPERTIES:\n:title: one\n:creation:>2020<\n:tags: "a b" c\n:END:\nbody'
    assert row["name"] == "Classics/War and Peace II - Leo" and row["cut"] == "a" * 35
    assert row["words"] == ("word " * 7).strip() and row["hard"] == "x" * 70


def test_escapes_and_braces_of_salvaged_replies(spark):
    odd = 'schön “so” a\\tb \\ c {x} } "q" 😀\n[y]'
    docs = spark.createDataFrame([(1, f"In 1900 {odd}.")], "doc_id long, text string")
    assert [tuple(r) for r in extraction.extracted(docs, extraction.year_clauses).collect()] == [(1, 0, 0, "1900", odd)]
    raw = r'[{"date_text": "1900", "event_description": "a \d "b" \\ c\u00f3 \"d\""}, {"date_text": "1901", "event_description": "\n e"}'
    salvaged = events.salvaged_events(spark.createDataFrame([(1, raw)], "reply_id long, reply string")).orderBy("n").collect()
    assert [tuple(r)[2:] for r in salvaged] == [("1900", 'a \\d "b" \\ có "d"'), ("1901", "\n e")]
