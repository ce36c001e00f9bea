"""Versions by compare-and-set; notes that are synced by what changed."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from folium.operators import notes_sync
from folium.sources import snapshots

FILE = "descriptor string, hash string, text string"


def test_two_writers_at_once_leave_two_whole_versions(spark, tmp_path):
    root, numbers = f"file://{tmp_path}", []
    both = threading.Barrier(2)

    def add(name):
        def change(last):
            if last:
                held = [r["n"] for r in snapshots.read(spark, root, "names").collect()]
            else:
                held = both.wait(60) and [] or []  # neither writes before both have read
            return {"names": spark.createDataFrame([(n,) for n in [*held, name]], "n string")}

        numbers.append(snapshots.updated(spark, root, change))

    threads = [threading.Thread(target=add, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(numbers) == [1, 2]
    # the second has what the first wrote, as it started anew from it
    assert sorted(r["n"] for r in snapshots.read(spark, root, "names").collect()) == ["a", "b"]
    assert snapshots.read(spark, root, "names", 1).count() == 1


def test_a_number_is_given_once_and_an_empty_file_is_none(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = {"t": spark.range(1)}
    assert snapshots.write(root, one) == 1
    with pytest.raises(ValueError):
        snapshots.write(root, one, 1)
    (tmp_path / "versions" / f"{2:012}.json").write_text("")  # a writer that died
    (tmp_path / "versions" / f"{3:012}.json").write_text('{"version": 3, "tables": [{"na')
    assert snapshots.version(spark, root) == 1 and snapshots.read(spark, root, "t").count() == 1
    assert snapshots.write(root, {"t": spark.range(5)}) == 4 and snapshots.read(spark, root, "t").count() == 5
    with pytest.raises(ValueError):
        snapshots.read(spark, root, "other")
    assert not snapshots.created(spark, f"{root}/versions/{1:012}.json", "x")


def note(domain, event, title="t"):
    return f"---\ntitle: {title}\n---\n<!-- domain: {domain} -->\n| Date | Event |\n|---|---|\n| 1900 | {event} |\n| 1910 | more |\n\n"


def files_of(spark, texts):
    return spark.createDataFrame([(d, str(hash(t)), t) for d, t in texts.items()] or [], FILE)


def rows(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def same_as_rebuilt(spark, root, texts):
    files = files_of(spark, texts).cache()
    held, whole = snapshots.held_notes(spark, root), notes_sync.synced(files, notes_sync.nothing(files), lambda df: df.cache())
    assert rows(held.notes, "descriptor", "hash", "header") == rows(whole.notes, "descriptor", "hash", "header")
    assert rows(held.tables, "descriptor", "table_id", "rows") == rows(whole.tables, "descriptor", "table_id", "rows")
    every = ("descriptor", "table_id", "row_id", "domain", "jd_start", "eventdata")
    assert rows(held.events, *every) == rows(whole.events, *every)


def test_random_edits_equal_a_rebuild(spark, tmp_path):
    """Edits, new notes, deletions; few domains, so that most change hands."""
    rng, root, texts = random.Random(4), f"file://{tmp_path}", {}
    for turn in range(3):
        for _ in range(9):
            name, what = f"n{rng.randrange(12):02}", rng.choice(["write", "write", "delete"])
            if what == "write":
                texts[name] = note(f"d{rng.randrange(4)}", f"e{rng.randrange(9)}", f"t{rng.randrange(3)}") * rng.choice([1, 1, 2])
            else:
                texts.pop(name, None)
        assert snapshots.sync_notes(spark, root, files_of(spark, texts)) == turn + 1
        same_as_rebuilt(spark, root, texts)


def test_a_domain_goes_to_the_next_note_and_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    texts = {"a": note("d", "of a"), "b": note("d", "of b"), "c": note("e", "of c")}
    owner = lambda: {r["domain"]: r["descriptor"] for r in snapshots.read(spark, root, "events").collect()}
    for change, want in ((lambda: None, {"d": "a", "e": "c"}), (lambda: texts.pop("a"), {"d": "b", "e": "c"}), (lambda: texts.update(a=note("d", "again")), {"d": "a", "e": "c"}), (lambda: texts.update(a=note("e", "x")), {"d": "b", "e": "a"})):
        change()
        snapshots.sync_notes(spark, root, files_of(spark, texts))
        assert owner() == want


def test_notes_that_did_not_change_are_not_parsed(spark, tmp_path):
    root = f"file://{tmp_path}"
    texts = {"a": note("d", "first"), "b": note("e", "second")}
    snapshots.sync_notes(spark, root, files_of(spark, texts), actions=True)
    # the text of a is another one under the same hash: parsed, its event would differ; b is new
    now = files_of(spark, texts).where("descriptor = 'a'").withColumn("text", F.lit(note("d", "never read")))
    snapshots.sync_notes(spark, root, now.unionByName(files_of(spark, {"b": note("e", "third")})), actions=True)
    data = {r["descriptor"]: r["eventdata"][0]["v"] for r in snapshots.read(spark, root, "events").where("row_id = 0").collect()}
    assert data == {"a": "first", "b": "third"}
    assert {(r["descriptor"], r["action"]) for r in snapshots.read(spark, root, "actions").collect()} == {("b", "changed")}
    # nothing at all, and an empty library
    snapshots.sync_notes(spark, root, now.limit(0), actions=True)
    assert snapshots.read(spark, root, "events").count() == 0 and snapshots.read(spark, root, "actions").count() == 2


def test_a_sync_reads_the_files_for_changes_and_once_to_parse(spark, tmp_path):
    root, read = f"file://{tmp_path}", spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = {x: note(f"d{x}", x) for x in "abcdef"}
    for turn, changed in enumerate(({}, {"a": note("db", "z"), "g": note("dg", "g")})):
        files = files_of(spark, texts | changed)
        snapshots.sync_notes(spark, root, files.mapInArrow(seen, files.schema), actions=True)
        assert read.value == 2 * (6 + 7 * turn)
    same_as_rebuilt(spark, root, texts | changed)


def test_files_that_share_a_descriptor_or_have_none(spark, tmp_path):
    root, held = f"file://{tmp_path}", [("a", "1", note("d", "x", "p")), ("a", "2", note("e", "y", "q")), (None, "3", note("f", "z")), ("b", "4", None), ("c", None, note("g", "w", "r"))]
    snapshots.sync_notes(spark, root, spark.createDataFrame(held, FILE), actions=True)
    found = snapshots.held_notes(spark, root)
    header = lambda t: f'{{"title": "{t}"}}'
    want = [("a", h, header(t)) for h in "12" for t in "pq"] + [("b", "4", "{}"), ("c", None, header("r"))]
    assert rows(found.notes, "descriptor", "hash", "header") == sorted(map(str, want))
    assert rows(found.tables, "descriptor", "table_id", "metadata.domain") == sorted(map(str, [("a", 0, "d"), ("a", 0, "e"), ("c", 0, "g")]))
    assert rows(found.events, "descriptor", "domain") == sorted(map(str, 2 * [("a", "d"), ("a", "e"), ("c", "g")]))
    assert rows(snapshots.read(spark, root, "actions"), "descriptor", "action") == sorted(map(str, [("a", "new"), ("a", "new"), ("b", "new"), ("c", "new"), (None, "new")]))
