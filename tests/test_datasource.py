import io
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from folium.operators import library
from folium.sources import datasource, files

CACHE = "path string, length long, modified timestamp, hash string"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for name in ("a.md", "b.TXT", "sub/c.md", "sub/.#d.md", ".git/e.md", "sub/deep/f.org", "g.bin", "sub/h with space é.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    return root


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan_of(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_same_rows_as_a_scan(spark, tree):
    new = datasource.load(spark, f"file://{tree}", "notes", ["md", "txt"], ["descriptor", "length", "modified", "content"])
    old = files.scan(spark, f"file://{tree}", "notes", ["md", "txt"])
    assert rows(new, "descriptor", "length", "content") == rows(old, "descriptor", "length", "content")
    assert {r["descriptor"] for r in new.collect()} == {"{notes}/a.md", "{notes}/b.TXT", "{notes}/sub/c.md", "{notes}/sub/h with space é.md"}
    assert rows(new, F.date_trunc("second", "modified")) == rows(old, F.date_trunc("second", "modified"))


def test_filters_reach_the_source_and_without_content_no_file_is_opened(spark, tree):
    os.chmod(tree / "a.md", 0)
    (tree / "a.md").unlink()
    os.symlink(tree / "nowhere", tree / "broken.md")
    load = lambda *c: datasource.load(spark, f"file://{tree}", "notes", ["md", "txt", "org"], list(c))
    found = load("descriptor", "extension", "path", "length").where("extension = 'md'").where(F.col("descriptor").startswith("{notes}/sub/")).where("length > 3")
    assert {r["descriptor"] for r in found.collect()} == {"{notes}/sub/c.md", "{notes}/sub/h with space é.md"}
    text = plan_of(found)
    assert "PythonScan" in text or "BatchScan" in text
    filters = [line for line in text.splitlines() if line.startswith("Condition")]
    # what is pushed is not filtered again; the length is
    assert filters and all("length" in line and "extension = md" not in line and "StartsWith" not in line for line in filters)
    one = load("descriptor", "content").where("descriptor in ('{notes}/sub/c.md', '{notes}/none.md')")
    assert [bytes(r["content"]) for r in one.collect()] == [b"text of sub/c.md"]
    assert load("descriptor", "source_name").where("source_name = 'other'").count() == 0
    assert datasource.load(spark, f"file://{tree}/absent", "notes", ["md"], ["path"]).count() == 0


def test_partitions_by_bytes(spark, tree):
    reader = datasource._Reader(datasource.StructType.fromDDL("path string, content binary"), {"path": str(tree), "partition_bytes": "5000"})
    assert [len(p.files) for p in reader.partitions()] == [1] * 6
    reader = datasource._Reader(datasource.StructType.fromDDL("path string"), {"path": str(tree)})
    assert [len(p.files) for p in reader.partitions()] == [6]


def test_bytes_of_changed_files_alone_are_read(spark, tree):
    here = lambda: datasource.load(spark, f"file://{tree}", "notes", ["md"], ["path", "length", "modified"])
    first = datasource.hashed(here(), spark.createDataFrame([], CACHE))
    cache = spark.createDataFrame(first.drop("read").collect(), CACHE)
    assert first.where("read").count() == 3
    assert datasource.hashed(here(), cache).where("read").count() == 0
    (tree / "sub/c.md").write_text("a longer text than before")
    (tree / "new.md").write_text("new")
    again = datasource.hashed(here(), cache)
    assert again.where("read").agg(F.sum("length")).first()[0] == len("a longer text than before") + 3
    whole = files.scan(spark, f"file://{tree}", "notes", ["md"]).select(F.sha2("content", 256).alias("hash"))
    assert rows(again, "hash") == rows(whole, "hash")
    # a file that is in the cache is not opened: it may even be unreadable
    held = library.to_hash(here(), cache).where("hash is not null")
    assert held.count() == 2


def written(spark, root, given, **options):
    datasource.save(spark.createDataFrame(given, "path string, content string").repartition(3), f"file://{root}", **options)


def tree_of(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_a_file_for_each_row(spark, tmp_path):
    root = tmp_path / "out"
    written(spark, root, [("a/b.md", "one"), ("/c.md", "two"), ("d é.md", "")])
    assert tree_of(root) == {"a/b.md": "one", "c.md": "two", "d é.md": ""}
    written(spark, root, [("a/b.md", "three"), ("c.md", None), ("never.md", None)], replace=True)
    assert tree_of(root) == {"a/b.md": "three", "d é.md": ""}
    assert not [p for p in root.iterdir() if p.name.startswith(".folium")]


@pytest.mark.parametrize("bad", [[("x.md", "1"), ("x.md", "2")], [("x.md", "1"), ("../y.md", "2")], [("x.md", "1"), (None, "2")], [("x.md", "1"), ("there.md", "2")], [("x.md", "1"), ("folder", "2")]])
def test_nothing_is_seen_of_a_write_that_fails(spark, tmp_path, bad):
    root = tmp_path / "out"
    (root / "folder").mkdir(parents=True)
    (root / "there.md").write_text("before")
    with pytest.raises(Exception):
        written(spark, root, bad)
    assert tree_of(root) == {"there.md": "before"} and sorted(p.name for p in root.iterdir()) == ["folder", "there.md"]


def test_a_task_that_fails_once_leaves_nothing_twice(spark, tmp_path):
    root, mark = tmp_path / "out", tmp_path / "mark"

    def failing(batches):
        for batch in batches:
            yield batch
            if not mark.exists():
                mark.write_text("")
                raise ValueError("once")

    given = spark.createDataFrame([(f"{i}.md", str(i)) for i in range(50)], "path string, content string").coalesce(1).mapInArrow(failing, "path string, content string")
    try:
        datasource.save(given, f"file://{root}")
    except Exception:  # a local master does not try again
        assert not tree_of(root)
        datasource.save(given, f"file://{root}")
    assert tree_of(root) == {f"{i}.md": str(i) for i in range(50)}
