"""Caches of extracted texts, vectors by pointer, exports and mirrors."""

import pytest
from pyspark.sql import functions as F

from folium.operators import pdf, pointers
from folium.sources import assembly, datasource, notes


def file_of(spark, contents):
    rows = [(h, len(c), bytearray(c)) for h, c in contents.items()]
    return spark.createDataFrame(rows, "hash string, file_size long, content binary")


def test_pages_that_count():
    assert pdf.joined(["a page of text", "-----", "short", None, "  -----  ", "more\n-----\ntext here"]) == "a page of text\nmore\ntext here"
    assert pdf.joined(["short", "-----"]) is None and pdf.joined([]) is None


def test_a_failure_is_remembered_until_it_is_tried_again(spark, tmp_path):
    tried = tmp_path / "tried"
    tried.mkdir()

    def counting(content):
        (tried / f"{content.decode()[:4]}-{len(list(tried.iterdir()))}").write_text("")
        return pdf.text_pages(content) if content.startswith(b"good") else 1 / 0

    times = lambda name: len([p for p in tried.iterdir() if p.name.startswith(name)])
    files, none = file_of(spark, {"a": b"good text of a", "b": b"bad one", "c": b"good text of c"}), spark.createDataFrame([], pdf.CACHE)
    keep = lambda df: spark.createDataFrame(df.collect(), pdf.CACHE)
    cache = keep(pdf.updated(files, none, counting))
    assert {(r["hash"], r["previous_failure"], r["text"]) for r in cache.collect()} == {("a", False, "good text of a"), ("b", True, None), ("c", False, "good text of c")}
    again = keep(pdf.updated(files, cache, counting))
    assert again.count() == 3 and times("bad") == 1 and times("good") == 2
    retried = keep(pdf.updated(files, cache, counting, lambda c: "by another way-----\n", retry=True))
    assert times("bad") == 2 and times("good") == 2
    assert {r["text"] for r in retried.where("hash = 'b'").collect()} == {"by another way"}
    # a text that is lost is extracted anew; only the worklist is fetched
    lost = cache.withColumn("text", F.when(F.col("hash") == "a", F.lit(None)).otherwise(F.col("text")))
    seen = []
    whole = keep(pdf.updated(files.drop("content"), lost, counting, fetch=lambda f: (seen.append([r["hash"] for r in f.collect()]), f.join(files.select("hash", "content"), "hash"))[1]))
    assert seen == [["a"]] and whole.where("text is not null").count() == 2
    kept = pdf.cleaned(lost, files.where("hash != 'c'"))
    assert [r["hash"] for r in kept.collect()] == ["b"]


def store_of(spark, store):
    return {r["hash"]: (r["start"], r["len"]) for r in store.index.collect()}, {r["row"]: r["embedding"][0] for r in store.rows.collect()}


def test_vectors_by_pointer_after_appends_and_purges(spark):
    chunk = lambda names: spark.createDataFrame([(h, i, [float(ord(h[0]) * 10 + i)]) for h, n in names.items() for i in range(n)], "hash string, chunk_index int, embedding array<float>")
    live = lambda names: spark.createDataFrame([(n,) for n in names], "hash string")
    keep = lambda s: pointers.Store(spark.createDataFrame(s.index.collect(), pointers.INDEX), spark.createDataFrame(s.rows.collect(), pointers.ROWS))
    first = keep(pointers.appended(pointers.empty(chunk({})), chunk({"a": 3, "b": 2, "c": 4})))
    assert store_of(spark, first)[0] == {"a": (0, 3), "b": (3, 2), "c": (5, 4)}
    second = keep(pointers.purged(first, live("ac")))
    assert store_of(spark, second) == ({"a": (0, 3), "c": (3, 4)}, {0: 970, 1: 971, 2: 972, 3: 990, 4: 991, 5: 992, 6: 993})
    third = keep(pointers.appended(second, chunk({"a": 3, "b": 1, "d": 2})))
    assert store_of(spark, third)[0] == {"a": (0, 3), "c": (3, 4), "b": (7, 1), "d": (8, 2)}
    assert sorted((r["hash"], r["chunk_index"], r["embedding"][0]) for r in pointers.found(third).where("hash in ('b', 'd')").collect()) == [("b", 0, 980), ("d", 0, 1000), ("d", 1, 1001)]
    assert tuple(pointers.checked(third, live("abx")).first()) == (4, 10, 10, 0, 0, 2, 1)
    broken = pointers.Store(third.index.withColumn("start", F.when(F.col("hash") == "d", -1).otherwise(F.col("start"))), third.rows.where("row != 4"))
    row = pointers.checked(broken, live("abcd")).first()
    assert (row["rows"], row["lengths"], row["negatives"]) == (9, 10, 1)


NOTE = "---\nuuid: u-1\ncontext: my notes\ntitle: A title\ntags: [one, two words]\nauthors: Some Body\npubdate: '1999-05-01'\n---\n# Head\n- **a** b\n"


@pytest.fixture
def folder(spark, tmp_path):
    given = {"/notes/x/a.md": NOTE, "/notes/b.md": NOTE.replace("uuid: u-1\n", ""), "/notes/c.txt": NOTE, "/else/d.md": NOTE, "/notes/e.md": NOTE}
    (tmp_path / "org").mkdir()
    (tmp_path / "org/e.org").write_text("here before")
    rows = [(p, "{n}" + p, f"h{i}", "2020-01-01", t) for i, (p, t) in enumerate(given.items())]
    return tmp_path, spark.createDataFrame(rows, "path string, descriptor string, hash string, created string, text string")


def test_exports_are_written_with_their_drawer_and_read_back(spark, folder):
    root, given = folder
    told = {r["path"]: (r["target_path"], r["refusal"]) for r in assembly.export(given, "/notes", f"file://{root}", "/org").collect()}
    assert told == {"/notes/x/a.md": ("/org/x/a.org", None), "/notes/b.md": (None, "incomplete"), "/notes/c.txt": (None, "ending"), "/else/d.md": (None, "outside"), "/notes/e.md": (None, "exists")}
    written = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.org")}
    assert written.keys() == {"org/x/a.org", "org/e.org"} and written["org/e.org"] == "here before"
    _, fields, body = notes.org_parts(written["org/x/a.org"])
    assert (fields["uuid"], fields["context"], fields["title"], fields["tags"], fields["authors"]) == ("u-1", "my notes", "A title", ["one", "two words"], ["Some", "Body"] if isinstance(fields["authors"], list) else "Some Body")
    assert fields["representations"] == {"doc_descriptor": "{n}/notes/x/a.md", "hash": "h0", "format": "md", "doc_date": "2020-01-01"} and body == "* Head\n- *a* b\n"
    # a second export refuses what is there
    again = {r["path"]: r["refusal"] for r in assembly.export(given, "/notes", f"file://{root}", "/org").collect()}
    assert again["/notes/x/a.md"] == "exists"
    # and back: a note with the same fields and body
    org = spark.createDataFrame([("/org/x/a.org", written["org/x/a.org"])], "path string, text string")
    assert assembly.export(org, "/org", f"file://{root}", "/back", "markdown").first()["target_path"] == "/back/x/a.md"
    header = (root / "back/x/a.md").read_text()
    assert "title: A title\n" in header and "tags:\n- one\n- two words\n" in header and header.endswith("---\n# Head\n- **a** b\n")


def test_a_mirror_of_a_folder(spark, tmp_path):
    for name, text in (("new.txt", "new"), ("same.txt", "same"), ("sub/changed.txt", "longer now")):
        (tmp_path / "from" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "from" / name).write_text(text)
    for name, text in (("same.txt", "same"), ("sub/changed.txt", "short"), ("gone.txt", "x")):
        (tmp_path / "to" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "to" / name).write_text(text)
    side = lambda name: datasource.load(spark, f"file://{tmp_path}/{name}", "", ["txt"], ["descriptor", "path", "length", "modified"]).select(F.regexp_replace("descriptor", r"^\{\}", "").alias("rel_path"), "path", F.col("length").alias("size"), F.lit(0).alias("modified"))
    want = {"/new.txt": "copy", "/same.txt": "keep", "/sub/changed.txt": "update", "/gone.txt": "delete"}
    dry = assembly.mirror(side("from"), side("to"), f"file://{tmp_path}/to", dry=True)
    assert {r["rel_path"]: r["action"] for r in dry.collect()} == want and (tmp_path / "to/gone.txt").exists()
    done = assembly.mirror(side("from"), side("to"), f"file://{tmp_path}/to")
    assert {r["rel_path"]: r["action"] for r in done.collect()} == want
    assert {str(p.relative_to(tmp_path / "to")): p.read_text() for p in (tmp_path / "to").rglob("*.txt")} == {"new.txt": "new", "same.txt": "same", "sub/changed.txt": "longer now"}
