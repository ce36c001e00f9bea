import pytest
from pyspark.sql import functions as F

from folium.functions import chronology, keys, text
from folium.operators import events, library, vectors
from folium.sources import files, notes


def test_command_lines():
    assert keys.arguments('find "a b" c\\ d n=3 q="x y"') == (["find", "a b", "c d"], {"n": "3", "q": "x y"})
    assert keys.arguments("a\\nb") == (["a\nb"], {})
    assert keys.arguments('ab"cd"e') == (["abcd", "e"], {})
    for bad in ('"open', "end\\", "=x", "k=", 'k= "', "a==b"):
        assert keys.arguments(bad) == ([], {})


@pytest.mark.parametrize(("key", "value", "found"), [
    ("schön", "wie schön!", True), ("schön", "schöner", False), ("schön*", "schöner", True), ("*ner", "schöner", True), ("ner", "schöner", False), ("*", "", True), ("**", "x", True),
    ("a|", "zz", True), ("a|", "...", False), ("!a", "b", True), ("!a", "a b", False), ("a*c", "a b c", True), ("a*c", "a\nc", False), ("!a|b", "a", False),
])
def test_keys(spark, key, value, found):
    assert spark.range(1).select(keys.matches(F.lit(value), [key])).first()[0] is found


def test_bad_keys():
    with pytest.raises(ValueError):
        keys.key_pattern("(")


def test_chunks_join_to_the_text(spark):
    rows = [(i, "abcdefghij" * i + "x" * (i % 4)) for i in range(30)]
    frame = spark.createDataFrame(rows, "id int, text string")
    for size, overlap in ((7, 3), (5, 9), (40, 0)):
        step = text.chunk_step(size, overlap)
        for r in frame.select("text", text.chunks(F.col("text"), size, overlap).alias("c"), text.chunk_count(F.col("text"), size, overlap).alias("n")).collect():
            assert len(r["c"]) == r["n"]
            assert "".join(c[:step] for c in r["c"][:-1]) + (r["c"][-1] if r["c"] else "") == r["text"]


def test_overlap_classes_exclude_each_other(spark):
    points = [(a, b, c, d) for a in range(4) for b in range(a, 4) for c in range(4) for d in range(c, 4)]
    frame = spark.createDataFrame(points, "s double, e double, a double, b double" .replace("double", "int"))
    for r in frame.select("*", events.overlap_class(F.col("s"), F.col("e"), F.col("a"), F.col("b")).alias("k")).collect():
        inside, covers = r["s"] >= r["a"] and r["e"] <= r["b"], r["s"] < r["a"] and r["e"] > r["b"]
        apart = r["e"] < r["a"] or r["s"] > r["b"]
        assert (r["k"] == "inside") == inside and (r["k"] == "covers") == covers
        if apart:
            assert r["k"] is None


def test_overlap_join_over_many_lengths(spark):
    spans = [(i, float(i * 13 % 50), float(i * 13 % 50 + 10.0 ** (i % 6))) for i in range(60)]
    left = spark.createDataFrame(spans, "l_id long, l_start double, l_end double")
    right = spark.createDataFrame([(i, s - 40, e - 40) for i, s, e in spans], "r_id long, r_start double, r_end double")
    found = [(r["l_id"], r["r_id"]) for r in events.overlap_join(left, right, 3.0).collect()]
    want = [(i, j) for i, s, e in spans for j, a, b in spans if s <= b - 40 and a - 40 <= e]
    assert sorted(found) == sorted(want)


def test_order_filter_equals_a_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(t, i, float(rng.randrange(4)), rng.choice([None, float(rng.randrange(5))])) for t in range(80) for i in range(8)]
    frame = spark.createDataFrame(rows, "table_id long, row_id long, jd_start double, jd_end double")
    got = {(r["table_id"], r["row_id"]) for r in events.in_order(frame).collect()}
    want = set()
    for t in range(80):
        start = end = None
        for _, i, s, e in (r for r in rows if r[0] == t):
            if e is not None and e < s:
                continue
            if start is None or s > start or (s == start and (end is None or (e is not None and e >= end))):
                want.add((t, i))
                start, end = s, e
    assert got == want


def test_times_keep_through_text(spark):
    days = [2458849.5, 2415020.5, 2299160.5, 2299159.5, 1721423.5, 2086302.5, 1721057.5]
    frame = spark.createDataFrame([(d,) for d in days], "jd double")
    back = frame.select("jd", chronology.parse(chronology.label(F.col("jd")))["jd_start"].alias("back"))
    assert all(r["jd"] == r["back"] for r in back.collect())


def test_significance_bounds(spark):
    rows = [([0.2, 0.5, 0.9],), ([0.4, 0.4],), ([-0.5, -0.1],), ([0.0],)]
    frame = spark.createDataFrame(rows, "c array<double>")
    out = [r[0] for r in frame.select(vectors.significance(F.col("c"), 0.3)).collect()]
    assert out[0][0] == 0 and abs(out[0][2] - 1) < 1e-12 and out[1] == [0.4, 0.4]
    assert all(0 <= x <= 1 for x in out[2])


def test_library_after_edits_equals_one_from_scratch(spark):
    import random

    rng = random.Random(6)
    held = spark.createDataFrame([], "hash string, source_name string, descriptor string, text string")
    state = {}
    for _ in range(3):
        for _ in range(6):
            name = f"f{rng.randrange(8)}"
            if rng.random() < 0.3:
                state.pop(name, None)
            else:
                state[name] = f"text {rng.randrange(5)}"
        rows = [(f"h{t}", "s", n, t, i) for i, (n, t) in enumerate(sorted(state.items()))]
        now = spark.createDataFrame(rows, "hash string, source_name string, descriptor string, text string, ord int")
        held = spark.createDataFrame(library.synced(now, held).collect(), held.schema)
        assert sorted(r["hash"] for r in held.collect()) == sorted({r[0] for r in rows})


def test_note_tables():
    good = "<!-- domain: d -->\n| Date | What |\n|---|---|\n| 1 | 2 |\n"
    assert list(notes.note_tables(good + "\n", "p/n.md")) == [(["Date", "What"], [["1", "2"]], {"context": "p/n/What_Date_What", "domain": "d"})]
    assert list(notes.note_tables(good.rstrip("\n"), "p")) == []
    assert list(notes.note_tables("| a | b \n" + good + "\n", "p")) == []
    assert list(notes.note_tables("```\n" + good + "\n```\n", "p")) == []
    bad = list(notes.note_tables("| a | b |\n|--x--|\n| 1 | 2 |\n\n", "p"))
    assert bad == [([], [["1", "2"]], {})]


def test_org_properties():
    assert notes.property_value('"a b" c') == "a b"
    assert notes.property_value('"a b" cd <2020-01-01 Wed>') == ["a b", "cd", "2020-01-01 Wed"]
    assert notes.property_value('[1,2]') == [1, 2]
    assert notes.property_value('"x\\ny"') == "x\ny" and notes.property_value("") == ""


@pytest.mark.parametrize("note", ["# A\n\n## B", "- a\n- **b** _c_ `d`", "> q\n\nx", "```py\n*a*\n```", "[a](b:c) [[w]] <http://x.y>", "$x^2$ and\n$$\ny\n$$", "| a | b |\n|---|---|\n| 1 | 2 |"])
def test_round_trips(note):
    assert notes.org_to_markdown(notes.markdown_to_org(note)) == note


def test_scan_of_files(spark, tmp_path):
    for name, body in (("a/n.md", b"ok \xff x"), ("a/.git/n.md", b"no"), ("b/.#n.md", b"no"), ("b/m.txt", "é".encode()), ("b/x.png", b"no")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    found = files.contents(files.scan(spark, str(tmp_path), "S", ["md", "txt"])).collect()
    assert sorted((r["descriptor"], r["text"]) for r in found) == [("{S}/a/n.md", "ok  x"), ("{S}/b/m.txt", "é")]
