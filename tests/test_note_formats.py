import time

import pytest

from folium import catalogue
from folium.sources import assembly, notes


@pytest.mark.parametrize("convert", [notes.markdown_to_org, notes.org_to_markdown])
def test_plain_stretches_are_not_read_character_by_character(convert):
    text = "ha" * 4_000_000
    start = time.process_time()
    assert convert(text) == text
    assert time.process_time() - start < 1.5


def test_notes_go_to_python_in_small_batches_and_once(spark):
    # an Arrow batch holds 10,000 notes, and a worker several times its texts
    docs = spark.createDataFrame([("a", "p.md", "# x\n| Date | b |\n|---|---|\n| 1 | 2 |\n\n"), ("b", None, None)], "note_id string, path string, text string").repartition(2)
    frames = [notes.converted(docs, "org"), notes.converted(docs, "markdown"), notes.round_trips(docs), notes.org_properties(docs), notes.parsed_headers(docs), notes.tables_of(docs).where("metadata['domain'] is not null")]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("BatchEvalPython") == 1 and "Arrow" not in plan and "Pandas" not in plan
    assert [tuple(r)[:3] for r in frames[-1].collect()] == [("a", 0, ["Date", "b"])]


def test_a_wiki_link_keeps_its_bar_when_the_alias_is_empty():
    # as in the reference and in the SQL of markdown_to_org; marks around nothing are no forms and stay
    assert notes.markdown_to_org("see [[note|]] [[plain]] [[w|x]]") == "see [[note][]] [[plain]] [[w][x]]"
    assert notes.markdown_to_org("- **** [](http://x.y) ____") == "- **** [](http://x.y) ____"
    assert notes.org_to_markdown("2 ** 3 [[http://x.y][]]") == "2 ** 3 [[http://x.y][]]"


def test_a_null_text_has_no_conversion_and_an_export_of_it_is_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "Abc.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("markdown_to_org", "org_to_markdown"):
        assert {r[0]: r[1] is None for r in catalogue.queries()[name](spark, str(tmp_path)).collect()} == {1: True, 2: False}
    given = spark.createDataFrame([("n.md", None)], "path string, text string")
    plan = spark.createDataFrame([("n.md", "n.org", None)], "path string, target_path string, refusal string")
    assert [tuple(r) for r in assembly.exported(given, plan).collect()] == [("n.org", "")]
    noted = given.selectExpr("path", "'{S}/n.md' AS descriptor", "'h' AS hash", "'' AS created", "text")
    assert ":END:" in assembly.org_documents(noted).first()["text"]
