import pytest

from folium.functions import keys
from folium.operators import embedding, library
from folium.plans import commands, samples
from folium.sources import snapshots
from tests.conftest import SF
from pyspark.sql import functions as F


@pytest.fixture
def desk(spark):
    texts = library.first_claims(samples.library(spark, SF)).where("claim = 1").drop("claim")
    chunks = samples.chunks(spark, SF).join(texts.select(F.col("ord").alias("doc"), "hash"), "doc").select(F.lit("m").alias("model"), F.col("hash").alias("doc"), "chunk_index", "embedding")
    meta = texts.select("descriptor", F.lit("a title").alias("title"), F.array("lang").alias("authors"), F.array().cast("array<string>").alias("tags"), F.lit("about").alias("description"), F.lit("").alias("context"), F.array(F.struct("hash")).alias("representations"))
    return commands.Desk(texts, meta, chunks, samples.timeline(spark, SF), lambda words: samples.query_vector(spark, SF), "m")


def test_commands(desk):
    hits = desk.run("search some words max_results=3").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3] and hits[0]["cosine"] == pytest.approx(1, abs=1e-5)
    assert {r["descriptor"].split("/")[1] for r in desk.run("ksearch fr title").collect()} == {"fr"}
    assert desk.run("ksearch 'title' source=src3").count() == desk.texts.where("source_name = 'src3'").count()
    assert desk.run('timeline time="2024-01-10 - 2024-01-12" keywords=view').count() > 0
    assert desk.run('timeline time="never"').count() == 0
    assert desk.run("set search_results=2").where("name = 'search_results'").first()["value"] == "2"
    assert desk.run("search x").count() == 2
    assert desk.run("check").first()["missing"] > 0 and desk.run("index").count() > 0
    for line in ("list", "list models", "list vars", "list timeline", "help", "select m"):
        assert desk.run(line).count() > 0
    with pytest.raises(ValueError):
        desk.run("fly away")


def test_requests_of_a_client(desk):
    first = desk.texts.orderBy("ord").first()
    at = {"descriptor": first["descriptor"]}
    assert desk.answer("get_text", at).first()["text"] == first["text"]
    assert desk.answer("get_chunk_details", at | {"chunk_index": "0"}).first()["chunk"] == first["text"][:3072]
    assert first["text"].strip().startswith(desk.answer("get_text_chunk", at).first()["chunk"][:20])
    assert desk.answer("set_var", {"name": "search_results", "value": "3"}).count() > 0
    assert desk.answer("search", {"text": "any words"}).count() == 3
    for request in ("test", "list_models", "get_vars", "get_3d_viz_data"):
        assert desk.answer(request).count() > 0
    assert desk.answer("timeline", keys.named_arguments('now time="2024-01-10 - 2024-01-12" keywords=view')).count() > 0
    assert desk.answer("get_metadata", at).count() == 1 and desk.answer("select", {"model": "m"}).count() == 1
    with pytest.raises(ValueError):
        desk.answer("fly")


def test_commands_that_change_the_library(desk, tmp_path):
    desk.root, desk.shared = f"file://{tmp_path}/own", f"file://{tmp_path}/shared"
    whole = desk.texts
    desk.files = whole.where("ord % 2 = 0")
    actions = {r["action"]: r["count"] for r in desk.run("sync").groupBy("action").count().collect()}
    assert actions == {"unchanged": desk.files.count(), "debris": whole.count() - desk.files.count()}
    assert desk.texts.count() == desk.files.count()
    assert [desk.run(c).first()["done"] for c in ("publish", "publish", "import")] == [True, False, False]
    desk.root = f"file://{tmp_path}/other"
    assert desk.run("import").first()["done"] and desk.texts.count() == desk.files.count()
    before = desk.chunks.count()
    assert desk.run("clean").first()["chunks"] < before
    assert [desk.run(c).first()["enabled"] for c in ("disable m", "enable m")] == [False, True]
    assert desk.run("export /fr/").first()["tested"] == desk.texts.where("lang = 'fr'" if "lang" in desk.texts.columns else "descriptor like '%/fr/%'").count()
    name = desk.texts.first()["descriptor"]
    assert desk.run(f'timeline_extract "{name}"').columns == ["date_text", "event_description"]
    assert desk.run(f"index3d folder=file://{tmp_path}/cloud").count() == desk.chunks.count()


def test_commands_that_index_search_and_store(spark, tmp_path):
    """A library of notes from nothing: sync, index, search with marks, timeline, and all of it read by another desk."""
    note = lambda title, domain, year: f"---\ntitle: {title}\nuuid: u\n---\n<!-- domain: {domain} -->\n| Date | Event |\n|---|---|\n| {year} | {title} rose |\n\nThe {title} runs on.\n"
    files = [(f"h{i}", "s", f"{{s}}/n/{t}.md", note(t, f"d/{t}", 1900 + i), i) for i, t in enumerate(("river", "bridge"))] + [("h9", "s", "{s}/a.txt", "a plain text", 9)]
    none = spark.createDataFrame([], "hash string, source_name string, descriptor string, text string")
    chunks = spark.createDataFrame([], "model string, doc string, chunk_index int, embedding array<float>")
    embed = embedding.letter_counts(8)
    new = lambda root: commands.Desk(none, none, chunks, none, lambda words: embedding.unit(embed([words]))[0].tolist(), "m", root=f"file://{root}", embedders={"m": embed, "other": embed})
    desk = new(tmp_path / "own")
    desk.files = spark.createDataFrame(files, "hash string, source_name string, descriptor string, text string, ord int")
    assert {r["action"] for r in desk.run("sync").collect()} == {"insert"}
    assert {r["title"] for r in desk.metadata.collect()} == {"river", "bridge"} and desk.run("ksearch river").first()["hash"] == "h0"
    assert [r["event"] for r in desk.run('timeline time="1900 - 1902"').collect()] == ["Event: river rose", "Event: bridge rose"]
    desk.run("disable other")
    assert {(r["model"], r["hash"]) for r in desk.run("index").collect()} == {("m", h) for h in ("h0", "h1", "h9")}
    assert desk.run("index").count() == 0 and desk.chunks.where("model = 'other'").count() == 0
    hit = desk.run("search The river runs on.").first()
    assert hit["descriptor"].endswith("river.md") and len(hit["marks"]) == len(hit["chunk"]) and max(hit["marks"]) > 0
    assert desk.run("search river highlight=false").first()["marks"] is None
    desk.run("disable m")
    assert desk.run("search river").count() == 0
    # a file goes; its vectors are cleaned, and another desk finds all of it
    desk.files = desk.files.where("hash != 'h1'")
    desk.run("sync")
    assert desk.run("clean").first()["docs"] == 2
    other = new(tmp_path / "own")
    assert other.run("load").first()["done"] and {r["title"] for r in other.metadata.collect()} == {"river"}
    assert other.chunks.select("doc").distinct().count() == 2 and other.timeline.count() == 1
    other.shared = f"file://{tmp_path}/shared"
    snapshots.write(other.shared, {"texts": none}, 99)
    assert [other.run(c).first()["done"] for c in ("load", "load force=true")] == [False, True]
