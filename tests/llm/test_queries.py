"""The registered queries: against SQL where there is some, and on tables with every odd kind of row."""

import hashlib
import zlib

import pytest

from folium.llm import queries
from tests.conftest import SF
from tests.oracle import differences

SQL = queries.oracle_sql()
COLUMNS = {
    "op1_katz_backoff": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_suffix_arrays": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_suffix_trees": "doc_id n_words n_removed kept_sha256",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_mixing": "doc_id size source_size target taken",
    "op6_near_dedup": "doc_id n_shingles component_id kept",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_quality_classifier": "doc_id held_out score predicted",
}
LONG = "The long tale goes on, " * 20_000 + " ".join(f"w{i * 7919 % 50_000}" for i in range(80_000))
TEXTS = [(1, LONG), (2, None), (3, ""), (4, " \n\t "), (None, "a text without id"), (None, "a text without id"), (5, "same words here " * 9), (5, "same words here " * 9), (6, "same words here " * 9), (7, "прямо — 試験 \U0001f642 " * 30), (8, "x")]
#: Columns whose names operators use for their own.
EXTRA = {c: "int" for c in "target source_size size copies taken shard slot kept ranges body home gram component_id score bits lang_ at shingles text_key held_out learns n_words".split()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else f"s{n % 2}", len(t or ""), *[1] * len(EXTRA)) for n, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {k}" for c, k in EXTRA.items())
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, None), (None, 1, 0), (7, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.queries()[name], SQL[name], spark, SF) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_odd_rows(spark, odd, name):
    """Every row keeps its row, and has the columns of the query with none null but those that may be."""
    df = queries.queries()[name](spark, odd)
    rows = df.collect()
    assert set(COLUMNS[name].split()) <= set(df.columns)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    free = {"doc_id", "component_id", "bits"}
    assert all(r[c] is not None for r in rows for c in COLUMNS[name].split() if c not in free)
    by_id = {r["doc_id"]: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    if name == "op2_suffix_arrays":
        assert (by_id[2]["n_bytes"], by_id[2]["kept_sha256"]) == (0, nothing) and by_id[6]["n_removed"] == by_id[6]["n_bytes"]
    if name == "op3_suffix_trees":
        assert by_id[4]["n_words"] == 0 and by_id[6]["n_removed"] == 27 and by_id[1]["n_removed"] > 90_000
    if name == "op4_quality_rules":
        assert by_id[4]["base_failed"] and by_id[5]["n_repeat_words"] == 27 and by_id[1]["n_words"] == 180_000
    if name == "op5_mixing":
        assert by_id[2]["size"] == by_id[2]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in rows)
    if name == "op6_near_dedup":
        assert by_id[6]["component_id"] == 5 and by_id[3]["n_shingles"] == 0 and by_id[3]["kept"]
    if name == "op7_bpe":
        assert by_id[3]["n_tokens"] == 0 and by_id[7]["decoded_sha256"] == hashlib.sha256(dict(TEXTS)[7].encode()).hexdigest()
    if name == "op8_sharding":
        assert {r["law"] for r in rows} == {"key"} and by_id[1]["text_crc32"] == zlib.crc32(LONG.encode()) and by_id[2]["size"] == 1
        for shard in range(8):
            slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert slots == list(range(len(slots)))
    if name == "op10_quality_classifier":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_table(spark, odd, tmp_path, name):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_search_on_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (100, None)]
    spark.createDataFrame([(*r, 7, 1) for r in rows], "vec_id long, embedding array<float>, rank int, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op9_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
