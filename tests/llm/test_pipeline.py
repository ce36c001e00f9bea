"""The stages of the pipeline against plain Python, and on every odd kind of row."""

import re
from collections import defaultdict
from math import log
from struct import pack

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folium.llm import mixing, quality_rules, sharding
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def kept_of_groups(texts):
    """Least ids of groups of texts that share five-word shingles to 80 percent."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def left_of_passages(texts, window=50):
    """The words that are left of each text, without those within a window that stands in an earlier place, too."""
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = WORD.findall(texts[i] or ""), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of it, over the given documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, SF), name.replace(" ", "-"))
        out[name] = docs.collect(), made.collect(), made.columns
        docs = made
    return out


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_order_and_columns(stages):
    assert list(STAGES) == ["quality rules", "near duplicates", "substring dedup", "mixing", "encoding"]
    assert all(stages[name][2] == corpus_pipeline.COLUMNS for name in list(STAGES)[:-1])


def test_quality_rules(spark, stages):
    given, made, _ = stages["quality rules"]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(given, SCHEMA)).collect()}
    assert by_id(made) == {r["doc_id"]: r["text"] for r in given if judged[r["doc_id"]]}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = spark.createDataFrame(given, SCHEMA)
    passed = {r["doc_id"] for r in quality_rules.judge(rows).where("not base_failed").collect()}
    assert len(good & passed & set(by_id(made))) > 0.95 * len(good & passed)


def test_near_duplicates(stages):
    given, made, _ = stages["near duplicates"]
    kept = kept_of_groups(by_id(given))
    assert by_id(made) == {i: t for i, t in by_id(given).items() if i in kept} and len(kept) < len(given)


def test_substring_dedup(stages):
    given, made, _ = stages["substring dedup"]
    want = left_of_passages(by_id(given))
    assert {i: WORD.findall(t) for i, t in by_id(made).items()} == {i: w for i, w in want.items() if w or not WORD.findall(by_id(given)[i] or "")}
    whole = by_id(given)
    assert all(r["n_chars"] == len(r["text"]) for r in made if r["text"] != whole[r["doc_id"]])


def hashed(*parts):
    h = 42
    for kind, x in parts:
        h = xxhash.xxh64(pack(kind, x), seed=h).intdigest()
    return h


def mixed(rows, seed=17, most=3):
    """doc_id -> (target, copies) of rows (doc_id, source, size, weight), in plain Python."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight, open_, target = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(sources)}, set(sources), {}
    while open_:  # the excess of those that stop goes to the others, until none is above
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * size[s]}
        target |= {s: float(most * size[s]) for s in above} or {s: level * weight[s] for s in open_}
        open_ = open_ - above if above else set()
    out = {}
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, before = target[s] - epochs * size[s], 0
        u = lambda i: ((hashed(("<i", seed), ("<q", i)) >> 11) + 0.5) / 2**53
        for key, i, n in sorted((-log(u(r[0])) / max(r[3], 1e-6), r[0], r[2]) for r in rows if r[1] == s):
            out[i] = target[s], epochs + (n > 0 and before + n / 2 <= rest and epochs < most)
            before += n
    return out


def test_mixing(spark, stages):
    given, made, _ = stages["mixing"]
    rows = spark.createDataFrame(given, SCHEMA).select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), mixing.quality_weight(F.col("text")).alias("w")).collect()
    want = {i: c for i, (_, c) in mixed([tuple(r) for r in rows]).items()}
    got = defaultdict(int)
    for r in made:
        got[r["doc_id"]] += 1
    assert dict(got) == {i: c for i, c in want.items() if c}


def test_encoding(stages):
    given, made, _ = stages["encoding"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation(), plain.no_padding()
    texts = {r["doc_id"]: r["text"] for r in given}
    assert len(made) == len(given)
    assert all(list(r["ids"]) == plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in made[::7])


def test_taken_of_each_document(spark):
    rows = [(i, f"s{i * i % 7}" if i % 11 else None, i * 7919 % 40, 0.1 + i % 9 / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long, w double")
    got = {r["doc_id"]: (r["target"], r["copies"], r["taken"]) for r in mixing.mix(df, F.col("n"), F.col("w")).collect()}
    want = mixed(rows)
    assert {i: (pytest.approx(t), c, c * rows[i][2]) for i, (t, c) in want.items()} == got


def test_shards_in_plain_python(spark):
    weights = [1.0, 2.0, 0.5]
    df = spark.createDataFrame([(i * 1_000_003,) for i in range(300)], "doc_id long")
    u = lambda i, s: ((hashed(("<i", 0x5EED), ("<q", i), ("<i", s)) >> 11) + 0.5) / 2**53
    for r in sharding.assign(df, weights).collect():
        assert r["shard"] == max(range(3), key=lambda s: (weights[s] / -log(u(r["doc_id"], s)), -s))


def test_operators_replace_columns_of_their_names(spark):
    names = "size source_size target copies taken shard slot".split()
    df = spark.createDataFrame([(i, f"s{i % 3}", i, *[-7] * len(names)) for i in range(60)], "doc_id long, source string, n long, " + ", ".join(f"{c} long" for c in names))
    for made, own in ((mixing.mix(df, F.col("n"), F.lit(1.0)), names[:5]), (mixing.mix(df.withColumn("size", F.col("n")), F.col("size"), F.lit(1.0)), names[:5]), (sharding.assign(df, [1.0, 1.0]), names[5:])):
        assert len(set(made.columns)) == len(made.columns) and made.count() == 60
        assert all(made.where(F.col(c) == -7).count() == 0 for c in own)


LONG = " ".join(f"w{i * 7919 % 70_000}" for i in range(60_000))
SOME = "The river of long words runs on and on through the hills, and nobody who lived there had ever seen it fall. " * 3
ODD = [(1, LONG), (2, None), (3, ""), (4, " \n "), (None, SOME), (None, SOME), (5, SOME + "one"), (5, SOME + "one"), (6, SOME + "one"), (7, "прямо — 試験 \U0001f642 " * 40), (8, "x")]


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, name):
    """Nulls in any column, empty and very long texts, ties, rows that repeat, columns of the stages' own names."""
    extra = "row_id copies kept size target _copy _size n_words".split()
    rows = [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else f"s{n % 2}", None if n % 5 == 0 else len(t or ""), *[1] * len(extra)) for n, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{c} int" for c in extra)).repartition(3)
    made = STAGES[name](spark, docs, SF)
    rows = made.collect()
    texts = sorted((r["text"] or "" for r in rows), key=len) if name != "encoding" else []
    assert name == "encoding" or made.columns == corpus_pipeline.COLUMNS
    if name == "quality rules":
        assert all(len(WORD.findall(t)) >= 20 for t in texts)
    if name == "near duplicates":  # a null id is not one more text's id; equal texts leave one
        assert [len(t) for t in texts if t.startswith("The river")] == [len(SOME)] or [t[:9] for t in texts].count("The river") <= 2
        assert sum(t == "" for t in texts) == 2 and LONG in texts
    if name == "substring dedup":
        assert LONG in texts and [r["doc_id"] for r in rows if (r["text"] or "").startswith("The river")] == [5, 5]
    if name == "mixing":
        assert all(texts.count(t) <= 3 * sum((x or "") == t for _, x in ODD) for t in texts)
    if name == "encoding":
        assert len(rows) == len(ODD) and sum(r["n_tokens"] == 0 for r in rows) == 2


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), SF).count() == 0
