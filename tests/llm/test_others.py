import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import mixing, quality_classifier, quality_rules, sharding, topk_search
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(x):
    w = WORD.findall(x)
    lines = [s for s in x.split("\n") if WORD.search(s)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered = collections.Counter(windows), set()
    for i, g in enumerate(windows):
        if often[g] > 1:
            covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = ["", None, "\n\n", "a\na\n a\na", "é# ü|\r\nx", " x y ", "a b c d e f g h " * 4, " \x0b#"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = _counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS[:1] + quality_rules.COUNTS[1:]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("letters", ["abdeghilnorstu", "абвгдежийклмнопрст", "αβγδεζηθικλμνξοπρσ", "ابتثجحخدذرزسشصضطع", "試験文字列日本語山川水火木金土"])
def test_perplexity_rejects_what_is_unlike_the_language(spark, letters):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(60)]
    good = [" ".join(rng.choice(words, int(rng.integers(40, 300)))) for _ in range(300)]
    shuffled = ["".join(rng.permutation(list(good[0] * 3))) for _ in range(3)]  # the same letters, in no order
    foreign = [" ".join("".join(rng.choice(list("qxzjk"), 5)) for _ in range(200))]
    even = ["".join(rng.choice(list("!?%&=+"), 40)) + " " + " ".join(f"{rng.integers(1000, 9999)}" for _ in range(150))]
    texts = [*good, *shuffled, *foreign, *even]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect() if not r["base_failed"]}
    assert not any(kept[i] for i in range(300, len(texts)) if i in kept) and len(kept) >= 303
    assert sum(kept[i] for i in range(300)) >= 294


def test_bits_and_verdicts_equal_plain_python(spark):
    """Modified Kneser-Ney over dictionaries, and the bands over sorted lists."""
    rng = np.random.default_rng(4)
    word = lambda lang: "".join(rng.choice(list("абвгд" if lang == "ru" else "abcdé"), rng.integers(1, 5)))
    rows = [(i, lang, " ".join(word(lang) for _ in range(int(rng.integers(15, 120)))) + "\nA") for i, lang in enumerate(["ru", "en"] * 130)]
    rows += [(900, "en", "zz " * 70), (901, None, " ".join(word("en") for _ in range(40))), (902, None, " ".join(word("en") for _ in range(50)))]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    grams = lambda t, n=4: [("^^^" + t.lower())[j : j + n] for j in range(len(t))]
    bits, counts = {}, {i: _counts(t) for i, _, t in rows}
    for lang in ("ru", "en", None):
        levels, level = [], collections.Counter(g for _, x, t in rows if x == lang for g in set(grams(t)))
        for _ in range(4):
            n = [sum(c == k for c in level.values()) for k in range(5)]
            drop = [0.0, 0.5, 1.0, 1.5]
            if all(n[1:4]):
                y = n[1] / (n[1] + 2 * n[2])
                drop = [0.0, *(max(0.0, min(k, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))]
            total, left = collections.Counter(), collections.Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += drop[min(c, 3)]
            levels.append((level, drop, total, left))
            level = collections.Counter(g[1:] for g in level)

        def p(g):
            if not g:
                return 1 / 255
            level, drop, total, left = levels[4 - len(g)]
            if not total[g[:-1]]:
                return p(g[1:])
            return (level[g] - drop[min(level[g], 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

        bits |= {i: -sum(np.log2(p(g)) for g in grams(t)) / len(t) for i, x, t in rows if x == lang}
    passed = {i: not (counts[i][0] < 20 or 100 * counts[i][4] > 30 * counts[i][0]) for i in bits}
    of_class = lambda t: min(max(int(np.ceil(np.log2(len(t)))), 7), 15)

    def quartiles(group):
        found = sorted(np.floor(bits[i] * 1000 + 0.5) / 1000 for i in group)
        return len(found), *[found[int(np.ceil(q * len(found))) - 1] for q in (0.25, 0.5, 0.75)]

    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    edge = 0
    for i, lang, t in rows:
        assert got[i]["bits"] == pytest.approx(bits[i], rel=1e-5)
        group = [j for j, x, u in rows if x == lang and passed[j] and of_class(u) == of_class(t)]
        spread = 2.0
        if len(group) < quality_rules.CLASS_TEXTS:
            group, spread = [j for j, x, _ in rows if x == lang and passed[j]], 1 + np.sqrt(2000 / len(t))
        _, low, middle, high = quartiles(group)
        off = bits[i] - middle
        near = [max(quality_rules.WIDTH * d, quality_rules.LEAST_BITS) * spread / 2 for d in (middle - low, high - middle)]
        if min(abs(off + near[0]), abs(off - near[1])) < 0.005:
            edge += 1
        else:
            assert got[i]["kept"] == (passed[i] and -near[0] <= off <= near[1])
    assert edge < 10 and not got[900]["kept"]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    n = quality_rules.SYMBOLS
    grams, counts = np.unique(rng.integers(1, 6, (4, 3000)).T @ np.array([n**i for i in (3, 2, 1, 0)]), return_counts=True)
    model = quality_rules.KneserNey.of(grams, counts)
    for context in (grams[0] // n, 1, 0):
        assert model.probability(context * n + np.arange(1, n)).sum() == pytest.approx(1, abs=1e-5)


def test_models_of_many_languages_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MODEL_BYTES", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    in_passes = {tuple(r) for r in quality_rules.judge(docs).collect()}
    monkeypatch.undo()
    assert in_passes == {tuple(r) for r in quality_rules.judge(docs).collect()} and len(in_passes) == docs.count()


def test_quality_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_rules.judge(docs).count() == 0


def _water_filling(sizes, weights, most):
    """Targets by sharing out again and again what is above its bound."""
    target, open_ = {}, dict(sizes)
    rest = sum(sizes.values())
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > most * sizes[s] * (1 + 1e-12)]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
            del open_[s]
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows, sizes = [], collections.Counter()
    for i in range(1500):
        source = [None, "a", "b", "é", "z"][int(rng.choice(5, p=[0.05, 0.6, 0.02, 0.03, 0.3]))]
        size = int(rng.integers(0, 40)) if rng.random() < 0.98 else 900
        rows.append((i, " w" * size, source, "x"))
        sizes[source] += size
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").drop("size")
    made = mixing.mix(docs, mixing.word_count(F.col("text")), F.lit(1.0)).collect()
    again = mixing.mix(docs.repartition(7), mixing.word_count(F.col("text")), F.lit(1.0)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in made) == sorted((r["doc_id"], r["taken"]) for r in again)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = _water_filling(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in made:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 450 for s in want)


def test_weighted_sampling_prefers_heavy_documents(spark):
    docs = spark.createDataFrame([(i, "s" if i < 2000 else "t", 10, 4.0 if i % 2 else 1.0) for i in range(2200)], "doc_id long, source string, n long, q double")
    made = mixing.mix(docs, F.col("n"), F.col("q"), weights=(1.0, 1.0)).where("source = 's'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in made}
    assert n[1] > n[0]


def test_rendezvous_moves_records_only_to_the_new_shard(spark):
    docs = spark.range(20000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)] * 50, "doc_id long"))
    placed = sharding.assign(docs, [1.0] * 8).withColumn("grown", sharding.shard_of(F.col("doc_id"), [1.0] * 9)).toPandas()
    assert len(placed) == 20050 and ((placed.shard == placed.grown) | (placed.grown == 8)).all()
    for _, part in placed.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and 2200 < len(part) < 2850
    heavy = sharding.assign(docs, [1.0, 3.0, 0.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert 2.7 < heavy[1] / heavy[0] < 3.3 and 2 not in heavy.index
    assert sharding.assign(docs.limit(0), [1.0]).count() == 0


def in_buckets(rows, queries, k=5):
    """Results by buckets from the longest vectors on, what was multiplied, and the results by all products."""
    order = np.argsort(-np.sqrt((rows * rows).sum(1)), kind="stable")
    best = topk_search.Best(topk_search.Rows.of(queries, rows[queries]), np.full(len(queries), -np.inf), k)
    for s in range(0, len(rows), topk_search.BUCKET_ROWS):
        at = order[s : s + topk_search.BUCKET_ROWS]
        best.meet(topk_search.Rows.of(at, rows[at]))
    scores = (rows[queries] @ rows.T).astype(np.int64)
    want = [(q, j, int(scores[i, j])) for i, q in enumerate(queries) for j in sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-scores[i, j], j))[:k]]
    return sorted(zip(*[best.table()[c].to_pylist() for c in ("query_id", "vec_id", "score")])), best.multiplied, sorted(want)


def test_buckets_are_pruned_by_length_and_by_coordinate(spark):
    rng = np.random.default_rng(8)
    lengths = 10 ** rng.uniform(0, 2, size=(4000, 1))
    found, multiplied, want = in_buckets(np.floor(rng.normal(size=(4000, 6)) * lengths * 100), np.arange(0, 4000, 200))
    assert found == want and multiplied < 0.5 * 20 * 4000
    near = np.repeat(rng.normal(size=(400, 6)), 10, axis=0)
    near = np.floor(1000 * (near + rng.normal(size=near.shape) * 0.01) / np.sqrt((near * near).sum(1, keepdims=True)))
    found, multiplied, want = in_buckets(near, np.arange(0, 4000, 200))
    assert found == want and multiplied < 0.3 * 20 * 4000
    # of the given vectors, of one length and far from each other, the method can leave none out
    given = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet").select("vec_id", topk_search.grid(F.col("embedding")).alias("v")).orderBy("vec_id").collect()
    found, multiplied, want = in_buckets(np.array([r["v"] for r in given]), np.arange(0, 2000, 50))
    assert found == want and multiplied <= 40 * 2000


def test_search_equals_all_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.floor(rng.normal(size=8) * 256 * 10 ** rng.uniform(-2, 2))]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(None, [1.0] * 8), (2000, [0.0] * 8), (2050, [0.0] * 8), (2100, [5.0, 3.0]), (2150, [2.0**40] * 8), (2200, [-(2.0**40)] * 8)]
    found = topk_search.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0).collect()
    padded = [(i, [int(x) for x in v] + [0] * (8 - len(v))) for i, v in rows if i is not None]
    want = []
    for i, x in padded:
        if i % 50 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), j) for j, y in padded if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, None]), (50, [float("nan"), 1.0]), (100, None), (150, [float("inf")]), (200, [0.5, 0.5])]
    usable = spark.createDataFrame(rows, "vec_id long, e array<float>").where(topk_search.usable(F.col("e")))
    assert [r["vec_id"] for r in usable.collect()] == [200]
    vectors = usable.select("vec_id", topk_search.grid(F.col("e")).alias("v"))
    assert topk_search.search(vectors, F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit(docs.where("doc_id % 4 != 2"), labels)
    held = quality_classifier.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > max(0.88, (held.quality == 1).mean())


def test_classifier_without_labels_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (2, ""), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, none)).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7)], "doc_id long, quality int")
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit(docs, one)).count() == 0


def test_hinge_loss_fit_separates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    y = np.where(x @ np.array([1, -2, 0, 0, 3, 0.5]) > 0.3, 1.0, -1.0)
    w, b = quality_classifier.dual_coordinate_descent([(np.arange(6), r) for r in x], y, 6, np.full(300, 10.0), 200)
    assert (np.sign(x @ w + b) == y).mean() > 0.97
