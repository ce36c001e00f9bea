from collections import Counter

import pytest

from folium import catalogue
from folium.plans.samples import chunks


def test_shades_of_all_chunks_of_documents_of_different_length(spark, tmp_path):
    # the last chunks of some documents are missing
    ids = [i for i in range(60) if i < 23 or 30 <= i < 31 or i >= 40]
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = [(r["doc"], r["chunk_index"]) for r in chunks(spark, str(tmp_path)).collect()]
    most = {doc: max(i for d, i in held if d == doc) for doc, _ in held}
    assert len(held) == len(ids) and len(set(Counter(d for d, _ in held).values())) > 1
    got = {(r["doc"], r["chunk_index"]): r["lightness"] for r in catalogue.queries()["doc_shade"](spark, str(tmp_path)).collect()}
    assert got == {(d, i): pytest.approx(0.6 - i / most[d] * 0.3 if most[d] else 0.5, abs=1e-6) for d, i in held}
