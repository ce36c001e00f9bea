import time

from pyspark.sql import functions as F

from folium.operators import vectors


def test_windows_across_blocks_of_a_long_text(spark):
    text = "".join(chr(97 + i * i % 23) if i % 5 else "é😀\n"[i % 3] for i in range(600_000))
    frame = spark.createDataFrame([(1, text), (2, text[:2049]), (3, ""), (4, None), (5, "x")], "id int, text string")
    for length, steps in ((32, 16), (7, 5)):
        start = time.monotonic()
        got = {r["id"]: r["w"] for r in frame.where("id = 1 or length(text) < 3000 or text is null").select("id", vectors.context_windows(F.col("text"), length, steps).alias("w")).collect()}
        assert time.monotonic() - start < 20
        for i, t in ((1, text), (2, text[:2049]), (5, "x")):
            n, want = len(t), []
            for at in range(0, n, steps):
                low, high = max(at - length // 2, 0), min(at + length // 2 + length % 2, n)
                want.append(t[max(n - length, 0) if high == n and low > 0 else low : min(length, n) if low == 0 and high < n else high])
            assert got[i] == want
        assert got[3] == [""] and got[4] == [None]
