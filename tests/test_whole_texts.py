import hashlib
import re

import pytest

from folium import catalogue
from folium.functions import keys

YEAR = re.compile(r"(?<!\w)(?:18|19|20)\d\d(?!\w)")
FILLER = "The river of long words runs on and on.\n" * 40
TEXTS = [FILLER + "In 1848 it rose, in 2031 it fell; 18480 and a1999 are none. " + FILLER + "1901", "short", "of the 1999 " + "x" * 500 + " 1850"]


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def rows(spark, tmp_path):
    docs = spark.createDataFrame([(i + 20, t, "en", "src1") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()


def test_years_anywhere_in_a_text(rows):
    want = set()
    for i, text in enumerate(TEXTS):
        marked = f"{text[:80]}\n{1790 + i + 20} {text[80:]}"
        for m in YEAR.finditer(marked):
            snippet = marked[max(0, m.start() - 50) : m.start() + 20].translate(str.maketrans("\n\r\t", "   "))
            want.add((i + 20, m.start(), int(m.group()), _md5(snippet)))
    assert len(want) == 8
    assert {tuple(r) for r in rows("year_mentions")} == want


def test_windows_of_a_whole_text(rows):
    want = set()
    for i, text in enumerate(TEXTS):
        n = len(text)
        for k in range((n - 1) // 16 + 1):
            start, end = max(0, k * 16 - 16), min(n, k * 16 + 16)
            low = max(n - 32, 0) if end == n and start > 0 else start
            high = min(32, n) if start == 0 and end < n else end
            want.add((i + 20, k, _md5(text[low:high])))
    assert {tuple(r) for r in rows("context_windows")} == want


def test_important_words_of_a_whole_text(rows):
    want = {(i + 20, " ".join(w for w in text.lower().split(" ") if w not in keys.STOP_WORDS)) for i, text in enumerate(TEXTS)}
    assert {tuple(r) for r in rows("important_words")} == want


def test_round_trip_of_a_whole_text(spark, tmp_path, monkeypatch):
    from folium.sources import notes

    # what is converted is the whole text, and letters and points come back as they were
    seen = []
    plain = notes.round_trips
    monkeypatch.setattr(notes, "round_trips", lambda frame: seen.append(frame) or plain(frame))
    docs = spark.createDataFrame([(i + 21, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same = {r["note_id"]: r["same"] for r in catalogue.queries()["md_org_roundtrip"](spark, str(tmp_path)).collect()}
    given = {r["note_id"]: r["text"] for r in seen[0].collect()}
    for i, text in enumerate(TEXTS):
        assert re.sub(r"[^A-Za-z\n .]", "", text) in given[i + 21]
    assert same == {i + 21: True for i in range(len(TEXTS))}
