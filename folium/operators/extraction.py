"""A slot for extractors of dated events: pieces of a text in, replies with JSON in them out."""

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators import events

#: Texts in, one reply for each; a reply holds a JSON list of {date_text, event_description} or something like it.
Extractor = Callable[[list[str]], list[str]]
EVENT = "array<struct<date_text string, event_description string>>"


def year_clauses(texts: list[str]) -> list[str]:
    """A stand-in for a model: each number of four digits dates the words up to the next full stop. Where a text
    has one event alone the reply is not quite JSON, as a model's may be."""
    replies = []
    for t in texts:
        found = [{"date_text": m[1], "event_description": m[2].strip()} for m in re.finditer(r"\b([0-9]{4})\b([^.]+)\.", t)]
        replies.append(f"Here: {json.dumps(found)}." if len(found) != 1 else f"Here: [{json.dumps(found[0])}, ...")
    return replies


def pieces(texts: DataFrame, size: int = 4000, most: int | None = None) -> DataFrame:
    """doc_id, piece, text: the text, or its first most characters, in pieces of size that do not overlap."""
    n = F.length("text") if most is None else F.least(F.length("text"), F.lit(most))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = texts.select("doc_id", "text", F.posexplode(starts).alias("piece", "start"))
    return cut.select("doc_id", "piece", F.substring(F.col("text"), F.col("start") + 1, F.least(F.lit(size), n - F.col("start"))).alias("text"))


def extracted(texts: DataFrame, extract: Extractor, size: int = 4000, most: int | None = None) -> DataFrame:
    """doc_id, piece, n, date_text, event_description: what stands between the first [ and the last ] of each reply
    as JSON, or else what salvage finds in the reply."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=extract(frame["text"].tolist()))[["doc_id", "piece", "reply"]]

    kind = texts.schema["doc_id"].dataType.simpleString()
    replies = pieces(texts, size, most).mapInPandas(run, f"doc_id {kind}, piece int, reply string")
    replies = replies.withColumn("reply_id", F.struct("doc_id", "piece"))
    strict = F.from_json(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), EVENT)
    read = replies.withColumn("found", strict).withColumn("fine", F.col("found").isNotNull() & ~F.exists("found", lambda x: x["date_text"].isNull()))
    whole = read.where("fine").select("reply_id", F.posexplode("found").alias("n", "event")).select("reply_id", "n", "event.date_text", "event.event_description")
    salvaged = events.salvaged_events(read.where("not fine").select("reply_id", "reply"))
    return whole.unionByName(salvaged).select("reply_id.doc_id", "reply_id.piece", "n", "date_text", "event_description")
