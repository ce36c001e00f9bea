"""All queries over the sample tables, and the SQL that each is checked against where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.catalogue import formats, libraries, lifecycle, models, stores, texts, timelines, vectors

_ALL = texts.QUERIES | timelines.QUERIES | libraries.QUERIES | vectors.QUERIES | formats.QUERIES | lifecycle.QUERIES | models.QUERIES | stores.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
