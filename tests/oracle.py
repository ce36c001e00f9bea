"""Compares a query with its SQL: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(query, sql: str, spark, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got, want = rows_of(df.columns, df.collect()), rows_of(*expected(sql, sf_dir))
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
        return f"{len(got[1])} and {len(want[1])} rows; only here {a}; only in SQL {b}"
    return ""
