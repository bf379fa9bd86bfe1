"""Runs a catalogue query in Spark and its SQL in DuckDB and compares them value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", v if v else 0.0)
    return ("s", str(v))


def compare(df, con, sql: str, limit: int = 5) -> list[str]:
    """Differences found, none when both sides agree on columns, kinds and every value."""
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return [f"columns: spark {cols} sql {sorted(names)}"]
    order = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return [f"rows: spark {len(got)} sql {len(want)}"] + _diff(got, want, cols, limit)
    return _diff(got, want, cols, limit)


def _diff(got, want, cols, limit):
    from collections import Counter
    a, b = Counter(got), Counter(want)
    only_a, only_b = sorted((a - b).elements(), key=str), sorted((b - a).elements(), key=str)
    out = [f"spark only {dict(zip(cols, r))}" for r in only_a[:limit]]
    out += [f"sql only   {dict(zip(cols, r))}" for r in only_b[:limit]]
    if out:
        out.insert(0, f"{len(only_a)} rows only in spark, {len(only_b)} only in sql")
    return out
