"""Runs a query and its SQL and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.12g}"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) or "" for i in order) for r in data), [columns[i] for i in order]


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ours = query(spark, sf_dir)
    theirs = con.execute(sql)
    left = rows(ours.columns, [tuple(r) for r in ours.collect()])
    right = rows([c[0] for c in theirs.description], theirs.fetchall())
    assert left[1] == right[1]
    assert len(left[0]) == len(right[0])
    wrong = [(a, b) for a, b in zip(left[0], right[0], strict=True) if a != b]
    assert not wrong, wrong[:3]
