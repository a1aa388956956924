"""Row-wise comparison of a Spark result with DuckDB's, or with any list of tuples."""

import os

import duckdb


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def duck(sql, sf, columns):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return sorted((tuple(r) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()), key=repr)


def plain(row):
    return tuple(round(x, 4) if isinstance(x, float) else x for x in row)


def same(df, sql, sf):
    columns = sorted(df.columns)
    a, b = [plain(r) for r in rows_of(df, columns)], [plain(r) for r in duck(sql, sf, columns)]
    assert len(a) == len(b)
    assert sorted(a, key=repr) == sorted(b, key=repr)
