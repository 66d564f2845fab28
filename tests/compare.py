"""Rows of a Spark query against rows of DuckDB SQL on the same tables."""

import os

import duckdb


def tables(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


def same(spark, query, sql, folder):
    ours = query(spark, folder)
    cursor = tables(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(ours.columns) == sorted(names)
    return rows(ours.columns, map(tuple, ours.collect())), rows(names, cursor.fetchall())
