"""Holds a query's rows against those of its SQL in DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def difference(spark, sf_dir, query, sql):
    """None where the rows agree, else a few that don't."""
    frame = query(spark, sf_dir)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    con = connect(sf_dir)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    theirs = rows_of(names, done.fetchall())
    if sorted(names) != sorted(frame.columns):
        return sorted(frame.columns), sorted(names)
    if mine == theirs:
        return None
    return len(mine), len(theirs), sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
