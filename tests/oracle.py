"""Runs a query and its SQL over the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, (list, dict)) else v

    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def from_sql(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], normal([tuple(r[i] for i in order) for r in done.fetchall()])


def from_spark(df):
    names = sorted(df.columns)
    return names, normal([tuple(r) for r in df.select(*names).collect()])


def same(spark, sf_dir, query, sql):
    """Both results, for a test to compare."""
    return from_spark(query(spark, str(sf_dir))), from_sql(str(sf_dir), sql)
