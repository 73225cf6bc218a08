"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def data_dir(sf="sf0.001"):
    return f"{os.environ.get('TESTDATA', '/root/testdata')}/{sf}"


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, datetime.date)):
        return repr(v)
    if isinstance(v, dict):
        return repr(sorted((k, plain(x)) for k, x in v.items()))
    return repr([plain(x) for x in v])


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(connection, sql):
    q = connection.execute(sql)
    names = [x[0] for x in q.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())
