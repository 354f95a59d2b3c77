"""Compare a query with its SQL twin, as rows without order."""

import datetime
import decimal
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 9))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql, sf_dir):
    twin = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(twin.columns, twin.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
