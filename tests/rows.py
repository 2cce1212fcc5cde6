"""Rows of results in a form that compares across engines."""

import datetime
import decimal
import math


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float, decimal.Decimal)):
        return repr(float(x))
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    names = sorted(columns)
    order = [columns.index(c) for c in names]
    return names, sorted(tuple(cell(r[i]) for i in order) for r in got.fetchall())
