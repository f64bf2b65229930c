"""Comparison of result tables, whatever the order of their rows."""

import math

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    out = duck.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda k: out.columns[k])
    return [out.columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in out.fetchall()), key=repr)


def same(df, duck, sql):
    names, expected = rows_of_sql(duck, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
