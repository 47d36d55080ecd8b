"""Equality of two results as multisets of rows, columns taken by name."""

import datetime
import math


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r.asDict(True)[c]) for c in names) for r in df.collect())


def assert_same(df, con, sql):
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[found.index(c)]) for c in sorted(found)) for r in cursor.fetchall())
    names, have = rows(df)
    assert names == sorted(found)
    assert have == want
