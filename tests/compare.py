"""Row comparison of a query and its SQL, without regard to order."""

import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values), [names[k] for k in order]


def same(df, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    mine, names = rows(df.columns, df.collect())
    theirs, other = rows(want.columns, want.fetchall())
    assert names == other
    assert mine == theirs, (list((mine - theirs))[:3], list((theirs - mine))[:3])
