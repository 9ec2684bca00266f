"""Rows of a registered query against the rows of its SQL in DuckDB."""

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(*duck(sf_dir, sql))
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]))
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    assert not bad, (ours[0], len(bad), bad[:3])
