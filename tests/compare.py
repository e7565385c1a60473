"""A query against its SQL on the same parquet files."""

from __future__ import annotations

from pathlib import Path

SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str = SMALL):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def same(spark, con, query, sql, sf_dir: str = SMALL) -> None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
