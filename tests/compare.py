"""Compare a query's rows with its SQL in DuckDB."""

import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in os.listdir(sf_dir):
        src = f"{sf_dir}/{p}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{p}") else "")
        con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{src}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NULL" if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return "NULL" if value is None else str(float(value)) if type(value).__name__ == "Decimal" else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


def same(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())
