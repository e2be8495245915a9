"""Comparison of a query with its SQL in DuckDB: same columns, same rows in any order, same values to the last digits that a sum may shift."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_integer_ratio") or type(value).__name__ == "Decimal":
        return int(value) if float(value).is_integer() else float(value)
    return str(value)


def place(row):
    """Order by what is exact first, then by numbers without their last digits."""
    exact = [str(v) for v in row if not isinstance(v, float)]
    return exact, [float(f"{v:.8g}") for v in row if isinstance(v, float)]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: str(place(r)))


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, sf, name, f, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = f(spark, sf)
    got = rows_of(out.columns, out.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(out.columns) == sorted(rel.columns), name
    assert len(got) == len(want), f"{name}: {len(got)} rows, {len(want)} wanted"
    for g, w in zip(got, want):
        assert all(same(a, b) for a, b in zip(g, w)), f"{name}: {g} {w}"
    return len(got)
