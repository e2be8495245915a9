import pytest

import __spark_entry__ as entry
from airlattice.plans import catalog

from oracle import compare

entry._load()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, sf, name, catalog.QUERIES[name], catalog.ORACLES[name]) >= 0


def test_interval_merge_counts_days_as_its_sql(spark, sf, tmp_path):
    """Days before 1970, and instants that a double of seconds can't hold; a day that differs moves an interval or joins two."""
    import os

    import duckdb

    for f in os.listdir(sf):
        if f != "orders.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    days = {1: ["1969-11-20 01:00:00", "1969-12-10 23:00:00", "1969-12-11 00:00:00", "1969-12-31 12:00:00", "1970-01-01 12:00:00"], 2: ["9998-12-31 23:59:59.999999", "2254-12-31 23:59:59.999999"], 3: ["2000-01-01", "2000-01-21", "2000-02-11"], "NULL": ["2000-01-01", "2000-01-15"]}
    rows = [f"({k}, TIMESTAMP '{t}')" for k, v in days.items() for t in v] + ["(4, NULL)", "(4, TIMESTAMP '2000-01-01')"]
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {', '.join(rows)}) AS t(o_custkey, o_orderdate)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert compare(spark, str(tmp_path), "interval_merge", catalog.QUERIES["interval_merge"], catalog.ORACLES["interval_merge"]) == 9


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cycles_of_the_lines(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error' and value > 100").toPandas().sort_values(["ts", "event_id"])
    deep = {}
    for kit, value in zip(e.user_id, e.value):
        deep.setdefault(kit, []).append(int((value - 100) // 25))
    rows = entry.queries()["cycle_detection"](spark, sf).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.start):
        by.setdefault(r.kit, []).append(r)
    # The shallowest brakings are none; an emergency falls by 1.5 bar or more.
    assert {k: len(v) for k, v in by.items()} == {k: n for k, v in deep.items() if (n := sum(x >= 1 for x in v))}
    for k, found in by.items():
        assert [c.emergency for c in found] == [x >= 8 for x in deep[k] if x >= 1]
    f = entry.queries()["cycle_features"](spark, sf).collect()
    assert len(f) == len(rows) and all(x.energy > 0 and x.to_low <= x.timing for x in f)
    assert {r.kit: r.cycle for r in entry.queries()["reference_cycle"](spark, sf).collect()}.keys() == by.keys()
    parts = entry.queries()["feature_table"](spark, sf).collect()
    assert {(r.kit, r.phase) for r in parts} == {(r.kit, r.cycle) for r in rows} and len(parts) == 2 * len(rows)


@pytest.mark.parametrize("name", ["pca_components", "kmeans_clusters", "gated_scores", "feature_importance"])
def test_learning_queries(spark, sf, name):
    rows = entry.queries()[name](spark, sf).collect()
    assert rows
    if name == "gated_scores":
        assert len(rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
        assert all((r.score is not None) == r.in_scope for r in rows)
    if name == "kmeans_clusters":
        assert [r.cluster for r in rows] == [1, 2, 3] and rows[0].l_extendedprice <= rows[2].l_extendedprice
    if name == "feature_importance":
        assert abs(sum(r.importance for r in rows) - 1) < 1e-9


def test_works_without_the_training_data_operators(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("airlattice.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "airlattice.llm", None)
    assert "kit_diagnostics" in entry.queries() and not any(q.startswith("op1") for q in entry.queries())
