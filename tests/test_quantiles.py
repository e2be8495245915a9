"""Exact quantiles: rows stay where they are, and groups that are many give the same as groups that are few."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import statistics


@pytest.mark.parametrize("few", [0, 4096])
def test_quantiles_of_few_and_many_groups(spark, few):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(500)).cast("double")).alias("x"))
    rows = [(r["k"], r["x"]) for r in d.collect()]
    want = {k: np.quantile([x for j, x in rows if j == k and x is not None], [0.05, 0.5]) for k in (None, 1, 2)}
    got = {r["k"]: r for r in statistics.quantiles(d, "k", "x", {"a": 0.05, "b": 0.5}, few=few).collect()}
    assert set(got) == set(want)
    assert all(np.allclose([got[k]["a"], got[k]["b"]], want[k]) for k in want)
    met = statistics.with_quantiles(d, "k", "x", {"a": 0.05, "b": 0.5}, few=few).collect()
    assert len(met) == 3000
    assert all(np.allclose([r["a"], r["b"]], want[r["k"]]) for r in met)


def test_rows_arent_dealt_by_group(spark):
    """Three groups hold all rows: only what was aggregated is shuffled."""
    d = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    plan = statistics.within_iqr(d, "k", "x")._jdf.queryExecution().executedPlan().toString()
    for join in re.findall(r"SortMergeJoin [^\n]*", plan):
        assert "x#" not in join
    assert plan.count("BroadcastHashJoin") >= 3
