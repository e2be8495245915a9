"""What made queries grow: rows laid out once for each distinct count, inputs prepared anew for every fit, and equal rows fitted one by one."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as entry
from airlattice.plans import learning


def test_file_summary_lays_its_rows_out_once(spark, sf):
    plan = entry.queries()["file_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "props" not in plan


@pytest.mark.parametrize("name, kind, fits", [("cluster_choice", "KMeans", 3), ("mixture_choice", "GaussianMixture", 3), ("grid_search", "RandomForestClassifier", 12)])
def test_fits_read_what_was_prepared_once(spark, sf, monkeypatch, name, kind, fits):
    seen, plain = [], getattr(learning, kind).fit

    def fit(self, d, *setting):
        seen.append(("InMemoryRelation" in d._jdf.queryExecution().withCachedData().toString(), d.storageLevel.useMemory))
        return plain(self, d, *setting)

    monkeypatch.setattr(getattr(learning, kind), "fit", fit)
    assert entry.queries()[name](spark, sf).count() in (3, 4)
    assert seen == [(True, False)] * fits


@pytest.fixture(scope="module")
def repeated(spark, sf, tmp_path_factory):
    """A folder with a lineitem of which some rows are there nine times and others once."""
    path = str(tmp_path_factory.mktemp("repeated"))
    d = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("l_quantity") > 25, 9).otherwise(1))))
    d.withColumn("l_orderkey", F.col("l_orderkey") + 1_000_000 * F.col("n")).drop("n").write.parquet(f"{path}/lineitem.parquet")
    return path


def recorded(monkeypatch, kind, method):
    """The list to which each call of the class's method adds what it got and gave."""
    seen, plain = [], getattr(kind, method)

    def f(self, d, *more):
        out = plain(self, d, *more)
        seen.append((d, out))
        return out

    monkeypatch.setattr(kind, method, f)
    return seen


def test_clusters_of_equal_rows_are_those_of_their_number(spark, repeated, monkeypatch):
    rows = learning.labelled(spark, repeated)
    total, different = rows.count(), rows.select(*learning.FEATURES).distinct().count()
    seen = recorded(monkeypatch, learning.KMeans, "fit")
    got = [r.silhouette for r in entry.queries()["cluster_choice"](spark, repeated).collect()]
    assert total > 4 * different
    assert [tuple(d.agg(F.count("*"), F.sum("weight")).first()) for d, _ in seen] == [(different, total)] * 3
    monkeypatch.undo()
    assert got == pytest.approx([ClusteringEvaluator().evaluate(m.transform(rows)) for _, m in seen], abs=1e-9)


@pytest.mark.parametrize("lots", [None, 2000])
def test_forests_draw_rows_or_lots_of_equal_ones(spark, repeated, monkeypatch, lots):
    total = spark.read.parquet(f"{repeated}/lineitem.parquet").count()
    if lots:
        monkeypatch.setattr(learning, "LOTS", lots)
    fits, areas = recorded(monkeypatch, learning.RandomForestClassifier, "fit"), recorded(monkeypatch, BinaryClassificationEvaluator, "evaluate")
    assert len(entry.queries()["grid_search"](spark, repeated).collect()) == 4
    sizes = [d.agg(F.count("*"), F.sum("weight"), F.max("weight")).first() for d, _ in fits]
    # Every row is in two of three training sets, for each of four settings.
    assert sum(s[1] for s in sizes) == pytest.approx(8 * total)
    if lots:
        assert all(s[0] < 0.6 * s[1] and 1 < s[2] <= total / lots for s in sizes)
    else:
        assert all(s[0] == s[1] and s[2] == 1 for s in sizes)
    monkeypatch.undo()
    for d, area in areas[:4]:
        plain = d.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
        assert area == pytest.approx(BinaryClassificationEvaluator(labelCol="label").evaluate(plain), abs=1e-9)
