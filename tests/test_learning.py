import math

import pytest
from pyspark.ml import Pipeline, PipelineModel

import __spark_entry__ as entry
from airlattice.plans import learning


def rows(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


def test_classifiers_and_grid(spark, sf):
    assert all(0.3 < r.auc < 0.8 for r in rows(spark, sf, "classifier_table"))
    assert {(r.depth, r.trees) for r in rows(spark, sf, "grid_search")} == {(2, 5), (2, 10), (4, 5), (4, 10)}


def test_choices(spark, sf):
    m = rows(spark, sf, "mixture_choice")
    assert [r.components for r in m] == [2, 3, 4] and all(r.bic > r.aic for r in m)
    assert [r.clusters for r in rows(spark, sf, "cluster_choice")] == [2, 3, 4]
    assert sum(r.best for r in rows(spark, sf, "selected_features")) == 2 and all(r.wide for r in rows(spark, sf, "selected_features"))


def test_calibration_rises_with_the_score(spark, sf):
    r = sorted((x.raw, x.probability) for x in rows(spark, sf, "calibrated_scores"))
    p = [x for _, x in r]
    assert len(r) > 5000 and (p == sorted(p) or p == sorted(p, reverse=True))


def test_ks_distance(spark, sf):
    v = sorted(r.value for r in spark.read.parquet(f"{sf}/events.parquet").collect())
    n, m = len(v), sum(v) / len(v)
    s = math.sqrt(sum((x - m) ** 2 for x in v) / (n - 1))
    cdf = [0.5 * math.erfc(-(x - m) / s / math.sqrt(2)) for x in v]
    want = max(max((i + 1) / n - c, c - i / n) for i, c in enumerate(cdf))
    assert rows(spark, sf, "ks_distance")[0].distance == pytest.approx(want, abs=1e-5)


def test_synthetic_vectors_lie_between(spark, sf):
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 1").collect()}
    got = rows(spark, sf, "smote_vectors")
    asked = [i for i in v if i % 20 == 0]
    assert len(got) == 2 * len(asked)
    for r in got[:6]:
        a = v[r.query_id]
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), i) for i, b in v.items() if i != r.query_id)[:3]
        between = []
        for _, i in near:
            d = [y - x for x, y in zip(a, v[i])]
            u = sum((z - x) * e for z, x, e in zip(r.embedding, a, d)) / sum(e * e for e in d)
            between.append(0 <= u < 1 and max(abs(x + u * e - z) for x, e, z in zip(a, d, r.embedding)) < 1e-5)
        assert any(between)


def test_saved_model(spark, sf, tmp_path):
    d = learning.labelled(spark, sf)
    model = Pipeline(stages=[learning.RandomForestClassifier(numTrees=3, seed=1, featuresCol="features", labelCol="label")]).fit(d)
    learning.save_model(model, str(tmp_path), {"features": learning.FEATURES, "trees": 3})
    again = PipelineModel.load(str(tmp_path / "model")).transform(d).select("prediction").agg({"prediction": "sum"}).first()[0]
    assert again == model.transform(d).agg({"prediction": "sum"}).first()[0]
    assert {r.key for r in spark.read.json(str(tmp_path / "about")).collect()} == {"features", "trees"}
