import importlib.util
import os
from collections import Counter

import corpus_pipeline
from airlattice.llm import mixing


def load(name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(os.path.dirname(__file__), name + ".py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_match_brute_force(spark, sf, tmp_path):
    near, leaks, base = load("test_jaccard"), load("test_decontam"), load("test_quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert k == 4 or docs.columns == columns
        ids = Counter(r.doc_id for r in after)
        if k == 0:
            for r in before:
                bad = base.brute(r.text)[-1] or labels.get(r.doc_id) == 0
                assert ids[r.doc_id] == (0 if bad else 1) or r.doc_id not in labels and not base.brute(r.text)[-1]
        if k == 1:
            want = near.brute([(r.doc_id, r.text) for r in before])
            assert ids == Counter({c[0]: 1 for c in want.values()})
        if k == 2:
            bad = {x[0] for x in leaks.brute([(r.doc_id, r.text) for r in before], items)}
            assert ids == Counter(r.doc_id for r in before if r.doc_id not in bad)
        if k == 3:
            plan = mixing.taken(spark.read.parquet(str(tmp_path / "2"))).collect()
            assert ids == Counter({r.doc_id: r.copies for r in plan if r.copies})
        if k == 4:
            assert ids == Counter(r.doc_id for r in before)
            slots = Counter((r.shard, r.slot) for r in after)
            assert set(slots.values()) == {1}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
