"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from airlattice.session import ship

from . import codes, decontam, jaccard, lm, merkle, mixing, pii, quality, sharding, simhash, tokens, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score", "threshold")


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality.*")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_token_counts": op2_token_counts,
        "op3_url_filter": op3_url_filter,
        "op4_sampled_splitters": op4_sampled_splitters,
        "op5_pivotal_mixing": op5_pivotal_mixing,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_personal_data": op8_personal_data,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
        "op11_vector_codes": op11_vector_codes,
        "op12_simhash": op12_simhash,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": corpus_pipeline.run,
    }


#: Shingles as joined words. Items of fewer than five words don't occur in the tables.
OP9_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM iw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
dw AS (SELECT DISTINCT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM dw WHERE len(w) >= 5)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, text, item_id, n_item HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": OP9_SQL, "op11_vector_codes": codes.SQL, "op13_merkle_manifest": merkle.SQL}
