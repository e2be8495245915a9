"""Cleaning and rebalancing of labelled vectors by their nearest neighbours.

A stated set of queries meets all vectors in blocks (``joins.nearest_neighbours``); what follows are joins on keys. ``v`` has
(id, vector, label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearest_neighbours


def labelled_neighbours(v: DataFrame, queries: DataFrame, id_: str, vector: str, label: str, k: int) -> DataFrame:
    """(query_id, own, id, other, distance, nth): the k nearest of each query with both labels."""
    n = nearest_neighbours(v, queries, id_, vector, k)
    labels = v.select(F.col(id_).alias("_id"), F.col(label).alias("_label"))
    n = n.join(labels.withColumnsRenamed({"_id": "query_id", "_label": "own"}), "query_id")
    return n.join(labels.withColumnsRenamed({"_id": "id", "_label": "other"}), "id").select("query_id", "own", "id", "other", "distance", "nth")


def tomek_links(v: DataFrame, queries: DataFrame, id_: str, vector: str, label: str) -> DataFrame:
    """(query_id, own, id, other) of the queries whose nearest vector has them for its nearest, and another label."""
    ahead = labelled_neighbours(v, queries, id_, vector, label, 1).where(~F.col("own").eqNullSafe(F.col("other")))
    back = nearest_neighbours(v, v.join(ahead.select(F.col("id").alias(id_)).distinct(), id_, "left_semi"), id_, vector, 1)
    back = back.select(F.col("query_id").alias("id"), F.col("id").alias("query_id"))
    return ahead.join(back, ["id", "query_id"], "left_semi").select("query_id", "own", "id", "other")


def edited(v: DataFrame, queries: DataFrame, id_: str, vector: str, label: str, k: int = 3) -> DataFrame:
    """(query_id, own, same, kept): a query is kept if at least half of its k nearest have its label."""
    n = labelled_neighbours(v, queries, id_, vector, label, k)
    same = F.sum(F.col("own").eqNullSafe(F.col("other")).cast("int"))
    return n.groupBy("query_id", "own").agg(same.alias("same"), F.count(F.lit(1)).alias("n")).select("query_id", "own", "same", (F.col("same") * 2 >= F.col("n")).alias("kept"))


def adaptive_quotas(v: DataFrame, queries: DataFrame, id_: str, vector: str, label: str, minority, total: int, k: int = 5) -> DataFrame:
    """(query_id, foreign, quota): how many of ``total`` new vectors each minority query should give, by the share of foreign labels around it.

    All quotas are 0 where no query has a foreign neighbour.
    """
    n = labelled_neighbours(v, queries.where(F.col(label).eqNullSafe(F.lit(minority))), id_, vector, label, k)
    d = n.groupBy("query_id").agg(F.sum((~F.col("own").eqNullSafe(F.col("other"))).cast("int")).alias("foreign"))
    share = F.coalesce(F.try_divide(F.col("foreign"), d.agg(F.sum("foreign")).scalar()), F.lit(0.0))
    return d.select("query_id", "foreign", F.floor(share * total + 0.5).alias("quota"))


def reverse_cleaned(v: DataFrame, queries: DataFrame, id_: str, vector: str, k: int = 5) -> DataFrame:
    """(id, n, kept) of every vector: of how many queries it is one of the k nearest; those of none are left out as outliers."""
    n = nearest_neighbours(v, queries, id_, vector, k).groupBy(F.col("id").alias(id_)).agg(F.count(F.lit(1)).alias("n"))
    return v.select(id_).join(n, id_, "left").select(id_, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("kept"))
