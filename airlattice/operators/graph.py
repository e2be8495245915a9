"""Connected components of links that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.session import shared_dir


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the links (a, b), of any type that orders; nodes without links are left out.

    Every round takes the least label of the neighbours, then the label of that label, so long chains halve. Nulls link
    nothing. Labels are written to the shared folder after each round, which cuts the lineage.
    """
    shared_dir(links.sparkSession)
    links = links.select("a", "b").where("a is not null and b is not null")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = met.join(up, "label").select("node", "old", F.least("label", "top").alias("label")).checkpoint()
        if new.where("label != old").isEmpty():
            return labels
        labels = new.drop("old")
