"""Small rules of the catalogue: bins closed on the right, the clock, optional columns, healthy rows with several outliers, transposed means."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.functions.columns import clock, right_closed_bin
from airlattice.operators import cleaning, statistics
from airlattice.session import table

from .catalog import query
from .telemetry import events

EDGES = [10.0, 34.59, 100.0]


@query("right_closed_bins", "SELECT CASE WHEN value <= 10 THEN 0 WHEN value <= 34.59 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS bin, count(*) AS n, max(value) AS most FROM events GROUP BY 1")
def right_closed_bins(spark, sf_dir):
    """Readings by bins that hold their upper edge."""
    return events(spark, sf_dir).groupBy(right_closed_bin(F.col("value"), EDGES).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query(
    "recordings_of_the_morning",
    "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND hour(ts) * 60 + minute(ts) BETWEEN 330 AND 585 ORDER BY ts, event_id LIMIT 200",
)
def recordings_of_the_morning(spark, sf_dir):
    """Of the days wanted, what was recorded from 5:30 to 9:45, and of that the first 200: the cap is the report's."""
    day = F.to_date("ts").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date"))
    return events(spark, sf_dir).where(day & clock("ts").between(330, 585)).select("event_id", "ts").orderBy("ts", "event_id").limit(200)


@query("optional_columns", "SELECT event_id, value, user_id FROM events")
def optional_columns(spark, sf_dir):
    """The wanted columns that are there."""
    return cleaning.present(events(spark, sf_dir), ["event_id", "value", "humidity", "user_id", "altitude"])


OUTLIER = ("l_quantity", "l_extendedprice", "l_tax")


@query(
    "several_outliers",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) + 0.9 * stddev_samp({c}) AS {c}_high" for c in OUTLIER)
    + " FROM lineitem WHERE l_returnflag = 'N'), v AS (SELECT l_orderkey, l_linenumber, l_returnflag, "
    + " + ".join(f"CASE WHEN {c} > {c}_high THEN 1 ELSE 0 END" for c in OUTLIER)
    + " AS n FROM lineitem, s) SELECT l_orderkey, l_linenumber, l_returnflag FROM v WHERE NOT (l_returnflag = 'N' AND n >= 2)",
)
def several_outliers(spark, sf_dir):
    """All lines but the healthy ones that are high in two measures or more."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *OUTLIER)
    return statistics.upper_violations(d, list(OUTLIER), F.col("l_returnflag") == "N", 0.9).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("transposed_means", " UNION ALL ".join(f"SELECT '{c}' AS feature, " + ", ".join(f"avg({c}) FILTER (l_returnflag = '{v}') AS \"{v}\"" for v in "ANR") + " FROM lineitem" for c in OUTLIER))
def transposed_means(spark, sf_dir):
    """A row a feature, a column a class."""
    return statistics.means_by_feature(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R"], list(OUTLIER))
