"""CSV scans, day-partitioned sinks, data sets by folder, and the registry of pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.operators import statistics


def scan_csv(spark: SparkSession, path: str, schema: str, time: str, keys: list[str]) -> DataFrame:
    """Feature files with a header and a given schema (ids as text); event_id numbers the rows by time, unknown times last, and keys."""
    d = spark.read.schema(schema).option("header", True).csv(path).withColumn("_one", F.lit(1))
    order = [F.asc_nulls_last(time), *[F.col(k) for k in keys]]
    return statistics.running_sums(d, order, {"_one": "event_id"}).withColumn("event_id", F.col("event_id") - 1).drop("_one")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one JSON object or array a file, with the file's name; what doesn't fit the schema is null, broken files are left out."""
    d = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    kept = d.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return kept.where("_broken IS NULL").drop("_broken")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def datasets(spark: SparkSession, path: str, folder: str = "kit", pattern: str = ".*") -> DataFrame:
    """The folders (such as kit=...) of a partitioned table whose names fit a pattern, in order."""
    d = _existing(spark, path)
    if d is None:
        return spark.createDataFrame([], f"{folder} string")
    return d.select(F.col(folder).cast("string").alias(folder)).distinct().where(F.col(folder).rlike(pattern)).orderBy(folder)


def write_new_days(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the partitions (such as kit and day) that the table doesn't have; those that are there stay as they are."""
    old = _existing(df.sparkSession, path)
    new = df if old is None else df.join(F.broadcast(old.select(*keys).distinct()), keys, "left_anti")  # a row a partition
    new.write.mode("append").partitionBy(*keys).parquet(path)


def write_folders(df: DataFrame, path: str, folder: str) -> None:
    """One table, laid out by folder; a folder that is written again is replaced, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(folder).parquet(path)


def ingest_days(spark: SparkSession, days: list[str], load: Callable[[str], DataFrame], path: str, errors: str) -> list[str]:
    """A Spark job for each day that isn't there yet; a day that fails leaves a row (day, error) and doesn't stop the others.

    ``load`` gives a day's rows; the days done are returned.
    """
    old = _existing(spark, path)
    there = set() if old is None else {str(r[0]) for r in old.select("day").distinct().collect()}
    done, failed = [], []
    for day in days:
        if day in there:
            continue
        try:
            load(day).drop("day").write.mode("overwrite").parquet(f"{path}/day={day}")
            done.append(day)
        except PySparkException as e:
            failed.append((day, str(e)[:2000]))
    if failed:
        spark.createDataFrame(failed, "day string, error string").coalesce(1).write.mode("append").parquet(errors)
    return done


def store_pairs(spark: SparkSession, pairs: DataFrame, path: str) -> bool:
    """Writes the registry of pairs unless a row of it says use_reference_phase: then it is locked and stays. Whether it was written."""
    old = _existing(spark, path)
    if old is not None and not old.where("use_reference_phase").isEmpty():
        return False
    pairs.write.mode("overwrite").parquet(path)
    return True


def may_start(spark: SparkSession, labels: DataFrame, pairs: str, kit: str) -> list[str]:
    """Why a kit's live query can't start: no labels, no pairs, or pairs that aren't locked. Empty if it can."""
    old = _existing(spark, pairs)
    mine = None if old is None else old.where(F.col("kit") == kit)
    out = ["no labels"] if labels.where(F.col("kit") == kit).isEmpty() else []
    if mine is None or mine.isEmpty():
        return [*out, "no pairs"]
    return out if not mine.where("use_reference_phase").isEmpty() else [*out, "pairs are not locked"]
