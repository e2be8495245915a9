"""An upsert table of Parquet snapshots: each merge writes a whole new version beside the last, readers take the newest.

A version appears only when its job has committed, so a failed merge leaves the table as it was and can be repeated. The next
version is the newest and one, whoever writes. What was merged is remembered for good by batch names in the table's log, so
a batch that comes again, however late, changes nothing and a stream with a new checkpoint can't fall behind. Versions are
listed from folder names, without reading rows. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from airlattice.operators import joins

#: Versions that are kept; a reader of an older one must have finished.
KEEP = 3


#: Marks that Spark leaves when a write has committed, and the folder of merged batches' names.
DONE, LOG = "_SUCCESS", "_merged"


def _folder(spark: SparkSession, path: str):
    """The folder in Hadoop's terms, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, batch) of the committed versions that are there, oldest first; at most ``KEEP`` and those of an interrupted merge."""
    pattern, fs = _folder(spark, f"{path}/version=*/batch=*/{DONE}")
    found = [str(f.getPath().getParent().toString()) for f in fs.globStatus(pattern) or []]
    return sorted((int(f.split("/version=")[-1].split("/")[0]), f.split("/batch=")[-1]) for f in found)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None where there is none yet."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version={found[-1][0]:09d}/batch={found[-1][1]}") if found else None


def _remember(spark: SparkSession, path: str, name: str) -> None:
    where, fs = _folder(spark, f"{path}/{LOG}/{name}")
    if not fs.exists(where):
        fs.create(where).close()


def _merged(spark: SparkSession, path: str, name: str) -> bool:
    where, fs = _folder(spark, f"{path}/{LOG}/{name}")
    return fs.exists(where)


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], batch: int | str, prefer_new: bool = True) -> None:
    """Merges ``new`` into the table as its next version; a batch that was ever merged is left out.

    An empty merge into an empty table writes no rows. Rows of ``new`` with equal keys are one, the first by ``order``.
    """
    found, name = versions(spark, path), f"batch-{batch}"
    if name in {b for _, b in found} or _merged(spark, path, name):
        return
    old = read(spark, path)
    both = joins.upsert(old, new, keys, order, prefer_new) if old is not None else joins.upsert(new.limit(0), new, keys, order)
    number = found[-1][0] + 1 if found else 0
    both.write.mode("overwrite").parquet(f"{path}/version={number:09d}/batch={name}")
    # A merge that ends here leaves its name in its version's folder; that goes to the log before the folder goes.
    for version, past in [*found, (number, name)]:
        _remember(spark, path, past)
    for version, _ in found[: max(0, len(found) + 1 - KEEP)]:
        _delete(spark, f"{path}/version={version:09d}")


def clear(spark: SparkSession, path: str) -> None:
    """Deletes the table with all its versions."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


def merge_stream(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str, prepare=None):
    """A streaming query that merges each micro-batch, after ``prepare`` (such as scoring) where given; available data only."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint.replace("/", "_")
        merge(spark, path, prepare(df) if prepare else df, keys, order, f"{query}-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
