from pyspark.sql import functions as F

from airlattice.sources import snapshots, tables


def test_new_checkpoint_keeps_rows(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v double"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    for i in range(2):
        rows((i, 1.0)).write.parquet(str(tmp_path / f"in{i}"))
    for i in range(2):  # the second stream starts with a new checkpoint: its batches count from 0 again
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}"))
        snapshots.merge_stream(stream, path, ["k"], [F.col("v")], str(tmp_path / f"c{i}"), lambda d: d.withColumn("v", F.col("v") * 2)).awaitTermination()
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == [(0, 2.0), (1, 2.0)]
    for i in range(5):
        snapshots.merge(spark, path, rows((7, float(i))), ["k"], [F.col("v")], f"more-{i}")
    snapshots.merge(spark, path, rows((7, 0.0)), ["k"], [F.col("v")], "more-4")  # again
    found = snapshots.versions(spark, path)
    assert len(found) == snapshots.KEEP and found[-1] == (6, "batch-more-4")
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {(0, 2.0), (1, 2.0), (7, 4.0)}
    snapshots.merge(spark, path, rows((7, 9.0), (8, 1.0)), ["k"], [F.col("v")], "old-first", prefer_new=False)
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {(0, 2.0), (1, 2.0), (7, 4.0), (8, 1.0)}
    snapshots.clear(spark, path)
    assert snapshots.read(spark, path) is None


def test_csv_ids_and_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t,x\n007,2024-01-02 00:00:00,1\n001,,2\n003,2024-01-01 00:00:00,\n")
    d = tables.scan_csv(spark, str(tmp_path / "a.csv"), "id string, t timestamp, x double", "t", ["id"])
    assert [(r.id, r.x, r.event_id) for r in d.orderBy("event_id").collect()] == [("003", None, 0), ("007", 1.0, 1), ("001", 2.0, 2)]
    path = str(tmp_path / "kits")
    assert tables.datasets(spark, path).collect() == []
    spark.createDataFrame([("K1", "2024-01-01", 1), ("K2", "2024-01-01", 2), ("X", "2024-01-01", 3)], "kit string, day string, v long").write.partitionBy("kit").parquet(path)
    assert [r.kit for r in tables.datasets(spark, path, pattern="^K").collect()] == ["K1", "K2"]


def test_days_are_written_once(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda *x: spark.createDataFrame(list(x), "kit string, day string, v long")
    tables.write_new_days(rows(("a", "2024-01-01", 1)), path, ["kit", "day"])
    tables.write_new_days(rows(("a", "2024-01-01", 9), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3)), path, ["kit", "day"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    folders = str(tmp_path / "folders")
    tables.write_folders(rows(("a", "x", 1), ("b", "x", 2)), folders, "kit")
    tables.write_folders(rows(("b", "x", 5)), folders, "kit")
    assert sorted(r.v for r in spark.read.parquet(folders).collect()) == [1, 5]


def test_a_failed_day_stops_no_other(spark, tmp_path):
    path, errors = str(tmp_path / "t"), str(tmp_path / "e")

    def load(day):
        d = spark.createDataFrame([(day, 1)], "day string, v long")
        return d.withColumn("v", F.expr("raise_error('broken')").cast("long")) if day == "2024-01-02" else d

    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert tables.ingest_days(spark, days, load, path, errors) == ["2024-01-01", "2024-01-03"]
    (e,) = spark.read.parquet(errors).collect()
    assert e.day == "2024-01-02" and "broken" in e.error
    assert tables.ingest_days(spark, [*days, "2024-01-04"], load, path, errors) == ["2024-01-04"]


def test_pairs_are_locked(spark, tmp_path):
    path = str(tmp_path / "pairs")
    pairs = lambda lock, bc: spark.createDataFrame([("K1", bc, "w", lock)], "kit string, bc string, wv string, use_reference_phase boolean")
    labels = spark.createDataFrame([("K1", "0x1")], "kit string, sensor string")
    assert tables.may_start(spark, labels, path, "K2") == ["no labels", "no pairs"]
    assert tables.store_pairs(spark, pairs(False, "a"), path) and tables.may_start(spark, labels, path, "K1") == ["pairs are not locked"]
    assert tables.store_pairs(spark, pairs(True, "b"), path) and not tables.store_pairs(spark, pairs(True, "c"), path)
    assert spark.read.parquet(path).first().bc == "b" and tables.may_start(spark, labels, path, "K1") == []


def test_json_files(spark, tmp_path):
    from airlattice.sources import tables

    (tmp_path / "a.json").write_text('{\n "id": 1,\n "score": 0.5, "more": [1]}')
    (tmp_path / "b.json").write_text('[{"id": 2}, {"id": 3, "score": 2}]')
    (tmp_path / "c.json").write_text('{"id": ')
    rows = tables.scan_json(spark, str(tmp_path), "id long, score double").collect()
    assert {(r.file, r.id, r.score) for r in rows } == {("a.json", 1, 0.5), ("b.json", 2, None), ("b.json", 3, 2.0)}


def test_healthy_rows_with_several_outliers(spark):
    from pyspark.sql import functions as F

    from airlattice.operators import statistics

    rows = [(i, 0, float(i % 5), float(i % 3)) for i in range(40)] + [(100, 0, 50.0, 60.0), (101, 0, 50.0, 1.0), (102, 1, 50.0, 60.0), (103, None, 50.0, 60.0), (104, 0, None, 60.0)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    left = {r.id for r in statistics.upper_violations(df, ["a", "b"], F.col("y") == 0, 2.0).collect()}
    assert left == {r[0] for r in rows} - {100}
    few = df.where("id in (1, 2, 100)")
    assert statistics.upper_violations(few, ["a", "b"], F.col("y") == 0, 0.1).count() == 3
