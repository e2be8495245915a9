import pytest
from pyspark.sql import functions as F

from airlattice.operators import cycles
from airlattice.sources import snapshots
from airlattice.streaming import windows
from airlattice.streaming.cycles import detect_stream, split_known


def signal(*parts):
    """Pieces (seconds, from, to) at 40 Hz."""
    out = []
    for s, a, b in parts:
        n = round(s * 40)
        out += [a + (b - a) * i / n for i in range(n)]
    return out


EVENT = signal((3, 5, 5), (3, 5, 3), (2, 3, 3), (2, 3, 5), (5, 5, 5))


def found(pressures, cuts=1):
    state, out, n = cycles.State(), [], len(pressures)
    for k in range(cuts):
        part = range(k * n // cuts, (k + 1) * n // cuts)
        out += cycles.feed(state, [i / 40 for i in part], [pressures[i] for i in part])
        state = cycles.State.load(state.dump())
    return out + cycles.flush(state)


def test_one_event():
    (c,) = found(EVENT)
    assert 4.9 < c["first"] < 5.0 and c["drop"] > 0.2 and c["emergency"] and not c["over"] and not c["under"]


@pytest.mark.parametrize("parts", [[(3, 5, 5), (1, 5, 4.9), (2, 4.9, 4.9), (1, 4.9, 5), (5, 5, 5)], [(3, 5, 5), (0.5, 5, 4.7), (9, 4.7, 4.75), (2, 4.75, 5), (5, 5, 5)], [(10, 5, 5)], [(3, 3, 3), (3, 3, 1), (2, 1, 1), (2, 1, 3)]])
def test_no_event(parts):
    assert found(signal(*parts)) == []


def test_later_pressures():
    (c,) = found(EVENT + signal((65, 5, 5)))
    assert c["later"] == pytest.approx([5, 5])
    a, b = found(EVENT + signal((5, 5, 5)) + EVENT)
    assert a["later"] == [None, None] and b["start"] > a["end"]


@pytest.mark.parametrize("cuts", [2, 3, 7, 20])
def test_chunks_give_the_same(cuts):
    long = EVENT + signal((30, 5, 5)) + EVENT + signal((62, 5, 5))
    assert found(long, cuts) == found(long)


def key_of(r):
    return (r.sensor, round(r.start, 6), round(r.end, 6), round(r.drop, 9), r.after20, r.after60)


def line(parts, sensors):
    """Rows (sensor, seq, t, p) of some sensors, of which every other one is calm."""
    long = EVENT + signal((30, 5, 5)) + EVENT + signal((62, 5, 5)) + EVENT
    return [(s, i, i / 40, p if k % 2 == 0 else 5.0) for k, s in enumerate(sensors) for i, p in enumerate(long[: len(long) * parts // 3])]


@pytest.mark.parametrize("sensors, parts", [(["a"], 1), (["a"], 13), (["a", "b", None, "c", "d"], 7)])
def test_cuts_of_a_batch_change_nothing(spark, sensors, parts):
    rows = line(3, sensors)
    df = spark.createDataFrame([*rows, ("a", -1, None, None), ("a", -2, 3.0, None)], "sensor string, seq long, t double, p double")
    want = []
    for s in sensors:
        own = [r for r in rows if r[0] == s]
        state = cycles.State()
        found_ = cycles.feed(state, [r[2] for r in own], [r[3] for r in own]) + cycles.flush(state)
        want += [(s, round(c["start"], 6), round(c["end"], 6), round(c["drop"], 9), *c["later"]) for c in found_]
    got = cycles.detect(df, ["sensor"], "t", "p", "seq", parts=parts).collect()
    assert len(want) >= 3 and sorted(map(key_of, got), key=repr) == sorted(want, key=repr)
    for s in sensors:
        assert sorted(r.cycle for r in got if r.sensor == s) == list(range(1, 1 + sum(w[0] == s for w in want)))


def test_no_rows(spark):
    assert cycles.detect(spark.createDataFrame([], "sensor string, seq long, t double, p double"), ["sensor"], "t", "p", "seq").count() == 0


def test_the_causal_filter_is_the_plain_one():
    """Moving mean of 20, low-pass at 1 Hz, gradient, moving mean of 20; whatever the chunks."""
    x = EVENT[:300]
    mean = [sum(x[max(0, i - 19) : i + 1]) / min(i + 1, 20) for i in range(300)]
    y = []
    for i, m in enumerate(mean):
        y.append(0.0729596572682667 * (m + (mean[i - 1] if i else 0)) + 0.8540806854634666 * (y[-1] if y else 0))
    g = [0.0] + [(b - a) * 40 for a, b in zip(y, y[1:])]
    state = cycles.State()
    for k in range(300):
        cycles.feed(state, [k / 40], [x[k]])
        assert state.smooth == pytest.approx(y[k], abs=1e-12)
        assert sum(state.slopes) / len(state.slopes) == pytest.approx(sum(g[max(0, k - 19) : k + 1]) / min(k + 1, 20), abs=1e-9)


def test_a_later_pressure_is_the_nearest_and_not_from_afar():
    first = len(EVENT) / 40
    times = [i / 40 for i in range(len(EVENT))]
    (c,) = found(EVENT + signal((1, 5, 5)))
    state = cycles.State()
    cycles.feed(state, times, EVENT)
    end = state.done["end"]
    # Nothing between the end and +60 s but early samples, and the next sample comes 61 s too late.
    out = cycles.feed(state, [first, end + 121.5], [5.0, 5.0]) + cycles.flush(state)
    assert c["later"] == [None, None] and [o["later"] for o in out] == [[None, None]]
    state = cycles.State()
    cycles.feed(state, times, EVENT)
    a = cycles.feed(state, [end + 19, end + 20.5, end + 59.9, end + 61], [5.0, 4.0, 5.0, 4.0]) + cycles.flush(state)
    assert a[0]["later"][0] < 5 and a[0]["later"][1] is not None


T0 = 1_750_000_000


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_give_the_batch_cycles(spark, tmp_path, seed):
    """Rows are dealt to batches out of order, none later than the watermark allows; a last row of another series lets time pass."""
    import random

    rng = random.Random(seed)
    rows = [(s, i, T0 + t, p) for s, i, t, p in line(3, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "sensor string, seq long, s double, p double")
    want = sorted(map(key_of, cycles.detect(df, ["sensor"], "s", "p", "seq", parts=3).collect()))
    assert len(want) >= 6
    span = max(r[2] for r in rows) - T0
    dealt = {r: int((r[2] - T0 + rng.uniform(-9, 9)) / span * 5) for r in rows}
    batches = [[r for r in rows if min(max(dealt[r], 0), 4) == k] for k in range(5)] + [[("end", 0, T0 + 1e6, 5.0)], [("end", 1, T0 + 2e6, 5.0)]]
    for k, some in enumerate(batches):
        rng.shuffle(some)
        d = spark.createDataFrame(some, df.schema).select("sensor", "seq", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"), "p")
        d.coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    schema = "sensor string, seq long, ts timestamp, p double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = detect_stream(stream, "sensor", "ts", "p", "seq", "30 seconds").writeStream.format("memory").queryName(f"cycles{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(key_of, spark.table(f"cycles{seed}").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:] == pytest.approx(w[3:], abs=1e-6)


def test_unknown_sensors_are_set_apart(spark, tmp_path):
    rows = spark.createDataFrame([("x1", 1), ("x2", 2), ("x9", 3), (None, 4)], "sensor_id string, v int")
    labels = spark.createDataFrame([("x1", "MBP"), ("x2", "BC"), ("x2", "BC")], "sensor_id string, role string")
    known, unknown = split_known(rows, labels)
    assert sorted((r.sensor_id, r.role) for r in known.collect()) == [("x1", "MBP"), ("x2", "BC")]
    assert sorted(r.v for r in unknown.collect()) == [3, 4]
    rows.write.parquet(str(tmp_path / "in"))
    _, apart = split_known(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), labels)
    q = apart.writeStream.format("memory").queryName("apart").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.v for r in spark.table("apart").collect()) == [3, 4]


def test_windows(spark):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in (0, 4, 5, 29, 31, 59)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    t = windows.tumbling(df, "t", "v", "30 minutes", ["k"]).orderBy("start").collect()
    assert [(r.n, r.high) for r in t] == [(4, 29.0), (2, 59.0)]
    assert sum(r.n for r in windows.sliding(df, "t", "v", "30 minutes", "15 minutes", ["k"]).collect()) == 12
    s = windows.sessions(df, "t", "v", "10 minutes", ["k"]).orderBy("start").collect()
    assert [r.n for r in s] == [3, 2, 1]
    assert windows.deduplicated(df.union(df), "t", ["k", "t"], "1 hour").count() == 6


def test_late_rows_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 05:00:00", 1.0)], "t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    # The mark that a batch reaches drops rows from the batch after the next on.
    df.where("hour(t) = 5").withColumn("t", F.expr("t + interval 30 minutes")).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    df.where("hour(t) = 0").coalesce(1).write.parquet(str(tmp_path / "in/c"))
    out = windows.tumbling(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "t", "v", "1 hour", [], "10 minutes")
    q = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("late").collect()] == [1]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "table")
    assert snapshots.read(spark, path) is None
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (None, "x", 9.0)], "k long, j string, v double")
    b = spark.createDataFrame([(2, "x", 5.0), (None, "x", 7.0), (3, "x", 3.0)], a.schema)
    snapshots.merge(spark, path, a, ["k", "j"], [F.col("v")], 0)
    for _ in range(2):  # a repeated merge changes nothing
        snapshots.merge(spark, path, b, ["k", "j"], [F.col("v")], 1)
        assert sorted((r.k or 0, r.v) for r in snapshots.read(spark, path).collect()) == [(0, 7.0), (1, 1.0), (2, 5.0), (3, 3.0)]
    b.write.parquet(str(tmp_path / "in"))
    q = snapshots.merge_stream(spark.readStream.schema(b.schema).parquet(str(tmp_path / "in")), str(tmp_path / "t2"), ["k", "j"], [F.col("v")], str(tmp_path / "c2"))
    q.awaitTermination()
    assert snapshots.read(spark, str(tmp_path / "t2")).count() == 3


def test_an_old_batch_never_comes_back(spark, tmp_path):
    path = str(tmp_path / "table")
    one = lambda v: spark.createDataFrame([(7, v)], "k long, v double")
    snapshots.merge(spark, path, one(1.0), ["k"], [F.col("v")], "a")
    for i in range(4):
        snapshots.merge(spark, path, one(10.0 + i), ["k"], [F.col("v")], f"b{i}")
    snapshots.merge(spark, path, one(1.0), ["k"], [F.col("v")], "a")
    assert [r.v for r in snapshots.read(spark, path).collect()] == [13.0]
    assert len(snapshots.versions(spark, path)) == snapshots.KEEP
    # A version whose job hasn't committed isn't there.
    one(99.0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=000000099/batch=batch-x")
    assert [r.v for r in snapshots.read(spark, path).collect()] == [13.0]
