import os
import random
import struct
import time

import numpy as np

from airlattice.sources import recordings as R
from airlattice.sources.brakebin import BrakeBin, recording


def packet(start, counts, kind=1):
    return struct.pack("<6B4Hh", 1, 2, 3, 4, 5, kind, 3300, 5000, 10, 20, 2150) + struct.pack("<Q80h3HBB", start, *counts, 80, 0, 0, 200, 0)


def wake():
    return bytes([1, 2, 3, 4, 5, 0x20]) + bytes(13)


def fix(ms, lat, lon, filler=False):
    return struct.pack("<3f", lat, lon, 36.0) + b"\x21\x0e" + bytes(8) + struct.pack("<3H", 1200, 500, 1250) + b"\r\n" + (b"\x00" if filler else b"") + struct.pack("<Q", ms)


def test_scan(spark, tmp_path):
    t0 = 1_749_000_000_000
    kit = tmp_path / "KitA"
    kit.mkdir()
    counts = list(range(2000, 2080))
    (kit / "2025_0604101500_0x1A_x_p.bin").write_bytes(packet(t0, counts) + wake() + packet(t0 + 2000, counts) + packet(t0, counts)[:100])
    (kit / "2025_0604101500_0x1B_x_p.bin").write_bytes(b"\x01")  # nothing but a truncated packet
    (kit / "2025_0604101600_0x2_x_pjm.bin").write_bytes(b"\x07" + fix(t0, 45.0, 9.0) + fix(t0 + 1, 45.1, 9.1, True) + fix(5, 1.0, 1.0) + fix(t0 + 2, 45.2, 9.2)[:20])
    (kit / "notes.bin").write_bytes(b"zzz")
    files = R.files(spark, str(tmp_path))
    assert sorted((r.kit, r.sensor_id, r.kind) for r in files.collect()) == [("KitA", "0x1A", "p"), ("KitA", "0x1B", "p"), ("KitA", "0x2", "pjm")]
    p = R.packets(files).orderBy("start_ms").collect()
    assert len(p) == 2 and p[0].vbatt == 3.3 and abs(p[0].temp - 21.5) < 1e-9 and p[0].rssi == -56.0 and p[0].raw == counts
    s = R.samples(R.packets(files)).orderBy("ts").collect()
    assert len(s) == 160 and abs(s[0].pressure - (2000 * 3.6 / 3.3 * 0.000788 - 2.3057)) < 1e-12
    assert (s[1].ts - s[0].ts).total_seconds() == 0.025
    assert R.samples(R.packets(files), R.SLOW_HZ).count() == 20
    g = R.fixes(files).orderBy("ts").collect()
    assert [round(r.lat, 1) for r in g] == [45.0, 45.1] and g[0].rpm == 120.0 and g[0].vbatt == 12.5
    assert abs(g[0].speed_rpm - 120 / 60 * 2 * np.pi * 0.46 * 3.6) < 1e-9


def test_fixes_without_a_place_are_left_out(spark, tmp_path):
    t0 = 1_749_000_000_000
    folder = tmp_path / "KitB"
    folder.mkdir()
    # The mark's bytes also occur in front, and within a record's payload.
    (folder / "2025_0604101600_0x2_x_pjm.bin").write_bytes(b"\x21\x0e" * 9 + fix(t0, 0.0, 9.0) + fix(t0 + 1, 45.0, 0.0) + b"\x21" + fix(t0 + 2, -0.0, 1.0))
    assert [(r.lat, r.lon) for r in R.fixes(R.files(spark, str(tmp_path))).collect()] == [(45.0, 0.0)]


def test_names():
    assert recording("/a/KitA/2025_0604101500_0x1A_x_p.bin", 5, "p").sensor == "0x1A"
    assert recording("/a/KitA/2025_0604101500_0x1A_x_p.bin", 5, "pjm") is None
    assert recording("/a/KitA/2025_1304101500_0x1A_x_p.bin", 5, "p") is None and recording("x.bin", 5, "p") is None


def write(folder, minute, start, arrived):
    folder.mkdir(exist_ok=True)
    path = folder / f"2025_06041015{minute:02d}_0x1_x_p.bin"
    path.write_bytes(packet(start, range(80)) + packet(start + 2000, range(80)))
    os.utime(path, (arrived, arrived))


def test_source_in_batch(spark, tmp_path):
    spark.dataSource.register(BrakeBin)
    kit, now = tmp_path / "KitA", time.time()
    for minute in random.Random(1).sample(range(8), 8):
        write(kit, minute, 4000 * minute, now)
    (kit / "2025_0604101600_0x2_x_pjm.bin").write_bytes(fix(1_749_000_000_000, 45.0, 9.0))
    (kit / "notes.txt").write_bytes(b"x")
    rows = spark.read.format("brakebin").load(str(tmp_path)).collect()
    assert [r.start_ms for r in rows] == [2000 * i for i in range(16)] and rows[0].raw == list(range(80))
    assert rows[0].kit == "KitA" and rows[0].sensor_id == "0x1" and str(rows[0].end_time) == "2025-06-04 10:15:00"
    d = R.in_units(spark.read.format("brakebin").load(str(tmp_path)))
    assert d.first().vbatt == 3.3 and R.samples(d).count() == 16 * 80
    (f,) = R.located(spark.read.format("brakebin").option("records", "fixes").load(str(tmp_path))).collect()
    assert f.lat == 45.0 and f.rpm == 120.0
    assert spark.read.format("brakebin").load(str(tmp_path / "nothing")).count() == 0


def test_stream_is_in_event_order_and_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(BrakeBin)
    kit, now, batches = tmp_path / "in" / "KitA", time.time() - 100, []
    kit.mkdir(parents=True)

    def take(df, number):
        rows = [(r.end_time.second, r.start_ms) for r in df.collect()]
        if len(batches) == 2 and failing:
            raise RuntimeError("stopped in the middle of a batch")
        batches.append(rows)

    def run():
        stream = spark.readStream.format("brakebin").option("settle", "0").load(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    failing = False
    for k, minute in enumerate([5, 1, 3]):  # arrive in another order than that of their names
        write(kit, minute, 4000 * minute, now + k)
    run()
    for k, minute in enumerate([2, 9, 7]):  # one is older than what has been taken
        write(kit, minute, 4000 * minute, now + 10 + k)
    run()
    assert [[m for m, _ in b[::2]] for b in batches] == [[1, 3, 5], [2, 7, 9]]
    assert all(b == sorted(b) for b in batches)
    failing = True
    write(kit, 4, 16000, now + 20)
    try:
        run()
        raise AssertionError("the batch was to fail")
    except Exception as e:
        assert "stopped in the middle" in str(e)
    failing = False
    write(kit, 6, 24000, now + 30)
    run()  # replays the batch that had not committed, as it was, and ends
    assert [m for m, _ in batches[-1]] == [4, 4]
    run()
    assert [m for m, _ in batches[-1]] == [6, 6]
    seen = [s for b in batches for _, s in b]
    assert sorted(seen) == sorted(s for m in (5, 1, 3, 2, 9, 7, 4, 6) for s in (4000 * m, 4000 * m + 2000))


def test_stream_waits_until_arrivals_have_settled(tmp_path):
    from airlattice.sources.brakebin import StreamReader

    kit = tmp_path / "KitA"
    write(kit, 1, 0, time.time() - 50)
    write(kit, 2, 0, time.time())
    reader = StreamReader(str(tmp_path), "packets", 5.0)
    end = reader.latestOffset()
    assert [p.name[11:15] for p in reader.partitions(reader.initialOffset(), end)] == ["1501"] and reader.partitions(end, end) == []
