"""Binary sensor recordings as DataFrames: pressure packets (192 bytes, wake packets of 19) and GPS records.

Files are read by Spark's binaryFile source and parsed where they are read; a file is one sensor's short recording.
A truncated last packet is left out. File names carry end time, sensor and kind; other names are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.operators import cleaning
from airlattice.session import ship

#: YYYY_MMDDHHMMSS_<0xHEX>_<tag>_<p|pjm>.bin (fixed by the format).
NAME = r"(\d{4})_(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})_(0x[0-9A-Fa-f]+)_.*_(p|pjm)\.bin$"
PACKET = np.dtype([("head", "u1", 6), ("vbatt", "<u2"), ("vin", "<u2"), ("id", "<u2"), ("ic", "<u2"), ("temp", "<i2"), ("start", "<u8"), ("raw", "<i2", 80), ("rest", "<u2", 3), ("rssi", "u1"), ("end", "u1")])
WAKE, WAKE_BYTES = 0x20, 19
FAST_HZ, SLOW_HZ, SLOW_SAMPLES = 40.0, 1.62181, 10
#: Accepted GPS times in ms, both ends included.
GPS_FROM, GPS_TO = 1735689600000, 1893456000000
#: The mark within a GPS record, and where it lies.
MARK, MARK_AT = b"\x21\x0e", 12


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kit, end_time, sensor_id, kind, content) of the recordings below ``path``; the kit is the folder's name."""
    ship(spark)
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.regexp_extract("path", NAME, i)
    d = d.where(F.col("path").rlike(NAME))
    end = F.to_timestamp_ntz(F.concat(*[part(i) for i in range(1, 7)]), F.lit("yyyyMMddHHmmss"))
    return d.select("path", F.element_at(F.split("path", "/"), -2).alias("kit"), end.alias("end_time"), part(7).alias("sensor_id"), part(8).alias("kind"), "content")


def packets_of(data: bytes) -> np.ndarray:
    """The pressure packets of a recording, without wake packets and without a truncated tail."""
    if len(data) % PACKET.itemsize == 0:
        whole = np.frombuffer(data, PACKET)
        if not (whole["head"][:, 5] == WAKE).any():
            return whole
    out, at = [], 0
    while at + 6 <= len(data):
        if data[at + 5] == WAKE:
            at += WAKE_BYTES
        elif at + PACKET.itemsize <= len(data):
            out.append(np.frombuffer(data, PACKET, 1, at))
            at += PACKET.itemsize
        else:
            break
    return np.concatenate(out) if out else np.zeros(0, PACKET)


PACKET_COLUMNS = "start_ms long, vbatt int, vin int, id int, ic int, temp int, rssi int, raw array<int>"
FIX_COLUMNS = "ms long, lat double, lon double, speed double, rpm double, ibatt double, vbatt double"


def packet_columns(p: np.ndarray) -> tuple[list[str], list[pa.Array]]:
    """Packets in counts, as Arrow columns."""
    names = ["vbatt", "vin", "id", "ic", "temp", "rssi"]
    raw = pa.FixedSizeListArray.from_arrays(pa.array(p["raw"].reshape(-1).astype(np.int32)), 80).cast(pa.list_(pa.int32()))
    return ["start_ms", *names, "raw"], [pa.array(p["start"].astype(np.int64)), *[pa.array(p[c].astype(np.int32)) for c in names], raw]


def in_units(packets_: DataFrame) -> DataFrame:
    """Packets with voltages in volts, currents in amperes, temperature in degrees and signal strength in dBm."""
    return packets_.withColumns({"vbatt": F.col("vbatt") / 1000, "vin": F.col("vin") / 1000, "id": F.col("id") * 0.1, "ic": F.col("ic") * 0.1, "temp": F.col("temp") * 0.01, "rssi": -(256.0 - F.col("rssi"))})


def packets(recordings: DataFrame) -> DataFrame:
    """One row a packet: kit, sensor_id, start_ms, voltages, currents, temperature and signal strength in units, and raw counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kit, sensor, data in zip(*(batch.column(c).to_pylist() for c in ("kit", "sensor_id", "content")), strict=True):
                names, columns = packet_columns(packets_of(data))
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([kit] * n, pa.string()), pa.array([sensor] * n, pa.string()), *columns], ["kit", "sensor_id", *names])

    return in_units(recordings.where("kind = 'p'").select("kit", "sensor_id", "content").mapInArrow(run, f"kit string, sensor_id string, {PACKET_COLUMNS}"))


def samples(packets_: DataFrame, rate: float = FAST_HZ, shift_hours: int = 2) -> DataFrame:
    """One row a sample: kit, sensor_id, ts, pressure. At any but the fast rate only the first ten counts of a packet are real."""
    raw = F.col("raw") if rate == FAST_HZ else F.slice("raw", 1, SLOW_SAMPLES)
    d = packets_.select("kit", "sensor_id", "start_ms", F.posexplode(raw).alias("i", "count"))
    micros = F.col("start_ms") * 1000 + F.round(F.col("i") * (1e6 / rate)).cast("long") + shift_hours * 3_600_000_000
    return d.select("kit", "sensor_id", F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"), cleaning.calibrated_pressure(F.col("count")).alias("pressure"))


def fixes_of(data: bytes) -> list[tuple]:
    """GPS records: found by their mark, with or without a filler byte before the time, times out of range dropped."""
    out, at = [], 0
    while (mark := data.find(MARK, at + MARK_AT)) >= 0 and mark - MARK_AT + 38 <= len(data):
        at = mark - MARK_AT
        if data[at + 28 : at + 30] != b"\r\n":
            at += 30
            continue
        lat, lon, speed = np.frombuffer(data, "<f4", 3, at)
        rpm, ibatt, vbatt = np.frombuffer(data, "<u2", 3, at + 14 + 8)
        for skip in (0, 1):
            end = at + 38 + skip
            if end > len(data):
                return out
            ms = int.from_bytes(data[end - 8 : end], "little")
            if GPS_FROM <= ms <= GPS_TO:
                out.append((ms, float(lat), float(lon), float(speed), rpm / 10, ibatt / 1000, vbatt / 100))
                break
        at = end
    return out


def fix_columns(rows: list[tuple]) -> tuple[list[str], list[pa.Array]]:
    """GPS records as Arrow columns."""
    names = [c.split()[0] for c in FIX_COLUMNS.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return names, [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]]


def located(fixes_: DataFrame) -> DataFrame:
    """GPS records with a place and a time: those at latitude 0 have none. Adds ts and speed_rpm. GPS times are not shifted."""
    d = fixes_.where("lat <> 0").withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).withColumn("speed_rpm", cleaning.speed_from_rpm(F.col("rpm")))
    return d.drop("ms")


def fixes(recordings: DataFrame) -> DataFrame:
    """One row a GPS record with a place: kit, ts, lat, lon, speed, rpm, ibatt, vbatt, speed_rpm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kit, data in zip(batch.column("kit").to_pylist(), batch.column("content").to_pylist(), strict=True):
                names, columns = fix_columns(fixes_of(data))
                yield pa.RecordBatch.from_arrays([pa.array([kit] * len(columns[0]), pa.string()), *columns], ["kit", *names])

    d = located(recordings.where("kind = 'pjm'").select("kit", "content").mapInArrow(run, f"kit string, {FIX_COLUMNS}"))
    return d.select("kit", "ts", "lat", "lon", "speed", "rpm", "ibatt", "vbatt", "speed_rpm")
