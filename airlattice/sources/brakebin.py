"""``brakebin``: recordings as a data source of its own, for ``spark.read`` and ``spark.readStream``.

    spark.dataSource.register(BrakeBin)
    spark.readStream.format("brakebin").option("records", "packets").load(folder)

A recording is one partition, parsed where it is read. Recordings come in the order of the times in their names. A stream
keeps no list of what it has seen: its offset is the arrival (modification time, then name) of the newest recording it has
taken, a batch is what arrived after that, put in the order of name times. So a recording that arrives late is taken
late, not lost, and a restart replays exactly the recordings of the batch that had not committed. ``settle`` seconds (2 by
default) must have passed since an arrival before a batch takes it, so that one of the same moment isn't passed by; until
then it is left for the next batch. Recordings may not be changed once they have arrived, and the newest one must stay.
With the trigger availableNow, a run that replays a batch ends with it, and the next run takes what arrived since.

The folder is listed with Arrow's file systems (local paths, hdfs://, s3:// and so on). Records are ``packets`` or ``fixes``;
other names, and recordings of the other kind, are left out.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .recordings import FIX_COLUMNS, NAME, PACKET_COLUMNS, fix_columns, fixes_of, packet_columns, packets_of

#: What every record has in front: its recording's name, place and time.
HEAD = "kit string, sensor_id string, file string, end_time timestamp_ntz"
RECORDS = {"packets": ("p", PACKET_COLUMNS), "fixes": ("pjm", FIX_COLUMNS)}


@dataclass(frozen=True)
class Recording(InputPartition):
    path: str
    kit: str
    sensor: str
    end: datetime
    arrived: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def arrival(self) -> tuple[int, str]:
        return self.arrived, self.path


def recording(path: str, arrived: int, kind: str) -> Recording | None:
    """The recording of a path, if its name says that it is one of ``kind``."""
    found = re.search(NAME, path.rsplit("/", 1)[-1])
    if found is None or found[8] != kind:
        return None
    try:
        end = datetime(*(int(x) for x in found.groups()[:6]))
    except ValueError:  # no such day or hour
        return None
    folders = path.rsplit("/", 2)
    return Recording(path, folders[-2] if len(folders) > 1 else "", found[7], end, arrived)


def _files(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, kind: str) -> list[Recording]:
    from pyarrow import fs

    files, at = _files(path)
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return [r for f in found if f.type == fs.FileType.File and (r := recording(f.path, f.mtime_ns or 0, kind))]


def in_order(recordings: list[Recording]) -> list[Recording]:
    """By the time in the name, then the name."""
    return sorted(recordings, key=lambda r: (r.end, r.path))


class _Parser:
    def __init__(self, path: str, records: str):
        self.path, self.records = path, records

    def parsed(self, part: Recording | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an empty folder
            return
        files, _ = _files(self.path)
        with files.open_input_stream(part.path) as stream:
            data = stream.read()
        names, columns = packet_columns(packets_of(data)) if self.records == "packets" else fix_columns(fixes_of(data))
        n = len(columns[0])
        head = [pa.array([v] * n, t) for v, t in ((part.kit, pa.string()), (part.sensor, pa.string()), (part.name, pa.string()), (part.end, pa.timestamp("us")))]
        yield pa.RecordBatch.from_arrays([*head, *columns], ["kit", "sensor_id", "file", "end_time", *names])


class BrakeBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brakebin"

    def _records(self) -> str:
        records = self.options.get("records", "packets")
        if records not in RECORDS:
            raise ValueError(f"records must be one of {sorted(RECORDS)}")
        return records

    def schema(self) -> str:
        return f"{HEAD}, {RECORDS[self._records()][1]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], self._records())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options["path"], self._records(), float(self.options.get("settle", "2")))


class BatchReader(DataSourceReader):
    def __init__(self, path: str, records: str):
        self.path, self.records = path, records

    def partitions(self) -> list[Recording]:
        return in_order(listed(self.path, RECORDS[self.records][0]))

    def read(self, partition: Recording | None) -> Iterator[pa.RecordBatch]:
        return _Parser(self.path, self.records).parsed(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, records: str, settle: float):
        self.path, self.records, self.settle = path, records, settle

    def initialOffset(self) -> dict:
        return {"arrived": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        newest = max((r.arrival() for r in listed(self.path, RECORDS[self.records][0]) if r.arrived <= until), default=(-1, ""))
        return {"arrived": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Recording]:
        after, upto = (start["arrived"], start["path"]), (end["arrived"], end["path"])
        return in_order([r for r in listed(self.path, RECORDS[self.records][0]) if after < r.arrival() <= upto])

    def read(self, partition: Recording | None) -> Iterator[pa.RecordBatch]:
        return _Parser(self.path, self.records).parsed(partition)
