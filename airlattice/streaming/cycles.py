"""The cycle detector on a stream, in event time: state, waiting rows and timers are kept by Spark between micro-batches.

Rows wait until the watermark has passed them and are then fed in order, so the cycles don't depend on how rows were
dealt to batches, as long as none is later than the watermark allows; later ones are dropped. Timers in event time
end what can't become known any more: the later pressures of a cycle, and a series that has been silent for ``idle`` seconds,
whose state is then cleared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from airlattice.operators.cycles import SCHEMA, Rules, State, deadline, feed, flush, frame
from airlattice.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Detector(StatefulProcessor):
    """One series: the rows that wait, in a list, and the detector's state with the time up to which it has been fed."""

    def __init__(self, key: str, rules: Rules, idle: float):
        self.key, self.rules, self.idle = key, rules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, o string, p double")
        self.state = handle.getValueState("state", "fed long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        fed = self.state.get()[0] if self.state.exists() else -1
        pdf = pdf[pdf["row_t"] * 1000 > max(fed, timerValues.getCurrentWatermarkInMs())]
        if len(pdf):
            self.waiting.appendList([(float(t), str(o), float(p)) for t, o, p in zip(pdf["row_t"], pdf["row_order"], pdf["row_p"], strict=True)])
            self.handle.registerTimer(ceil(pdf["row_t"].max() * 1000))
        yield self.rows_of(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] * 1000 <= mark], [r for r in rows if r[0] * 1000 > mark]
        state = State.load(self.state.get()[1]) if self.state.exists() else State()
        found = feed(state, [r[0] for r in ready], [r[2] for r in ready], self.rules)
        self.waiting.clear()
        if later:
            self.waiting.appendList([tuple(r) for r in later])
        until = deadline(state, self.rules)
        # Rows that may still come are later than the mark.
        if until is not None and mark >= until * 1000 and not later:
            found += flush(state)
            until = None
        silent = None if state.time is None else (state.time + self.idle) * 1000
        if not later and silent is not None and mark >= silent:
            found += flush(state)
            self.state.clear()
        else:
            self.state.update((int(mark), state.dump()))
            for at in (until and until * 1000, silent):
                if at is not None and at > mark:
                    self.handle.registerTimer(ceil(at))
        yield self.rows_of(key, found)

    def rows_of(self, key: tuple, found: list[dict]) -> pd.DataFrame:
        out = frame(found)
        out.insert(0, self.key, pd.Series([key[0]] * len(out), dtype=object))
        return out

    def close(self) -> None:
        pass


def detect_stream(samples: DataFrame, key: str, time: str, pressure: str, order: str, late: str = "10 seconds", rules: Rules = Rules(), idle: float = 3600.0) -> DataFrame:
    """Cycles of a streaming DataFrame with (key, time, pressure), in append mode; ``time`` is a timestamp, cycles are in seconds since the epoch.

    ``late`` is how far behind the newest row of all series a row may come. Rows of equal time go by ``order``. ``idle`` should be
    longer than a cycle may last. Rows without time or pressure are left out. State is kept in RocksDB.
    """
    spark = samples.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = samples.schema[key].dataType.simpleString()
    d = samples.where(F.col(time).isNotNull() & F.col(pressure).isNotNull()).withWatermark(time, late)
    d = d.select(key, time, (F.unix_micros(F.col(time)) / 1e6).alias("row_t"), F.col(pressure).cast("double").alias("row_p"), F.lpad(F.col(order).cast("string"), 20, "0").alias("row_order"))
    return d.groupBy(key).transformWithStateInPandas(Detector(key, rules, max(idle, rules.longest)), f"{key} {kind}, {SCHEMA}", "append", "eventTime")


def split_known(samples: DataFrame, labels: DataFrame, key: str = "sensor_id") -> tuple[DataFrame, DataFrame]:
    """Rows of registered sensors with the registry's columns, and rows of sensors that nobody has named, set apart and not guessed.

    ``labels`` is a table of one row a sensor; a repeated name counts once. Works on batches and on streams.
    """
    one = labels.dropDuplicates([key]).withColumn("_known", F.lit(True))
    met = samples.join(one, key, "left")
    return met.where("_known").drop("_known"), met.where("_known IS NULL").select(*samples.columns)
