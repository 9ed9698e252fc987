"""Epochs of the calendar - 24, 72 and 120 hours and the bridge between two of them - counted in event time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.weights import epoch

EPOCH = "epoch_id string, start timestamp, end timestamp, n long"


class Epochs(StatefulProcessor):
    """State of an epoch: its rows so far; a timer at its end gives them out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "start timestamp, end timestamp, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, end, n = self.sums.get() if self.sums.exists() else (None, None, 0)
        for part in rows:
            if part.empty:
                continue
            if start is None:
                start, end = (pd.Timestamp(part[c].iloc[0]).to_pydatetime() for c in ("start", "end"))
                self.handle.registerTimer(int(part["end_ms"].iloc[0]))
            n += int(part["n"].sum())
        self.sums.update((start, end, n))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, end, n = self.sums.get()
        self.sums.clear()
        yield pd.DataFrame({"epoch_id": [key[0]], "start": [start], "end": [end], "n": [n]})

    def close(self) -> None:
        pass


def epoch_stream(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """EPOCH rows of a stream: a row for each epoch that has any, once the watermark, `late` behind the newest row, has passed its end.

    Rows older than the watermark go, those without a time too; a row within it
    counts in its own epoch, which is still open. Epochs begin and end on whole
    hours: rows are counted by hour first, combined before the shuffle, so an
    epoch gets a row for each of its hours, not for each of its events.
    """
    hours = stream.select(F.col(at).cast("timestamp").alias("at")).where(F.col("at").isNotNull()).withWatermark("at", late)
    counted = hours.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n")).withColumn("at", F.window_time("window"))
    e = epoch(F.col("at"))
    named = counted.select("at", "n", e["id"].alias("epoch_id"), e["start"].alias("start"), e["end"].alias("end"), (F.unix_timestamp(e["end"]) * 1000).alias("end_ms"))
    return named.groupBy("epoch_id").transformWithStateInPandas(Epochs(), EPOCH, "Append", "EventTime")


# Planning workers beside the driver don't get files that are added for tasks: what they unpickle brings its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
