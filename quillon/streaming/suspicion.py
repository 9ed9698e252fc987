"""The suspicion registry as keyed state: reason counters, the last events, and a timer that forgets who is quiet."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events of a key that are kept.
RECENT = 64
STATE = "counts map<string,long>, events array<struct<event_id:long,at:timestamp,reasons:array<string>>>, n_events long, last_ms long"
ENTRY = "uid long, counts map<string,long>, events array<struct<event_id:long,at:timestamp,reasons:array<string>>>, n_events long, gone boolean"


class Suspicion(StatefulProcessor):
    """State of a uid, one value that is read and written once a micro-batch: a counter for each reason, its last events by id, how many there were, and when it was last seen."""

    def __init__(self, keep: int, quiet_ms: int | None) -> None:
        self.keep, self.quiet_ms = keep, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [r for r in rows if r.reasons]
        if not fresh:
            return
        counts, events, n, last = self._known()
        for r in fresh:
            for reason in r.reasons:
                counts[reason] = counts.get(reason, 0) + 1
        kept = sorted([*events, *[(r.event_id, r.at, list(r.reasons)) for r in fresh]], key=lambda e: e[0])[-self.keep :]
        n, last = n + len(fresh), max([last, *(int(r.at.timestamp() * 1000) for r in fresh if r.at is not None)])
        self.entry.update((counts, kept, n, last))
        if self.quiet_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.quiet_ms)
        yield self._row(key, counts, kept, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        counts, events, n, _ = self._known()
        yield self._row(key, counts, events, n, True)
        self.entry.clear()

    def _known(self) -> tuple[dict, list, int, int]:
        found = self.entry.get()
        if found is None:
            return {}, [], 0, 0
        return dict(found[0]), [tuple(e) for e in found[1]], found[2], found[3]

    @staticmethod
    def _row(key: tuple, counts: dict, events: list, n: int, gone: bool) -> Row:
        return Row(uid=key[0], counts=counts, events=[Row(event_id=e[0], at=e[1], reasons=list(e[2])) for e in events], n_events=n, gone=gone)

    def close(self) -> None:
        pass


def suspicion_stream(events: DataFrame, keep: int = RECENT, quiet: str | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of ENTRY rows, from (uid, event_id, at, reasons): of each uid of a micro-batch its registry entry after it.

    counts adds up each reason of each event, repeats within one included;
    events are the last `keep` by event_id, oldest first, in whatever order they
    came; events without a reason are none. With `quiet`, a uid without an event
    for that long in event time is forgotten: its last entry comes out marked
    `gone`, and rows over `late` behind the newest are left out. Events are held
    for a uid in RocksDB, so a restart goes on from the checkpoint; see
    `stateful` for the setting that starts such a stream.
    """
    known = events.select("uid", "event_id", "at", "reasons")
    quiet_ms = None
    if quiet is not None:
        quiet_ms = _ms(quiet)
        known = known.withWatermark("at", late)
    return known.groupBy("uid").transformWithState(Suspicion(keep, quiet_ms), ENTRY, "Update", "None" if quiet_ms is None else "EventTime")


_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _ms(text: str) -> int:
    n, unit = text.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def latest(entries: DataFrame) -> DataFrame:
    """Of the entries that a stream wrote the newest of each uid."""
    newest = entries.groupBy("uid").agg(F.max_by(F.struct("counts", "events", "gone"), "n_events").alias("e"))
    return newest.select("uid", "e.counts", "e.events", "e.gone")


# Planning workers beside the driver don't get files that are added for tasks: what they unpickle brings its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
