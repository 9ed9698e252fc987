"""Streams: settled requests, the suspicion registry, epochs; restarts and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.streaming import calendar, responses, runs, suspicion

T = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


class Feed:
    """A folder that a stream reads, to which a test adds files."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        path.mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/{self.n}")
        self.n += 1

    def read(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


REQ, ANS = "uid long, request_id string, sent_at timestamp, n_sent long", "uid long, request_id string, got_at timestamp, n_scores long"


def test_requests_are_answered_or_time_out(spark, tmp_path):
    asked, replies = Feed(spark, tmp_path / "r", REQ), Feed(spark, tmp_path / "a", ANS)

    def run():
        return {(r["uid"], r["request_id"]): r for r in runs.drain(responses.answered(asked.read(), replies.read(), late="1 minute"), str(tmp_path / "c"), str(tmp_path / "o"), "append").collect()}

    asked.add([(1, "a", at(0), 3), (2, "a", at(0), 3), (3, "a", at(0), 3), (4, "a", at(0), 3), (1, "b", at(400), 2), (None, "n", at(0), 1), (9, "t", None, 1)])
    replies.add([(1, "a", at(20), 3), (1, "a", at(10), 3), (2, "a", at(30), 2), (3, "a", at(181), 3), (4, "z", at(5), 3), (None, "n", at(1), 1)])
    first = run()
    assert (1, "b") not in first  # still open
    asked.add([(5, "late", at(1), 1), (8, "end", at(9000), 1)])
    replies.add([(1, "b", at(580), 2), (8, "other", at(9000), 1)])
    got = run()
    settled = {k: (r["coverage"], r["latency_seconds"]) for k, r in got.items()}
    assert settled[1, "a"] == (1.0, 10.0)  # the first of two answers
    assert settled[2, "a"] == (0.0, 30.0)  # not a score for each thing sent
    assert settled[3, "a"] == settled[4, "a"] == (0.0, None)  # too late; for another request
    assert settled[1, "b"] == (1.0, 180.0)  # sent before, answered after the restart, to the second in time
    assert settled[None, "n"] == (0.0, None)
    assert (8, "end") not in settled and (9, "t") not in settled


def test_latencies_are_whole_microseconds(spark, tmp_path):
    asked, replies = Feed(spark, tmp_path / "r", REQ), Feed(spark, tmp_path / "a", ANS)
    asked.add([(1, "a", at(0.1), 3)])
    replies.add([(1, "a", at(17.2355), 3)])
    got = runs.drain(responses.answered(asked.read(), replies.read(), late="1 minute"), str(tmp_path / "c"), str(tmp_path / "o"), "append", [lambda: (asked.add([(2, "z", at(9000), 1)]), replies.add([(2, "z", at(9000), 1)]))])
    assert got.where("uid = 1").head()["latency_seconds"] == 17.1355


def test_a_join_of_streams_has_one_store_a_partition(spark, tmp_path):
    """Each store is loaded and committed in each batch, so four of them cost four times as much."""
    asked, replies = Feed(spark, tmp_path / "r", REQ), Feed(spark, tmp_path / "a", ANS)
    asked.add([(1, "a", at(0), 3)])
    replies.add([(1, "a", at(20), 3)])
    runs.drain(responses.answered(asked.read(), replies.read(), late="1 minute"), str(tmp_path / "c"), str(tmp_path / "o"), "append")
    stores = [{x.name for x in p.iterdir() if x.is_dir() and not x.name.startswith("_")} for p in (tmp_path / "c" / "state").glob("*/0")]
    assert stores and not any("left-keyToNumValues" in s for s in stores)


def test_outcomes_of_retries(spark):
    rows = [("x", at(0), 0.0, None), ("x", at(200), 1.0, 5.0), ("x", at(400), 1.0, 1.0), ("y", at(0), 0.0, None), ("y", at(200), 0.0, None), ("z", at(0), 0.0, 7.0), ("w", at(0), 0.0, None), ("w", at(1), 0.0, None), ("w", at(2), 0.0, None), ("w", at(3), 1.0, 1.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "uid long, request_id string, sent_at timestamp, coverage double, latency_seconds double")
    got = {r["request_id"]: tuple(r)[2:] for r in responses.outcomes(df).collect()}
    assert got == {"x": (2, 1.0, 5.0), "y": (2, 0.0, None), "z": (1, 0.0, 7.0), "w": (3, 0.0, None)}


EV = "uid long, event_id long, at timestamp, reasons array<string>"


def entries(df):
    return {r["uid"]: (r["counts"], [e["event_id"] for e in r["events"]], r["gone"]) for r in suspicion.latest(df).collect()}


def test_suspicion_goes_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "e", EV)

    def run():
        return entries(runs.drain(suspicion.suspicion_stream(feed.read(), keep=3), str(tmp_path / "c"), str(tmp_path / "o")))

    feed.add([(1, 5, at(5), ["a", "b"]), (1, 2, at(2), ["a"]), (2, 1, None, ["x", "x"]), (3, 9, at(1), []), (3, 10, at(1), None)])
    assert run() == {1: ({"a": 2, "b": 1}, [2, 5], False), 2: ({"x": 2}, [1], False)}
    feed.add([(1, 3, at(3), ["c"]), (1, 9, at(9), ["a"]), (4, 1, at(1), ["é"])])
    assert run() == {1: ({"a": 3, "b": 1, "c": 1}, [3, 5, 9], False), 2: ({"x": 2}, [1], False), 4: ({"é": 1}, [1], False)}


def test_the_quiet_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path / "e", EV)

    def run():
        return entries(runs.drain(suspicion.suspicion_stream(feed.read(), quiet="1 hour", late="1 minute"), str(tmp_path / "c"), str(tmp_path / "o")))

    feed.add([(1, 1, at(0), ["a"]), (2, 2, at(0), ["a"])])
    assert run() == {1: ({"a": 1}, [1], False), 2: ({"a": 1}, [2], False)}
    feed.add([(2, 3, at(3000), ["a"])])
    run()
    feed.add([(5, 9, at(4000), ["z"])])
    got = run()
    assert got[1][2] and not got[2][2] and got[2][0] == {"a": 2}


def test_epochs_close_once_and_late_rows_go(spark, tmp_path):
    feed = Feed(spark, tmp_path / "t", "ts timestamp")
    day = lambda text: dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)

    def run():
        return {r["epoch_id"]: (r["start"].isoformat(), r["end"].isoformat(), r["n"]) for r in runs.drain(calendar.epoch_stream(feed.read(), late="1 hour"), str(tmp_path / "c"), str(tmp_path / "o"), "append").collect()}

    feed.add([(day(x),) for x in ("2026-04-27T20:00", "2026-04-28T19:59", "2026-04-28T20:00")] + [(None,)])
    assert run() == {}
    feed.add([(day(x),) for x in ("2026-04-28T19:30", "2026-05-12T20:00", "2026-05-15T19:59")])
    got = run()
    assert got == {"day_2026-04-27_2000utc": ("2026-04-27T20:00:00", "2026-04-28T20:00:00", 3), "day_2026-04-28_2000utc": ("2026-04-28T20:00:00", "2026-04-29T20:00:00", 1)}
    feed.add([(day(x),) for x in ("2026-04-27T21:00", "2026-06-18T00:00", "2026-06-22T19:59", "2026-06-22T20:00", "2026-06-26T23:59", "2026-06-27T00:00", "2026-07-03T00:00")])
    got = run()
    assert got["day_2026-04-27_2000utc"][2] == 3  # a late row doesn't open it again
    assert got["day_2026-05-12_2000utc"] == ("2026-05-12T20:00:00", "2026-05-15T20:00:00", 2)
    assert got["day_2026-06-17_2000utc"] == ("2026-06-17T20:00:00", "2026-06-22T20:00:00", 2)
    assert got["day_2026-06-22_2000utc"] == ("2026-06-22T20:00:00", "2026-06-27T00:00:00", 2)
    assert got["day_2026-06-27_0000utc"][2] == 1 and len(got) == 6


def test_played_tables_come_one_after_the_other(spark, tmp_path):
    df = spark.range(100).select("id", F.timestamp_seconds("id").alias("ts"))
    stream, more = runs.played([df.where("id < 50"), df.where("id >= 50"), *runs.closing(df, "ts", 2, id=F.explode(F.array(F.lit(-1), F.lit(-2))))])
    got = runs.drain(stream, str(tmp_path / "c"), str(tmp_path / "o"), "append", more)
    assert got.count() == 100 + 2 * runs.CLOSINGS and got.where("id < 0").agg(F.min("ts")).head()[0] == dt.datetime(1970, 1, 1, 2, 1, 39)


def test_suspicion_reads_and_writes_its_state_once_a_batch():
    """Each access is a round trip to the state store, whatever the number of reasons."""
    from pyspark.sql import Row

    class Handle:
        value, calls = None, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    handle, own = Handle(), suspicion.Suspicion(3, None)
    own.init(handle)
    rows = [Row(event_id=i, at=None, reasons=[f"r{i}", "all"]) for i in (4, 2, 9, 7)]
    (got,) = own.handleInputRows((1,), iter(rows), None)
    assert handle.calls == 2 and [e.event_id for e in got.events] == [4, 7, 9] and got.counts == {"all": 4, "r2": 1, "r4": 1, "r7": 1, "r9": 1} and got.n_events == 4
