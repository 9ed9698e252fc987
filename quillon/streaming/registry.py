"""Stateful stream forms: served fingerprints, moving averages, cycle sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SERVED = "fingerprint string, first_seen timestamp, last_seen timestamp, times_served long"


def served_stream(events: DataFrame, key: str = "fingerprint", at: str = "ts") -> DataFrame:
    """A stream of registry rows: for each key of a micro-batch, when it was first and last seen and how often it was served."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        for p in parts:
            if p.empty:
                continue
            lo, hi = p[at].min(), p[at].max()
            first, last, n = (lo if first is None else min(first, lo)), (hi if last is None else max(last, hi)), n + len(p)
        state.update((first, last, n))
        yield pd.DataFrame({"fingerprint": [k[0]], "first_seen": [first], "last_seen": [last], "times_served": [n]})

    return events.groupBy(key).applyInPandasWithState(update, SERVED, "first_seen timestamp, last_seen timestamp, times_served long", "update", GroupStateTimeout.NoTimeout)


def ema_stream(rewards: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A stream of (uid, step, score, n): s <- alpha r + (1 - alpha) s, steps without a reward of the uid count as 0.

    Every reward counts by its own step, several of one step and late ones
    included, so scores are those of weights.ema up to the uid's last step; n
    counts its rewards. `ema_now` brings all uids to one step.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, score, n = state.get if state.exists else (None, 0.0, 0)
        for p in parts:
            for t, r in p[["step", "reward"]].itertuples(index=False):
                n += 1
                if step is None or t > step:
                    score *= 0.0 if step is None else (1 - alpha) ** (int(t) - step)
                    step = int(t)
                score += alpha * (1 - alpha) ** (step - int(t)) * (0.0 if pd.isna(r) else float(r))
        if step is None:
            return
        state.update((step, score, n))
        yield pd.DataFrame({"uid": [k[0]], "step": [step], "score": [score], "n": [n]})

    return rewards.groupBy("uid").applyInPandasWithState(update, "uid long, step long, score double, n long", "step long, score double, n long", "update", GroupStateTimeout.NoTimeout)


def ema_now(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """uid, score at the latest step of all, from the rows that ema_stream wrote: of each uid the newest, decayed."""
    own = scores.groupBy("uid").agg(F.max(F.struct("n", "step", "score")).alias("s")).select("uid", "s.step", "s.score")
    last = own.agg(F.max("step").alias("now"))  # one row
    return own.join(F.broadcast(last), F.lit(True), "cross").select("uid", (F.col("score") * F.pow(F.lit(1 - alpha), (F.col("now") - F.col("step")).cast("double"))).alias("score"))


def run_cycles(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Feed each micro-batch, of a stateful stream what it changed, to `sink` once per batch id; the checkpoint is the offset commit."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def epochs(stream: DataFrame, at: str, late: str, hours: int = 24, offset: str = "20 hours") -> DataFrame:
    """Counts by event-time epochs of `hours`, anchored at 20:00 UTC; rows later than the watermark go."""
    return stream.withWatermark(at, late).groupBy(F.window(at, f"{hours} hours", f"{hours} hours", offset)).agg(F.count("*").alias("n"))
