"""Requests and their answers as two streams: who answered in time, how fast, and who didn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answered(requests: DataFrame, answers: DataFrame, within: str = "180 seconds", late: str = "10 minutes", by_request: bool = True) -> DataFrame:
    """uid, request_id, sent_at, n_sent, got_at, n_scores, coverage, latency_seconds: a row for each request, when it is settled.

    requests: (uid, request_id, sent_at, n_sent); answers: (uid, request_id, got_at,
    n_scores), of which request_id is left aside without by_request: an answer
    then settles every open request of its uid. A request waits `within` for an
    answer. The first counts; it has coverage 1 if it has a score for each thing
    sent, else 0. A request without one comes out with coverage 0 and no latency
    once the watermark, `late` behind the slower of both streams, has passed its
    time. A retry is a request of its own, see `outcomes`. Rows later than the
    watermark, requests without a time and answers without a uid go.

    The join keeps a request for its time and an answer as long, by watermark,
    so state is bounded by what is open; it is dealt by uid (and request).
    """
    r = requests.select("uid", "request_id", "sent_at", "n_sent").withWatermark("sent_at", late)
    a = answers.select(F.col("uid").alias("__uid"), F.col("request_id").alias("__id") if by_request else F.lit(None).alias("__id"), "got_at", "n_scores").withWatermark("got_at", late)
    same = F.col("uid") == F.col("__uid")
    if by_request:
        same = same & (F.col("request_id") == F.col("__id"))
    in_time = (F.col("got_at") >= F.col("sent_at")) & (F.col("got_at") <= F.col("sent_at") + F.expr(f"INTERVAL {within}"))
    pairs = r.join(a, same & in_time, "left_outer")
    first = pairs.groupBy("uid", "request_id", "sent_at", "n_sent").agg(F.min(F.struct("got_at", "n_scores")).alias("answer"))
    got = F.col("answer.got_at")
    return first.select(
        "uid",
        "request_id",
        "sent_at",
        "n_sent",
        got.alias("got_at"),
        F.col("answer.n_scores").alias("n_scores"),
        F.when(F.col("answer.n_scores") == F.col("n_sent"), 1.0).otherwise(0.0).alias("coverage"),
        ((F.unix_micros(got) - F.unix_micros("sent_at")) / F.lit(1e6)).alias("latency_seconds"),
    )


def outcomes(settled: DataFrame, attempts: int = 3) -> DataFrame:
    """uid, request_id, attempts, coverage, latency_seconds of requests that were sent again when unanswered, from the settled tries.

    The first answered try counts, with its own latency, and later ones don't;
    tries beyond `attempts` are left aside. A batch aggregate over what `answered` wrote.
    """
    tries = settled.groupBy("uid", "request_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("sent_at", "coverage", "latency_seconds"))), 1, attempts).alias("tries"))
    answered_at = F.array_position(F.transform("tries", lambda t: t["latency_seconds"].isNotNull()), True)
    used = F.get("tries", (answered_at - 1).cast("int"))
    return tries.select(
        "uid",
        "request_id",
        F.when(answered_at > 0, answered_at).otherwise(F.size("tries")).cast("int").alias("attempts"),
        F.when(answered_at > 0, used["coverage"]).otherwise(0.0).alias("coverage"),
        F.when(answered_at > 0, used["latency_seconds"]).alias("latency_seconds"),
    )
