"""Exact dedup by counting quotient filters and byte verification.

Fingerprints of all texts are counted: each partition builds counting quotient
filters, dealt into buckets by the fingerprint's first bits, and a bucket merges
what it gets. Fingerprints counted once belong to texts without a copy, which
are done: their texts never move. Of a bucket only the bits of the fingerprints
that repeat come back, as a bitmap of bounded size; texts whose bit is set are
grouped by their bytes, combined in each task first, which is what decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import quotient
from quillon.session import materialised

#: Characters that don't count.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Fingerprints of a filter; fingerprints of a bucket, about.
FILTER_ROWS, BUCKET_ROWS = 1 << 20, 1 << 18
#: Bits of the bitmap, as a power of two: at most 32 MB, at least 64 for each row where that is less.
MOST_BITS, BITS_A_ROW = 28, 6
#: A class of over a HOT-th of all rows is joined from a table of HOT rows at most.
HOT = 1000


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def repeated(prints: DataFrame, n_rows: int) -> tuple[bytes, int]:
    """From (fp long): a bitmap over the first bits of a fingerprint, set for each that occurs more than once, and the bits it is addressed by.

    The bitmap's size follows from n_rows and is 2^MOST_BITS bits at most; where
    more fingerprints repeat than it can tell apart more texts are verified.
    """
    bits = min(MOST_BITS, max(12, (n_rows - 1).bit_length() + BITS_A_ROW))
    deal = min(bits - 3, max(6, (n_rows // BUCKET_ROWS).bit_length()))
    width = 64 - deal

    def filters(h: np.ndarray) -> pa.RecordBatch:
        h, n = quotient.added(h, np.ones(len(h), np.int64))
        bucket = (h >> np.uint64(width)).astype(np.int64)
        own, start = np.unique(bucket, return_index=True)
        ends = [*start[1:].tolist(), len(h)][: len(own)]
        low = h & np.uint64((1 << width) - 1)
        made = [quotient.build(low[a:b], n[a:b], width) for a, b in zip(start.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(made, pa.binary())], ["bucket", "filter"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= FILTER_ROWS:
                yield filters(np.concatenate(held))
                held, n = [], 0
        if n:
            yield filters(np.concatenate(held))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h, n = quotient.merge(part["filter"].tolist())
        own = np.zeros(1 << (bits - deal), np.uint8)
        own[(h[n > 1] >> np.uint64(64 - bits)).astype(np.int64)] = 1
        return pd.DataFrame({"bucket": [key[0]], "bits": [np.packbits(own).tobytes()]}) if own.any() else pd.DataFrame({"bucket": [], "bits": []})

    met = prints.mapInArrow(count, "bucket int, filter binary").groupBy("bucket").applyInPandas(meet, "bucket int, bits binary")
    each = 1 << (bits - deal - 3)
    bitmap = bytearray(1 << (bits - 3))
    for r in met.collect():  # slices of the bitmap, 2^(MOST_BITS - 3) bytes in all
        bitmap[r["bucket"] * each : (r["bucket"] + 1) * each] = r["bits"]
    return bytes(bitmap), bits


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size long, kept, text_sha256 of each row, dropped ones too.

    Texts are equal when they are after deleting white space ([\\x20\\x09-\\x0D]).
    Of equal ones the row with the most characters stays, then the one with the
    smallest key; a null key is after all others. Rows that are equal in all of
    this are told apart in no column, and exactly one of them is kept. A null
    text counts as empty. An empty table gives no row; other columns, whatever
    their names, are not read.

    A large group of copies is one row for each task before texts are shuffled,
    and its class, one of HOT at most, goes to all tasks; other groups are under
    a HOT-th of all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"), normalised(text).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    seen = materialised(rows.select("id", "n_chars", "fp", F.sha2("norm", 256).alias("sha")))
    n_rows = seen.count()
    bitmap, bits = repeated(seen.select("fp"), n_rows)
    sent, shift = spark.sparkContext.broadcast(bitmap), np.uint64(64 - bits)

    @F.pandas_udf("boolean")
    def repeats(fp: pd.Series) -> pd.Series:
        at = (fp.to_numpy(np.int64).view(np.uint64) >> shift).astype(np.int64)
        return pd.Series((np.frombuffer(sent.value, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    best = F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("best")
    classes = rows.where(repeats("fp")).groupBy("fp", "norm").agg(best, F.count("*").alias("group_size"))
    classes = materialised(classes.select(F.sha2("norm", 256).alias("sha"), F.col("best.id").alias("keep_id"), (-F.col("best.fewer")).alias("keep_chars"), "group_size"))

    routed = seen.withColumn("again", repeats("fp"))
    alone = routed.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    copies = routed.where("again").select("id", "n_chars", "sha")
    large = F.col("group_size") * HOT > n_rows
    hot = F.broadcast(classes.where(large))  # under HOT rows: each has over a HOT-th of all
    known = copies.join(hot, "sha").unionByName(copies.join(hot.select("sha"), "sha", "left_anti").join(classes.where(~large), "sha"))
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    out = ["id", "keep_id", "group_size", "kept", "sha"]
    rest = known.where(~first).withColumn("kept", F.lit(False)).select(out)
    ties = known.where(first).groupBy("id", "keep_id", "group_size", "sha").agg(F.count("*").alias("n"))
    one = ties.select("id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).withColumn("kept", F.col("i") == 1).select(out)
    every = alone.unionByName(rest).unionByName(one)
    return every.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL over `documents`."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER g AS place, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d WINDOW g AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""
