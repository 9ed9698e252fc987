"""Readers of hand documents in JSON, and writers. Land them as Parquet once.

Files are read in byte ranges by many tasks (see quillon.sources.arrays), so one
file may be as large as the store holds; .gz files are read by one task each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.longform import HAND_DDL, in_chunks
from quillon.sources.arrays import elements

RECORD_DDL = f"struct<chunkId:string,chunkHash:string,sourceDate:string,releaseVersion:string,split:string,windowStart:string,chunks:array<array<{HAND_DDL}>>,groundTruth:array<int>>"


def flat(spark: SparkSession, path: str | list[str], size: int = 100) -> DataFrame:
    """(chunk_id, hand_ix, hand) of files that hold one array of hands: chunks of `size` in order, a short last one goes."""
    hands = elements(spark, path, "[", "{")
    return in_chunks(hands.select("file", "pos", F.from_json("value", HAND_DDL).alias("hand")), size)


def nested(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chunk_id, hand_ix, hand) of files that hold an array of arrays: an inner array is a chunk, and a broken one goes."""
    chunks = elements(spark, path, "[", "[").select("file", "pos", F.from_json("value", f"array<{HAND_DDL}>").alias("hands"))
    return chunks.select(F.concat_ws("#", "file", F.col("pos").cast("string")).alias("chunk_id"), F.posexplode("hands").alias("hand_ix", "hand"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chunk_id, label, data, hand_ix, hand) of benchmark files {"data": {"chunks": [record, ...]}}.

    Records whose chunks and labels differ in number are left out, and broken
    ones. The date is windowStart, else sourceDate, else that of the file's name.
    """
    named = F.replace(F.regexp_extract("file", r"data_(\d{4}_\d{2}_\d{2})", 1), F.lit("_"), F.lit("-"))
    rec = elements(spark, path, "{{[", "{").select("file", named.alias("named"), F.from_json("value", RECORD_DDL).alias("r"))
    rec = rec.where(F.size("r.chunks") == F.size("r.groundTruth"))
    date = F.coalesce("r.windowStart", "r.sourceDate", F.nullif(F.col("named"), F.lit("")))
    pairs = rec.select(F.col("r.chunkId").alias("rid"), date.alias("data"), F.posexplode(F.arrays_zip("r.chunks", "r.groundTruth")).alias("n", "z"))
    return pairs.select(F.concat_ws("#", "rid", F.col("n").cast("string")).alias("chunk_id"), F.col("z.groundTruth").alias("label"), "data", F.posexplode("z.chunks").alias("hand_ix", "hand"))


def dumps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As nested, with the date of a request dump: the second part of <prefix>_<date>_<time>.json."""
    return nested(spark, path).withColumn("data", F.get(F.split(F.get(F.split("chunk_id", "#"), 0), "_"), 1))


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, read: Callable[[SparkSession, list[str]], DataFrame], most: int = 1000) -> DataFrame:
    """Lands the files of a folder that weren't there before, and returns all that is landed.

    A stream of the folder's files, at most `most` to a cycle, whose names alone
    are read; `read` (flat, nested, records or dumps) gets a cycle's files. The
    checkpoint knows which files are done, and a cycle that is run again writes
    over its own folder, so every file lands once, after a restart too.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most).load(folder).select("path")

    def sink(df: DataFrame, n: int) -> None:
        paths = [r["path"] for r in df.collect()]  # names, `most` at most
        if paths:
            read(df.sparkSession, paths).write.mode("overwrite").parquet(f"{out}/cycle={n}")

    names.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("cycle")


def new_files(listed: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Files that a manifest doesn't hold yet."""
    return listed.join(done.select(key), key, "left_anti")


def land(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write as Parquet, by date if asked, so that later reads prune and split."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
