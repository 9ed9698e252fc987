"""Small state and report tables: read with a default, CSV and JSON sinks, batches of a cycle."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType


#: Spark's error conditions for content that can't be parsed; whatever else goes wrong says nothing about the content.
UNREADABLE = ("MALFORMED_RECORD_IN_PARSING", "CANNOT_READ_FILE_FOOTER", "CONVERT_PROBLEM")
#: What Parquet's reader says of a file that isn't one, or was cut.
_NOT_PARQUET = ("is not a Parquet file", "Could not read footer", "expected magic number")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, by Spark's own file systems; an error to reach the store is raised."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def unparsable(error: Exception) -> bool:
    """Whether an error is about content, not about the machines, the store or rights."""
    text = str(error)
    return any(f"[{c}" in text or f".{c}]" in text for c in UNREADABLE) or any(m in text for m in _NOT_PARQUET)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The state table at a path; an empty one of the schema where there is none or its content doesn't parse.

    State is small (a row for each key): it is read once to see whether it can
    be. Any other failure - a lost executor, no permission, a store that doesn't
    answer - is raised: it must not reset a state that is there.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).format(fmt).options(**({"mode": "FAILFAST"} if fmt in ("json", "csv") else {})).load(path)
    try:
        found.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as e:
        if not unparsable(e):
            raise
        return spark.createDataFrame([], schema)
    return found


STATE = "uid long, score double, hotkey string, step long"


def write_scores(df: DataFrame, path: str) -> None:
    """A cycle's numeric state (STATE), each step in a folder of its own: a reader never sees half a state."""
    df.select("uid", "score", "hotkey", "step").write.mode("overwrite").partitionBy("step").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_scores(spark: SparkSession, path: str, uids: DataFrame) -> DataFrame:
    """The state of the last step for (uid, hotkey) rows; score 0 where a uid is new, and step 0 where there is no state.

    A uid whose hotkey changed starts from 0.
    """
    every = read_or_empty(spark, path, STATE)
    last = every.agg(F.coalesce(F.max("step"), F.lit(0)).alias("now"))  # one row
    own = every.select(F.col("uid").alias("__uid"), "score", F.col("hotkey").alias("__key"), F.col("step").alias("__step"))
    kept = uids.join(F.broadcast(last), F.lit(True), "cross").join(own, (F.col("uid") == F.col("__uid")) & (F.col("__step") == F.col("now")), "left")
    return kept.select("uid", F.when(F.col("__key").eqNullSafe(F.col("hotkey")), F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"), "hotkey", F.col("now").alias("step"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV report with a header; fields that don't parse are null."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON with sorted keys; the commit protocol makes the folder appear whole or not at all."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def flatten_metrics(schema: StructType, prefix: str = "", of: Column | None = None) -> list[Column]:
    """Columns `a/b` for the scalars of nested structs: booleans as 0 and 1, arrays of anything but numbers as their count."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if of is None else of[f.name]
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            out += flatten_metrics(f.dataType, f"{name}/", c)
        elif isinstance(f.dataType, ArrayType):
            out.append(F.greatest(F.size(c), F.lit(0)).alias(f"{name}_count"))
        elif isinstance(f.dataType, BooleanType):
            out.append(c.cast("int").alias(name))
        elif isinstance(f.dataType, NumericType):
            out.append(c.alias(name))
    return out


def cycle_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (pos, hands array<struct<hand_id,...>>, is_bot, ref_ids array<string>): batches that have hands, and their ids.

    The first frame is (pos, is_human, hands); the second (hand_id), distinct,
    taken from ref_ids where a batch has them. Empty and missing batches go.
    """
    ok = batches.where(F.size("hands") > 0)
    ids = F.when(F.size("ref_ids") > 0, F.col("ref_ids")).otherwise(F.transform("hands", lambda h: h["hand_id"]))
    named = ok.select(F.explode(ids).alias("hand_id")).where("hand_id is not null").distinct()
    return ok.select("pos", (~F.coalesce("is_bot", F.lit(False))).alias("is_human"), "hands"), named
