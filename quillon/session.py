"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """path, which the session's file system deletes when it closes; results may still read it till then."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, as the cluster names it in spark.checkpoint.dir.

    Where none is named a local session gets a temporary one (tests); elsewhere
    that would be a folder of the driver alone, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-ckpt-"))
        gone_at_exit(spark, sc.getCheckpointDir())  # the session's own folder below the one named
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs a re-read only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the checkpoint folder, deleted when the session ends."""
    return gone_at_exit(spark, f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")


def materialised(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared checkpoint folder and read back: for tables that a plan reads many times."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written once in the shared checkpoint folder, dealt into buckets by `key`: what groups, joins or windows by it, or by it and more, needs no shuffle then.

    The files go with the session's folder; the name in the session's catalog is one of its own.
    """
    path = new_folder(df.sparkSession, "buckets")
    name = "quillon_" + path.rpartition("-")[2]
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bench_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
