"""Starting streams, and playing tables as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import new_folder

#: State in RocksDB; a commit writes what has changed instead of all files; a join of streams has one store a partition, not four.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which keyed maps, lists and timers need."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "update", then: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Runs a stream over all there is and returns what it has written to `out`, earlier runs included.

    A cycle that is run again after a failure writes over its own folder. then:
    each brings more rows, over which the stream runs again from its checkpoint.
    """
    spark = stream.sparkSession

    def sink(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/cycle={n}")

    for more in (None, *then):
        if more:
            more()
        with stateful(spark):
            run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Runs over closing rows: a chain of stateful steps hands its watermark on one batch at a time.
CLOSINGS = 3


def played(parts: Sequence[DataFrame]) -> tuple[DataFrame, list[Callable[[], None]]]:
    """Tables of one schema as a stream over a folder: the first is there at once, the others as `drain` asks for them. A table is a micro-batch."""
    folder = new_folder(parts[0].sparkSession, "played")

    def writer(i: int) -> Callable[[], None]:
        return lambda: parts[i].write.parquet(f"{folder}/{i}")

    writer(0)()
    stream = parts[0].sparkSession.readStream.schema(parts[0].schema).option("recursiveFileLookup", True).parquet(folder)
    return stream, [writer(i) for i in range(1, len(parts))]


def closing(df: DataFrame, at: str, hours: int, **columns: Column) -> list[DataFrame]:
    """CLOSINGS tables of the schema of df, a row each (or a row for each item of an exploded column): times `hours` and more after all others, other columns null or as given. They move watermarks past every real row."""
    ends = [df.agg(F.max(at).alias("__at")).select(F.expr(f"__at + INTERVAL {hours * (i + 1)} HOURS").alias(at), *[c.alias(n) for n, c in columns.items()]) for i in range(CLOSINGS)]
    return [e.select(*[(F.col(f.name) if f.name in e.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]) for e in ends]
