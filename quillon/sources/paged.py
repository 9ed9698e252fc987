"""Data sources for what comes page by page: dumps with cursors, and batches that are read once they are ready.

Both read folders of any store that pyarrow's file systems reach; every machine
must reach them alike. Nothing is fetched over HTTP here: who downloads pages
writes each under its cursor, in any order.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

PAGED = "date string, page int, pos int, cursor string, record string"
#: Names under which a page tells where the next one is.
NEXT = ("nextCursor", "cursor", "next_cursor")
#: Records of a batch that goes to Spark, about: a page isn't cut.
BATCH_RECORDS = 10_000


def _store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(root: str, kind: str) -> list[str]:
    """The values of folders `kind=value` below a folder, in order."""
    from pyarrow import fs

    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(unquote(f.base_name.removeprefix(f"{kind}=")) for f in found if f.base_name.startswith(f"{kind}="))


def _text(path: str) -> str | None:
    """What a file, or the files of a folder in order, hold; None where there is none."""
    from pyarrow import fs

    store, base = _store(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        return None
    files = [info]
    if info.type == fs.FileType.Directory:
        files = sorted((f for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    parts = []
    for f in files:
        with store.open_input_stream(f.path) as s:
            parts.append(s.read().decode())
    return "".join(parts)


class _Pages:
    """The pages of a date by cursor: its folder is listed once, and of files with many pages it is known where each page is."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.folder = folder
        self.store, base = _store(folder)
        found = sorted(self.store.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda f: f.path)
        self.own = {unquote(f.base_name.removeprefix("cursor=")) for f in found if f.base_name.startswith("cursor=")}
        self.at: dict[str, tuple[str, int, int]] = {}
        self.files: dict[str, pa.NativeFile] = {}
        for f in found:
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".", "cursor=")):
                self._look(f.path)

    def _look(self, path: str) -> None:
        place = 0
        with io.BufferedReader(self.store.open_input_file(path), 1 << 20) as lines:
            for line in lines:
                cursor, tab, _ = line.partition(b"\t")
                if tab:  # else the writer is at work
                    self.at[unquote(cursor.decode(errors="replace"))] = path, place, len(line)
                place += len(line)

    def text(self, cursor: str) -> str | None:
        """A page's JSON; None where there is none."""
        if cursor in self.own:
            return _text(f"{self.folder}/cursor={quote(cursor, safe='')}")
        if cursor not in self.at:
            return None
        path, place, size = self.at[cursor]
        if path not in self.files:
            self.files[path] = self.store.open_input_file(path)
        return self.files[path].read_at(size, place).partition(b"\t")[2].decode()

    def close(self) -> None:
        for f in self.files.values():
            f.close()


class PagedDump(DataSource):
    """Records of a paged dump: `path`/date=<date>/cursor=<cursor> holds a page, JSON with its records and the cursor of the next.

    Many pages may also be in one file, so that a dump's files don't grow with
    its pages: other files of `path`/date=<date> have a page a line, the cursor
    (percent-encoded), a tab and the page. Of lines with the same cursor the
    last counts, by file name and place; a page in a folder of its own goes first.

    A date is a partition: its pages are followed from `first` (option, "start")
    through the cursors, wherever they lie in the folder. A filter on date is
    pushed down: other dates' pages aren't opened. Each date ends with a row
    without a record (pos -1) whose cursor says where it stopped: null at the
    end of the dump; with `mode` "keep", the cursor of a page that is missing or
    broken, from which a later read goes on if given it in `resume` (JSON, date
    to [cursor, page], null for done). In mode "failfast" such a page is an
    error, and so is a cursor that comes back in either.
    """

    @classmethod
    def name(cls) -> str:
        return "quillon_paged"

    def schema(self) -> str:
        return PAGED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.first, self.mode = options["path"].rstrip("/"), options.get("first", "start"), options.get("mode", "failfast")
        self.resume: dict = json.loads(options.get("resume", "{}"))
        self.dates: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("date",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.dates = own if self.dates is None else self.dates & own
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        dates = [d for d in _names(self.path, "date") if (self.dates is None or d in self.dates) and self.resume.get(d, "") is not None]
        return [InputPartition(d) for d in dates]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        date = partition.value
        cursor, page = self.resume.get(date) or (self.first, 0)
        pages, seen = _Pages(f"{self.path}/date={quote(date, safe='')}"), set()
        held: list[tuple] = []
        try:
            while cursor:
                if cursor in seen:
                    raise ValueError(f"{date}: cursor {cursor!r} comes back")
                seen.add(cursor)
                try:
                    data = json.loads(pages.text(cursor) or "")
                    data = data.get("data", data)
                    records = data if isinstance(data, list) else data.get("chunks", [])
                except (ValueError, AttributeError) as e:
                    if self.mode != "keep":
                        raise ValueError(f"{date}: page {cursor!r} is missing or broken") from e
                    break
                held += [(date, page, pos, cursor, json.dumps(r)) for pos, r in enumerate(records)]
                cursor = None if isinstance(data, list) else next((data[k] for k in NEXT if data.get(k)), None)
                page += 1
                if len(held) >= BATCH_RECORDS:
                    yield _batch(held)
                    held = []
        finally:
            pages.close()
        yield _batch([*held, (date, page, -1, cursor, None)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"date": pa.string(), "page": pa.int32(), "pos": pa.int32(), "cursor": pa.string(), "record": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def paged(spark: SparkSession, path: str, mode: str = "failfast", resume: dict | None = None, first: str = "start") -> DataFrame:
    """PAGED rows of a dump, see PagedDump. Turns on the session's push-down of filters to Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedDump)
    return spark.read.format(PagedDump.name()).options(path=path, mode=mode, first=first, resume=json.dumps(resume or {})).load()


MANIFEST = "date string, page int, cursor string, run long"


def land_pages(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Lands what a dump has that isn't landed yet; returns all records landed: (date, page, pos, record).

    Each run writes records to a folder of its own, then where each date stopped
    to the manifest; a run that fails before that is written over by the next.
    Dates that are through are not read again, others go on at their cursor.
    """
    from quillon.sources.state import read_or_empty

    known = read_or_empty(spark, f"{out}/manifest", MANIFEST)
    last = known.groupBy("date").agg(F.max_by(F.struct("cursor", "page"), "run").alias("at"), F.max("run").alias("run")).collect()  # a row for each date
    run = max((r["run"] for r in last), default=-1) + 1
    resume = {r["date"]: [r["at"]["cursor"], r["at"]["page"]] if r["at"]["cursor"] else None for r in last}
    rows = paged(spark, path, "keep", resume)
    rows.write.mode("overwrite").parquet(f"{out}/records/run={run}")
    got = spark.read.schema(rows.schema).parquet(f"{out}/records/run={run}")
    got.where("pos < 0").select("date", "page", "cursor", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{out}/manifest")
    through = read_or_empty(spark, f"{out}/manifest", MANIFEST).select("run").distinct()
    every = spark.read.schema(StructType(rows.schema.fields)).option("basePath", f"{out}/records").parquet(f"{out}/records")
    return every.join(F.broadcast(through), "run", "left_semi").where("pos >= 0").select("date", "page", "pos", "record")


BATCHES = "batch long, pos long, hand string"


class ReadyBatches(DataSource):
    """Batches of hands as a stream whose offset moves only over batches that are ready.

    `path`/batch=<n> holds the hands of batch n as JSON lines; `status` holds
    JSON lines {"batch", "ready", "available", "seq"}, of which the one with the
    largest seq counts. A batch is read once it and all before it are ready and
    have `least` hands available (option, 0). Spark's checkpoint holds the
    offset, so each batch comes once, in order, after a restart too.
    """

    @classmethod
    def name(cls) -> str:
        return "quillon_ready"

    def schema(self) -> str:
        return BATCHES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _ReadyReader(dict(self.options))


class _ReadyReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.status, self.least = options["path"].rstrip("/"), options["status"], int(options.get("least", "0"))
        self.now = -1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        newest: dict[int, dict] = {}
        for line in (_text(self.status) or "").splitlines():
            try:
                s = json.loads(line)
                if s.get("seq", 0) >= newest.get(s["batch"], {}).get("seq", 0):
                    newest[s["batch"]] = s
            except (ValueError, KeyError, AttributeError, TypeError):
                continue  # half a line of a writer at work
        n = -1
        while (s := newest.get(n + 1)) and s.get("ready") is True and int(s.get("available") or 0) >= self.least:
            n += 1
        self.now = max(self.now, n)  # what was ready once stays so
        return {"batch": self.now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(n) for n in range(start["batch"] + 1, end["batch"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        lines = (_text(f"{self.path}/batch={partition.value}") or "").splitlines()
        for pos, line in enumerate(x for x in lines if x.strip()):
            yield partition.value, pos, line

    def commit(self, end: dict) -> None:
        self.now = max(self.now, end["batch"])

    def stop(self) -> None:
        pass


def ready_batches(spark: SparkSession, path: str, status: str, least: int = 0) -> DataFrame:
    """A stream of BATCHES rows, see ReadyBatches."""
    spark.dataSource.register(ReadyBatches)
    return spark.readStream.format(ReadyBatches.name()).options(path=path, status=status, least=str(least)).load()


# Planning workers beside the driver don't get files that are added for tasks: what they unpickle brings its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
