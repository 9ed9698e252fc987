"""Paged dumps and batches behind a gate."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import paged
from quillon.streaming import runs


def page(root, date, cursor, records, following=None, key="nextCursor"):
    folder = root / f"date={date}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"cursor={cursor}").write_text(json.dumps({"data": {"chunks": records} | ({key: following} if following else {})}))


@pytest.fixture
def dump(tmp_path):
    root = tmp_path / "dump"
    page(root, "2026-01-01", "zz", [{"i": 2}], "a%2Fb".replace("%2F", "/"), "cursor")
    page(root, "2026-01-01", "start", [{"i": 0}, {"i": 1}], "zz")
    page(root, "2026-01-01", "a%2Fb", [{"i": 3, "t": "é"}])
    page(root, "2026-01-02", "start", [{"i": 10}], "next", "next_cursor")
    (root / "date=2026-01-02" / "cursor=next").write_text('{"data": {"chunks": [')
    page(root, "2026-01-03", "start", [])
    return root


def records(df):
    return sorted((r["date"], r["page"], r["pos"], json.loads(r["record"])["i"]) for r in df.where("record is not null").collect())


def test_pages_are_followed_in_order(spark, dump):
    rows = paged.paged(spark, str(dump), "keep")
    assert records(rows) == [("2026-01-01", 0, 0, 0), ("2026-01-01", 0, 1, 1), ("2026-01-01", 1, 0, 2), ("2026-01-01", 2, 0, 3), ("2026-01-02", 0, 0, 10)]
    assert {r["date"]: (r["cursor"], r["page"]) for r in rows.where("pos = -1").collect()} == {"2026-01-01": (None, 3), "2026-01-02": ("next", 1), "2026-01-03": (None, 1)}


def test_a_date_is_a_partition_and_others_are_not_opened(spark, dump):
    good = paged.paged(spark, str(dump)).where(F.col("date").isin("2026-01-01", "2026-01-03"))
    assert good.rdd.getNumPartitions() == 2 and len(records(good)) == 4  # failfast: the broken date isn't read
    with pytest.raises(Exception, match="missing or broken"):
        paged.paged(spark, str(dump)).collect()


def test_a_cursor_that_comes_back_is_an_error(spark, tmp_path):
    page(tmp_path, "d", "start", [1], "start")
    with pytest.raises(Exception, match="comes back"):
        paged.paged(spark, str(tmp_path), "keep").collect()


def test_landing_resumes_at_the_broken_page(spark, dump, tmp_path):
    out = str(tmp_path / "out")
    assert len(records(paged.land_pages(spark, str(dump), out))) == 5
    assert len(records(paged.land_pages(spark, str(dump), out))) == 5  # nothing new, nothing twice
    page(dump, "2026-01-02", "next", [{"i": 11}], "last")
    page(dump, "2026-01-02", "last", [{"i": 12}])
    page(dump, "2026-01-04", "start", [{"i": 20}])
    spark.createDataFrame([("x", 0, 0, "c", "{}")], paged.PAGED).write.parquet(f"{out}/records/run=2")  # a run that failed before its manifest
    got = records(paged.land_pages(spark, str(dump), out))
    assert got[4:] == [("2026-01-02", 0, 0, 10), ("2026-01-02", 1, 0, 11), ("2026-01-02", 2, 0, 12), ("2026-01-04", 0, 0, 20)] and len(got) == 8


def test_many_pages_may_be_in_one_file(spark, dump):
    """A file per page makes the time of a dump that of its files."""
    line = lambda cursor, records, following=None: f"{cursor}\t" + json.dumps({"data": {"chunks": records} | ({"nextCursor": following} if following else {})})
    folder = dump / "date=2026-01-05"
    folder.mkdir()
    (folder / "part-0").write_text("\n".join([line("x%09y", [{"i": 33}]), line("c", [{"i": 32}], "x\ty"), line("b", [{"i": 0}]), "d"]))  # the last line is half written
    (folder / "part-1").write_text("\n".join([line("start", [{"i": 30}, {"i": 30, "t": "é"}], "b"), line("b", [{"i": 31}], "c"), ""]))
    (folder / "_SUCCESS").write_text(line("b", [{"i": -1}]))
    own = paged.paged(spark, str(dump)).where("date = '2026-01-05'")
    assert [r[1:] for r in records(own)] == [(0, 0, 30), (0, 1, 30), (1, 0, 31), (2, 0, 32), (3, 0, 33)]
    page(dump, "2026-01-05", "x%09y", [{"i": 34}], "gone")  # a page of its own goes first
    kept = paged.paged(spark, str(dump), "keep").where("date = '2026-01-05'")
    assert [r[3] for r in records(kept)] == [30, 30, 31, 32, 34]
    assert [(r["cursor"], r["page"]) for r in kept.where("pos = -1").collect()] == [("gone", 4)]


def test_the_dump_query_has_no_file_for_each_page(spark, sf, monkeypatch):
    import os

    from quillon.plans.catalog import QUERIES

    seen = []
    land = paged.land_pages
    monkeypatch.setattr(paged, "land_pages", lambda s, path, out: seen.append(path) or land(s, path, out))
    wanted = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("ts is not null").count()
    assert QUERIES["paged_dump"](spark, "/root/testdata/sf0.01").count() == wanted
    folders = [d for d, _, names in os.walk(seen[0].removeprefix("file:")) if any(f.startswith("part-") for f in names)]
    assert len(folders) == 30 and all(os.path.basename(d).startswith("date=") for d in folders)


def test_batches_come_once_they_are_ready(spark, tmp_path):
    root, status = tmp_path / "b", tmp_path / "status"
    status.mkdir()
    for n in range(4):
        (root / f"batch={n}").mkdir(parents=True)
        (root / f"batch={n}" / "hands.json").write_text("".join(json.dumps({"hand_id": f"{n}-{i}"}) + "\n" for i in range(n + 1)))

    def tell(name, *lines):
        (status / name).write_text("".join(json.dumps(x) + "\n" for x in lines))

    def run():
        stream = paged.ready_batches(spark, str(root), str(status), least=2)
        out = runs.drain(stream, str(tmp_path / "c"), str(tmp_path / "o"), "append").collect()
        return sorted((r["batch"], r["pos"], json.loads(r["hand"])["hand_id"]) for r in out)

    tell("0", {"batch": 0, "ready": True, "available": 5}, {"batch": 2, "ready": True, "available": 5}, {"batch": 1, "ready": False, "available": 9})
    first = [(0, 0, "0-0")]
    assert run() == first
    assert run() == first
    tell("1", {"batch": 1, "ready": True, "available": 1, "seq": 1})  # too few hands
    assert run() == first
    (status / "2").write_text(json.dumps({"batch": 1, "ready": True, "available": 2, "seq": 2}) + "\n{\"batch\": 3, ")
    assert run() == first + [(1, 0, "1-0"), (1, 1, "1-1"), (2, 0, "2-0"), (2, 1, "2-1"), (2, 2, "2-2")]
    tell("0", {"batch": 0, "ready": False, "available": 5}, {"batch": 2, "ready": True, "available": 5})  # what was read stays read
    assert len(run()) == 6
