"""The split scan of JSON arrays: many small ranges give what one gives."""

import gzip
import json
import random

import pytest

from quillon.sources import arrays
from quillon.sources import hands as sources


def plain(text, inside, opens):
    """Elements by one walk over all characters."""
    close, out, depth, start, quoted, skip = {"[": "]", "{": "}"}[opens], [], 0, None, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "[{":
            if ch == opens and depth == len(inside) and start is None:
                start = i
            depth += 1
        elif not quoted and ch in "]}":
            depth -= 1
            if start is not None and depth == len(inside):
                if ch == close and arrays.is_json(text[start : i + 1]) and text[i + 1 :].strip():
                    out.append(text[start : i + 1])
                start = None
    return out


def value(rng, deep=0):
    kind = rng.randrange(7 if deep < 3 else 4)
    if kind == 0:
        return rng.choice(['}"{', "a\\", "\\\"]", "é}日", "", "[{", "}}}", "\\}"])
    if kind == 1:
        return rng.randrange(10**6)
    if kind in (2, 3):
        return rng.choice([None, True, 1.5])
    if kind == 4:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}}}": value(rng, deep + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "97b")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def got(spark, path, inside, opens):
    return [r["value"] for r in arrays.elements(spark, str(path), inside, opens).orderBy("file", "pos").collect()]


@pytest.mark.parametrize(("inside", "opens"), [("[", "{"), ("[", "["), ("{{[", "{")])
def test_ranges_give_what_one_walk_gives(spark, tmp_path, small_ranges, inside, opens):
    rng = random.Random(len(inside) + ord(opens))
    body = [value(rng) if rng.random() < 0.3 else {"x": value(rng), "y": "z" * rng.randrange(400)} for _ in range(40)]
    body += [[value(rng) for _ in range(3)] for _ in range(20)]
    rng.shuffle(body)
    parts = [json.dumps(b, ensure_ascii=False, indent=rng.choice([None, 1])) for b in body]
    for broken in ('{"a": }', '{"a" "b"}', "[1, }", "{]", "{,}", '[{"k": [1}]'):
        parts.insert(rng.randrange(len(parts)), broken)
    text = "[" + " ,\n".join(parts) + "]\n"
    if inside == "{{[":
        text = '{"data": {"n": {"x": 1}, "chunks": ' + text + ', "more": {}}, "end": [{"q": 1}]}'
    (tmp_path / "t.json").write_text(text)
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        f.write(text)
    want = plain(text, inside, opens)
    assert len(want) > 10
    rows = arrays.lines(spark, str(tmp_path / "t.json"))
    assert rows.select("range").distinct().count() > 20
    assert got(spark, tmp_path / "t.json", inside, opens) == want
    assert got(spark, tmp_path / "t.json.gz", inside, opens) == want
    pieces = arrays.pieces(rows, inside, opens, few=0).orderBy("range", "ix").collect()
    assert sorted(map(str, pieces)) == sorted(map(str, arrays.pieces(rows, inside, opens).collect()))


def test_positions_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"i": i, "pad": "p" * (i % 7 * 40)} for i in range(50)]))
    rows = arrays.elements(spark, str(tmp_path), "[", "{").collect()
    assert sorted((r["file"], r["pos"]) for r in rows) == [(f"{n}.json", i) for n in "ab" for i in range(50)]
    assert all(json.loads(r["value"])["i"] == r["pos"] for r in rows)


def test_an_element_over_many_ranges(spark, tmp_path, small_ranges):
    body = [{"i": 0}, {"i": 1, "big": [{"n": k} for k in range(300)]}, {"i": 2, "text": "}" * 500 + "x" * 500}, {"i": 3}]
    (tmp_path / "t.json").write_text(json.dumps(body))
    assert [json.loads(v) for v in got(spark, tmp_path / "t.json", "[", "{")] == body


def test_a_file_that_breaks_off_loses_its_last_element(spark, tmp_path):
    for i, text in enumerate(('[{"a":1},{"b":2', '[{"a":1},{"b":2}', '[{"a":1},{"b":"2', '[{"a":1},')):
        (tmp_path / f"{i}.json").write_text(text)
        assert got(spark, tmp_path / f"{i}.json", "[", "{") == ['{"a":1}']


def test_flat_chunks_are_the_same_over_any_ranges(spark, tmp_path):
    hands = [{"hand_id": str(i), "metadata": {"bb": 0.02}, "players": [{"seat": 1}], "actions": [{"street": "preflop", "actor_seat": 1}] * (i % 5)} for i in range(60)]
    (tmp_path / "f.json").write_text(json.dumps(hands))
    one = sorted(map(str, sources.flat(spark, str(tmp_path / "f.json"), 7).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        many = sources.flat(spark, str(tmp_path / "f.json"), 7)
        assert sorted(map(str, many.collect())) == one and len(one) == 56
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_new_files_land_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def put(name, n):
        (folder / name).write_text(json.dumps([{"hand_id": f"{name}{i}"} for i in range(n)]))

    def run():
        got = sources.follow(spark, str(folder), out, str(tmp_path / "ck"), lambda s, paths: sources.flat(s, paths, 2), most=2)
        return sorted(r[0] for r in got.select("hand.hand_id").collect())

    put("a", 4)
    put("b", 3)
    put("c", 2)
    first = ["a0", "a1", "a2", "a3", "b0", "b1", "c0", "c1"]
    assert run() == first == run()
    put("d", 2)
    assert run() == [*first, "d0", "d1"]


def test_elements_of_an_array_are_not_moved(spark, tmp_path):
    """Their numbers come from a row for each range, which goes to all tasks."""
    from quillon.sources.hands import flat

    (tmp_path / "a.json").write_text(json.dumps([{"hand_id": str(i)} for i in range(50)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for elements of any size
    try:
        read = flat(spark, str(tmp_path / "a.json"), 1)
        assert "Exchange hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
        assert {(r["chunk_id"], r["hand_ix"], r["hand"]["hand_id"]) for r in read.collect()} == {(f"a.json#{i}", 0, str(i)) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
