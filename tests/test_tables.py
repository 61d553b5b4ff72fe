"""Keyed tables: tags, tombstones, replay, compaction, recovery, schema rebuilds."""

from __future__ import annotations

import json
import random
import subprocess
import sys

import pytest

from postern.errors import ConcurrentWriteError, SchemaError, StorageError
from postern.operators import schema_admin
from postern.plans.predicate import P
from postern.sources.namespace import INDEX_ONLY, Namespace
from postern.sources.schema import IndexDecl, StateSchema
from postern.sources.table import Table
from tests.conftest import ROOT

KIND = "key string, city string, salary int, tags array<string>"


def frame(spark, *rows):
    return spark.createDataFrame([(k, c, s, t) for k, c, s, t in rows], KIND)


@pytest.fixture
def table(spark, tmp_path):
    schema = StateSchema.of("job", "key", frame(spark), city="hash", salary="range", tags="hash")
    return Table(spark, f"file://{tmp_path}/job", schema)


def test_conditional_writes(spark, table):
    assert not table.read("a").exists
    new = spark.createDataFrame([("a", "Oslo", 1, None, None)], KIND + ", etag string")
    tag = table.write(new)
    assert table.read("a").etag == tag == "1" and table.read("a").record.city == "Oslo"
    with pytest.raises(ConcurrentWriteError):
        table.write(new)
    tag2 = table.write(spark.createDataFrame([("a", "Rome", 2, None, tag)], KIND + ", etag string"))
    with pytest.raises(ConcurrentWriteError):
        table.clear(spark.createDataFrame([("a", tag)], "key string, etag string"))
    table.clear(spark.createDataFrame([("a", tag2)], "key string, etag string"))
    assert not table.read("a").exists and table.current().count() == 0
    table.clear(spark.createDataFrame([("a", None)], "key string, etag string"))
    with pytest.raises(ConcurrentWriteError):
        table.clear(spark.createDataFrame([("a", "1")], "key string, etag string"))


def test_extraction(spark, table):
    table.upsert(frame(spark, ("a", None, None, ["b", None, "a", "b", ""]), ("b", "x", 1, None)))
    rows = {r.key: r for r in table.current().collect()}
    assert rows["a"].tags == ["", "a", "b"] and rows["b"].tags == [] and rows["a"].city is None
    table.upsert(frame(spark, ("c", "x", 1, [f"t{i % 64}" for i in range(200)])))
    with pytest.raises(Exception, match="distinct members"):
        table.upsert(frame(spark, ("d", "x", 1, [f"t{i}" for i in range(65)])))
    assert table.current().count() == 3


def test_nan_is_refused(spark, tmp_path):
    data = spark.createDataFrame([(1, float("nan"))], "id long, v double")
    t = Table(spark, f"file://{tmp_path}/n", StateSchema.of("n", "id", data, v="range"))
    with pytest.raises(Exception, match="NaN"):
        t.upsert(data)
    t.upsert(spark.createDataFrame([(1, -0.0), (2, float("inf"))], "id long, v double"))
    assert sorted(str(r.v) for r in t.current().collect()) == ["0.0", "inf"]


def test_codec_domains(spark, tmp_path):
    data = spark.createDataFrame([(1, 256)], "id long, v short")
    t = Table(spark, f"file://{tmp_path}/c", StateSchema.of("c", "id", data, v=IndexDecl("v", "range", codec="byte")))
    with pytest.raises(Exception, match="domain"):
        t.upsert(data)


def test_random_changes_equal_a_rebuild(spark, table):
    rng, model = random.Random(0x5EED), {}
    for step in range(12):
        up, down = {}, set()
        for _ in range(8):
            key = f"property-{rng.randrange(24):02d}"
            if rng.randrange(4) == 0:
                down.add(key)
                up.pop(key, None)
            elif key not in down:
                up[key] = (key, rng.choice(["Helsinki", "London", "Oslo"]), rng.choice([10, 20, 30, 40]), [])
        table.upsert(frame(spark, *up.values()))
        model |= up
        if down:
            table.remove(spark.createDataFrame([(k,) for k in down], "key string"))
            model = {k: v for k, v in model.items() if k not in down}
        if step % 5 == 4:
            before = sorted(map(tuple, table.rows().collect()))
            table.compact()
            assert sorted(map(tuple, table.rows().collect())) == before
            table.vacuum()
        if step % 4 == 3:
            assert {r.key: tuple(r) for r in table.current().collect()} == model
    table.recover()


def test_last_arrival_wins_within_a_write(spark, table):
    rows = frame(spark, ("a", "Oslo", 1, []), ("a", "Rome", 2, []), ("b", "x", 5, []))
    table.upsert(rows, order="salary")
    assert {r.key: r.city for r in table.current().collect()} == {"a": "Rome", "b": "x"}
    changes = spark.createDataFrame([("a", "x", 1, [], "U", 1), ("a", None, None, None, "D", 2), ("b", None, None, None, "D", 1), ("b", "y", 1, [], "U", 2)], KIND + ", op string, version long")
    table.apply_outbox(changes)
    assert {r.key: r.city for r in table.current().collect()} == {"b": "y"}


def test_writers_race_for_a_version(spark, table):
    table.upsert(frame(spark, ("a", "x", 1, [])))
    m = table.manifest()
    table.upsert(frame(spark, ("b", "x", 1, [])))
    with pytest.raises(ConcurrentWriteError):
        table._append(frame(spark, ("c", "x", 1, [])), None, before=m)
    assert {r.key for r in table.current().collect()} == {"a", "b"}


def test_damage_is_noticed(spark, table):
    table.upsert(frame(spark, ("a", "x", 1, [])))
    table.files.remove(f"{table.manifest().deltas[0]}/_SUCCESS")
    with pytest.raises(StorageError):
        table.recover()
    table.files.create_json("manifests/000000000002.json", {"version": 2})
    with pytest.raises(StorageError):
        table.manifest()


def space(spark, base, version=1, mode="integrated", **kinds):
    ns = Namespace(spark, "jobs", base, mode)
    ns.register(StateSchema.of("job", "key", frame(spark), **kinds), version)
    return ns


def test_schema_gate_and_rebuild(spark, tmp_path):
    base = f"file://{tmp_path}"
    first = space(spark, base, city="hash")
    first.writer("job").upsert(frame(spark, ("a", "Oslo", 1, []), ("b", "Rome", 5, [])))
    second = space(spark, base, 2, city="hash", salary="range")
    assert not schema_admin.status(second, "job").active
    for use in (lambda: second.query("job").where(P.city == "Oslo").ids(), lambda: second.writer("job")):
        with pytest.raises(SchemaError):
            use()
    # Broken off in the middle: nobody may use it, and it is taken up again.
    assert schema_admin.rebuild(second, "job", stop_after="scanning").phase == "scanning"
    with pytest.raises(SchemaError):
        first.writer("job")
    done = schema_admin.rebuild(space(spark, base, 2, city="hash", salary="range"), "job")
    assert done.active and done.generation == 2
    assert second.query("job").where(P.salary >= 2).ids() == ["b"]
    with pytest.raises(SchemaError):
        first.query("job").where(P.city == "Oslo").ids()


def test_index_only(spark, tmp_path):
    base = f"file://{tmp_path}"
    ns = space(spark, base, mode=INDEX_ONLY, city="hash")
    ns.writer("job").upsert(frame(spark, ("a", "Oslo", 1, [])))
    assert ns.data("job").columns == ["key", "city"]
    assert ns.query("job").where(P.city == "Oslo").ids() == ["a"]
    with pytest.raises(StorageError):
        ns.table("job").write(frame(spark, ("a", "Oslo", 1, [])))
    with pytest.raises(SchemaError):
        schema_admin.rebuild(space(spark, base, 2, INDEX_ONLY, city="hash", salary="range"), "job")


def test_namespaces_are_apart(spark, tmp_path):
    a, b = Namespace(spark, "a", f"file://{tmp_path}"), Namespace(spark, "b", f"file://{tmp_path}")
    for ns in (a, b):
        ns.register(StateSchema.of("job", "key", frame(spark), city="hash"))
    a.writer("job").upsert(frame(spark, ("a", "Oslo", 1, [])))
    assert b.data("job").count() == 0
    with pytest.raises(SchemaError):
        a.register(StateSchema.of("job", "key", frame(spark), salary="range"))


RACER = """
import sys, time
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from postern.errors import ConcurrentWriteError
from postern.sources.files import Files
files, won = Files(spark, sys.argv[2]), []
print("ready", flush=True)
sys.stdin.readline()
for n in range(150):
    try:
        files.create_json(f"manifests/{n:012d}.json", {"by": sys.argv[3], "n": n})
        won.append(n)
    except ConcurrentWriteError:
        pass
print("won", *won, flush=True)
spark.stop()
"""


def test_two_processes_never_share_a_version(tmp_path):
    base = f"file://{tmp_path}/raced"
    racers = [subprocess.Popen([sys.executable, "-c", RACER, str(ROOT), base, str(k)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for k in range(2)]
    try:
        for r in racers:
            assert any(line == "ready\n" for line in iter(r.stdout.readline, ""))
        for r in racers:
            r.stdin.write("go\n")
            r.stdin.flush()
        won = [next(x for x in r.communicate(timeout=120)[0].splitlines() if x.startswith("won")).split()[1:] for r in racers]
    finally:
        for r in racers:
            r.kill()
    assert sorted(map(int, won[0] + won[1])) == list(range(150))
    for k, mine in enumerate(won):
        for n in mine:
            assert json.loads((tmp_path / "raced" / "manifests" / f"{int(n):012d}.json").read_text()) == {"by": str(k), "n": int(n)}
    assert not list((tmp_path / "raced" / "manifests").glob("*.draft"))


def test_a_filter_reaches_the_snapshot_and_it_is_not_shuffled(spark, table):
    table.upsert(frame(spark, *((f"k{i}", "Oslo" if i % 2 else "Rome", i, []) for i in range(50))))
    table.compact()
    table.upsert(frame(spark, ("k1", "Rome", 1, []), ("k60", "Oslo", 60, [])))
    table.remove(spark.createDataFrame([("k3",)], "key string"))
    found = table.current().where("city = 'Oslo'")
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and "EqualTo(city,Oslo)" in x)
    above = lines[max(k for k in range(at) if "Union" in lines[k]) : at]
    assert any("BroadcastHashJoin" in x and "LeftAnti" in x for x in above)
    assert not any("Exchange" in x or "Aggregate" in x for x in above)
    assert {r.key for r in found.collect()} == {*(f"k{i}" for i in range(5, 50, 2)), "k60"}


def test_a_blind_write_that_loses_is_made_again(spark, table, monkeypatch):
    table.upsert(frame(spark, ("a", "x", 1, [])))
    real, raced = Table._delta, []

    def slow(self, *args):
        name = real(self, *args)
        if not raced:
            raced.append(1)
            other = Table(spark, table.files.base, table.schema)
            other.upsert(frame(spark, ("b", "y", 2, [])))
        return name

    monkeypatch.setattr(Table, "_delta", slow)
    table.upsert(frame(spark, ("a", "z", 3, [])))
    assert {r.key: r.city for r in table.current().collect()} == {"a": "z", "b": "y"}
    assert table.manifest().version == 3 and len(table.files.names("deltas")) == 3


def test_a_lost_compaction_is_no_lost_write(spark, table, monkeypatch):
    import postern.sources.table as module

    monkeypatch.setattr(module, "COMPACT_AFTER", 2)

    def lost(self):
        raise ConcurrentWriteError("another was first")

    monkeypatch.setattr(Table, "compact", lost)
    assert [table.upsert(frame(spark, (k, "x", 1, []))) for k in "abc"] == ["1", "2", "3"]
    assert table.current().count() == 3


def test_old_manifests_go_with_the_files(spark, table):
    for k in "abcd":
        table.upsert(frame(spark, (k, "x", 1, [])))
    table.compact()
    table.vacuum()
    assert table.files.names("manifests") == ["000000000005.json"] and table.files.names("deltas") == []
    assert table.current().count() == 4 and table.upsert(frame(spark, ("e", "x", 1, []))) == "6"


def test_entries_have_a_capacity(spark, tmp_path, monkeypatch):
    import postern.sources.table as module

    kind = "key string, note string, tags array<string>"
    schema = StateSchema.of("noted", "key", spark.createDataFrame([], kind), note="hash", tags="hash")
    t = Table(spark, f"file://{tmp_path}/noted", schema)
    row = lambda note, tags: spark.createDataFrame([("a", note, tags)], kind)
    t.upsert(row("n" * (module.ENTRY_BYTES - len("noted/note")), None))
    for wrong in (row("n" * module.ENTRY_BYTES, []), row(None, ["t" * module.ENTRY_BYTES]), row("n", [chr(97 + i) * 60_000 for i in range(10)])):
        with pytest.raises(Exception, match="capacity"):
            t.upsert(wrong)
    monkeypatch.setattr(module, "ENTRIES_PER_RECORD", 3)
    with pytest.raises(Exception, match="capacity"):
        t.upsert(row("n", ["a", "b", "c"]))
    with pytest.raises(SchemaError):
        StateSchema.of("s" * 1025, "key", spark.createDataFrame([], kind))


@pytest.mark.parametrize("sink", ["orc", "json"])
def test_other_file_formats(spark, tmp_path, sink):
    t = Table(spark, f"file://{tmp_path}/t", StateSchema.of("job", "key", frame(spark), city="hash", tags="hash"), sink=sink)
    t.upsert(frame(spark, ("a", "Oslo", 1, ["x", "y"]), ("b", None, 2, None)))
    t.compact()
    t.upsert(frame(spark, ("a", "Rome", 3, [])))
    t.remove(spark.createDataFrame([("b",)], "key string"))
    assert [tuple(r) for r in t.current().collect()] == [("a", "Rome", 3, [])] and t.recover().version == 4
