from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.commits import CommitLog
from loomtrace.operators import incremental
from loomtrace.operators.incremental import Conflict, Manifest, pending_entries, read_committed, run_once

A, B, C, X = "0000000a", "0000000b", "0000000c", "adapter-1"


def test_pending(spark, tmp_path):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, "running")], "run_id int, run_state string")
    obs = [
        (1, "same", [A, B], 1), (4, "same", [A, B], 1),
        (1, "grown", [A], 1), (2, "grown", [A, B], 1), (4, "grown", [A, B], 1),
        (1, "old", [A, B], 1), (3, "old", [C, B], 1), (4, "old", [A, B], 1),
        (3, "twice", [A], 1), (3, "twice", [B], 2), (4, "twice", [A], 1), (4, "twice", [B], 2),
        (3, "holder", [X, A], 1), (4, "holder", [X, A], 1),
        (4, "new", [A, None], 1), (4, "none", None, 1), (3, "gone", [A], 1), (4, None, [A], 1), (4, "new", [A, None], 1),
    ]
    df = spark.createDataFrame(obs, "run_id int, file_path string, entry_hashes array<string>, observed_at int")
    got = sorted(tuple(r) for r in pending_entries(df.withColumn("done", F.lit(1)), runs, str(tmp_path / "1")).collect())
    assert got == [("grown", 1), ("holder", 0), ("new", 0), ("new", 1), ("old", 0)]
    assert pending_entries(df, runs.filter("false"), str(tmp_path / "2")).collect() == []
    assert pending_entries(df.filter("false"), runs, str(tmp_path / "3")).collect() == []


def listing(spark, **files):
    return spark.createDataFrame([(k, len(v), v) for k, v in files.items()], "file_path string, size_bytes long, entry_hashes array<string>")


def process(todo):
    return todo.select("file_path", F.explode("places").alias("place"))


def rows(spark, m):
    return sorted(tuple(r) for r in read_committed(spark, m).select("file_path", "place", "batch").collect())


@pytest.mark.parametrize("linked", [True, False])
def test_a_number_is_taken_once(spark, tmp_path, linked):
    log = CommitLog(spark, str(tmp_path / "log"), linked)
    assert log.numbers() == [] and log.publish(1, {"x": "ü"}) and not log.publish(1, {"x": "late"}) and log.publish(2, {})
    assert log.numbers() == [1, 2] and log.read(1) == {"x": "ü"}
    assert [n for n in log.children(log.folder) if n.startswith("_draft")] == []


def test_runs_survive_failures(spark, tmp_path):
    root, out = str(tmp_path / "manifest"), str(tmp_path / "out")
    m = Manifest(spark, root)
    assert run_once(spark, listing(spark, f=[A], g=[B]), process, out, m) == 1
    assert run_once(spark, listing(spark, f=[A], g=[B]), process, out, m) is None

    class Died(Exception):
        pass

    def dies(*_):
        raise Died

    class NoCommit(Manifest):
        commit = dies

    class NoPublish(Manifest):
        def commit(self, *a):
            self.log.publish = dies
            return super().commit(*a)

    class Late(Manifest):  # dies after the commit stands
        def commit(self, *a):
            super().commit(*a)
            raise Died

    now = listing(spark, f=[A, C], g=[B])
    for way, how in ((Manifest, dies), (NoCommit, process), (NoPublish, process)):
        with pytest.raises(Died):
            run_once(spark, now, how, out, way(spark, root))
        assert rows(spark, m) == [("f", 0, 1), ("g", 0, 1)] and m.batches() == [1]
    with pytest.raises(Died):
        run_once(spark, now, process, out, Late(spark, root))
    assert run_once(spark, now, process, out, m) is None
    assert run_once(spark, listing(spark, f=[A, C], g=[B], h=[A]), process, out, m) == 3
    assert rows(spark, m) == [("f", 0, 1), ("f", 1, 2), ("g", 0, 1), ("h", 0, 3)] and m.files().count() == 3
    assert len(m.sweep(out)) == 2 and rows(spark, m) == [("f", 0, 1), ("f", 1, 2), ("g", 0, 1), ("h", 0, 3)]


def test_two_runs_at_once(spark, tmp_path):
    m, out = Manifest(spark, str(tmp_path / "manifest")), str(tmp_path / "out")
    began = []

    def slow(todo):  # another run commits while this one works
        if not began:
            began.append(run_once(spark, listing(spark, f=[A]), process, out, m))
        return process(todo)

    assert run_once(spark, listing(spark, f=[A], g=[B]), slow, out, m) == 2 and began == [1]
    assert rows(spark, m) == [("f", 0, 1), ("g", 0, 2)]

    def always(todo):
        run_once(spark, listing(spark, **{f"x{m.batches()[-1]}": [A]}), process, out, m)
        return process(todo)

    with pytest.raises(Conflict):
        run_once(spark, listing(spark, h=[A]), always, out, m, attempts=2)
    assert "h" not in {r[0] for r in rows(spark, m)} and run_once(spark, listing(spark, h=[A]), process, out, m) == 5


def test_what_is_processed_is_committed(spark, tmp_path):
    """A listing that changes between its evaluations."""
    m, out, folder = Manifest(spark, str(tmp_path / "m")), str(tmp_path / "out"), str(tmp_path / "listing")
    listing(spark, f=[A]).write.parquet(folder)

    def changes(todo):
        listing(spark, f=[A, B], g=[C]).write.mode("append").parquet(folder)
        return process(todo)

    assert run_once(spark, spark.read.parquet(folder), changes, out, m) == 1
    assert rows(spark, m) == [("f", 0, 1)] and [r.file_path for r in m.files().collect()] == ["f"]
    assert run_once(spark, spark.read.parquet(folder), process, out, m) == 2
    assert rows(spark, m) == [("f", 0, 1), ("f", 1, 2), ("g", 0, 2)]


def test_snapshots_hold_every_file_and_output(spark, tmp_path):
    m, out = Manifest(spark, str(tmp_path / "m"), snapshot_every=2), str(tmp_path / "out")
    for i in range(1, 6):
        assert run_once(spark, listing(spark, f=[A] * i, **{f"g{i}": [B]}), process, out, m) == i
    assert rows(spark, m) == sorted([("f", i - 1, i) for i in range(1, 6)] + [(f"g{i}", 0, i) for i in range(1, 6)])
    assert m.files().count() == 6 and {len(r.entry_hashes) for r in m.files().filter("file_path = 'f'").collect()} == {5}
    assert [bool(m.log.read(i).get("snapshot")) for i in m.batches()] == [False, True, False, True, False]


def test_one_operator_for_runs_and_observations(spark, tmp_path, monkeypatch):
    schema = "file_path string, entry_hashes array<string>"
    now = spark.createDataFrame([("same", [A, B]), ("held", [X, A]), ("null", [None]), ("less", [A]), ("more", [A, C]), ("new", [B]), ("none", None), ("void", None)], schema)
    done = spark.createDataFrame([("same", [A, B]), ("held", [X, A]), ("null", [None]), ("less", [A, B]), ("more", [A, B]), ("gone", [A]), ("none", None)], schema)
    got = {r.file_path: r.places for r in incremental.unprocessed(now, incremental.with_checksum(done)).collect()}
    assert got == {"held": [0], "null": [0], "less": [], "more": [1], "new": [0], "void": []}

    calls = []
    whole = incremental.run_once
    monkeypatch.setattr(incremental, "run_once", lambda *a: calls.append(1) or whole(*a))
    runs = spark.createDataFrame([(1, "ok"), (2, "running")], "run_id int, run_state string")
    obs = spark.createDataFrame([(1, "f", [A], 1), (2, "f", [A, B], 1)], "run_id int, file_path string, entry_hashes array<string>, observed_at int")
    assert [tuple(r) for r in pending_entries(obs, runs, str(tmp_path / "p")).collect()] == [("f", 1)] and len(calls) == 1
