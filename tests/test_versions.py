"""Tables in versions: what breaks leaves the old rows, and a batch rewrites its own buckets only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import relations
from seriesloom.sources import sinks, versions
from seriesloom.streaming.ingest import ingest


def rows(spark, path):
    return sorted((tuple(r) for r in sinks.read_table(spark, path).collect()), key=repr)


def files(path):
    return {str(p) for p in path.rglob("*.parquet")}


class Broken(Exception):
    pass


STEPS = ["current", "_frame", "_commit", "fs.create", "fs.rename"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_at_any_step_leaves_the_old_rows(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/t"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.store(old, path, ["k", "v"], ["k"])
    before = rows(spark, path)
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")

    def fail(*a, **k):
        raise Broken

    with monkeypatch.context() as m:
        if step.startswith("fs."):
            real = versions.file_system

            class Store:
                def __init__(self, fs):
                    self.fs = fs

                def __getattr__(self, name):
                    return fail if name == step[3:] else getattr(self.fs, name)

            m.setattr(versions, "file_system", lambda s, p: (real(s, p)[0], Store(real(s, p)[1])))
        else:
            m.setattr(versions, step, fail)
        with pytest.raises(Broken):
            sinks.store(new, path, ["k", "v"], ["k"])
    assert rows(spark, path) == before
    sinks.store(new, path, ["k", "v"], ["k"])
    assert rows(spark, path) == [(1, "a"), (2, "c"), (3, "d")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    versions.append(spark.range(3), path)
    stale = versions.current(spark, path)
    versions.append(spark.range(3, 5), path)
    with monkeypatch.context() as m:
        m.setattr(versions, "current", lambda *a: stale)
        with pytest.raises(versions.Conflict):
            versions.append(spark.range(9), path)
    assert rows(spark, path) == [(i,) for i in range(5)]
    assert versions.read(spark, path, 1).count() == 3


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.range(10_000).select("id", (F.col("id") / 100).cast("int").alias("season"), F.lit("old").alias("v"))
    by = {"bucket": F.col("season")}
    sinks.append_keep_last(table, path, ["id", "season"], **by)
    first = files(tmp_path)
    assert len(first) == 100
    sinks.append_keep_last(table.where("season = 7").withColumn("v", F.lit("new")), path, ["id", "season"], **by)
    assert first <= files(tmp_path) and len(files(tmp_path) - first) == 1
    got = sinks.read_table(spark, path)
    assert got.columns == ["id", "season", "v"] and got.count() == 10_000
    assert {tuple(r) for r in got.where("v = 'new'").select("season").distinct().collect()} == {(7,)}
    assert versions.forget(spark, path, 1) == 1 and len(files(tmp_path)) == 100
    assert sinks.read_table(spark, path).where("v = 'new'").count() == 100


def test_repeated_new_keys_keep_the_last(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (1, "z", 6), (3, "p", 2), (3, "q", 1)], "k int, v string, t int")
    want = [(1, "y", 7), (2, "b", 1), (3, "p", 2)]
    for mode in ("replace", "merge"):
        assert sorted(tuple(r) for r in relations.upsert(old, new, ["k"], mode, ["t"]).collect()) == want
    path = f"{tmp_path}/t"
    sinks.store(new, path, ["k", "v", "t"], ["k"], order=["t"])  # in the first call too
    assert rows(spark, path) == [(1, "y", 7), (3, "p", 2)]
    sinks.store(new.select("k", F.lit("only").alias("v")), path, ["k", "v", "t"], ["k"])
    assert rows(spark, path) == [(1, "only", 7), (3, "only", 2)]


def test_late_rows_don_t_replace_newer_ones(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/t"
    for batch in ([(1, 20), (2, 1)], [(1, 10), (3, 5)], [(3, 5), (2, 2)]):
        spark.createDataFrame(batch, "k int, ts int").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "k int, ts int", path, ["k"], ["ts"], f"{tmp_path}/seen", buckets=4)
    assert rows(spark, path) == [(1, 20), (2, 2), (3, 5)]
    ingest(spark, source, "k int, ts int", path, ["k"], ["ts"], f"{tmp_path}/seen", buckets=4)
    assert versions.current(spark, path)["version"] == 3


def test_new_columns_null_buckets_and_no_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_keep_last(spark.createDataFrame([(None, "x"), (1, "a/b=c")], "k int, v string"), path, ["k"], bucket=F.col("v"))
    sinks.append_keep_last(spark.createDataFrame([(1, "a/b=c", 2.0)], "k int, v string, w double"), path, ["k"], bucket=F.col("v"))
    assert rows(spark, path) == [(1, "a/b=c", 2.0), (None, "x", None)]
    sinks.append_keep_last(spark.createDataFrame([], "k int, v string"), path, ["k"], bucket=F.col("v"))
    assert sinks.read_table(spark, path).count() == 2
    sinks.overwrite(spark.createDataFrame([], "k int, v string"), path, ["v"])
    assert sinks.read_table(spark, path).columns == ["k", "v"] and sinks.read_table(spark, path).count() == 0


def test_publication_that_broke_off_is_brought_back(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/doc"
    sinks.write_text(spark, path, {"n": 1})
    (tmp_path / "doc").rename(tmp_path / "doc.aside")  # the driver died between the two renames
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, f"{tmp_path}/absent", path)
    sinks.recover(spark, path)
    assert spark.read.text(path, wholetext=True).first()[0].strip() == '{\n  "n": 1\n}'
    (tmp_path / "doc").rename(tmp_path / "doc.aside")
    sinks.write_text(spark, path, {"n": 2})
    assert spark.read.text(path, wholetext=True).first()[0].strip() == '{\n  "n": 2\n}'
    assert not (tmp_path / "doc.aside").exists()
