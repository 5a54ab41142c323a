"""The commit log: retries, crashes between its steps, two writers, versions, streams."""

import json
import os

import pytest

from plumbline.sources import sinks
from plumbline.streaming import commits

SHAPE = "seq long, period string, v string"


def frame(spark, *seqs):
    return spark.createDataFrame([(i, f"p{i % 2}", f"v{i}") for i in seqs], SHAPE)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_a_batch_is_there_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert seqs(commits.read(spark, folder, SHAPE)) == []
    assert commits.append(frame(spark, 1, 2, 3), folder, "a", ("period",)) == 1
    assert commits.append(frame(spark, 4), folder, "b", ("period",)) == 2
    assert commits.append(frame(spark, 1, 2, 3), folder, "a", ("period",)) == 1
    assert commits.append(frame(spark).limit(0), folder, "none", ("period",)) == 3
    assert seqs(commits.read(spark, folder, SHAPE)) == [1, 2, 3, 4]
    assert seqs(commits.read(spark, folder, SHAPE, version=1)) == [1, 2, 3]
    assert [(r.version, r.batch, r.rows) for r in commits.versions(spark, folder).orderBy("version").collect()] == [(1, "a", 3), (2, "b", 1), (3, "none", 0)]


def test_a_crash_between_the_steps(spark, tmp_path, monkeypatch):
    """The data lie at their place, the manifest is missing: readers don't see them, and the next try completes the commit."""
    folder = str(tmp_path / "t")
    commits.append(frame(spark, 1), folder, "a")
    monkeypatch.setattr(commits.Store, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        commits.append(frame(spark, 2, 3), folder, "b")
    monkeypatch.undo()
    assert seqs(commits.read(spark, folder, SHAPE)) == [1]
    assert commits.append(frame(spark, 2, 3), folder, "b") == 2
    assert seqs(commits.read(spark, folder, SHAPE)) == [1, 2, 3] and len(os.listdir(f"{folder}/data")) == 2
    assert not [x for x in os.listdir(f"{folder}/_aside") if not x.startswith(".")]


def test_two_writers_with_one_number(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    commits.append(frame(spark, 1), folder, "a")
    names = commits.Store.names
    monkeypatch.setattr(commits.Store, "names", lambda self, name: [] if name == "log" else names(self, name))  # it hasn't seen version 1
    store = commits.Store(spark, folder)
    assert not store.put_text("other\n", "log/000000000001.json")
    assert json.load(open(f"{folder}/log/000000000001.json"))["batch"] == "a"
    assert commits.append(frame(spark, 2), folder, "b") == 2
    monkeypatch.undo()
    assert seqs(commits.read(spark, folder, SHAPE)) == [1, 2]


def test_stream_and_sink(spark, tmp_path):
    """Two streams one after the other: each batch is handed on once, also where a sink runs again."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(3):
        commits.append(frame(spark, 2 * k, 2 * k + 1), a, f"n{k}", ("period",))
        commits.sink(commits.stream(spark, a, SHAPE), b, "copy", str(tmp_path / "c"), ("period",)).awaitTermination(60)
    assert seqs(commits.read(spark, b, SHAPE)) == list(range(6))
    commits.append(frame(spark, 99), b, "copy-000000000000")
    assert seqs(commits.read(spark, b, SHAPE)) == list(range(6))


def test_transaction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for name, rows in (("t1", (3, 1, 2)), ("t2", (5, 4)), ("t1", (3, 1, 2))):
        sinks.transaction_log(frame(spark, *rows).repartition(3), path, name)
    got = commits.read(spark, path, SHAPE)
    assert sorted((r.version, r.seq) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    files = sorted(f for f in os.listdir(f"{path}/data/batch=t1") if f.endswith(".json"))
    assert [json.loads(x)["seq"] for f in files for x in open(f"{path}/data/batch=t1/{f}")] == [1, 2, 3]
