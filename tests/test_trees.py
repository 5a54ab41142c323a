"""The source tree data source: what is found, what is never listed or opened, and the run from files to batches."""

import fnmatch
import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files, trees

TREE = ["a.py", "b.js", "Makefile", "src/c.py", "src/deep/er/d.py", "src/deep/e.txt", "node_modules/x/f.py", "src/build/g.py", ".hidden/h.py", "src/two.part.py", "empty/.keep"]


@pytest.fixture
def root(tmp_path):
    for name in TREE:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe ok")
    return str(tmp_path)


def wanted(excludes, extensions=("py",)):
    out = lambda p: any(fnmatch.fnmatchcase(p, x) or fnmatch.fnmatchcase("/" + p, x) for x in excludes)
    return sorted(p for p in [*TREE, "bad.py"] if p.rsplit(".", 1)[-1] in extensions and "." in p and not out(p))


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_files_are_found(spark, root, parts):
    for excludes in ([], ["node_modules/*", "**/build/**"], ["*.py"], ["src/*"]):
        rows = trees.read_tree(spark, root, [".py"], excludes, parts=parts).collect()
        assert sorted(r.path for r in rows) == wanted(excludes) and all(r.text == f"# {r.path}\n" for r in rows if r.path != "bad.py")
    both = files.source_files(spark, root, ["py", "js"])
    assert sorted(r.path for r in both.collect()) == wanted([], ("py", "js"))
    assert [r.ext for r in both.filter("path = 'b.js'").collect()] == ["js"]


class Watched:
    """A reader in this process that notes what it lists and opens."""

    def __init__(self, root, **options):
        self.reader = trees.tree_source()({"path": root, "extensions": "py", **options}).reader(None)
        self.listed, entries = [], self.reader.entries
        self.reader.entries = lambda s, b, folder: self.listed.append(folder) or entries(s, b, folder)
        self.read = [x for p in self.reader.partitions() for b in self.reader.read(p) for x in b["path"].to_pylist()]


def test_what_is_excluded_is_not_listed(root):
    w = Watched(root, excludes="node_modules/*,**/build/**", parts="2")
    assert not {"node_modules", "node_modules/x", "src/build"} & set(w.listed) and "src/deep/er" in w.listed
    assert sorted(w.read) == wanted(["node_modules/*", "**/build/**"])


def test_only_the_asked_beginning_is_listed(spark, root):
    w = Watched(root, begins="src/deep")
    assert set(w.listed) == {"", "src", "src/deep", "src/deep/er"} and w.read == ["src/deep/er/d.py"]
    rows = trees.read_tree(spark, root, ["py"], begins="src/deep")
    assert [r.path for r in rows.collect()] == ["src/deep/er/d.py"] and rows.rdd.getNumPartitions() < trees.read_tree(spark, root, ["py"]).rdd.getNumPartitions()


def test_filters_of_one_query_leave_the_next_alone(spark, root):
    rows = trees.read_tree(spark, root, ["py"])
    assert rows.filter("path = 'a.py'").count() == 1 and rows.count() == len(wanted([])) and rows.filter("path = 'src/c.py'").count() == 1


def test_a_folder_without_files(spark, tmp_path):
    assert trees.read_tree(spark, str(tmp_path), ["py"]).count() == 0
    assert os.listdir(tmp_path) == []


def test_months_are_pruned(spark, tmp_path):
    for month in ("2024-01", "2024-02"):
        (tmp_path / f"l/period={month}").mkdir(parents=True)
        (tmp_path / f"l/period={month}/a.json").write_text('{"seq": 1}\nbroken\n')
    rows = files.monthly_ledger(spark, str(tmp_path / "l"), "seq long, period string", "2024-02")
    assert rows.count() == 1 and "PartitionFilters: [isnotnull(period" in rows._jdf.queryExecution().executedPlan().toString()
