"""Source trees as a data source of their own: folders are listed by the tasks, and what isn't asked for isn't listed.

``spark.read.format("sourcetree")`` takes the options ``extensions`` and ``excludes`` (comma-separated, globs for the
second), ``begins`` (what paths begin with) and ``parts``.  The driver lists folders level by level until there are enough of them for ``parts`` tasks; each
task walks its own.  A folder under which every path is excluded, or none begins as asked, isn't listed, and files that aren't
asked for aren't opened.  These are options and no filters that Spark pushes: with 4.1 a filter once pushed into a Python
source stays in it, so another query over the same DataFrame would lose rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tree_source():
    """The data source class.  It is made in a function so that tasks get it by value and need no installed package."""
    import fnmatch

    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, folders, files):
            super().__init__(0)
            self.folders, self.files = folders, files

    class Reader(DataSourceReader):
        BATCH = 16_000_000

        def __init__(self, options):
            self.root = options["path"].rstrip("/")
            listed = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
            self.extensions = {x.lstrip(".") for x in listed("extensions")}
            self.excludes, self.parts = listed("excludes"), int(options.get("parts", "64"))
            self.begins = options.get("begins", "")

        def system(self):
            if "://" in self.root or self.root.startswith("file:"):
                return fs.FileSystem.from_uri(self.root)
            return fs.LocalFileSystem(), self.root

        def entries(self, system, base, folder):
            """Names of the folders and the files right in a folder, and nothing below."""
            found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
            under = lambda kind: sorted((f"{folder}/{x.base_name}" if folder else x.base_name) for x in found if x.type == kind)
            return [x for x in under(fs.FileType.Directory) if self.enters(x)], [x for x in under(fs.FileType.File) if self.takes(x)]

        def enters(self, folder):
            """Whether some path below a folder may be wanted: a glob with a star at its end that matches the folder matches all below."""
            if any(p.endswith("*") and (fnmatch.fnmatchcase(folder + "/", p) or fnmatch.fnmatchcase("/" + folder + "/", p)) for p in self.excludes):
                return False
            inside = folder + "/"
            return inside.startswith(self.begins) or self.begins.startswith(inside)

        def takes(self, path):
            dot = path.rsplit("/", 1)[-1].rfind(".")
            kind = path.rsplit(".", 1)[-1] if dot >= 0 else ""
            return kind in self.extensions and path.startswith(self.begins) and not any(fnmatch.fnmatchcase(path, p) or fnmatch.fnmatchcase("/" + path, p) for p in self.excludes)

        def partitions(self):
            system, base = self.system()
            folders, files = [""], []
            while folders and len(folders) < self.parts:
                below = []
                for folder in folders:
                    more, here = self.entries(system, base, folder)
                    below += more
                    files += here
                folders = below
            n = max(1, min(self.parts, len(folders) + len(files)))
            return [Part(folders[i::n], files[i::n]) for i in range(n)]

        def paths(self, system, base, part):
            yield from part.files
            todo = list(part.folders)
            while todo:
                more, here = self.entries(system, base, todo.pop())
                todo += more
                yield from here

        def read(self, part):
            system, base = self.system()
            rows, size = [], 0
            for path in self.paths(system, base, part):
                with system.open_input_stream(f"{base}/{path}") as f:
                    text = f.read().decode("utf-8", "replace")
                rows.append((path, path.rsplit(".", 1)[-1], text))
                size += len(text)
                if size > self.BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

        @staticmethod
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "ext", "text"])

    class Tree(DataSource):
        @classmethod
        def name(cls):
            return "sourcetree"

        def schema(self):
            return "path string, ext string, text string"

        def reader(self, schema):
            return Reader(self.options)

    return Tree


def read_tree(spark: SparkSession, root: str, extensions: list[str], excludes: list[str] | None = None, begins: str = "", parts: int = 64) -> DataFrame:
    """path, ext and text of the files under a root that have one of the extensions, begin as asked and aren't excluded (SRC-1, SRC-2)."""
    spark.dataSource.register(tree_source())
    options = {"extensions": ",".join(extensions), "excludes": ",".join(excludes or []), "begins": begins, "parts": parts}
    return spark.read.format("sourcetree").options(**options).load(root)
