"""The store: a graph is a set of tables, kept as immutable snapshots.

A table is a list of Parquet folders.  A snapshot is a manifest ``CURRENT/<number>`` that
names the folders of each table; it is put in place by a rename that refuses to overwrite,
after all folders are written.  Readers take the highest manifest, so they never see half a
snapshot, and a writer never touches what is being read.  The next snapshot carries the
folders of tables that did not change, adds one for rows that were only appended, and
writes a table anew only where rows were changed or removed.

The rename needs a file system whose rename does not replace files (HDFS, local disks).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.durable import new_path
from weftgraph.schema import TABLES

#: Folders of a table from which on the next change writes it as one.
MOST_FOLDERS = 32


@dataclass(frozen=True)
class Stored:
    """What of a table is written: its folders, and the table they hold."""

    folders: tuple[str, ...]
    rows: DataFrame


@dataclass(frozen=True)
class Graph:
    """Tables by name; operators take a graph and return another.

    ``stored`` has the tables that are written as they are or but for rows in ``added``;
    ``home`` is the folder that :meth:`settled` writes to.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stored: dict[str, Stored] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)
    home: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.createDataFrame([], TABLES[name])

    def with_tables(self, **tables: DataFrame) -> Graph:
        """A graph with some tables replaced, brought to their schema by column name.  A table that is the present one stays."""
        fit = {n: conform(df, n) for n, df in tables.items() if df is not self.tables.get(n)}
        rest = lambda d: {n: x for n, x in d.items() if n not in fit}
        return replace(self, tables={**self.tables, **fit}, stored=rest(self.stored), added=rest(self.added))

    def append(self, name: str, rows: DataFrame) -> Graph:
        """A graph with rows added to a table."""
        new = conform(rows, name)
        before = self.added.get(name)
        return replace(self, tables={**self.tables, name: self[name].unionByName(new)}, added={**self.added, name: new if before is None else before.unionByName(new)})

    def settled(self) -> Graph:
        """The graph with everything written that is not, so that later steps do not repeat earlier ones.

        Of tables that only grew, the new rows are written.
        """
        home = self.home or new_path(self.spark, "graph")
        tables, stored = dict(self.tables), dict(self.stored)
        for name in self.tables:
            old, more = self.stored.get(name), self.added.get(name)
            if old is not None and more is None:
                continue
            grow = old is not None and len(old.folders) < MOST_FOLDERS
            folder = f"{home}/data/{name}-{uuid.uuid4().hex}"
            rows = conform(more if grow else self.tables[name], name)
            (rows.sortWithinPartitions("workspace") if "workspace" in rows.columns else rows).write.option("compression", "zstd").parquet(folder)
            folders = (*old.folders, folder) if grow else (folder,)
            tables[name] = read_folders(self.spark, name, folders)
            stored[name] = Stored(folders, tables[name])
        return replace(self, tables=tables, stored=stored, added={}, home=home)


def read_folders(spark: SparkSession, name: str, folders: tuple[str, ...]) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(*folders)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table's schema in order; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


class Store:
    """Snapshots below a root that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.root)).toUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def versions(self) -> list[int]:
        """Numbers of the published snapshots, in order."""
        folder = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self, version: int) -> dict[str, list[str]]:
        """The folders of each table of a snapshot, relative to the root."""
        stream = self._fs.open(self._path(f"{self.root}/CURRENT/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> Graph:
        """The latest snapshot or an earlier one; an empty graph if there is none."""
        have = self.versions()
        if not have:
            return Graph(self.spark, home=self.root)
        names = self.manifest(have[-1] if version is None else version)
        folders = {n: tuple(f"{self.root}/{f}" for f in fs) for n, fs in names.items() if n in TABLES}
        stored = {n: Stored(fs, read_folders(self.spark, n, fs)) for n, fs in folders.items()}
        return Graph(self.spark, {n: s.rows for n, s in stored.items()}, stored, home=self.root)

    def write(self, graph: Graph) -> int:
        """Write what is not yet below the root and publish the next snapshot; fails if another writer took the number."""
        number = (self.versions() or [0])[-1] + 1
        here = f"{self.root}/"
        foreign = {n for n, s in graph.stored.items() if not all(f.startswith(here) for f in s.folders)}
        rest = lambda d: {n: x for n, x in d.items() if n not in foreign}
        graph = replace(graph, stored=rest(graph.stored), added=rest(graph.added), home=self.root).settled()
        names = {n: [f.removeprefix(here) for f in s.folders] for n, s in graph.stored.items()}
        draft = self._path(f"{self.root}/CURRENT/.{number}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(names).encode())
        out.close()
        try:
            self._files.rename(draft, self._path(f"{self.root}/CURRENT/{number}"), self._options)
        except Exception:
            self._fs.delete(draft, False)
            raise
        return number

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the last ``keep`` snapshots and delete the folders that no other names; returns how many.

        Nothing may be writing, as folders of a snapshot to come are named by none.
        """
        have = self.versions()
        used = {f for v in have[-keep:] for fs in self.manifest(v).values() for f in fs}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/CURRENT/{v}"), False)
        data = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in used] if self._fs.exists(data) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
