"""Processing only what was added or changed since the last successful run.

* The runs that succeeded form a commit sequence: they are numbered by ``finished_at`` and
  ``run_id``.  A failed or running run is not in it, so it never hides work.  A run gets its
  time when it lands, so later ones get larger numbers; if one turns up below the
  watermark all the same, the numbers shift, which a step notices and begins anew.
* :func:`step` is one bounded step.  The highest number there is when it starts is its upper
  limit; runs that land later belong to the next step.  Only what runs between the
  watermark and the limit recorded is read and folded into the state of earlier steps, and
  artifacts are compared with that state.
* :class:`IncrementalSink` publishes: state, output and watermark go to a folder of their
  own, and one manifest, put in place by a rename that refuses to overwrite, makes all
  of them visible at once.  A step that dies leaves nothing behind that is ever read.

The rename needs a file system whose rename does not replace files (HDFS, local disks).  On
an object store without one, put the ``commits`` folder on such a file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.paths import same_path
from weftgraph.plans.durable import durable, sized


def current_versions(artifacts: DataFrame) -> DataFrame:
    """One row per artifact id: its row with the latest ``ingested_at``.

    Repeats collapse.  Rows of one id with the same time are told apart by the larger
    sha, path and workspace (a null is the smallest), and a null time is the earliest.
    Rows without an id are no artifacts.
    """
    order = F.struct("ingested_at", "sha", "path", "workspace")
    return (
        artifacts.where("id is not null")
        .groupBy(F.col("id").alias("artifact_id"))
        .agg(F.max(order).alias("_v"))
        .select("artifact_id", F.col("_v.workspace").alias("workspace"), F.col("_v.path").alias("path"), F.col("_v.sha").alias("sha"), F.col("_v.ingested_at").alias("ingested_at"))
    )


def commit_sequence(runs: DataFrame, upper: object | None = None) -> DataFrame:
    """``run_id, seq`` of the runs that count, numbered from 1 by time and id (a run without a time comes first).

    ``upper`` is the last ``finished_at`` to be seen.  There is one row per run, not per
    record, so the numbering may be one task's.
    """
    ok = runs.where("status = 'ok' and run_id is not null")
    if upper is not None:
        ok = ok.where(F.col("finished_at") <= F.lit(upper))
    once = ok.groupBy("run_id").agg(F.max("finished_at").alias("at"))
    return once.select("run_id", F.row_number().over(Window.orderBy("at", "run_id")).cast("long").alias("seq"))


def handled(run_items: DataFrame, commits: DataFrame) -> DataFrame:
    """For each workspace, path and sha (lower case) the last of the commits (``run_id, seq``) that recorded it, as ``seq``.

    Items of other runs are dropped.  The aggregation is partial
    before the shuffle and keyed by sha too, so a path written a billion times is
    neither one task's nor one row's burden.
    """
    return (
        run_items.join(sized(commits), "run_id")
        .groupBy("workspace", same_path(F.col("path")).alias("path"), F.lower("sha").alias("sha"))
        .agg(F.max("seq").alias("seq"))
    )


def latest(seen: DataFrame) -> DataFrame:
    """The rows of :func:`handled` that belong to the last commit of their path; what a path had before counts no more."""
    last = seen.groupBy("workspace", "path").agg(F.max("seq").alias("seq"))
    same = seen["workspace"].eqNullSafe(last["workspace"]) & seen["path"].eqNullSafe(last["path"]) & (seen["seq"] == last["seq"])
    return seen.join(last, same, "left_semi")


def judge(artifacts: DataFrame, state: DataFrame) -> DataFrame:
    """``artifact_id, workspace, path, sha, ingested_at, reason`` of the artifacts that a state (:func:`latest`) does not cover.

    reason is ``new`` (no committed run has the path), ``no_sha`` (the current sha is
    null, so nothing can show that it was handled) or ``changed`` (the last commit that
    has the path does not hold the current sha).  Case of sha is ignored; a null sha in
    the state matches none; a null path or workspace matches no run and is ``new``.
    """
    now = current_versions(artifacts).withColumn("_path", same_path(F.col("path"))).withColumn("_sha", F.lower("sha"))
    # one row per path: has it been handled, and with which shas (those of one commit)
    known = state.select(F.col("workspace").alias("w1"), F.col("path").alias("p1"), F.lit(True).alias("known")).distinct()
    by_sha = state.where("sha is not null").select(F.col("workspace").alias("w2"), F.col("path").alias("p2"), F.col("sha").alias("s2"), F.lit(True).alias("held"))
    joined = now.join(known, (F.col("workspace") == F.col("w1")) & (F.col("_path") == F.col("p1")), "left").join(
        by_sha, (F.col("workspace") == F.col("w2")) & (F.col("_path") == F.col("p2")) & (F.col("_sha") == F.col("s2")), "left"
    )
    reason = F.when(F.col("known").isNull(), "new").when(F.col("_sha").isNull(), "no_sha").when(F.col("held").isNull(), "changed")
    return joined.withColumn("reason", reason).where("reason is not null").select("artifact_id", "workspace", "path", "sha", "ingested_at", "reason")


def pending(artifacts: DataFrame, run_items: DataFrame, runs: DataFrame, upper: object | None = None) -> DataFrame:
    """:func:`judge` against all runs up to ``upper`` at once, without a sink."""
    return judge(artifacts, latest(handled(run_items, commit_sequence(runs, upper))))


@dataclass(frozen=True)
class Commit:
    """One published step: what has ``low < sequence <= high`` is in ``folder``.  ``last`` names the record at ``high``.

    A ``base`` holds everything before it too.
    """

    number: int
    low: int | None
    high: int
    folder: str
    last: int | None = None
    base: bool = False


class IncrementalSink:
    """Exactly-once steps over something with a monotonic sequence.

    ``root`` holds ``data/<step>/<table>`` folders and ``commits/<number>.json`` manifests.  A
    folder without a manifest is a step that died; it is never read and its range is done
    again by the next one.  Two steps that race for a number cannot both commit: the
    rename of the second fails, and its rows stay invisible.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(self.root)
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def commits(self, most: int | None = None) -> list[Commit]:
        """Published steps in order, from the last base on, or the last ``most`` of them; only their manifests are read."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        found: list[Commit] = []
        for name in reversed(names if most is None else names[-most:]):
            found.append(Commit(**json.loads(self._read(f"{self.root}/commits/{name}"))))
            if found[-1].base:
                break
        return found[::-1]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def last(self) -> Commit | None:
        """The latest step."""
        return (self.commits(1) or [None])[0]

    def watermark(self) -> int | None:
        """Highest sequence number that is published; None before the first step."""
        done = self.last()
        return done.high if done else None

    def publish(self, low: int | None, high: int, work: Callable[[Callable[[str, DataFrame], DataFrame]], None], after: Commit | None, last: int | None = None, base: bool = False) -> Commit:
        """Let ``work`` write tables (it is given ``write(name, df)``, which returns what was written), then publish them with the watermark ``high``.

        ``after`` is the step this one builds on; if another was published in between, this one fails.
        """
        number = after.number + 1 if after else 1
        folder = f"{self.root}/data/{number:08d}-{uuid.uuid4().hex}"

        def write(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        work(write)
        commit = Commit(number, low, high, folder, last, base)
        final = self._path(f"{self.root}/commits/{number:08d}.json")
        draft = self._path(f"{self.root}/commits/.{number:08d}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(asdict(commit)).encode())
        out.close()
        try:
            self._files.rename(draft, final, self._options)
        except Exception:
            self._fs.delete(draft, False)
            raise
        return commit

    def run(self, source: DataFrame, sequence: str, work: Callable[[DataFrame], DataFrame], upper: int | None = None) -> Commit | None:
        """Process rows above the watermark and at most ``upper`` (default: the highest there is now).

        Returns the commit, or None if there is nothing new.  Rows whose sequence is null
        were never committed by their producer and are left out.
        """
        done = self.last()
        low = done.high if done else None
        new = source.where(F.col(sequence).isNotNull())
        if low is not None:
            new = new.where(F.col(sequence) > F.lit(low))
        if upper is None:
            upper = new.agg(F.max(sequence)).first()[0]
        if upper is None or (low is not None and upper <= low):
            return None
        rows = work(new.where(F.col(sequence) <= F.lit(upper)))
        return self.publish(low, upper, lambda write: write("rows", rows), done)

    def compact(self) -> Commit | None:
        """Publish all rows of :meth:`run` as one step, so that readers open one folder again."""
        rows, done = self.read(), self.last()
        return None if rows is None else self.publish(None, done.high, lambda write: write("rows", rows), done, done.last, base=True)

    def read(self) -> DataFrame | None:
        """All published rows of :meth:`run`, or None before the first commit."""
        folders = [f"{c.folder}/rows" for c in self.commits()]
        return self.spark.read.parquet(*folders) if folders else None

    def table(self, name: str) -> DataFrame | None:
        """A table of the latest step, or None before the first."""
        done = self.last()
        return self.spark.read.parquet(f"{done.folder}/{name}") if done else None


def step(sink: IncrementalSink, artifacts: DataFrame, run_items: DataFrame, runs: DataFrame, upper: object | None = None) -> DataFrame:
    """Publish what the next run has to ingest, with the state it follows from and the watermark; returns it as published.

    ``upper`` is the last ``finished_at`` to be seen, by default that of the last run there is when the step starts.
    Only items of runs above the watermark are read.  Published tables are ``state`` (:func:`latest`) and ``pending`` (:func:`judge`).
    """
    commits = durable(commit_sequence(runs, upper), "commits")
    top = commits.agg(F.max(F.struct("seq", "run_id"))).first()[0]
    high, last = (top.seq, top.run_id) if top else (0, None)
    done = sink.last()
    low = done.high if done else 0
    if low and commits.where((F.col("seq") == low) & (F.col("run_id") == F.lit(done.last))).isEmpty():
        low = 0  # the numbers have shifted: fold everything again
    seen = handled(run_items, commits.where((F.col("seq") > low) & (F.col("seq") <= high)))
    if low:
        seen = seen.unionByName(sink.table("state")).groupBy("workspace", "path", "sha").agg(F.max("seq").alias("seq"))

    def work(write: Callable[[str, DataFrame], DataFrame]) -> None:
        write("pending", judge(artifacts, write("state", latest(seen))))

    sink.publish(low, high, work, done, last)
    return sink.table("pending")
