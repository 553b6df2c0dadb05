"""Intermediate results that outlive the executors that made them.

A result that several later stages read, or that one round of an iteration
hands to the next, is written as a Parquet table into the shared folder that
``spark.checkpoint.dir`` names.  Its lineage ends there: losing an executor
afterwards costs nothing but a read.  Where the setting is missing and Spark runs in
this process only (tests, a laptop) a folder of the machine is used; on a cluster it has
to be set.  An operator marked :func:`kept` leaves its result there and nothing else.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a result, already written and counted, up to which it may be sent to every executor.
#: A row of such results holds a few numbers or one short text: at most some 50 MB.
BROADCAST_ROWS = 500_000

_SETTING = "spark.checkpoint.dir"
#: Tables made by the operator that is running, if it is one that cleans up.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; set for this session only where it was unset."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set(_SETTING, root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str = "step") -> str:
    """A path of the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with the same columns."""
    spark = df.sparkSession
    path = new_path(spark, label)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(label: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make an operator write its result as a durable table and delete those it made on the way."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(*args: object, **how: object) -> DataFrame:
            outer = _MADE.get()
            mine: list[str] = []
            token = _MADE.set(mine)
            try:
                result = durable(operator(*args, **how), label)
            finally:
                _MADE.reset(token)
            for path in mine[:-1]:
                _delete(result.sparkSession, path)
            if outer is not None:
                outer.append(mine[-1])
            return result

        return run

    return wrap


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_durable(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`durable` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        mine = f"/{spark.sparkContext.applicationId}/"
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if mine in folder:
                _delete(spark, folder)


def clear_durable(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that read them cannot be computed any more."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def sized(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most`` rows; else leave the join to shuffle.

    ``df`` should be durable or otherwise cheap, as it is counted unless ``rows`` is given.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df
