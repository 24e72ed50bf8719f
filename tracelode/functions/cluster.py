"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may leave that unset and gets a folder of our own; executors of a cluster would not find it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = _own[0]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` without its lineage, by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows of an input that one task of `dealt` takes.
ROWS = 100_000


def shares(table: DataFrame) -> int:
    """Into how many tasks the rows of a table are dealt: as many as ROWS makes of them, so that a task's share does not grow with the table, but no fewer than there are cores."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """`df` by the hash of `keys` in `n` tasks. What follows by these keys (windows, groups, joins with a side dealt alike) stays in them: the shuffle's own partitions go by the
    bytes that are shuffled, which say little of rows that are multiplied, sorted and grouped later on."""
    return df.repartition(n, *keys)
