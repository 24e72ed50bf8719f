"""Folds over the rows of a session in log order that come to an end, and late rows on a side table.

Rows wait in the state until the watermark has passed them. A timer then takes them out in log order, so rows that come out of order within the lateness
are folded as the batch form folds them. Another timer closes a session that has been idle for long enough; what the fold still holds is given out then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def _plain(column: pd.Series, kind: T.DataType) -> list:
    """Values as Spark's state takes them: null is None, whole numbers that pandas made fractions are whole again."""
    whole = isinstance(kind, T.IntegralType)
    return [None if x is None or x != x else int(x) if whole else x for x in column.tolist()]


class OrderedFold(StatefulProcessor):
    """step(key, state, rows) -> (state, results); finish(key, state) -> results, once after the last row of a key."""

    def __init__(self, fields: T.StructType, names: list[str], step: Callable, finish: Callable, state: str, empty: tuple, idle_ms: int):
        self.fields, self.names, self.step, self.finish, self.state, self.empty, self.idle_ms = fields, names, step, finish, state, empty, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([*self.fields.fields, T.StructField("ts_ms", T.LongType())]))
        self.kept = handle.getValueState("kept", f"{self.state}, latest_ms long")

    def _out(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names)

    def _wake(self, ts_ms: int) -> None:
        # One later: a timer is due when the watermark is beyond it, and rows at the watermark may still come.
        self.handle.registerTimer(ts_ms + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            columns = [_plain(pdf[f.name], f.dataType) for f in self.fields]
            new += list(zip(*columns, [int(t.timestamp() * 1000) for t in pdf["ts"]]))
        self.waiting.appendList(new)
        *state, latest = self.kept.get() if self.kept.exists() else (*self.empty, 0)
        latest = max(latest, *(r[-1] for r in new))
        self.kept.update((*state, latest))
        self._wake(min(r[-1] for r in new))
        self._wake(latest + self.idle_ms)
        yield self._out([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()]
        due = [r for r in waiting if r[-1] < now]
        rest = [r for r in waiting if r[-1] >= now]
        *state, latest = self.kept.get() if self.kept.exists() else (*self.empty, None)
        state, out = tuple(state), []
        if due:
            names = [f.name for f in self.fields]
            pdf = pd.DataFrame([r[:-1] for r in due], columns=names, dtype=object).sort_values("seq", key=lambda c: c.astype("int64"))
            state, out = self.step(key, state, pdf)
            self.kept.update((*state, latest))
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[-1] for r in rest))
        elif due:
            self.waiting.clear()
        if not rest and latest is not None and latest + self.idle_ms < now:
            out = [*out, *self.finish(key, state)]
            self.kept.clear()
        if out:
            yield self._out(out)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, keys: list[str], columns: list[str], step: Callable, result: str, state: str, empty: tuple, lateness: str, idle: str, finish: Callable = lambda key, state: []) -> DataFrame:
    """The fold over the rows of each key, in the order of seq among rows whose event time (ts) the watermark has passed. Rows of one session should agree in the order of ts and seq.

    A key ends once the watermark is `idle` beyond its last row. Timers and lists in the state need the RocksDB store, which is set where the session has the default."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, ROCKSDB)
    fields = T.StructType([stream.schema[c] for c in columns])
    names = [x.strip().split(" ")[0] for x in result.split(",")]
    fold = OrderedFold(fields, names, step, finish, state, empty, _milliseconds(idle))
    rows = stream.select(*dict.fromkeys([*keys, *columns, "ts"])).withWatermark("ts", lateness).groupBy(*keys)
    return rows.transformWithStateInPandas(fold, result, "append", "EventTime")


def divide_late(root: str, lateness: str) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: every row of the stream goes to one of two tables below `root`, those on time and those older than the watermark.

    The watermark of a batch is the latest event time of all batches before it less `lateness`, as in a query with that watermark; such a query drops no row that is on time here. Each batch owns a folder that a replay writes
    anew, and reads only the folders of earlier batches, so a replay adds nothing and decides alike. Rows without an event time are late."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = divided(spark, root)
        latest = None if seen is None else seen.filter(F.col("batch") < number).agg(F.max("ts")).first()[0]
        if latest is None:
            late = F.col("ts").isNull()
        else:
            late = F.coalesce(F.col("ts") < F.lit(latest) - F.expr(f"INTERVAL {lateness}"), F.lit(True))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{root}/batch={number}")

    return write


def divided(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows that `divide_late` has written, with `late` and `batch`; None before the first. Latest times come from the files' statistics."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/late=*")):
        return None
    return spark.read.option("basePath", root).parquet(f"{root}/batch=*").withColumn("late", F.col("late").cast("boolean"))


def on_time(spark: SparkSession, root: str) -> DataFrame:
    return divided(spark, root).filter("NOT late").drop("late", "batch")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The late rows with the number of the batch that brought them."""
    return divided(spark, root).filter("late").drop("late")
