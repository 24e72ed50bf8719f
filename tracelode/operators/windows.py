"""Time windows of frames and of task passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATEST_S, LONGEST_S = 86_400.0, 3_600.0
_NUMBER, _NEGATIVE = r"\d+(?:\.\d+)?", r"^\s*-\s*\d|\d\s*-\s*-\s*\d"


def frame_window(text: Column, frame_s: Column) -> Column:
    """The first number of a text, and the second or else `frame_s` later, as a struct of start_s, end_s and error. A text without numbers, or null, is no window and no error.
    Windows are within a day and an hour long at most; they may be empty."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))
    a = F.get(numbers, 0)
    b = F.coalesce(F.get(numbers, 1), a + frame_s)
    error = (
        F.when(text.rlike(_NEGATIVE), "negative").when(a.isNull(), None).when((a == float("inf")) | (b == float("inf")), "not_finite")
        .when(b < a, "reversed").when(b > LATEST_S, "too_late").when(b - a > LONGEST_S, "too_long")
    )
    return F.struct(F.when(error.isNull(), a).alias("start_s"), F.when(error.isNull(), b).alias("end_s"), error.alias("error"))


def resolve_windows(frames: DataFrame, frame_s: float, default_index: int = 0) -> DataFrame:
    """The window of every frame: the one that is listed for it; else, if the list has one entry only, that many frames after its start; else by place from `default_index` on.
    A list with an entry in error is refused: no frame of its session has a window, and all have the first error.
    `in_order` is false where a frame starts before the one ahead. frames: session, seq, window (text), listed (entries in the session's list)."""
    w = Window.partitionBy("session")
    rows = frames.withColumn("place", F.row_number().over(w.orderBy("seq")) - 1).withColumn("w", frame_window(F.col("window"), F.lit(frame_s)))
    rows = rows.withColumn("refused", F.min(F.when(F.col("w.error").isNotNull(), F.struct("place", "w.error"))).over(w)["error"])
    rows = rows.withColumn("base", F.max(F.when(F.col("place") == 0, F.col("w.start_s"))).over(w))
    single = (F.col("listed") == 1) & (F.col("place") > 0)
    start = F.coalesce("w.start_s", F.when(single, F.col("base") + F.col("place") * frame_s), (F.col("place") + default_index) * F.lit(frame_s))
    rows = rows.withColumn("start_s", F.when(F.col("refused").isNull(), start)).withColumn("end_s", F.when(F.col("refused").isNull(), F.coalesce("w.end_s", F.col("start_s") + frame_s)))
    rows = rows.withColumn("in_order", F.coalesce(F.col("start_s") >= F.lag("start_s").over(w.orderBy("seq")), F.lit(True)))
    return rows.withColumn("error", F.col("refused")).drop("place", "base", "w", "refused")


def wall_window(passes: DataFrame, most_s: float, now: Column) -> DataFrame:
    """Deadline, time left and whether it is over, for passes of a task; a start that is unknown or in the future is now. passes: started."""
    start = F.when(F.col("started") <= now, F.col("started")).otherwise(now)
    left = F.lit(most_s) - (F.unix_micros(now) - F.unix_micros(start)) / 1e6
    return passes.withColumn("deadline", F.timestamp_micros((F.unix_micros(start) + F.lit(most_s) * 1_000_000).cast("long"))).withColumn("remaining_s", F.greatest(F.lit(0.0), left)).withColumn("expired", left <= 0)
