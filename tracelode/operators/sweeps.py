"""Range joins along time as one sweep over a session: rows of both kinds in one order, the open interval carried on.

A sweep shuffles and sorts the rows once and is linear in a session, where a join on the session is one side times the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inside_rounds(responses: DataFrame, rounds: DataFrame) -> DataFrame:
    """Every round with the responses that came in it (turn <= t < next_turn), one row each; a round without any has one row without a response.

    responses: session, turn, text; rounds: session, rn, turn, next_turn (the turn of the round after it, null for the last), text."""
    q = rounds.select("session", F.col("turn").alias("at"), F.struct("rn", "turn", "next_turn", F.col("text").alias("query")).alias("q"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("string").alias("text"))
    r = responses.select("session", F.col("turn").alias("at"), F.lit(None).cast(q.schema["q"].dataType).alias("q"), F.col("turn").alias("t"), "text")
    order = Window.partitionBy("session").orderBy("at", F.col("q").isNull(), "q.rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = q.unionByName(r).withColumn("open", F.last("q", ignorenulls=True).over(order)).withColumn("own", F.col("q").isNotNull())
    rows = rows.filter(F.col("own") | F.col("open.next_turn").isNull() & F.col("open").isNotNull() | (F.col("at") < F.col("open.next_turn")))
    answered = F.count(F.when(~F.col("own"), 1)).over(Window.partitionBy("session", "open.rn")) > 0
    rows = rows.withColumn("answered", answered).filter("NOT own OR NOT answered")
    return rows.select("session", "open.rn", "open.turn", "open.next_turn", "open.query", "t", "text")
