"""Attempt ledgers: folding claim and finish events, validation, exhaustion.

Attempts are long rows: stage, task, attempt (from 1), status (claimed, response, exception), status_code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("claimed", "response", "exception")


def fold_attempts(events: DataFrame) -> DataFrame:
    """One row per attempt from claim and finish events, with what is wrong with its events. events: task, request, kind (claim, finish), seq, status."""
    per = events.groupBy("task", "request").agg(
        F.min(F.when(F.col("kind") == "claim", F.col("seq"))).alias("claimed_seq"), F.count_if(F.col("kind") == "finish").alias("finishes"),
        F.max_by("status", F.when(F.col("kind") == "finish", F.col("seq"))).alias("finished_status"),
    )
    number = F.row_number().over(Window.partitionBy("task").orderBy(F.asc_nulls_last("claimed_seq"), "request"))
    problem = F.when(F.col("claimed_seq").isNull(), "finish_without_claim").when(F.col("finishes") > 1, "finished_twice")
    return per.select("task", "request", number.alias("attempt"), F.coalesce("finished_status", F.lit("claimed")).alias("status"), problem.alias("error"))


def validate_ledger(attempts: DataFrame, budget: int) -> DataFrame:
    """Findings per task: over budget, numbers not 1..n, status not allowed."""
    per = attempts.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("attempt").alias("d"), F.min("attempt").alias("lo"), F.max("attempt").alias("hi"), F.count_if(~F.col("status").isin(*STATUSES)).alias("strange"))
    rules = [F.when(F.col("n") > budget, "over_budget"), F.when((F.col("d") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "sequence"), F.when(F.col("strange") > 0, "status")]
    return per.select("task", F.explode(F.array_compact(F.array(*rules))).alias("reason"))


def final_ok(attempts: DataFrame, budget: int) -> DataFrame:
    """Whether a task ended well: 1 to budget attempts, the last one a response with code 200."""
    last = F.max_by(F.struct("status", "status_code"), "attempt").alias("last")
    per = attempts.groupBy("stage", "task").agg(F.count(F.lit(1)).alias("attempts"), last)
    return per.select("stage", "task", "attempts", ((F.col("attempts") <= budget) & (F.col("last.status") == "response") & (F.col("last.status_code") == 200)).alias("ok"))


def exhausted(attempts: DataFrame, budget: int) -> DataFrame:
    """Tasks that used up their budget without ending well."""
    return final_ok(attempts, budget).filter(~F.col("ok") & (F.col("attempts") >= budget)).select("stage", "task", "attempts")


#: What an error says, in lower case, if the credentials were refused.
AUTH_MARKERS = ("http 401", "unauthenticated", "api key无效", "invalid api key", "api key invalid")


def auth_failed(text: Column) -> Column:
    """Whether an error holds one of the markers, in any case."""
    hit = F.lit(False)
    for marker in AUTH_MARKERS:
        hit = hit | F.lower(F.coalesce(text, F.lit(""))).contains(marker)
    return hit


def check_seal(headers: DataFrame, seals: DataFrame, fields: list[str]) -> DataFrame:
    """Ledgers whose identity hash or external seal does not agree with their contents. headers: ledger, identity_sha256, fields; seals: ledger, seal_sha256."""
    from .rubric import canonical_hash

    rows = headers.withColumn("computed", canonical_hash(*fields)).join(seals, "ledger", "left")
    reason = F.when(F.col("identity_sha256") != F.col("computed"), "identity").when(F.col("seal_sha256").isNull(), "no_seal").when(F.col("seal_sha256") != F.col("computed"), "seal")
    return rows.select("ledger", reason.alias("reason")).filter("reason IS NOT NULL")


def task_of_request(requests: DataFrame, marker: str) -> DataFrame:
    """Task id from the JSON behind a marker in the user text. requests: id, user_text."""
    document = F.substring_index("user_text", marker, -1)
    return requests.select("id", F.when(F.col("user_text").contains(marker), F.get_json_object(F.trim(document), "$.task_id")).alias("task_id"))
