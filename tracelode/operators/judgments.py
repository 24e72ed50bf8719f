"""Grades, coupled scores, leaderboards and agreement of graders.

`grades` tables are long: system, task_id, dim (D1 to D5), grade (G, S, B), applicable. A dimension that is not applicable has no score; an applicable dimension
without a grade makes the whole item fail closed: none of its dimensions is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

LEVELS = ("G", "S", "B")
ITEM = ("system", "task_id")


def grade_value(grade: Column) -> Column:
    return F.when(grade == "G", 1.0).when(grade == "S", 0.5).when(grade == "B", 0.0)


def grade_scores(grades: DataFrame) -> DataFrame:
    """Adds `score` to long grades."""
    value = grade_value(F.col("grade"))
    complete = F.min(value.isNotNull() | ~F.col("applicable")).over(Window.partitionBy(*ITEM))
    return grades.withColumn("score", F.when(F.col("applicable") & complete, value))


def mean_of(*cols: str) -> Column:
    """Mean of the columns that are not null; null if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(n, F.lit(0))


def item_scores(scores: DataFrame, *carry: str) -> DataFrame:
    """One row per item. D1 and D2 are coupled: only the smaller counts, or the one that applies."""
    dims = [F.max(F.when(F.col("dim") == f"D{k}", F.col("score"))).alias(f"d{k}") for k in range(1, 6)]
    wide = scores.groupBy(*ITEM, *carry).agg(*dims).withColumn("coupled", F.least("d1", "d2"))
    return wide.select(*ITEM, *carry, "d1", "d2", "d3", "d4", "d5", mean_of("coupled", "d3", "d4", "d5").alias("score"), mean_of("coupled", "d4", "d5").alias("score_without_d3"), mean_of("d1", "d2", "d3", "d4", "d5").alias("raw_mean"))


def recheck(reported: DataFrame, computed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Findings where a reported score differs from the recomputed one, or only one of both is there."""
    names = ("score", "score_without_d3", "raw_mean")
    both = reported.select(*ITEM, *[F.col(n).alias(f"reported_{n}") for n in names]).join(computed.select(*ITEM, *names).hint("merge"), list(ITEM), "full_outer")
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"reported_{n}").alias("reported"), F.col(n).alias("recomputed")) for n in names]
    out = both.select(*ITEM, F.explode(F.array(*rows)).alias("f")).select(*ITEM, "f.*")
    differs = (F.abs(F.col("reported") - F.col("recomputed")) > tolerance) | (F.col("reported").isNull() != F.col("recomputed").isNull())
    return out.filter(differs)


def system_summary(items: DataFrame) -> DataFrame:
    """Counts and means; the overall score divides by the items that have a score."""
    return items.groupBy("system").agg(
        F.count("*").alias("tasks"), F.count("score").alias("n_scored"), (F.count("*") - F.count("score")).alias("n_failed"),
        (100 * F.avg("score")).alias("overall_score"), (100 * F.avg("score_without_d3")).alias("score_without_d3"), (100 * F.avg("raw_mean")).alias("raw_dimension_mean"),
    )


def leaderboard(summary: DataFrame, campaign_order: str = "system") -> DataFrame:
    """Ranks systems, one row each, by overall score; nulls last, ties in campaign order."""
    order = Window.orderBy(F.desc_nulls_last("overall_score"), campaign_order)
    return summary.withColumn("place", F.row_number().over(order))


def category_scores(items: DataFrame, categories: list[str] | None = None) -> DataFrame:
    return items.groupBy("system").pivot("category", categories).agg(100 * F.avg("score"))


def dimension_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("system").pivot("dim", ["D1", "D2", "D3", "D4", "D5"]).agg(100 * F.avg("score"))


def confusion(verdicts: DataFrame) -> DataFrame:
    """Counts of judge grades (columns) by dimension and human grade."""
    return verdicts.groupBy("dim", "human").pivot("judge", list(LEVELS)).agg(F.count(F.lit(1))).na.fill(0)


def alignment(verdicts: DataFrame) -> DataFrame:
    """Agreement of judge and human per dimension and over all (dim null): mean absolute error, exact and within-one-level rates,
    macro F1 over the grades that occur, and quadratic kappa."""
    level = lambda c: (1 - grade_value(F.col(c))) * 2
    cells = verdicts.groupBy("dim", "human", "judge").agg(F.count("*").alias("n")).withColumn("h", level("human")).withColumn("j", level("judge"))
    cells = cells.groupingSets([["dim", "human", "judge", "h", "j"], ["human", "judge", "h", "j"]], "dim", "human", "judge", "h", "j").agg(F.sum("n").alias("n"))
    gap = F.abs(F.col("h") - F.col("j"))
    per_level = []
    for k, g in enumerate(LEVELS):
        at = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
        per_level += [at((F.col("human") == g) & (F.col("judge") == g)).alias(f"tp{k}"), at(F.col("human") == g).alias(f"h{k}"), at(F.col("judge") == g).alias(f"j{k}")]
    agg = cells.groupBy("dim").agg(
        F.sum("n").alias("labels"), (F.sum(gap * F.col("n")) / 2).alias("err"), F.sum(F.when(gap == 0, F.col("n")).otherwise(0)).alias("same"),
        F.sum(F.when(gap <= 1, F.col("n")).otherwise(0)).alias("near"), F.sum(gap * gap * F.col("n")).alias("sq"), *per_level,
    )
    f1 = [F.when(F.col(f"h{k}") + F.col(f"j{k}") > 0, 2 * F.col(f"tp{k}") / (F.col(f"h{k}") + F.col(f"j{k}"))) for k in range(3)]
    seen = sum((x.isNotNull().cast("int") for x in f1), F.lit(0))
    chance = sum((F.col(f"h{a}") * F.col(f"j{b}") * ((a - b) ** 2) for a in range(3) for b in range(3)), F.lit(0)) / F.col("labels")
    return agg.select(
        "dim", "labels", (F.col("err") / F.col("labels")).alias("mae"), (F.col("same") / F.col("labels")).alias("exact"), (F.col("near") / F.col("labels")).alias("within_one"),
        (sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / seen).alias("macro_f1"), F.when(chance != 0, 1 - F.col("sq") / chance).otherwise(1.0).alias("quadratic_kappa"),
    )


def validate_prediction(predictions: DataFrame, grades: DataFrame, spec: DataFrame) -> DataFrame:
    """Per item the ordered list of what is wrong with a prediction: its own task id, its status, and each dimension of the spec whose grade is missing, unknown or given where
    nothing applies. Grades of dimensions that the spec does not have are not looked at.

    predictions: system, task_id, own_task_id (as the prediction names it), status; grades: system, task_id, dim, grade; spec: task_id, dim, applicable."""
    # A task's dimensions and an item's grades meet as lists, so that the joins have a row for each prediction and not for each of its grades.
    asked = spec.groupBy("task_id").agg(F.collect_list(F.struct("dim", "applicable")).alias("asked"))
    given = grades.groupBy(*ITEM).agg(F.collect_list(F.struct("dim", "grade")).alias("given"))
    rows = predictions.join(given.hint("merge"), list(ITEM), "left").join(asked.hint("merge"), "task_id", "left")

    def faults(s):
        def of(grade):
            fault = (
                F.when(s["applicable"] & grade.isNull(), "missing")
                .when(s["applicable"] & ~grade.isin(*LEVELS), "unknown")
                .when(~s["applicable"] & ~grade.eqNullSafe(F.lit("not_applicable")), "not_applicable")
            )
            return F.when(fault.isNotNull(), F.concat_ws(":", s["dim"], fault))

        own = F.transform(F.filter("given", lambda g: g["dim"] == s["dim"]), lambda g: g["grade"])
        return F.transform(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string"))), of)

    errors = F.array_sort(F.array_compact(F.flatten(F.transform("asked", faults))))
    own = F.when(~F.col("own_task_id").eqNullSafe(F.col("task_id")), "task_id")
    status = F.when(~F.col("status").eqNullSafe(F.lit("ok")), "status")
    none = F.array().cast("array<string>")
    return rows.select(*ITEM, F.concat(F.array_compact(F.array(own, status)), F.coalesce(errors, none)).alias("errors"))


def fill_na(grades: DataFrame) -> DataFrame:
    """The canonical grade on dimensions that do not apply, whatever was predicted."""
    return grades.withColumn("grade", F.when(F.col("applicable"), F.col("grade")).otherwise("not_applicable"))


def candidates(predictions: DataFrame, stages: tuple[str, ...] = ("review_1", "first", "review_2")) -> DataFrame:
    """Ordered candidates of items whose predictions of all stages are ok. predictions: system, task_id, stage, status, digest."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    rows = predictions.withColumn("p", place).filter("p > 0")
    per = rows.groupBy(*ITEM).agg(F.count("*").alias("n"), F.min(F.col("status") == "ok").alias("ok"), F.array_sort(F.collect_list(F.struct("p", "stage", "digest"))).alias("c"))
    return per.filter((F.col("n") == len(stages)) & F.col("ok")).select(*ITEM, F.transform("c", lambda c: F.concat_ws("=", c["stage"], c["digest"])).alias("candidates"))


def stage_status(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per stage: ok, failed and missing tasks, and how many remain. expected: stage, task_id; predictions: stage, task_id, status."""
    joined = expected.join(predictions.select("stage", "task_id", F.coalesce("status", F.lit("failed")).alias("status")).hint("merge"), ["stage", "task_id"], "left")
    n = lambda cond: F.count(F.when(cond, 1))
    return joined.groupBy("stage").agg(n(F.col("status") == "ok").alias("ok"), n(F.col("status") != "ok").alias("failed"), n(F.col("status").isNull()).alias("missing")).withColumn("remaining", F.col("failed") + F.col("missing"))


def remaining_tasks(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    return expected.join(predictions.filter("status = 'ok'").hint("merge"), ["stage", "task_id"], "left_anti")


def system_progress(predictions: DataFrame, stages: list[str], expected: int) -> DataFrame:
    """Ok predictions per stage, and whether every stage of a system is complete."""
    wide = predictions.filter("status = 'ok'").groupBy("system").pivot("stage", stages).agg(F.count(F.lit(1))).na.fill(0)
    complete = F.lit(True)
    for s in stages:
        complete = complete & (F.col(s) == expected)
    return wide.withColumn("complete", complete)


def campaign_progress(predictions: DataFrame) -> DataFrame:
    """Predictions and ok ones by system and stage, by system, and over all."""
    n = F.count(F.when(F.col("status") == "ok", 1))
    return predictions.rollup("system", "stage").agg(F.count("*").alias("predictions"), n.alias("ok"))


def batch_summary(predictions: DataFrame) -> DataFrame:
    n = lambda cond: F.count(F.when(cond, 1))
    ok = F.col("status") == "ok"
    return predictions.groupBy("stage").agg(F.count("*").alias("total"), n(ok).alias("ok"), n(~F.coalesce(ok, F.lit(False))).alias("failed"))


def extract_json(text: Column) -> Column:
    """The JSON in a text as a string: the whole text, else a fenced object, else what stands between the outermost braces; else null, as for the JSON null.

    Strict: nothing may follow the value, names and strings are in double quotes. An object that names a key twice counts as no JSON."""

    def ok(t):
        # The parser stops where a value ends. So the value stands in an array before a digest of itself: the digest comes second only if the text is one whole value.
        whole = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]')))
        return F.when(F.try_variant_get(whole, "$[1]", "string") == F.md5(t), t)

    text = trimmed(text)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(F.coalesce(ok(text), ok(fenced), ok(braces)), F.lit("null"))


def stage_input(rows: DataFrame, stage: str, keys: dict[str, list[str]]) -> DataFrame:
    """The persisted input document of a stage, with exactly the keys of that stage in sorted order."""
    return rows.select(*ITEM, F.to_json(F.struct(*sorted(keys[stage])), {"ignoreNullFields": "false"}).alias("document"))
