"""Rubrics: anchors per task and dimension, and the issues that block a formal run.

Wide rows carry applicable_k, threshold_k and weight_k; the long form is task_id, dim, applicable, threshold, weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import clean_cell

DIMS = ("D1", "D2", "D3", "D4", "D5")


def rubric_long(wide: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(f"D{k}").alias("dim"), (F.coalesce(clean_cell(F.col(f"applicable_{k}")), F.lit("")) == "是").alias("applicable"), F.coalesce(clean_cell(F.col(f"threshold_{k}")), F.lit("-")).alias("threshold"), F.col(f"weight_{k}").cast("double").alias("weight")) for k in range(1, 6)]
    return wide.select("task_id", F.explode(F.array(*rows)).alias("r")).select("task_id", "r.*")


def normalize_threshold(text: Column) -> Column:
    """Grade marks F and P of an anchor text become S and B; a mark stands outside words and before a space, colon, 档 or a comparison."""
    t = clean_cell(text)
    for mark, grade in (("[Ff]", "S"), ("[Pp]", "B")):
        t = F.regexp_replace(t, rf"(?<![A-Za-z0-9]){mark}(?=(?U:\s)|[:：档≤≥<>±])", grade)
    return t


def rubric_dimensions(cells: DataFrame) -> DataFrame:
    """Canonical name of each dimension, the first line of its first cell, and how many cells name it. cells: row, text, declared."""
    head = F.regexp_extract(F.coalesce(clean_cell(F.col("text")), F.lit("")), r"(?is)^(D[1-5])\s*[.．、]?\s*(.*)$", 1)
    rest = F.regexp_extract(F.coalesce(clean_cell(F.col("text")), F.lit("")), r"(?is)^(D[1-5])\s*[.．、]?\s*(.*)$", 2)
    rows = cells.select("row", "declared", F.upper(head).alias("dim"), F.trim(F.split(rest, "\n").getItem(0)).alias("name"))
    found = rows.filter("dim != ''").groupBy("dim").agg(F.min_by("name", "row").alias("name"), F.min_by("declared", "row").alias("declared"), F.count(F.lit(1)).alias("times"))
    every = cells.sparkSession.range(1, 6).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("dim"))
    return every.join(found, "dim", "left").select("dim", "name", "declared", F.when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate").otherwise("ok").alias("status"))


def headerless_cells(rows: DataFrame) -> DataFrame:
    """Values under an empty header. rows: row, headers ARRAY<STRING>, cells ARRAY<STRING>."""
    out = rows.select("row", "headers", F.posexplode("cells").alias("column", "value"))
    header = F.get("headers", F.col("column"))
    return out.filter((F.coalesce(F.trim(header), F.lit("")) == "") & (F.coalesce(F.trim("value"), F.lit("")) != "")).select("row", "column", "value")


def missing_fields(tasks: DataFrame, fields: list[str]) -> DataFrame:
    rows = [F.when(clean_cell(F.col(f).cast("string")).isNull(), f) for f in fields]
    return tasks.select("task_id", F.explode(F.array_compact(F.array(*rows))).alias("field"))


def _applies() -> Column:
    return F.col("applicable")


def missing_rule(long: DataFrame) -> DataFrame:
    return long.filter(_applies() & (F.col("threshold") == "-")).select("task_id", "dim")


def missing_weight(long: DataFrame) -> DataFrame:
    """Applicable dimensions without a weight in tasks that have some."""
    some = F.max(F.col("weight").isNotNull() & _applies()).over(Window.partitionBy("task_id"))
    return long.withColumn("some", some).filter(F.col("some") & _applies() & F.col("weight").isNull()).select("task_id", "dim")


def rule_on_na(long: DataFrame) -> DataFrame:
    return long.filter(~_applies() & (F.col("weight").isNotNull() | (F.col("threshold") != "-"))).select("task_id", "dim")


def weight_sum(long: DataFrame) -> DataFrame:
    """Tasks with weights whose applicable weights do not sum to 1."""
    per = long.filter(_applies()).groupBy("task_id").agg(F.sum("weight").alias("total"))
    return per.filter(F.col("total").isNotNull() & (F.abs(F.col("total") - 1) > 1e-9))


#: Where a duration can be read, field by field.
DURATIONS = {
    "scene": (r"[-—]\s*(\d+)\s*(?:秒|s)", r"(\d+)\s*(?:秒|s)\s*[-—]"),
    "expected_response_window": (r"R1\s*后(?:的)?\s*(\d+)\s*(?:秒|s)",),
    "expected_key_information": (r"时间到\s*/\s*(\d+)\s*(?:秒|s)\s*结束",),
    "d5_threshold": (r"t0\s*\+\s*(\d+)\s*(?:秒|s)",),
}
DEADLINE = r"限时\s*(\d+)\s*(?:秒|s)"


def duration_conflict(tasks: DataFrame) -> DataFrame:
    """Tasks with a deadline in the prompt and another duration elsewhere, as a map of what differs."""
    number = lambda f, p: F.nullif(F.regexp_extract(F.coalesce(f, F.lit("")), p, 1), F.lit("")).cast("int")
    limit = number("user_prompt", DEADLINE)
    found = F.map_from_arrays(F.array(*map(F.lit, DURATIONS)), F.array(*[F.coalesce(*[number(f, p) for p in ps]) for f, ps in DURATIONS.items()]))
    out = tasks.select("task_id", limit.alias("deadline"), F.map_filter(found, lambda k, v: v.isNotNull() & (v != limit)).alias("conflicts"))
    return out.filter(F.col("deadline").isNotNull() & (F.size("conflicts") > 0))


def applicable_counts(declared: DataFrame, long: DataFrame) -> DataFrame:
    """Declared against actual numbers of applicable items. declared: dim, declared."""
    actual = long.groupBy("dim").agg(F.count_if("applicable").alias("actual"))
    return declared.join(actual.hint("merge"), "dim", "left").select("dim", "declared", F.coalesce("actual", F.lit(0)).alias("actual")).filter("declared IS NOT NULL AND declared != actual")


def issues(long: DataFrame) -> DataFrame:
    """All rule issues of a long rubric: severity, code, task_id, dim."""
    parts = [(missing_rule(long), "error", "missing_rule"), (missing_weight(long), "error", "missing_weight"), (rule_on_na(long), "warning", "rule_on_na"), (weight_sum(long).select("task_id", F.lit(None).cast("string").alias("dim")), "warning", "weight_sum")]
    out = None
    for df, severity, code in parts:
        rows = df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "task_id", "dim")
        out = rows if out is None else out.unionByName(rows)
    return out


def formal_ready(found: DataFrame) -> DataFrame:
    return found.groupBy().agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (F.count_if(F.col("severity") == "error") == 0).alias("ready"))


def canonical_hash(*fields: str) -> Column:
    """SHA-256 of compact JSON with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


#: What the contract of a rubric must say of its dimensions.
DIMENSIONS = ("D1", "D2", "D3", "D4", "D5")
D3_PHRASES, D4_NAME, D4_SCOPE = ("只对有效响应计时", "无有效响应记 0"), "响应内容正确性", "response_content_correctness"


def contract_check(manifests: DataFrame, version: str, tasks: int, schema_version: int = 2) -> DataFrame:
    """Rules that manifests as a whole break, one row each. manifests: manifest, schema_version, version, label_free, contract_sha256 (stated and, as contract_now, of the contract itself),
    contract_version, dimensions ARRAY<STRING> in order, d3_definition, d4_name, d3_no_response_score, d4_scope, formal_ready, errors (open issues), workbook_sha256 and workbook_now, task_count, tasks."""
    c = F.col
    no = lambda x: ~F.coalesce(x, F.lit(False))
    d3 = F.coalesce("d3_definition", F.lit(""))
    rules = {
        "schema_version": no(c("schema_version") == schema_version), "version": no(c("version") == version), "labels": no(c("label_free")), "no_contract": c("contract_now").isNull(),
        "contract_hash": no(c("contract_sha256") == c("contract_now")), "contract_version": no(c("contract_version") == version), "dimensions": no(c("dimensions") == F.array(*map(F.lit, DIMENSIONS))),
        "d3_definition": ~(d3.contains(D3_PHRASES[0]) & d3.contains(D3_PHRASES[1])), "d4_name": no(c("d4_name") == D4_NAME), "d3_no_response": no(c("d3_no_response_score") == 0.0), "d4_scope": no(c("d4_scope") == D4_SCOPE),
        "open_errors": no(c("formal_ready")) | (F.coalesce("errors", F.lit(0)) > 0), "no_workbook": c("workbook_now").isNull() | c("workbook_sha256").isNull(),
        "workbook_changed": c("workbook_now") != c("workbook_sha256"), "tasks": no(c("tasks") == tasks), "task_count": no(c("task_count") == c("tasks")),
    }
    return manifests.select("manifest", F.explode(F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))).alias("reason"))


def manifest_check(manifest: DataFrame, tasks: DataFrame, version: str) -> DataFrame:
    """One finding per rule and task that a manifest breaks. manifest: task_id, version, label_free, spec_sha256, contract_sha256 (of the task's own contract, and stated as contract),
    dimensions ARRAY<STRING>; tasks: task_id, spec_sha256."""
    both = manifest.withColumnRenamed("spec_sha256", "own").join(tasks.withColumnRenamed("spec_sha256", "spec").hint("merge"), "task_id", "full_outer")
    both = both.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("task_id")))
    there = F.col("own").isNotNull()
    rules = [
        F.when(~there, "missing_task"), F.when(F.col("spec").isNull(), "unknown_task"), F.when(there & (F.trim(F.coalesce("task_id", F.lit(""))) == ""), "no_id"), F.when(F.col("version") != version, "version"),
        F.when(~F.col("label_free"), "labels"), F.when(F.col("own") != F.col("spec"), "spec_hash"), F.when(there & ~F.col("contract").eqNullSafe(F.col("contract_sha256")), "contract_hash"),
        F.when(there & ~F.coalesce(F.col("dimensions") == F.array(*map(F.lit, DIMENSIONS)), F.lit(False)), "dimensions"), F.when(F.col("times") > 1, "duplicate_task"),
    ]
    return both.select("task_id", F.explode(F.array_compact(F.array(*rules))).alias("reason")).distinct()
