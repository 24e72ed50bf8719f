"""Queries over judgments: scores, leaderboard, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cluster import cut
from ..operators import judgments as J
from . import fixtures as X
from .fixtures import oracle

STAGES = ["first", "review_1", "review_2"]


def _scores(spark, d):
    return J.grade_scores(X.grades(spark, d))


def _items(spark, d):
    return J.item_scores(_scores(spark, d), "category")


def leaderboard(spark, d):
    return J.leaderboard(J.system_summary(_items(spark, d))).select("place", "system", "tasks", "n_scored", *[F.round(c, 6).alias(c) for c in ("overall_score", "score_without_d3", "raw_dimension_mean")])


def _predictions(spark, d):
    """system, task_id, stage, status, digest: three stages an item, some failed, some missing."""
    g = X.grades(spark, d).filter("dim = 'D4'").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    m = (F.col("task_id") + F.col("k") * 7) % 11
    return g.filter((F.col("task_id") + F.col("k")) % 17 != 0).select("system", "task_id", F.element_at(F.array(*map(F.lit, STAGES)), F.col("k") + 1).alias("stage"), F.when(m == 0, "error").otherwise("ok").alias("status"), F.coalesce("grade", F.lit("-")).alias("digest"))


def _judged(spark, d):
    """Predictions of one stage with the task id that they name, their grades (one dimension left out of some), and the spec of all tasks."""
    g = X.grades(spark, d)
    own = F.when(F.col("task_id") % 13 == 0, -1).otherwise(F.col("task_id"))
    p = _predictions(spark, d).filter("stage = 'first'").select("system", "task_id", own.alias("own_task_id"), "status")
    given = g.filter("task_id % 23 > 0 OR dim <> 'D2'").select("system", "task_id", "dim", F.when(F.col("applicable"), F.col("grade")).otherwise(F.coalesce("grade", F.lit("not_applicable"))).alias("grade"))
    spec = g.groupBy("task_id", "dim").agg(F.bool_or("applicable").alias("applicable"))
    return p, given, spec


_PRED = """, predictions AS (SELECT system, task_id, CASE k WHEN 0 THEN 'first' WHEN 1 THEN 'review_1' ELSE 'review_2' END AS stage,
 CASE WHEN (task_id + k * 7) % 11 = 0 THEN 'error' ELSE 'ok' END AS status, coalesce(grade, '-') AS digest FROM grades CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE dim = 'D4' AND (task_id + k) % 17 <> 0)
"""


def _rechecked(spark, d):
    """The item scores as some stage wrote them down, a few of them off and a few missing, against the scores themselves, which are computed once."""
    i = cut(_items(spark, d))
    reported = i.withColumn("score", F.when(F.col("task_id") % 29 == 0, F.col("score") + 0.5).otherwise(F.col("score"))).withColumn("raw_mean", F.when(F.col("task_id") % 31 != 0, F.col("raw_mean")))
    return J.recheck(reported, i)


def _expected(spark, d):
    g = X.grades(spark, d).select("task_id").distinct()
    return g.withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))


def _stage_tasks(spark, d):
    return _predictions(spark, d).groupBy("stage", "task_id").agg(F.min("status").alias("status"))


def _pivoted(df, prefix=""):
    return df.select(*[F.round(c, 6).alias(prefix + c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "jd_leaderboard": leaderboard,
    "jd_grade_score": lambda s, d: _scores(s, d).select("system", "task_id", "dim", "score"),
    "jd_item_score": lambda s, d: _items(s, d).select("system", "task_id", *[F.round(c, 6).alias(c) for c in ("score", "score_without_d3", "raw_mean")]),
    "jd_summary": lambda s, d: J.system_summary(_items(s, d)).select("system", "tasks", "n_scored", "n_failed", F.round("overall_score", 6).alias("overall_score")),
    "jd_category": lambda s, d: _pivoted(J.category_scores(_items(s, d), [f"C{k}" for k in range(9)])),
    "jd_dimension": lambda s, d: _pivoted(J.dimension_means(_scores(s, d))),
    "jd_recheck": lambda s, d: _rechecked(s, d).select("system", "task_id", "field", F.round("reported", 6).alias("reported"), F.round("recomputed", 6).alias("recomputed")),
    "jd_confusion": lambda s, d: J.confusion(X.verdicts(s, d)),
    "jd_alignment": lambda s, d: J.alignment(X.verdicts(s, d)).select(F.coalesce("dim", F.lit("all")).alias("dim"), "labels", *[F.round(c, 6).alias(c) for c in ("mae", "exact", "within_one", "macro_f1", "quadratic_kappa")]),
    "jd_validate": lambda s, d: J.validate_prediction(*_judged(s, d)).select("system", F.col("task_id").cast("string").alias("task_id"), F.array_join("errors", ",").alias("errors")),
    "jd_fill_na": lambda s, d: J.fill_na(X.grades(s, d)).groupBy("system", "dim", "grade").agg(F.count("*").alias("n")),
    "jd_candidates": lambda s, d: J.candidates(_predictions(s, d)).select("system", "task_id", F.array_join("candidates", ";").alias("candidates")),
    "jd_stage_status": lambda s, d: J.stage_status(_expected(s, d), _stage_tasks(s, d)),
    "jd_remaining": lambda s, d: J.remaining_tasks(_expected(s, d), _stage_tasks(s, d)).select("stage", "task_id"),
    "jd_system_progress": lambda s, d: J.system_progress(_predictions(s, d), STAGES, 1000),
    "jd_campaign_progress": lambda s, d: J.campaign_progress(_predictions(s, d)).select(F.coalesce("system", F.lit("all")).alias("system"), F.coalesce("stage", F.lit("all")).alias("stage"), "predictions", "ok"),
    "jd_batch_summary": lambda s, d: J.batch_summary(_predictions(s, d)),
}
_SUMMARY = """, summary AS (SELECT system, count(*) AS tasks, count(score) AS n_scored, count(*) - count(score) AS n_failed, 100 * avg(score) AS overall_score, 100 * avg(score_without_d3) AS score_without_d3, 100 * avg(raw_mean) AS raw_dimension_mean FROM items GROUP BY 1)
"""
_EXPECTED = """, expected AS (SELECT DISTINCT task_id, stage FROM grades CROSS JOIN (SELECT unnest(['first', 'review_1', 'review_2']) AS stage)),
done AS (SELECT stage, task_id, min(status) AS status FROM predictions GROUP BY 1, 2)
"""
_F1 = " + ".join(f"coalesce(2.0 * tp{k} / nullif(h{k} + j{k}, 0), 0)" for k in range(3))
_SEEN = " + ".join(f"CASE WHEN h{k} + j{k} > 0 THEN 1 ELSE 0 END" for k in range(3))
_CHANCE = " + ".join(f"h{a} * j{b} * {(a - b) ** 2}" for a in range(3) for b in range(3) if a != b)
_COUNTS = ", ".join(f"count(*) FILTER (human = '{g}' AND judge = '{g}') AS tp{k}, count(*) FILTER (human = '{g}') AS h{k}, count(*) FILTER (judge = '{g}') AS j{k}" for k, g in enumerate("GSB"))
_ALIGN = f"""SELECT coalesce(dim, 'all') AS dim, count(*) AS labels, avg(abs(h - j)) / 2 AS mae, avg(CASE WHEN h = j THEN 1.0 ELSE 0 END) AS exact, avg(CASE WHEN abs(h - j) <= 1 THEN 1.0 ELSE 0 END) AS within_one, sum((h - j) * (h - j)) AS sq, {_COUNTS}
 FROM (SELECT *, CASE human WHEN 'G' THEN 0 WHEN 'S' THEN 1 ELSE 2 END AS h, CASE judge WHEN 'G' THEN 0 WHEN 'S' THEN 1 ELSE 2 END AS j FROM verdicts) GROUP BY GROUPING SETS ((dim), ())"""
ORACLES = {
    "jd_leaderboard": oracle("items", _SUMMARY + "SELECT row_number() OVER (ORDER BY overall_score DESC NULLS LAST, system) AS place, system, tasks, n_scored, round(overall_score, 6) AS overall_score, round(score_without_d3, 6) AS score_without_d3, round(raw_dimension_mean, 6) AS raw_dimension_mean FROM summary"),
    "jd_grade_score": oracle("scored", "SELECT system, task_id, dim, score FROM scored"),
    "jd_item_score": oracle("items", "SELECT system, task_id, round(score, 6) AS score, round(score_without_d3, 6) AS score_without_d3, round(raw_mean, 6) AS raw_mean FROM items"),
    "jd_summary": oracle("items", _SUMMARY + "SELECT system, tasks, n_scored, n_failed, round(overall_score, 6) AS overall_score FROM summary"),
    "jd_category": oracle("items", "SELECT system, " + ", ".join(f"round(100 * avg(score) FILTER (category = 'C{k}'), 6) AS C{k}" for k in range(9)) + " FROM items GROUP BY 1"),
    "jd_dimension": oracle("scored", "SELECT system, " + ", ".join(f"round(100 * avg(score) FILTER (dim = 'D{k}'), 6) AS D{k}" for k in range(1, 6)) + " FROM scored GROUP BY 1"),
    "jd_recheck": oracle("items", """, r AS (SELECT system, task_id, CASE WHEN task_id % 29 = 0 THEN score + 0.5 ELSE score END AS rs, score, CASE WHEN task_id % 31 <> 0 THEN raw_mean END AS rr, raw_mean FROM items)
SELECT system, task_id, 'score' AS field, round(rs, 6) AS reported, round(score, 6) AS recomputed FROM r WHERE abs(rs - score) > 1e-12
UNION ALL SELECT system, task_id, 'raw_mean', round(rr, 6), round(raw_mean, 6) FROM r WHERE rr IS NULL AND raw_mean IS NOT NULL"""),
    "jd_confusion": oracle("verdicts", "SELECT dim, human, count(*) FILTER (judge = 'G') AS G, count(*) FILTER (judge = 'S') AS S, count(*) FILTER (judge = 'B') AS B FROM verdicts GROUP BY 1, 2"),
    "jd_alignment": oracle("verdicts", f", a AS ({_ALIGN}) SELECT dim, labels, round(mae, 6) AS mae, round(exact, 6) AS exact, round(within_one, 6) AS within_one, round(({_F1}) / ({_SEEN}), 6) AS macro_f1, round(CASE WHEN ({_CHANCE}) = 0 THEN 1.0 ELSE 1 - sq / (({_CHANCE})::DOUBLE / labels) END, 6) AS quadratic_kappa FROM a"),
    "jd_validate": oracle("grades", _PRED + """, spec AS (SELECT task_id, dim, bool_or(applicable) AS applicable FROM grades GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN task_id % 13 = 0 THEN 'other' ELSE task_id::VARCHAR END AS own FROM predictions WHERE stage = 'first'),
w AS (SELECT p.system, p.task_id, spec.dim, spec.applicable, CASE WHEN p.task_id % 23 > 0 OR spec.dim <> 'D2' THEN CASE WHEN g.applicable THEN g.grade ELSE coalesce(g.grade, 'not_applicable') END END AS grade
      FROM p JOIN spec USING (task_id) LEFT JOIN grades g ON g.system = p.system AND g.task_id = p.task_id AND g.dim = spec.dim),
e AS (SELECT system, task_id, string_agg(dim || CASE WHEN NOT applicable THEN ':not_applicable' WHEN grade IS NULL THEN ':missing' ELSE ':unknown' END, ',' ORDER BY dim) AS e FROM w
      WHERE CASE WHEN applicable THEN grade IS NULL OR grade NOT IN ('G', 'S', 'B') ELSE grade IS NULL OR grade <> 'not_applicable' END GROUP BY 1, 2)
SELECT p.system, p.task_id::VARCHAR AS task_id, concat_ws(',', CASE WHEN own <> p.task_id::VARCHAR THEN 'task_id' END, CASE WHEN status <> 'ok' THEN 'status' END, e) AS errors FROM p LEFT JOIN e ON e.system = p.system AND e.task_id = p.task_id"""),
    "jd_fill_na": oracle("grades", "SELECT system, dim, CASE WHEN applicable THEN grade ELSE 'not_applicable' END AS grade, count(*) AS n FROM grades GROUP BY 1, 2, 3"),
    "jd_candidates": oracle("grades", _PRED + """SELECT system, task_id, string_agg(stage || '=' || digest, ';' ORDER BY list_position(['review_1', 'first', 'review_2'], stage)) AS candidates FROM predictions GROUP BY 1, 2 HAVING count(*) = 3 AND min(status) = 'ok'"""),
    "jd_stage_status": oracle("grades", _PRED + _EXPECTED + """SELECT e.stage, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status IS NULL OR status <> 'ok') AS remaining
FROM expected e LEFT JOIN done d ON d.stage = e.stage AND d.task_id = e.task_id GROUP BY 1"""),
    "jd_remaining": oracle("grades", _PRED + _EXPECTED + "SELECT stage, task_id FROM expected e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.stage = e.stage AND d.task_id = e.task_id AND status = 'ok')"),
    "jd_system_progress": oracle("grades", _PRED + """, p AS (SELECT system, count(*) FILTER (stage = 'first') AS "first", count(*) FILTER (stage = 'review_1') AS review_1, count(*) FILTER (stage = 'review_2') AS review_2 FROM predictions WHERE status = 'ok' GROUP BY 1)
SELECT *, ("first" = 1000 AND review_1 = 1000 AND review_2 = 1000) AS complete FROM p"""),
    "jd_campaign_progress": oracle("grades", _PRED + "SELECT coalesce(system, 'all') AS system, coalesce(stage, 'all') AS stage, count(*) AS predictions, count(*) FILTER (status = 'ok') AS ok FROM predictions GROUP BY ROLLUP (system, stage)"),
    "jd_batch_summary": oracle("grades", _PRED + "SELECT stage, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM predictions GROUP BY 1"),
}
