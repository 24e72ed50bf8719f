"""Queries over recording quality, campaigns and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import sampling as S
from . import fixtures as X
from .fixtures import oracle


def _systems(s):
    return s.sql("SELECT concat('s', k) AS system FROM (SELECT explode(sequence(0, 2)) AS k)")


#: What recordings say, as expressions of k, the last order of a customer on a system, and of `task_id`; Spark and the oracle read the same text.
_FIELDS = {
    "result_status": "CASE WHEN k % 41 = 0 THEN 'error' ELSE 'ok' END", "has_summary": "k % 43 <> 0", "has_validation": "k % 47 <> 0", "summary_status": "CASE WHEN k % 53 <> 0 THEN 'ok' END",
    "summary_task": "task_id", "validation_task": "CASE WHEN k % 59 = 0 THEN 0 ELSE task_id END", "backend_ok": "k % 61 <> 0", "identity_ok": "k % 67 <> 0", "prompt_sha256": "CASE WHEN k % 71 = 0 THEN 'q' ELSE 'p' END",
    "request_id": "CASE WHEN k % 73 = 0 THEN 'r9' ELSE 'r' END", "transport": "CASE WHEN k % 3 = 0 THEN 'native-video-realtime' ELSE 'frames' END", "scaffold": "CASE WHEN k % 29 <> 0 THEN 'joyai-official-live-adapter' END",
    "protocol": "CASE WHEN k % 31 = 0 THEN 'v0' ELSE 'v1' END", "query_mode": "CASE WHEN k % 37 <> 0 THEN 'inline' END", "realtime_ok": "k % 23 <> 0", "frames_ok": "k % 19 <> 0", "barrier_ok": "k % 79 <> 0", "same_session_ready": "k % 83 <> 0",
    "uploaded_after_ready": "k % 89 <> 0", "delivery_ok": "k % 97 <> 0", "replays": "CASE WHEN k % 101 = 0 THEN 1 ELSE 0 END", "cached_later": "k % 103 = 0", "upstream_ok": "k % 107 <> 0", "provider_errors": "CASE WHEN k % 109 = 0 THEN 2 END",
    "outcome": "CASE k % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'not_required' ELSE 'complete' END", "outcome_policy": "'wait_then_keep_as_capability_result'",
    "outcome_semantics": "CASE WHEN k % 113 = 0 THEN 'v3' ELSE 'strict_protocol_non_deferred_non_echo_response_v4' END", "timeout_is_failure": "k % 2 = 0", "provider_failure": "k % 127 = 0", "reconnects": "CASE WHEN k % 131 = 0 THEN 1 ELSE 0 END",
    "outages": "CASE WHEN k % 137 = 0 THEN 1 ELSE 0 END", "video_ok": "k % 139 <> 0", "decode_ok": "k % 149 <> 0", "video_name_ok": "k % 151 <> 0", "video_exists": "k % 17 <> 0", "video_inside": "k % 157 <> 0", "duration_s": "(k % 100) * 1.0",
    "bytes": "k % 163", "width": "k % 167", "height": "720", "minimum_s": "CASE WHEN k % 4 = 0 THEN 0.0 WHEN k % 4 = 1 THEN 10.0 END", "decoded": "CASE WHEN k % 5 = 0 THEN k % 15 <> 0 END",
}


def _tasks(s, d):
    return X.table(s, d, "customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 3 + 1).alias("queries"), (F.col("c_custkey") % 3 * 5.0 + 5).alias("last_query_s"), (F.col("c_nationkey") * 1.0).alias("duration_s"))


def _last(s, d):
    """Orders as recordings of customers on three systems; the last order of a pair counts."""
    k = F.col("o_orderkey")
    return X.table(s, d, "orders").groupBy(F.concat(F.lit("s"), (k % 3).cast("string")).alias("system"), F.col("o_custkey").alias("task_id")).agg(F.max("o_orderkey").alias("k"))


def _checked(s, d):
    last = _last(s, d)
    recordings = last.select("system", "task_id", *[F.expr(e).alias(n) for n, e in _FIELDS.items()])
    n = _systems(s).select("system", F.substring("system", 2, 1).cast("int").alias("n"))
    systems = n.select("system", F.lit("r").alias("request_id"), F.when(F.col("n") == 0, "native-video-realtime").otherwise("frames").alias("transport"), F.when(F.col("n") == 1, "joyai_scaffold").otherwise("plain").alias("runner"), F.lit("v1").alias("protocol"), F.lit("inline").alias("query_mode"))
    place = F.col("place")
    expected = _tasks(s, d).select("task_id", F.explode(F.sequence(F.lit(1), F.col("queries").cast("int"))).alias("place")).select("task_id", "place", F.concat(F.lit("R"), place.cast("string")).alias("id"), F.concat(F.lit("q"), place.cast("string")).alias("text"), (place * 5.0).alias("query_s"))
    rows = last.select("*", F.explode(F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int"))).alias("place")).filter("place <= k % 4")
    m = F.col("k") + place
    actual = rows.select("system", "task_id", "place", F.concat(F.when(m % 13 == 0, "X").otherwise("R"), place.cast("string")).alias("id"), F.concat(F.lit("q"), place.cast("string")).alias("text"), (place * 5.0 + F.when(m % 17 == 0, 0.01).otherwise(0.0)).alias("query_s"), F.when(m % 29 != 0, place * 5.0 + m % 8 / 10.0).alias("actual_s"), (m % 19 != 0).alias("ready"), (m % 23 != 0).alias("acknowledged"))
    return Q.verify_recordings(_tasks(s, d), systems, recordings, Q.query_rules(expected, actual), "p")


_SUM = """last AS (SELECT 's' || (o_orderkey % 3) AS system, o_custkey AS task_id, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
rec AS (SELECT system AS r_system, task_id AS r_task, k, """ + ", ".join(f"{e} AS {n}" for n, e in _FIELDS.items()) + """ FROM last),
acts AS (SELECT system, task_id, k, unnest(range(1, k % 4 + 1)) AS place FROM last),
qr AS (SELECT system AS q_system, task_id AS q_task, count(*) AS n, bool_or(place <= task_id % 3 + 1 AND (k + place) % 13 = 0) AS q1, bool_or(place <= task_id % 3 + 1 AND (k + place) % 17 = 0) AS q2, bool_or(place <= task_id % 3 + 1 AND ((k + place) % 29 = 0 OR (k + place) % 8 > 5)) AS q3,
 bool_or(place <= task_id % 3 + 1 AND (k + place) % 19 = 0) AS q4, bool_or(place <= task_id % 3 + 1 AND (k + place) % 23 = 0) AS q5 FROM acts GROUP BY 1, 2),
base AS (SELECT *, CASE WHEN minimum_s > 0 THEN minimum_s ELSE greatest(c_nationkey, c_custkey % 3 * 5.0 + 6) END AS shortest FROM customer CROSS JOIN (SELECT unnest(range(3)) AS n_sys) LEFT JOIN rec ON r_system = 's' || n_sys AND r_task = c_custkey LEFT JOIN qr ON q_system = 's' || n_sys AND q_task = c_custkey),
checked AS (SELECT 's' || n_sys AS system, c_custkey AS task_id, k, list_filter([CASE WHEN k IS NULL OR k % 41 = 0 THEN 'result' END, CASE WHEN k IS NULL OR k % 43 = 0 THEN 'no_summary' END, CASE WHEN k IS NULL OR k % 47 = 0 THEN 'no_validation' END,
 CASE WHEN k IS NULL OR k % 53 = 0 THEN 'summary_status' END, CASE WHEN k IS NULL OR k % 59 = 0 THEN 'task_identity' END, CASE WHEN k IS NULL OR k % 61 = 0 OR k % 67 = 0 THEN 'model_identity' END, CASE WHEN k IS NULL OR k % 71 = 0 THEN 'prompt' END, CASE WHEN k IS NULL OR k % 73 = 0 THEN 'request_id' END,
 CASE WHEN k IS NULL THEN 'transport' END, CASE WHEN n_sys = 1 AND (k IS NULL OR k % 29 = 0) THEN 'scaffold' END, CASE WHEN n_sys = 0 AND (k IS NULL OR k % 31 = 0) THEN 'protocol' END, CASE WHEN n_sys = 0 AND (k IS NULL OR k % 37 = 0) THEN 'query_mode' END, CASE WHEN n_sys = 0 AND (k IS NULL OR k % 23 = 0) THEN 'realtime_audit' END,
 CASE WHEN n_sys > 0 AND (k IS NULL OR k % 19 = 0) THEN 'frame_audit' END, CASE WHEN k IS NULL OR k % 79 = 0 THEN 'barrier' END, CASE WHEN k IS NULL OR k % 83 = 0 THEN 'model_not_ready' END, CASE WHEN k IS NULL OR k % 89 = 0 THEN 'early_upload' END, CASE WHEN k IS NULL OR k % 97 = 0 THEN 'delivery' END,
 CASE WHEN k IS NULL OR k % 101 = 0 THEN 'replay' END, CASE WHEN k IS NULL OR k % 103 = 0 THEN 'cached' END, CASE WHEN coalesce(n, 0) <> c_custkey % 3 + 1 THEN 'query_count' END, CASE WHEN q1 THEN 'query_identity' END, CASE WHEN q2 THEN 'query_time' END, CASE WHEN q3 THEN 'query_drift' END, CASE WHEN q4 THEN 'query_before_ready' END,
 CASE WHEN q5 THEN 'query_not_acknowledged' END, CASE WHEN k IS NULL OR k % 107 = 0 THEN 'upstream' END, CASE WHEN k % 109 = 0 THEN 'provider_error' END, CASE WHEN k IS NULL OR k % 113 = 0 THEN 'outcome_semantics' END, CASE WHEN k IS NULL OR k % 13 = 0 OR (k % 13 = 1 AND (k % 2 = 0 OR k % 113 = 0)) THEN 'outcome' END,
 CASE WHEN k % 127 = 0 THEN 'provider_failure' END, CASE WHEN k % 131 = 0 THEN 'reconnect' END, CASE WHEN k % 137 = 0 THEN 'outage' END, CASE WHEN k IS NULL OR k % 139 = 0 OR k % 149 = 0 THEN 'video' END, CASE WHEN k IS NULL OR k % 151 = 0 THEN 'video_name' END, CASE WHEN k IS NULL OR k % 17 = 0 THEN 'no_video' END,
 CASE WHEN k % 17 <> 0 AND k % 157 = 0 THEN 'video_outside' END, CASE WHEN k % 17 <> 0 AND (k % 100 = 0 OR k % 163 = 0 OR k % 167 = 0) THEN 'probe' END, CASE WHEN k % 17 <> 0 AND k % 100 + 1.5 < shortest THEN 'too_short' END, CASE WHEN k % 15 = 0 THEN 'full_decode' END], lambda x: x IS NOT NULL) AS errors FROM base)"""


def _ev(s, d):
    return X.session_events(s, d)


def _sends(s, d):
    """Deliveries of user turns: some twice, some never."""
    r = X.rounds(s, d)
    n = F.when((F.col("session") + F.col("rn")) % 11 == 0, 0).when((F.col("session") * 3 + F.col("rn")) % 17 == 0, 2).otherwise(1)
    return r.withColumn("n", n).filter("n > 0").select("session", "rn", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def _barrier(s, d):
    li = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    return li.select(k.alias("session"), (k % 5).alias("warm_s"), (k % 7).alias("upload_s"), F.when(k % 13 != 0, k % 11 + 2).alias("ready_s"), F.lit(12).alias("play_s"), (k % 3).alias("sent_bytes"), (k % 6).alias("file_bytes"))


def _videos(s, d):
    o = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    v = o.select(k.alias("session"), F.when(k % 19 != 0, (k % 97) * 0.5).alias("duration_s"), F.lit(25.0).alias("expected_s"), F.lit(20.0).alias("min_s"), F.lit(40.0).alias("max_s"), F.when(k % 2 == 0, (k % 50).cast("double")).alias("until_s"))
    li = X.table(s, d, "lineitem")
    r = li.select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") < 5, F.col("l_quantity")).alias("expected_query_s"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") + F.col("l_discount") * 6).alias("actual_query_s"))
    return v, r


def _queries(s, d):
    e = _ev(s, d)
    q = e.filter("kind = 'query'").select("session", "seq", F.col("text").alias("sha"), F.col("t_s").alias("planned_s"))
    return q, e.filter("kind = 'output'").select("session", "seq", F.col("text").alias("sha"), "t_s"), e.filter("kind = 'resume'").select("session", "seq", F.col("text").alias("sha"), "t_s")


def _attempt_events(s, d):
    e = X.table(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "failed").when(F.col("event_type") == "purchase", "recovery").when(F.col("event_type") == "error", "exhausted").when(F.col("event_id") % 40 == 0, "complete").otherwise("note")
    return e.select((F.col("event_id") % 1500).alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 9).alias("attempt"), F.lit(2).alias("allowed"), F.col("props").alias("message"))


def _attempt_state(s, d):
    """What the supervisor knows of tasks: of some nothing, of some a limit, a number of batches or when their pass began."""
    c = X.table(s, d, "customer")
    k = F.col("c_custkey")
    started = F.when(k % 3 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=k % 100))
    return c.select(k.alias("task_id"), F.element_at(F.array(*map(F.lit, ["ok", "failed", "running", "failed"])), (k % 4 + 1).cast("int")).alias("status"), (k % 8).alias("attempts"), F.when(k % 5 == 0, k % 10).alias("attempt_limit"), F.when(k % 6 == 0, k % 4).alias("recovery_batches"), started.alias("pass_started"), F.when(k % 7 != 0, 3600.0).alias("wall_s"))


def _audited(s, d):
    tasks = X.table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"))
    out = Q.attempt_audit(tasks, _attempt_state(s, d), _attempt_events(s, d), F.lit("2024-01-01 01:30:00").cast("timestamp"), recoveries=2)
    batches = F.array_join(F.transform("batches", lambda b: F.concat_ws("-", b["first"].cast("string"), b["last"].cast("string"))), ";")
    return out.withColumns({"history": F.sha2(F.array_join("history", ";"), 256), "batches": batches})


def _results(s, d):
    return X.attempts(s, d).groupBy("task").agg(F.max("attempt").alias("attempts"), F.max_by("status", "attempt").alias("st")).select(F.concat(F.lit("s"), (F.col("task") % 400).cast("string")).alias("system"), F.col("task"), F.when(F.col("st") == "response", "ok").otherwise("error").alias("status"), "attempts")


_RES = ", res AS (SELECT task, 's' || (task % 400) AS system, CASE WHEN arg_max(status, attempt) = 'response' THEN 'ok' ELSE 'error' END AS status, max(attempt) AS attempts FROM attempts GROUP BY 1)\n"


def _stored(s, d):
    a = X.artifacts(s, d)
    k = F.col("doc_id")
    tasks = a.select(k.alias("task"), F.lit("c1").alias("contract"), F.lit("v").alias("source"), (k % 2 == 0).alias("realtime"))
    unless = lambda n, good, bad=None: F.when(k % n == 0, bad).otherwise(good)
    stored = a.filter("doc_id % 10 != 0").select(
        k.alias("task"), unless(9, "ok", "error").alias("status"), unless(33, k, F.lit(-1)).alias("own_task"), unless(8, "c1", "c0").alias("contract"), unless(15, "v").alias("source"), (k % 16 != 1).alias("evaluation_ok"), unless(17, "s4", "s3").alias("semantics"), (k % 19 != 0).alias("backend_ok"),
        unless(22, "p").alias("prompt_sha256"), (k % 23 != 0).alias("identity_ok"), (k % 6 != 2).alias("realtime_ok"), "path", unless(21, F.col("sha256"), F.reverse("sha256")).alias("sha256"),
    )
    return tasks, stored, a.filter("doc_id % 14 != 0").select("path", unless(13, F.col("bytes"), F.lit(0)).alias("bytes"), "sha256"), "s4", "p"


def _outputs(s, d):
    return _ev(s, d).filter("kind = 'output'").select("session", "seq", "t_s")


def _recordings(s, d):
    o = X.table(s, d, "customer")
    return o.select(F.col("c_custkey").alias("session"), (F.col("c_nationkey") * 10.0 + 5).alias("duration_s"))


def _specs(s, d):
    c = X.table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("task_id"), F.element_at(F.array(*map(F.lit, ["实时计数", "实时翻译", "App引导", "智能体委托", "其他"])), (k % 5 + 1).cast("int")).alias("category"), (k % 2 == 0).alias("d1"), (k % 3 == 0).alias("d5"), (F.col("c_nationkey") * 10.0).alias("recording_s"), F.when(k % 4 != 0, F.col("c_nationkey") * 9.0).alias("source_s"), F.when(k % 7 < 4, "R1： a\nR2: b").otherwise("R1: a").alias("prompt"))


_SPECS = "specs AS (SELECT c_custkey AS task_id, c_custkey AS k, ['实时计数', '实时翻译', 'App引导', '智能体委托', '其他'][c_custkey % 5 + 1] AS category, c_custkey % 2 = 0 AS d1, c_custkey % 3 = 0 AS d5, c_nationkey * 10.0::DOUBLE AS recording_s, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey * 9.0::DOUBLE END AS source_s FROM customer)"


def _samples(s, d):
    e = _ev(s, d).filter("kind IN ('output', 'query')")
    return e.select("session", F.when(F.col("kind") == "output", 1).otherwise(0).alias("plan"), "t_s", F.lit(4).alias("tiles"), F.when(F.col("kind") == "output", 3).otherwise(2).alias("max_sheets")).distinct()


def _catalog(s, d):
    e = _ev(s, d)
    view = F.when(F.col("kind") == "query", "full_ui").when(F.col("kind") == "output", "crop").when(F.col("kind") == "stalled", "temporal_sheet_left").when(F.col("kind") == "disconnect", "full_ui").otherwise(F.when(F.col("event_id") % 9 == 0, "right_ui_tail_zoom").otherwise("crop"))
    return e.select("session", "t_s", view.alias("view")).distinct()


_CATALOG = """, c0 AS (SELECT DISTINCT session, t_s, CASE kind WHEN 'query' THEN 'full_ui' WHEN 'output' THEN 'crop' WHEN 'stalled' THEN 'temporal_sheet_left' WHEN 'disconnect' THEN 'full_ui' ELSE CASE WHEN event_id % 9 = 0 THEN 'right_ui_tail_zoom' ELSE 'crop' END END AS view FROM session_events),
cat AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN view LIKE 'temporal_sheet%' THEN 1 ELSE 0 END, t_s, CASE WHEN view LIKE 'temporal_sheet%' THEN 2 WHEN view = 'full_ui' THEN 0 ELSE 1 END, view) - 1 AS place FROM c0)
"""


def _even(k: str, n: str, place: str) -> str:
    """SQL: is `place` one of the k even places of n."""
    return f"CASE WHEN {n} <= {k} THEN true WHEN {k} <= 1 THEN {place} = 0 ELSE list_contains(list_transform(range(greatest(({k})::BIGINT, 2)), lambda i: round_even(i * ({n} - 1) / (({k}) - 1)::DOUBLE, 0)), {place}::DOUBLE) END"


def _cataloged(s, d):
    return S.evidence_catalog(_catalog(s, d)).select("session", "place", "view", "t_s", "evidence_id")


QUERIES = {
    "qa_verify": lambda s, d: _checked(s, d).select("system", "task_id", F.array_join("errors", ",").alias("errors"), "ok"),
    "qa_verify_rollup": lambda s, d: Q.verify_rollup(_checked(s, d), _systems(s).select("system", F.when(F.col("system") == "s1", "running").otherwise("complete").alias("supervisor_status")), 3),
    "qa_delivery": lambda s, d: Q.delivery(X.rounds(s, d), _sends(s, d)),
    "qa_barrier": lambda s, d: Q.start_barrier(_barrier(s, d)).select("session", "barrier_ok"),
    "qa_video": lambda s, d: Q.video_quality(*_videos(s, d)).select("session", F.array_join("errors", ",").alias("errors")),
    "qa_max_duration": lambda s, d: X.table(s, d, "orders").select("o_orderkey", F.round(Q.max_duration(F.col("o_totalprice"), F.col("o_orderstatus") == "O", F.lit(180.0), F.lit(2.5)), 2).alias("max_s")),
    "qa_query_timing": lambda s, d: Q.query_timing(*_queries(s, d)).select("session", "seq", F.round("drift_s", 4).alias("drift_s"), F.round("queue_s", 4).alias("queue_s")),
    "qa_hash_bag": lambda s, d: Q.bag_diff(X.rounds(s, d).select("session", "rn"), _sends(s, d)).groupBy("session", "rn", "side").agg(F.count(F.lit(1)).alias("n")),
    "qa_timeout_accept": lambda s, d: Q.timeout_accept(_ev(s, d).select("session", (F.col("event_id") % 40 != 0).alias("answered"), (F.col("event_id") % 80 == 0).alias("timeout_recorded"), (F.col("event_id") % 333 == 0).alias("provider_error"))),
    "qa_upstream": lambda s, d: Q.upstream_audit(_ev(s, d).select("session", F.when(F.col("kind") == "query", "request").when(F.col("kind") == "output", "response").alias("kind"), (F.col("event_id") % 25 != 0).alias("ok"), F.when(F.col("event_id") % 50 == 0, "model_latency_timeout").alias("failure_class")).filter("kind IS NOT NULL").withColumn("failure_class", F.when(F.col("kind") == "response", F.col("failure_class")))),
    "qa_first_error": lambda s, d: Q.first_error(_checked(s, d), ["model_identity", "outcome"]).select("system", "task_id", "first_error"),
    "qa_attempt_audit": _audited,
    "qa_run_summary": lambda s, d: Q.run_summary(X.table(s, d, "orders").select(F.col("o_orderkey").alias("task")), X.attempts(s, d).select("task", "attempt", F.when(F.col("status_code") == 200, "ok").otherwise("error").alias("status"))),
    "qa_system_state": lambda s, d: Q.system_state(_results(s, d), 5),
    "qa_matrix": lambda s, d: Q.matrix_summary(_results(s, d)),
    "qa_contract_compat": lambda s, d: Q.contract_compat(X.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "wall").alias("clock"), F.col("o_orderstatus").alias("mode")), X.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "media").otherwise("wall").alias("clock"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("mode")), {"clock": "wall", "mode": "F"}, ("clock", "wall", "media")),
    "qa_resume_valid": lambda s, d: Q.resume_valid(*_stored(s, d)),
    "qa_reusable_run": lambda s, d: Q.reusable_runs(_results(s, d).select(F.col("system").alias("run"), F.lit("f").alias("fingerprint"), "task", "status"), "f"),
    "qa_state_merge": lambda s, d: Q.merge_state(X.table(s, d, "customer").filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("system"), F.col("c_mktsegment").alias("status"), (F.col("c_custkey") % 2 == 0).alias("alive")), X.table(s, d, "customer").filter("c_custkey % 4 != 0").select(F.col("c_custkey").alias("system"), (F.col("c_custkey") % 5 == 0).alias("complete"))),
    "qa_source_sig": lambda s, d: Q.source_signatures(X.table(s, d, "lineitem").select(F.col("l_partkey").alias("path")), X.table(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("bytes"), F.col("p_retailprice").alias("modified"))),
    "qa_pipeline_state": lambda s, d: Q.pipeline_state(X.table(s, d, "customer").filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 2 == 0, "complete").otherwise("running").alias("status")), X.table(s, d, "customer").filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 7 == 0, "failed").otherwise("complete").alias("status"))),
    "ev_even_sample": lambda s, d: S.evenly_sample(_outputs(s, d), ["session"], ["seq"], 5).select("session", "seq"),
    "ev_even_indices": lambda s, d: S.evenly_sample(_outputs(s, d), ["session"], ["seq"], 1, middle=True).select("session", "seq"),
    "ev_crop_times": lambda s, d: S.crop_times(_outputs(s, d), _ev(s, d).filter("kind = 'query'").select("session", "t_s"), 6),
    "ev_query_segments": lambda s, d: S.query_segments(_recordings(s, d), _ev(s, d).filter("kind = 'query'")).select("session", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s")),
    "ev_plans": lambda s, d: S.temporal_plans(_specs(s, d)),
    "ev_grid": lambda s, d: S.sample_grid(S.query_segments(_recordings(s, d), _ev(s, d).filter("kind = 'query'")), 2.0, 100),
    "ev_sheets": lambda s, d: S.sheets(_samples(s, d), 4).select("session", "plan", "sheet", "t_s", "tiles"),
    "ev_catalog": lambda s, d: _cataloged(s, d),
    "ev_tail_zoom": lambda s, d: S.tail_zoom(_specs(s, d)),
    "ev_priority": lambda s, d: S.priority_order(_cataloged(s, d)).select("session", "place", "new_place"),
    "ev_frame_times": lambda s, d: S.frame_times(_recordings(s, d), _outputs(s, d), 40).select("session", F.size("times").alias("n"), F.element_at("times", -1).alias("last_s")),
    "ev_variants": lambda s, d: S.variants(_cataloged(s, d)).groupBy("session", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places")),
}
_EV_O = "(SELECT session, seq, t_s, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY session) AS n FROM session_events WHERE kind = 'output')"
_SENDS = ", sends AS (SELECT session, rn, CASE WHEN (session + rn) % 11 = 0 THEN 0 WHEN (session * 3 + rn) % 17 = 0 THEN 2 ELSE 1 END AS n FROM rounds)\n"
ORACLES = {
    "qa_verify": f"WITH {_SUM} SELECT system, task_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS ok FROM checked",
    "qa_verify_rollup": f"WITH {_SUM} SELECT system, count(*) AS total, count(*) FILTER (len(errors) = 0) AS ok, CASE WHEN count(*) FILTER (len(errors) = 0) = count(*) AND system = 's0' OR count(*) FILTER (len(errors) = 0) = count(*) AND system = 's2' THEN 'complete' ELSE 'incomplete' END AS status FROM checked GROUP BY ROLLUP (system)",
    "qa_delivery": oracle("rounds", _SENDS + "SELECT session, count(*) AS rounds, bool_and(n = 1) AS delivered_once FROM sends GROUP BY 1"),
    "qa_barrier": "SELECT o_orderkey AS session, coalesce(o_orderkey % 5 <= o_orderkey % 7 AND o_orderkey % 7 <= CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 11 + 2 END AND CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 11 + 2 END <= 12 AND o_orderkey % 3 = o_orderkey % 6, false) AS barrier_ok FROM orders",
    "qa_video": """WITH r AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber < 6) AS a, count(*) FILTER (l_linenumber < 5) AS e, count(*) FILTER (l_linenumber < 5 AND abs(l_quantity + l_discount * 6 - l_quantity) > 0.5) AS late FROM lineitem GROUP BY 1), v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 97) * 0.5 END AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END AS until_s FROM orders)
SELECT v.k AS session, concat_ws(',', CASE WHEN d IS NULL OR abs(d - 25) > 1.5 THEN 'duration' END, CASE WHEN d < 18.5 THEN 'shorter' END, CASE WHEN d > 41.5 THEN 'longer' END, CASE WHEN d < until_s - 0.25 THEN 'tail' END, CASE WHEN coalesce(a, 0) <> coalesce(e, 0) THEN 'query_count' END, CASE WHEN coalesce(late, 0) > 0 THEN 'query_drift' END) AS errors FROM v LEFT JOIN r ON r.k = v.k""",
    "qa_max_duration": "SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 182.5 ELSE 0 END + 5, 2) AS max_s FROM orders",
    "qa_query_timing": oracle("events_", """, n AS (SELECT *, row_number() OVER (PARTITION BY session, kind, text ORDER BY seq) AS k FROM session_events) SELECT q.session, q.seq, round(a.t_s - q.t_s, 4) AS drift_s, round(b.t_s - a.t_s, 4) AS queue_s
FROM (SELECT * FROM n WHERE kind = 'query') q LEFT JOIN (SELECT * FROM n WHERE kind = 'output') a ON a.session = q.session AND a.text = q.text AND a.k = q.k LEFT JOIN (SELECT * FROM n WHERE kind = 'resume') b ON b.session = q.session AND b.text = q.text AND b.k = q.k"""),
    "qa_hash_bag": oracle("rounds", _SENDS + "SELECT session, rn, CASE WHEN n = 0 THEN 'undelivered' ELSE 'unexpected' END AS side, 1 AS n FROM sends WHERE n <> 1"),
    "qa_timeout_accept": oracle("events_", "SELECT session, count(*) FILTER (event_id % 40 = 0) AS unanswered, bool_and(event_id % 40 <> 0 OR event_id % 80 = 0) AND NOT bool_or(event_id % 333 = 0) AS accepted FROM session_events GROUP BY 1"),
    "qa_upstream": oracle("events_", """, a AS (SELECT session, count(*) FILTER (kind = 'query') AS requests, count(*) FILTER (kind = 'output' AND event_id % 25 <> 0) AS ok, count(*) FILTER (kind = 'output' AND event_id % 25 = 0) AS failed, count(*) FILTER (kind = 'output' AND event_id % 50 = 0) AS timeouts FROM session_events WHERE kind IN ('query', 'output') GROUP BY 1)
SELECT *, failed = timeouts AND ok + failed >= requests AS clean FROM a"""),
    "qa_first_error": f"WITH {_SUM} SELECT system, task_id, CASE WHEN list_contains(errors, 'model_identity') THEN 'model_identity' WHEN list_contains(errors, 'outcome') THEN 'outcome' ELSE errors[1] END AS first_error FROM checked",
    "qa_attempt_audit": """WITH e AS (SELECT event_id % 1500 AS task_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'failed' WHEN event_type = 'purchase' THEN 'recovery' WHEN event_type = 'error' THEN 'exhausted' WHEN event_id % 40 = 0 THEN 'complete' ELSE 'note' END AS kind, event_id % 9 AS attempt, props FROM events),
p AS (SELECT task_id, max(attempt) FILTER (kind IN ('failed', 'complete')) AS seen, count(*) FILTER (kind = 'failed') AS failures, count(*) FILTER (kind = 'complete') AS completions, count(*) FILTER (kind = 'exhausted') AS exhausted, count(*) FILTER (kind = 'recovery') AS recovered,
 coalesce(string_agg(props, ';' ORDER BY seq) FILTER (kind = 'failed'), '') AS history, coalesce(string_agg((attempt + 1) || '-' || (attempt + 2), ';' ORDER BY seq) FILTER (kind = 'recovery'), '') AS batches FROM e GROUP BY 1),
r AS (SELECT o_orderkey AS task_id, c_custkey AS k, CASE WHEN k IS NULL THEN 'pending' ELSE ['ok', 'failed', 'running', 'failed'][k % 4 + 1] END AS status, greatest(0, coalesce(k % 8, 0), coalesce(seen, 0)) AS attempts, p.* EXCLUDE (task_id) FROM orders LEFT JOIN customer ON c_custkey = o_orderkey LEFT JOIN p ON p.task_id = o_orderkey),
q AS (SELECT *, CASE WHEN k % 5 = 0 AND k % 10 <> 0 THEN k % 10 ELSE greatest(6, attempts) END AS attempt_limit, CASE WHEN k % 6 = 0 THEN k % 4 ELSE coalesce(recovered, 0) END AS recovery_batch_count, coalesce(k % 3 = 0 OR k % 7 = 0 OR k % 100 > 30, true) AS in_time FROM r)
SELECT task_id, status, attempts, attempt_limit, recovery_batch_count, coalesce(failures, 0) AS failures, coalesce(completions, 0) AS completions, coalesce(exhausted, 0) AS exhausted, CASE WHEN failures IS NOT NULL THEN sha256(history) END AS history, batches,
 attempt_limit > attempts AND in_time AS may_continue, recovery_batch_count < 2 AS may_recover, status = 'failed' AND (attempt_limit > attempts AND in_time OR recovery_batch_count < 2) AS may_go_on FROM q""",
    "qa_run_summary": oracle("attempts", ", p AS (SELECT task, count(*) AS n, min(attempt) FILTER (status_code = 200) AS f, max(attempt) AS l FROM attempts GROUP BY 1) SELECT o_orderkey AS task, coalesce(n, 0) AS attempts, coalesce(f, l) AS chosen, CASE WHEN f IS NOT NULL THEN 'ok' WHEN n IS NOT NULL THEN 'error' ELSE 'pending' END AS status FROM orders LEFT JOIN p ON task = o_orderkey"),
    "qa_system_state": oracle("attempts", _RES + "SELECT system, bool_and(status = 'ok') AS complete, bool_and(status = 'ok' OR attempts >= 5) AS terminal, bool_or(status <> 'ok' AND attempts < 5) AS resumable FROM res GROUP BY 1"),
    "qa_matrix": oracle("attempts", _RES + "SELECT system, count(*) AS tasks, count(*) FILTER (status = 'ok') AS ok, sum(attempts) AS attempts FROM res GROUP BY 1"),
    "qa_contract_compat": "SELECT o_orderkey AS id, (o_orderkey % 7 <> 0 OR o_orderstatus = 'F') AS compatible FROM orders",
    "qa_resume_valid": oracle("artifacts", """SELECT doc_id AS task, CASE WHEN doc_id % 10 = 0 THEN 'no_result' WHEN doc_id % 9 = 0 THEN 'status' WHEN doc_id % 33 = 0 THEN 'task' WHEN doc_id % 8 = 0 THEN 'contract' WHEN doc_id % 15 = 0 THEN 'source' WHEN doc_id % 16 = 1 THEN 'evaluation' WHEN doc_id % 17 = 0 THEN 'protocol' WHEN doc_id % 19 = 0 THEN 'backend'
 WHEN doc_id % 22 = 0 THEN 'prompt' WHEN doc_id % 23 = 0 THEN 'identity' WHEN doc_id % 6 = 2 THEN 'realtime' WHEN doc_id % 14 = 0 THEN 'no_file' WHEN doc_id % 13 = 0 OR bytes = 0 THEN 'empty_video' WHEN doc_id % 21 = 0 THEN 'file' END AS reason FROM artifacts"""),
    "qa_reusable_run": oracle("attempts", _RES + "SELECT system AS run, bool_and(status = 'ok') AS reusable FROM res GROUP BY 1"),
    "qa_state_merge": "SELECT c_custkey AS system, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 = 0 THEN 'complete' WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'unknown' END AS status, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND NOT (c_custkey % 4 <> 0 AND c_custkey % 5 = 0) AS live FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0",
    "qa_source_sig": "SELECT DISTINCT l_partkey AS path, p_size AS bytes, p_retailprice AS modified FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    "qa_pipeline_state": "SELECT c_custkey AS run, CASE WHEN c_custkey % 5 = 0 THEN 'no_recording' WHEN c_custkey % 2 <> 0 THEN 'recording:running' WHEN c_custkey % 3 = 0 THEN 'waiting_for_judge' WHEN c_custkey % 7 = 0 THEN 'judging:failed' ELSE 'complete' END AS status FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 <> 0",
    "ev_variants": oracle("events_", _CATALOG + f""", ns AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place) - 1 AS p, count(*) OVER (PARTITION BY session) AS n FROM cat WHERE view NOT LIKE 'temporal_sheet%'),
v AS (SELECT session, 'complete' AS variant, place FROM cat UNION ALL SELECT session, 'priority', place FROM cat WHERE place < 24 UNION ALL SELECT session, 'individual', place FROM ns UNION ALL SELECT session, 'sparse', place FROM ns WHERE {_even('12', 'n', 'p')})
SELECT session, variant, count(*) AS n, sum(place)::BIGINT AS places FROM v GROUP BY 1, 2"""),
    "ev_even_sample": oracle("events_", f"SELECT session, seq FROM {_EV_O} WHERE {_even('5', 'n', 'p')}"),
    "ev_even_indices": oracle("events_", f"SELECT session, seq FROM {_EV_O} WHERE n <= 1 OR p = n // 2"),
    "ev_crop_times": oracle("events_", f""", c AS (SELECT o.session, seq * 3 + part AS g, o.t_s + [-0.6, 0.0, 0.8][part + 1] AS c_s FROM {_EV_O} o CROSS JOIN (SELECT unnest([0, 1, 2]) AS part)), e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY g) - 1 AS p, count(*) OVER (PARTITION BY session) AS n FROM c),
q AS (SELECT session, t_s FROM session_events WHERE kind = 'query') SELECT DISTINCT session, t_s FROM (SELECT e.session, q.t_s, row_number() OVER (PARTITION BY e.session, g ORDER BY abs(q.t_s - c_s), q.t_s) AS r FROM e JOIN q ON q.session = e.session WHERE {_even('6', 'n', 'p')}) WHERE r = 1"""),
    "ev_query_segments": oracle("events_", """, r AS (SELECT c_custkey AS session, c_nationkey * 10.0::DOUBLE + 5 AS d FROM customer), q AS (SELECT session, t_s FROM session_events WHERE kind = 'query')
SELECT r.session, round(greatest(0.0, t_s - 1), 3) AS start_s, round(least(d, t_s + 4), 3) AS end_s FROM r JOIN q ON q.session = r.session UNION ALL SELECT session, 0.0, d FROM r WHERE session NOT IN (SELECT session FROM q) AND d <= 120
UNION ALL SELECT session, 0.0, 35.0 FROM r WHERE session NOT IN (SELECT session FROM q) AND d > 120 UNION ALL SELECT session, d - 45, d FROM r WHERE session NOT IN (SELECT session FROM q) AND d > 120"""),
    "ev_plans": f"""WITH {_SPECS}, m AS (SELECT *, CASE WHEN source_s IS NULL THEN recording_s ELSE least(source_s, recording_s) END AS media FROM specs)
SELECT task_id, 0 AS place, CASE WHEN source_s IS NULL THEN 'left_video' ELSE 'source_video' END AS view, CASE WHEN category = '实时计数' THEN 4.0 WHEN category = '实时翻译' THEN 2.0 WHEN d1 AND media <= 180 THEN 2.0 WHEN d1 THEN 1.0 ELSE 0.5 END::DOUBLE AS fps, CASE WHEN category IN ('实时计数', '实时翻译') OR d1 THEN 240 ELSE 180 END AS max_frames, 12 AS tiles, CASE WHEN category = 'App引导' THEN 8 WHEN category IN ('实时计数', '实时翻译') THEN 14 ELSE 10 END AS max_sheets FROM m WHERE media > 0
UNION ALL SELECT task_id, CASE WHEN media > 0 THEN 1 ELSE 0 END, 'right_ui', CASE WHEN d5 THEN 4.0 ELSE 2.0 END, 120, 6, 10 FROM m WHERE category IN ('App引导', '智能体委托') OR d5 OR source_s IS NULL""",
    "ev_grid": oracle("events_", f""", r AS (SELECT c_custkey AS session, c_nationkey * 10.0::DOUBLE + 5 AS d FROM customer), q AS (SELECT session, t_s FROM session_events WHERE kind = 'query'),
o AS (SELECT * FROM r WHERE session NOT IN (SELECT session FROM q)),
g AS (SELECT session, d, greatest(0.0, t_s - 1) AS a, least(d, t_s + 4) AS b FROM r JOIN q USING (session)
 UNION ALL SELECT session, d, 0.0, CASE WHEN d <= 120 THEN d ELSE 35.0 END FROM o UNION ALL SELECT session, d, d - 45, d FROM o WHERE d > 120),
h AS (SELECT *, least(b, greatest(0.0, d - least(0.5, greatest(0.05, d * 0.1)))) AS z FROM g), t AS (SELECT DISTINCT session, round_even(a + i / 2.0::DOUBLE, 3) AS t_s FROM (SELECT session, a, unnest(range(floor((z - a) * 2)::BIGINT + 1)) AS i FROM h WHERE z >= a)),
e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_s) - 1 AS p, count(*) OVER (PARTITION BY session) AS n FROM t) SELECT session, t_s FROM e WHERE {_even('100', 'n', 'p')}"""),
    "ev_sheets": oracle("events_", f""", s AS (SELECT DISTINCT session, CASE WHEN kind = 'output' THEN 1 ELSE 0 END AS plan, t_s, CASE WHEN kind = 'output' THEN 3 ELSE 2 END AS most FROM session_events WHERE kind IN ('output', 'query')),
n AS (SELECT *, count(*) OVER (PARTITION BY session, plan) AS n, row_number() OVER (PARTITION BY session, plan ORDER BY t_s) - 1 AS p FROM s), w AS (SELECT session, plan, least(ceil(max(n) / 4.0), max(most)) AS want FROM n GROUP BY 1, 2),
b AS (SELECT session, plan, greatest(0, least(want, 4 - coalesce(sum(want) OVER (PARTITION BY session ORDER BY plan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS room FROM w),
k AS (SELECT n.session, n.plan, t_s FROM n JOIN b ON b.session = n.session AND b.plan = n.plan WHERE room > 0 AND {_even('room * 4', 'n.n', 'p')}), f AS (SELECT *, (row_number() OVER (PARTITION BY session, plan ORDER BY t_s) - 1) // 4 AS sheet FROM k)
SELECT session, plan, sheet, min(t_s) AS t_s, count(*) AS tiles FROM f GROUP BY 1, 2, 3"""),
    "ev_catalog": oracle("events_", _CATALOG + "SELECT session, place, view, t_s, 'EVIDENCE_IMAGE_' || lpad(place::VARCHAR, 3, '0') AS evidence_id FROM cat"),
    "ev_tail_zoom": f"WITH {_SPECS} SELECT task_id, greatest(0.0, recording_s - unnest([2.0, 0.5])) AS t_s, 'right_ui_tail_zoom' AS view FROM specs WHERE d5 AND k % 7 < 4",
}
