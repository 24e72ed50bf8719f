"""Recording quality and campaign bookkeeping: rules over recordings, query timing, rollups, resume decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in conditions.items()]))


#: How the outcome of a recording's responses must be stated, and a scaffold's contract.
POLICY, SEMANTICS, SCAFFOLD = "wait_then_keep_as_capability_result", "strict_protocol_non_deferred_non_echo_response_v4", "joyai-official-live-adapter"
#: Systems of a campaign that are broadcast; beyond, every task meets them by a shuffle.
BROADCAST_SYSTEMS = 10_000


def query_rules(expected: DataFrame, actual: DataFrame, drift_s: float = 0.5) -> DataFrame:
    """Per system and task how many queries there are and which rules some query breaks; queries meet by place, as far as both sides go.
    expected: task_id, place, id, text, query_s; actual: system, task_id, place, id, text, query_s, actual_s, ready, acknowledged."""
    e = expected.select("task_id", "place", F.col("id").alias("e_id"), F.col("text").alias("e_text"), F.col("query_s").alias("e_s"))
    both = actual.join(e.hint("merge"), ["task_id", "place"], "left")
    there = F.col("e_id").isNotNull()
    same = (F.col("id") == F.col("e_id")) & (F.coalesce("text", F.lit("")) == F.coalesce("e_text", F.lit("")))
    far = lambda c, most: ~F.coalesce(F.abs(F.col(c) - F.col("e_s")) <= most, F.lit(False))
    broken = {"query_identity": ~F.coalesce(same, F.lit(False)), "query_time": far("query_s", 0.001), "query_drift": far("actual_s", drift_s), "query_before_ready": ~F.coalesce("ready", F.lit(False)), "query_not_acknowledged": ~F.coalesce("acknowledged", F.lit(False))}
    return both.groupBy("system", "task_id").agg(F.count(F.lit(1)).alias("actual_queries"), *[F.bool_or(there & cond).alias(name) for name, cond in broken.items()])


def verify_recordings(tasks: DataFrame, systems: DataFrame, recordings: DataFrame, queries: DataFrame, prompt_sha256: str, policy: str = POLICY, semantics: str = SEMANTICS) -> DataFrame:
    """Every task of every system against its recording: the list of broken rules, in order.

    tasks: task_id, queries, last_query_s, duration_s; systems: system, request_id, transport, runner, protocol, query_mode; queries: what `query_rules` gives;
    recordings: system, task_id and what supervisor (result_status), summary, validation, contract, audits, outcome, video file, probe and, if tried, full decode (decoded) say; null is unknown."""
    systems = systems.select("system", F.struct(*[c for c in systems.columns if c != "system"]).alias("w"))
    systems = systems.hint("broadcast" if systems.count() <= BROADCAST_SYSTEMS else "shuffle_replicate_nl")
    every = tasks.crossJoin(systems)
    rows = every.join(recordings.withColumnRenamed("duration_s", "probed_s").hint("merge"), ["system", "task_id"], "left").join(queries.hint("merge"), ["system", "task_id"], "left")
    c = F.col
    no = lambda x: ~F.coalesce(c(x) if isinstance(x, str) else x, F.lit(False))
    zero = lambda x: F.coalesce(c(x), F.lit(0)) != 0
    realtime = F.coalesce(c("w.transport") == "native-video-realtime", F.lit(False))
    timed_out = (c("outcome_policy") == policy) & (c("outcome_semantics") == semantics) & (c("timeout_is_failure") == F.lit(False)) & c("outcome").isin("timeout", "partial_timeout")
    shortest = F.coalesce(F.nullif("minimum_s", F.lit(0.0)), F.greatest(F.coalesce("duration_s", F.lit(0.0)), F.greatest(F.lit(0.0), F.coalesce("last_query_s", F.lit(0.0))) + 1))
    there = F.coalesce(c("video_exists"), F.lit(False))
    broken = rules(
        result=no(c("result_status") == "ok"), no_summary=no("has_summary"), no_validation=no("has_validation"), summary_status=no(c("summary_status") == "ok"),
        task_identity=no((c("summary_task") == c("task_id")) & (c("validation_task") == c("task_id"))), model_identity=no(c("backend_ok") & c("identity_ok")), prompt=no(c("prompt_sha256") == prompt_sha256),
        request_id=~c("request_id").eqNullSafe(c("w.request_id")), transport=~c("transport").eqNullSafe(c("w.transport")), scaffold=F.coalesce(c("w.runner") == "joyai_scaffold", F.lit(False)) & no(c("scaffold") == SCAFFOLD),
        protocol=realtime & ~c("protocol").eqNullSafe(c("w.protocol")), query_mode=realtime & ~c("query_mode").eqNullSafe(c("w.query_mode")), realtime_audit=realtime & no("realtime_ok"), frame_audit=~realtime & no("frames_ok"),
        barrier=no("barrier_ok"), model_not_ready=no("same_session_ready"), early_upload=no("uploaded_after_ready"), delivery=no("delivery_ok"), replay=~c("replays").eqNullSafe(F.lit(0)), cached=~c("cached_later").eqNullSafe(F.lit(False)),
        query_count=F.coalesce("actual_queries", F.lit(0)) != c("queries"), query_identity=F.coalesce("query_identity", F.lit(False)), query_time=F.coalesce("query_time", F.lit(False)), query_drift=F.coalesce("query_drift", F.lit(False)),
        query_before_ready=F.coalesce("query_before_ready", F.lit(False)), query_not_acknowledged=F.coalesce("query_not_acknowledged", F.lit(False)), upstream=no("upstream_ok"), provider_error=zero("provider_errors"),
        outcome_semantics=~c("outcome_semantics").eqNullSafe(F.lit(semantics)), outcome=no(timed_out) & no(c("outcome").isin("complete", "not_required")), provider_failure=F.coalesce("provider_failure", F.lit(False)),
        reconnect=zero("reconnects"), outage=zero("outages"), video=no(c("video_ok") & c("decode_ok")), video_name=no("video_name_ok"), no_video=~there, video_outside=there & no("video_inside"),
        probe=there & no((c("probed_s") > 0) & (c("bytes") > 0) & (c("width") > 0) & (c("height") > 0)), too_short=there & (c("probed_s") + 1.5 < shortest), full_decode=c("decoded").eqNullSafe(F.lit(False)),
    )
    return rows.select("system", "task_id", broken.alias("errors")).withColumn("ok", F.size("errors") == 0)


def verify_rollup(checked: DataFrame, systems: DataFrame, expected: int) -> DataFrame:
    """Ok and total by system and over all (system null), and the status. A system is complete if its supervisor says so and all its tasks are ok, the campaign if
    it has as many systems as expected and all are complete. systems: system, supervisor_status (null without a supervisor)."""
    tasks = checked.groupBy("system").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"))
    per = systems.select("system", "supervisor_status").join(tasks.hint("merge"), "system", "left").na.fill(0, ["total", "ok"])
    per = per.withColumn("good", F.col("supervisor_status").eqNullSafe(F.lit("complete")) & (F.col("ok") == F.col("total")))
    status = lambda good: F.when(good, "complete").otherwise("incomplete").alias("status")
    out = per.groupingSets([["system"], []], "system").agg(F.sum("total").alias("total"), F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.bool_and("good").alias("good"), F.grouping("system").alias("all"))
    return out.select("system", "total", "ok", status(F.col("good") & ((F.col("all") == 0) | (F.col("n") == expected))))


def delivery(rounds: DataFrame, sends: DataFrame) -> DataFrame:
    """Whether each round of a session was delivered exactly once. rounds: session, rn; sends: session, rn."""
    n = rounds.join(sends.groupBy("session", "rn").agg(F.count(F.lit(1)).alias("times")).hint("merge"), ["session", "rn"], "left")
    return n.groupBy("session").agg(F.count(F.lit(1)).alias("rounds"), F.bool_and(F.coalesce("times", F.lit(0)) == 1).alias("delivered_once"))


def start_barrier(sessions: DataFrame) -> DataFrame:
    """Warm-up, upload start, upload ready and playback request must follow each other, and sizes agree."""
    ok = (F.col("warm_s") <= F.col("upload_s")) & (F.col("upload_s") <= F.col("ready_s")) & (F.col("ready_s") <= F.col("play_s")) & (F.col("sent_bytes") == F.col("file_bytes"))
    return sessions.withColumn("barrier_ok", F.coalesce(ok, F.lit(False)))


def video_quality(sessions: DataFrame, rounds: DataFrame, duration_tolerance_s: float = 1.5, query_tolerance_s: float = 0.5, until_tolerance_s: float = 0.25) -> DataFrame:
    """Broken rules of a recording's length and of its queries, which meet the expected ones by place.
    sessions: session, duration_s, expected_s, min_s, max_s, until_s; rounds: session, place, expected_query_s, actual_query_s (a side that lacks a place has null)."""
    drift = F.abs(F.col("actual_query_s") - F.col("expected_query_s"))
    q = rounds.groupBy("session").agg(F.count("actual_query_s").alias("actual"), F.count("expected_query_s").alias("expected"), F.count_if(drift > query_tolerance_s).alias("late"))
    d = F.col("duration_s")
    broken = rules(
        duration=d.isNull() | (F.abs(d - F.col("expected_s")) > duration_tolerance_s), shorter=d < F.col("min_s") - duration_tolerance_s, longer=d > F.col("max_s") + duration_tolerance_s,
        tail=d < F.col("until_s") - until_tolerance_s, query_count=F.coalesce("actual", F.lit(0)) != F.coalesce("expected", F.lit(0)), query_drift=F.coalesce("late", F.lit(0)) > 0,
    )
    return sessions.join(q, "session", "left").select("session", broken.alias("errors"))


def max_duration(minimum: Column, waits: Column, timeout: Column, tail: Column, extra: float = 5.0) -> Column:
    return minimum + F.when(waits, timeout + tail).otherwise(0.0) + extra


def query_timing(queries: DataFrame, accepted: DataFrame, delivered: DataFrame) -> DataFrame:
    """The k-th occurrence of a query in a session meets its k-th acceptance and delivery. queries: session, seq, sha, planned_s; the others: session, seq, sha, t_s."""
    k = F.row_number().over(Window.partitionBy("session", "sha").orderBy("seq"))
    a, b = (df.select("session", "sha", k.alias("k"), F.col("t_s").alias(name)) for df, name in ((accepted, "accepted_s"), (delivered, "delivered_s")))
    out = queries.withColumn("k", k).join(a, ["session", "sha", "k"], "left").join(b, ["session", "sha", "k"], "left")
    return out.withColumn("drift_s", F.col("accepted_s") - F.col("planned_s")).withColumn("queue_s", F.col("delivered_s") - F.col("accepted_s"))


def bag_diff(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Multiset difference both ways. Both have the same columns."""
    a, b = expected.exceptAll(delivered).withColumn("side", F.lit("undelivered")), delivered.exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return a.unionByName(b)


def timeout_accept(outcomes: DataFrame) -> DataFrame:
    """Sessions with unanswered queries pass only if each is a recorded capability timeout and no provider failed. outcomes: session, answered, timeout_recorded, provider_error."""
    fine = F.col("answered") | F.col("timeout_recorded")
    return outcomes.groupBy("session").agg(F.count_if(~F.col("answered")).alias("unanswered"), (F.bool_and(fine) & ~F.bool_or("provider_error")).alias("accepted"))


def upstream_audit(events: DataFrame) -> DataFrame:
    """Counts and verdict per session from audit events. events: session, kind (request, response), ok, failure_class."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    req, res = F.col("kind") == "request", F.col("kind") == "response"
    out = events.groupBy("session").agg(n(req).alias("requests"), n(res & F.col("ok")).alias("ok"), n(res & ~F.col("ok")).alias("failed"), n(F.col("failure_class") == "model_latency_timeout").alias("timeouts"))
    return out.withColumn("clean", (F.col("failed") == F.col("timeouts")) & (F.col("ok") + F.col("failed") >= F.col("requests")))


def first_error(checked: DataFrame, priority: list[str]) -> DataFrame:
    """The most important broken rule of each row. checked: key columns and errors ARRAY<STRING>."""
    return checked.withColumn("first_error", F.coalesce(*[F.when(F.array_contains("errors", p), p) for p in priority], F.get("errors", 0)))


def attempt_audit(tasks: DataFrame, state: DataFrame, events: DataFrame, now: Column, retries: int = 5, recoveries: int = 1) -> DataFrame:
    """Attempts, limits and history of every task, and whether it may go on. Attempts are the most that state or events know of.

    tasks: task_id; state: task_id, status (ok, failed, running; null is pending), attempts, attempt_limit, recovery_batches (null: count the events), pass_started, wall_s;
    events: task_id, seq, kind (failed, complete, exhausted, recovery), attempt, allowed (attempts that a recovery grants), message."""
    n = lambda k: F.count_if(F.col("kind") == k)
    history = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "failed", F.struct("seq", F.coalesce("message", F.lit("")).alias("message"))))), lambda f: f["message"])
    batches = F.array_sort(F.collect_list(F.when(F.col("kind") == "recovery", F.struct("seq", (F.coalesce("attempt", F.lit(0)) + 1).alias("first"), (F.coalesce("attempt", F.lit(0)) + F.coalesce("allowed", F.lit(0))).alias("last")))))
    per = events.filter("task_id IS NOT NULL").groupBy("task_id").agg(
        F.max(F.when(F.col("kind").isin("failed", "complete"), F.col("attempt"))).alias("seen"), n("failed").alias("failures"), n("complete").alias("completions"), n("exhausted").alias("exhausted"),
        n("recovery").alias("recovered"), history.alias("history"), batches.alias("batches"),
    )
    rows = tasks.select("task_id").join(state.hint("merge"), "task_id", "left").join(per.hint("merge"), "task_id", "left")
    attempts = F.greatest(F.lit(0), F.coalesce("attempts", F.lit(0)), F.coalesce("seen", F.lit(0)))
    limit = F.coalesce(F.nullif("attempt_limit", F.lit(0)), F.greatest(F.lit(retries + 1), F.col("total")))
    batch_count = F.coalesce("recovery_batches", "recovered", F.lit(0))
    # A pass without a start or a limit has all the time.
    in_time = F.coalesce(F.col("pass_started").isNull() | (F.coalesce("wall_s", F.lit(0.0)) <= 0) | (now < F.col("pass_started") + F.make_dt_interval(secs=F.coalesce("wall_s", F.lit(0.0)))), F.lit(True))
    rows = rows.withColumn("total", attempts).withColumn("attempt_limit", limit).withColumn("recovery_batch_count", batch_count)
    out = rows.select(
        "task_id", F.coalesce("status", F.lit("pending")).alias("status"), F.col("total").alias("attempts"), "attempt_limit", "recovery_batch_count", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("failures", "completions", "exhausted")],
        "history", "batches", ((F.col("attempt_limit") > F.col("total")) & in_time).alias("may_continue"), (F.col("recovery_batch_count") < recoveries).alias("may_recover"),
    )
    return out.withColumn("may_go_on", (F.col("status") == "failed") & (F.col("may_continue") | F.col("may_recover")))


def run_summary(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per task its first success, else its last attempt, else pending. attempts: task, attempt, status."""
    ok = F.min(F.when(F.col("status") == "ok", F.col("attempt")))
    per = attempts.groupBy("task").agg(F.count(F.lit(1)).alias("attempts"), ok.alias("first_ok"), F.max(F.struct("attempt", "status")).alias("last"))
    return tasks.join(per, "task", "left").select("task", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("first_ok", "last.attempt").alias("chosen"), F.when(F.col("first_ok").isNotNull(), "ok").otherwise(F.coalesce("last.status", F.lit("pending"))).alias("status"))


def system_state(results: DataFrame, budget: int) -> DataFrame:
    """Complete, terminal and resumable flags of each system. results: system, status, attempts."""
    ok, spent = F.col("status") == "ok", F.col("attempts") >= budget
    return results.groupBy("system").agg(F.bool_and(ok).alias("complete"), F.bool_and(ok | spent).alias("terminal"), F.bool_or(~ok & ~spent).alias("resumable"))


def matrix_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("system").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum("attempts").alias("attempts"))


def contract_compat(before: DataFrame, after: DataFrame, defaults: dict[str, str], migrated: tuple[str, str, str]) -> DataFrame:
    """Whether contracts are equal once defaults are filled in; one field may move from one value to another. Both: id and the fields."""
    field, old, new = migrated
    a = after.select("id", *[F.coalesce(F.col(f), F.lit(v)).alias(f"a_{f}") for f, v in defaults.items()])
    same = F.lit(True)
    for f, v in defaults.items():
        b = F.coalesce(F.col(f), F.lit(v))
        equal = b == F.col(f"a_{f}")
        same = same & (equal | ((b == old) & (F.col(f"a_{f}") == new)) if f == field else equal)
    return before.join(a, "id").select("id", same.alias("compatible"))


def resume_valid(tasks: DataFrame, stored: DataFrame, files: DataFrame, semantics: str, prompt_sha256: str) -> DataFrame:
    """Stored results that hold; the rest is to be done again, with the first reason why.

    tasks: task, contract, source (signature of its video), realtime (whether its input needs the realtime audit); stored: task, status, own_task, contract, source, evaluation_ok (whether
    `contract_compat` holds), semantics, backend_ok, prompt_sha256, identity_ok, realtime_ok, path, sha256; files: path, bytes, sha256."""
    f = files.select("path", F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now"))
    s = stored.withColumnRenamed("contract", "old").withColumnRenamed("source", "old_source").join(f.hint("merge"), "path", "left")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    reason = (
        F.when(F.col("own_task").isNull() & F.col("status").isNull(), "no_result").when(no(F.col("status") == "ok"), "status").when(no(F.col("own_task") == F.col("task")), "task").when(no(F.col("old") == F.col("contract")), "contract")
        .when(no(F.col("old_source") == F.col("source")), "source").when(no(F.col("evaluation_ok")), "evaluation").when(no(F.col("semantics") == semantics), "protocol").when(no(F.col("backend_ok")), "backend")
        .when(no(F.col("prompt_sha256") == prompt_sha256), "prompt").when(no(F.col("identity_ok")), "identity").when(F.coalesce("realtime", F.lit(False)) & no(F.col("realtime_ok")), "realtime")
        .when(F.col("now").isNull(), "no_file").when(no(F.col("now_bytes") > 0), "empty_video").when(no(F.col("now") == F.col("sha256")), "file")
    )
    return tasks.join(s.hint("merge"), "task", "left").select("task", reason.alias("reason"))


def reusable_runs(results: DataFrame, fingerprint: str) -> DataFrame:
    """Runs that hold as a whole: same fingerprint, not empty, every task ok. results: run, fingerprint, task, status."""
    return results.groupBy("run").agg((F.bool_and(F.col("fingerprint") == fingerprint) & F.bool_and(F.coalesce(F.col("status") == "ok", F.lit(False)))).alias("reusable"))


def merge_state(workers: DataFrame, inspected: DataFrame) -> DataFrame:
    """Worker states overlaid with what inspection found; complete wins over whatever the worker says. workers: system, status, alive; inspected: system, complete."""
    out = workers.join(inspected, "system", "full_outer")
    return out.select("system", F.when(F.col("complete"), "complete").otherwise(F.coalesce("status", F.lit("unknown"))).alias("status"), (F.coalesce("alive", F.lit(False)) & ~F.coalesce("complete", F.lit(False))).alias("live"))


def source_signatures(tasks: DataFrame, files: DataFrame) -> DataFrame:
    return tasks.select("path").distinct().join(files, "path", "left").select("path", "bytes", "modified")


def pipeline_state(recording: DataFrame, judging: DataFrame) -> DataFrame:
    """One status per run out of both halves. Both: run, status."""
    out = recording.withColumnRenamed("status", "rec").join(judging.withColumnRenamed("status", "judge"), "run", "full_outer")
    status = F.when(F.col("rec").isNull(), "no_recording").when(F.col("rec") != "complete", F.concat(F.lit("recording:"), F.col("rec"))).when(F.col("judge").isNull(), "waiting_for_judge").when(F.col("judge") != "complete", F.concat(F.lit("judging:"), F.col("judge"))).otherwise("complete")
    return out.select("run", status.alias("status"))
