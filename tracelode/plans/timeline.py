"""Queries over session timelines, intervals and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import timeline as L
from . import fixtures as X
from .fixtures import oracle


def _ev(spark, d, kind=None):
    e = X.session_events(spark, d)
    return e.filter(F.col("kind") == kind) if kind else e


def _sessions(spark, d):
    """One row per user: origins of their clocks and how playback went."""
    u = X.table(spark, d, "customer")
    return u.select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") / 4.0).alias("video_start_s"), (F.col("c_nationkey") / 2.0).alias("stream_ready_s"), F.when(F.col("c_custkey") % 4 != 1, "upload").otherwise("live").alias("input_mode"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 7 == 0).alias("paused"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey") / 50.0).alias("current_time_s"), (F.col("c_custkey") % 11 % 2).alias("loop_count"))


_SESSIONS = """sessions AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey / 4.0::DOUBLE END AS video_start_s, c_nationkey / 2.0::DOUBLE AS stream_ready_s, CASE WHEN c_custkey % 4 <> 1 THEN 'upload' ELSE 'live' END AS input_mode,
 CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 = 0 END AS paused, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey / 50.0::DOUBLE END AS current_time_s, c_custkey % 11 % 2 AS loop_count FROM customer)"""


def _samples(spark, d):
    """A media clock that runs with the log and falls back now and then."""
    e = _ev(spark, d)
    return e.select("session", "seq", "t_s", F.bround(F.col("t_s") % 20.0, 3).alias("media_s"), F.lit(20.0).alias("duration_s"), F.col("latency_ms").alias("value"), "kind", F.floor(F.col("seq") / 3).alias("frame"), (F.col("session") % 50).cast("double").alias("removed_s"))


_SAMPLES = ", samples AS (SELECT session, seq, t_s, round_even(t_s % 20.0, 3) AS media_s, latency_ms AS value, kind, seq // 3 AS frame, (session % 50)::DOUBLE AS removed_s FROM session_events)"


def _health(spark, d):
    e = _ev(spark, d)
    v = F.col("latency_ms")
    return e.select("session", "seq", "t_s", F.when(F.col("event_id") % 97 == 0, "camera").otherwise("upload").alias("source"), F.when(F.col("event_id") % 89 != 0, "running").alias("lifecycle"), (F.col("event_id") % 83 != 0).alias("analysis"), (F.col("event_id") % 79 != 0).alias("looping"), (F.col("event_id") % 101 == 0).alias("ended"), F.when(v > 60, 1).otherwise(4).alias("ready_state"), (F.col("event_id") % 41 == 0).alias("paused"), (F.col("event_id") % 6).alias("closes"), F.when(F.col("event_id") % 5 == 0, v / 2).alias("disconnected_s"), (v / 40).alias("media_stall_s"), (v / 15).alias("frame_stall_s"), (F.col("event_id") % 3).alias("guard_pauses"))


def _merged(spark, d):
    return I.merge_intervals(X.intervals(spark, d), 2.0)


def _trims(spark, d):
    o = X.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("session"), F.lit(500.0).alias("trim_start_s"), F.lit(2500.0).alias("trim_end_s"))


def _queue(spark, d):
    return _ev(spark, d).filter("kind IN ('query', 'output')").withColumn("kind", F.when(F.col("kind") == "query", "enqueue").otherwise("dequeue"))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def _stalls(spark, d):
    """Every sample's stalls, beside the longest of its session."""
    rows = I.stalls(_samples(spark, d))
    return _r(rows.join(I.longest_stalls(rows).hint("merge"), "session").drop("t_s"), "stall_s", "frame_stall_s", "longest_stall_s", "longest_frame_stall_s")


#: Every Unicode space, line separator and ASCII separator, as a class of DuckDB's patterns.
_SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"

QUERIES = {
    "tl_rebase": lambda s, d: _r(L.rebase_clock(_ev(s, d).select("session", "seq", (F.col("t_s") * 1000).alias("t_ms")), _sessions(s, d)).select("session", "seq", "wall_s"), "wall_s"),
    "tl_queries": lambda s, d: _ev(s, d, "query").select("session", "seq", "t_s", "text"),
    "tl_outputs": lambda s, d: _ev(s, d, "output").filter(~L.is_silence(F.col("text"))).select("session", "seq", "t_s", "latency_ms", "text"),
    "tl_silence": lambda s, d: L.silence_counts(X.responses(s, d)),
    "tl_clean_response": lambda s, d: X.responses(s, d).select("session", "turn", F.sha2(L.clean_response(F.col("text")), 256).alias("answer")),
    "tl_dedupe": lambda s, d: L.dedupe_events(_ev(s, d).withColumn("t_s", F.floor(F.col("t_s") / 40).cast("double"))).select("session", "seq"),
    "tl_wall_intervals": lambda s, d: _r(L.intervals_between(_ev(s, d, "output"), "t_s").select("session", "seq", "interval_s"), "interval_s"),
    "tl_frame_intervals": lambda s, d: _r(L.intervals_between(_ev(s, d, "output").withColumn("frame_clock_s", L.frame_time(F.col("text"))), "frame_clock_s").select("session", "seq", "interval_s"), "interval_s"),
    "tl_numeric_summary": lambda s, d: L.numeric_summary(L.intervals_between(_ev(s, d, "output"), "latency_ms"), ["session"], "latency_ms").select("session", "count", "min", "median", "max"),
    "tl_first_output": lambda s, d: _r(L.first_output_after_query(_ev(s, d, "query"), _ev(s, d, "output")).select("session", "query_seq", "output_t_s", "wall_delay_s", "latency_ms"), "wall_delay_s"),
    "tl_round_match": lambda s, d: L.round_match(X.rounds(s, d), X.responses(s, d).select("session", F.col("turn").alias("seq"), "text", (F.col("turn") * 10).alias("latency_ms"))).select("session", "rn", "latency_ms"),
    "tl_alignment": lambda s, d: L.playback_alignment(_sessions(s, d)).select("session", "aligned"),
    "tl_frame_time": lambda s, d: X.table(s, d, "events").select("event_id", L.frame_time(F.concat(F.lit("frame "), F.col("props"))).alias("frame_s")),
    "tl_document": lambda s, d: L.timeline_document(_ev(s, d, "query"), _ev(s, d, "output")).select("session", F.size("queries").alias("n_queries"), F.size("outputs").alias("n_outputs"), F.element_at("queries", 1)["t_s"].alias("first_query_s")),
    "iv_merge": lambda s, d: _merged(s, d).select("session", "start_s", "end_s", F.array_join(F.array_sort("reasons"), ",").alias("reasons")),
    "iv_keep": lambda s, d: I.keep_segments(_trims(s, d), _merged(s, d)),
    "iv_totals": lambda s, d: I.interval_totals(_merged(s, d)),
    "iv_value_runs": lambda s, d: _r(I.value_runs(_samples(s, d), 60.0, 0.1, 100.0), "start_s", "end_s", "rise_s", "offset_s"),
    "st_loop_unroll": lambda s, d: _r(I.unroll_loops(_samples(s, d)).select("session", "seq", "loops", "timeline_s"), "timeline_s"),
    "st_stalls": lambda s, d: _stalls(s, d),
    "st_interrupts": lambda s, d: I.interruptions(_health(s, d)),
    "st_downtime": lambda s, d: _r(I.downtime(_ev(s, d)), "down_s", "longest_s"),
    "st_segments": lambda s, d: I.segments(X.frames(s, d), 10.0),
    "st_session_expiry": lambda s, d: _r(I.sessions(_ev(s, d), 8.0), "start_s"),
    "st_last_n": lambda s, d: I.last_n(X.frames(s, d), 5).select("session", "position"),
    "st_mode_size": lambda s, d: I.modal_size(X.frames(s, d)),
    "st_idempotent_event": lambda s, d: I.idempotent_events(_ev(s, d).select((F.col("event_id") % 3000).alias("event_id"), "kind").withColumnRenamed("kind", "content")),
    "st_queue_delay": lambda s, d: _r(I.queue_delay(_queue(s, d)).select("session", "place", "delay_s"), "delay_s"),
    "st_ack_match": lambda s, d: _r(I.ack_match(_ev(s, d, "query"), _ev(s, d, "resume")).select("session", "seq", "ack_t_s"), "ack_t_s"),
}
_ISLANDS = """, kept AS (SELECT *, max(end_s) OVER (PARTITION BY session ORDER BY start_s, end_s, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM intervals WHERE end_s - start_s >= 2.0),
numbered AS (SELECT *, sum(CASE WHEN upto IS NULL OR start_s > upto + 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY start_s, end_s, reason ROWS UNBOUNDED PRECEDING) AS island FROM kept),
merged AS (SELECT session, min(start_s) AS start_s, max(end_s) AS end_s, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM numbered GROUP BY session, island)
"""
_O = "SELECT * FROM session_events WHERE kind = 'output'"
_FIRST = """, q AS (SELECT *, lead(t_s) OVER (PARTITION BY session ORDER BY seq) AS next_t FROM session_events WHERE kind = 'query')
SELECT q.session, q.seq AS query_seq, arg_min(o.t_s, o.seq) AS output_t_s, round(arg_min(o.t_s, o.seq) - q.t_s, 4) AS wall_delay_s, arg_min(o.latency_ms, o.seq) AS latency_ms
FROM q LEFT JOIN (SELECT * FROM session_events WHERE kind = 'output') o ON o.session = q.session AND o.t_s >= q.t_s AND (q.next_t IS NULL OR o.t_s < q.next_t) GROUP BY q.session, q.seq, q.t_s"""
ORACLES = {
    "tl_rebase": oracle("events_", f", {_SESSIONS} SELECT e.session, seq, round(round_even(t_s * 1000 / 1000 - coalesce(video_start_s, stream_ready_s), 3), 4) AS wall_s FROM session_events e LEFT JOIN sessions s ON s.session = e.session"),
    "tl_queries": oracle("events_", "SELECT session, seq, t_s, text FROM session_events WHERE kind = 'query'"),
    "tl_outputs": oracle("events_", "SELECT session, seq, t_s, latency_ms, text FROM session_events WHERE kind = 'output' AND text IS NOT NULL AND text NOT IN ('', 'none')"),
    "tl_silence": oracle("responses", f"SELECT session, count(*) AS responses, count(*) FILTER (lower(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) IN ('', '</silence>', '<silence>', 'silence', 'null', 'none')) AS silent FROM responses GROUP BY 1"),
    "tl_clean_response": oracle("responses", f"SELECT session, turn, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '^{_SPACE}*</?response>{_SPACE}*', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS answer FROM responses"),
    "tl_dedupe": oracle("events_", "SELECT session, min(seq) AS seq FROM (SELECT *, floor(t_s / 40) AS f FROM session_events) GROUP BY session, kind, text, CASE WHEN f = 0 THEN -1 ELSE f END"),
    "tl_wall_intervals": oracle("events_", f"SELECT session, seq, round(i, 4) AS interval_s FROM (SELECT session, seq, t_s - lag(t_s) OVER (PARTITION BY session ORDER BY seq) AS i FROM ({_O})) WHERE i IS NOT NULL"),
    "tl_frame_intervals": oracle("events_", f"SELECT session, seq, round(i, 4) AS interval_s FROM (SELECT session, seq, text::DOUBLE - lag(text::DOUBLE) OVER (PARTITION BY session ORDER BY seq) AS i FROM ({_O})) WHERE i IS NOT NULL"),
    "tl_numeric_summary": oracle("events_", f"SELECT session, count(*) AS count, round_even(min(latency_ms), 3) AS min, round_even(median(latency_ms), 3) AS median, round_even(max(latency_ms), 3) AS max FROM (SELECT *, lag(latency_ms) OVER (PARTITION BY session ORDER BY seq) AS p FROM ({_O})) WHERE p IS NOT NULL GROUP BY 1"),
    "tl_first_output": oracle("events_", _FIRST),
    "tl_round_match": oracle("rounds responses", """, o AS (SELECT session, text, min(turn) * 10 AS latency_ms FROM responses WHERE text <> '' GROUP BY 1, 2)
SELECT r.session, rn, latency_ms FROM rounds r LEFT JOIN o ON o.session = r.session AND o.text = trim(regexp_replace(r.text, '^\\s*</?response>\\s*', ''), ' ' || chr(9) || chr(10) || chr(13))"""),
    "tl_alignment": f"WITH {_SESSIONS} SELECT session, coalesce(input_mode = 'upload' AND paused = false AND coalesce(current_time_s, 0) < 0.25 AND loop_count = 0, false) AS aligned FROM sessions",
    "tl_frame_time": "SELECT event_id, nullif(regexp_extract(props, '[-+]?\\d+(?:\\.\\d+)?', 0), '')::DOUBLE AS frame_s FROM events",
    "tl_document": oracle("events_", "SELECT session, CASE WHEN count(*) FILTER (kind = 'query') = 0 THEN NULL ELSE count(*) FILTER (kind = 'query') END AS n_queries, CASE WHEN count(*) FILTER (kind = 'output') = 0 THEN NULL ELSE count(*) FILTER (kind = 'output') END AS n_outputs, arg_min(t_s, seq) FILTER (kind = 'query') AS first_query_s FROM session_events WHERE kind IN ('query', 'output') GROUP BY 1"),
    "iv_merge": oracle("intervals", _ISLANDS + "SELECT session, start_s, end_s, reasons FROM merged"),
    "iv_keep": oracle("intervals", _ISLANDS + """, inside AS (SELECT session, greatest(start_s, 500.0) AS s, least(end_s, 2500.0) AS e FROM merged WHERE least(end_s, 2500.0) - greatest(start_s, 500.0) > 0.001),
marks AS (SELECT session, s AS b, e AS nxt FROM inside WHERE session IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 2500.0, NULL FROM orders),
gaps AS (SELECT session, coalesce(lag(nxt) OVER (PARTITION BY session ORDER BY b, nxt NULLS LAST), 500.0) AS start_s, b AS end_s FROM marks)
SELECT session, start_s, end_s FROM gaps WHERE end_s - start_s > 0.01"""),
    "iv_totals": oracle("intervals", _ISLANDS + "SELECT session, count(*) AS pieces, sum(end_s - start_s) AS total_s FROM merged GROUP BY 1"),
    "iv_value_runs": oracle("events_", _SAMPLES + """, a AS (SELECT *, t_s - lag(t_s) OVER w AS step FROM samples WINDOW w AS (PARTITION BY session ORDER BY seq)),
m AS (SELECT session, coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN step > 0 AND step < 1 THEN step END DESC), 0.04) AS usual, count(*) AS rows, max(removed_s) AS removed_s FROM a GROUP BY 1),
b AS (SELECT a.*, usual, value <= 60 AS low FROM a JOIN m ON m.session = a.session),
c AS (SELECT *, CASE WHEN low AND NOT coalesce(lag(low) OVER w AND step <= greatest(0.12, 2.5 * usual), false) THEN 1 ELSE 0 END AS starts FROM b WINDOW w AS (PARTITION BY session ORDER BY seq)),
e AS (SELECT *, sum(starts) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT session, run, count(*) AS n, min(t_s) AS start_s, max(t_s) AS end_s, max(seq) AS end_seq FROM e WHERE low GROUP BY 1, 2 HAVING max(t_s) - min(t_s) + max(usual) >= 0.1),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY run DESC) = 1),
h AS (SELECT l.session, n, start_s, end_s, arg_min(s.t_s, s.seq) AS rise_s FROM l LEFT JOIN (SELECT * FROM samples WHERE value >= 100) s ON s.session = l.session AND s.seq > end_seq GROUP BY 1, 2, 3, 4)
SELECT m.session, n, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s, round(rise_s, 4) AS rise_s, round(removed_s - rise_s, 4) AS offset_s, CASE WHEN rows < 2 THEN 'too_few' WHEN n IS NULL THEN 'no_marker' WHEN rise_s IS NULL THEN 'no_transition'
 WHEN removed_s - rise_s < -0.25 OR removed_s - rise_s > 30 THEN 'implausible_offset' END AS error FROM m LEFT JOIN h ON h.session = m.session"""),
    "st_loop_unroll": oracle("events_", _SAMPLES + """, j AS (SELECT *, CASE WHEN lag(media_s) OVER (PARTITION BY session ORDER BY seq) - media_s > 0.25 THEN 1 ELSE 0 END AS back FROM samples),
k AS (SELECT *, sum(back) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS loops FROM j) SELECT session, seq, loops, round(loops * 20.0 + media_s, 4) AS timeline_s FROM k"""),
    "st_stalls": oracle("events_", _SAMPLES + """, w AS (SELECT session, seq, t_s, media_s AS progress, t_s AS moved, frame, t_s AS frame_at FROM samples WHERE seq = 1 UNION ALL
SELECT s.session, s.seq, s.t_s, CASE WHEN s.media_s > w.progress + 0.03 OR s.media_s + 0.25 < w.progress THEN s.media_s ELSE w.progress END, CASE WHEN s.media_s > w.progress + 0.03 OR s.media_s + 0.25 < w.progress THEN s.t_s ELSE w.moved END,
 greatest(s.frame, w.frame), CASE WHEN s.frame > w.frame THEN s.t_s ELSE w.frame_at END FROM w JOIN samples s ON s.session = w.session AND s.seq = w.seq + 1)
SELECT session, seq, round(t_s - moved, 4) AS stall_s, round(t_s - frame_at, 4) AS frame_stall_s, round(max(t_s - moved) OVER (PARTITION BY session), 4) AS longest_stall_s, round(max(t_s - frame_at) OVER (PARTITION BY session), 4) AS longest_frame_stall_s FROM w""").replace("WITH ", "WITH RECURSIVE ", 1),
    "st_interrupts": oracle("events_", """, b AS (SELECT *, event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0 OR event_id % 101 = 0 AS hard, hard OR event_id % 41 = 0 OR coalesce(latency_ms > 60, false) AS bad FROM session_events),
c AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY session ORDER BY seq) AS run FROM b),
u AS (SELECT *, t_s - min(t_s) FILTER (WHERE bad) OVER (PARTITION BY session, run) AS unhealthy_s FROM c),
h AS (SELECT session, seq, CASE WHEN hard THEN 'hard_state' WHEN event_id % 41 = 0 THEN 'paused' WHEN event_id % 5 = 0 AND event_id % 6 > 3 THEN 'reconnect_budget' WHEN event_id % 5 = 0 AND latency_ms / 2 > 30 THEN 'reconnect_timeout'
 WHEN bad AND unhealthy_s > 2 THEN 'unhealthy' WHEN latency_ms / 40 > CASE WHEN event_id % 3 > 0 THEN 30 ELSE 2 END THEN 'media_stall' WHEN event_id % 5 <> 0 AND latency_ms / 15 > 5 THEN 'frame_stall' END AS reason FROM u)
SELECT session, arg_min(reason, seq) AS reason, min(seq) AS seq FROM h WHERE reason IS NOT NULL GROUP BY 1"""),
    "st_downtime": oracle("events_", """, n AS (SELECT *, lead(kind) OVER w AS nk, lead(t_s) OVER w AS nt FROM session_events WHERE kind IN ('disconnect', 'resume') WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, count(*) AS outages, round(sum(nt - t_s), 4) AS down_s, round(max(nt - t_s), 4) AS longest_s FROM n WHERE kind = 'disconnect' AND nk = 'resume' GROUP BY 1"""),
    "st_segments": oracle("frames", "SELECT session, floor(start_s / 10.0)::BIGINT AS segment, count(*) AS frames, min(start_s) AS start_s, max(end_s) AS end_s FROM frames GROUP BY 1, 2"),
    "st_session_expiry": oracle("events_", """, n AS (SELECT *, CASE WHEN lag(t_s) OVER w IS NULL OR t_s - lag(t_s) OVER w > 8.0 THEN 1 ELSE 0 END AS new FROM session_events WINDOW w AS (PARTITION BY session ORDER BY seq)),
v AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS visit FROM n) SELECT session, visit, count(*) AS events, round(min(t_s), 4) AS start_s, max(t_s) AS end_s FROM v GROUP BY 1, 2"""),
    "st_last_n": oracle("frames", "SELECT session, position FROM frames QUALIFY row_number() OVER (PARTITION BY session ORDER BY position DESC) <= 5"),
    "st_mode_size": oracle("frames", ", c AS (SELECT session, size_class, count(*) AS n, max(position) AS last FROM frames GROUP BY 1, 2) SELECT session, size_class, n FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, last DESC) = 1"),
    "st_idempotent_event": oracle("events_", "SELECT event_id % 3000 AS event_id, count(*) AS times, count(DISTINCT kind) > 1 AS conflict FROM session_events GROUP BY 1"),
    "st_queue_delay": oracle("events_", """, n AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY seq) AS place FROM session_events WHERE kind IN ('query', 'output'))
SELECT a.session, a.place, round(b.t_s - a.t_s, 4) AS delay_s FROM (SELECT * FROM n WHERE kind = 'query') a LEFT JOIN (SELECT * FROM n WHERE kind = 'output') b ON a.session = b.session AND a.place = b.place"""),
    "st_ack_match": oracle("events_", """SELECT q.session, q.seq, round(arg_min(r.t_s, r.seq), 4) AS ack_t_s FROM (SELECT * FROM session_events WHERE kind = 'query') q LEFT JOIN (SELECT * FROM session_events WHERE kind = 'resume') r
ON r.session = q.session AND r.text = q.text AND r.t_s >= q.t_s GROUP BY q.session, q.seq, q.t_s, q.text"""),
}
