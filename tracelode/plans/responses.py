"""Queries over responses: protocol, attribution, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import responses as R
from . import fixtures as X
from .fixtures import oracle


#: Answers beside whole texts, and whether they only promise one.
_PROMISES = {
    "</response>这个问题需要调用后台模型": True, "我会继续观察": True, "火灾警报已设定。": True, "如果看到火，我会立即提醒": True, "\n</response> 好的！已收到，我会留意": True, "我将提醒您": True, "等小狗出现之后确认": True, "Let me keep watching": True, "I'll alert you": True,
    "Once it starts, we will tell you": True, "ＬＥＴ ＭＥ ｋｅｅｐ ｌｏｏｋｉｎｇ": True, "A dog has appeared": False, "已经看到火了": False, "收到了一封信": False, "</delegation>": True, "</response>": False,
}


def _promises():
    n = (F.col("conv_id") * 5 + F.col("turn")) % 19
    return F.coalesce(F.get(F.array(*map(F.lit, _PROMISES)), n.cast("int")), "text")


def _flags(s, d):
    return R.flags(X.responses(s, d), X.rounds(s, d))


def _flow(s, d):
    return X.responses(s, d).withColumnRenamed("turn", "t")


def _evidence(s, d):
    """Responses with whatever evidence of their query they carry, and rounds with theirs."""
    r = X.responses(s, d)
    k = F.col("turn") % 5
    r = r.select("session", F.col("turn").alias("t"), F.when(k == 0, F.concat_ws("-", "session", F.col("turn") - 1)).alias("event_id"), F.when(k == 1, F.sha2("text", 256)).alias("query_sha256"), F.when(k == 2, F.col("text")).alias("prompt"), F.when(k == 3, F.col("turn") - 0.5).alias("frame_s"))
    q = X.rounds(s, d)
    return r, q.select("session", "rn", "turn", "text", F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "session", "turn")).alias("event_id"), F.col("turn").cast("double").alias("query_s"))


_EVID = """, r AS (SELECT session, turn AS t, CASE WHEN turn % 5 = 0 THEN session || '-' || (turn - 1) END AS event_id, CASE WHEN turn % 5 = 1 THEN sha256(text) END AS query_sha256, CASE WHEN turn % 5 = 2 THEN nullif(regexp_replace(text, '\\s+', '', 'g'), '') END AS prompt, CASE WHEN turn % 5 = 3 THEN turn - 0.5 END AS frame_s FROM responses),
q AS (SELECT session, rn, turn, next_turn, sha256(text) AS sha, regexp_replace(text, '\\s+', '', 'g') AS txt, CASE WHEN turn % 2 = 0 THEN session || '-' || turn END AS event_id FROM rounds)
"""


def _background(s, d):
    """Background work: events of tasks numbered within their session."""
    e = X.session_events(s, d)
    return e.select("session", (F.col("event_id") % 7).alias("task"), F.col("seq").alias("t"), F.when(F.col("kind") == "query", "started").when(F.col("kind") == "stalled", "error").when(F.col("kind") == "resume", "ready").alias("status")).filter("status IS NOT NULL")


_BG = ", bg AS (SELECT session, event_id % 7 AS task, seq AS t, CASE kind WHEN 'query' THEN 'started' WHEN 'stalled' THEN 'error' WHEN 'resume' THEN 'ready' END AS status FROM session_events WHERE kind IN ('query', 'stalled', 'resume'))\n"


def _delegated(s, d):
    """Rounds with the category of their task; a word of background work in English asks for none."""
    return X.rounds(s, d).withColumn("category", F.when(F.col("session") % 7 == 0, R.DELEGATION).when(F.col("session") % 7 < 3, "background"))


def _asked_tasks(s, d):
    """Background tasks with the question of a round: started with it, before it, or at an unknown time."""
    k = (F.col("session") + F.col("rn")) % 3
    at = F.when(k == 0, F.col("turn") + 1).when(k == 2, F.col("turn") - 1)
    return X.rounds(s, d).filter("turn % 5 = 0 AND rn % 2 = 0").select("session", F.col("rn").alias("task"), F.col("text").alias("question"), at.alias("started_t"))


def _bg_rounds(s, d):
    r = X.rounds(s, d)
    return r.filter((F.col("session") + F.col("rn")) % 3 == 0).select("session", "rn", F.when(F.col("session") % 2 == 0, "ready").otherwise("error").alias("status"), (F.col("turn") + 5).alias("t"))


def _waits(s, d):
    out = R.query_outcome(_flags(s, d), _bg_rounds(s, d))
    asked = X.rounds(s, d).select("session", "rn", F.col("turn").alias("asked_t"))
    return R.final_wait(out.join(asked.hint("merge"), ["session", "rn"]), 4.0)


def _timed(s, d):
    return X.rounds(s, d).select("session", "rn", F.col("turn").alias("t")), X.responses(s, d).select("session", F.col("turn").alias("t"), F.when(F.col("turn") % 3 != 0, F.col("turn") * 1.5).alias("frame_s"))


def _firsts(s, d):
    return X.responses(s, d).join(X.rounds(s, d).select("session", "rn", F.col("turn").alias("asked"), "next_turn"), "session").filter("turn >= asked AND (next_turn IS NULL OR turn < next_turn)").groupBy("session", "rn").agg(F.min(F.col("turn") * 1.5).alias("frame_s"))


def _calls(s, d):
    e = X.table(s, d, "events")
    k = F.col("event_id") % 9
    # Every eleventh call says in its message that it ran out of time.
    status = F.element_at(F.array(*map(F.lit, [0, 429, 503, 401, 403, 404, 500, 200, 0])), (k + 1).cast("int"))
    message = F.element_at(F.array(*map(F.lit, ["", "TooManyRequests", "AccountOverdue", "x", "quotaexceeded today", "model service has been paused", "安全体验模式", "smart_resize: bad size", "RateLimitExceeded"])), (k + 1).cast("int"))
    return e.select("event_id", status.alias("status"), (F.col("event_id") % 10 == 0).alias("deadline"), (F.col("event_id") % 4 == 0).alias("transport"), F.when(F.col("event_id") % 11 == 0, "Request timed out").otherwise(message).alias("message"))


_CALLS = """calls AS (SELECT event_id, [0, 429, 503, 401, 403, 404, 500, 200, 0][event_id % 9 + 1] AS status, event_id % 10 = 0 AS deadline, event_id % 4 = 0 AS transport,
 ['', 'TooManyRequests', 'AccountOverdue', 'x', 'quotaexceeded today', 'model service has been paused', '安全体验模式', 'smart_resize: bad size', 'RateLimitExceeded'][event_id % 9 + 1] AS message0, CASE WHEN event_id % 11 = 0 THEN 'Request timed out' ELSE message0 END AS message FROM events)"""


def _observed(s, d):
    o = X.table(s, d, "orders")
    return o.select(F.concat(F.lit("s"), (F.col("o_custkey") % 6).cast("string")).alias("system"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("Backend-"), (F.col("o_custkey") % 6).cast("string"))).alias("backend")), s.sql("SELECT concat('s', k) AS system, array(concat('BACKEND-', CASE WHEN k = 2 THEN 'x' ELSE string(k) END)) AS aliases, k <> 4 AS checked FROM (SELECT explode(sequence(0, 7)) AS k)")


def _messages(s, d):
    c = X.table(s, d, "conversations")
    part = F.array(F.struct(F.lit("text").alias("kind"), F.col("text")), F.struct(F.when(F.col("turn") % 2 == 0, "image").otherwise("audio").alias("kind"), F.lit(None).cast("string").alias("text")))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("parts")))).alias("m"))
    return R.message_parts(turns.select(F.col("conv_id").alias("id"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["parts"].alias("parts"))).alias("messages")))


QUERIES = {
    "rsp_classify": lambda s, d: X.responses(s, d).select("session", "turn", R.classify_response(F.col("text")).alias("class")),
    "rsp_deferred": lambda s, d: X.table(s, d, "conversations").select("conv_id", "turn", R.is_deferred(_promises()).alias("deferred")),
    "rsp_echo": lambda s, d: X.rounds(s, d).alias("q").join(X.responses(s, d).select("session", F.col("turn").alias("t"), F.col("text").alias("said")), "session").select("session", "rn", "t", R.is_query_echo(F.col("said"), F.col("text")).alias("echo")),
    "rsp_dedupe": lambda s, d: R.dedupe_responses(_flow(s, d), ["text"]).select("session", "t"),
    "rsp_violations": lambda s, d: R.violations(_flow(s, d)),
    "rsp_first_failure": lambda s, d: R.first_failure(X.session_events(s, d).select("session", F.col("seq").alias("t"), (F.col("kind") == "stalled").alias("failed"), F.col("text").alias("message"))),
    "rsp_attribute": lambda s, d: R.attribute_responses(*_evidence(s, d)),
    "rsp_completes": lambda s, d: _flags(s, d).filter("completes").groupBy("session", "rn").agg(F.min("t").alias("t")),
    "rsp_background": lambda s, d: R.background_tasks(_background(s, d)),
    "rsp_bg_match": lambda s, d: R.match_background(X.rounds(s, d).select("session", F.col("rn").alias("task"), F.col("text").alias("question"), (F.col("turn") + F.when(F.col("rn") % 2 == 0, 1).otherwise(-1)).alias("started_t")), X.rounds(s, d)),
    "rsp_outcome": lambda s, d: R.query_outcome(_flags(s, d), _bg_rounds(s, d)),
    "rsp_async_needed": lambda s, d: R.needs_async(_delegated(s, d), _flags(s, d), R.match_background(_asked_tasks(s, d), X.rounds(s, d)), 6),
    "rsp_query_counts": lambda s, d: R.query_counts(_flags(s, d)),
    "rsp_final_wait": lambda s, d: _waits(s, d).select("session", "rn", "wait", "result"),
    "rsp_session_outcome": lambda s, d: R.session_outcome(_waits(s, d)).select("session", "queries", "replied", F.array_join("timed_out_ids", ",").alias("timed_out"), "outcome"),
    "rsp_tail_required": lambda s, d: R.required_tail(_waits(s, d), 2.5),
    "rsp_expected_frame": lambda s, d: R.expected_frame(*_timed(s, d)),
    "rsp_frame_drift": lambda s, d: R.frame_drift(R.expected_frame(*_timed(s, d)), _firsts(s, d)),
    "rsp_identity": lambda s, d: R.backend_identity(*_observed(s, d)),
    "rsp_failure_class": lambda s, d: _calls(s, d).select("event_id", R.failure_class(F.col("status"), F.col("deadline"), F.col("transport")).alias("f"), R.session_failure_class(F.col("status"), F.col("deadline"), F.col("message")).alias("g")).select("event_id", "f.*", F.col("g.failure_class").alias("session_class"), F.col("g.retryable").alias("session_retryable")),
    "rsp_quota_class": lambda s, d: _calls(s, d).select("event_id", R.quota_class(F.col("message")).alias("q")).select("event_id", "q.*"),
    "rsp_to_marker": lambda s, d: X.responses(s, d).select("session", "turn", *[F.sha2(R.to_marker(F.col("text"), v), 256).alias(v) for v in ("session", "native", "streaming")]).toDF("session", "turn", "session_form", "native_form", "streaming_form"),
    "rsp_message_parts": lambda s, d: _messages(s, d).select("id", F.sha2("user_text", 256).alias("user_text"), "images"),
    "task_name_key": lambda s, d: X.table(s, d, "pages").select("page_id", name_key(F.col("url")).alias("key")),
}
_FORM = "regexp_replace(regexp_replace(translate({}, '＜／ｓｉｌｅｎｃｅ＞', '</silence>'), '\\r\\n?', chr(10), 'g'), '^[\\s\u3000]+|[\\s\u3000]+$', '', 'g')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_INNER = _STRIP.format(f"regexp_replace({_FORM}, '^</response>\\s*', '', 'i')")
_BODY = _STRIP.format(f"regexp_replace({_INNER}, '</response>\\s*$', '', 'i')")
_CLASS = f"""CASE WHEN regexp_matches({_FORM}, '^Error:\\s', 'i') THEN 'provider_error' WHEN {_FORM} = '' THEN 'empty_output' WHEN regexp_matches({_INNER}, '(^|\\n)\\s*(user|assistant|system)\\s*:', 'i') THEN 'role_transcript_continuation'
 WHEN lower({_FORM}) = '</silence>' THEN 'silence' WHEN {_BODY} = '' THEN CASE WHEN regexp_matches({_FORM}, '^</response>', 'i') THEN 'empty_response' ELSE 'empty_output' END WHEN regexp_matches({_BODY}, '^<[0-9.]+ seconds>$') THEN 'timestamp_only_response'
 WHEN regexp_matches(regexp_replace({_BODY}, '\\s+', '', 'g'), '^<?/?sil[a-z0-9_-]*>?$', 'i') THEN 'malformed_silence' WHEN NOT regexp_matches({_FORM}, '^</response>', 'i') THEN 'missing_response_marker'
 WHEN regexp_matches({_BODY}, '<?/?sil[a-z0-9_-]*>?', 'i') THEN 'mixed_silence_control_token' WHEN contains(lower({_INNER}), '</response>') THEN 'unexpected_response_closer' ELSE 'substantive_response' END""".replace("{}", "text")
_SQ = f"regexp_replace({_BODY}, '\\s+', '', 'g')"
_FLAGS = f""", f AS (SELECT q.session, q.rn, q.turn, r.turn AS t, coalesce(({_CLASS.replace("text", "r.text")}) = 'substantive_response', false) AND r.turn IS NOT NULL AS substantive,
 coalesce({_SQ.format("r.text")} = regexp_replace(q.text, '\\s+', '', 'g'), false) AS same FROM rounds q LEFT JOIN responses r ON r.session = q.session AND r.turn >= q.turn AND (q.next_turn IS NULL OR r.turn < q.next_turn))
"""
_OUT = _FLAGS + """, bg AS (SELECT session, rn, CASE WHEN session % 2 = 0 THEN 'ready' ELSE 'error' END AS status, turn + 5 AS t FROM rounds WHERE (session + rn) % 3 = 0),
direct AS (SELECT session, rn, min(t) AS t FROM f WHERE substantive AND NOT same GROUP BY 1, 2),
outc AS (SELECT q.session, q.rn, q.turn AS asked_t, coalesce(bg.status, CASE WHEN direct.t IS NOT NULL THEN 'answered' ELSE 'pending' END) AS outcome, coalesce(bg.t, direct.t) AS t FROM rounds q LEFT JOIN bg ON bg.session = q.session AND bg.rn = q.rn LEFT JOIN direct ON direct.session = q.session AND direct.rn = q.rn),
waits AS (SELECT *, greatest(0.0, (t - asked_t)::DOUBLE) AS wait, CASE WHEN t IS NOT NULL AND greatest(0.0, (t - asked_t)::DOUBLE) <= 4 THEN 'received' ELSE 'timeout' END AS result FROM outc)
"""
_EXP = """, known AS (SELECT session, turn AS t, turn * 1.5 AS frame_s FROM responses WHERE turn % 3 <> 0),
expd AS (SELECT q.session, q.rn, CASE WHEN max(k.t) IS NULL THEN q.turn::DOUBLE ELSE arg_max(k.frame_s, k.t) + (q.turn - max(k.t)) END::DOUBLE AS expected_s, CASE WHEN max(k.t) IS NULL THEN 'stream' ELSE 'response' END AS source FROM rounds q LEFT JOIN known k ON k.session = q.session AND k.t <= q.turn GROUP BY q.session, q.rn, q.turn)
"""
ORACLES = {
    "rsp_classify": oracle("responses", f"SELECT session, turn, {_CLASS} AS class FROM responses"),
    "rsp_deferred": f"SELECT conv_id, turn, coalesce([{', '.join(map(str, _PROMISES.values()))}][(conv_id * 5 + turn) % 19 + 1], false) AS deferred FROM conversations",
    "rsp_echo": oracle("rounds responses", f"SELECT q.session, rn, r.turn AS t, ({_SQ.format('r.text')} <> '' AND {_SQ.format('r.text')} = regexp_replace(q.text, '\\s+', '', 'g')) AS echo FROM rounds q JOIN responses r ON r.session = q.session"),
    "rsp_dedupe": oracle("responses", "SELECT session, min(turn) AS t FROM responses GROUP BY session, text"),
    "rsp_violations": oracle("responses", f'SELECT session, i AS "index", class AS violation, sha256(text) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS i, {_CLASS} AS class FROM responses) WHERE class NOT IN (\'silence\', \'substantive_response\')'),
    "rsp_first_failure": oracle("events_", "SELECT session, min(seq) AS t, arg_min(text, seq) AS message FROM session_events WHERE kind = 'stalled' GROUP BY 1"),
    "rsp_attribute": oracle("rounds responses", _EVID + """SELECT r.session, rn, t FROM r JOIN q ON q.session = r.session AND CASE WHEN r.event_id IS NOT NULL AND q.event_id IS NOT NULL THEN r.event_id = q.event_id WHEN query_sha256 IS NOT NULL THEN query_sha256 = sha WHEN prompt IS NOT NULL THEN prompt = txt
 WHEN frame_s IS NOT NULL THEN frame_s >= turn - 0.001 AND (next_turn IS NULL OR frame_s < next_turn - 0.001) ELSE t >= turn AND (next_turn IS NULL OR t < next_turn) END"""),
    "rsp_completes": oracle("rounds responses", _FLAGS + "SELECT session, rn, min(t) AS t FROM f WHERE substantive AND NOT same GROUP BY 1, 2"),
    "rsp_background": oracle("events_", _BG + "SELECT session, task, min(t) FILTER (status = 'started') AS started_t, max(t) FILTER (status <> 'started') AS finished_t, arg_max(status, t) AS status FROM bg GROUP BY 1, 2"),
    "rsp_bg_match": oracle("rounds", "SELECT a.session, a.rn AS task, b.rn FROM rounds a JOIN rounds b ON a.session = b.session AND regexp_replace(a.text, '\\s+', '', 'g') = regexp_replace(b.text, '\\s+', '', 'g') AND a.turn + CASE WHEN a.rn % 2 = 0 THEN 1 ELSE -1 END >= b.turn"),
    "rsp_outcome": oracle("rounds responses", _OUT + "SELECT session, rn, outcome, t FROM outc"),
    "rsp_async_needed": oracle("rounds", "SELECT session, rn, session % 7 = 0 OR turn % 5 = 0 AND rn % 2 = 0 AND (session + rn) % 3 <> 2 AS is_async, session % 7 = 0 OR turn % 5 = 0 AND rn % 2 = 0 AND (session + rn) % 3 <> 2 OR turn >= 6 AS tail FROM rounds"),
    "rsp_query_counts": oracle("rounds responses", _FLAGS + "SELECT session, rn, count(t) AS responses, count(*) FILTER (substantive) AS substantive, 0 AS deferred, count(*) FILTER (substantive AND same) AS echo, count(*) FILTER (substantive AND NOT same) AS completed, min(t) FILTER (substantive AND NOT same) AS first_t FROM f GROUP BY 1, 2"),
    "rsp_final_wait": oracle("rounds responses", _OUT + "SELECT session, rn, CASE WHEN t IS NULL THEN 0.0 ELSE wait END AS wait, result FROM waits"),
    "rsp_session_outcome": oracle("rounds responses", _OUT + """SELECT session, count(*) AS queries, count(*) FILTER (result = 'received') AS replied, coalesce(string_agg(rn::VARCHAR, ',' ORDER BY rn) FILTER (result <> 'received'), '') AS timed_out,
 CASE WHEN count(*) FILTER (result = 'received') = count(*) THEN 'complete' WHEN count(*) FILTER (result = 'received') > 0 THEN 'partial_timeout' ELSE 'timeout' END AS outcome FROM waits GROUP BY 1"""),
    "rsp_tail_required": oracle("rounds responses", _OUT + "SELECT session, max(t) + 2.5::DOUBLE AS recorded_until FROM waits GROUP BY 1"),
    "rsp_expected_frame": oracle("rounds responses", _EXP + "SELECT session, rn, expected_s, source FROM expd"),
    "rsp_frame_drift": oracle("rounds responses", _EXP + """, firsts AS (SELECT q.session, q.rn, min(r.turn * 1.5)::DOUBLE AS frame_s FROM rounds q JOIN responses r ON r.session = q.session AND r.turn >= q.turn AND (q.next_turn IS NULL OR r.turn < q.next_turn) GROUP BY 1, 2)
SELECT e.session, e.rn, frame_s - expected_s AS drift_s, abs(frame_s - expected_s) > 3 AS invalid FROM expd e JOIN firsts f ON f.session = e.session AND f.rn = e.rn"""),
    "rsp_identity": """WITH p AS (SELECT unnest(range(8)) AS k), o AS (SELECT 's' || (o_custkey % 6) AS system, count(*) FILTER (o_orderkey % 9 = 0) AS n, count(*) FILTER (o_orderkey % 9 <> 0) AS named FROM orders GROUP BY 1)
SELECT 's' || k AS system, CASE WHEN k = 4 THEN 'disabled' WHEN coalesce(named, 0) = 0 THEN 'missing' WHEN k = 2 THEN 'mismatch' ELSE 'verified' END AS status, coalesce(n, 0) AS without_name FROM p LEFT JOIN o ON o.system = 's' || k""",
    "rsp_failure_class": f"WITH {_CALLS}, c AS (SELECT event_id, CASE WHEN deadline THEN 'model_latency_timeout' WHEN status = 429 THEN 'provider_rate_limit' WHEN status >= 500 THEN 'provider_service_error' WHEN transport THEN 'provider_transport_error' WHEN status IN (401, 403) THEN 'provider_auth_error' ELSE 'provider_request_error' END AS failure_class, CASE WHEN deadline OR message = 'Request timed out' THEN 'model_latency_timeout' WHEN message LIKE 'smart_resize%' THEN 'provider_frame_preprocessing_error' WHEN status = 429 THEN 'provider_rate_limit' WHEN status <> 0 THEN 'provider_http_error' ELSE 'provider_transport_error' END AS session_class FROM calls) SELECT *, failure_class NOT IN ('model_latency_timeout', 'provider_auth_error') AS retryable, session_class <> 'model_latency_timeout' AS session_retryable FROM c",
    "rsp_quota_class": f"WITH {_CALLS} SELECT event_id, regexp_matches(message, 'SetLimitExceeded|RateLimitExceeded|QuotaExceeded|AccountOverdue|TooManyRequests|model service has been paused', 'i') AS temporarily_blocked, regexp_matches(message, 'SetLimitExceeded|AccountOverdue|QuotaExceeded|model service has been paused|安全体验模式', 'i') AS key_limit FROM calls",
    "rsp_to_marker": oracle("responses", r""", c AS (SELECT session, turn, regexp_replace(text, '^[\s　]+|[\s　]+$', '', 'g') AS t FROM responses), e AS (SELECT *, regexp_replace(regexp_replace(t, '^<\s*/?\s*response\s*>\s*', '', 'i'), '^\s+|\s+$', '', 'g') AS inn, regexp_replace(t, '[\s　]+', ' ', 'g') AS line FROM c)
SELECT session, turn, sha256(CASE WHEN inn = '' OR regexp_matches(t, '^<\s*/?\s*silence\s*>$', 'i') THEN '</silence>' ELSE '</response> ' || inn END) AS session_form,
 sha256(CASE WHEN t = '' THEN '</silence>' WHEN regexp_matches(t, '^</?(response|silence)>', 'i') THEN t ELSE '</response> ' || t END) AS native_form, sha256(CASE WHEN line IN ('', '</silence>') THEN '</silence>' WHEN starts_with(line, '</response>') THEN line ELSE '</response> ' || line END) AS streaming_form FROM e"""),
    "rsp_message_parts": "SELECT conv_id AS id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '')) AS user_text, count(*) FILTER (role = 'user' AND turn % 2 = 0) AS images FROM conversations GROUP BY 1",
    "task_name_key": "SELECT page_id, lower(regexp_replace(nfc_normalize(url), '[\\s_—–-]+', '', 'g')) AS key FROM pages",
}
