"""Responses of assistants: protocol classes, attribution to timed queries, outcomes per query and session.

Responses: session, t (log time), text; rounds (timed queries): session, rn, turn (time sent), next_turn, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, nfkc, normalised, once, trimmed
from .sweeps import inside_rounds

PREFIX, CLOSER = rf"(?i)^</response>[{SPACES}]*", rf"(?i)</response>[{SPACES}]*\z"
#: Markers and patterns of an answer that only promises one.
DEFERRED_MARKERS = ("需要调用后台模型", "后台处理", "后台模型", "请稍等", "稍后回复", "稍后为您", "</delegation>")
DEFERRED_PATTERNS = (
    "(?:我|这边)?(?:会|将|需要)?继续(?:留意|观察|等待|关注)",
    "(?:警报|告警|提醒|监测|任务|规则)[^。！？]{0,24}(?:已设定|已设置|已开启|已启动|已准备)",
    "(?:如果|若|一旦)[^。！？]{0,100}(?:我会|我将|会立即|将立即)[^。！？]{0,40}(?:提醒|通知|告警)",
    "^(?:好的[，,!！\\s]*)?(?:已收到|收到|明白)[^。！？]{0,80}(?:留意|观察|监测|提醒|通知)",
    "^(?:好的[，,!！\\s]*)?我(?:已准备|会|将)[^。！？]{0,80}(?:留意|观察|监测|提醒|通知)",
    "等(?:待)?[^。！？]{0,40}(?:出现|展示|看到)[^。！？]{0,40}(?:后|之后)[^。！？]{0,20}(?:确认|回复|告诉)",
    "\\b(?:i(?:'ll| will)|let me)\\s+(?:keep|continue)\\s+(?:watching|monitoring|looking)\\b",
    "\\b(?:i(?:'ll| will)|ready to)\\s+(?:alert|notify|monitor|watch)\\b",
    "\\b(?:if|when|once)\\b[^.!?]{0,120}\\b(?:i(?:'ll| will)|we(?:'ll| will))\\b[^.!?]{0,50}\\b(?:alert|notify|inform|tell)\\b",
)


def body(text: Column) -> Column:
    """A response in normal form without its marker in front and a closing one behind."""
    return unmarked(normalised(text))


def unmarked(normal: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(normal, PREFIX, ""), CLOSER, ""))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACES}]+", "")


#: The patterns of the response protocol.
ROLE_LINE = rf"(?i)(?:^|\n)[{SPACES}]*(?:user|assistant|system)[{SPACES}]*:"
ACTION_PREFIX = r"(?i)^<(?:response|silence)>"
SILENCE_ONLY, SILENCE_CONTROL = r"(?i)^<?/?sil[a-z0-9_-]*>?\z", r"(?i)<?/?sil[a-z0-9_-]*>?"
TIMESTAMP_ONLY = r"(?i)^<\s*-?\d+(?:\.\d+)?\s*(?:seconds?|s)(?:\s*(?:~|-)\s*-?\d+(?:\.\d+)?\s*(?:seconds?|s))?\s*>\z"
ERROR_TEXT = rf"(?i)^Error:[{SPACES}]+"
VALID = ("substantive_response", "silence")


def classify_response(text: Column, raw: Column | None = None, provider_error: Column | None = None) -> Column:
    """The class of a response: the first rule that holds. `raw` is the provider's text before any adapter touched it, if known.

    Texts are read in normal form. Only a substantive response counts as an answer; of the others only silence keeps the protocol."""
    failed = F.coalesce(provider_error, F.lit(False)) if provider_error is not None else F.lit(False)
    return _classify(normalised(text), normalised(raw) if raw is not None else F.lit(""), failed)


def _classify(normal: Column, raw: Column, failed: Column) -> Column:
    """The class of a response in normal form."""

    def with_inner(x):
        inner = F.when(x["marked"], trimmed(F.regexp_replace(x["t"], PREFIX, ""))).otherwise(x["t"])
        return once(inner, lambda i: once(F.struct(i.alias("inner"), trimmed(F.regexp_replace(i, CLOSER, "")).alias("content")), lambda y: _classified(x["t"], x["r"], x["marked"], y["inner"], y["content"], failed)))

    # Each form of the text is computed once, not in every rule that reads it.
    return once(F.struct(normal.alias("t"), raw.alias("r")), lambda n: once(F.struct(n["t"].alias("t"), n["r"].alias("r"), n["t"].rlike(PREFIX).alias("marked")), with_inner))


def _classified(t: Column, r: Column, marked: Column, inner: Column, content: Column, failed: Column) -> Column:
    upstream = F.when(r != "", r).otherwise(t)
    return (
        F.when(failed | t.rlike(ERROR_TEXT), "provider_error")
        .when(t == "", "empty_output")
        .when(trimmed(F.regexp_replace(upstream, PREFIX, "")).rlike(ROLE_LINE), "role_transcript_continuation")
        .when((r != "") & (F.lower(r) != "</silence>") & ~r.rlike(PREFIX), F.when(r.rlike(ACTION_PREFIX), "malformed_action_marker").otherwise("missing_response_marker"))
        .when(F.lower(t) == "</silence>", "silence")
        .when(content == "", F.when(marked, "empty_response").otherwise("empty_output"))
        .when(content.rlike(TIMESTAMP_ONLY), "timestamp_only_response")
        .when(F.lower(content) == "</silence>", "response_wrapped_silence")
        .when(squeezed(content).rlike(SILENCE_ONLY), "malformed_silence")
        .when(~marked, "missing_response_marker")
        .when(content.rlike(SILENCE_CONTROL), "mixed_silence_control_token")
        .when(F.lower(inner).contains("</response>"), "unexpected_response_closer")
        .otherwise("substantive_response")
    )


#: A word border as the patterns mean it: only these letters make words, so a word may follow a Chinese one at once.
_BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def is_deferred(text: Column) -> Column:
    return _promises(body(text))


def _promises(said: Column) -> Column:
    def promises(t):
        hit = t.rlike("|".join(f"(?:{p})" for p in DEFERRED_PATTERNS).replace("\\b", _BORDER))
        for marker in DEFERRED_MARKERS:
            hit = hit | t.contains(marker)
        return hit

    return once(F.lower(said), promises)


def normalized_question(text: Column) -> Column:
    """Compatibility normal form without any white space."""
    return squeezed(nfkc(F.coalesce(text, F.lit(""))))


def is_query_echo(response: Column, query: Column) -> Column:
    b = body(response)
    return (b != "") & (normalized_question(b) == normalized_question(query))


def dedupe_responses(df: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal keys per session, in log order."""
    rank = F.row_number().over(Window.partitionBy("session", *keys).orderBy("t"))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def violations(df: DataFrame) -> DataFrame:
    """Invalid responses with their index in the session's log and the hash of the text."""
    rows = df.withColumn("index", F.row_number().over(Window.partitionBy("session").orderBy("t")) - 1).withColumn("violation", classify_response(F.col("text")))
    return rows.filter(~F.col("violation").isin(*VALID)).select("session", "index", "violation", F.sha2("text", 256).alias("text_sha256"))


def first_failure(df: DataFrame) -> DataFrame:
    """First failed response per session. df: session, t, failed, message."""
    return df.filter("failed").groupBy("session").agg(F.min("t").alias("t"), F.min_by("message", "t").alias("message"))


#: A frame belongs to a query from this much before its time.
EARLY_S = 0.001


def evidence(responses: DataFrame) -> DataFrame:
    """Responses with their prompt in compatibility normal form; an empty one is none."""
    return responses.select("session", "t", "event_id", "query_sha256", F.nullif(normalized_question(F.col("prompt")), F.lit("")).alias("prompt"), "frame_s")


def expected(rounds: DataFrame) -> DataFrame:
    """Rounds with what a response to them carries, and the times of the next one."""
    w = Window.partitionBy("session").orderBy("rn")
    return rounds.select("session", "rn", "event_id", F.sha2("text", 256).alias("sha"), normalized_question(F.col("text")).alias("question"), "query_s", F.lead("query_s").over(w).alias("next_s"), "turn", F.lead("turn").over(w).alias("next_turn"))


def attribute_responses(responses: DataFrame, rounds: DataFrame) -> DataFrame:
    """(session, rn, t) for every round that a response belongs to. The first kind of evidence that a response has decides: event id (if the round has one too), query hash,
    prompt text, frame time (if the round has one too), and else the time it came. responses: session, t, event_id, query_sha256, prompt, frame_s; rounds: session, rn, turn, event_id, text, query_s.

    A response has a row in the lane of each kind of evidence that may decide, a round in the lane of each that it has. Lanes of equal keys
    meet all rounds of the key; in lanes of time the last round before a response is the only one whose interval can hold it. Sessions whose rounds go back in time, or lack a time that
    others have, have intervals that overlap, so there a response meets all rounds of its session. A bound that is unknown is open."""
    number = lambda c: F.col(c).cast("double")
    lane = lambda name, key, at: F.struct(F.lit(name).alias("lane"), key.alias("key"), at.alias("at"))
    no_key, no_time = F.lit("").cast("string"), F.lit(None).cast("double")
    r = evidence(responses)
    bare = F.col("query_sha256").isNull() & F.col("prompt").isNull()
    lanes = F.array(
        F.when(F.col("event_id").isNotNull(), lane("event", F.col("event_id").cast("string"), no_time)),
        F.when(F.col("query_sha256").isNotNull(), lane("hash", F.col("query_sha256"), no_time)).when(F.col("prompt").isNotNull(), lane("prompt", F.col("prompt"), no_time)),
        F.when(bare & F.col("frame_s").isNotNull(), lane("frame", no_key, number("frame_s"))),
        F.when(bare & F.col("t").isNotNull(), lane("time", no_key, number("t"))),
    )
    r = r.select("session", F.explode(F.array_compact(lanes)).alias("l"), F.struct("t", "event_id", "frame_s").alias("r"), F.lit(None).cast("boolean").alias("all"))

    q = expected(rounds)
    w = Window.partitionBy("session")
    times = F.coalesce(F.bool_and((F.col("next_turn") >= F.col("turn")) | F.col("next_turn").isNull()).over(w), F.lit(True)) & (F.count("turn").over(w) == F.count(F.lit(1)).over(w))
    frames = F.coalesce(F.bool_and((F.col("next_s") >= F.col("query_s")) | F.col("next_s").isNull()).over(w), F.lit(True)) & F.count("query_s").over(w).isin(F.lit(0), F.count(F.lit(1)).over(w))
    q = q.withColumn("times", times).withColumn("frames", frames)
    lanes = F.array(
        F.when(F.col("event_id").isNotNull(), lane("event", F.col("event_id").cast("string"), no_time)),
        lane("hash", F.col("sha"), no_time),
        lane("prompt", F.col("question"), no_time),
        F.when(F.col("query_s").isNotNull(), lane("frame", no_key, F.when(F.col("frames"), number("query_s") - EARLY_S))),
        lane("time", no_key, F.when(F.col("times"), number("turn"))),
    )
    about = F.struct("rn", "event_id", "query_s", "next_s", "turn", "next_turn")
    q = q.select("session", F.explode(F.array_compact(lanes)).alias("l"), about.alias("q")).withColumn("all", F.col("l.at").isNull())

    rows = r.withColumn("q", F.lit(None).cast(q.schema["q"].dataType)).unionByName(q.withColumn("r", F.lit(None).cast(r.schema["r"].dataType)))
    order = Window.partitionBy("session", "l.lane", "l.key").orderBy(F.col("l.at").asc_nulls_first(), F.col("q").isNull(), "q.rn").rowsBetween(Window.unboundedPreceding, 0)
    every = F.collect_list(F.when(F.col("all"), F.col("q"))).over(order)
    last = F.last(F.when(~F.col("all"), F.col("q")), ignorenulls=True).over(order)
    rows = rows.select("session", F.col("l.lane").alias("lane"), "r", F.concat(every, F.array_compact(F.array(last))).alias("qs")).filter("r IS NOT NULL")
    rows = rows.select("session", "lane", "r", F.explode("qs").alias("q"))
    t, frame = F.col("r.t"), F.col("r.frame_s")
    in_frames = (frame >= F.col("q.query_s") - EARLY_S) & (F.col("q.next_s").isNull() | (frame < F.col("q.next_s") - EARLY_S))
    in_time = (t >= F.col("q.turn")) & (F.col("q.next_turn").isNull() | (t < F.col("q.next_turn")))
    undecided = F.col("r.event_id").isNull() | F.col("q.event_id").isNull()
    good = (
        F.when(F.col("lane") == "event", F.lit(True))
        .when(F.col("lane").isin("hash", "prompt"), undecided)
        .when(F.col("lane") == "frame", undecided & in_frames)
        .otherwise(undecided & (frame.isNull() | F.col("q.query_s").isNull()) & in_time)
    )
    return rows.filter(good).select("session", F.col("q.rn").alias("rn"), F.col("r.t").alias("t"))


def flags(responses: DataFrame, rounds: DataFrame) -> DataFrame:
    """Responses inside each round with what they are: substantive, deferred, echo, and whether they complete the query."""
    rows = inside_rounds(responses, rounds)
    # One row out of a generator: each is computed once and not again in every column that reads it. Normal forms are all that needs Python, so a row goes there once:
    # what a response says, cut out of its normal form, is in normal form too.
    normal = F.struct(normalised(F.col("text")).alias("text"), normalized_question(F.col("query")).alias("query"))
    rows = rows.select("*", F.explode(F.array(normal)).alias("normal"))
    kind = F.when(F.col("t").isNotNull(), _classify(F.col("normal.text"), F.lit(""), F.lit(False)))
    rows = rows.select("*", F.explode(F.array(kind)).alias("kind")).withColumn("substantive", F.coalesce(F.col("kind") == "substantive_response", F.lit(False)))
    said = unmarked(F.when(F.col("substantive"), F.col("normal.text")))
    more = once(said, lambda b: F.struct(F.coalesce(_promises(b), F.lit(False)).alias("deferred"), F.coalesce((b != "") & (squeezed(b) == F.col("normal.query")), F.lit(False)).alias("echo")))
    rows = rows.select("*", F.explode(F.array(more)).alias("m")).select("*", "m.deferred", "m.echo").drop("m", "normal")
    return rows.withColumn("completes", F.col("substantive") & ~F.col("deferred") & ~F.col("echo"))


def query_counts(flagged: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(F.col(c), 1))
    done = F.when(F.col("completes"), F.col("t"))
    return flagged.groupBy("session", "rn").agg(F.count("t").alias("responses"), n("substantive").alias("substantive"), n("deferred").alias("deferred"), n("echo").alias("echo"), n("completes").alias("completed"), F.min(done).alias("first_t"))


def query_outcome(flagged: DataFrame, background: DataFrame) -> DataFrame:
    """Per query: background error, else background answer, else direct answer, else pending. background: session, rn, status (error, ready), t."""
    bg = background.withColumn("priority", F.when(F.col("status") == "error", 1).when(F.col("status") == "ready", 2)).filter("priority IS NOT NULL")
    # The flags are read once: an answer and the fallback come out of the same aggregate.
    own = flagged.groupBy("session", "rn").agg(F.min(F.when(F.col("completes"), F.col("t"))).cast("long").alias("t"))
    answered = F.col("t").isNotNull()
    own = own.select("session", "rn", F.when(answered, "answered").otherwise("pending").alias("status"), "t", F.when(answered, 3).otherwise(4).alias("priority"))
    rows = bg.select("session", "rn", "status", F.col("t").cast("long").alias("t"), "priority").unionByName(own)
    best = rows.groupBy("session", "rn").agg(F.min(F.struct("priority", "t", "status")).alias("b"))
    return best.select("session", "rn", F.col("b.status").alias("outcome"), F.col("b.t").alias("t"))


def background_tasks(events: DataFrame) -> DataFrame:
    """One row per background task: when it started and finished, its last status. events: session, task, t, status (started, ready, error)."""
    done = F.col("status").isin("ready", "error")
    return events.groupBy("session", "task").agg(F.min(F.when(F.col("status") == "started", F.col("t"))).alias("started_t"), F.max(F.when(done, F.col("t"))).alias("finished_t"), F.max_by("status", "t").alias("status"))


def match_background(tasks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Background tasks of a query: the same question, started no earlier than it or at an unknown time. tasks: session, task, question, started_t."""
    a = tasks.withColumn("key", normalized_question(F.col("question")))
    b = rounds.select(F.col("session").alias("q_session"), "rn", "turn", normalized_question(F.col("text")).alias("q_key"))
    return a.join(b.hint("merge"), (F.col("session") == F.col("q_session")) & (F.col("key") == F.col("q_key")) & (F.col("started_t").isNull() | (F.col("started_t") >= F.col("turn")))).select("session", "task", "rn")


def final_wait(outcomes: DataFrame, timeout: float) -> DataFrame:
    """Whether a final response came in time, and how long it took, at least 0. outcomes: session, rn, asked_t, t."""
    wait = F.greatest(F.lit(0.0), (F.col("t") - F.col("asked_t")).cast("double"))
    return outcomes.withColumn("wait", wait).withColumn("result", F.when(F.col("t").isNotNull() & (F.col("wait") <= timeout), "received").otherwise("timeout"))


def session_outcome(waits: DataFrame) -> DataFrame:
    got = F.col("result") == "received"
    n, ok = F.count(F.lit(1)), F.count(F.when(got, 1))
    lists = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("rn"))))
    return waits.groupBy("session").agg(n.alias("queries"), ok.alias("replied"), lists(got).alias("replied_ids"), lists(~got).alias("timed_out_ids"), F.when(ok == n, "complete").when(ok > 0, "partial_timeout").otherwise("timeout").alias("outcome"))


def required_tail(waits: DataFrame, tail: float) -> DataFrame:
    """How long a session must have been recorded: its last answer plus a tail."""
    return waits.groupBy("session").agg((F.max("t") + tail).alias("recorded_until"))


def expected_frame(rounds: DataFrame, responses: DataFrame) -> DataFrame:
    """Frame time a query refers to: that of the last timed response before it plus the time since, else the time since the start.

    A backward as-of join: both kinds of rows in one order, and the last frame time carried on. rounds: session, rn, t; responses: session, t, frame_s."""
    rows = rounds.select("session", "t", F.lit(None).cast("double").alias("frame_s"), "rn", F.lit(1).alias("side")).unionByName(responses.filter("frame_s IS NOT NULL").select("session", "t", F.col("frame_s").cast("double"), F.lit(None).cast("long").alias("rn"), F.lit(0).alias("side")))
    order = Window.partitionBy("session").orderBy("t", "side", "rn")
    known = F.last(F.when(F.col("side") == 0, F.struct("t", "frame_s")), ignorenulls=True).over(order)
    rows = rows.withColumn("k", known).filter("side = 1")
    return rows.select("session", "rn", F.coalesce(F.col("k.frame_s") + (F.col("t") - F.col("k.t")), F.col("t").cast("double")).alias("expected_s"), F.when(F.col("k").isNotNull(), "response").otherwise("stream").alias("source"))


def frame_drift(expected: DataFrame, firsts: DataFrame, most_s: float = 3.0) -> DataFrame:
    """Frame time of the first response minus the expected one; invalid beyond `most_s`. firsts: session, rn, frame_s."""
    d = expected.join(firsts, ["session", "rn"]).withColumn("drift_s", F.col("frame_s") - F.col("expected_s"))
    return d.select("session", "rn", "drift_s", (F.abs("drift_s") > most_s).alias("invalid"))


def backend_identity(observed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Whether the backends that a system answered from are among its aliases. observed: system, backend; profiles: system, aliases, checked."""
    seen = observed.groupBy("system").agg(F.collect_set(F.lower("backend")).alias("seen"), F.count(F.when(F.col("backend").isNull(), 1)).alias("without_name"))
    rows = profiles.join(seen.hint("merge"), "system", "left").withColumn("strange", F.array_except(F.coalesce("seen", F.array().cast("array<string>")), F.transform("aliases", F.lower)))
    status = F.when(~F.col("checked"), "disabled").when(F.coalesce(F.size("seen"), F.lit(0)) <= 0, "missing").when(F.size("strange") > 0, "mismatch").otherwise("verified")
    return rows.select("system", status.alias("status"), F.coalesce("without_name", F.lit(0)).alias("without_name"))


#: The classes of failed calls, and the messages that decide some of them.
DEADLINE_MESSAGE, FRAME_MESSAGE = r"(?i)operation was aborted|timed? out|timeout", r"(?i)Frames yielded inconsistent|smart_resize"


def failure_class(status: Column, deadline: Column, transport: Column) -> Column:
    """Class of a call that failed at an adapter, and whether the infrastructure is worth another try, as a struct."""
    kind = (
        F.when(F.coalesce(deadline, F.lit(False)), "model_latency_timeout").when(status == 429, "provider_rate_limit").when(status >= 500, "provider_service_error")
        .when(F.coalesce(transport, F.lit(False)), "provider_transport_error").when(status.isin(401, 403), "provider_auth_error").otherwise("provider_request_error")
    )
    return F.struct(kind.alias("failure_class"), (~kind.isin("model_latency_timeout", "provider_auth_error")).alias("retryable"))


def session_failure_class(status: Column, deadline: Column, message: Column) -> Column:
    """The same for a call that failed at a session proxy, where messages count; a status of null or 0 is none. Only a deadline is final."""
    m = F.coalesce(message, F.lit(""))
    known = F.nullif(status, F.lit(0))
    kind = (
        F.when(F.coalesce(deadline, F.lit(False)) | m.rlike(DEADLINE_MESSAGE), "model_latency_timeout").when(m.rlike(FRAME_MESSAGE), "provider_frame_preprocessing_error")
        .when(known == 429, "provider_rate_limit").when(known.isNotNull(), "provider_http_error").otherwise("provider_transport_error")
    )
    return F.struct(kind.alias("failure_class"), (kind != "model_latency_timeout").alias("retryable"))


#: Messages of providers that block an account or a key.
BLOCKED = r"(?i)SetLimitExceeded|RateLimitExceeded|QuotaExceeded|AccountOverdue|TooManyRequests|model service has been paused"
KEY_LIMIT = r"(?i)SetLimitExceeded|AccountOverdue|QuotaExceeded|model service has been paused|安全体验模式"


def quota_class(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return F.struct(m.rlike(BLOCKED).alias("temporarily_blocked"), m.rlike(KEY_LIMIT).alias("key_limit"))


def to_marker(text: Column, variant: str) -> Column:
    """Raw provider text in the marked form. `session`: silence tags in any spelling are silence, response tags become the marker; `native`: text that
    starts with a tag stays as it is; `streaming`: one line, of which only the exact tag is silence."""
    t = trimmed(F.coalesce(text, F.lit("")))
    marked = lambda x: F.concat(F.lit("</response> "), x)
    if variant == "native":
        return F.when(t == "", "</silence>").when(t.rlike(r"(?i)^</?(?:response|silence)>"), t).otherwise(marked(t))
    if variant == "streaming":
        line = trimmed(F.regexp_replace(t, r"(?U)[\s\x1C-\x1F]+", " "))
        return F.when(line.isin("", "</silence>"), "</silence>").when(line.startswith("</response>"), line).otherwise(marked(line))
    if variant != "session":
        raise ValueError(variant)
    inner = trimmed(F.regexp_replace(t, r"(?i)^<\s*/?\s*response\s*>\s*", ""))
    quiet = (t == "") | t.rlike(r"(?i)^<\s*/?\s*silence\s*>\z") | (inner == "")
    return F.when(quiet, "</silence>").otherwise(marked(inner))


def message_parts(messages: DataFrame) -> DataFrame:
    """User text and image count of a chat: messages ARRAY<STRUCT<role, parts ARRAY<STRUCT<kind, text>>>>."""
    user = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["parts"]))
    texts = F.transform(F.filter(user, lambda p: p["kind"] == "text"), lambda p: p["text"])
    return messages.select("id", F.array_join(texts, "\n").alias("user_text"), F.size(F.filter(user, lambda p: p["kind"] == "image")).alias("images"))


#: The category of tasks that are delegated, and what a query says that asks for background work.
DELEGATION, ASKS_BACKGROUND = "智能体委托", "后台|异步"


def needs_async(rounds: DataFrame, flagged: DataFrame, matched: DataFrame, end_turn: int) -> DataFrame:
    """Queries that need a tail: of a delegation task, asking for background work, with a background task of their own, deferred by the reply, or sent at or after the end.

    rounds: session, rn, turn, text, category; flagged: of `flags`; matched: of `match_background`."""
    known = flagged.filter("deferred").select("session", "rn").unionByName(matched.select("session", "rn")).distinct().withColumn("known", F.lit(True))
    asked = F.coalesce((F.col("category") == DELEGATION) | F.col("text").rlike(ASKS_BACKGROUND), F.col("category") == DELEGATION, F.col("text").rlike(ASKS_BACKGROUND), F.lit(False))
    out = rounds.join(known.hint("merge"), ["session", "rn"], "left").withColumn("is_async", asked | F.coalesce("known", F.lit(False)))
    return out.select("session", "rn", "is_async", (F.col("is_async") | (F.col("turn") >= end_turn)).alias("tail"))
