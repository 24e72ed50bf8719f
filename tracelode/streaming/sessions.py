"""Stream forms of the session operators. The batch result over the same rows is what each comes to, once the watermark has passed them.

Events carry `ts` (event time) besides session and seq. Sequential operators are folds in log order that end with their session (`ordered.ordered_fold`): a row is taken once
the watermark has passed it, `lateness` behind the latest, and a session ends `idle` after its last row. Rows that come later than the watermark
allows are on the side table of `ordered.divide_late`, not in a result.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import by_request, merge_intervals, segment_step, stall_step
from ..operators.responses import EARLY_S, normalized_question
from .ordered import ordered_fold

LATENESS, IDLE = "1 hour", "1 day"


def dedupe_responses(stream: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session", *keys])


def idempotent_events(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def visits(stream: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Visits of a session, closed by a pause of `gap`."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", lateness).groupBy("session", w).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def ack_match(requests: DataFrame, acks: DataFrame, within: str = "1 hour") -> DataFrame:
    """Every acknowledgement of the same text within `within` of a request; null if none comes. Both: session, ts, text."""
    a = acks.withWatermark("ts", within).select(F.col("session").alias("a_session"), F.col("text").alias("a_text"), F.col("ts").alias("ack_ts"))
    r = requests.withWatermark("ts", within)
    on = (F.col("session") == F.col("a_session")) & (F.col("text") == F.col("a_text")) & (F.col("ack_ts") >= F.col("ts")) & (F.col("ack_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return r.join(a, on, "left_outer").select("session", "ts", "text", "ack_ts")


BACKGROUND = "session long, task long, started_t double, finished_t double, status string"


def background_tasks(stream: DataFrame, lateness: str = LATENESS, idle: str = "30 days") -> DataFrame:
    """The row of each background task, once no event of it has come for `idle`. stream: session, task, seq, ts, t, status (started, ready, error)."""

    def step(key, state, pdf):
        started, finished, status, at = state
        for t, s in zip(pdf["t"], pdf["status"]):
            if s == "started":
                started = t if started is None else min(started, t)
            elif s in ("ready", "error"):
                finished = t if finished is None else max(finished, t)
            if at is None or t >= at:
                status, at = s, t
        return (started, finished, status, at), []

    def finish(key, state):
        return [(*key, *state[:3])]

    return ordered_fold(stream, ["session", "task"], ["seq", "t", "status"], step, BACKGROUND, "started double, finished double, status string, at double", (None,) * 4, lateness, idle, finish)


#: Event types that open and close an outage.
PROGRESS, STALLED = "local_rtsp_relay_progress", ("local_rtsp_relay_failed", "local_rtsp_relay_output_stalled")
DISCONNECTED = "capture_stream_disconnected"
RESUMED = ("local_rtsp_publisher_timeline_resumed", "local_rtsp_relay_resumed", "capture_stream_reconnect_ready")
OUTAGE = "session long, start_s double, end_s double, start_position_s double, reasons array<string>"
_CLOSED = "session long, start_s double, end_s double, start_position_s double, reason string"
#: State: open since, position of the source then, reasons; time and position of the last progress.
_QUIET = (None, None, "", None, None)


def outage_step(state: tuple, kind: str, t_ms: float, position_s: float | None) -> tuple[tuple, tuple | None]:
    """One event: the new state and an outage that it closes.

    A stall is dated back to when the source had been delivered; an earlier start extends an open outage."""
    start, position, reasons, seen_ms, seen_s = state
    if kind == PROGRESS and position_s is not None:
        return (start, position, reasons, t_ms, position_s), None
    if kind in STALLED or kind == DISCONNECTED:
        begin = t_ms
        if kind in STALLED and seen_ms is not None and position_s is not None:
            begin = min(t_ms, seen_ms + max(0.0, position_s - seen_s) * 1000)
        start, position = (begin, position_s) if start is None else (min(start, begin), position)
        return (start, position, reasons if kind in reasons.split(",") else f"{reasons},{kind}".strip(","), seen_ms, seen_s), None
    if kind in RESUMED and start is not None and t_ms > start:
        reasons = reasons if kind in reasons.split(",") else f"{reasons},{kind}".strip(",")
        return (None, None, "", seen_ms, seen_s), (start / 1000, t_ms / 1000, position, reasons)
    return state, None


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def _outages(key, state, pdf):
    out = []
    for kind, t, p in pdf[["type", "t_ms", "source_position_s"]].itertuples(index=False):
        if _number(t) is not None:
            state, closed = outage_step(state, kind, float(t), _number(p))
            out += [(key[0], *closed)] if closed else []
    return state, out


def closed_outages(events: DataFrame) -> DataFrame:
    """Outages as their ends come in the log, one pass over each session's own events. events: session, seq, t_ms, type, source_position_s."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_outages(key, _QUIET, pdf.sort_values("seq"))[1], columns=["session", "start_s", "end_s", "start_position_s", "reason"])

    return events.groupBy("session").applyInPandas(run, _CLOSED)


def merged_outages(closed: DataFrame) -> DataFrame:
    """Outages that overlap, as one that was dated back can, become one with the reasons of all."""
    return merge_intervals(closed.withColumn("reasons", F.split("reason", ",")).drop("reason")).select("session", "start_s", "end_s", "start_position_s", "reasons")


def outages(events: DataFrame) -> DataFrame:
    """Outages of finished sessions."""
    return merged_outages(closed_outages(events))


def outages_stream(stream: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """`closed_outages` while sessions run; the open outage is the state. `merged_outages` over what has come out makes them whole."""
    return ordered_fold(stream, ["session"], ["seq", "type", "t_ms", "source_position_s"], _outages, _CLOSED, "start double, position double, reasons string, seen_ms double, seen_s double", _QUIET, lateness, idle)


STALL = "session long, seq long, stall_s double, frame_stall_s double"


def stalls_stream(stream: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """`intervals.stalls` while sessions run. stream: session, seq, ts, t_s, media_s, frame."""

    def step(key, state, pdf):
        out = []
        for seq, t, media, frame in pdf[["seq", "t_s", "media_s", "frame"]].itertuples(index=False):
            state = stall_step(state, t, _number(media), _number(frame))
            out.append((key[0], seq, None if state[0] is None else t - state[0], None if state[2] is None else t - state[2]))
        return state, out

    return ordered_fold(stream, ["session"], ["seq", "t_s", "media_s", "frame"], step, STALL, "at double, value double, frame_at double, frames double", (None,) * 4, lateness, idle)


CLOCK = "session long, seq long, media_ms double"


def _clock(key, state, pdf):
    """Anchor, wall time of the anchor, last value."""
    anchor, origin, last = state
    out = []
    for seq, wall, inbound, query, queued in pdf[["seq", "wall_ms", "inbound_ms", "query_ms", "queued_ms"]].itertuples(index=False):
        inbound, query, queued = _number(inbound), _number(query), _number(queued)
        if query is not None and query >= 0:
            # The clock runs from when the query was queued, not from when its frame is sent.
            anchor, origin, last = query, wall if queued is None else queued, query
        else:
            if anchor is None:
                anchor, origin = inbound or 0.0, wall
            value = max(anchor + max(0.0, wall - origin), inbound or 0.0)
            last = value if last is None else max(value, last + 1.0)
        out.append((key[0], seq, last))
    return (anchor, origin, last), out


#: Policies of the clock: anchored at queries, or the inbound time of each turn as it is.
ANCHORED, INBOUND_TURN = "anchored", "inbound-turn"


def media_clock(frames: DataFrame, policy: str = ANCHORED) -> DataFrame:
    """An anchored clock: a query's exact time is its value and sets the anchor at the time it was queued; else it is anchor plus elapsed, at least the inbound time and the last value plus 1 ms.
    frames: session, seq, wall_ms, inbound_ms, query_ms and queued_ms (null without a query). Each value depends on the one before, so a session is one pass; with the policy
    of inbound turns none does."""
    if policy == INBOUND_TURN:
        return frames.select("session", "seq", F.col("inbound_ms").cast("double").alias("media_ms"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_clock(key, (None,) * 3, pdf.sort_values("seq"))[1], columns=["session", "seq", "media_ms"])

    return frames.groupBy("session").applyInPandas(run, CLOCK)


def media_clock_stream(stream: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """The same while sessions run. stream: session, seq, ts, wall_ms, inbound_ms, query_ms, queued_ms."""
    return ordered_fold(stream, ["session"], ["seq", "wall_ms", "inbound_ms", "query_ms", "queued_ms"], _clock, CLOCK, "anchor double, origin double, last double", (None,) * 3, lateness, idle)


#: Control tokens of a model that speaks in rounds, and the forms that its output takes.
START, END, ANSWER, QUIET = "<|round_start|>", "<|round_end|>", "<|response|>", "<|silence|>"
SILENCE, RESPONSE = "</silence>", "</response>"
_TOKEN = re.compile("|".join(map(re.escape, (START, END, ANSWER, QUIET))))


def _line(text: str) -> str:
    return " ".join(_TOKEN.sub("", text).split())


def take_rounds(pending: str, chunk: str) -> tuple[str, list[str]]:
    """What is still open once `chunk` has come after `pending`, and the texts that are complete; a silence is an empty text.

    A round runs from its start to its end, or to a silence inside; text outside of rounds is complete when a round or a silence follows."""
    pending, done = pending + chunk, []
    while True:
        start, quiet = pending.find(START), pending.find(QUIET)
        if start >= 0 and (quiet < 0 or start < quiet):
            if outside := _line(pending[:start]):
                done.append(outside)
            pending = pending[start:]
            end, quiet = pending.find(END), pending.find(QUIET)
            if end >= 0:
                cut = end + len(END)
            elif quiet >= 0:
                cut = quiet + len(QUIET)
            else:
                return pending, done
            done.append(_line(pending[:cut]))
            pending = pending[cut:]
        elif quiet >= 0:
            if outside := _line(pending[:quiet]):
                done.append(outside)
            done.append("")
            pending = pending[quiet + len(QUIET) :]
        else:
            return pending, done


def _polled(done: list[str]) -> str:
    """The answer to one poll: its texts in one line behind the marker, or silence."""
    texts = [t.removeprefix(RESPONSE).strip() for t in done if t and t != SILENCE]
    text = " ".join(t for t in texts if t)
    return SILENCE if not texts or not text or text == SILENCE else text if text.startswith(RESPONSE) else f"{RESPONSE} {text}"


ROUNDS = "session long, poll long, content string"


def _rounds(key, state, pdf):
    """State: the open text, and the poll whose answer has not been given with the texts complete in it."""
    pending, poll, done = state[0], state[1], [] if state[2] is None else list(state[2])
    out = []

    def ended():
        nonlocal pending, done
        if START not in pending:
            # Only an unfinished round waits for the next poll.
            done, pending = [*done, *([x] if (x := _line(pending)) else [])], ""
        out.append((key[0], poll, _polled(done)))
        done = []

    for at, text in pdf[["poll", "text"]].itertuples(index=False):
        if poll is not None and at != poll:
            ended()
        poll = at
        pending, new = take_rounds(pending, text or "")
        done += new
    return (pending, poll, done), (out, ended)


def assemble_rounds(chunks: DataFrame) -> DataFrame:
    """The answer to each poll out of chunks of text in which control tokens open and close rounds; a token may be cut by a chunk's border, and an open round is carried over
    to the next poll. chunks: session, seq, poll, text."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, (out, ended) = _rounds(key, ("", None, None), pdf.sort_values("seq"))
        ended()
        return pd.DataFrame(out, columns=["session", "poll", "content"])

    return chunks.groupBy("session").applyInPandas(run, ROUNDS)


def assemble_rounds_stream(stream: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """The same while sessions run: a poll is answered when the first chunk of the next one comes, the last one when its session ends. stream: session, seq, ts, poll, text."""

    def step(key, state, pdf):
        now, (out, _) = _rounds(key, state, pdf)
        return (now[0], int(now[1]), now[2]), out

    def finish(key, state):
        _, (out, ended) = _rounds(key, state, pd.DataFrame({"poll": [], "text": []}))
        ended()
        return out

    return ordered_fold(stream, ["session"], ["seq", "poll", "text"], step, ROUNDS, "pending string, poll long, done array<string>", ("", None, None), lateness, idle, finish)


SEGMENT = "session long, segment long, frames long, start_s double, end_s double"


def segments_stream(stream: DataFrame, seconds: float, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """`intervals.segments` while sessions run. The buffer of frames, the segment clock and the frames of the last request are the state: that request is taken when the next
    one comes, or with the end of the stream when the session ends. stream: session, seq (order of arrival), ts, request, start_s, end_s."""

    def step(key, state, pdf):
        starts, ends, at, request, held_starts, held_ends = state
        pending, out = list(zip(starts or [], ends or [])), []
        held = list(zip(held_starts or [], held_ends or []))
        for number, frames in by_request(pdf[["request", "start_s", "end_s"]].itertuples(index=False)):
            if request is not None and number != request:
                pending, at, new = segment_step(pending, at, held, seconds, False)
                out += new
                held = []
            request, held = number, [*held, *frames]
        return ([p[0] for p in pending], [p[1] for p in pending], at, request, [h[0] for h in held], [h[1] for h in held]), [(key[0], *x) for x in out]

    def finish(key, state):
        starts, ends, at, _, held_starts, held_ends = state
        return [(key[0], *x) for x in segment_step(list(zip(starts or [], ends or [])), at, list(zip(held_starts or [], held_ends or [])), seconds, True)[2]]

    state = "starts array<double>, ends array<double>, at double, request long, held_starts array<double>, held_ends array<double>"
    return ordered_fold(stream, ["session"], ["seq", "request", "start_s", "end_s"], step, SEGMENT, state, (None,) * 6, lateness, idle, finish)


ATTRIBUTED = "session long, rn long, t long"
_SAID, _ASKED = ("t", "event_id", "sha", "question", "at"), ("rn", "turn", "event_id", "sha", "question", "at")


def _listed(kept: str | None) -> list[tuple]:
    """Rows that a state keeps as JSON."""
    return [tuple(x) for x in json.loads(kept or "[]")]


def belongs(said: tuple, asked: tuple, following: tuple | None) -> bool:
    """Whether a response (time, event id, hash, prompt, frame time) is to a round (number, time, event id, hash, question, frame time), given the round after it."""
    t, event_id, sha, prompt, frame_s = said
    _, turn, q_event, q_sha, question, query_s = asked
    next_turn, next_s = (following[1], following[5]) if following else (None, None)
    if event_id is not None and q_event is not None:
        return event_id == q_event
    if sha is not None:
        return sha == q_sha
    if prompt is not None:
        return prompt == question
    if frame_s is not None and query_s is not None:
        return frame_s >= query_s - EARLY_S and (next_s is None or frame_s < next_s - EARLY_S)
    return t is not None and turn is not None and t >= turn and (next_turn is None or t < next_turn)


def attribute_stream(responses: DataFrame, rounds: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """`responses.attribute_responses` while sessions run. Both streams carry seq and ts, which order them in a session's log, rounds in the order of rn.

    The rounds and the evidence of the responses are the state, as evidence other than time may name any round of the session. A round is
    complete when the next one comes or the session ends; a pair is decided when its round is complete and its response is there, so each comes out once."""
    none = lambda kind: F.lit(None).cast(kind)
    when = ["session", "seq", "ts"]
    key = F.nullif(normalized_question(F.col("prompt")), F.lit(""))
    r = responses.select(*when, none("long").alias("rn"), none("long").alias("turn"), F.col("t").cast("long").alias("t"), "event_id", F.col("query_sha256").alias("sha"), key.alias("question"), F.col("frame_s").cast("double").alias("at"))
    q = rounds.select(*when, F.col("rn").cast("long").alias("rn"), F.col("turn").cast("long").alias("turn"), none("long").alias("t"), "event_id", F.sha2("text", 256).alias("sha"), normalized_question(F.col("text")).alias("question"), F.col("query_s").cast("double").alias("at"))

    def step(key, state, pdf):
        (asked, said), out = map(_listed, state), []
        for row in pdf.to_dict("records"):
            if row["rn"] is not None:
                asked.append(tuple(row[c] for c in _ASKED))
                out += [(key[0], asked[-2][0], x[0]) for x in said if belongs(x, asked[-2], asked[-1])] if len(asked) > 1 else []
            else:
                said.append(tuple(row[c] for c in _SAID))
                out += [(key[0], a[0], said[-1][0]) for a, b in zip(asked, asked[1:]) if belongs(said[-1], a, b)]
        return (json.dumps(asked), json.dumps(said)), out

    def finish(key, state):
        asked, said = map(_listed, state)
        return [(key[0], asked[-1][0], x[0]) for x in said if belongs(x, asked[-1], None)] if asked else []

    return ordered_fold(q.unionByName(r), ["session"], ["seq", "rn", "turn", "t", "event_id", "sha", "question", "at"], step, ATTRIBUTED, "asked string, said string", (None, None), lateness, idle, finish)


MATCHED = "session long, task long, rn long"


def match_background_stream(tasks: DataFrame, rounds: DataFrame, lateness: str = LATENESS, idle: str = IDLE) -> DataFrame:
    """`responses.match_background` while sessions run: a pair comes out when the later of its rows has come. tasks: session, seq, ts, task, question, started_t; rounds: session, seq, ts, rn, turn, text."""
    none = F.lit(None).cast("long")
    a = tasks.select("session", "seq", "ts", F.col("task").cast("long").alias("task"), none.alias("rn"), F.col("started_t").cast("double").alias("at"), normalized_question(F.col("question")).alias("question"))
    b = rounds.select("session", "seq", "ts", none.alias("task"), F.col("rn").cast("long").alias("rn"), F.col("turn").cast("double").alias("at"), normalized_question(F.col("text")).alias("question"))

    def step(key, state, pdf):
        (started, asked), out = map(_listed, state), []
        for row in pdf.to_dict("records"):
            mine = (row["rn"] if row["task"] is None else row["task"], row["at"], row["question"])
            others = started if row["task"] is None else asked
            for other in others:
                task, query = (other, mine) if row["task"] is None else (mine, other)
                if task[2] == query[2] and (task[1] is None or query[1] is not None and task[1] >= query[1]):
                    out.append((key[0], task[0], query[0]))
            (asked if row["task"] is None else started).append(mine)
        return (json.dumps(started), json.dumps(asked)), out

    return ordered_fold(a.unionByName(b), ["session"], ["seq", "task", "rn", "at", "question"], step, MATCHED, "started string, asked string", (None, None), lateness, idle)
