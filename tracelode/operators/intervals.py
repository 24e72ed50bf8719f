"""Intervals and clocks within sessions: merging, complements, stalls, downtime, loops.

Every operator works on partitions by session and running frames; none looks at more than one session at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOUCH_S = 0.001


def merge_intervals(df: DataFrame, min_s: float = 0.001, touch_s: float = TOUCH_S) -> DataFrame:
    """Intervals of a session that overlap or touch become one; shorter ones than `min_s` do not count. Reasons (`reason`, or lists of them in `reasons`)
    in the order in which they are first met; null and empty ones do not count. Other columns come from an island's first interval.

    A new island starts where the start lies beyond the greatest end so far, not just the end before."""
    rows = df.filter(F.col("end_s") - F.col("start_s") >= min_s)
    if "reasons" not in df.columns:
        rows = rows.withColumn("reasons", F.array("reason")).drop("reason")
    more = [c for c in rows.columns if c not in ("session", "start_s", "end_s", "reasons")]
    order = Window.partitionBy("session").orderBy("start_s", "end_s", "reasons")
    upto = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce(F.col("start_s") > upto + touch_s, F.lit(True)).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(order)).withColumn("__n", F.row_number().over(order))
    reasons = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", "reasons"))), lambda x: x["reasons"]))
    reasons = F.array_distinct(F.filter(reasons, lambda x: x.isNotNull() & (x != "")))
    first = [F.min_by(c, "__n").alias(c) for c in more]
    return rows.groupBy("session", "__island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), reasons.alias("reasons"), *first).drop("__island")


def keep_segments(trims: DataFrame, merged: DataFrame, least_s: float = 0.01) -> DataFrame:
    """What is left of [trim_start, trim_end] of each session without its merged intervals; pieces of `least_s` or less go."""
    t = trims.select("session", F.greatest("trim_start_s", F.lit(0.0)).alias("a"), F.greatest("trim_end_s", "trim_start_s", F.lit(0.0)).alias("b")).filter("session IS NOT NULL")
    rows = t.join(merged.select("session", "start_s", "end_s"), "session", "left").withColumn("s", F.greatest("start_s", "a")).withColumn("e", F.least("end_s", "b"))
    inside = F.col("start_s").isNotNull() & (F.col("e") - F.col("s") > TOUCH_S)
    rows = rows.select("session", "a", "b", F.when(inside, F.col("s")).alias("s"), F.when(inside, F.col("e")).alias("e"))
    # Every gap ends where an interval starts, or at the end of the trim; it starts where the interval before ends, or at the start. Intervals that lie outside come last.
    order = Window.partitionBy("session").orderBy(F.asc_nulls_last("s"), "e")
    rows = rows.withColumns({"before": F.lag("e").over(order), "after": F.lead("s").over(order), "n": F.row_number().over(order)})
    gap = lambda start, end: F.struct(start.alias("start_s"), end.alias("end_s"))
    here, last = F.col("s").isNotNull(), F.col("after").isNull()
    gaps = F.array(
        F.when(here, gap(F.coalesce("before", "a"), F.col("s"))),
        F.when(here & last, gap(F.col("e"), F.col("b"))).when(~here & (F.col("n") == 1), gap(F.col("a"), F.col("b"))),
    )
    out = rows.select("session", F.explode(F.array_compact(gaps)).alias("g")).select("session", "g.*")
    return out.filter(F.col("end_s") - F.col("start_s") > least_s)


def interval_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("session").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"))


def unroll_loops(samples: DataFrame, jump_s: float = 0.25) -> DataFrame:
    """A media clock that falls back by more than `jump_s` has started a new loop. samples: session, seq, media_s, duration_s."""
    order = Window.partitionBy("session").orderBy("seq")
    back = (F.lag("media_s").over(order) - F.col("media_s") > jump_s).cast("int")
    loops = F.sum(F.coalesce(back, F.lit(0))).over(order)
    return samples.withColumn("loops", loops).withColumn("timeline_s", F.col("loops") * F.col("duration_s") + F.col("media_s"))


#: How far ahead of its last progress a media clock must be to have moved, and how far behind it to have looped.
AHEAD_S, BEHIND_S = 0.03, 0.25


def stall_step(state: tuple, t: float, media: float | None, frame: float | None) -> tuple:
    """One sample: time and value of the last progress of the media clock, and of the frame counter."""
    at, value, frame_at, count = state
    if media is not None and (value is None or media > value + AHEAD_S or media + BEHIND_S < value):
        at, value = t, media
    if frame is not None and (count is None or frame > count):
        frame_at, count = t, frame
    return at, value, frame_at, count


def stalls(samples: DataFrame) -> DataFrame:
    """Time since the media clock and the frame counter last advanced; a clock that has fallen back has looped, which is an advance too. samples: session, seq, t_s, media_s, frame.

    What counts as an advance depends on the last one, so rows are streamed in the order of their session's log, and a session's state is all that is held."""
    none = lambda x: None if x is None or x != x else float(x)

    def run(batches):
        current, state = object(), None
        for pdf in batches:
            out = []
            for session, seq, t, media, frame in pdf.itertuples(index=False):
                if session != current:
                    current, state = session, (None,) * 4
                state = stall_step(state, t, none(media), none(frame))
                out.append((session, seq, t, None if state[0] is None else t - state[0], None if state[2] is None else t - state[2]))
            yield pd.DataFrame(out, columns=["session", "seq", "t_s", "stall_s", "frame_stall_s"])

    rows = samples.select("session", "seq", "t_s", "media_s", "frame").repartition("session").sortWithinPartitions("session", "seq")
    return rows.mapInPandas(run, "session long, seq long, t_s double, stall_s double, frame_stall_s double")


def longest_stalls(stalled: DataFrame) -> DataFrame:
    return stalled.groupBy("session").agg(F.max("stall_s").alias("longest_stall_s"), F.max("frame_stall_s").alias("longest_frame_stall_s"))


def downtime(events: DataFrame) -> DataFrame:
    """Disconnects and the next reconnect of the session: count, total and longest downtime."""
    marks = events.filter(F.col("kind").isin("disconnect", "resume"))
    order = Window.partitionBy("session").orderBy("seq")
    rows = marks.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_t", F.lead("t_s").over(order))
    down = rows.filter("kind = 'disconnect' AND next_kind = 'resume'").withColumn("down_s", F.col("next_t") - F.col("t_s"))
    return down.groupBy("session").agg(F.count(F.lit(1)).alias("outages"), F.sum("down_s").alias("down_s"), F.max("down_s").alias("longest_s"))


def interruptions(samples: DataFrame, reconnects: int = 3, reconnect_timeout_s: float = 30.0) -> DataFrame:
    """The first reason of each session why playback must be interrupted. samples: session, seq, t_s, source, lifecycle, analysis (running), looping, ended, paused, ready_state, closes (of the
    control connection), disconnected_s (null while it is open), media_stall_s, frame_stall_s, guard_pauses.

    Playback is in a hard state unless it is an upload that runs, is analysed, loops and has not ended. It is unhealthy since the first of successive samples that are in a hard state, paused or not ready.
    A continuity guard that has paused playback allows a stall as long as a reconnect."""
    down = F.col("disconnected_s").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    hard = ~(yes(F.col("source") == "upload") & yes(F.col("lifecycle") == "running") & yes(F.col("analysis")) & yes(F.col("looping")) & ~yes(F.col("ended")))
    order = Window.partitionBy("session").orderBy("seq")
    samples = samples.withColumn("__hard", hard).withColumn("__bad", hard | yes(F.col("paused")) | yes(F.col("ready_state") < 2))
    samples = samples.withColumn("__healthy", F.count(F.when(~F.col("__bad"), 1)).over(order))
    since = F.min(F.when(F.col("__bad"), F.col("t_s"))).over(Window.partitionBy("session", "__healthy"))
    samples = samples.withColumn("unhealthy_s", F.when(F.col("__bad"), F.col("t_s") - since))
    reason = (
        F.when(F.col("__hard"), "hard_state").when(F.col("paused"), "paused").when(down & (F.col("closes") > reconnects), "reconnect_budget")
        .when(F.col("disconnected_s") > reconnect_timeout_s, "reconnect_timeout").when(F.col("unhealthy_s") > 2, "unhealthy")
        .when(F.col("media_stall_s") > F.when(F.col("guard_pauses") > 0, reconnect_timeout_s).otherwise(2.0), "media_stall").when(~down & (F.col("frame_stall_s") > 5), "frame_stall")
    )
    return samples.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("session").agg(F.min_by("reason", "seq").alias("reason"), F.min("seq").alias("seq"))


def by_request(rows) -> list[tuple]:
    """(request, frames) of rows (request, start, end) in the order of arrival."""
    out = []
    for request, start, end in rows:
        if not out or out[-1][0] != request:
            out.append((request, []))
        out[-1][1].append((start, end))
    return out


def segment_step(pending: list, at: float | None, frames: list, seconds: float, end: bool) -> tuple[list, float | None, list]:
    """A request of frames (start, end): what is left of the frames, the segment clock, and the segments that are complete, as (segment, frames, start_s, end_s).

    The request that ends the stream gives one segment, complete or not. What starts before the end of a segment is used up with it, late frames that no longer overlap it too."""
    pending, out = [*pending, *frames], []
    if pending and at is None:
        at = pending[0][0] // seconds * seconds
    while pending and (end or max(e for _, e in pending) >= at + seconds):
        chosen = [(s, e) for s, e in pending if s < at + seconds and e > at]
        if not chosen:
            at = max(at + seconds, min(s for s, _ in pending) // seconds * seconds)
            continue
        out.append((int(at // seconds), len(chosen), min(s for s, _ in chosen), max(e for _, e in chosen)))
        at += seconds
        pending = [(s, e) for s, e in pending if s >= at]
        if end:
            break
    return pending, at, out


def segments(frames: DataFrame, seconds: float, end_of_stream: bool = True) -> DataFrame:
    """Tumbling segments of frames that arrive in the order of `position`, in requests. A frame belongs to the segment of its start; one that comes late joins the current segment if it
    still overlaps it, and is lost otherwise. A segment is complete when the end of some frame reaches its end, after a whole request has come. With `end_of_stream` the last request
    ends the stream: it gives one segment, complete or not. frames: session, position, request (each frame is one if there is no such column), start_s, end_s.

    Which segment is current depends on what came before, so a session, a recording of an hour or so, is one pass."""
    if "request" not in frames.columns:
        frames = frames.withColumn("request", F.col("position"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        requests = by_request(pdf.sort_values("position")[["request", "start_s", "end_s"]].itertuples(index=False))
        pending, at, out = [], None, []
        for k, (_, rows) in enumerate(requests):
            pending, at, new = segment_step(pending, at, rows, seconds, end_of_stream and k == len(requests) - 1)
            out += new
        return pd.DataFrame([(key[0], *x) for x in out], columns=["session", "segment", "frames", "start_s", "end_s"])

    return frames.groupBy("session").applyInPandas(run, "session long, segment long, frames long, start_s double, end_s double")


def sessions(events: DataFrame, gap_s: float) -> DataFrame:
    """Visits of a session: a pause of more than `gap_s` starts a new one."""
    order = Window.partitionBy("session").orderBy("seq")
    new = F.coalesce(F.col("t_s") - F.lag("t_s").over(order) > gap_s, F.lit(True)).cast("int")
    rows = events.withColumn("__new", new).withColumn("visit", F.sum("__new").over(order))
    return rows.groupBy("session", "visit").agg(F.count(F.lit(1)).alias("events"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"))


def last_n(frames: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("position")))
    return frames.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def modal_size(frames: DataFrame) -> DataFrame:
    """Most frequent size class of each session; of equally frequent ones the one seen last."""
    counts = frames.groupBy("session", "size_class").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
    return counts.groupBy("session").agg(F.max_by(F.struct("size_class", "n"), F.struct("n", "last")).alias("m")).select("session", "m.size_class", "m.n")


def idempotent_events(events: DataFrame) -> DataFrame:
    """Per event id: how often it came, and whether with different contents. events: event_id, content."""
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"), (F.count_distinct("content") > 1).alias("conflict"))


def queue_delay(events: DataFrame) -> DataFrame:
    """First-in first-out: the k-th enqueued query of a session waits for the k-th dequeue. events: session, seq, kind (enqueue, dequeue), t_s."""
    k = F.row_number().over(Window.partitionBy("session", "kind").orderBy("seq"))
    rows = events.filter(F.col("kind").isin("enqueue", "dequeue")).withColumn("place", k)
    a, b = rows.filter("kind = 'enqueue'"), rows.filter("kind = 'dequeue'")
    return a.select("session", "place", F.col("t_s").alias("in_s")).join(b.select("session", "place", F.col("t_s").alias("out_s")), ["session", "place"], "left").withColumn("delay_s", F.col("out_s") - F.col("in_s"))


def ack_match(requests: DataFrame, acks: DataFrame) -> DataFrame:
    """The first acknowledgement, in log order, of the same text at or after each request; a null text has none. Both: session, seq, t_s, text.

    One sweep from the end of a session: the least of what has been seen is what comes first in the log. At equal times acknowledgements are seen before requests."""
    order = Window.partitionBy("session", "text").orderBy(F.desc("t_s"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["session", "seq", "t_s", "text"]
    rows = requests.select(*columns, F.lit(True).alias("asks")).unionByName(acks.select(*columns, F.lit(False).alias("asks")))
    seen = F.min(F.when(~F.col("asks") & F.col("text").isNotNull(), F.struct("seq", "t_s"))).over(order)
    return rows.withColumn("ack", seen).filter("asks").select(*columns, F.col("ack.t_s").alias("ack_t_s"))


def value_runs(series: DataFrame, low: float, least_s: float, high: float, earliest_s: float = -0.25, latest_s: float = 30.0) -> DataFrame:
    """The last run at or under `low` that lasts at least `least_s`, the first later sample at or over `high`, and by how much the event clock is ahead of the series there.

    series: session, seq, t_s, value, removed_s (when the marker was removed, on the event clock). The usual step is the upper median of steps between 0 and 1 (0.04 without any);
    a run lasts from its first to its last sample and one step more, and breaks where a step is more than max(0.12, 2.5 times the usual one).
    `error` says what is missing: too_few, no_marker, no_transition, or implausible_offset."""
    order = Window.partitionBy("session").orderBy("seq")
    s = series.withColumn("step", F.col("t_s") - F.lag("t_s").over(order))
    usual = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN step > 0 AND step < 1 THEN step END DESC)")
    facts = s.groupBy("session").agg(F.coalesce(usual, F.lit(0.04)).alias("usual"), F.count(F.lit(1)).alias("rows"), F.max("removed_s").alias("removed_s"))
    s = s.join(facts.select("session", "usual"), "session").withColumn("low", F.col("value") <= low)
    starts = F.col("low") & ~F.coalesce(F.lag("low").over(order) & (F.col("step") <= F.greatest(F.lit(0.12), 2.5 * F.col("usual"))), F.lit(False))
    s = s.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order))
    runs = s.filter("low").groupBy("session", "run", "usual").agg(F.count(F.lit(1)).alias("n"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.max("seq").alias("end_seq"))
    runs = runs.filter(F.col("end_s") - F.col("start_s") + F.col("usual") >= least_s)
    last = runs.groupBy("session").agg(F.max_by(F.struct("n", "start_s", "end_s", "end_seq"), "run").alias("r")).select("session", "r.*")
    after = series.filter(F.col("value") >= high).select(F.col("session").alias("h_session"), F.struct("seq", "t_s").alias("h"))
    hit = last.join(after, (F.col("session") == F.col("h_session")) & (F.col("h.seq") > F.col("end_seq")), "left")
    hit = hit.groupBy("session", "n", "start_s", "end_s").agg(F.min("h").alias("h")).select("session", "n", "start_s", "end_s", F.col("h.t_s").alias("rise_s"))
    out = facts.join(hit, "session", "left").withColumn("offset_s", F.col("removed_s") - F.col("rise_s"))
    error = (
        F.when(F.col("rows") < 2, "too_few").when(F.col("n").isNull(), "no_marker").when(F.col("rise_s").isNull(), "no_transition")
        .when(~F.col("offset_s").between(earliest_s, latest_s), "implausible_offset")
    )
    return out.select("session", "n", "start_s", "end_s", "rise_s", "offset_s", error.alias("error"))
