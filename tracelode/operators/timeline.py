"""Session timelines: clocks, first outputs, intervals between outputs.

Wall time, media time, the analyzer's frame clock and reported latencies are four clocks in four columns; no operator subtracts one from another.
Event tables carry `session` and `seq`, the order of the log; "first" means first in the log, not earliest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import cut

#: Texts that count as silence once white space is gone and letters are lower.
SILENCE = ("", "</silence>", "<silence>", "silence", "null", "none")


#: White space of timeline texts: the Unicode spaces and the four ASCII separators.
_SPACE = r"[\s\x1C-\x1F]"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){_SPACE}+", "")


def is_silence(text: Column) -> Column:
    return F.lower(squeezed(text)).isin(*SILENCE)


def clean_response(text: Column) -> Column:
    """Without one leading response tag and outer white space."""
    untagged = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U)^{_SPACE}*</?response>{_SPACE}*", "")
    return F.regexp_replace(untagged, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def frame_time(text: Column) -> Column:
    """First signed number in a text."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def rebase_clock(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """wall_s = t_ms / 1000 - origin, the start of the original video if known, else the time the stream was ready."""
    origin = sessions.select("session", F.coalesce("video_start_s", "stream_ready_s").alias("origin_s"))
    return events.join(origin, "session", "left").withColumn("wall_s", F.bround(F.col("t_ms") / 1000 - F.col("origin_s"), 3))


def dedupe_events(events: DataFrame) -> DataFrame:
    """The first of equal (kind, text, time to a hundredth) in log order. A time of exactly 0 counts as unknown, like null."""
    at = F.bround(F.when(F.coalesce("t_s", F.lit(0.0)) == 0, -1.0).otherwise(F.col("t_s")), 2)
    rank = F.row_number().over(Window.partitionBy("session", "kind", "text", at).orderBy("seq"))
    return events.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def intervals_between(outputs: DataFrame, column: str) -> DataFrame:
    """Gaps between neighbours in the log where both times are known."""
    gap = F.col(column) - F.lag(column).over(Window.partitionBy("session").orderBy("seq"))
    return outputs.withColumn("interval_s", gap).filter("interval_s IS NOT NULL")


#: Values of a group that one task may sort; bins of a histogram; groups that are broadcast.
MEDIAN_ROWS, BINS, BROADCAST_GROUPS = 1 << 20, 4096, 10_000


def selected(df: DataFrame, keys: list[str], column: str, groups: DataFrame, most: int) -> DataFrame:
    """keys and the exact median of large groups (keys, count, lo, hi; a table), by histograms that are refined where the wanted rank lies.

    A histogram has BINS bins between the least and the greatest value that are left, so a round gains three or four decimal digits; it is summed before the shuffle, and no task holds more than
    `most` values of a group. Even counts have two ranks, whose mean is the median."""
    key = F.struct(*keys)
    hint = "broadcast" if groups.count() <= BROADCAST_GROUPS else "merge"
    rows = df.select(key.alias("key"), F.col(column).cast("double").alias("x")).filter("x IS NOT NULL")
    ranks = F.array_distinct(F.array(F.floor((F.col("count") - 1) / 2), F.floor(F.col("count") / 2)))
    left = cut(groups.select(key.alias("g"), F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("count").alias("n"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")))
    inside = lambda t: rows.join(t.hint(hint), F.col("key").eqNullSafe(F.col("g")) & F.col("x").between(F.col("lo"), F.col("hi")))
    ready = []
    while True:
        over = (F.col("lo") == F.col("hi")) | (F.col("n") <= most)
        ready.append(left.filter(over))
        left = left.filter(~over)
        if left.isEmpty():
            break
        # Halves first: the difference of two finite numbers need not be finite.
        place = F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        bins = inside(left).groupBy("g", "rank", "before", F.least(place, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bin"))
        left = cut(bins.withColumn("before", F.col("before") + upto - F.col("n")).filter("before <= rank AND rank < before + n").select("g", "rank", "before", "n", "lo", "hi"))
    found = reduce(DataFrame.unionByName, ready)
    single = found.filter("lo = hi").select("g", "rank", F.col("lo").alias("x"))
    place = F.row_number().over(Window.partitionBy("g", "rank").orderBy("x")) - 1 + F.col("before")
    sorted_ = inside(found.filter("lo < hi")).withColumn("place", place).filter("place = rank").select("g", "rank", "x")
    # As the built-in median interpolates.
    middle = single.unionByName(sorted_).groupBy("g").agg((F.min("x") * 0.5 + F.max("x") * 0.5).alias("median"))
    return middle.select(*[F.col("g")[k].alias(k) for k in keys], "median")


def numeric_summary(df: DataFrame, keys: list[str], column: str, most: int = MEDIAN_ROWS) -> DataFrame:
    """count, min, exact median, mean and max to three decimals; groups without a value have none of them.

    Groups of more than `most` finite values get their median by `selected`; the others from the built-in one, which keeps a group's distinct values in one task."""
    r = lambda c: F.bround(c, 3)
    plain = (F.count(column).alias("count"), r(F.min(column)).alias("min"), r(F.median(column)).alias("median"), r(F.avg(column)).alias("mean"), r(F.max(column)).alias("max"))
    sizes = df.groupBy(*keys).agg(F.count(column).alias("count"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("avg"))
    infinite = float("inf")
    large = cut(sizes.filter((F.col("count") > most) & (F.abs("lo") < infinite) & (F.abs("hi") < infinite)))
    if large.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    mine = large.select(F.struct(*keys).alias("__g")).hint("broadcast" if large.count() <= BROADCAST_GROUPS else "merge")
    rest = df.join(mine, F.struct(*keys).eqNullSafe(F.col("__g")), "left_anti").groupBy(*keys).agg(*plain)
    medians = selected(df, keys, column, large, most).select(F.struct(*keys).alias("__g"), "median").hint("merge")
    done = large.join(medians, F.struct(*keys).eqNullSafe(F.col("__g"))).select(*keys, "count", r("lo").alias("min"), r("median").alias("median"), r("avg").alias("mean"), r("hi").alias("max"))
    return rest.unionByName(done)


def first_output_after_query(queries: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each query the first output in the log whose time is in [query, next query); queries without one keep nulls.

    The bound makes the range two-sided, and the equal key is the session."""
    w = Window.partitionBy("session").orderBy("seq")
    q = queries.select("session", F.col("seq").alias("query_seq"), F.col("t_s").alias("query_t_s"), F.lead("t_s").over(w).alias("next_t_s"), F.col("text").alias("query"))
    o = outputs.select(F.col("session").alias("o_session"), F.struct("seq", "t_s", "latency_ms", "text").alias("o"))
    inside = (F.col("session") == F.col("o_session")) & (F.col("o.t_s") >= F.col("query_t_s")) & (F.col("next_t_s").isNull() | (F.col("o.t_s") < F.col("next_t_s")))
    # The smallest struct is the one with the smallest seq.
    hit = q.join(o, inside, "left").groupBy("session", "query_seq", "query_t_s", "query").agg(F.min("o").alias("o"))
    return hit.select("session", "query_seq", "query_t_s", "query", F.col("o.t_s").alias("output_t_s"), F.bround(F.col("o.t_s") - F.col("query_t_s"), 3).alias("wall_delay_s"), F.col("o.latency_ms").alias("latency_ms"), F.col("o.text").alias("text"))


def round_match(rounds: DataFrame, outputs: DataFrame) -> DataFrame:
    """The latency of the first output whose text equals the cleaned final response of a round. rounds: session, rn, text."""
    r = rounds.select("session", "rn", clean_response(F.col("text")).alias("answer"))
    o = outputs.select("session", F.col("text").alias("answer"), "seq", "latency_ms").filter("answer != ''")
    first = o.groupBy("session", "answer").agg(F.min_by("latency_ms", "seq").alias("latency_ms"))
    return r.join(first, ["session", "answer"], "left").select("session", "rn", F.nullif("answer", F.lit("")).alias("answer"), "latency_ms")


def playback_alignment(sessions: DataFrame) -> DataFrame:
    """Whether source media and wall clock run together: uploaded, not paused, started at the beginning, never looped."""
    aligned = (F.col("input_mode") == "upload") & (F.col("paused") == F.lit(False)) & (F.coalesce("current_time_s", F.lit(0.0)) < 0.25) & (F.coalesce("loop_count", F.lit(0)) == 0)
    return sessions.withColumn("aligned", F.coalesce(aligned, F.lit(False)))


def silence_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy("session").agg(F.count(F.lit(1)).alias("responses"), F.count(F.when(is_silence(F.col("text")), 1)).alias("silent"))


def timeline_document(queries: DataFrame, outputs: DataFrame) -> DataFrame:
    """One nested row per session: its queries and outputs in log order. Sessions are bounded by one recording."""
    item = F.array_sort(F.collect_list(F.struct("seq", "t_s", "text")))
    q, o = queries.groupBy("session").agg(item.alias("queries")), outputs.groupBy("session").agg(item.alias("outputs"))
    return q.join(o, "session", "full_outer")


#: Categories whose latency counts from an explicit query, and marks of one in the D3 anchor.
QUERY_CATEGORIES = ("App引导", "实时翻译")
QUERY_MARKERS = ("query", "输入问题", "提问", "提交", "首次点评启动")


def d3_clock_policy(specs: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """Which clock is authoritative for a task's latency: the reported latency after an explicit query or start, else the time from the visual event to the output
    on an aligned clock. With the former come its measurements, one for each query in order; the wall delay is for cross-checks only.
    specs: task_id, category, threshold (the D3 anchor); timing: task_id and the columns of `first_output_after_query`."""
    explicit = F.coalesce(F.col("category").isin(*QUERY_CATEGORIES), F.lit(False))
    for marker in QUERY_MARKERS:
        explicit = explicit | F.coalesce(F.col("threshold").contains(marker), F.lit(False))
    out = specs.select("task_id", F.when(explicit, "explicit_query_or_startup_model_latency").otherwise("visual_event_end_to_end").alias("mode"), explicit.alias("explicit"))
    kind = "array<struct<query_seq:bigint,query:string,model_reported_latency_ms:double,end_to_end_wall_delay_s:double>>"
    if timing is None:
        return out.select("task_id", "mode", F.array().cast(kind).alias("measurements"))
    one = F.struct("query_seq", "query", F.col("latency_ms").alias("model_reported_latency_ms"), F.col("wall_delay_s").alias("end_to_end_wall_delay_s"))
    found = timing.groupBy("task_id").agg(F.array_sort(F.collect_list(one)).cast(kind).alias("found"))
    rows = out.join(found.hint("merge"), "task_id", "left")
    return rows.select("task_id", "mode", F.coalesce(F.when(F.col("explicit"), F.col("found")), F.array().cast(kind)).alias("measurements"))
