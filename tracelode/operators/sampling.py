"""Evidence sampling plans: which times of a recording to look at.

Items carry `session` and `t_s`. Even samples take k of n items at the half-even rounded places i (n - 1) / (k - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _is_even_place(place: Column, n: Column, k: Column) -> Column:
    """Whether `place` (from 0) is one of the k even places of n. The place can only come from the step next to its own."""
    step = (n - 1) / F.greatest(k - 1, F.lit(1))
    hit = F.lit(False)
    for off in (-1, 0, 1):
        i = F.floor(place / F.when(step == 0, 1.0).otherwise(step)) + off
        hit = hit | ((i >= 0) & (i < k) & (F.rint(i * step) == place))
    return hit


def evenly_sample(items: DataFrame, keys: list[str], order: list[str], k: Column | int, middle: bool = False) -> DataFrame:
    """k of the items of each group, all if there are no more. One item is the first, or with `middle` the middle one; with `middle` k of 0 or less takes none."""
    k = F.lit(k) if isinstance(k, int) else k
    w = Window.partitionBy(*keys)
    rows = items.withColumn("__place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", k)
    one = F.floor(F.col("__n") / 2) if middle else F.lit(0)
    keep = F.when(F.col("__n") <= F.col("__k"), True).when(F.col("__k") <= (0 if middle else -1), False).when(F.col("__k") <= 1, F.col("__place") == one).otherwise(_is_even_place(F.col("__place"), F.col("__n"), F.col("__k")))
    return rows.filter(keep).drop("__place", "__n", "__k")


def crop_times(outputs: DataFrame, full: DataFrame, budget: int) -> DataFrame:
    """Times around outputs, evenly sampled and moved to the nearest full-frame time, each once. Both: session, t_s; outputs also seq."""
    c = outputs.filter("t_s IS NOT NULL").select("session", "seq", F.posexplode(F.array(F.col("t_s") - 0.6, F.col("t_s"), F.col("t_s") + 0.8)).alias("part", "c_s"))
    c = evenly_sample(c, ["session"], ["seq", "part"], budget)
    # The nearest is the last one before or the first one after: two sweeps over the session in order of time, each with what it saw last.
    rows = c.select("session", F.col("c_s").alias("at"), F.lit(None).cast("double").alias("full_s")).unionByName(full.filter("t_s IS NOT NULL").select("session", F.col("t_s").cast("double").alias("at"), F.col("t_s").cast("double").alias("full_s")))
    seen = lambda order: F.last("full_s", ignorenulls=True).over(Window.partitionBy("session").orderBy(order, F.col("full_s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("is_full", F.col("full_s").isNotNull()).withColumn("below", seen(F.asc("at"))).withColumn("above", seen(F.desc("at"))).filter("NOT is_full")
    gap = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x) - F.col("at")).alias("gap"), F.col(x).alias("full_s")))
    return rows.select("session", F.least(gap("below"), gap("above"))["full_s"].alias("t_s")).filter("t_s IS NOT NULL").distinct()


def query_segments(sessions: DataFrame, queries: DataFrame, before: float = 1.0, after: float = 4.0) -> DataFrame:
    """Windows around queries; without any the whole of a short recording, head and tail of a long one. sessions: session, duration_s; queries: session, t_s."""
    d = F.col("duration_s")
    q = sessions.join(queries.filter("t_s IS NOT NULL").select("session", "t_s"), "session", "left")
    around = F.array(F.struct(F.greatest(F.lit(0.0), F.col("t_s") - before).alias("start_s"), F.least(d, F.col("t_s") + after).alias("end_s")))
    whole = F.array(F.struct(F.lit(0.0).alias("start_s"), d.alias("end_s")))
    ends = F.array(F.struct(F.lit(0.0).alias("start_s"), F.least(F.lit(35.0), d).alias("end_s")), F.struct(F.greatest(F.lit(0.0), d - 45.0).alias("start_s"), d.alias("end_s")))
    parts = F.when(F.col("t_s").isNotNull(), around).when(d <= 120, whole).otherwise(ends)
    return q.select("session", "duration_s", F.explode(parts).alias("p")).select("session", "duration_s", "p.start_s", "p.end_s")


def temporal_plans(specs: DataFrame) -> DataFrame:
    """Density and budgets of a recording's views. specs: task_id, category, d1, d5, recording_s, source_s (null without one)."""
    has_source = F.col("source_s").isNotNull()
    media_end = F.when(has_source, F.least("source_s", "recording_s")).otherwise(F.col("recording_s"))
    fps = F.when(F.col("category") == "实时计数", 4.0).when(F.col("category") == "实时翻译", 2.0).when(F.col("d1") & (media_end <= 180), 2.0).when(F.col("d1"), 1.0).otherwise(0.5)
    most = F.when(F.col("category").isin("实时计数", "实时翻译") | F.col("d1"), 240).otherwise(180)
    sheets = F.when(F.col("category") == "App引导", 8).when(F.col("category").isin("实时计数", "实时翻译"), 14).otherwise(10)
    plan = lambda view, f, m, t, s: F.struct(view.alias("view"), f.alias("fps"), m.alias("max_frames"), t.alias("tiles"), s.alias("max_sheets"))
    media = F.when(media_end > 0, plan(F.when(has_source, "source_video").otherwise("left_video"), fps, most, F.lit(12), sheets))
    ui = F.when(F.col("category").isin("App引导", "智能体委托") | F.col("d5") | ~has_source, plan(F.lit("right_ui"), F.when(F.col("d5"), 4.0).otherwise(2.0), F.lit(120), F.lit(6), F.lit(10)))
    return specs.select("task_id", F.posexplode(F.array_compact(F.array(media, ui))).alias("place", "p")).select("task_id", "place", "p.*")


def decodable_end(duration: Column) -> Column:
    return F.greatest(F.lit(0.0), duration - F.least(F.lit(0.5), F.greatest(F.lit(0.05), duration * 0.1)))


def sample_grid(segments: DataFrame, fps: float, most: int) -> DataFrame:
    """Times on a grid of 1 / fps inside segments, before the end that can be decoded; distinct and evenly sampled. segments: session, duration_s, start_s, end_s."""
    end = F.least(F.col("end_s"), decodable_end(F.col("duration_s")))
    steps = F.floor((end - F.col("start_s")) * fps).cast("int")
    rows = segments.filter(end >= F.col("start_s")).select("session", F.col("start_s"), F.explode(F.sequence(F.lit(0), steps)).alias("i"))
    return evenly_sample(rows.select("session", F.bround(F.col("start_s") + F.col("i") / fps, 3).alias("t_s")).distinct(), ["session"], ["t_s"], most)


def sheets(samples: DataFrame, budget: int) -> DataFrame:
    """Contact sheets plan by plan while the budget lasts. samples: session, plan, t_s, tiles, max_sheets."""
    w = Window.partitionBy("session", "plan")
    rows = samples.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("want", F.least(F.ceil(F.col("n") / F.col("tiles")), F.col("max_sheets")))
    plans = rows.groupBy("session", "plan").agg(F.first("want").alias("want"))
    before = F.coalesce(F.sum("want").over(Window.partitionBy("session").orderBy("plan").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plans = plans.withColumn("room", F.greatest(F.lit(0), F.least(F.col("want"), F.lit(budget) - before))).drop("want")
    rows = rows.join(plans, ["session", "plan"]).filter("room > 0")
    kept = evenly_sample(rows, ["session", "plan"], ["t_s"], F.col("room") * F.col("tiles"))
    place = F.row_number().over(w.orderBy("t_s")) - 1
    return kept.withColumn("sheet", F.floor(place / F.col("tiles"))).groupBy("session", "plan", "sheet").agg(F.min("t_s").alias("t_s"), F.count(F.lit(1)).alias("tiles"))


def evidence_catalog(items: DataFrame) -> DataFrame:
    """Ids by position: by time, the whole screen before a crop of the same time, sheets last. items: session, t_s, view."""
    rank = F.when(F.col("view").startswith("temporal_sheet"), 2).when(F.col("view") == "full_ui", 0).otherwise(1)
    last = (rank == 2).cast("int")
    place = F.row_number().over(Window.partitionBy("session").orderBy(last, "t_s", rank, "view")) - 1
    return items.withColumn("place", place).withColumn("evidence_id", F.format_string("EVIDENCE_IMAGE_%03d", "place"))


def tail_zoom(specs: DataFrame, duration: str = "recording_s") -> DataFrame:
    """Two looks near the end where D5 applies and the prompt has two labelled rounds or more. specs: task_id, d5, prompt, recording_s."""
    labels = F.regexp_count(F.coalesce("prompt", F.lit("")), F.lit(r"(?im)^\s*R\d+\s*[：:]"))
    rows = specs.filter(F.col("d5") & (labels >= 2))
    return rows.select("task_id", F.explode(F.array(F.greatest(F.lit(0.0), F.col(duration) - 2.0), F.greatest(F.lit(0.0), F.col(duration) - 0.5))).alias("t_s"), F.lit("right_ui_tail_zoom").alias("view"))


def priority_order(catalog: DataFrame, budget: int = 24) -> DataFrame:
    """Puts a self-contained choice of at most `budget` items first: all sheets and zooms, then ordinary items evenly; if those are too many, zooms and then sheets evenly. catalog: session, place, view."""
    w = Window.partitionBy("session")
    zoom, sheet = F.col("view") == "right_ui_tail_zoom", F.col("view").startswith("temporal_sheet")
    rows = catalog.withColumn("kind", F.when(zoom, "zoom").when(sheet, "sheet").otherwise("plain"))
    n = lambda k: F.sum((F.col("kind") == k).cast("int")).over(w)
    rows = rows.withColumn("room", F.least(F.lit(budget), F.count(F.lit(1)).over(w))).withColumn("zooms", n("zoom")).withColumn("sheets", n("sheet"))
    fits = F.col("zooms") + F.col("sheets") <= F.col("room")
    share = F.when(F.col("kind") == "zoom", F.col("room")).when(F.col("kind") == "sheet", F.when(fits, F.col("sheets")).otherwise(F.greatest(F.lit(0), F.col("room") - F.col("zooms")))).otherwise(F.when(fits, F.col("room") - F.col("zooms") - F.col("sheets")).otherwise(0))
    first = evenly_sample(rows.withColumn("share", share), ["session", "kind"], ["place"], F.col("share"), middle=True).select("session", "place", F.lit(0).alias("first"))
    out = catalog.join(first, ["session", "place"], "left")
    return out.withColumn("new_place", F.row_number().over(w.orderBy(F.coalesce("first", F.lit(1)), "place")) - 1).drop("first")


def frame_times(sessions: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """Times around queries and outputs first, then a uniform grid; each is kept if it lies 0.18 s or more from all kept before it, up to `most`.

    The choice is greedy, so it is a fold over the candidates of one session in their order of priority, a list bounded by the recording. sessions: session, duration_s; events: session, seq, t_s."""
    d = F.greatest(F.col("duration_s"), F.lit(0.1))
    end = F.greatest(F.lit(0.05), d - F.least(F.lit(0.5), F.greatest(F.lit(0.05), d * 0.1)))
    count = min(18, max(8, most // 3))
    around = events.filter("t_s IS NOT NULL").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "t_s"))).alias("e"))
    rows = sessions.join(around, "session", "left").withColumn("end_s", end)
    near = F.flatten(F.transform(F.coalesce("e", F.array().cast("array<struct<seq:bigint,t_s:double>>")), lambda x: F.array(x["t_s"] - 0.6, x["t_s"], x["t_s"] + 0.8)))
    grid = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: 0.5 + i * (F.col("end_s") - 0.5) / max(1, count - 1))
    candidates = F.transform(F.concat(near, grid), lambda x: F.bround(F.least(F.col("end_s"), F.greatest(F.lit(0.0), x)), 3))
    picked = F.aggregate(candidates, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) < most) & F.forall(acc, lambda y: F.abs(x - y) >= 0.18), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select("session", F.array_sort(picked).alias("times"))


def variants(catalog: DataFrame, budget: int = 24) -> DataFrame:
    """Fallback choices of evidence in the order in which they are tried. catalog: session, place, view; priority first."""
    sheet = F.col("view").startswith("temporal_sheet")
    parts = [("complete", catalog), ("priority", catalog.filter(F.col("place") < budget)), ("individual", catalog.filter(~sheet)), ("sparse", evenly_sample(catalog.filter(~sheet), ["session"], ["place"], 12))]
    out = None
    for k, (name, df) in enumerate(parts):
        rows = df.select("session", "place", F.lit(name).alias("variant"), F.lit(k).alias("trial"))
        out = rows if out is None else out.unionByName(rows)
    return out
