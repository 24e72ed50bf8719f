"""Task tables: cells, times, rounds, media resolution, selection and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, once

#: Phrases that mean "at the start".
AT_START = ("视频开始", "开始就发送")
TEXT_FIELDS, TIME_FIELDS = ("query", "prompt", "text_query", "content"), ("query_time_s", "time_s", "query_at_s", "query_second")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_cell(cell: Column) -> Column:
    """Line ends as LF, stripped, empty as null."""
    return F.nullif(strip(F.regexp_replace(cell, r"\r\n?", "\n")), F.lit(""))


def parse_seconds(cell: Column, default: float | None = None) -> Column:
    """0 for a phrase that means the start, else the first unsigned number, else the default."""
    t = clean_cell(cell)
    number = F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    at_start = F.lit(False)
    for phrase in AT_START:
        at_start = at_start | t.contains(phrase)
    return F.coalesce(F.when(at_start, 0.0), number, F.lit(default).cast("double"))


def round_label(text: Column) -> Column:
    """`r 02` as R2; without digits the upper-case text."""
    up = F.upper(strip(F.coalesce(text, F.lit(""))))
    digits = F.regexp_extract(up, r"R?\s*(\d+)", 1)
    return F.when(digits == "", up).otherwise(F.concat(F.lit("R"), digits.cast("long").cast("string")))


#: Labels of rounds.
_LABEL, _NUMBER = r"(?i)(?:^|\n|\s)(R\d+)\s*[：:]", r"(?:^|\n|\s)(\d+)\s*[.．、]"
_PART = "array<struct<label:string,text:string>>"


def split_labels(cell: Column, allow_numbered: bool = False) -> Column:
    """"R1: … R2: …" (or "1. … 2. …") as (label, text) pairs. It takes two labels at least; empty parts fall out."""
    none = F.array().cast(_PART)

    def paired(cut):
        bodies = F.slice(cut["bodies"], 2, F.greatest(F.size(cut["bodies"]) - 1, F.lit(0)))
        pairs = F.zip_with(cut["labels"], bodies, lambda a, b: F.struct(round_label(a).alias("label"), strip(b).alias("text")))
        return F.when(F.size(cut["labels"]) >= 2, F.filter(pairs, lambda p: p["text"] != "")).otherwise(none)

    def by(text, pattern):
        return once(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("labels"), F.split(text, pattern, -1).alias("bodies")), paired)

    def parts(text):
        labelled = by(text, _LABEL)
        return once(labelled, lambda x: F.when(F.size(x) > 0, x).otherwise(by(text, _NUMBER))) if allow_numbered else labelled

    return once(F.coalesce(clean_cell(cell), F.lit("")), parts)


def query_rounds(tasks: DataFrame, default_s: float = 0.0) -> DataFrame:
    """task_id, pos, round_id, query, query_time_s. tasks: task_id, query, query_time.

    Query parts and time parts meet by label (the last time of a label counts), else by position, else the time of the whole cell holds. Without query parts
    every time part is a round with the whole query; without either there is one round."""
    t = tasks.select("task_id", F.coalesce(clean_cell(F.col("query")), F.lit("")).alias("query"), clean_cell(F.col("query_time")).alias("time"))
    # One row out of a generator: both lists are computed once and not again in every branch that reads them.
    once = F.explode(F.array(F.struct(split_labels(F.col("query"), True).alias("parts"), split_labels(F.col("time")).alias("times"))))
    t = t.select("*", once.alias("s")).select("task_id", "query", "time", "s.parts", "s.times")
    seconds = lambda x: F.coalesce(parse_seconds(x), F.lit(default_s))
    by_label = lambda label: F.element_at(F.reverse(F.filter("times", lambda x: x["label"] == label)), 1)["text"]
    whole = seconds(F.col("time"))

    def of_part(p, i):
        label_time = F.when(F.exists("times", lambda x: x["label"] == p["label"]), seconds(by_label(p["label"])))
        place_time = F.when(i < F.size("times"), seconds(F.get("times", i)["text"]))
        return F.struct(p["label"].alias("round_id"), p["text"].alias("query"), F.coalesce(label_time, place_time, whole).alias("query_time_s"))

    from_parts = F.transform("parts", of_part)
    from_times = F.transform("times", lambda x: F.struct(x["label"].alias("round_id"), F.col("query").alias("query"), seconds(x["text"]).alias("query_time_s")))
    single = F.array(F.struct(F.lit("R1").alias("round_id"), F.col("query").alias("query"), whole.alias("query_time_s")))
    rounds = F.when(F.size("parts") > 0, from_parts).when(F.size("times") > 0, from_times).otherwise(single)
    return t.select("task_id", F.posexplode(rounds).alias("pos", "r")).select("task_id", "pos", "r.round_id", "r.query", "r.query_time_s")


def normalize_rounds(tasks: DataFrame) -> DataFrame:
    """Rounds out of a JSON array of rounds under alias names, in the order of their times; without one, a round from the task's own fields.
    `error` names what is wrong with a round. tasks: task_id, rounds_json, query, query_time_s."""
    kind = "array<struct<id:string,round_id:string,label:string," + ",".join(f"{f}:string" for f in TEXT_FIELDS + TIME_FIELDS) + ">>"
    listed = F.from_json("rounds_json", kind)
    fallback = F.array(F.struct(*[F.lit("R1" if f == "id" else None).cast("string").alias(f) for f in ("id", "round_id", "label")], *[(F.col("query") if f == "query" else F.lit(None).cast("string")).alias(f) for f in TEXT_FIELDS], *[(F.col("query_time_s").cast("string") if f == "query_time_s" else F.lit(None).cast("string")).alias(f) for f in TIME_FIELDS]))
    rows = tasks.select("task_id", F.posexplode(F.when(F.size(F.coalesce(listed, F.array().cast(kind))) > 0, listed).otherwise(fallback)).alias("pos", "r"))
    name = F.concat(F.lit("R"), (F.col("pos") + 1).cast("string"))
    rid = F.coalesce(F.nullif(F.trim(F.coalesce("r.id", "r.round_id", "r.label")), F.lit("")), name)
    text, time = F.trim(F.coalesce(*[f"r.{f}" for f in TEXT_FIELDS], F.lit(""))), F.coalesce(*[f"r.{f}" for f in TIME_FIELDS]).try_cast("double")
    error = F.when(text == "", "missing text").when(time.isNull() | F.isnan(time) | (time < 0), "invalid time")
    rows = rows.select("task_id", "pos", rid.alias("round_id"), text.alias("query"), time.alias("query_time_s"), error.alias("error"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("query_time_s", "pos")))


def normalize_task(raw: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Each field is the first alias that is not null, trimmed; `missing` lists required fields that are empty."""
    cols = [F.nullif(F.trim(F.coalesce(*names)), F.lit("")).alias(field) for field, names in aliases.items()]
    out = raw.select(*cols)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in required])))


def media_key_index(files: DataFrame) -> DataFrame:
    """Normalised name to the first path in path order, with how many paths share it. files: path, stem."""
    return files.groupBy(name_key(F.col("stem")).alias("key")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))


def resolve_media(tasks: DataFrame, explicit: DataFrame, index: DataFrame) -> DataFrame:
    """The explicit file of a task if it has one, else the first of its label, scene and id that names a file. tasks: task_id, label, scene; explicit: task_id, path; index: key, path."""
    out = tasks.join(explicit.select("task_id", F.col("path").alias("p0")).hint("merge"), "task_id", "left")
    for k, column in enumerate(("label", "scene", "task_id"), 1):
        side = index.select(F.col("key").alias(f"k{k}"), F.col("path").alias(f"p{k}")).hint("merge")
        out = out.join(side, F.nullif(name_key(F.col(column).cast("string")), F.lit("")) == F.col(f"k{k}"), "left")
    return out.select("task_id", F.coalesce("p0", "p1", "p2", "p3").alias("path"), F.when(F.col("p0").isNotNull(), "map").when(F.col("p1").isNotNull(), "label").when(F.col("p2").isNotNull(), "scene").when(F.col("p3").isNotNull(), "id").alias("found_by"))


def resolve_duration(df: DataFrame, default_s: float, cap_s: float | None = None) -> DataFrame:
    value = F.coalesce("stated_s", "probed_s", F.lit(default_s))
    return df.withColumn("duration_s", F.bround(F.least(value, F.lit(cap_s)) if cap_s is not None else value, 3))


def filter_tasks(tasks: DataFrame, ids: DataFrame | None = None, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    if ids is not None:
        tasks = tasks.join(ids, "task_id", "left_semi")
    if categories:
        tasks = tasks.filter(F.col("category").isin(*categories))
    return tasks.orderBy("task_id").limit(limit) if limit is not None else tasks


def select_in_order(tasks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested tasks with their place, and requests that no task meets. wanted: task_id, place."""
    return wanted.join(tasks, "task_id"), wanted.join(tasks, "task_id", "left_anti")


def repeated_queries(rounds: DataFrame) -> DataFrame:
    per = rounds.groupBy("task_id").agg(F.count(F.lit(1)).alias("rounds"), F.count_distinct("query").alias("texts"))
    return per.filter("texts < rounds")


def unique_queries(rounds: DataFrame) -> DataFrame:
    """One row per query text, by hash; the first round that asks it names it. rounds: seq, query."""
    return rounds.groupBy(F.sha2("query", 256).alias("query_sha256")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("times"))


def task_report(tasks: DataFrame) -> DataFrame:
    """tasks: task_id, path, rounds."""
    return tasks.agg(F.count(F.lit(1)).alias("selected"), F.count("path").alias("written"), F.count_distinct("path").alias("unique_videos"), F.count_if(F.col("rounds") > 1).alias("multi_round"), F.count_if(F.col("path").isNull()).alias("missing"))


def task_gate(tasks: DataFrame, expected: int) -> DataFrame:
    n = F.count(F.lit(1))
    return tasks.agg((n == expected).alias("count_ok"), (F.count_distinct("task_id") == n).alias("ids_unique"), (F.count_if(F.coalesce(F.trim(F.col("task_id").cast("string")), F.lit("")) == "") == 0).alias("ids_present"), (F.count_distinct("path") == n).alias("videos_unique"))


def audio_coverage(rounds: DataFrame, entries: DataFrame) -> DataFrame:
    """Query hashes without audio, audio without a query, and audio whose bytes do not fit its samples. entries: query_sha256, sample_count, bytes."""
    q = rounds.select(F.sha2("query", 256).alias("query_sha256")).distinct().withColumn("asked", F.lit(True))
    both = q.join(entries.hint("merge"), "query_sha256", "full_outer")
    finding = F.when(F.col("bytes").isNull(), "no_audio").when(F.col("asked").isNull(), "no_query").when(F.col("sample_count") * 4 != F.col("bytes"), "size")
    return both.select("query_sha256", finding.alias("finding")).filter("finding IS NOT NULL")


def validate_pool(rows: DataFrame, required: list[str], selection: str | None = None, chosen: str = "入选") -> DataFrame:
    """A task pool sheet: trimmed cells, chosen rows, no blank ids; ids that repeat are marked. Missing headers are an error at once."""
    if gone := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing required columns: {gone}")
    out = rows.select(*[clean_cell(F.col(c).cast("string")).alias(c) for c in rows.columns]).filter("id IS NOT NULL")
    if selection and selection in rows.columns:
        out = out.filter(F.col(selection) == chosen)
    return out.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("id")) > 1)
