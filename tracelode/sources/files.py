"""Sources and sinks: task files, media indexes, result trees, event logs, capture summaries, artifacts, run summaries.

Everything is read through Spark's readers, with schemas given, so that inputs may lie in any store that Spark reaches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "id string, task_id string, category string, scene string, local_video_path string, video string, query string, query_time_s double, queries array<struct<id:string,query:string,query_time_s:double>>, duration_s double"
EVENT = "session string, seq long, t_ms double, type string, task_id string, source_position_s double, text string, payload string"
#: Names under which an index may give a video.
VIDEO_FIELDS = ("video", "path", "file", "video_path", "local_video_path")
SUMMARY = (
    "system string, task_id string, attempt int, status string, query_events array<struct<id:string,query:string,query_time_s:double>>, vlm_responses array<struct<t_ms:double,text:string,source:string>>, "
    "prompt_events array<struct<t_ms:double,text:string,ok:boolean>>, background_tasks array<struct<task_id:string,question:string,status:string,started_t_ms:double,finished_t_ms:double>>"
)


def read_tasks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and lines that start with # are skipped, and a bad line is an error."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#|$)"))
    return lines.select(F.from_json("value", TASK, {"mode": "FAILFAST"}).alias("t")).select("t.*")


def read_tasks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted line ends and doubled quotes are part of a cell; headers are trimmed; rows of blanks fall out."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns]).isNotNull())


def media_index(documents: DataFrame) -> DataFrame:
    """id, video out of index documents: rows, lists under items, videos or tasks, or a plain map of id to video. `times` over 1 marks an id that repeats. documents: json."""
    row = "struct<id:string,task_id:string," + ",".join(f"{f}:string" for f in VIDEO_FIELDS) + ">"
    wrapped = [F.from_json(F.get_json_object("json", f"$.{k}"), f"array<{row}>") for k in ("items", "videos", "tasks")]
    whole, plain = F.from_json("json", f"array<{row}>"), F.from_json("json", "map<string,string>")
    entry = F.array(F.struct(*[F.get_json_object("json", f"$.{f}").alias(f) for f in ("id", "task_id", *VIDEO_FIELDS)]))
    of_map = F.transform(F.map_entries(plain), lambda e: F.struct(e["key"].alias("id"), F.lit(None).cast("string").alias("task_id"), e["value"].alias("video"), *[F.lit(None).cast("string").alias(f) for f in VIDEO_FIELDS[1:]]))
    is_row = F.get_json_object("json", "$.id").isNotNull() | F.get_json_object("json", "$.task_id").isNotNull()
    rows = F.when(F.trim("json").startswith("["), whole).otherwise(F.coalesce(*wrapped, F.when(is_row, entry), of_map))
    out = documents.select(F.explode(rows).alias("r")).select(F.trim(F.coalesce("r.id", "r.task_id")).alias("id"), F.coalesce(*[F.nullif(F.col(f"r.{f}"), F.lit("")) for f in VIDEO_FIELDS]).alias("video"))
    return out.groupBy("id").agg(F.min("video").alias("video"), F.count(F.lit(1)).alias("times"))


def read_media_index(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return media_index(spark.read.text(path, wholetext=not lines).filter(F.trim("value") != "").withColumnRenamed("value", "json"))


def placed(path: Column) -> list[Column]:
    """Stage and task out of <root>/<stage>/<task>/<file>."""
    return [F.element_at(F.split(path, "/"), -3).alias("stage"), F.element_at(F.split(path, "/"), -2).alias("task_id")]


def read_result_tree(spark: SparkSession, path: str, schema: str, packed: bool = False) -> DataFrame:
    """A tree of JSON documents; an unreadable one has a null `doc`. A packed tree has many documents a file, <root>/<stage>/<file>: each line is the task, a tab and its document."""
    rows = spark.read.text(path, wholetext=not packed, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    if packed:
        rows = rows.select("path", F.element_at(F.split("path", "/"), -2).alias("stage"), F.substring_index("value", "\t", 1).alias("task_id"), F.regexp_replace("value", "^[^\t]*\t?", "").alias("value"))
    else:
        rows = rows.select("path", *placed(F.col("path")), "value")
    return rows.select("path", "stage", "task_id", F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("d")).select("path", "stage", "task_id", F.when(F.col("d._broken").isNull(), F.col("d")).alias("doc"))


def write_packed_tree(docs: DataFrame, path: str) -> None:
    """Documents as <root>/stage=<stage>/<file>, many a file, each a line of JSON with its task. docs: stage, task_id, doc. Files are compressed; one is read by one task, so their size goes by the tasks that write them."""
    docs.select("stage", "task_id", "doc").write.partitionBy("stage").json(path, compression="lz4")


def read_packed_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """stage, task_id and `doc` of a tree that `write_packed_tree` wrote; an unreadable document is null. Spark's JSON reader takes task and document in one pass, and the stage comes with the file, so no row is cut,
    parsed again or looked up by its path. Of a broken line the task is taken out of its text, where it comes first."""
    rows = spark.read.schema(f"task_id string, doc struct<{schema}>, _broken string, stage string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    named = F.regexp_extract("_broken", r'^\s*\{\s*"task_id"\s*:\s*("(?:[^"\\]|\\.)*+")', 1)
    task = F.coalesce("task_id", F.when(F.col("_broken").isNotNull(), F.get_json_object(F.concat(F.lit('{"t":'), named, F.lit("}")), "$.t")))
    return rows.select("stage", task.alias("task_id"), F.when(F.col("_broken").isNull(), F.col("doc")).alias("doc"))


def read_events(spark: SparkSession, path: str, streaming: bool = False, strict: bool = False, schema: str = EVENT, files_per_trigger: int = 1):
    """An append-only event log as a table or a stream; malformed lines are dropped, or with `strict` an error."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    if streaming:
        return spark.readStream.schema(schema).option("mode", mode).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(schema).json(path, mode=mode)


def explode_summaries(summaries: DataFrame) -> dict[str, DataFrame]:
    """The session row of each capture summary and its four child tables, with the place in the array as `seq`."""
    arrays = [c for c, t in summaries.dtypes if t.startswith("array")]
    key = ["system", "task_id", "attempt"]
    out = {"sessions": summaries.drop(*arrays)}
    for a in arrays:
        rows = summaries.select(*key, F.posexplode(a).alias("seq", "x"))
        inner = [f"x.{f.name}" for f in summaries.schema[a].dataType.elementType.fields]
        out[a] = rows.select(*[F.col(k).alias(f"own_{k}" if f"x.{k}" in inner else k) for k in key], "seq", *inner)
    return out


#: Files above this size are hashed in pieces by their task instead of as one cell of a row.
WHOLE_BYTES = 1 << 28


def read_artifacts(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, bytes and sha256 of files. Contents of files up to `whole_bytes` are hashed as rows; a larger one is streamed by a task through the file system that holds it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = listed.filter(F.col("length") <= whole_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = listed.filter(F.col("length") > whole_bytes).select("path", F.col("length").alias("bytes"))
    return small.unionByName(large.mapInArrow(_hashed, "path string, bytes long, sha256 string"))


def _hashed(batches):
    """The hash of each file, read in pieces of 8 MB."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            system, inside = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_stream(inside) as f:
                while piece := f.read(1 << 23):
                    digest.update(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(out, pa.string())], names=["path", "bytes", "sha256"])


def content_hash(df: DataFrame, *by: str) -> DataFrame:
    """A hash of a table, or of each group of its rows, that does not depend on the order of the rows: their number and two sums of row hashes."""
    doc = F.to_json(F.struct(*sorted(c for c in df.columns if c not in by)), {"ignoreNullFields": "false"})
    total = lambda *seed: F.sum(F.xxhash64(*seed, doc).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*by).agg(F.concat_ws("-", F.count(F.lit(1)), total(), total(F.lit("second"))).alias("hash"))


#: Parts of an index that is written by changed parts.
PARTS = 64
_PART, _HASHES = "index_part", "index_part long, parts long, hash string"


def _generations(spark: SparkSession, path: str) -> tuple[int, dict[int, tuple]]:
    """The newest generation of an index's part hashes and what it holds, at most `parts` rows; 0 and nothing if there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(_HASHES + ", gen long").option("basePath", f"{path}/hashes").parquet(f"{path}/hashes")
        last = rows.agg(F.max("gen")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, {}
    held = rows.filter((F.col("gen") == F.lit(last)) & (F.col(_PART) >= 0)).collect()
    return last or 0, {r[_PART]: (r.parts, r.hash) for r in held}


def _write_generation(spark: SparkSession, path: str, gen: int, held: dict[int, tuple]) -> None:
    """One file, so a generation is there whole or not at all; the row of part -1 makes one without parts a file too."""
    rows = [(-1, 0, "")] + [(p, *h) for p, h in sorted(held.items())]
    spark.createDataFrame(rows, _HASHES).coalesce(1).write.mode("overwrite").parquet(f"{path}/hashes/gen={gen}")


def write_index(df: DataFrame, path: str, keys: list[str] | None = None, parts: int = PARTS) -> tuple[list[int], list[int]]:
    """Writes JSON lines in `parts` parts by hash of `keys` (all columns, if not given), but only the parts whose rows have changed. Gives the parts written and the parts that have no rows any more.

    Part hashes lie beside the data, so the old rows are not read, and if nothing has changed nothing is written. Before data change, a generation of hashes
    without the changed parts is written; after that, one with all. A writer that fails in between leaves no hash that does not belong to its part, and the next write
    mends it. Parts without rows stay as folders that `read_index` passes over. Null keys have a part; repeated rows count as often as they occur; one writer at a time.
    """
    spark = df.sparkSession
    if _PART in df.columns:
        raise ValueError(f"{_PART} is the name of the part's own column")
    placed_rows = df.withColumn(_PART, F.pmod(F.xxhash64(*(keys or sorted(df.columns))), F.lit(parts)))
    gen, old = _generations(spark, path)
    new = {r[_PART]: (parts, r.hash) for r in content_hash(placed_rows, _PART).collect()}
    changed, gone = sorted(p for p, h in new.items() if old.get(p) != h), sorted(set(old) - set(new))
    if not changed and not gone and gen:
        return [], []
    kept = {p: h for p, h in old.items() if new.get(p) == h}
    if changed and old:
        _write_generation(spark, path, gen := gen + 1, kept)
    if changed:
        # Spark splits a part that holds very many rows over several files.
        rows = placed_rows.filter(F.col(_PART).isin(changed)).hint("rebalance", _PART)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).json(f"{path}/data")
    _write_generation(spark, path, gen + 1, new)
    return changed, gone


def read_index(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of an index that `write_index` wrote; folders of parts that have no rows now are not read."""
    from pyspark.sql.types import StructType

    live = list(_generations(spark, path)[1])
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not live:
        return spark.createDataFrame([], schema)
    names = schema.names
    return spark.read.schema(StructType([*schema.fields]).add(_PART, "long")).json(f"{path}/data").filter(F.col(_PART).isin(live)).select(*names)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes an index unless the same rows are there already; says whether it wrote."""
    return any(write_index(df, path))


def write_run_summary(df: DataFrame, path: str, columns: list[str]) -> None:
    """A run summary in a fixed order of columns, as JSON lines and as CSV with all cells quoted."""
    out = df.select(*columns)
    out.write.mode("overwrite").json(f"{path}/json")
    out.write.mode("overwrite").csv(f"{path}/csv", header=True, quoteAll=True)
