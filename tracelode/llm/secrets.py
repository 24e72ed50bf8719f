"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every historical version of a text is a blob, addressed by its SHA-256. The ledger is a Parquet table of
(blob, rule version, spans); a scan reads only blobs that have no ledger row for the rule version, each once however many paths
hold it, appends what it found, and joins the findings back to all paths.

Match positions: Spark gives the matches of a pattern (`regexp_extract_all`) and the gaps between them (`split`);
the lengths of both in code points, run together, are the positions.

Defined cases: null text is the empty text; spans of one kind never overlap, spans of different kinds may; rows that
repeat each get a result row; a blob that scans at the same time wrote twice counts once; an empty table gives an empty result. A text without findings has the hash of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common

#: Kinds in the order in which they are listed: pattern, group whose length counts, least length.
#: For access and hex the least length is in the pattern itself: a run that is too short has no longer run inside it.
RULES = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULE_VERSION = 1
_SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    items = F.zip_with(F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(c).alias("n")))
    items = F.filter(items, lambda x: x["len"].isNotNull())

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"))
        return F.struct((start + x["len"]).alias("at"), F.when(x["n"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    # Most texts match nothing, and the fold is skipped for them.
    return F.when(F.size(matches) > 0, F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])).otherwise(none)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    found = [spans_of(F.col("text"), i, *rule) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*found)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def update_ledger(spark: SparkSession, docs: DataFrame, path: str, rules=RULES, version: int = RULE_VERSION) -> DataFrame:
    """Scans what the ledger at `path` does not know under this rule version and returns the ledger's rows of the version.
    A scan that is run again after a failure appends only what is still missing."""
    versions = addressed(docs)
    if (known := read_ledger(spark, path)) is not None:
        seen = known.filter(F.col("rule_version") == version).select("blob")
        versions = versions.join(seen.hint("merge"), "blob", "left_anti")
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text"))
    scan_blobs(unseen, rules).withColumn("rule_version", F.lit(version)).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("rule_version") == version)


#: Parts in which the paths of a blob meet its findings.
PARTS = 16


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The spans of every row of `docs`; blobs without findings need no join partner. A blob that scans at the same time both wrote counts once;
    one that very many paths hold meets them in parts."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("found_part")
    hits = ledger.filter(F.size("spans") > 0).select(F.col("blob").alias("found_blob"), "spans", part)
    hits = hits.groupBy("found_blob", "found_part").agg(F.first("spans").alias("spans"))
    paths = addressed(docs).select("doc_id", "blob", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("part"))
    none = F.array().cast(f"array<{_SPAN}>")
    same = (F.col("blob") == F.col("found_blob")) & (F.col("part") == F.col("found_part"))
    return paths.join(hits.hint("merge"), same, "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = findings(docs, update_ledger(spark, docs, common.new_path(spark, "blob-ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
