r"""Exact dedup with content-defined chunk recipes.

Two texts are equal when they are identical after deleting `[\x20\x09-\x0D]`. Each normalised text is cut where a rolling
hash of its last 32 bytes says so, hence equal texts are cut alike, and becomes a recipe: the ordered list of the 64-bit identifiers of its chunks.
Only recipes are compared, by one grouping that sums before the shuffle.
Identifiers are verified: chunks are reduced to distinct (identifier, SHA-256) pairs, and documents with an identifier that stands
for two contents are told apart by their chunks' SHA-256 as well, so equal lists of verified identifiers mean equal texts. No text is shuffled.

Of equal texts the row with the most code points stays, then the smallest doc_id, then the smallest text hash; rows that repeat doc_id and text are one
of them kept, the others not. Null doc_ids come last among ties. Null and empty texts, and texts of blanks only, are equal and have the empty recipe.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, wordhash

#: Cut on average every 2^11 bytes; chunks have LEAST to MOST bytes.
MASK, LEAST, MOST = np.uint32((1 << 11) - 1), 256, 16_384
_GEAR = (wordhash.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks. The gear hash of the last 32 bytes is built by doubling its window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[k:] += h[:-k] << np.uint32(k)
        h = moved
    out, last = [], 0
    for p in (np.flatnonzero((h & (MASK << np.uint32(20))) == 0) + 1).tolist():
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST:
            last = p
            out.append(p)
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def _chunks(texts: pa.Array):
    data, offsets = wordhash.buffers(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        one = data[a:b]
        ends = cuts(one)
        yield [one[x:y].tobytes() for x, y in zip([0, *ends], ends)]


_CHUNK = T.StructType([T.StructField("id", T.LongType()), T.StructField("proof", T.BinaryType())])


@F.arrow_udf(T.ArrayType(_CHUNK))
def chunked(texts: pa.Array) -> pa.Array:
    """Each chunk as its identifier and its SHA-256, in order."""
    out = [[{"id": xxhash.xxh3_64_intdigest(c) - (1 << 63), "proof": hashlib.sha256(c).digest()} for c in chunks] for chunks in _chunks(texts)]
    return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("proof", pa.binary())])))


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), common.BLANKS, "")


def recipes(docs: DataFrame) -> DataFrame:
    keyed = common.keyed(docs).withColumn("norm", normalised(F.col("text")))
    return keyed.select("doc_id", "th", F.length("text").cast("long").alias("n_points"), F.sha2("norm", 256).alias("text_sha256"), chunked("norm").alias("chunks"))


def verified(rows: DataFrame) -> DataFrame:
    """Adds `recipe` (identifiers) and `told_apart`: null, or for the documents with an identifier that stands for two
    contents, a digest of their contents in order."""
    rows = rows.withColumn("recipe", F.col("chunks.id"))
    chunks = rows.select(F.explode("chunks").alias("c")).select("c.id", "c.proof").distinct()
    clash = chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if clash.isEmpty():
        return rows.withColumn("told_apart", F.lit(None).cast("string"))
    hit = rows.select("doc_id", "th", F.explode("recipe").alias("id")).join(clash.hint("merge"), "id", "left_semi")
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), F.lit(True).alias("hit")).distinct()
    rows = rows.join(hit.hint("merge"), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    proofs = F.sha2(F.array_join(F.transform("chunks", lambda c: F.hex(c["proof"])), ","), 256)
    return rows.withColumn("told_apart", F.when(F.col("hit"), proofs)).drop("h_id", "h_th", "hit")


def grouped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, th, `times` it occurs, keep_id, group_size, is_best, text_sha256."""
    rows = verified(common.written(spark, recipes(docs), "recipes"))
    # Rows that repeat in full are one row with a count from here on. Every grouping sums before it shuffles, so a group
    # that holds a third of all rows arrives as one row a task.
    distinct = rows.groupBy("recipe", "told_apart", "doc_id", "th", "n_points", "text_sha256").agg(F.count("*").alias("times"))
    first = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    groups = distinct.groupBy("recipe", "told_apart").agg(F.min(first).alias("best"), F.sum("times").alias("group_size"))
    groups = common.written(spark, groups, "recipe-groups").select(F.col("recipe").alias("g_recipe"), F.col("told_apart").alias("g_told"), "best", "group_size")
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("told_apart").eqNullSafe(F.col("g_told"))
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    # The rows of a large group meet one row here; Spark splits such a partition of a sort-merge join.
    return distinct.join(groups.hint("merge"), same).select("doc_id", "th", "times", F.col("best.doc_id").alias("keep_id"), "group_size", is_best.alias("is_best"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(spark, common.table(spark, sf_dir, "documents"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("is_best") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts, in the columns it came with."""
    best = common.written(spark, grouped(spark, docs).filter("is_best").select("doc_id", "th", "times"), "kept-texts")
    return common.kept_rows(docs, best)


ORACLE = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER g = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
