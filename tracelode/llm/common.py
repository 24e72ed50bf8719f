"""What the operators of this subpackage share: tables, row keys and a place for intermediate tables.

A document row is told apart by ``(doc_id, text key)``, where the text key is a 64-bit hash of the text.
The pair needs no row numbers, so a recomputed task gives the same key. Rows that repeat both are the same
document written twice; every operator says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import new_path

#: The characters `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and its size is that of real files."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty), text key ``th`` and the columns asked for; other columns stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), *more)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose key is in `kept` (doc_id, th, times), one for each key, in the columns of `docs`.

    `kept` is a written table. The texts are shuffled once; the other side, two numbers a row, is the one that is hashed."""
    side = kept.select(F.struct("doc_id", "th").alias("__kept")).hint("shuffle_hash")
    rows = docs.withColumn("__th", text_key(F.col("text")))
    rows = rows.join(side, F.col("doc_id").eqNullSafe(F.col("__kept.doc_id")) & (F.col("__th") == F.col("__kept.th")), "left_semi")
    if not kept.filter("times > 1").isEmpty():
        # Some rows repeat in full; of those one stays.
        rows = rows.dropDuplicates(["doc_id", "__th"])
    return rows.drop("__th")
