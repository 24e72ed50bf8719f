"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 40-bit hash. A source that is to give `target` words first gives each of its documents
`floor(target / size)` times; the rest of its budget is the set of documents whose hash lies below a threshold.
The threshold comes from a histogram of words by (source, hash bucket): the bucket in which the running sum crosses
the budget is the only one that is refined, with the next bits of the hash. Nothing is sorted, budgets nest (a larger
budget keeps what a smaller one took), and only histograms are shuffled, summed before the shuffle.

Defined cases: null text counts 0 words; the null source is a source of its own, last in order; rows that repeat
doc_id, text and source are numbered, in any order, and the number is part of the hash, so they are taken one by one; documents without words take 0, and a source of nothing else has target 0; windows over all sources run in one task, which suits up to some millions of sources; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of each histogram level, and levels.
BITS, LEVELS = 10, 4
#: Parts in which rows that repeat are numbered.
SALTS = 64
#: Joins against the table of sources broadcast it up to so many sources; beyond, it is a sort-merge join.
BROADCAST_SOURCES = 10_000
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(seed: int) -> F.Column:
    """From doc_id, text key `th` and the number `k` of the row among its equals; the first has no number in its hash."""
    first, more = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th")), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th"), F.col("k"))
    return F.shiftrightunsigned(F.when(F.col("k") == 1, first).otherwise(more), 64 - BITS * LEVELS)


def numbered(spark: SparkSession, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """`rows` (doc_id, th, source and more) with `k`: 1 to n among rows that are equal in these three, in any order.

    repeated: the keys that occur more than once, a written table. Rows of such a key are dealt over SALTS parts, numbered in each, and moved on by what the parts before hold."""
    if repeated.isEmpty():
        return rows.withColumn("k", F.lit(1).cast("long"))
    key = ["doc_id", "th", "source"]
    keys = repeated.select(F.struct(*key).alias("__key")).hint("merge")
    on = F.struct(*key).eqNullSafe(F.col("__key"))
    single = rows.join(keys, on, "left_anti").withColumn("k", F.lit(1).cast("long"))
    several = rows.join(keys, on, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    several = common.written(spark, several, "mix-repeated")
    before = Window.partitionBy(*key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = several.groupBy(*key, "__salt").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.struct(*key, "__salt").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(F.lit(0)))
    several = several.withColumn("__n", inside).join(parts.hint("merge"), F.struct(*key, "__salt").eqNullSafe(F.col("__part")))
    return single.unionByName(several.withColumn("k", F.col("__n") + F.col("__before")).select(*single.columns))


def sized(spark: SparkSession, docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs: doc_id, source, size, hash; and the keys of rows that repeat."""
    rows = common.written(spark, docs.select("doc_id", "source", words(F.col("text")).alias("size"), common.text_key(F.col("text")).alias("th")), "mix-rows")
    key = ["doc_id", "th", "source"]
    repeated = common.written(spark, rows.groupBy(*key).count().filter("count > 1").select(*key), "mix-repeated-keys")
    sizes = numbered(spark, rows, repeated).select("doc_id", "source", "size", hash_of(seed).alias("h"))
    return common.written(spark, sizes, "mix-sizes"), repeated


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Source, size, target: weights repeat over the sources in order; a target stops at `most` times the size and
    the excess is shared again by weight. With sources by ascending cap / weight, the level of the water is the largest
    of (budget - caps before) / (weights from here on). One row per source, so its one-task window is small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, after, all_rows = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    return per.withColumn("level", level).select("source", "source_size", F.least("cap", F.max("level").over(all_rows) * F.col("w")).alias("target"))


def thresholds(spark: SparkSession, sizes: DataFrame, goal: DataFrame, hint: str) -> DataFrame:
    """Adds to each source `repeats` and `below`: documents with a hash under `below` are taken once more."""
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0)
    state = goal.withColumn("repeats", repeats.cast("long")).withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("at", F.lit(0).cast("long"))
    for depth in range(LEVELS):
        shift = BITS * (LEVELS - 1 - depth)
        now = state.select(F.col("source").alias("s"), "at")
        inside = sizes.join(now.hint(hint), F.col("source").eqNullSafe(F.col("s")))
        if depth:
            inside = inside.filter(F.shiftright("h", shift + BITS) == F.col("at"))
        bins = inside.groupBy("s", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("in_bin"))
        running = bins.withColumn("upto", F.sum("in_bin").over(Window.partitionBy("s").orderBy("bin")))
        crossed = running.join(state.select(F.col("source").alias("s2"), "need").hint(hint), F.col("s").eqNullSafe(F.col("s2"))).filter(F.col("upto") > F.col("need"))
        edge = crossed.groupBy("s").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"), "in_bin"), "bin").alias("e"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        # No bucket crosses: the whole source falls short of its need, which only rounding can cause.
        at = F.coalesce(F.col("e.bin"), F.lit((1 << BITS * (depth + 1)) - 1))
        state = joined.select("source", "source_size", "target", "repeats", (F.col("need") - F.coalesce(F.col("e.before"), F.lit(0))).alias("need"), at.alias("at"), F.col("e.in_bin").alias("last"))
        # The next level refers to this one several times; as a table it is computed once.
        state = common.written(spark, state, "mix-level")
    # What is left of the boundary bucket is taken whole if that comes nearer to the budget. A source that needs nothing beyond its repeats takes nothing more.
    edge = F.col("at") + F.coalesce(F.col("need") > F.col("last") / 2, F.lit(False)).cast("long")
    whole = F.col("target") <= F.col("repeats") * F.col("source_size")
    return state.select("source", "source_size", "target", "repeats", F.when(whole, F.lit(0).cast("long")).otherwise(edge).alias("below"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, str, DataFrame]:
    """Sizes of all rows, the table of sources with thresholds, the hint for joins with it, and the keys of rows that repeat."""
    sizes, repeated = sized(spark, docs, seed)
    goal = common.written(spark, targets(sizes), "mix-targets")
    hint = "broadcast" if goal.count() <= BROADCAST_SOURCES else "merge"
    return sizes, thresholds(spark, sizes, goal, hint), hint, repeated


def taken(rows: DataFrame, goal: DataFrame, hint: str) -> DataFrame:
    goal = goal.withColumnRenamed("source", "goal_source").hint(hint)
    copies = (F.col("repeats") + (F.col("h") < F.col("below")).cast("long")).alias("copies")
    return rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(*mix(spark, common.table(spark, sf_dir, "documents"))[:3])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns it came with."""
    _, goal, hint, repeated = mix(spark, docs)
    goal = goal.select(F.struct("source", "repeats", "below").alias("__goal")).hint(hint)
    # Columns of the documents may have any name, so they travel in one.
    rows = docs.select("doc_id", common.text_key(F.col("text")).alias("th"), "source", F.struct(*docs.columns).alias("__row"))
    rows = numbered(spark, rows, repeated).join(goal, F.col("source").eqNullSafe(F.col("__goal.source")))
    times = F.col("__goal.repeats") + (hash_of(0) < F.col("__goal.below")).cast("long")
    return rows.select("__row", times.alias("__times")).filter("__times > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
