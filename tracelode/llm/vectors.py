"""Exact top-k search by inner product with vector-approximation files.

Components become integers floor(1024 x). Equal vectors are one class that remembers its k + 1 smallest distinct ids and how often each
occurs, as no answer can need more of it. The approximation file holds one byte per component of each class: its cell between the component's least and greatest value in the table.
A cell gives an upper and a lower bound of the inner product. The file is scanned where it lies, once for every block of queries, which is a broadcast variable of
bounded bytes; cells are never shuffled. A task keeps, of each query, the k best lower bounds it has seen so far and gives out the classes whose upper bound reaches the least of them.
Over all tasks the k-th best lower bound is raised, and what cannot reach it falls out. Exact vectors are then read in bound order, in two steps: the first k candidates of
each query give its k-th exact score, and of the others only those whose bound reaches that score are read. Nothing is approximate in the result.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, neither as query nor as candidate; vectors meet only vectors
of their own length; a score that does not fit 64 bits stops the query with Spark's overflow error; rows that repeat a vec_id are candidates each; a query's own
rows (its vec_id) never answer it; a null vec_id is no query and no candidate; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cluster import new_path
from . import common

K, EVERY = 10, 100
CELLS = 256
#: Classes and queries that are multiplied at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Bytes of the queries of one scan, which pass through the driver.
BLOCK_BYTES = 16 << 20
FOUND = "query_id long, qn int, cls long, low double, high double"
#: Parts of a query's candidates where they meet what is known of the query.
SALTS = 16


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and integer vector `v` of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 1024)).alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """class id (a number given as the table is written, since one vec_id can be the smallest of several classes), vector, the k + 1 smallest distinct ids with their counts, and the id if there is only one; the rank is limited before the shuffle."""
    rows = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).select(F.monotonically_increasing_id().alias("cls"), "v", "ids", F.when(F.size("ids") == 1, F.get("ids", 0)["vec_id"]).alias("lone"), F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def bounds_udf(k: int, scale, asked):
    """Candidates of one block of queries among the cells of a task. Bounds are sums in double precision of integers far below 2^53, widened by one cell step's rounding. `asked` is a broadcast variable: for each length of vectors ids, numbers and matrix of the queries."""

    def pair(rows: pa.RecordBatch, dim: int, first: int, best: np.ndarray) -> pa.RecordBatch:
        ids, numbers, matrix = (x[first : first + BLOCK_QUERIES] for x in asked.value[dim])
        lo, step = scale.value[dim]
        cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, dim).astype(float)
        cell_lo, cell_hi = lo + cells * step, lo + (cells + 1) * step
        q = matrix.astype(float)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(lo + CELLS * step)))[:, None] + 1e-6
        high = up @ cell_hi.T + down @ cell_lo.T + slack
        low = up @ cell_lo.T + down @ cell_hi.T - slack
        # A class that holds only the query's own id is no candidate; any other stands for at least one answer, so the bound is of rank k.
        lone = rows.column("lone")
        barred = (ids[:, None] == lone.fill_null(0).to_numpy(zero_copy_only=False)) & lone.is_valid().to_numpy(zero_copy_only=False)
        low[barred] = -np.inf
        best[:] = np.partition(np.hstack([best, low]), -k, axis=1)[:, -k:]
        a, b = np.nonzero((high >= best.min(axis=1)[:, None]) & ~barred)
        columns = [pa.array(ids[a]), pa.array(numbers[a], pa.int32()), rows.column("cls").take(pa.array(b)), pa.array(low[a, b]), pa.array(high[a, b])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "qn", "cls", "low", "high"])

    def scan(batches):
        best = {dim: np.full((len(ids), k), -np.inf) for dim, (ids, _, _) in asked.value.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(best):
                rows = batch.filter(pa.array(dims == dim))
                for i in range(0, rows.num_rows, BLOCK_ROWS):
                    for first in range(0, len(best[dim]), BLOCK_QUERIES):
                        yield pair(rows.slice(i, BLOCK_ROWS), dim, first, best[dim][first : first + BLOCK_QUERIES])

    return scan


def query_matrices(block: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries of one block, of bounded bytes, by the length of their vectors."""
    rows = block.select("query_id", "qn", "v", "dim").toArrow()
    out = {}
    for dim in pc.unique(rows.column("dim")).to_pylist():
        some = rows.filter(pc.equal(rows.column("dim"), dim))
        out[dim] = some.column("query_id").to_numpy(), some.column("qn").to_numpy(), _matrix(some.column("v").combine_chunks(), dim, np.int64)
    return out


def candidates(spark: SparkSession, asked: DataFrame, coded: DataFrame, k: int, scale) -> DataFrame:
    """Classes that may be among a query's k best, by one scan of the cells for each block of queries."""
    blocks = max(1, -(-(asked.agg(F.sum("dim")).first()[0] or 0) * 8 // BLOCK_BYTES))
    path, found = new_path(spark, "vector-query-blocks"), new_path(spark, "vector-candidates")
    placed = asked.withColumn("qb", F.pmod(F.xxhash64("query_id", "qn"), F.lit(blocks)))
    placed.repartition(blocks, "qb").write.partitionBy("qb").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    for b in range(blocks):
        block = spark.sparkContext.broadcast(query_matrices(placed.filter(F.col("qb") == b)))
        rows = coded.mapInArrow(bounds_udf(k, scale, block), FOUND)
        rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).write.mode("append").parquet(found)
        block.unpersist()
    return spark.read.schema(FOUND + ", part int").parquet(found)


def scales(reps: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the least value and the step of a cell of every component; as many numbers as the lengths that occur sum to."""
    spans = reps.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[int, list] = {}
    for r in sorted(spans.collect(), key=lambda r: r.i):
        out.setdefault(r.dim, []).append((float(r.lo), (r.hi - r.lo + 1) / CELLS))
    return {dim: (np.array([x[0] for x in s]), np.array([x[1] for x in s])) for dim, s in out.items()}


def approximated(reps: DataFrame, scale) -> DataFrame:
    """Classes with their cells, one byte a component; `scale` is the broadcast variable of `scales`."""

    @F.arrow_udf("binary")
    def cells(v: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(v).to_numpy()
        flat, ends = v.flatten().to_numpy().astype(float), np.cumsum(lengths)
        out = np.empty(len(v), object)
        for dim in np.unique(lengths):
            lo, step = scale.value[int(dim)]
            at = np.flatnonzero(lengths == dim)
            x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
            coded = np.clip(np.floor((x - lo) / step), 0, CELLS - 1).astype(np.uint8)
            out[at] = [c.tobytes() for c in coded]
        return pa.array(out.tolist(), pa.binary())

    return reps.withColumn("cells", cells("v"))


def salted(rows: DataFrame, as_: str) -> DataFrame:
    """`rows` once for every part of a query's candidates."""
    return rows.withColumn(as_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    rows = common.written(spark, integers(vectors), "vectors")
    reps = common.written(spark, classes(rows, k).filter("dim > 0"), "vector-classes")
    scale = spark.sparkContext.broadcast(scales(reps))
    coded = common.written(spark, approximated(reps, scale).select("cls", "lone", "dim", "cells"), "vector-cells")
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")).filter("dim > 0")
    # Several vectors under one query_id are told apart by `qn`; each has bounds of its own.
    asked = asked.withColumn("qn", F.row_number().over(Window.partitionBy("query_id").orderBy("v")))
    asked = common.written(spark, asked, "vector-queries")
    found = candidates(spark, asked, coded, k, scale)
    # The k-th best lower bound of each query over all tasks; both ranks here are limited to k before the shuffle. A query with very many
    # candidates meets its bound in parts, so that they do not come into one task.
    place = F.row_number().over(Window.partitionBy("query_id", "qn").orderBy(F.desc("low")))
    floor = found.withColumn("p", place).filter(F.col("p") == k).select(F.col("query_id").alias("f_id"), F.col("qn").alias("f_qn"), F.col("low").alias("floor"))
    of_floor = (F.col("query_id") == F.col("f_id")) & (F.col("qn") == F.col("f_qn")) & (F.col("part") == F.col("f_part"))
    kept = found.join(salted(floor, "f_part").hint("shuffle_hash"), of_floor, "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    kept = common.written(spark, kept.select("query_id", "qn", "cls", "part", "high"), "vector-kept")
    place = F.row_number().over(Window.partitionBy("query_id", "qn").orderBy(F.desc("high"), "cls"))
    top = common.written(spark, kept.withColumn("p", place).filter(F.col("p") <= k), "vector-top")

    def exact(pairs: DataFrame) -> DataFrame:
        full = reps.select("cls", F.col("v").alias("w"), "ids").hint("merge")
        q = salted(asked.select(F.col("query_id").alias("q_id"), F.col("qn").alias("q_qn"), F.col("v").alias("q"), F.col("dim").alias("q_dim")), "q_part").hint("merge")
        # Spark splits the partition of a class that very many queries ask for.
        both = pairs.join(full, "cls").join(q, (F.col("query_id") == F.col("q_id")) & (F.col("qn") == F.col("q_qn")) & (F.col("part") == F.col("q_part")) & (F.size("w") == F.col("q_dim")))
        score = F.aggregate(F.zip_with("q", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return both.select("query_id", "qn", "ids", score.alias("score"))

    first = common.written(spark, exact(top), "vector-first")
    # With k exact scores the k-th certain score is known. A query with fewer candidates has been read in full; of the others, what comes after
    # the first k in bound order and may still reach the score is read now.
    sure = first.groupBy("query_id", "qn").agg(F.min("score").alias("least"))
    edge = top.filter(F.col("p") == k).select(F.col("query_id").alias("s_id"), F.col("qn").alias("s_qn"), F.col("high").alias("e_high"), F.col("cls").alias("e_cls"))
    sure = sure.join(edge.hint("shuffle_hash"), (F.col("query_id") == F.col("s_id")) & (F.col("qn") == F.col("s_qn"))).select("s_id", "s_qn", "least", "e_high", "e_cls")
    after = (F.col("high") < F.col("e_high")) | ((F.col("high") == F.col("e_high")) & (F.col("cls") > F.col("e_cls")))
    of_sure = (F.col("query_id") == F.col("s_id")) & (F.col("qn") == F.col("s_qn")) & (F.col("part") == F.col("s_part"))
    rest = kept.join(salted(sure, "s_part").hint("shuffle_hash"), of_sure).filter((F.col("high") >= F.col("least")) & after).select("query_id", "qn", "cls", "part")
    scores = first.unionByName(exact(rest))
    answers = scores.select("query_id", F.explode("ids").alias("i"), "score").filter("i.vec_id != query_id")
    # Rows that repeat an id are answers each, of which no query needs more than k.
    answers = answers.select("query_id", F.explode(F.array_repeat("i.vec_id", F.least("i.n", F.lit(k)).cast("int"))).alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
