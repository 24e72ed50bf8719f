"""Sharding by k-d tree partitioning, with DataFrame functions only.

The unit that is placed is a group of equal texts; a group larger than a quarter of a shard is cut into pieces
by document and row number, so that a huge group of copies, or one row repeated without end, is spread. Units lie in a space of metadata: first doc_id, text
bytes, source and language codes. A node that is to become n shards is split at the weighted quantile floor(n/2)/n of
its widest dimension (relative to the whole table). The quantile is found for all nodes of a level at once: a histogram
of bytes over 1,024 bins of the dimension, then, inside the bin that the budget crosses, a histogram over 1,024 hash buckets,
so ties on a dimension split evenly. The boxes of the halves follow from the cut. The driver holds the histograms of a level, 1,024 rows for each of
fewer nodes than there are shards, whatever the size of the table; the tasks get the cuts as literals. Every level is written, so none is computed twice.

The law that holds is `bytes`: shards have nearly equal sizes.
Defined cases: a null text has no bytes (size 16) and equals the empty text; null doc_id, source or lang
take code 0; rows repeated in full stay apart and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Bins of a histogram.
BINS = 1 << 10
#: Rows of one (shard, bucket) that get their slots in one window.
SLOT_ROWS = 4096
DIMENSIONS = ("x_id", "x_bytes", "x_source", "x_lang")


def rows_of(docs: DataFrame) -> DataFrame:
    """One narrow row per document, with a number that the written table keeps; the text is read once and not kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).cast("double")
    return docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text).alias("g2"), code("source").alias("c_source"), code("lang").alias("c_lang"),
    )


def units_of(rows: DataFrame, count: int, total: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the piece of their group they belong to and whether the group is large, and one row per unit."""
    most, many = max(1, total // (4 * shards)), max(1, count // (4 * shards))
    large = rows.groupBy("g1", "g2").agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("group_rows"))
    large = large.filter((F.col("group_bytes") > most) | (F.col("group_rows") > many))
    pieces = F.when(F.col("group_bytes") > most, F.ceil(F.col("group_bytes") / (most / 16))).otherwise(1)
    # At most 4 * shards groups have so many bytes, and as many have so many rows, which bounds the broadcast.
    large = large.select(F.col("g1").alias("l1"), F.col("g2").alias("l2"), pieces.alias("pieces"))
    rows = rows.join(large.hint("broadcast"), (F.col("g1") == F.col("l1")) & (F.col("g2") == F.col("l2")), "left")
    piece = F.when(F.coalesce("pieces", F.lit(1)) == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")))
    rows = rows.withColumn("piece", piece.cast("long")).withColumn("large", F.col("pieces").isNotNull()).drop("l1", "l2", "pieces")
    units = rows.groupBy("g1", "g2", "piece").agg(
        F.sum("size").alias("bytes"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("x_id"),
        F.max("size").cast("double").alias("x_bytes"), F.min("c_source").alias("x_source"), F.min("c_lang").alias("x_lang"), F.first("large").alias("large"),
    )
    return rows, units.withColumn("tie", F.pmod(F.xxhash64("g1", "g2", "piece"), F.lit(BINS)))


def of_node(values: dict[int, float], shards: int, kind: str = "double") -> Column:
    """The value of the row's node, from literals; null for nodes without one. A node is a number below `shards`."""
    return F.expr(f"array({', '.join(f'CAST({values[k]!r} AS {kind})' if k in values else f'CAST(NULL AS {kind})' for k in range(shards))})[node]")


def crossing(bins: DataFrame, need: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """For each node the bin in which the running sum of bytes passes its need, the sum before it, and its bytes. bins: node, bin, bytes.
    The driver gets the histograms, `BINS` rows for each of fewer nodes than shards."""
    rows = bins.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect()
    upto, out = {}, {}
    for node, bin_, size in sorted(rows):
        before = upto.get(node, 0)
        upto[node] = before + size
        if node not in out and upto[node] > need[node]:
            out[node] = (bin_, float(before), float(size))
    return out


def binned(placed: DataFrame, cuts: dict[int, tuple[int, float, float]], shards: int) -> DataFrame:
    """The bin of each unit on the dimension that its node is cut along (dimension, least value, width); units of finished nodes have none."""
    dim, low, width = (of_node({k: v[i] for k, v in cuts.items()}, shards, kind) for i, kind in enumerate(("int", "double", "double")))
    x = F.floor((F.element_at(F.array(*DIMENSIONS), dim) - low) / width * BINS)
    return placed.withColumn("bin", F.when(width > 0, F.greatest(F.least(x, F.lit(BINS - 1)), F.lit(0))).when(dim.isNotNull(), 0).cast("long"))


def assigned(spark: SparkSession, units: DataFrame, shards: int) -> DataFrame:
    """Units with their leaf as `node`, the number of its shard. A node is named by its first shard."""
    placed = units.withColumn("node", F.lit(0))
    columns = placed.columns
    root = units.agg(F.sum("bytes"), *[f(d) for d in DIMENSIONS for f in (F.min, F.max)]).first()
    if root[0] is None or shards < 2:
        return placed
    whole = [root[2 * i + 2] - root[2 * i + 1] for i in range(len(DIMENSIONS))]
    # Of each node that is still to be cut: shards, bytes, and the box its units lie in.
    nodes = {0: (shards, root[0], [(root[2 * i + 1], root[2 * i + 2]) for i in range(len(DIMENSIONS))])}
    while nodes:
        cuts, need = {}, {}
        for k, (n, size, box) in nodes.items():
            dim = max(range(len(DIMENSIONS)), key=lambda i: (box[i][1] - box[i][0]) / whole[i] if whole[i] else 0.0)
            cuts[k] = (dim + 1, box[dim][0], box[dim][1] - box[dim][0])
            need[k] = size * (n // 2) / n
        bins = binned(placed, cuts, shards)
        first = crossing(bins.filter("bin IS NOT NULL"), need)
        edge = of_node({k: e[0] for k, e in first.items()}, shards, "long")
        left = {k: need[k] - e[1] for k, e in first.items()}
        second = crossing(bins.filter(F.col("bin") == edge).select("node", F.col("tie").alias("bin"), "bytes"), left)
        ties, children = {}, {}
        for k, (at, before, _) in first.items():
            tie, passed, inside = second.get(k, (BINS, 0.0, 0.0))
            over = left[k] - passed > inside / 2
            ties[k] = tie + int(over)
            n, size, box = nodes[k]
            dim, low, width = cuts[k]
            given = before + passed + (inside if over else 0)
            # Units of the edge bin lie on both sides.
            upper, lower = list(box), list(box)
            lower[dim - 1], upper[dim - 1] = (low, low + width * (at + 1) / BINS), (low + width * at / BINS, low + width)
            children |= {k: (n // 2, given, lower), k + n // 2: (n - n // 2, size - given, upper)}
        right = (F.col("bin") > edge) | ((F.col("bin") == edge) & (F.col("tie") >= of_node(ties, shards, "long")))
        step = of_node({k: nodes[k][0] // 2 for k in first}, shards, "int")
        moved = bins.withColumn("node", F.col("node") + F.when(right, step).otherwise(0)).select(*columns)
        # A node without bytes has no units.
        nodes = {k: c for k, c in children.items() if c[0] > 1 and c[1] > 0}
        placed = common.written(spark, moved, "shard-level") if nodes else moved
    return placed


def sharded(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with shard and slot. Slots are gapless: an offset for each (shard, bucket) plus a rank inside it."""
    rows = common.written(spark, rows_of(docs), "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows, units = units_of(rows, n, total, shards)
    placed = assigned(spark, common.written(spark, units, "shard-units"), shards)
    placed = common.written(spark, placed.select(F.col("g1").alias("u1"), F.col("g2").alias("u2"), F.col("piece").alias("u3"), "large", F.col("node").cast("int").alias("shard")), "shard-units-placed")
    same = (F.col("g1") == F.col("u1")) & (F.col("g2") == F.col("u2")) & (F.col("piece") == F.col("u3"))
    # Rows of large groups meet their units, a number bounded by that of the shards, by broadcast; no key of the others is hot.
    small = rows.filter("NOT large").drop("large").join(placed.filter("NOT large").hint("merge"), same)
    large = rows.filter("large").drop("large").join(placed.filter("large").hint("broadcast"), same)
    buckets = max(1, math.ceil(n / shards / SLOT_ROWS))
    columns = ["doc_id", "size", "text_crc32", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")]
    out = common.written(spark, small.select(*columns).unionByName(large.select(*columns)), "shard-placed")
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("bucket").alias("o_bucket"), (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")))
    at = (F.col("shard") == F.col("o_shard")) & (F.col("bucket") == F.col("o_bucket"))
    return ranked.join(offsets.hint("merge"), at).withColumn("slot", F.col("offset") + F.col("rank") - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark, common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
