"""Near-duplicate detection: SetSketch registers in bands, joint likelihood, exact verification, connected components.

1. One pass over the texts gives each document its shingle set's size, a 128-bit digest of the set and its registers. Documents with equal sets
   are one node from here on.
2. Four registers each make 32 bands. Nodes that agree in a band share a bucket. (band, node) rows are range partitioned by both and streamed, so a band that a
   third of all nodes share is spread, and rows that are alone in their band fall out before anything is grouped. What is known of a band (company, pivot) meets its rows
   by (band, partition they were written from), so a large band stays spread.
3. Each bucket takes as pivot its node with the most company. (pivot, node) pairs, one a row at most, pass the joint likelihood of their registers
   and are verified on the full sets, which come from the texts of the surviving nodes; the spokes of a pivot are dealt over `SALTS` parts. Components of these links are labels.
4. Pairs without the pivot: a bucket's rows that some other row may reach by its registers are compared on the full sets, but only across labels; copies that
   the pivot has joined cost nothing more. Large buckets are cut into blocks, and pairs of blocks are compared like buckets. A pair is
   looked at in the first band it shares only. Nothing is capped: every pair that shares a band is either linked, given up by the likelihood, or of one component.

With similarity s and independent registers a pair shares no band with probability (1 - s^4)^32: at s = 0.75 that is 5 in a million. Registers of tiny sets are
not independent; sets of up to `TINY` shingles are similar only if one is the other and a single shingle more, and these links are found exactly, by the digests
of a set without each of its shingles. Joins on a node or a label are sort-merge joins, whose hot partitions (a hub of links, the label of a large group) Spark splits.

Defined cases: null texts, and texts without words, have the empty set and are linked with nothing; documents with fewer than five words have one shingle; a null
doc_id is a document like others, and is never a component's id unless all of it lack one; rows that repeat in full have equal sets and so one component.
An empty table gives an empty result. doc_id must be a number or the text of one; it is cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, sketch, wordhash

SIMILARITY = 75  # of a hundred
WORDS = 5
#: Rows, and shingles, of a block of a large bucket.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 18
#: Parts of a key that may be hot.
SALTS = 64
#: Links between sets of at most so many shingles are found without sketches.
TINY = 6


def _batch(names, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _sets(texts: pa.Array):
    data, offsets = wordhash.buffers(texts)
    for a, b in wordhash.slices(offsets):
        yield a, b, wordhash.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _without_one(s: np.ndarray) -> list[bytes] | None:
    """Digests of the set without each of its shingles, where such a subset is similar and both are tiny."""
    n = len(s)
    return [_digest(np.delete(s, i)) for i in range(n)] if 2 <= n <= TINY and 100 * (n - 1) >= SIMILARITY * n else None


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, sets in _sets(batch.column("text")):
                regs = sketch.registers(sets)
                node = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
                subsets = pa.array([_without_one(s) for s in sets], pa.list_(pa.binary()))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                registers = pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets)], pa.binary())
                ids, th = (batch.column(c).slice(a, b - a) for c in ("doc_id", "th"))
                yield _batch(["doc_id", "th", "n_shingles", "node", "regs", "subsets"], ids, th, sizes, node, registers, subsets)

    return common.keyed(docs).select(F.col("doc_id").cast("long"), "text", "th").mapInArrow(run, "doc_id long, th long, n_shingles long, node binary, regs binary, subsets array<binary>")


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, sketch.REGISTERS)


def band_rows(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = sketch.band_keys(_registers(batch.column("regs")))
                at = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                yield _batch(["band", "node"], pa.array(keys.ravel()), batch.column("node").take(at))

    return nodes.select("node", "regs").mapInArrow(run, "band long, node binary")


def shared_bands(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(band, node) rows of bands with company; a row at the edge of a partition may be alone."""

    def run(batches):
        held = previous = None  # the last row so far, if nothing shares its band yet; its band
        for batch in batches:
            if not batch.num_rows:
                continue
            band = batch.column("band").to_numpy()
            same = band[1:] == band[:-1]
            company = np.zeros(len(band), bool)
            company[1:] |= same
            company[:-1] |= same
            company[0] |= previous is None or band[0] == previous
            if held is not None and band[0] == previous:
                yield held
            held, previous = None if company[-1] else batch.slice(len(band) - 1), band[-1]
            if company.any():
                yield batch.filter(pa.array(company))
        if held is not None:
            yield held

    rows = band_rows(nodes).repartitionByRange(common.parts(spark), "band", "node").sortWithinPartitions("band", "node")
    return rows.mapInArrow(run, "band long, node binary")


def runs(batches, keys):
    """Tables of consecutive rows with equal keys, over batch borders."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            v = np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(c[a].as_py() for c in columns)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def first_band(keys: np.ndarray, i: int, others: np.ndarray, band: int) -> np.ndarray:
    """Which of `others` share no earlier band with row i."""
    c = int(np.argmax(keys[i] == band))
    return ~(keys[others, :c] == keys[i, :c]).any(1)


def common_counts(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat(one[at] == flat, np.cumsum([0, *map(len, many[:-1])]))


def linked(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    both = common_counts(one, many)
    return 100 * both >= SIMILARITY * (len(one) + np.array([len(x) for x in many]) - both)


def in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """Adds `blocks`, the number of blocks a bucket is cut into, and `block`, the row's own."""
    return rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def salt():
    return F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")


def block_pairs(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """Every row once for each block that its own meets, sorted so that the rows of a pair of blocks stand together."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = rows.select("*", other).withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other", "blocks")
    return paired.repartition(common.parts(spark), key, "b1", "b2").sortWithinPartitions(key, "b1", "b2", "node")


def reachable_rows(batches):
    """(band, node, n) of rows that another row, not the pivot, may be similar to; both in the first band they share."""
    for t in runs(batches, ["band", "b1", "b2"]):
        regs, sizes = _registers(t.column("regs")), t.column("n").to_numpy()
        keys, band, block = sketch.band_keys(regs), t.column("band")[0].as_py(), t.column("block").to_numpy()
        nodes = np.array(t.column("node").to_pylist(), object)
        rest, across = np.flatnonzero(nodes != t.column("pivot")[0].as_py()), t.column("b1")[0].as_py() != t.column("b2")[0].as_py()
        hit = np.zeros(len(nodes), bool)
        for x, i in enumerate(rest[:-1]):
            others = rest[x + 1 :]
            if across:
                others = others[block[others] != block[i]]
            others = others[first_band(keys, i, others, band)]
            if len(others):
                others = others[sketch.may_reach(regs[others], np.broadcast_to(regs[i], (len(others), regs.shape[1])), sizes[others], np.full(len(others), sizes[i]))]
                hit[others] = True
                hit[i] |= len(others) > 0
        if hit.any():
            yield _batch(["band", "node", "n"], pa.array(np.full(int(hit.sum()), band, np.int64)), pa.array(nodes[hit].tolist(), pa.binary()), pa.array(sizes[hit]))


def star_links(batches):
    """Links between pivots and their spokes. A pivot stands before the spokes of each of its parts, and only its set is held."""
    pivot = own = None
    for batch in batches:
        pivots, nodes, sets = (batch.column(c).to_pylist() for c in ("pivot", "node", "set"))
        links, spokes = [], []

        def compared(links=links, spokes=spokes):
            if spokes:
                good = linked(own, [s for _, s in spokes])
                links.extend((pivot, n) for (n, _), ok in zip(spokes, good) if ok)
                spokes.clear()

        for p, n, s in zip(pivots, nodes, sets):
            if n == p:
                compared()
                pivot, own = p, np.frombuffer(s, np.uint64)
            elif p == pivot:
                spokes.append((n, np.frombuffer(s, np.uint64)))
        compared()
        if links:
            yield _batch(["a", "b"], pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary()))


def cross_links(batches):
    """Links across labels, each joining two labels of the block pair that nothing before in it has joined."""
    for t in runs(batches, ["band", "b1", "b2"]):
        regs, sizes = _registers(t.column("regs")), t.column("n").to_numpy()
        keys, band, block = sketch.band_keys(regs), t.column("band")[0].as_py(), t.column("block").to_numpy()
        nodes, across = t.column("node").to_pylist(), t.column("b1")[0].as_py() != t.column("b2")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        names = {}
        labels = np.array([names.setdefault(x, len(names)) for x in t.column("label").to_pylist()])
        out = []
        for i in range(len(nodes) - 1):
            others = np.arange(i + 1, len(nodes))
            others = others[labels[others] != labels[i]]
            if across:
                others = others[block[others] != block[i]]
            others = others[first_band(keys, i, others, band)] if len(others) else others
            if len(others):
                others = others[sketch.may_reach(regs[others], np.broadcast_to(regs[i], (len(others), regs.shape[1])), sizes[others], np.full(len(others), sizes[i]))]
            if len(others):
                for j in others[linked(sets[i], [sets[j] for j in others])]:
                    if labels[i] != labels[j]:
                        out.append((nodes[i], nodes[j]))
                        labels[labels == labels[j]] = labels[i]
        if out:
            yield _batch(["a", "b"], pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary()))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of the links. Labels go to neighbours, and each round also follows
    the label of the label, so rounds are few even for long chains; every round is a written table."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.written(spark, both, "links")
    labels = common.written(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("of_node"), F.col("label").alias("of_label"))
        near = both.join(of.hint("merge"), F.col("b") == F.col("of_node")).groupBy("a").agg(F.min("of_label").alias("m"))
        new = labels.join(near.hint("merge"), F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        new = new.join(of.hint("merge"), F.col("label") == F.col("of_node")).select("node", "old", F.least("label", "of_label").alias("label"))
        new = common.written(spark, new, "labels")
        done = new.filter("label != old").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def clustered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, th, n_shingles, best (doc_id and th of the row that stands for its component)."""
    rows = common.written(spark, sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("best")
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("subsets").alias("subsets"), first)
    nodes = common.written(spark, nodes, "nodes")
    buckets = common.written(spark, shared_bands(spark, nodes).withColumn("piece", F.spark_partition_id()), "buckets")

    # Pivots: of each bucket the node with the most company over all bands.
    pieces = buckets.groupBy("band", "piece").agg(F.count("*").alias("n"))
    company = pieces.groupBy("band").agg(F.sum("n").alias("company")).filter("company > 1")
    pieces = common.written(spark, pieces.select("band", "piece").join(company.hint("merge"), "band"), "band-pieces")
    sized = common.written(spark, buckets.join(pieces.hint("merge"), ["band", "piece"]), "sized-buckets")
    degree = sized.groupBy("node").agg(F.sum("company").alias("degree"))
    pivots = sized.join(degree.hint("merge"), "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("p")).select("band", F.col("p.node").alias("pivot"))
    pivots = pieces.select("band", "piece").join(pivots.hint("merge"), "band")
    members = common.written(spark, sized.join(pivots.hint("merge"), ["band", "piece"]), "members")

    # Step 3 on registers.
    facts = nodes.select("node", "n", "regs")
    pairs = members.filter("node != pivot").select("pivot", "node").distinct().join(facts.hint("merge"), "node")
    of_pivot = facts.select(F.col("node").alias("p_node"), F.col("n").alias("p_n"), F.col("regs").alias("p_regs"))

    @F.arrow_udf(T.BooleanType())
    def plausible(n: pa.Array, regs: pa.Array, p_n: pa.Array, p_regs: pa.Array) -> pa.Array:
        return pa.array(sketch.may_reach(_registers(regs), _registers(p_regs), n.to_numpy(), p_n.to_numpy()))

    pairs = pairs.join(of_pivot.hint("merge"), F.col("pivot") == F.col("p_node")).filter(plausible("n", "regs", "p_n", "p_regs"))
    pairs = common.written(spark, pairs.select("pivot", "node", "n"), "star-pairs")

    # Step 4 on registers.
    more = members.filter("company > 2").select("band", "node", "pivot", F.ceil(F.col("company") / BLOCK_ROWS).alias("blocks")).join(facts.hint("merge"), "node")
    more = block_pairs(spark, in_blocks(more, F.col("blocks")), "band")
    more = common.written(spark, more.mapInArrow(reachable_rows, "band long, node binary, n long").distinct(), "reachable-rows")

    # The sets of what is left, from the texts.
    wanted = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).unionByName(more.select("node")).distinct()
    wanted = common.written(spark, nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", F.col("best.doc_id").alias("w_id"), F.col("best.th").alias("w_th")), "wanted")

    def sets_of(batches):
        for batch in batches:
            for a, b, sets in _sets(batch.column("text")):
                yield _batch(["node", "set"], batch.column("node").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()))

    keyed = common.keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = keyed.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    # Rows that repeat in full give the same node; one of them is enough.
    sets = common.written(spark, texts.select("node", "text").mapInArrow(sets_of, "node binary, set binary"), "sets")
    sets = sets.groupBy("node").agg(F.first("set").alias("set")) if not rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty() else sets

    # Step 3 on sets, and the links of tiny sets.
    spoke = pairs.select("pivot", "node", salt())
    hubs = spoke.select("pivot", "salt").distinct().select("pivot", F.col("pivot").alias("node"), "salt")
    star = spoke.unionByName(hubs).join(sets.hint("merge"), "node")
    star = star.repartition(common.parts(spark), "pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("node") != F.col("pivot"))
    tiny = nodes.filter("subsets IS NOT NULL").select(F.explode("subsets").alias("a"), F.col("node").alias("b"))
    tiny = tiny.join(nodes.filter(F.col("n") < TINY).select(F.col("node").alias("a")).hint("merge"), "a", "left_semi")
    star = common.written(spark, star.mapInArrow(star_links, "a binary, b binary").unionByName(tiny), "star-links")
    labels = components(spark, star)

    # Step 4 on sets, across labels.
    label_of = labels.select(F.col("node").alias("l_node"), "label")
    named = more.join(label_of.hint("merge"), F.col("node") == F.col("l_node"), "left").select("band", "node", "n", F.coalesce("label", "node").alias("label"), salt())
    named = common.written(spark, named, "named-rows")
    per = named.groupBy("band", "salt").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("weight"))
    mixed = per.groupBy("band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("blocks")).filter("lo != hi").select("band", "blocks")
    mixed = per.select("band", "salt").join(mixed.hint("merge"), "band")
    left = named.join(mixed.hint("merge"), ["band", "salt"]).drop("salt").join(nodes.select("node", "regs").hint("merge"), "node")
    left = in_blocks(left, F.col("blocks")).join(sets.hint("merge"), "node")
    crossed = common.written(spark, block_pairs(spark, left, "band").mapInArrow(cross_links, "a binary, b binary"), "cross-links")
    if not crossed.isEmpty():
        labels = components(spark, star.unionByName(crossed))

    # The row that stands for each component.
    label_of = labels.select(F.col("node").alias("l_node"), "label")
    placed = nodes.select("node", "best").join(label_of.hint("merge"), F.col("node") == F.col("l_node"), "left").select("node", "best", F.coalesce("label", "node").alias("label"))
    leaders = placed.groupBy("label").agg(F.min("best").alias("best"))
    leaders = placed.select(F.col("node").alias("p_node"), F.col("label").alias("p_label")).join(leaders.hint("merge"), F.col("p_label") == F.col("label")).select("p_node", "best")
    leaders = common.written(spark, leaders, "leaders")
    return rows.select("doc_id", "th", "n_shingles", "node").join(leaders.hint("merge"), F.col("node") == F.col("p_node"), "left").select("doc_id", "th", "n_shingles", "best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(spark, common.table(spark, sf_dir, "documents"))
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, and every document without words, in the columns they came with."""
    out = clustered(spark, docs)
    own = F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.th") == F.col("th")))
    kept = out.filter(own).groupBy("doc_id", "th").agg(F.when(F.max(F.col("best").isNotNull()), F.count("*")).otherwise(1).alias("times"))
    return common.kept_rows(docs, common.written(spark, kept, "kept-nodes"))
