"""Conversation prefix trie: conversations grouped by digests of blocks of turns, turn borders refined only where a block's siblings diverge.

1. Turns are numbered, and every conversation is rebuilt from the opening turns of its hundred's first conversation and its own later turns. Each turn has a digest
   of 128 bits over its position, role and text; a prefix's digest is the exclusive-or of its turns' digests, so prefixes sum up in any order and over partitions.
2. Conversations with equal digests of all turns are one class from here on, which its smallest id stands for.
3. Classes are cut into blocks of `BLOCK` turns. Blocks with equal prefix digests are one group. Where all members of a prefix go on with the same whole block, or
   only one class is left, all nodes inside the block have the same members and need no grouping of their own; elsewhere the block is refined turn by turn. The
   result are units: one or more successive turns whose nodes have the same members.
4. A node belongs to its smallest member, which is also the smallest member of everything below it on its own path. So leaves and saved tokens of a subtree are sums over the
   members of the node, each of which brings what belongs to it: partial sums before the shuffle, and a fixed number of jobs at any depth.

A conversation may hold a third of all turns, and a class a third of all conversations: running values (`running`) are taken over range partitions and joined at their edges, and ids of
a class are streamed. The SHA-256 of a node's ids is sequential by definition: ids of a class that spans partitions are joined into texts where they are and only
these texts are streamed through one task, in bounded memory.

Defined cases: a null conv_id is no conversation; null roles and texts are empty; turns are ordered by number (null first), then by the MD5 of text and role; rows that repeat are turns each;
a conversation without turns after rebuilding is a member of the root alone; ids are divided as in SQL (the remainder has the sign of the id); an empty table has no root and gives an
empty result. conv_id must be a number or the text of one; it is cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a block; openings have up to LENT - 1 turns, lent by the first conversation of each GROUP ids.
BLOCK, LENT, GROUP = 4, 6, 100
#: Ids that are joined to one text before they are streamed.
CHUNK_IDS = 1024
NO_IDS = hashlib.sha256(b"").hexdigest()

ADD, XOR = (np.add, np.subtract, F.sum), (np.bitwise_xor, np.bitwise_xor, F.bit_xor)


def running(spark: SparkSession, rows: DataFrame, order: list[str], values: list[str], kind, name: str) -> DataFrame:
    """`rows` with <value>_before for each value: its sum over the rows of the conversation that stand before. Conversations may span range partitions."""
    plus, minus, total = kind
    columns = rows.columns

    def run(batches):
        piece, conv, carried = TaskContext.get().partitionId(), None, {v: np.int64(0) for v in values}
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            key = batch.column("conv_id").to_numpy()
            opens = np.ones(m, bool)
            opens[1:] = key[1:] != key[:-1]
            opens[0] = key[0] != conv
            start = np.maximum.accumulate(np.where(opens, np.arange(m), -1))
            out = []
            for v in values:
                x = batch.column(v).to_numpy()
                before = minus(plus.accumulate(x), x)
                before = np.where(start < 0, plus(before, carried[v]), minus(before, before[np.maximum(start, 0)]))
                carried[v] = plus(before[-1], x[-1])
                out.append(pa.array(before))
            conv = key[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *out, pa.array(np.full(m, piece, np.int32))], names=[*columns, *(f"{v}_before" for v in values), "piece"])

    schema = rows.schema
    for v in values:
        schema = schema.add(f"{v}_before", "long")
    dealt = rows.repartitionByRange(common.parts(spark), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    local = common.written(spark, dealt.mapInArrow(run, schema.add("piece", "integer")), name)
    # Only the first conversation of a partition can have rows in earlier ones: one a partition, which bounds both broadcasts.
    heads = local.groupBy("piece").agg(F.min("conv_id").alias("conv_id")).select("conv_id").distinct()
    per = local.join(heads.hint("broadcast"), "conv_id", "left_semi").groupBy("conv_id", "piece").agg(*(total(v).alias(v) for v in values))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("conv_id", "piece", *(F.coalesce(total(v).over(earlier), F.lit(0)).alias(f"{v}_offset") for v in values))
    joined = local.join(offsets.hint("broadcast"), ["conv_id", "piece"], "left")
    both = {v: (F.col(f"{v}_before"), F.coalesce(f"{v}_offset", F.lit(0))) for v in values}
    return joined.select(*columns, *((a + b if kind is ADD else a.bitwiseXOR(b)).alias(f"{v}_before") for v, (a, b) in both.items()))


def rebuilt(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and the turns of the rebuilt conversations: conv_id, pos (from 0), digest (f1, f2), points (code points of the text)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(text)).alias("t"), F.unhex(F.md5(role)).alias("r"), F.length(text).cast("long").alias("points"), F.monotonically_increasing_id().alias("tie"), F.lit(1).cast("long").alias("one"))
    turns = common.written(spark, turns.filter("conv_id IS NOT NULL"), "turns")
    own = running(spark, turns, ["turn", "t", "r", "tie"], ["one"], ADD, "numbered-turns").select("conv_id", F.col("one_before").alias("j"), "t", "r", "points")
    own = common.written(spark, own, "own-turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % LENT).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lender"))
    lenders = sizes.select(F.col("conv_id").alias("lender"), F.col("n").alias("lends"))
    convs = convs.join(lenders.hint("merge"), "lender", "left").select("conv_id", "lender", "h", F.least("h", F.coalesce("lends", F.lit(0))).alias("k"))
    convs = common.written(spark, convs, "conversations")
    later = own.join(convs.select("conv_id", "h", "k").hint("merge"), "conv_id").filter("j >= h").select("conv_id", (F.col("j") - F.col("h") + F.col("k")).alias("pos"), "t", "r", "points")
    lent = own.filter(F.col("j") < LENT - 1).select(F.col("conv_id").alias("lender"), F.col("j").alias("pos"), "t", "r", "points")
    lent = convs.filter("k > 0").select("conv_id", "lender", "k").join(lent.hint("merge"), "lender").filter("pos < k").select("conv_id", "pos", "t", "r", "points")
    rows = later.unionByName(lent).select("conv_id", "pos", F.xxhash64("pos", "t", "r").alias("f1"), F.xxhash64(F.lit("again"), "r", "t", "pos").alias("f2"), "points")
    return convs.select("conv_id"), common.written(spark, rows, "rebuilt-turns")


_CLASS = ["x1", "x2", "len"]


def joined_ids(batches):
    """Rows sorted by class and conv_id become texts of up to CHUNK_IDS ids: class, piece, seq, rep (the first id), m (their number), ids."""
    piece, seq, key, ids, out = TaskContext.get().partitionId(), 0, None, [], []

    def table():
        columns = zip((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in columns], names=[*_CLASS, "piece", "seq", "rep", "m", "ids"])

    for batch in batches:
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*_CLASS, "conv_id"))):
            if ids and (now != key or len(ids) == CHUNK_IDS):
                out.append((*key, piece, seq, ids[0], len(ids), ",".join(map(str, ids))))
                ids, seq = [], seq + 1
                if len(out) == 500:
                    yield table()
                    out = []
            key = now
            ids.append(conv)
    if ids:
        out.append((*key, piece, seq, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield table()


def hashed_ids(batches):
    """The texts of a class follow each other; only a running hash is held."""
    key, state, rep, m, out = None, None, None, 0, []

    def table():
        columns = zip((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in columns], names=[*_CLASS, "rep", "m", "ends"])

    for batch in batches:
        for *now, first, n, ids in zip(*(batch.column(c).to_pylist() for c in (*_CLASS, "rep", "m", "ids"))):
            if now != key:
                if key is not None:
                    out.append((*key, rep, m, state.hexdigest()))
                key, state, rep, m = now, hashlib.sha256(ids.encode()), first, n
            else:
                state.update(b"," + ids.encode())
                m += n
        if out:
            yield table()
            out = []
    if key is not None:
        out.append((*key, rep, m, state.hexdigest()))
        yield table()


def classes(spark: SparkSession, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations that are alike in full: digest and number of their turns, rep (the smallest id), m (how many), ends (SHA-256 of the ids)."""
    sums = turns.groupBy("conv_id").agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"), F.count(F.lit(1)).alias("len"))
    rows = convs.join(sums.hint("merge"), "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _CLASS))
    rows = common.written(spark, rows, "conversation-digests")
    rows = rows.repartitionByRange(common.parts(spark), *_CLASS, "conv_id").sortWithinPartitions(*_CLASS, "conv_id")
    texts = rows.mapInArrow(joined_ids, "x1 long, x2 long, len long, piece int, seq long, rep long, m long, ids string")
    texts = texts.repartition(common.parts(spark), *_CLASS).sortWithinPartitions(*_CLASS, "piece", "seq")
    return common.written(spark, texts.mapInArrow(hashed_ids, "x1 long, x2 long, len long, rep long, m long, ends string"), "classes")


def units(spark: SparkSession, turns: DataFrame, alike: DataFrame, total: int) -> DataFrame:
    """conv_id (of a class), d_end, digest of the prefix of d_end turns (g1, g2), points of the unit's turns, n and low (members and smallest member of its nodes), and m, len, ends of the class."""
    of = alike.filter("len > 0").select(F.col("rep").alias("conv_id"), "m", "len", "ends")
    rows = turns.join(of.hint("merge"), "conv_id").withColumn("blk", F.floor(F.col("pos") / BLOCK))
    # At most BLOCK rows a group.
    blocks = rows.groupBy("conv_id", "blk", "m", "len", "ends").agg(F.array_sort(F.collect_list(F.struct("pos", "f1", "f2", "points"))).alias("turns"), F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))
    blocks = running(spark, blocks, ["blk"], ["x1", "x2"], XOR, "blocks")
    blocks = blocks.select("*", *(F.col(f"{x}_before").bitwiseXOR(F.col(x)).alias(f"q{x[1]}") for x in ("x1", "x2")), (F.size("turns") == BLOCK).alias("full"))
    blocks = common.written(spark, blocks, "block-prefixes")
    groups = common.written(spark, blocks.filter("full").groupBy("blk", "q1", "q2").agg(F.sum("m").alias("n"), F.min("conv_id").alias("low")), "block-groups")
    own = groups.select(F.col("blk").alias("o_blk"), F.col("q1").alias("o1"), F.col("q2").alias("o2"), "n", "low")
    above = groups.select((F.col("blk") + 1).alias("a_blk"), F.col("q1").alias("a1"), F.col("q2").alias("a2"), F.col("n").alias("n_above"))
    rows = blocks.join(own.hint("merge"), F.col("full") & (F.col("blk") == F.col("o_blk")) & (F.col("q1") == F.col("o1")) & (F.col("q2") == F.col("o2")), "left")
    rows = rows.join(above.hint("merge"), (F.col("blk") == F.col("a_blk")) & (F.col("x1_before") == F.col("a1")) & (F.col("x2_before") == F.col("a2")), "left")
    members = F.coalesce("n_above", F.lit(total))
    alone = members == F.col("m")
    rows = rows.withColumn("whole", F.coalesce(alone | (F.col("n") == members), F.lit(False)))
    rows = rows.select("conv_id", "blk", "turns", "q1", "q2", "x1_before", "x2_before", "m", "len", "ends", "whole", F.when(alone, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(alone, F.col("conv_id")).otherwise(F.col("low")).alias("low"))
    rows = common.written(spark, rows, "judged-blocks")
    about = ["conv_id", "m", "len", "ends"]
    whole = rows.filter("whole").select(*about, (F.col("blk") * BLOCK + F.size("turns")).alias("d_end"), F.col("q1").alias("g1"), F.col("q2").alias("g2"), F.col("turns.points").alias("points"), "n", "low")

    def prefix(i, k):
        return F.aggregate(F.slice("turns", F.lit(1), i + 1), F.col(f"x{k}_before"), lambda a, t: a.bitwiseXOR(t[f"f{k}"]))

    steps = F.transform(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.struct(prefix(i, 1).alias("g1"), prefix(i, 2).alias("g2"), F.array(F.get("turns", i)["points"]).alias("points"), F.get("turns", i)["pos"].alias("pos")))
    fine = rows.filter("NOT whole").select(*about, F.explode(steps).alias("s")).select(*about, (F.col("s.pos") + 1).alias("d_end"), "s.g1", "s.g2", "s.points")
    fine = common.written(spark, fine, "refined-turns")
    per = fine.groupBy("d_end", "g1", "g2").agg(F.sum("m").alias("n"), F.min("conv_id").alias("low"))
    fine = fine.join(per.hint("merge"), ["d_end", "g1", "g2"]).select(*whole.columns)
    return common.written(spark, whole.unionByName(fine), "units")


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, turns = rebuilt(spark, conversations)
    alike = classes(spark, convs, turns)
    total, low = alike.agg(F.sum("m"), F.min("rep")).first()  # two numbers
    rows = units(spark, turns, alike, total or 0)
    own = F.col("low") == F.col("conv_id")
    points = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p)
    rows = rows.withColumn("saved", F.when(own, (F.col("n") - 1) * points).otherwise(F.lit(0)).cast("long"))
    rows = common.written(spark, running(spark, rows, ["d_end"], ["saved"], ADD, "unit-sums"), "running-units")

    # What a class brings to the nodes that it is a member of.
    begins = F.col("d_end") - F.size("points") + 1
    per = rows.groupBy("conv_id").agg(
        F.sum("saved").alias("all_saved"), F.min(F.when(own, begins)).alias("since"), F.coalesce(F.max_by(F.when(~own, F.col("low")), F.when(~own, F.col("d_end"))), F.lit(low)).alias("before"),
        F.max(F.when(F.col("d_end") == F.col("len"), (F.col("n") == F.col("m")).cast("long"))).alias("leaf"), F.max("len").alias("len"),
    )
    per = common.written(spark, per, "class-sums")
    rows = rows.join(per.drop("len").hint("merge"), "conv_id")
    rows = rows.select(
        "d_end", "g1", "g2", "conv_id", "points", "n", "low", "m", "since", "before", "leaf", (F.col("all_saved") - F.col("saved_before") - F.col("saved")).alias("below"),
        F.coalesce((F.col("since") <= F.col("d_end") + 1) & (F.col("d_end") < F.col("len")), F.lit(False)).cast("long").alias("child"), F.when(F.col("d_end") == F.col("len"), F.col("ends")).alias("ends"),
    )
    shared = rows.filter("n > m").groupBy("d_end", "g1", "g2").agg(
        F.max("low").alias("low"), F.max("n").alias("n"), F.max(F.when(own, F.struct("points", "since", "before"))).alias("o"), F.sum("leaf").alias("leaves"), F.sum("child").alias("children"), F.sum("below").alias("below"), F.max("ends").alias("ends"),
    )
    shared = shared.select("low", "d_end", "n", "o.points", "o.since", "o.before", "leaves", "children", "below", "ends")
    alone = rows.filter("n = m").select("low", "d_end", "n", "points", "since", "before", F.col("leaf").alias("leaves"), F.col("child").alias("children"), "below", "ends")
    nodes = shared.unionByName(alone).select("*", F.posexplode("points").alias("i", "own_points"))
    depth, last = F.col("d_end") - F.size("points") + 1 + F.col("i"), F.col("i") == F.size("points") - 1
    rest = F.aggregate(F.slice("points", F.col("i") + 1, F.size("points")), F.lit(0).cast("long"), lambda a, p: a + p)
    nodes = nodes.select(
        F.col("low").alias("conv_id"), depth.cast("long").alias("depth"), F.when(depth > F.col("since"), F.col("low")).otherwise(F.col("before")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * rest).alias("saved_tokens"), F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(NO_IDS).alias("ends_sha256"),
    )
    if not total:
        return nodes
    top = per.agg(F.coalesce(F.sum((F.col("since") == 1).cast("long")), F.lit(0)).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("all_saved"), F.lit(0)).alias("saved_tokens"))
    bare = alike.filter("len = 0").agg(F.coalesce(F.max("ends"), F.lit(NO_IDS)).alias("ends_sha256"))  # one row at most
    root = top.join(bare.hint("broadcast")).select(F.lit(low).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return nodes.unionByName(root)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, common.table(spark, sf_dir, "conversations"))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE = f"""
WITH t0 AS (SELECT i AS k, list_reduce(list_prepend(i, range(8)), lambda c, j: {_STEP}) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY k) AS v FROM t0),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(text, '')), md5(coalesce(role, ''))) - 1 AS j FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
hs AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s))), lambda c, b: xor(c >> 8, tab.v[xor(c & 255, b) + 1])), 4294967295) % 6 AS h FROM ids, tab),
con AS (SELECT hs.conv_id, h, hs.conv_id - hs.conv_id % 100 AS lender, (SELECT count(*) FROM own WHERE own.conv_id = hs.conv_id - hs.conv_id % 100) AS n FROM hs),
reb AS (SELECT c.conv_id AS c, j - h + least(h, n) AS pos, role, text FROM own JOIN con c ON c.conv_id = own.conv_id WHERE j >= h
        UNION ALL SELECT c.conv_id, j, role, text FROM con c JOIN own ON own.conv_id = c.lender WHERE j < h),
pre AS (SELECT c, pos + 1 AS d, length(text) AS cp, string_agg(md5(text) || md5(role), ',') OVER (PARTITION BY c ORDER BY pos) AS p FROM reb
        UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
len AS (SELECT c, max(d) AS len FROM pre GROUP BY c),
node AS (SELECT d, p, min(c) AS mn, count(*) AS n, max(cp) AS cp FROM pre GROUP BY d, p),
par AS (SELECT node.*, q.p AS up FROM node LEFT JOIN pre q ON q.c = node.mn AND q.d = node.d - 1),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM par WHERE d > 0 GROUP BY ALL),
leaf AS (SELECT node.mn, node.d FROM node LEFT JOIN kids USING (d, p) WHERE kids.k IS NULL),
lv AS (SELECT pre.d, pre.p, count(*) AS leaves FROM leaf JOIN pre ON pre.c = leaf.mn AND pre.d <= leaf.d GROUP BY ALL),
sv AS (SELECT pre.d, pre.p, sum((node.n - 1) * node.cp)::bigint AS saved FROM node JOIN pre ON pre.c = node.mn AND pre.d <= node.d GROUP BY ALL),
en AS (SELECT pre.d, pre.p, string_agg(pre.c::varchar, ',' ORDER BY pre.c) AS ids FROM pre JOIN len ON len.c = pre.c AND len.len = pre.d GROUP BY ALL)
SELECT par.mn AS conv_id, par.d::bigint AS depth, u.mn AS parent_conv_id, par.n AS n_convs, coalesce(kids.k, 0) AS n_children, lv.leaves AS n_leaves, sv.saved AS saved_tokens, sha256(coalesce(en.ids, '')) AS ends_sha256
FROM par LEFT JOIN node u ON u.d = par.d - 1 AND u.p = par.up LEFT JOIN kids ON kids.d = par.d AND kids.p = par.p
JOIN lv ON lv.d = par.d AND lv.p = par.p JOIN sv ON sv.d = par.d AND sv.p = par.p LEFT JOIN en ON en.d = par.d AND en.p = par.p
"""
