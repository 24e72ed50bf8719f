"""Substring dedup: windows of words that occur elsewhere, revealed and verified by recompression.

1. One pass over the texts recompresses their words (`recompress`) and gives every window its sign, a high-level symbol inside it. Neighbouring windows with
   one sign are a group: a row of the sign's name, a hash of the group's words and the group's place, about one row for ten words.
2. Rows are range partitioned by (sign, words, document, place) and streamed. A group alone with its sign holds no repeated window. Groups with
   equal words are repeated, all their windows at once. What is left are groups that share a sign but not all their words, as at the ends of a
   repeated passage. One group for each equal set, and all that are left, give their single windows, if the sign has both kinds.
3. Those windows (128 bits each) are range partitioned and streamed like the groups; equal neighbours are repeated.
4. The repeated windows of a document return as intervals, and its text loses the words they cover.

Equal windows have equal signs, so nothing is missed; windows and groups are compared by 128 bits of hashes of their whole word sequences. As a
document's place is part of the range keys, a passage that a third of all documents share is spread over many partitions, each streamed in bounded memory.
Rows at the edge of a partition count as left over in step 2, which step 3 decides; in step 3 the edges, two a partition, are added up.

Defined cases: null and empty texts have no words and lose none; a text of fewer words than a window loses none; overlapping occurrences in one text count; a run of one word longer than
a window is repeated by itself; rows that repeat in full are places of their own and so lose every window (two of them a task are enough to tell);
a null doc_id is a document like others; an empty table gives an empty result. doc_id must be a number or the text of one; it is cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, recompress, wordhash

WINDOW = 35
SURE, SURE_AND_ASKED, ASKED = 1, 2, 3
FOUND, WAIT, EDGE = 0, 1, 2
#: Rows of one document that a task takes when rows repeat in full; remembered documents of a task.
TIMES, REMEMBERED = 2, 100_000

_KEY = ["doc_id", "th"]
_GROUPS = "sign long, words long, doc_id long, th long, x int, n int"
_JUDGED = "doc_id long, th long, x int, n int, kind int"
_WINDOWS = "w1 long, w2 long, doc_id long, th long, x int, asked boolean"
_BASES = [(0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Spans:
    """Hashes of spans of a sequence of words, each a difference of running sums; equal sequences have equal hashes in any batch."""

    def __init__(self, words: np.ndarray, which: int):
        base, mixed = _BASES[which]
        power, inverse = (np.full(len(words) + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wordhash.mix64(words ^ np.uint64(mixed)) * np.multiply.accumulate(power)[:-1])])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return wordhash.mix64((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def _few(batches):
    """The batches without rows of a document that the task has met often enough."""
    met: dict[tuple, int] = {}
    for batch in batches:
        take = []
        for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist())):
            met[key] = met.get(key, 0) + 1
            if met[key] <= TIMES:
                take.append(i)
        if len(met) > REMEMBERED:
            met.clear()
        yield batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))


def _slices(batch):
    """(first row, word hashes, row offsets into them) of slices of a batch of texts."""
    data, offsets = wordhash.buffers(batch.column("text"))
    for a, b in wordhash.slices(offsets):
        yield a, *wordhash.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], False)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _narrow(docs: DataFrame) -> DataFrame:
    return common.keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))


def groups(docs: DataFrame, size: int) -> DataFrame:
    """A row for each group of neighbouring windows with one sign: x is the first window, n their number. A run of one word has two equal rows if it has two windows."""

    def run(batches):
        for batch in _few(batches):
            for a, words, rows in _slices(batch):
                x, name, place = recompress.signs(words, rows, size)
                if not len(x):
                    continue
                new = np.ones(len(x), bool)
                new[1:] = (place[1:] != place[:-1]) | (x[1:] != x[:-1] + 1)
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(x)))
                alone = place[head] < 0
                ends = x[head] + size + np.where(alone, 0, n - 1)
                hashes = Spans(words, 0).hashes(x[head], ends)
                times = np.where(alone & (n > 1), 2, 1)
                head, n, hashes = (np.repeat(v, times) for v in (head, n, hashes))
                row = np.searchsorted(rows, x[head], "right") - 1
                at = pa.array(a + row)
                yield pa.RecordBatch.from_arrays([_signed(name[head]), _signed(hashes), *(batch.column(c).take(at) for c in _KEY), pa.array((x[head] - rows[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["sign", "words", *_KEY, "x", "n"])

    return _narrow(docs).select(*_KEY, "text").mapInArrow(run, _GROUPS)


def neighbours(batches, keys):
    """(batch, same): for each of the leading columns, whether a row and the row before agree in it and those before it; `same` has one entry more, for the row after the batch.

    None where the row before or after is not in this partition."""
    held = before = None

    def compared(batch, before, after):
        same, agree = [], None
        for k in keys:
            v = batch.column(k).to_numpy()
            eq = np.empty(len(v) + 1, np.int8)
            eq[1:-1] = v[1:] == v[:-1]
            eq[0] = -1 if before is None else before[k] == v[0]
            eq[-1] = -1 if after is None else after.column(k)[0].as_py() == v[-1]
            agree = eq if agree is None else np.minimum(agree, eq)
            same.append(agree)
        return same

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held, compared(held, before, batch)
            before = {k: held.column(k)[held.num_rows - 1].as_py() for k in keys}
        held = batch
    if held is not None:
        yield held, compared(held, before, None)


def judge(batches):
    """Rows of groups with their kind; rows without company fall out. At an edge of the partition the unknown row counts as one of the same sign with other words."""
    mixed = False  # whether the set of equal groups that is going on has company of other words
    for batch, (sign, words) in neighbours(batches, ["sign", "words"]):
        m = batch.num_rows
        like, equal = sign != 0, words == 1
        opens = np.flatnonzero(~equal[:m])
        start = np.full(m, -1)
        start[opens] = opens
        start = np.maximum.accumulate(start)
        company = np.where(start < 0, mixed, like[np.maximum(start, 0)])
        mixed = bool(company[-1])
        several = equal[:m] | equal[1:]
        closes = ~equal[1:]
        kind = np.where(several, np.where(closes & (company | like[1:]), SURE_AND_ASKED, SURE), np.where(like[:m] | like[1:], ASKED, 0)).astype(np.int32)
        keep = np.flatnonzero(kind)
        if len(keep):
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*_KEY, "x", "n")), pa.array(kind[keep])], names=[*_KEY, "x", "n", "kind"])


def windows(spark: SparkSession, docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """The single windows of groups, hashed from the texts. asked: doc_id, th, and a list of groups."""

    def run(batches):
        for batch in _few(batches):
            lists = batch.column("groups")
            for a, words, rows in _slices(batch):
                mine = lists.slice(a, len(rows) - 1)
                count = np.array([len(g) for g in mine], np.int64)
                flat = mine.flatten()
                x, n, kind = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("x", "n", "kind"))
                row = np.repeat(np.repeat(np.arange(len(count)), count), n)
                first = np.repeat(x, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at, start = pa.array(a + row), rows[row] + first
                h = [Spans(words, k).hashes(start, start + size) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([_signed(h[0]), _signed(h[1]), *(batch.column(c).take(at) for c in _KEY), pa.array(first.astype(np.int32)), pa.array(np.repeat(kind == ASKED, n))], names=["w1", "w2", *_KEY, "x", "asked"])

    lists = asked.groupBy(*_KEY).agg(F.collect_set(F.struct("x", "n", "kind")).alias("groups"))
    lists = lists.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "groups").hint("shuffle_hash")
    rows = _narrow(docs)
    return rows.join(lists, rows.doc_id.eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th"))).select(*_KEY, "text", "groups").mapInArrow(run, _WINDOWS)


def twice(batches):
    """The windows that stand beside an equal one. A window alone at an edge of the partition waits for the sum over edges."""
    ends = None
    for batch, (_, same) in neighbours(batches, ["w1", "w2"]):
        m = batch.num_rows
        asked = batch.column("asked").to_numpy(zero_copy_only=False)
        edge = np.where((same[:m] == -1) & (same[1:] != 1) | (same[1:] == -1) & (same[:m] != 1), WAIT, -1)
        kind = np.where((same[:m] == 1) | (same[1:] == 1), FOUND, edge)
        out = [(i, k) for i, k in enumerate(kind.tolist()) if k >= 0 and asked[i]]
        for i in ([0] if same[0] == -1 else []) + ([m - 1] if same[-1] == -1 else []):
            key = tuple(batch.column(c)[i].as_py() for c in ("w1", "w2"))
            if key != ends:  # once if the partition is a single run
                out.append((i, EDGE))
                ends = key
        if out:
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("w1", "w2", *_KEY, "x")), pa.array([k for _, k in out], pa.int32())], names=["w1", "w2", *_KEY, "x", "kind"])


def repeated(spark: SparkSession, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, th and a list of (x, n): the windows x to x + n - 1 occur elsewhere too. Only documents that have such windows."""
    rows = common.written(spark, groups(docs, size), "window-groups")
    order = ["sign", "words", *_KEY, "x"]
    rows = rows.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)
    judged = common.written(spark, rows.mapInArrow(judge, _JUDGED), "judged-groups")
    single = common.written(spark, windows(spark, docs, judged.filter(F.col("kind") >= SURE_AND_ASKED), size), "windows")
    order = ["w1", "w2", *_KEY, "x"]
    single = single.repartitionByRange(common.parts(spark), *order).sortWithinPartitions(*order)
    single = common.written(spark, single.mapInArrow(twice, "w1 long, w2 long, doc_id long, th long, x int, kind int"), "repeated-windows")
    # Edges are two rows a partition at most, which bounds the broadcast.
    edges = single.filter(F.col("kind") == EDGE).groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    late = single.filter(F.col("kind") == WAIT).join(edges.hint("broadcast"), ["w1", "w2"], "left_semi")
    found = single.filter(F.col("kind") == FOUND).unionByName(late).select(*_KEY, "x", F.lit(1).alias("n"))
    sure = judged.filter(F.col("kind") < ASKED).select(*_KEY, "x", "n")
    return sure.unionByName(found).groupBy(*_KEY).agg(F.collect_set(F.struct("x", "n")).alias("windows"))


def deduped(spark: SparkSession, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """keyed(docs) with n_words, n_removed and kept (the remaining words, joined by one space)."""
    lists = repeated(spark, docs, size).select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "windows").hint("shuffle_hash")
    rows = _narrow(docs)
    rows = rows.join(lists, rows.doc_id.eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")

    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("windows")):
                words = text.encode().split()  # bytes: at [\x20\x09-\x0D] only
                counts.append(len(words))
                if spans.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    x, n = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("x", "n"))
                    np.add.at(edges, x, 1)
                    np.add.at(edges, x + n - 1 + size, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*_KEY, "n_words", "n_removed", "kept"])

    return rows.select(*_KEY, "text", "windows").mapInArrow(run, "doc_id long, th long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i FROM x JOIN g USING (s)), range(35) t(j)),
k AS (SELECT d.r, d.w[i + 1] AS word, i, c.i IS NOT NULL AS gone FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d) d LEFT JOIN c USING (r, i)),
s AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY r)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
