"""Spelling variants: words one edit apart, found by box-pruned range searches in k-d trees over letter-count vectors.

1. One pass over the texts counts the runs of letters; every `every`-th run (by a checksum of document and run) loses a code point first.
   Counts are summed per slice of texts, then by Spark.
2. A word's vector has the letter counts of its first half and of its second half, 32 numbers each. One edit changes a single half and
   leaves the vector within L1 distance two: one letter more, one letter less, or one of each.
3. Words of one length are one k-d tree. Its upper part is fitted on a bounded sample of all words (`SAMPLE`), which decides where it is cut, not what is found:
   every word is filed in its leaf and asks the leaves of its own length, and of the next length, whose boxes an edit can reach.
4. A leaf's words and the words that ask it meet in blocks of bounded size; a block has a finer tree of its own. What the boxes leave is compared in
   letter order, a pair of equal lengths from both sides, a pair of unequal lengths from the shorter side. Blocks return a count and the best form of each word, no pairs.
5. Forms are followed by pointer doubling; a form has at least `ratio` times the word's count, so chains are short.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; rows that repeat count each; letters are `[A-Za-z\\u00C0-\\u00FF]`, of
which only A-Z are lower-cased; a tie between forms goes to the smallest word in code-point order; an empty table gives an empty result. Words may be of any length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

EVERY, MIN_POINTS, MIN_COUNT, RATIO = 31, 7, 2, 10
#: Words that fit the upper trees; words of a leaf that is not cut further; words and askers of a block; words of a leaf in a block's own tree.
SAMPLE, LEAF, BLOCK_WORDS, BLOCK_ASKERS, FINE_LEAF = 1 << 18, 1 << 15, 1 << 15, 1 << 17, 32
#: Bounded number of leaves of all upper trees.
MAX_LEAVES = 1 << 14
HALF = 32
#: Searches: the half that holds the edit, and whether the asked words are one letter longer.
SEARCHES = [(0, False), (1, False), (0, True), (1, True)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_TABLE = np.arange(256, dtype=np.uint32)  # of the checksum, a byte at a time
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> np.uint32(1)) ^ np.uint32(0xEDB88320), _TABLE >> np.uint32(1))
#: Longer runs are few; their checksums are taken one by one.
_SHORT = 64


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of letters in lower-cased bytes, and their numbers of code points."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none
    lead = data == 0xC3  # U+00C0 to U+00FF, and nothing else, start with this byte
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    start, end = letter.copy(), letter.copy()
    joined = letter[1:] & letter[:-1]
    cuts = offsets[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(data))] - 1] = False
    start[1:] &= ~joined
    end[:-1] &= ~joined
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return s, e, np.searchsorted(offsets, s, "right") - 1, e - s - (leads[e] - leads[s])


def checksums(data: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the checksum of what stands before it."""
    out = np.zeros(len(s), np.uint32)
    short = np.flatnonzero(e - s <= _SHORT)
    order = short[np.argsort(s[short] - e[short], kind="stable")]  # longest first
    at, size, state = s[order], (e - s)[order], ~before[order]
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, "left"))  # so many are longer than j
        state[:k] = _TABLE[(state[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(e - s > _SHORT):
        out[i] = zlib.crc32(data[s[i] : e[i]].tobytes(), int(before[i]))
    return out


def slice_counts(data: np.ndarray, offsets: np.ndarray, before: np.ndarray, min_points: int, every: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a slice of texts with their counts; a word may come more than once."""
    data = _LOWER[data]
    s, e, row, points = letter_runs(data, offsets)
    long = points >= min_points
    s, e, row, points = s[long], e[long], row[long], points[long]
    sums = checksums(data, s, e, before[row])
    hit = sums % np.uint32(every) == 0
    words, counts = [], []
    for a, b, h, n in zip(s[hit].tolist(), e[hit].tolist(), sums[hit].tolist(), points[hit].tolist()):
        if n > min_points:
            run = data[a:b].tobytes().decode()
            words.append((run[: h % n] + run[h % n + 1 :]).encode())
            counts.append(1)
    s, e = s[~hit], e[~hit]
    _, first, times = np.unique(wordhash.hash_spans(data, s, e, False), return_index=True, return_counts=True)
    words += [data[a:b].tobytes() for a, b in zip(s[first].tolist(), e[first].tolist())]
    return words, np.concatenate([np.array(counts, np.int64), times])


def word_counts(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """word, n."""

    def run(batches):
        for batch in batches:
            data, offsets = wordhash.buffers(batch.column("text"))
            before = np.array([zlib.crc32(p.encode()) for p in batch.column("before").to_pylist()], np.uint32)
            for a, b in wordhash.slices(offsets):
                words, counts = slice_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], before[a:b], min_points, every)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], names=["word", "n"])

    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("before"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point, and n + 1 offsets."""
    data, offsets = wordhash.buffers(words)
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    leads = np.concatenate([[0], np.cumsum(lead)])
    return np.where(after, data + np.uint8(64), data)[~lead], offsets - leads[offsets]


def vectors(flat: np.ndarray, offsets: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Letter counts before and after position `split` of each word. Accented letters share the numbers left over; counts end at 255. Neither makes a distance larger."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
    letter = np.where(flat < 128, flat - 97, 26 + flat % 6).astype(np.int64)
    key = row * (2 * HALF) + np.where(place < split[row], 0, HALF) + letter
    return np.minimum(np.bincount(key, minlength=n * 2 * HALF), 255).astype(np.uint8).reshape(n, 2 * HALF)


class Tree:
    """A k-d tree over count vectors. Each inner node is cut where one number parts its rows most evenly."""

    def __init__(self, rows: np.ndarray, leaf: int):
        dim, cut, lo, hi, left, span = [], [], [], [], [], []
        self.order = np.arange(len(rows))
        todo = [(0, len(rows), 0)]
        box = {0: (np.zeros(rows.shape[1], np.int16), np.full(rows.shape[1], 255, np.int16))}

        def node(a, b):
            for x, v in ((dim, -1), (cut, 0), (lo, 0), (hi, 0), (left, 0), (span, (a, b))):
                x.append(v)
            return len(dim) - 1

        node(0, len(rows))
        while todo:
            a, b, k = todo.pop()
            lows, highs = box.pop(k)
            if b - a <= leaf:
                continue
            mine = rows[self.order[a:b]]
            above = np.stack([(mine > c).sum(0) for c in range(3)])
            uneven = np.where((above > 0) & (above < b - a), np.abs(2 * above - (b - a)), 4 * (b - a))
            c, d = np.unravel_index(int(np.argmin(uneven)), uneven.shape)
            if uneven[c, d] > 2 * (b - a):
                continue  # all rows are equal in what can be cut
            right = mine[:, d] > c
            own = self.order[a:b]
            m = a + int((~right).sum())
            self.order[a:b] = np.concatenate([own[~right], own[right]])
            dim[k], cut[k], lo[k], hi[k] = int(d), int(c), int(lows[d]), int(highs[d])
            left[k] = node(a, m)
            node(m, b)
            for child, x, y in ((left[k], a, m), (left[k] + 1, m, b)):
                l2, h2 = lows.copy(), highs.copy()
                (h2 if child == left[k] else l2)[d] = c if child == left[k] else c + 1
                box[child] = (l2, h2)
                todo.append((x, y, child))
        self.dim, self.cut, self.lo, self.hi, self.left = (np.array(x, np.int32) for x in (dim, cut, lo, hi, left))
        self.span = np.array(span, np.int64).reshape(-1, 2)

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(rows), np.int64)
        while (inner := np.flatnonzero(self.dim[at] >= 0)).size:
            k = at[inner]
            at[inner] = self.left[k] + (rows[inner, self.dim[k]] > self.cut[k])
        return at

    def reach(self, rows: np.ndarray, half: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs whose box is within one edit in the given half, the other half unchanged. more, less: letters that a box has too few or too many of."""
        row, at = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        more, less = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        found_row, found_leaf = [], []
        while len(row):
            leaf = self.dim[at] < 0
            found_row.append(row[leaf])
            found_leaf.append(at[leaf])
            row, at, more, less = (x[~leaf] for x in (row, at, more, less))
            d, c = self.dim[at], self.cut[at]
            v = rows[row, d].astype(np.int32)
            free = d // HALF == half
            over = more + np.where(v > c, v - c - np.maximum(v - self.hi[at], 0), 0)
            under = less + np.where(v <= c, c + 1 - v - np.maximum(self.lo[at] - v, 0), 0)
            to_left = np.where(free, over <= (0 if longer else 1), v <= c)
            to_right = np.where(free, under <= 1, v > c)
            row, more, less = (np.concatenate([x[to_left], y[to_right]]) for x, y in ((row, row), (over, more), (less, under)))
            at = np.concatenate([self.left[at[to_left]], self.left[at[to_right]] + 1])
        return np.concatenate(found_row), np.concatenate(found_leaf)


def asking(flat: np.ndarray, offsets: np.ndarray, half: int, longer: bool) -> np.ndarray:
    """Vectors that the words have as askers: cut where words of the asked length are cut, one letter earlier if the asked word has one more before."""
    size = np.diff(offsets)
    return vectors(flat, offsets, (size + 1) // 2 - (half == 0) if longer else size // 2)


def fitted(words: DataFrame, total: int) -> dict[int, Tree]:
    """The upper tree of each length. The sample is chosen by hash, so it is the same in every run; its size is bounded by SAMPLE."""
    of = 1 << 30
    share = min(1.0, SAMPLE / max(total, 1))
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(of)) < int(share * of)).select("word").toArrow().column("word").combine_chunks()
    flat, offsets = latin(sample)
    size = np.diff(offsets)
    leaf = max(1, int(max(LEAF, total / MAX_LEAVES) * share))
    trees = {}
    for length in np.unique(size).tolist():
        mine = np.flatnonzero(size == length)
        if len(mine) > leaf:
            rows = flat[offsets[mine][:, None] + np.arange(length)]
            trees[length] = Tree(vectors(rows.ravel(), np.arange(len(mine) + 1) * length, np.full(len(mine), length // 2)), leaf)
    return trees


def by_length(size: np.ndarray):
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(part):
            yield int(size[part[0]]), part


def picked(flat: np.ndarray, offsets: np.ndarray, part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The words `part`, all of one length."""
    return flat[offsets[part][:, None] + np.arange(length)].ravel(), np.arange(len(part) + 1) * length


def placed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every word in its leaf (ask 0) and at every leaf that it asks (ask: bits of the searches)."""

    def run(batches):
        for batch in batches:
            flat, offsets = latin(batch.column("word"))
            for length, part in by_length(np.diff(offsets)):
                own = picked(flat, offsets, part, length)
                parts, leaves, asks, lengths = [], [], [], []

                def put(rows, leaf, ask, of, part=part, parts=parts, leaves=leaves, asks=asks, lengths=lengths):
                    parts.append(part[rows])
                    leaves.append(leaf)
                    asks.append(np.full(len(rows), ask, np.int32) if np.isscalar(ask) else ask)
                    lengths.append(np.full(len(rows), of, np.int32))

                tree = trees.get(length)
                put(np.arange(len(part)), tree.file(vectors(*own, np.full(len(part), length // 2))) if tree else np.zeros(len(part), np.int64), 0, length)
                for longer in (False, True):
                    tree, keys, bits = trees.get(length + longer), [], []
                    for k, (half, more) in enumerate(SEARCHES):
                        if more != longer:
                            continue
                        rows, leaf = tree.reach(asking(*own, half, longer), half, longer) if tree else (np.arange(len(part)), np.zeros(len(part), np.int64))
                        keys.append(rows * (1 << 32) + leaf)
                        bits.append(np.full(len(rows), 1 << k, np.int64))
                    key, at = np.unique(np.concatenate(keys), return_inverse=True)
                    put(key >> 32, key & 0xFFFFFFFF, np.bincount(at, np.concatenate(bits), len(key)).astype(np.int32), length + longer)
                at = pa.array(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(leaves).astype(np.int32)), pa.array(np.concatenate(asks))], names=["word", "n", "length", "leaf", "ask"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, leaf int, ask int")


def compared(x: np.ndarray, y: np.ndarray, half: int, longer: bool) -> np.ndarray:
    """Which rows of letters x turn into those of y by one edit in the given half. An edit that can stand at several places counts at the last."""
    split = y.shape[1] // 2
    if not longer:
        differ = x != y
        return (differ.sum(1) == 1) & ((differ.argmax(1) < split) == (half == 0))
    differ = x != y[:, :-1]
    place = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    shifted = (x == y[:, 1:]) | (np.arange(x.shape[1]) < place[:, None])
    return shifted.all(1) & ((place < split) == (half == 0))


def block_near(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The near words between the words of a block and its askers: for each word how many there are here, and the one of largest count."""
    length, table = int(key[0].as_py()), table.combine_chunks()
    words, n, ask = table.column("word").combine_chunks(), table.column("n").to_numpy(), table.column("ask").to_numpy()
    flat, offsets = latin(words)
    filed = np.flatnonzero(ask == 0)
    who, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(filed) and len(filed) < len(ask):
        letters, ends = picked(flat, offsets, filed, length)
        tree = Tree(vectors(letters, ends, np.full(len(filed), length // 2)), FINE_LEAF)
        letters = letters.reshape(-1, length)
        for k, (half, longer) in enumerate(SEARCHES):
            askers = np.flatnonzero(ask & (1 << k))
            if not len(askers):
                continue
            own = picked(flat, offsets, askers, length - longer)
            rows, leaves = tree.reach(asking(*own, half, longer), half, longer)
            own = own[0].reshape(-1, length - longer)
            spans = tree.span[leaves]
            ends = np.cumsum(spans[:, 1] - spans[:, 0])
            step, a = max(1, (1 << 22) // length), 0
            while a < len(rows):  # so many pairs at once as bounded memory takes
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
                size = spans[a:b, 1] - spans[a:b, 0]
                q = np.repeat(rows[a:b], size)
                w = tree.order[np.repeat(spans[a:b, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
                good = compared(own[q], letters[w], half, longer)
                q, w = askers[q[good]], filed[w[good]]
                who += [q, w] if longer else [q]
                other += [w, q] if longer else [w]
                a = b
    who, other = np.concatenate(who), np.concatenate(other)
    names = np.array([x.encode("latin-1") for x in words.to_pylist()])
    rank = np.zeros(len(names), np.int64)
    rank[np.argsort(names)] = np.arange(len(names))
    order = np.lexsort((rank[other], -n[other], who))
    who, other = who[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    near = np.diff(np.concatenate([first, [len(who)]]))
    return pa.table({"word": words.take(pa.array(who[first])), "n_near": pa.array(near), "best_n": pa.array(n[other[first]]), "best": words.take(pa.array(other[first]))})


def nearest(spark: SparkSession, words: DataFrame, total: int) -> DataFrame:
    """word, n, n_near and best (count and word) of a written table of words."""
    rows = common.written(spark, placed(words, fitted(words, total)), "asked-leaves")
    # Long words weigh more, so that a block's letters stay bounded too.
    weight = F.greatest(F.lit(1.0), F.col("length") / 64)
    sizes = rows.groupBy("length", "leaf").agg(F.ceil(F.sum(F.when(F.col("ask") == 0, weight)) / BLOCK_WORDS).alias("w"), F.ceil(F.sum(F.when(F.col("ask") > 0, weight)) / BLOCK_ASKERS).alias("q"))
    # A leaf without words or without askers has nothing to compare. Leaves are bounded in number for each length.
    sizes = common.written(spark, sizes.filter("w IS NOT NULL AND q IS NOT NULL"), "leaf-sizes")
    rows = rows.join(sizes.hint("merge"), ["length", "leaf"])
    hashed = F.xxhash64("word")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    filed = rows.filter("ask = 0").withColumn("wb", F.pmod(hashed, F.col("w")).cast("int")).withColumn("qb", every("q"))
    askers = rows.filter("ask > 0").withColumn("qb", F.pmod(hashed, F.col("q")).cast("int")).withColumn("wb", every("w"))
    met = filed.select("length", "leaf", "wb", "qb", "word", "n", "ask").unionByName(askers.select("length", "leaf", "wb", "qb", "word", "n", "ask"))
    near = met.groupBy("length", "leaf", "wb", "qb").applyInArrow(block_near, "word string, n_near long, best_n long, best string")
    near = near.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("word")).alias("best"))
    both = near.unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(near.schema["best"].dataType).alias("best")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def rooted(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """`rows` (word, form, ...) with root, the end of the chain of forms. Each round doubles the steps that a word has gone."""
    steps = common.written(spark, rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        of = steps.select(F.col("word").alias("of_word"), F.col("root").alias("of_root"))
        new = steps.join(of.hint("merge"), F.col("root") == F.col("of_word"), "left")
        new = common.written(spark, new.select("word", F.coalesce("of_root", "root").alias("root"), F.col("of_root").isNotNull().alias("moved")), "forms")
        steps = new.select("word", "root")
        if new.filter("moved").isEmpty():
            break
    of = steps.select(F.col("word").alias("of_word"), F.col("root").alias("of_root"))
    return rows.join(of.hint("merge"), F.col("word") == F.col("of_word"), "left").withColumn("root", F.coalesce("of_root", "word")).drop("of_word", "of_root")


def variants(spark: SparkSession, docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, every: int = EVERY, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = common.written(spark, word_counts(docs, min_points, min_count, every), "words")
    near = nearest(spark, words, words.count())
    taken = -F.col("best.order") >= ratio * F.col("n")
    rows = near.select("word", F.when(taken, F.col("best.word")).alias("form"), "n", "n_near", F.when(taken, -F.col("best.order")).alias("form_n"))
    return rooted(spark, common.written(spark, rows, "near-words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, common.table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: Forms are followed by joins, as many as a chain can have: a form's count is ten times the word's at least.
ORACLE = f"""
WITH RECURSIVE t(k, v) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: {_STEP}) FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY k) AS v FROM t),
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM u WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, unhex_list FROM (SELECT *, list_transform(range(0, octet_length(encode(coalesce(doc_id::varchar, '') || ':' || run))), lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), 2 * i + 1, 2))::bigint) AS unhex_list FROM r)),
h AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, unhex_list), lambda c, x: xor(c >> 8, tab.v[xor(c & 255, x) + 1])), 4294967295) AS h FROM b, tab),
d AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::bigint AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
x AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM g),
p AS (SELECT a.word AS word, c.word AS near, c.n AS m FROM x a JOIN x c ON a.cut = c.cut AND a.i = c.i AND a.word <> c.word
      UNION SELECT w.word, x.word, x.n FROM w JOIN x ON x.cut = w.word
      UNION SELECT x.word, w.word, w.n FROM w JOIN x ON x.cut = w.word),
q AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT q.word, min(p.near) AS form FROM q JOIN p ON p.word = q.word AND p.m = q.m GROUP BY q.word),
s AS (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.m >= 10 * w.n THEN f.form END AS form, CASE WHEN q.m >= 10 * w.n THEN q.m END AS form_n
      FROM w LEFT JOIN q ON q.word = w.word LEFT JOIN f ON f.word = w.word),
c AS (SELECT word, word AS at FROM s UNION ALL SELECT c.word, s.form FROM c JOIN s ON s.word = c.at WHERE s.form IS NOT NULL)
SELECT s.word, s.form, c.at AS root, s.n, s.n_near, s.form_n FROM s JOIN c ON c.word = s.word JOIN s e ON e.word = c.at AND e.form IS NULL
"""
