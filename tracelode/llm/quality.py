"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text are hashed one- and two-word grams, of the words as written and of their shapes (a shape keeps the
case pattern, digits and punctuation of a word, its length class, and whether it repeats the word before). A text is the sparse vector of the share
that each feature has among its grams; its score is the logistic function of one sparse dot product.

Training uses a bounded sample of documents that have a label: at most `MAX_ROWS` of each label, those with the smallest hash of doc_id and text, and
of these as many as have `MAX_BYTES` together, which is the only thing in this operator that does not cover all rows. It runs in one task, and only the weights come to the driver.
Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2.

Defined cases: null and empty texts have only the intercept; null labels and labels without a document are not used; a pair of label and document
counts once however often it repeats; without labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordhash

#: Labelled rows of each label that the fit may use (whole texts of them), bytes of all their texts (of one a 64th), and passes over them.
MAX_ROWS, MAX_BYTES, PASSES = 1500, 1 << 28, 4
BITS = 18
#: Per-coordinate learning rate and regularisation.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
_SHAPE = np.full(256, ord("."), np.uint8)
_SHAPE[np.r_[97:123, 128:256]] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature index of every gram, the row of each, and the number of words of each row."""
    s, e, rows = wordhash.word_bounds(data, offsets)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(rows)
    words = wordhash.hash_spans(data, s, e, False)
    classes = _SHAPE[data]
    # Shape: class of the first, second and last byte, bytes of punctuation, and the length in powers of two.
    dots = np.concatenate([[0], np.cumsum(classes == ord("."))])
    second = classes[np.minimum(s + 1, e - 1)].astype(np.uint64)
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    same[rows[:-1][rows[:-1] < len(words)]] = 0
    shape = classes[s].astype(np.uint64) | second << np.uint64(8) | classes[e - 1].astype(np.uint64) << np.uint64(16)
    shape |= np.minimum(dots[e] - dots[s], 3).astype(np.uint64) << np.uint64(24) | same << np.uint64(28)
    shape |= np.log2(e - s).astype(np.uint64) << np.uint64(32)
    shape = wordhash.mix64(shape + np.uint64(77))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    out, where = [words, shape], [row, row]
    inside = row[1:] == row[:-1]
    for grams in (words, shape):
        out.append(wordhash.ngrams(grams, 2)[inside])
        where.append(row[1:][inside])
    index = [(wordhash.mix64(x + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64) for k, x in enumerate(out)]
    return np.concatenate(index), np.concatenate(where), np.diff(rows)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal over (feature indices, values, label); the last weight is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for k in range(passes):
        for j in np.random.default_rng(k).permutation(len(samples)):
            i, x, y = samples[j]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    return weights(np.arange(size))


def sample(texts: list[str], labels: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for t, y in zip(texts, labels):
        data, offsets = wordhash.buffers(pa.array([t]))
        index, _, count = features(data, offsets)
        i, c = np.unique(index, return_counts=True)
        out.append((np.append(i, 1 << BITS), np.append(SCALE * c / max(1, count[0]), 1.0), y))
    return out


#: Shares of features are scaled so that their updates are of the order of the intercept's.
SCALE = 10.0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    texts = common.keyed(docs)
    found = texts.groupBy("doc_id", "th").agg(F.first(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") <= MAX_BYTES // 64)
    found = found.join(usable.hint("merge"), "doc_id")
    order = [F.xxhash64("doc_id", "th"), "doc_id", "th"]
    picked = [found.filter(F.col("quality") == y).orderBy(*order).limit(max_rows) for y in (0, 1)]
    picked = common.written(docs.sparkSession, picked[0].unionByName(picked[1]), "quality-sample")  # 2 * max_rows rows at most
    upto = F.sum("bytes").over(Window.orderBy(*order, "quality").rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("upto", upto).filter(F.col("upto") <= MAX_BYTES).select("doc_id", "th", "quality")
    # The sample's bounds are those of the broadcast and of the task of the fit; rows that repeat in full fall out before they are shuffled.
    rows = texts.join(picked.hint("broadcast"), ["doc_id", "th"]).groupBy("doc_id", "th", "quality").agg(F.first("text").alias("text")).select("doc_id", "text", "quality")

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("quality", "ascending")])
        items = sample(group.column("text").to_pylist(), group.column("quality").to_pylist())
        count = [sum(x[2] == y for x in items) for y in (0, 1)]
        weights = np.zeros((1 << BITS) + 1)
        if all(count):
            # Both labels weigh the same in the fit: rows of the rarer one are repeated.
            rare = int(count[1] < count[0])
            weights = fit(items + [x for x in items if x[2] == rare] * min(4, max(count) // min(count) - 1))
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()])})

    # One task fits the bounded sample; only the weights come to the driver.
    fitted_rows = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(fitted, "weights binary").collect()
    return np.frombuffer(fitted_rows[0].weights, np.float32) if fitted_rows else np.zeros((1 << BITS) + 1, np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scorer(spark: SparkSession, weights: np.ndarray):
    """A Column function: text to score. The weights, 2^BITS floats, travel as a broadcast variable."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = shared.value.astype(np.float64)
        data, offsets = wordhash.buffers(texts)
        out = np.full(len(texts), w[-1])
        for a, b in wordhash.slices(offsets):
            index, row, count = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] += SCALE * np.bincount(row, w[index], b - a) / np.maximum(1, count)
        return pa.array(1 / (1 + np.exp(-out)))

    return score


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Column:
    return scorer(spark, train(docs, labels))(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    score = scored(spark, docs, common.table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, in the columns they came with."""
    score = scored(spark, docs, common.table(spark, sf_dir, "labels"))
    return docs.select(F.struct(*docs.columns).alias("__doc"), score.alias("__score")).filter(F.col("__score") >= THRESHOLD).select("__doc.*")
