"""SentencePiece encoding with sampled segmentations, and decoding.

Each document gets `k` distinct segmentations drawn by Gumbel top-k without replacement, a perturbed A-star search over its lattice of pieces (see
`lattice`), with inclusion scores (as logarithms); the draw is seeded by the row key (doc_id and text), so it does not depend on partitioning and repeats after a lost executor.
The model's vocabulary file is a parameter; it is a merge model, whose scores are ranks, so a piece weighs 1 / (rank + 2) ** theta.

As in the model, a text gets one leading space, spaces are U+2581, and a character that is no piece becomes its bytes; decoding turns ids back into the text, in which a U+2581 has become a space.

Defined cases: null text is empty; an empty text has one segmentation without ids, of probability and score 1 (logarithm 0); a text with fewer than k segmentations gets them all;
rows that repeat doc_id and text get the same samples each; a null doc_id is a key like others; an empty table gives an empty result. doc_id must be a number or the text of one; it is cast to long.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, lattice

SAMPLES, THETA = 2, 1.0
#: Texts of a batch that are sampled together have about so many bytes, which bounds the memory of a worker.
TOGETHER = 600_000
_vocabularies: dict[tuple[str, float], lattice.Vocabulary] = {}
_DRAWN = "doc_id long, sample int, n_tokens long, ids array<int>, log_prob double, log_inclusion double"
_DIGEST = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, log_inclusion double, round_trip boolean"


def model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str, theta: float = THETA) -> lattice.Vocabulary:
    if (path, theta) not in _vocabularies:
        _vocabularies[path, theta] = lattice.Vocabulary(path, theta)
    return _vocabularies[path, theta]


def _groups(sizes: list[int]):
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def encoded(docs: DataFrame, path: str, k: int = SAMPLES, theta: float = THETA, seed: int = 0, digest: bool = False) -> DataFrame:
    """A row for each document and sample: the ids, or with digest their crc32 and whether they decode to the text."""

    def run(batches):
        v = vocabulary(path, theta)
        for batch in batches:
            column, keys, ids_in = batch.column("text"), batch.column("key").to_numpy().view(np.uint64), batch.column("doc_id")
            for a, b in _groups(pc.binary_length(column).to_pylist()):
                texts = column.slice(a, b - a).to_pylist()
                drawn = lattice.sample(v, texts, keys[a:b], k)
                rows = [d for d, x in enumerate(drawn) for _ in x]
                flat = [y for x in drawn for y in x]
                number = [s for x in drawn for s in range(1, len(x) + 1)]
                out = {"doc_id": ids_in.take(pa.array([a + d for d in rows], pa.int64())), "sample": pa.array(number, pa.int32()), "n_tokens": pa.array([len(x[0]) for x in flat], pa.int64())}
                if digest:
                    out["ids_crc32"] = pa.array([zlib.crc32(x[0].astype("<u4").tobytes()) for x in flat], pa.int64())
                else:
                    cuts = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)
                    values = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in flat]]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))
                out["log_prob"], out["log_inclusion"] = pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())
                if digest:
                    plain = [t.replace(lattice.SPACE, " ") for t in texts]
                    out["round_trip"] = pa.array([v.decode(x[0].tolist()) == plain[d] for d, x in zip(rows, flat)], pa.bool_())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    keyed = common.keyed(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.lit(seed), "doc_id", "th").alias("key"))
    return keyed.mapInArrow(run, _DIGEST if digest else _DRAWN)


def best_encoded(docs: DataFrame, path: str, theta: float = THETA) -> DataFrame:
    """A row for each document: the ids of its likeliest segmentation and their log probability. Cases are defined as for samples."""

    def run(batches):
        v = vocabulary(path, theta)
        for batch in batches:
            column = batch.column("text")
            for a, b in _groups(pc.binary_length(column).to_pylist()):
                found = lattice.best(v, column.slice(a, b - a).to_pylist())
                ids = pa.array([x[0] for x in found], pa.list_(pa.int32()))
                out = [batch.column("doc_id").slice(a, b - a), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "log_prob"])

    keyed = common.keyed(docs).select(F.col("doc_id").cast("long"), "text")
    return keyed.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, log_prob double")


def decoder(path: str, theta: float = THETA):
    """A Column function: array of ids to text."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        v = vocabulary(path, theta)
        return pa.array([None if x is None else v.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), model(), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The samples of every row that reached the end of the pipeline."""
    return encoded(docs, model())
