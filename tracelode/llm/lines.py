"""Line dedup: range-partitioned line hashes, decisions returned as compressed keep bitmaps.

Every line becomes a row (128-bit hash of its key, document, position) without its text. The rows are range
partitioned by (hash, document) and sorted by (hash, document, position); one pass over a partition counts the documents
of each run of equal hashes and emits the positions of frequent keys. As the document is part of the range, a line that
a third of all documents hold is spread over many partitions; only the first and last run of a partition can go on in another one.
Their counts (two rows a partition at most) are summed afterwards, and only rows of such runs that stayed under the
threshold wait for that sum. Positions of a document become one compressed bitmap, and the document is rebuilt from it.

Defined cases: null text is one empty line; keys shorter than `min_points` are never counted or dropped;
a null doc_id is a document like others; rows repeating doc_id and text count as one document and get the same result (a task takes the lines of such a document once, and equal neighbours fall out of the stream, so they are never held);
an empty table gives an empty result. doc_id must be a number or the text of one; it is cast to long.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_POINTS, MIN_DOCS = 1, 10
DROP, WAIT, EDGE = 0, 1, 2
_DECIDED = "kind int, h1 long, h2 long, doc_id long, th long, n_lines int, pos int, n long"


_LINES = "h1 long, h2 long, doc_id long, th long, n_lines int, pos int"
_STRIPPED = common.BLANKS.encode()
#: Documents that a task remembers, to take the lines of rows that repeat once.
REMEMBERED = 100_000


def line_rows(docs: DataFrame, min_points: int) -> DataFrame:
    """A row for each line whose key is long enough: 128-bit hash of the key, document, number of lines, position."""

    def hashed(batches):
        met = set()
        for batch in batches:
            keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()))
            new = [i for i, key in enumerate(keys) if key not in met and not met.add(key)]
            if len(met) > REMEMBERED:
                met.clear()
            batch = batch if len(new) == len(keys) else batch.take(pa.array(new, pa.int64()))
            digests, counts, rows, positions = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                lines = text.as_py().encode().lower().split(b"\n")  # bytes: only A-Z
                for pos, line in enumerate(lines):
                    key = line.strip(_STRIPPED)
                    if len(key) >= min_points and (min_points <= 1 or len(key.decode()) >= min_points):
                        digests.append(xxhash.xxh3_128_digest(key))
                        positions.append(pos)
                        rows.append(k)
                counts.append(len(lines))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = np.array(rows, np.int64)
            taken = [batch.column(n).take(pa.array(at)) for n in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *taken, pa.array(np.array(counts, np.int32)[at] if len(at) else np.zeros(0, np.int32)), pa.array(np.array(positions, np.int32))], names=["h1", "h2", "doc_id", "th", "n_lines", "pos"])

    return common.keyed(docs).select(F.col("doc_id").cast("long"), "text", "th").mapInArrow(hashed, _LINES)


def decide(min_docs: int):
    """Streams a sorted partition. Rows of a run are held back only until the run has `min_docs` documents."""

    def run(batches):
        names = ["h1", "h2", "doc_id", "th", "n_lines", "pos"]
        key, docs, last, row, first, held = None, 0, None, None, True, []

        def rows(kind, cols, n=0):
            size = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *[pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], pa.array(np.full(size, n, np.int64))], names=["kind", *names, "n"])

        def ended(edge):
            """The run is over: what is held back falls short of the threshold here; at an edge others may add to it."""
            if not edge or key is None:
                return
            one = [pa.array([v], t) for v, t in zip((*key, None, None, None, None), (pa.int64(),) * 4 + (pa.int32(),) * 2)]
            yield rows(EDGE, one, docs)
            if docs < min_docs:
                for b in held:
                    yield rows(WAIT, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            equal = np.ones(batch.num_rows, bool)  # to the row before
            for n in names:
                c = batch.column(n)
                v, null = c.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(c.is_null())
                equal &= np.concatenate([[row is not None and row[n] == (None if null[0] else v[0])], (v[1:] == v[:-1]) & (null[1:] == null[:-1])])
            row = {n: batch.column(n)[batch.num_rows - 1].as_py() for n in names}
            if equal.any():
                batch = batch.filter(pa.array(~equal))
                if not batch.num_rows:
                    continue
            cols = [batch.column(n) for n in names]
            h1, h2 = (c.to_numpy(zero_copy_only=False) for c in cols[:2])
            null = np.asarray(cols[2].is_null())
            ids = cols[2].fill_null(0).to_numpy(zero_copy_only=False)
            th = cols[3].to_numpy(zero_copy_only=False)
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key != (h1[0], h2[0])
            fresh = new.copy()
            fresh[1:] |= (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (null[1:] != null[:-1])
            fresh[0] |= last != (null[0], ids[0], th[0])
            starts = np.flatnonzero(new)
            bounds = [0, *starts[starts > 0], len(h1)]
            counts = np.add.reduceat(fresh, bounds[:-1])
            drop = np.zeros(len(h1), bool)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if new[a]:
                    if key is not None:
                        yield from ended(first)
                        first = False
                    key, docs, held = (h1[a], h2[a]), 0, []
                docs += int(counts[k])
                if docs >= min_docs:
                    drop[a:b] = True
                    for x in held:
                        yield rows(DROP, x)
                    held = []
                elif b == len(h1) or first:
                    held.append([c.slice(a, b - a) for c in cols])
            last = (null[-1], ids[-1], th[-1])
            if drop.any():
                mask = pa.array(drop)
                yield rows(DROP, [c.filter(mask) for c in cols])
        if key is not None:
            yield from ended(True)

    return run


def _bitmap(n_lines: int, positions) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(positions)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, n_lines, n_dropped and the compressed bitmap of kept lines, for documents that lose a line."""
    rows = common.written(spark, line_rows(docs, min_points), "lines")
    rows = rows.repartitionByRange(common.parts(spark), "h1", "h2", "doc_id", "th").sortWithinPartitions("h1", "h2", "doc_id", "th", "pos")
    decided = common.written(spark, rows.mapInArrow(decide(min_docs), _DECIDED), "line-decisions")
    edges = decided.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    # Edges are two rows a partition at most, which bounds the broadcast.
    late = decided.filter(F.col("kind") == WAIT).join(edges.hint("broadcast"), ["h1", "h2"], "left_semi")
    cols = ["doc_id", "th", "n_lines", "pos"]
    drops = decided.filter(F.col("kind") == DROP).select(*cols).unionByName(late.select(*cols))
    per = drops.groupBy("doc_id", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("positions"))

    @F.pandas_udf("binary")
    def bitmap(n, positions):
        return n.combine(positions, _bitmap)

    return per.select("doc_id", "th", "n_lines", F.size("positions").cast("long").alias("n_dropped"), bitmap("n_lines", "positions").alias("keep_bitmap"))


def _rebuild(text: str, bits: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, keep) if k])


@F.pandas_udf(T.StringType())
def rebuilt(text, bits):
    """The kept lines of a document, joined; null where there is nothing to drop."""
    return text.combine(bits, lambda t, b: None if b is None else _rebuild(t, b))


@F.pandas_udf(T.StringType())
def rebuilt_hash(text, bits):
    return text.combine(bits, lambda t, b: None if b is None else hashlib.sha256(_rebuild(t, b).encode()).hexdigest())


def deduped(spark: SparkSession, docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """keyed(docs) with n_dropped and keep_bitmap, null where a document loses nothing."""
    maps = keep_bitmaps(spark, docs, min_points, min_docs)
    maps = maps.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "n_dropped", "keep_bitmap").hint("shuffle_hash")
    keyed = common.keyed(docs)
    return keyed.join(maps, keyed.doc_id.eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left").drop("m_id", "m_th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduped(spark, common.table(spark, sf_dir, "documents"))
    changed = rebuilt_hash(F.when(F.col("keep_bitmap").isNotNull(), F.col("text")), "keep_bitmap")
    return out.select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(changed, F.sha2("text", 256)).alias("kept_sha256"),
    )


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
