"""Token-id output with bit-plane shuffling.

Documents are range partitioned by doc_id, and each partition becomes one shard: chunks of whole documents in ascending order.
A chunk's ids (unsigned 32-bit) are cut into blocks of `BLOCK` ids; each block is transposed into its four byte planes, and each
plane is compressed with zstandard, so the high planes, nearly constant, take almost no space. The store is a Parquet table:
one row per chunk holds the planes, and its other columns are the chunk index (shard, chunk, token offset in the shard, documents, lengths),
which a reader can scan without touching the planes. Offsets over all shards are sums over the index, one row a shard.

A tokenizer with the normaliser and pre-tokenizer stated below cuts at blanks before anything else, so ids of a text are the ids of its pieces between spaces and line
ends, one after the other; each worker remembers the ids of pieces it has met, in a table of bounded size. Any other tokenizer gets whole texts.

Defined cases: null text is empty; an empty text has only the end id; a null doc_id sorts first; rows that repeat doc_id follow each other in the order of
their text hash, each with a place of its own; an empty table gives an empty store and an empty result. doc_id must be a number or the text of one, as in the store it is a long.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
BLOCK, CHUNK = 16_384, 65_536
#: Pieces that a worker remembers; longer pieces are not kept.
REMEMBER, REMEMBER_CHARS = 900_000, 64
MARKS = ".,!?;:"
#: Words that go through the tokenizer together, the special token between them, and characters of texts that are looked up together.
TOGETHER, SEPARATOR, LOOKED_UP = 1000, "<|startoftext|>", 1 << 20
PLANES = 4
#: What a tokenizer file must say for texts to be cut at blanks and before marks without changing an id.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that lower-case one by one, alike in Python and in the tokenizer, and that no normal form changes.
LETTERS, LOWER_LETTERS = (re.compile(p).fullmatch for p in ("[A-Za-zÀ-ÖØ-öø-ÿ]+", "[a-zß-öø-ÿ]+"))
#: Byte-level tokenizers give the bytes outside these ranges, in order, the code points from 256 on.
BYTES_AS_THEY_ARE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_POINTS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in BYTES_AS_THEY_ARE)}
CHUNK_SCHEMA = "shard int, chunk int, offset long, doc_ids array<long>, lengths array<int>, planes array<binary>"
_known: dict[str, tuple[object, dict[str, bytes], bool]] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer's file has the normaliser and pre-tokenizer under which pieces can be encoded apart."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    first, *later = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True
    added = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in said.get("added_tokens", ()))
    bytes_only = len(later) == 1 and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in later)
    return cut and added and bytes_only and (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS and not said.get("post_processor")


def core(piece: str) -> tuple[str, str]:
    """A piece as the word it stands for and the marks behind it, where cutting there changes no id: behind a letter or digit
    the tokenizer always cuts before such a mark, and it lower-cases ASCII letters and `LETTERS` as Python does."""
    word = piece.rstrip(MARKS)
    if LETTERS(word):
        return word.lower(), piece[len(word) :]
    if not word or word == piece and not piece.isascii() or "<|" in piece or not word[-1].isalnum() or not word[-1].isascii():
        return piece, ""
    return word.lower() if word.isascii() else word, piece[len(word) :]


def words_encoded(tokenizer, words: list[str]) -> list[bytes]:
    """The bytes of the ids of each word. A word of lower-case letters alone is one piece in normal form and goes to the tokenizer's model at once.
    Of the others many go through the tokenizer as one text with a special token between them, which cuts before anything else;
    words that might hold a special token themselves go alone."""
    model = tokenizer.model.tokenize
    out = {w: array("I", [x.id for x in model(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_POINTS))]).tobytes() for w in words if LOWER_LETTERS(w)}
    out.update({w: array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words if "<|" in w})
    plain = [w for w in words if w not in out]
    for a in range(0, len(plain), TOGETHER):
        some = plain[a : a + TOGETHER]
        ids = np.array(tokenizer.encode_batch_fast([SEPARATOR.join(some)], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(ids == tokenizer.token_to_id(SEPARATOR)) * 4).tolist()
        raw = ids.tobytes()
        out.update(zip(some, [raw[x:y] for x, y in zip([0, *[e + 4 for e in at]], [*at, len(raw)])]))
    return [out[w] for w in words]


def batch_encoder(path: str):
    """A function: texts to the bytes of their ids."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _known[path] = tokenizer, {"": b""}, cuts_at_blanks(path) and tokenizer.token_to_id(SEPARATOR) is not None
    tokenizer, known, apart = _known[path]
    if not apart:
        return lambda texts: [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def encode(texts: list[str]) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        missing = set().union(*pieces).difference(known)
        if len(known) + len(missing) > REMEMBER:
            known.clear()
            known[""] = b""
            missing = set().union(*pieces).difference(known)
        if missing:
            asked, words, marks = list(missing), [], []
            for p in asked:
                word, mark = core(p)
                words.append(word)
                marks.append(mark)
            new = list({*words, *marks}.difference(known))
            known.update(zip(new, words_encoded(tokenizer, new)))
            known.update({p: known[w] + known[m] if m else known[w] for p, w, m in zip(asked, words, marks)})
            out = [b"".join(map(known.__getitem__, p)) for p in pieces]
            for x in [x for x in (*missing, *new) if len(x) > REMEMBER_CHARS]:
                known.pop(x, None)
            return out
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    return encode


def encoder(path: str):
    """A function: text to the bytes of its ids."""
    encode = batch_encoder(path)
    return lambda text: encode([text])[0]


def shuffle_planes(ids: np.ndarray) -> list[bytes]:
    """The compressed byte planes of each block, block by block."""
    pack = zstandard.ZstdCompressor(level=1).compress
    out = []
    for a in range(0, len(ids), BLOCK):
        planes = ids[a : a + BLOCK].astype("<u4").view(np.uint8).reshape(-1, PLANES).T
        out += [pack(np.ascontiguousarray(p).tobytes()) for p in planes]
    return out


def unshuffle_planes(planes: list[bytes]) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    out = [np.zeros(0, "<u4")]
    for a in range(0, len(planes), PLANES):
        block = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes[a : a + PLANES]], axis=1)
        out.append(np.ascontiguousarray(block).view("<u4").ravel())
    return np.concatenate(out)


def write(spark: SparkSession, docs: DataFrame, path: str, vocab: str, end_id: int = END_ID) -> None:
    """Writes the store of `docs` at `path`."""
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches):
        from pyspark import TaskContext

        encode, number = batch_encoder(vocab), TaskContext.get().partitionId()
        chunk, offset, ids, texts, size = 0, 0, [], [], 0

        def row():
            lengths = [len(x) // 4 for x in texts]
            planes = shuffle_planes(np.frombuffer(b"".join(texts), "<u4"))
            cols = zip((number, chunk, offset, ids, lengths, planes), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cols], names=["shard", "chunk", "offset", "doc_ids", "lengths", "planes"])

        def encoded():
            held, doc_ids, chars = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    held.append(text.as_py())
                    doc_ids.append(doc_id.as_py())
                    chars += len(held[-1])
                    if chars >= LOOKED_UP:
                        yield from zip(doc_ids, encode(held))
                        held, doc_ids, chars = [], [], 0
            yield from zip(doc_ids, encode(held))

        for doc_id, found in encoded():
            ids.append(doc_id)
            texts.append(found + end)
            size += len(texts[-1]) // 4
            if size >= CHUNK:
                yield row()
                chunk, offset, ids, texts, size = chunk + 1, offset + size, [], [], 0
        if ids:
            yield row()

    ordered = common.keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(common.parts(spark), "doc_id", "th").sortWithinPartitions("doc_id", "th")
    ordered.select("doc_id", "text").mapInArrow(shard, CHUNK_SCHEMA).write.parquet(path)


def shard_starts(index: DataFrame) -> DataFrame:
    """Ids before each shard; one row a shard, so the window over all of them is small."""
    sizes = index.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start"))


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens and `ids` (or, with digest, the crc32 of their bytes)."""
    chunks = spark.read.parquet(path)

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                c = {n: batch.column(n)[k] for n in batch.schema.names}
                ids, lengths = unshuffle_planes(c["planes"].as_py()), np.array(c["lengths"].as_py(), np.int64)
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                out = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if digest else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                place = pa.array(c["offset"].as_py() + cuts[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c["shard"].as_py()] * len(parts), pa.int32()), c["doc_ids"].values, place, pa.array(lengths), out], names=["shard", "doc_id", "place", "n_tokens", "ids"])

    docs = chunks.mapInArrow(decode, f"shard int, doc_id long, place long, n_tokens long, ids {'long' if digest else 'array<long>'}")
    # One row a shard, as many shards as the write had partitions: that bounds the broadcast.
    docs = docs.join(shard_starts(chunks).hint("broadcast"), "shard")
    return docs.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", F.col("ids").alias("ids_crc32" if digest else "ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-store")
    write(spark, common.table(spark, sf_dir, "documents"), path, vocabulary())
    return read(spark, path, digest=True)
