"""The operators for training data against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import common, exactdups, lattice, lines, mixing, neardups, quality, queries, secrets, segmentation, sharding, sketch, tokens, vectors, wordhash

from ..oracle import connection, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, node string, size long"
WORDS = "alpha beta gamma delta épée straße 漢字 zeta eta theta iota kappa lambda mu nu xi".split()


def phrase(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def awkward():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, near copies, extra columns with names that operators use inside."""
    rng = random.Random(5)
    texts = ["", None, "   \n\t", "one", "ONE", "one\n", "a b c d", "same line\nx\nsame line", phrase(rng, 3000), "x" * 5000]
    base = phrase(rng, 60).split(" ")
    texts += [" ".join(base), "▁odd " + " ".join(base), " ".join(base[:-2]), "  ".join(base)]
    texts += [f"Shared Line  \nbody {i} {phrase(rng, 12)}\n\tshared line" for i in range(14)]
    texts += ["token = abcdefgh12 and AKIAABCDEFGHIJKL99 " + "0123456789abcdef" * 2, "é password:'short' secret=longenough1 api_key==zz", "deadbeef" * 5 + "g"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, i, 0.5, "n", 7) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "null id", "en", "s1", 7, 1, 0.1, None, None), (None, None, None, None, None, None, None, None, None), (5000, "one", None, "s0", 1, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30, 2)] + [(None, 1, 0), (3, None, 0), (10, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    v = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(250)]
    v += [(1000 + i, v[7][1]) for i in range(40)] + [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (400, [1.0, 2.0]), (500, []), (5, v[5][1])]
    spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def run(spark, name, d):
    return [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert run(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == oracle_rows(connection(SF), queries.ORACLES[name])


def test_quality_separates_held_out_rows(spark, sf_dir):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    big = common.table(spark, "/root/testdata/sf0.01", "documents")
    out = big.select("doc_id", quality.scored(spark, big, labels).alias("s"), quality.held_out(F.col("doc_id")).alias("h")).join(labels, "doc_id").filter("h").collect()
    assert len(out) > 50 and sum((r.s >= 0.7) == (r.quality == 1) for r in out) >= 0.97 * len(out)
    assert docs.count() == len(run(spark, "op1_quality_classifier", SF))
    rows = run(spark, "op1_quality_classifier", sf_dir)
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)


def _line_dedup(rows, min_docs):
    keys = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in {(r[0], r[1] or "") for r in rows}:
        for x in t.split("\n"):
            keys[key(x)].add((i, t))
    out = []
    for r in rows:
        ls = (r[1] or "").split("\n")
        kept = [x for x in ls if not key(x) or len(keys[key(x)]) < min_docs]
        out.append((r[0], len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, sf_dir):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run(spark, "op2_line_dedup", sf_dir)), key=repr)
    assert got == _line_dedup(awkward(), 10) and any(g[2] for g in got)


def test_line_runs_over_partition_borders():
    import pyarrow as pa

    rows = [(1, 1, d, 0, 9, 0) for d in range(12)] + [(2, 2, d, 0, 9, 0) for d in range(4)] + [(3, 3, 1, 0, 9, p) for p in range(15)]
    names = ["h1", "h2", "doc_id", "th", "n_lines", "pos"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    for cut in range(len(rows) + 1):
        found = []
        for part in (rows[:cut], rows[cut:]):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part[a : a + 5]), kinds)], names=names) for a in range(0, len(part), 5)]
            found += [r for b in lines.decide(10)(batches) for r in b.to_pylist()]
        total = collections.Counter()
        for r in found:
            if r["kind"] == lines.EDGE:
                total[r["h1"]] += r["n"]
        drops = {(r["h1"], r["doc_id"], r["pos"]) for r in found if r["kind"] == lines.DROP or r["kind"] == lines.WAIT and total[r["h1"]] >= 10}
        assert drops == {(1, d, 0) for d in range(12)}, cut


def test_lines_of_a_row_that_repeats_are_not_held(spark):
    import pyarrow as pa

    rows = [(1, "again\nand again\nagain")] * 5000 + [(i, "again\nown %d" % i) for i in range(2, 9)] + [(None, "again")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted({(r.doc_id, r.n_dropped) for r in lines.keep_bitmaps(spark, docs, 1, 9).collect()}, key=repr)
    assert got == sorted([(1, 2), (None, 1), *[(i, 1) for i in range(2, 9)]], key=repr)
    assert lines.keep_bitmaps(spark, docs, 1, 10).count() == 0
    # Many batches of one repeated row: one row waits at the end.
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])
    batch = pa.RecordBatch.from_pylist([dict(h1=5, h2=6, doc_id=None, th=8, n_lines=1, pos=0)] * 1000, schema=schema)
    out = list(lines.decide(10)(iter([batch] * 50)))
    assert sum(b.num_rows for b in out) == 2 and {k for b in out for k in b.column("kind").to_pylist()} == {lines.WAIT, lines.EDGE}


def test_token_store_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = collections.Counter(), 0
    got = run(spark, "op3_token_output", sf_dir)
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    places = sorted((r["start"], r["n_tokens"]) for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) == start
    by_place = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert by_place == sorted(by_place, key=lambda i: (i is not None, i or 0))
    ids = np.random.default_rng(0).integers(0, 2**32, 70_001, dtype=np.uint32)
    assert (tokens.unshuffle_planes(tokens.shuffle_planes(ids)) == ids).all() and len(tokens.unshuffle_planes([])) == 0


@pytest.mark.parametrize("text", ["<|endoftext|>, a<|startoftext|>b", "a\x1cb c d", "é, é;", "ΑΣ ΣΑΣ.", "I'LL can't 3.5, x--y... '", "İ, ǅ:", "\r\n\x0b a!!", "Été ÀÉÎ, ß; Øre. São e\u0301te e\u0301, ÷x× ºª µm ÿ!", "naïve's d'Été 1é é1 ſt ŒUVRE,"])
def test_token_pieces_keep_the_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    assert tokens.encoder(tokens.vocabulary())(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_exact_dedup(spark, sf_dir):
    got = run(spark, "op4_exact_dedup", sf_dir)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in awkward():
        groups[norm(r[1])].append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    want = collections.Counter((r[0], best[norm(r[1])][0], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in awkward())
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_tells_clashing_identifiers_apart(spark):
    chunk = lambda i, p: [(i, bytes([p]))]
    rows = [(1, 1, 5, "x", chunk(9, 1)), (2, 2, 5, "y", chunk(9, 2)), (3, 3, 5, "x", chunk(9, 1))]
    df = spark.createDataFrame(rows, "doc_id long, th long, n_points long, text_sha256 string, chunks array<struct<id long, proof binary>>")
    out = {r.doc_id: r.told_apart for r in exactdups.verified(df).collect()}
    assert out[1] == out[3] != out[2] and out[1]


def test_chunks_follow_the_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8)
    ends = exactdups.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exactdups.MOST and sizes[:-1].min() >= exactdups.LEAST
    moved = exactdups.cuts(np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), data]))
    assert len({e - 777 for e in moved} & set(ends)) > 0.9 * len(ends)


def _top(vs, k=10):
    ints = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in vs if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, a in {x for x in ints if x[0] % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_topk_with_ties(spark, sf_dir, monkeypatch):
    vs = [(r.vec_id, r.embedding) for r in common.table(spark, sf_dir, "embeddings").collect()]
    want = _top(vs)
    for rows, qs, size in ((8192, 1024, 1 << 24), (16, 1, 1 << 9)):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", size)  # the second takes several scans
        monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
        monkeypatch.setattr(vectors, "BLOCK_QUERIES", qs)
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run(spark, "op5_topk_search", sf_dir)} == want


def test_topk_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    other = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(1, 60)]
    same, second = [2.0, 2.0, 2.0], [-2.0, 1.0, 0.5]
    vs = other + [(100, same), (100, same)] + [(101 + i, same) for i in range(12)] + [(103, same)] * 3 + [(200, same), (200, second), (300, second)] + [(300, [9.0 + i, 9.0, 9.0]) for i in range(14)]
    got = vectors.search(spark, spark.createDataFrame(vs, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    ints = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in vs]
    for q in (100, 200, 300):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for a in {a for i, a in ints if i == q} for i, b in ints if i != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]


def test_topk_of_a_query_with_very_many_candidates(spark):
    """All scores are near one another, so bounds hold back almost nothing."""
    rng = np.random.default_rng(9)
    vs = [(i, [1.0 + float(x) / 4096 for x in rng.normal(size=6)]) for i in range(1, 400)] + [(500, [1.0] * 6)]
    got = vectors.search(spark, spark.createDataFrame(vs, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == _top(vs)


def _spans(text):
    kinds = [("assign", r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 0, 16), ("hex", r"[0-9a-f]+", 0, 0, 32)]
    out = []
    for rank, (kind, p, flags, g, n) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text, flags) if len(m.group(g)) >= n]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, sf_dir):
    for d, texts in ((sf_dir, [(r[0], r[1] or "") for r in awkward()]), (SF, [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()])):
        got = run(spark, "op6_secret_scan", d)
        want = collections.Counter((i, _spans(t)) for i, t in texts)
        assert collections.Counter((r["doc_id"], r["spans"]) for r in got) == want
        assert all(r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() for r in got)
        assert d == SF or any(r["n_assign"] for r in got) and any(r["n_access"] for r in got) and any(r["n_hex"] for r in got)


def test_ledger_scans_only_what_is_new(spark):
    path = common.new_path(spark, "ledger")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = secrets.update_ledger(spark, make([(1, "token=aaaaaaaa1"), (2, "token=aaaaaaaa1"), (3, "clean")]), path)
    assert first.count() == 2
    again = secrets.update_ledger(spark, make([(4, "clean"), (5, "new secret: bbbbbbbb2")]), path)
    assert again.count() == 3 and {r.doc_id: len(r.spans) for r in secrets.findings(make([(9, "token=aaaaaaaa1"), (8, "clean")]), again).collect()} == {9: 1, 8: 0}
    assert secrets.update_ledger(spark, make([(4, "clean")]), path, version=2).count() == 1


def test_ledger_counts_a_blob_once(spark):
    path = common.new_path(spark, "ledger")
    docs = spark.createDataFrame([(1, "token=aaaaaaaa1"), (2, "token=aaaaaaaa1"), (3, "x")], "doc_id long, text string")
    secrets.update_ledger(spark, docs, path)
    again = spark.read.parquet(path).collect()
    spark.createDataFrame(again, spark.read.parquet(path).schema).write.mode("append").parquet(path)
    out = secrets.findings(docs, spark.read.parquet(path)).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in out) == [(1, 1), (2, 1), (3, 0)]


def test_mixing_of_sources_without_words(spark):
    rows = [(i, "a b c" * 3, "s1") for i in range(20)] + [(100 + i, "", None) for i in range(5)] + [(200 + i, " \n", "s0") for i in range(3)] + [(300, "w", "s2"), (301, "", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.taken(*mixing.mix(spark, docs)[:3]).collect()}
    assert len(out) == len(rows) and all((out[i].taken, out[i].copies, out[i].target) == (0, 0, 0.0) for i in (100, 104, 200, 202))
    assert out[300].taken == 3 and out[301].copies <= 3  # a source stops at 3 times its size
    kept = collections.Counter(r.doc_id for r in mixing.stage(spark, docs, "").collect())
    assert kept[100] == kept[200] == 0 and kept[300] == 3 and max(kept.values()) <= 3


def test_mixing_of_one_row_that_repeats(spark):
    """A source of copies of one row comes as near to its target as its largest document allows."""
    rows = [(1, "w " * 50, "s0", 1.5)] * 1000 + [(2 + i, "a b c " * (i % 9), "s1", 0.1 * i) for i in range(400)] + [(None, None, None, None)] * 3 + [(9000, "x y", None, 2.0)] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k double").repartition(7)
    got = mixing.taken(*mixing.mix(spark, docs)[:3]).collect()
    sums, goal = collections.Counter(), {}
    assert len(got) == len(rows)
    for r in got:
        sums[r.source_size, r.target] += r.taken
        goal[r.source_size, r.target] = max(goal.get((r.source_size, r.target), 0), r.size)
    assert all(abs(taken - target) <= goal[size, target] for (size, target), taken in sums.items()) and len(sums) == 3
    kept = collections.Counter(tuple(r) for r in mixing.stage(spark, docs, "").collect())
    assert kept[rows[0]] * 50 == sum(r.taken for r in got if r.doc_id == 1) and kept[rows[-1]] * 2 == sum(r.taken for r in got if r.doc_id == 9000)
    again = mixing.taken(*mixing.mix(spark, docs.repartition(3))[:3]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing(spark, sf_dir):
    for d in (sf_dir, SF, "/root/testdata/sf0.01"):
        docs = common.table(spark, d, "documents").collect()
        sizes = collections.Counter()
        for r in docs:
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        goal, open_, left = {}, set(order), float(sum(sizes.values()))
        while open_:
            total = sum(weight[s] for s in open_)
            over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
            if not over:
                goal |= {s: left * weight[s] / total for s in open_}
                break
            goal |= {s: 3.0 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            open_ -= over
        got = [r.asDict() for r in queries.QUERIES["op7_source_mixing"](spark, d).collect()]
        assert len(got) == len(docs) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        for r in got:
            assert any(math.isclose(r["target"], goal[s], rel_tol=1e-9, abs_tol=1e-6) and r["source_size"] == sizes[s] for s in order)
        taken = collections.Counter()
        for (t, z), n in collections.Counter(((r["target"], r["source_size"]), 0) [0] for r in got).items():
            taken[t, z] = sum(r["taken"] for r in got if (r["target"], r["source_size"]) == (t, z))
            largest = max(r["size"] for r in got if (r["target"], r["source_size"]) == (t, z))
            same = sum(math.isclose(goal[s], t, rel_tol=1e-9, abs_tol=1e-6) and sizes[s] == z for s in order)
            assert abs(taken[t, z] - t * same) <= 2 * largest * same + 1e-6
        again = [r.asDict() for r in queries.QUERIES["op7_source_mixing"](spark, d).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, again))


def _shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _components(rows):
    sets, parent = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def near_copies(n=150, words=40, seed=2):
    rng = random.Random(seed)
    base, out = phrase(rng, words).split(" "), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        out.append((i, " ".join(w)))
    return out + [(1000 + i, phrase(rng, 30)) for i in range(40)]


def test_near_dedup(spark, sf_dir, tmp_path, monkeypatch):
    got = run(spark, "op8_near_dedup", sf_dir)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components([(r[0], r[1]) for r in awkward()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    rows = near_copies()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for most_rows, most_shingles in ((4096, 1 << 18), (16, 400)):
        monkeypatch.setattr(neardups, "BLOCK_ROWS", most_rows)
        monkeypatch.setattr(neardups, "BLOCK_SHINGLES", most_shingles)
        got = run(spark, "op8_near_dedup", str(tmp_path))
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _components(rows)


def test_tiny_sets_are_linked_exactly(spark):
    """Texts of 6 to 10 words and the same with one word more before or behind; sketches alone lose some of these links."""
    rng, rows = random.Random(11), []
    for i in range(400):
        w = [f"w{rng.randrange(10**9)}" for _ in range(5 + i % 6)]
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w, "last"])), (3 * i + 2, " ".join(["first", *w]))]
    got = neardups.clustered(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best = {r.doc_id: r.best.doc_id for r in got}
    for i in range(400):
        n = len(_shingles(rows[3 * i][1]))
        for other in (3 * i + 1, 3 * i + 2):
            if n <= 5:
                assert (best[3 * i] == best[other]) == (4 * n >= 3 * (n + 1)), (n, rows[3 * i])


def test_recall_near_the_threshold(spark):
    """Pairs whose similarity is between 0.75 and 0.8, and pairs just below 0.75."""
    rng, rows, want = random.Random(12), [], {}
    for i in range(2000):
        n = rng.randrange(30, 120)
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        v = list(w)
        for p in rng.sample(range(0, n, 6), max(1, n // 38)):
            v[p] = "edit"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        want[i] = len(a & b) / len(a | b)
    best = {r.doc_id: r.best.doc_id for r in neardups.clustered(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, s in want.items() if 0.75 <= s < 0.8]
    assert len(near) > 300 and sum(best[2 * i] == best[2 * i + 1] for i in near) == len(near)
    assert all(best[2 * i] != best[2 * i + 1] for i, s in want.items() if s < 0.75)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64)) for _ in range(2))
    ka, kb, kab = sketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ka, kb) == kab).all()
    c = np.union1d(a[:800], b[:100])
    kc = sketch.registers([c])[0]
    both = len(np.intersect1d(a, c)) / len(np.union1d(a, c))
    assert abs((ka == kc).mean() - both) < 0.15
    n = lambda *x: np.array(x)
    assert sketch.may_reach(ka[None], kc[None], n(len(a)), n(len(c)))[0] and not sketch.may_reach(ka[None], kb[None], n(900), n(900))[0]


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a bb\tCCC", "", None, "bb a", "é ccc"]
    h, rows = wordhash.word_hashes(*wordhash.buffers(pa.array(texts)), True)
    assert rows.tolist() == [0, 3, 3, 3, 5, 7] and h[0] == h[4] and h[1] == h[3] and h[2] == h[6]
    one, _ = wordhash.word_hashes(*wordhash.buffers(pa.array(["ccc"])), True)
    assert one[0] == h[2]


def test_sharding(spark, sf_dir):
    for d, n in ((sf_dir, len(awkward())), ("/root/testdata/sf0.01", 1000)):
        got = run(spark, "op9_kd_sharding", d)
        assert len(got) == n and all(0 <= r["shard"] < 40 for r in got)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in common.table(spark, d, "documents").collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    weight = collections.Counter()
    for r in got:
        weight[r["shard"]] += r["size"]
    assert len(weight) == 40 and max(weight.values()) < 1.15 * sum(weight.values()) / 40
    groups = collections.defaultdict(set)
    for r in got:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for (_, z), v in groups.items() if z < 5000)


def test_shards_are_even_with_groups_and_rows_that_repeat(spark):
    """A large group of copies, one row repeated for a quarter of all rows, and very many empty texts."""
    rng = random.Random(8)
    rows = [(i, phrase(rng, rng.randrange(1, 60)), "en", f"s{i % 3}") for i in range(1500)] + [(5000 + i, "copy " * 200, "en", "s1") for i in range(300)] + [(7777, "again " * 50, "en", "s2")] * 900 + [(9000 + i, None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for shards in (40, 7, 1):
        got = sharding.sharded(spark, docs, shards).collect()
        assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 16) for i, t, _, _ in rows)
        weight, slots = collections.Counter(), collections.defaultdict(list)
        for r in got:
            weight[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        assert len(weight) == shards and max(weight.values()) < 1.1 * sum(weight.values()) / shards
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert len({r.shard for r in got if r["size"] == 16}) == 1  # a group of many rows and few bytes stays whole


def test_shards_of_the_larger_table_are_even(spark):
    got = queries.QUERIES["op9_kd_sharding"](spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(got) == 40 and max(r.n for r in got) < 1.05 * sum(r.n for r in got) / 40


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Texts of two megabytes: prose, one line, one word, blanks, and copies of them, beside short ones."""
    rng, d = random.Random(6), str(tmp_path_factory.mktemp("long"))
    prose = phrase(rng, 240_000)
    rows = [(0, prose), (1, prose + " end"), (2, prose.replace(" ", "\n")), (3, "x" * 200_000), (4, " \n" * 1_000_000), (5, "short text of a few words"), (6, prose), (7, "token = " + "a" * 200_000)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (5, 0, 0), (3, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_texts_of_megabytes(spark, long_dir):
    from tokenizers import Tokenizer

    d, rows = long_dir
    assert len(run(spark, "op1_quality_classifier", d)) == len(rows)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run(spark, "op2_line_dedup", d))
    assert got == _line_dedup(rows, 10)
    t = Tokenizer.from_file(tokens.vocabulary())
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, x in rows if i in (0, 2, 4, 5)}
    assert want.items() <= {r["doc_id"]: r["ids_crc32"] for r in run(spark, "op3_token_output", d)}.items()  # longer than a chunk of 65,536 ids
    assert {r["doc_id"]: r["keep_id"] for r in run(spark, "op4_exact_dedup", d)} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 0, 7: 7}
    assert {(r["doc_id"], r["spans"]) for r in run(spark, "op6_secret_scan", d)} == {(i, _spans(x)) for i, x in rows}
    assert {r["doc_id"]: r["size"] for r in run(spark, "op7_source_mixing", d)} == {i: len(x.split()) for i, x in rows}
    assert {r["doc_id"]: r["component_id"] for r in run(spark, "op8_near_dedup", d)} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 0, 7: 7}
    assert {r["doc_id"]: r["size"] for r in run(spark, "op9_kd_sharding", d)} == {i: len(x.encode()) + 16 for i, x in rows}
    sampled = run(spark, "op10_sampled_segmentation", d)
    assert {r["doc_id"] for r in sampled} == set(range(8)) and all(r["round_trip"] for r in sampled)


def test_sample_of_the_fit_is_bounded_by_documents(spark):
    rng = random.Random(4)
    rows = [(1, phrase(rng, 30))] * 500 + [(i, phrase(rng, 30) if i % 2 else "JUNK 99 !! " * 10) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 2000)] + [(1, 1)] * 50, "doc_id long, quality int")
    once = docs.dropDuplicates()
    assert (quality.train(docs, labels) == quality.train(once, labels.distinct())).all()


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.cuts_at_blanks(tokens.vocabulary()) and not tokens.cuts_at_blanks(path)
    text = "Some words,  two spaces\n\nand lines."
    assert tokens.encoder(path)(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _all_paths(v, text):
    table = {}
    for i, b in enumerate(v.bytes_of):
        p = b.decode("utf-8", "ignore").replace(" ", lattice.SPACE)
        if p and i > 258:
            table.setdefault(p, i)
    weight = dict(zip(v.ids.tolist(), v.weights.tolist()))
    out = {(): 0.0}
    for unit in lattice._UNITS.findall(lattice.SPACE + text.replace(" ", lattice.SPACE)):
        found = {}

        def go(i, ids, w, unit=unit, found=found):
            if i == len(unit):
                found[tuple(ids)] = w
                return
            for j in range(i + 1, len(unit) + 1):
                k = table.get(unit[i:j])
                if k in weight:
                    go(j, [*ids, k], w + weight[k])
                elif j == i + 1:
                    raw = unit[i:j].encode()
                    go(j, [*ids, *(int(v.byte_ids[b]) for b in raw)], w + v.fallback * len(raw))

        go(0, [], 0.0)
        out = {a + b: x + y for a, x in out.items() for b, y in found.items()}
    z = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(x - z) for k, x in out.items()}


@pytest.mark.parametrize("text", ["the of", "is\n漢 it", "é"])
def test_sampled_segmentations_follow_their_law(text):
    v = lattice.Vocabulary(segmentation.model(), theta=0.15)  # flat enough for many segmentations to be drawn
    law, n = _all_paths(v, text), 6000
    out = lattice.sample(v, [text] * n, wordhash.mix64(np.arange(n, dtype=np.uint64)), 3)
    first = collections.Counter(tuple(r[0][0].tolist()) for r in out)
    for ids, p in law.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert all(len({tuple(x[0].tolist()) for x in r}) == len(r) == min(3, len(law)) for r in out)
    assert all(abs(math.exp(x[1]) - law[tuple(x[0].tolist())]) < 1e-9 and x[2] <= 0 for r in out[:300] for x in r)
    # Inclusion scores make sums over samples unbiased: the probabilities of all segmentations sum to 1.
    assert abs(np.mean([sum(math.exp(x[1] - x[2]) for x in r) for r in out]) - 1) < 0.05
    top = max(law, key=law.get)
    second = collections.Counter(tuple(r[1][0].tolist()) for r in out if len(r) > 1 and tuple(r[0][0].tolist()) == top)
    total = sum(second.values())
    for ids, p in law.items():
        if ids != top and total:
            p = min(1.0, p / (1 - law[top]))
            assert abs(second[ids] / total - p) < 5 * math.sqrt(p * (1 - p) / total) + 0.01


@pytest.mark.parametrize("theta", [0.15, 1.0])
def test_best_segmentation_is_the_likeliest_of_all(theta):
    v, texts = lattice.Vocabulary(segmentation.model(), theta=theta), ["the of", "is\n漢 it", "é", "", "  a  b\n", "the of"]
    for text, (ids, log_p) in zip(texts, lattice.best(v, texts)):
        law = _all_paths(v, text) if text else {(): 1.0}
        top = max(law.values())
        assert abs(law[tuple(ids.tolist())] - top) < 1e-9 and abs(math.exp(log_p) - top) < 1e-9
    assert lattice.best(v, []) == []


def test_best_segmentations_of_a_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = segmentation.best_encoded(docs, segmentation.model()).withColumn("back", segmentation.decoder(segmentation.model())("ids")).collect()
    want = collections.Counter((r.doc_id, (r.text or "").replace(lattice.SPACE, " ")) for r in docs.select(F.col("doc_id").cast("long"), "text").collect())
    assert collections.Counter((r.doc_id, r.back) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.log_prob <= 0 for r in rows)


def _full_law(v, text):
    """All segmentations over every piece of the model, without units."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=segmentation.model())
    n = m.get_piece_size()
    whole = lattice.SPACE + text.replace(" ", lattice.SPACE)
    pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    weigh = lambda i: -0.15 * math.log(2 - max(m.get_score(i), -n))
    ways = {0: {(): 0.0}}
    for j in range(1, len(whole) + 1):
        ways[j] = {}
        for i in range(j):
            k = pieces.get(whole[i:j])
            if k is None and i + 1 < j:
                continue
            raw = whole[i:j].encode()
            ids, w = ((k,), weigh(k)) if k is not None else (tuple(int(v.byte_ids[b]) for b in raw), v.fallback * len(raw))
            ways[j] |= {a + ids: x + w for a, x in ways[i].items()}
    z = np.logaddexp.reduce(list(ways[len(whole)].values()))
    return {a: math.exp(x - z) for a, x in ways[len(whole)].items()}, tuple(m.encode(text))


@pytest.mark.parametrize("text", ["a  b", " x", "   ", "a  ", "\n  b", "a \n   c"])
def test_runs_of_spaces_have_all_their_segmentations(text):
    v = lattice.Vocabulary(segmentation.model(), theta=0.15)
    (law, own), n = _full_law(v, text), 4000
    out = lattice.sample(v, [text] * n, wordhash.mix64(np.arange(n, dtype=np.uint64)), 2)
    first = collections.Counter(tuple(r[0][0].tolist()) for r in out)
    assert own in law and first[own]
    assert all(abs(math.exp(x[1]) - law[tuple(x[0].tolist())]) < 1e-9 for r in out for x in r)
    for ids, p in law.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert abs(np.mean([sum(math.exp(x[1] - x[2]) for x in r) for r in out]) - 1) < 0.05
    assert all(v.decode(x[0].tolist()) == text for r in out[:50] for x in r)


def test_segmentation_round_trip(spark, sf_dir):
    rows = run(spark, "op10_sampled_segmentation", sf_dir)
    assert all(r["round_trip"] for r in rows) and {r["sample"] for r in rows} == {1, 2}
    per = collections.Counter(r["doc_id"] for r in rows)
    assert per[0] == 1 and per[10] == 6 and all(-math.inf < r["log_inclusion"] <= 0 for r in rows)
    empty = next(r for r in rows if r["doc_id"] == 0)
    assert (empty["n_tokens"], empty["log_prob"], empty["log_inclusion"]) == (0, 0.0, 0.0)
    docs = common.table(spark, sf_dir, "documents")
    ids = segmentation.encoded(docs, segmentation.model())
    text = ids.filter("doc_id = 12").select(segmentation.decoder(segmentation.model())("ids").alias("t")).collect()
    assert {r.t for r in text} == {awkward()[12][1]}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=segmentation.model())
    assert m.decode(ids.filter("doc_id = 8 AND sample = 1").first().ids) == awkward()[8][1]
