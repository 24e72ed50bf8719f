"""The prefix trie, the spelling variants and the repeated passages against brute force, on small tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelode.llm import prefixes, recompress, repeats, spelling, wordhash

EXTRA = ["n", "sign", "words", "piece", "x"]  # names that the operators use inside


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, "w", 3, None) for i, t in rows], "doc_id long, text string, n long, sign long, words string, piece int, x int").repartition(parts)


# ---- conversations


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5((text or "").encode()).digest(), hashlib.md5((role or "").encode()).digest(), role or "", text or ""))
    own = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - int(np.fmod(c, 100))
        out[c] = [*own.get(lender, [])[:h], *turns[h:]]
    return out


def trie(rows):
    convs = rebuilt(rows)
    members = collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=repr)


def spark_trie(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 5, "h", 1) for r in rows], "conv_id long, turn long, role string, text string, pos int, h string, blk int").repartition(parts)
    return sorted((tuple(r) for r in prefixes.trie(spark, df).collect()), key=repr)


def talks(seed, n, few):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.choice([0, 0, 1, 2])
        for t in range(rng.choice([0, 1, 3, 5, 9, 14])):
            rows.append((c + rng.choice([0, 100, 300]) * (seed % 2), t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]) if not same else "user", rng.choice(["a", "bb", "é漢", "", None]) if t > few else f"same {same}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_of_awkward_conversations(spark, seed):
    rows = talks(seed, 120, 7 if seed < 3 else 2)
    rows += rows[5:9] + [(None, 1, "user", "no id"), (-7, None, None, None), (-107, 3, "user", "minus"), (-7, 2, "user", "x" * 50_000)]
    assert spark_trie(spark, rows) == trie(rows)


def test_trie_of_one_long_conversation_and_of_copies(spark):
    rows = [(700, t, "user", f"turn {t}") for t in range(250)] + [(100 + c, t, "user", f"copy {t}") for c in range(200) for t in range(6)]
    assert spark_trie(spark, rows, 5) == trie(rows)


def test_trie_of_nothing(spark):
    assert spark_trie(spark, [(None, 1, "user", "x")]) == []
    alone = spark_trie(spark, [(41, 0, "user", "x")])  # its only turn is replaced by an opening that nobody lends
    assert zlib.crc32(b"41") % 6 and alone == [(41, 0, None, 1, 0, 1, 0, hashlib.sha256(b"41").hexdigest())]


def test_ids_of_a_large_class_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK_IDS", 7)
    rows = [(c, 0, "user", "all the same") for c in range(1000, 1400)]
    assert spark_trie(spark, rows) == trie(rows)


# ---- spelling


def variants(docs, least=7, every=31):
    counts, lower = collections.Counter(), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= least
    n = {w: k for w, k in counts.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = []
    friends = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {w: min(f, key=lambda v: (-n[v], v)) if f and max(n[v] for v in f) >= 10 * n[w] else None for w, f in friends.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(friends[w]), n.get(form[w])))
    return sorted(out, key=repr)


def spark_variants(spark, docs):
    got = spelling.variants(spark, documents(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in got), key=repr)


def misspelt(seed):
    rng = random.Random(seed)
    base = ["spelling", "variants", "straße", "façadesque", "éclairées", "aaaaaaaa", "abababab", "ababababa", "longestword" * 9]
    words = []
    for k, w in enumerate(base):
        words += [w] * (400 if k % 2 else 60)
        for _ in range(40):
            i, c = rng.randrange(len(w)), rng.choice("abÿlÈ")
            words += rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]).split() * rng.choice([1, 2, 5, 30])
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "\n", "1", "×"]).join(words[i::25])) for i in range(25)]
    return [*docs, docs[3], docs[3], (None, docs[4][1]), (90, None), (91, ""), (92, "ÀÈ漢ÿé" * 5), (93, "y" * 3000 + " " + "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3001)]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, monkeypatch, small):
    if small:  # upper trees, blocks of words and of askers, deep fine trees
        for name, v in (("LEAF", 20), ("BLOCK_WORDS", 7), ("BLOCK_ASKERS", 11), ("FINE_LEAF", 2), ("SAMPLE", 200)):
            monkeypatch.setattr(spelling, name, v)
    docs = misspelt(4)
    want = variants(docs)
    assert spark_variants(spark, docs) == want and sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] and r[1] for r in want)


def test_variants_of_nothing(spark):
    assert spark_variants(spark, [(1, None), (2, "short words"), (3, "onlyonce")]) == []


def test_checksums_go_on_from_a_prefix():
    words = [b"a", b"straight", "é".encode() * 40, b"x" * 300, b"word"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    got = spelling.checksums(data, ends - [len(w) for w in words], ends, before)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i, w in enumerate(words)]


def test_boxes_miss_no_edit():
    rng = random.Random(8)
    for length in (7, 8, 11):
        words = ["".join(rng.choice("abcé") for _ in range(length)) for _ in range(600)]
        flat, ends = np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.arange(601) * length
        tree = spelling.Tree(spelling.vectors(flat, ends, np.full(600, length // 2)), 3)
        for half, longer in spelling.SEARCHES:
            i = rng.randrange(length // 2) + (half * (length // 2))
            asks = [w[:i] + ("" if longer else "d") + w[i + 1 :] for w in words]
            own = np.frombuffer("".join(asks).encode("latin-1"), np.uint8), np.arange(601) * (length - longer)
            rows, leaves = tree.reach(spelling.asking(*own, half, longer), half, longer)
            met = {(r, w) for r, k in zip(rows.tolist(), leaves.tolist()) for w in tree.order[slice(*tree.span[k])].tolist()}
            for k, (a, w) in enumerate(zip(asks, words)):
                last = max(j for j in range(length) if w[:j] + w[j + 1 :] == a) if longer else i
                assert (k, k) in met or (last >= length // 2) != bool(half)  # then the other search finds it


# ---- repeats


def without_repeats(docs, size=35):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    seen = collections.Counter(tuple(w[k : k + size]) for _, w in split for k in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def spark_without_repeats(spark, docs, parts=3):
    return sorted((tuple(r) for r in repeats.deduped(spark, documents(spark, docs, parts)).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def passages(seed):
    rng = random.Random(seed)
    word = lambda k=40: rng.choice("alpha beta Beta épée 漢字 gamma, delta. the of".split()) + (str(rng.randrange(k)) if k else "")
    text = lambda n, k=40: [word(k) for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    docs = []
    for i in range(40):
        parts = text(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) - 30))
            parts += p[a:] + text(rng.randrange(20))
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    own = text(50)
    docs += [(50, " ".join(own + text(9) + own)), (51, " ".join(["run"] * 90)), (52, " ".join(["run"] * 35)), (53, " ".join(["run"] * 34)), (54, " ".join(["solo"] * 35)), (55, " ".join(["solo2"] * 36))]
    docs += [(56, " ".join(["ab", "cd"] * 40)), (57, " ".join(["cd", "ab"] * 18)), (58, " ".join(["p", "q", "r"] * 13)), (59, " ".join(["u"] * 20 + ["v"] * 30)), (60, " ".join(["u"] * 30 + ["v"] * 20 + ["w"] * 3))]
    docs += [(70, None), (71, ""), (72, " \n"), (None, docs[3][1]), docs[5], docs[5], (80, " ".join(text(3000, 0))), (81, "long" * 10_000)]
    docs += [(90 + i, " ".join(shared[4][:150] + text(3) + shared[4][150:])) for i in range(30)]
    return docs


@pytest.mark.parametrize("parts", [3, 40])
def test_repeats(spark, parts):
    docs = passages(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert spark_without_repeats(spark, docs, parts) == without_repeats(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeats_of_a_row_that_repeats_and_of_nothing(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(100))
    docs = [(1, text)] * 3000 + [(2, " ".join(str(rng.random()) for _ in range(100)))]
    assert spark_without_repeats(spark, docs) == without_repeats(docs)
    assert spark_without_repeats(spark, [(1, text), (2, None)]) == without_repeats([(1, text), (2, None)])


def test_equal_windows_have_equal_signs():
    rng = np.random.default_rng(2)
    for k in range(60):
        window = rng.integers(0, 4 if k % 2 else 60, 35).astype(np.uint64)
        pieces = [np.concatenate([rng.integers(0, 5, a).astype(np.uint64), window, rng.integers(0, 5, b).astype(np.uint64)]) for a, b in rng.integers(0, 30, (6, 2))]
        words = wordhash.mix64(np.concatenate(pieces))
        rows = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        x, name, _ = recompress.signs(words, rows, 35)
        for r in range(2):  # all windows of all texts, by their words
            seen = {}
            for i, s in zip(x.tolist(), name.tolist()):
                assert seen.setdefault(words[i : i + 35].tobytes(), s) == s
        assert len(x) == sum(len(p) - 34 for p in pieces)
