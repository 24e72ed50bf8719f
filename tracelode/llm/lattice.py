"""Lattices of pieces over many short strings at once, and segmentations drawn from them without replacement.

A string's nodes are the positions between its characters; an edge is a vocabulary piece, or the bytes of a character that is no piece.
A segmentation weighs the product of its edges' weights. With the sums of weights of all ways on from each node, an edge
has a conditional probability, and a walk from the start by these probabilities draws a segmentation.

A document is a row of such strings, and its segmentation the row of theirs. Perturbed A-star search draws k distinct ones: the Gumbel-perturbed log
probability of a set of segmentations is its greatest member's. The root's is drawn; a walk follows the greatest member, and at each of its steps the other edges of the node
are one set whose perturbed value is drawn as a Gumbel cut off at the walk's. The next best segmentation lies in the set of the frontier with the greatest
value, which is then entered in the same way. All steps of all documents of a batch are array operations; only the k - 1 branch points are met one by one.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np

from .wordhash import mix64

SPACE = "▁"
#: Pieces of more than one U+2581 are runs of it and nothing else, so no piece crosses these borders.
_UNITS = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
_STEP = 0x9E3779B97F4A7C15
_TABLE, _SPREAD = 19, 0xD1342543DE82EF95


def uniform(key: np.ndarray, t: int) -> np.ndarray:
    """In (0, 1), by key and step."""
    return ((mix64(key + np.uint64((t + 1) * _STEP % (1 << 64))) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a SentencePiece model. A merge model's score is its rank, so a piece weighs 1 / (rank + 2) ** theta."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        states, words, ids, weights = {}, [-1], [], []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses a border of units: {piece!r}")
                at = 0
                for ch in piece:
                    key = at << 21 | ord(ch)
                    if key not in states:
                        states[key] = len(words)
                        words.append(-1)
                    at = states[key]
                words[at] = len(ids)
                ids.append(i)
                weights.append(-theta * math.log(2 - max(m.get_score(i), -n)))
        # Transitions (state, character) -> state in an open table.
        self.table, self.next = np.full(1 << _TABLE, -1, np.int64), np.zeros(1 << _TABLE, np.int64)
        for key, state in states.items():
            at = (key * _SPREAD % (1 << 64)) >> (64 - _TABLE)
            while self.table[at] >= 0:
                at = (at + 1) % (1 << _TABLE)
            self.table[at], self.next[at] = key, state
        self.word, self.ids, self.weights = np.array(words), np.array(ids), np.array(weights)
        self.fallback = -theta * math.log(n + 2)
        self.first = np.zeros(1 << 21, np.int32)
        for key, state in states.items():
            if key < 1 << 21:
                self.first[key] = state

    def step(self, key: np.ndarray) -> np.ndarray:
        """The states after these transitions, 0 where there is none."""
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - _TABLE)).astype(np.int64)
        there = self.table[at]
        out = np.where(there == key, self.next[at], 0)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % (1 << _TABLE)
            there = self.table[at[open_]]
            out[open_] = np.where(there == key[open_], self.next[at[open_]], 0)
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return out

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.bytes_of[i] for i in ids])
        return out.decode("utf-8", "replace").removeprefix(" ")


class Lattices:
    """Lattices of a list of strings. Edges stand in the order of their source node; `cum` is node + running probability."""

    def __init__(self, v: Vocabulary, strings: list[str]):
        code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(code))  # characters to the end of the string
        node = np.arange(len(code)) + np.repeat(np.arange(len(strings)), lengths)
        n_nodes = len(code) + len(strings)
        self.start = np.concatenate([[0], ends[:-1] + np.arange(1, len(strings))]) if strings else np.zeros(0, np.int64)
        at, state = np.arange(len(code)), v.first[code].astype(np.int64)
        found, step = [], 1
        lone = np.ones(len(code), bool)
        alive = state > 0
        at, state = at[alive], state[alive]
        while len(at):
            word = v.word[state]
            hit = word >= 0
            found.append((at[hit], np.full(int(hit.sum()), step), word[hit]))
            if step == 1:
                lone[at[hit]] = False
            more = left[at] > step
            at, state = at[more], state[more]
            state = v.step(state << 21 | code[at + step])
            hit = state > 0
            at, state = at[hit], state[hit]
            step += 1
        lone = np.flatnonzero(lone)
        found.append((lone, np.ones(len(lone), np.int64), -1 - code[lone]))
        # Edges by source, the longest first, which as a rule is the likeliest; each list is in order of its sources, so counting places them.
        counts = np.zeros(len(code) + 1, np.int64)
        for x, _, _ in found:
            counts[x + 1] += 1
        place = np.cumsum(counts)
        n_edges = int(place[-1])
        src, size, word = (np.empty(n_edges, np.int64) for _ in range(3))
        for x, length, w_ in reversed(found):
            k = place[x]
            src[k], size[k], word[k] = x, length, w_
            place[x] += 1
        utf8 = np.ones(len(word), np.int64)
        odd = np.flatnonzero(word < 0)
        points = -1 - word[odd]
        utf8[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        w = np.where(word >= 0, v.weights[np.maximum(word, 0)], v.fallback * utf8)
        self.ids = np.where(word >= 0, v.ids[np.maximum(word, 0)], word)
        single = odd[utf8[odd] == 1]
        self.ids[single] = v.byte_ids[-1 - word[single]]
        self.src, self.dst = node[src], node[src] + size
        # Sums of weights from each node on, nodes taken by their distance from the end.
        far = left[src]
        far = far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far
        by = np.argsort(far, kind="stable")
        z = np.zeros(n_nodes)
        bounds = np.searchsorted(far[by], np.arange(1, (int(far.max()) if len(far) else 0) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            e = by[a:b]
            s = self.src[e]
            value = w[e] + z[self.dst[e]]
            group = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(value, group)
            counts = np.diff(np.append(group, len(s)))
            z[s[group]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), group))
        self.by, self.bounds = by, bounds
        self.log_q = w + z[self.dst] - z[self.src]
        q = np.exp(self.log_q)
        self.q = q
        self.ptr = np.searchsorted(self.src, np.arange(n_nodes + 1))
        run = np.cumsum(q)
        base = np.where(self.ptr[self.src] > 0, run[np.maximum(self.ptr[self.src] - 1, 0)], 0.0)
        self.cum = self.src + np.minimum(run - base, 1.0)
        last = self.ptr[self.src + 1] - 1 == np.arange(len(self.src))
        self.cum[last] = self.src[last] + 1.0
        only = last & (self.ptr[self.src] == np.arange(len(self.src)))
        with np.errstate(divide="ignore"):
            self.log_rest = np.where(only, -np.inf, np.log(np.maximum(1 - q, 1e-15)))
        self.end = self.ptr[1:] == self.ptr[:-1]

    def likeliest(self) -> np.ndarray:
        """The first edge of the likeliest way on from each node; of ties the longest."""
        value, edge = np.zeros(len(self.end)), np.zeros(len(self.end), np.int64)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            if a < b:
                e = self.by[a:b]
                s, way = self.src[e], self.log_q[e] + value[self.dst[e]]
                group = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                top = np.maximum.reduceat(way, group)
                hits = np.flatnonzero(way == np.repeat(top, np.diff(np.append(group, len(s)))))[::-1]
                value[s[group]] = top
                edge[s[hits]] = e[hits]
        return edge

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to the end of its string: edges, one walk after the other, and the number of each."""
        who = np.flatnonzero(~self.end[nodes])
        at, steps = nodes[who], []
        while len(who):
            e, x = self.ptr[at], at + uniform(keys[who], len(steps))
            over = np.flatnonzero(self.cum[e] <= x)
            while len(over):
                e[over] += 1
                over = over[self.cum[e[over]] <= x[over]]
            steps.append((who, e))
            at = self.dst[e]
            going = ~self.end[at]
            who, at = who[going], at[going]
        counts = np.zeros(len(nodes), np.int64)
        for who, _ in steps:
            counts[who] += 1
        offsets = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for t, (who, e) in enumerate(steps):
            out[offsets[who] + t] = e
        return out, counts


def cut_gumbel(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel of location phi, given that it is at most `top`."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return np.where(phi == -np.inf, -np.inf, phi - np.log(np.exp(phi - top) - np.log(u)))


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 40.0))))


class Path:
    """One drawn segmentation of every document of a batch that has one more."""

    def __init__(self, lat: Lattices, edges, offsets, unit, top, keys, s, fresh_from):
        self.edges, self.offsets, self.unit, self.top = edges, offsets, unit, top
        counts = np.diff(offsets)
        run = np.concatenate([[0.0], np.cumsum(lat.log_q[edges])])
        self.log_p = run[offsets[1:]] - run[offsets[:-1]]
        self.before = run[:-1] - np.repeat(run[offsets[:-1]], counts)
        place = np.arange(len(edges)) - np.repeat(offsets[:-1], counts)
        u = uniform(np.repeat(keys, counts) ^ mix64(place.astype(np.uint64) + np.uint64(s << 40)), 7)
        self.frontier = cut_gumbel(self.before + lat.log_rest[edges], np.repeat(top, counts), u)
        self.frontier[place < np.repeat(fresh_from, counts)] = -np.inf

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Greatest frontier value of each document and its place, -inf without one."""
        n = len(self.offsets) - 1
        value, place = np.full(n, -np.inf), np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(self.offsets))
        if len(full):
            value[full] = np.maximum.reduceat(self.frontier, self.offsets[full])
            hits = np.flatnonzero(self.frontier == np.repeat(value, np.diff(self.offsets)))
            doc = np.searchsorted(self.offsets, hits, "right") - 1
            first = np.unique(doc, return_index=True)
            place[first[0]] = hits[first[1]] - self.offsets[first[0]]
        return value, place


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def best(v: Vocabulary, texts: list[str]) -> list[tuple[np.ndarray, float]]:
    """The likeliest segmentation of each text: ids and log probability."""
    number = _Numbers()
    rows = [list(map(number.__getitem__, _UNITS.findall(SPACE + t.replace(" ", SPACE)))) if t else [] for t in texts]
    lat = Lattices(v, list(number))
    edge, found = lat.likeliest(), []
    for node in lat.start.tolist():
        path = []
        while not lat.end[node]:
            path.append(int(edge[node]))
            node = int(lat.dst[path[-1]])
        found.append((lat.ids[path], float(lat.log_q[path].sum())))
    none = [np.zeros(0, np.int64)]
    return [(spelled(v, np.concatenate(none + [found[u][0] for u in r])).astype(np.int32), sum(found[u][1] for u in r)) for r in rows]


def sample(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct segmentations in drawn order: ids, log probability, log inclusion score.

    The score is the probability that the segmentation is among those above the next perturbed value, 1 - exp(-exp(log p - value)); it is 1 if there is no next.
    Of long texts it is tiny, hence its logarithm."""
    number = _Numbers()
    rows = [list(map(number.__getitem__, _UNITS.findall(SPACE + t.replace(" ", SPACE)))) if t else [] for t in texts]
    lat = Lattices(v, list(number))
    n = len(texts)
    counts = np.array([len(r) for r in rows], np.int64)
    unit_off = np.concatenate([[0], np.cumsum(counts)])
    types = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(counts.sum()))
    starts = lat.start[types]
    index = np.arange(len(types)) - np.repeat(unit_off[:-1], counts)

    def unit_keys(s):
        return mix64(np.repeat(keys, counts) + np.uint64(s)) ^ mix64(index.astype(np.uint64) * np.uint64(_STEP))

    edges, steps = lat.walk(starts, unit_keys(0))
    sizes = np.add.reduceat(np.append(steps, 0), np.minimum(unit_off[:-1], len(steps))) * (counts > 0) if n else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    top = -np.log(-np.log(uniform(keys, 1)))
    paths = [Path(lat, edges, offsets, np.repeat(index, steps), top, keys, 0, np.zeros(n, np.int64))]
    taken: dict[tuple[int, int, int], list[int]] = {}
    for s in range(1, k + 1):
        bests = [p.best() for p in paths]
        values = np.stack([b[0] for b in bests]) if n else np.zeros((1, 0))
        which, nxt = values.argmax(0), values.max(0) if n else np.zeros(0)
        if s == k:
            break
        todo = np.flatnonzero(nxt > -np.inf)
        heads, walk_nodes, walk_keys, later = {}, [], [], unit_keys(s)
        draws = uniform(keys, 100 + s)
        for d in todo.tolist():
            p, i = paths[which[d]], int(bests[which[d]][1][d])
            at = int(p.offsets[d]) + i
            used = taken.setdefault((int(which[d]), d, i), [int(p.edges[at])])
            node = lat.src[p.edges[at]]
            choice = [e for e in range(lat.ptr[node], lat.ptr[node + 1]) if e not in used]
            run = np.cumsum(lat.q[choice])
            e = choice[min(int(np.searchsorted(run, draws[d] * run[-1], "right")), len(choice) - 1)]
            used.append(e)
            rest = [x for x in choice if x != e]
            phi = p.before[at] + math.log(max(lat.q[rest].sum(), 1e-300)) if rest else -np.inf
            p.frontier[at] = cut_gumbel(np.array([phi]), nxt[d : d + 1], uniform(keys[d : d + 1], 200 + s))[0]
            unit = int(p.unit[at])
            heads[d] = (p, at, e, unit)
            a, b = unit_off[d] + unit + 1, unit_off[d + 1]
            walk_nodes += [lat.dst[e : e + 1], starts[a:b]]
            walk_keys.append(later[a - 1 : b])
        edges, steps = lat.walk(np.concatenate(walk_nodes), np.concatenate(walk_keys)) if walk_nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        out_edges, out_units, fresh, sizes, used_steps, used_edges = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
        for d in todo.tolist():
            p, at, e, unit = heads[d]
            own = steps[used_steps : used_steps + counts[d] - unit]
            total = int(own.sum())
            a = int(p.offsets[d])
            out_edges += [p.edges[a:at], np.array([e]), edges[used_edges : used_edges + total]]
            out_units += [p.unit[a : at + 1], np.repeat(np.arange(unit, counts[d]), own)]
            fresh[d], sizes[d] = at - a + 1, at - a + 1 + total
            used_steps, used_edges = used_steps + len(own), used_edges + total
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        paths.append(Path(lat, join(out_edges), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), join(out_units), nxt, keys, s, fresh))
    out = []
    for d in range(n):
        got = []
        for s, p in enumerate(paths):
            a, b = p.offsets[d], p.offsets[d + 1]
            if s and p.top[d] == -np.inf:
                continue
            score = 0.0 if nxt[d] == -np.inf else log_inclusion(float(p.log_p[d] - nxt[d]))
            got.append((spelled(v, lat.ids[p.edges[a:b]]).astype(np.int32), float(p.log_p[d]), score))
        out.append(got)
    return out


def spelled(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Puts the byte ids of characters that are no piece, noted as -1 - code point, in their places."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    parts, last = [], 0
    for i in odd.tolist():
        parts += [ids[last:i], v.byte_ids[np.frombuffer(chr(-1 - int(ids[i])).encode("utf-8", "replace"), np.uint8)]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]])
