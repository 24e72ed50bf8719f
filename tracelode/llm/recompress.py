"""Recompression of word sequences: symbols that name runs and pairs, alike wherever the words are alike.

The words of a text are symbols of one word each. A run round names every maximal run of one symbol by (symbol, length); a pair round deals all symbols to a left and a
right side by a hash of their names and names every left symbol with the right symbol that follows it. Names are hashes of what they stand for, so they are
global without an exchange, and a symbol depends on its neighbours only.

Of a window of words some symbols are certain: they come out alike wherever the window stands, whatever surrounds it. A run round takes the first and the last
run from them, which may go on outside; a pair round takes a first symbol of the right side and a last symbol of the left side, which may be paired outside.
As this is read off the window alone, equal windows have equal certain symbols at equal places. A window's sign is one of its certain symbols of
the last round that leaves it any: the one of least hash. Equal windows have equal signs, and neighbouring windows mostly share theirs.
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix64

RUN, PAIR = "run", "pair"
#: A pair round shortens a sequence by a quarter or so; after these a symbol stands for six words in the mean.
ROUNDS = (RUN, PAIR, PAIR, PAIR, PAIR, PAIR, PAIR)
_LEFT, _RIGHT, _TIMES = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Symbols:
    """Names of all symbols, where each starts (in words), and which start a text."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, first: np.ndarray, words: int):
        self.names, self.first, self.words = names, first, words
        self.bounds = np.append(starts, words)
        self.index = np.full(words + 1, -1, np.int64)
        self.index[self.bounds] = np.arange(len(self.bounds))

    def grouped(self, opens: np.ndarray, names: np.ndarray) -> Symbols:
        return Symbols(names, self.bounds[:-1][opens], self.first[opens], self.words)


def of_round(names: np.ndarray, k: int) -> np.ndarray:
    return mix64(names + np.uint64(0x8EBC6AF09C88C6E3 * (k + 1) % (1 << 64)))


def sides(names: np.ndarray, k: int) -> np.ndarray:
    """True for the right side."""
    return (of_round(names, k) & np.uint64(1)).astype(bool)


def run_round(s: Symbols, lo: np.ndarray, hi: np.ndarray) -> tuple[Symbols, np.ndarray, np.ndarray]:
    opens = np.ones(len(s.names), bool)
    opens[1:] = (s.names[1:] != s.names[:-1]) | s.first[1:]
    heads = np.flatnonzero(opens)
    length = np.diff(np.append(heads, len(s.names)))
    names = s.names[heads]
    names = np.where(length > 1, mix64(names * _TIMES + length.astype(np.uint64)), names)
    new = s.grouped(opens, names)
    of = np.cumsum(opens) - 1
    return new, new.bounds[of[s.index[lo]] + 1], new.bounds[of[s.index[hi] - 1]]


def pair_round(s: Symbols, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    right = sides(s.names, k)
    joins = np.zeros(len(s.names), bool)  # to the symbol before
    joins[1:] = right[1:] & ~right[:-1] & ~s.first[1:]
    opens = ~joins
    names = s.names[opens]
    paired = joins[np.minimum(np.flatnonzero(opens) + 1, len(joins) - 1)] & (np.flatnonzero(opens) + 1 < len(joins))
    names = np.where(paired, mix64(mix64(names * _LEFT) + np.append(s.names[1:], s.names[:1])[opens] * _RIGHT), names)
    a, b = s.index[lo], s.index[hi] - 1
    return s.grouped(opens, names), np.where(right[a], s.bounds[a + 1], lo), np.where(right[b], hi, s.bounds[b])


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the least of values[a:b] for each a, b; of equal ones the first."""
    out, size = np.zeros(len(a), np.int64), (b - a)
    table, width = np.arange(len(values)), 1
    while True:
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        x, y = table[a[now]], table[b[now] - width]
        out[now] = np.where(values[x] <= values[y], x, y)
        if not (size >= 2 * width).any():
            return out
        x, y = table[: len(table) - width], table[width:]
        table, width = np.where(values[x] <= values[y], x, y), 2 * width


def signs(words: np.ndarray, rows: np.ndarray, size: int, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, sign's name, sign's place) of every window of `size` words that lies in one text. The place tells signs of a text apart; it is negative for windows inside a run of one word.

    words: hashes of all words; rows: n + 1 offsets of the texts into them."""
    lengths = np.diff(rows)
    room = np.maximum(lengths - size + 1, 0)
    x = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(int(room.sum()))
    name, place = np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64)
    first = np.zeros(len(words), bool)
    first[rows[:-1][lengths > 0]] = True
    s = Symbols(words, np.arange(len(words)), first, len(words))
    at, lo, hi = np.arange(len(x)), x, x + size
    for k, kind in enumerate((*rounds, None)):
        if not len(at):
            break
        if kind is None:
            over = np.ones(len(at), bool)
        else:
            new, lo2, hi2 = run_round(s, lo, hi) if kind == RUN else pair_round(s, lo, hi, k)
            over = lo2 >= hi2
        if over.any():
            a, b = s.index[lo[over]], s.index[hi[over]]
            best = least(mix64(s.names), a, b)
            name[at[over]] = of_round(s.names[best], k)
            place[at[over]] = s.bounds[best] * (len(rounds) + 1) + k
            if k == 0 and kind == RUN:
                # Windows of one word alone: they share the place of their run.
                alone = over & (lo2 >= hi)
                place[at[alone]] = -1 - new.bounds[np.searchsorted(new.bounds, lo[alone], "right") - 1]
        if kind is not None:
            s, at, lo, hi = new, at[~over], lo2[~over], hi2[~over]
    return x, name, place
