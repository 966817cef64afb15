"""Sorted keys as a tree of their characters: which keys have enough characters in common,
in order, with each of many vendor keys.

Equal beginnings are walked once.  A step adds a character to the longest common
subsequence (LCS) of a vendor and a beginning (the bit-parallel recurrence of
``similarity``), for all vendors and nodes of a depth at once.  To have ``need`` characters in common, a vendor may
leave out n - need of its characters and a key m - need: a node that has left out more,
against every beginning of the vendor, is not walked any further.
"""

from __future__ import annotations

import numpy as np

from ledgerlink.functions.similarity import LONG_LEN_RATIO, LONG_PARTIAL_SCALE, PARTIAL_MIN_LEN_RATIO, PARTIAL_SCALE, _lcs_of, _step

#: Characters of a key in a tree; a longer key is its first ones, and bounded by the number of the others.
DEEP = 96
#: (vendor, node) pairs walked at once, and 64-bit words of the vendors' masks.
FRONTIER, MASK_WORDS = 100_000, 2_000_000
_SLACK = 1e-6


def needed_common(n: np.ndarray, m: int, score: np.ndarray) -> np.ndarray:
    """Least LCS with which keys of lengths n and m can reach a positive score (the inverse of ``wratio_bound``)."""
    short, long = np.minimum(n, m), np.maximum(n, m)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = long / short
        scale = 200.0 * np.where(q < PARTIAL_MIN_LEN_RATIO, 0.0, np.where(q <= LONG_LEN_RATIO, PARTIAL_SCALE, LONG_PARTIAL_SCALE))
        window = np.where(scale > score, score * short / (scale - score), np.inf)
    return np.maximum(np.ceil(np.minimum(score * (n + m) / 200.0, window) - _SLACK), 1).astype(np.int64)


class Patterns:
    """Vendor keys of at most 64 x ``words`` characters each."""

    def __init__(self, keys: list[str], words: int):
        self.words, self.n = words, np.array([len(k) for k in keys], dtype=np.int64)
        self.points = np.full((len(keys), int(self.n.max())), 0xFFFFFFFF, dtype=np.uint32)
        self.points[np.arange(self.points.shape[1])[None] < self.n[:, None]] = np.frombuffer("".join(keys).encode("utf-32-le"), dtype=np.uint32)
        left = np.clip(self.n[:, None] - 64 * np.arange(words)[None], 0, 64)
        self.full = np.where(left == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))

    def masks(self, some: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """vendors x (1 + letters) x words: the places of each letter of an alphabet."""
        out = np.zeros((len(some), 1 + len(alphabet), self.words), dtype=np.uint64)
        if len(alphabet):
            points = self.points[some]
            letter = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
            found = alphabet[letter] == points
            for j in range(points.shape[1]):
                row = np.flatnonzero(found[:, j])
                out[row, 1 + letter[row, j], j >> 6] |= np.uint64(1) << np.uint64(j & 63)
        return out


def _kept(v: np.ndarray, spare: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Greatest LCS with a beginning of the vendor that leaves out at most ``spare`` of its characters."""
    ones = np.bitwise_count(v).astype(np.int64)
    upto = np.cumsum(ones, axis=1) if v.shape[1] > 1 else ones
    out = n - upto[:, -1]
    more = np.flatnonzero(upto[:, -1] > spare)
    if len(more):
        s = spare[more]
        if v.shape[1] > 1:
            word = (upto[more] <= s[:, None]).sum(axis=1)
            x, r = v[more, word], s - upto[more, word] + ones[more, word]
        else:
            word, x, r = 0, v[more, 0], s
        for k in range(int(r.max())):
            x = np.where(r > k, x & (x - np.uint64(1)), x)
        out[more] = 64 * word + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) - s  # up to the first character too many
    return out


def forks(strings: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The letters used, the strings as numbers of letters from 1 (0: ended), and the place
    where each differs from the one before (the first: -1)."""
    lens = np.array([len(s) for s in strings], dtype=np.int64)
    width = int(lens.max()) + 1
    alphabet, letter = np.unique(np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    text = np.zeros((len(strings), width), dtype=np.int32)
    text[np.arange(width)[None] < lens[:, None]] = letter.reshape(-1) + 1
    differ = text[1:] != text[:-1]
    return (alphabet, text), np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])


class Tree:
    """``strings``, ascending: keys of ``length`` characters, or beginnings of such keys."""

    def __init__(self, strings: list[str], length: int):
        (self.alphabet, text), fork = forks(strings)
        self.length, self.size, width = length, len(strings), text.shape[1]
        self.starts = [np.flatnonzero(fork < t) for t in range(width + 1)]  # of a depth's nodes, their first strings
        self.children = [np.searchsorted(b, np.append(a, self.size)) for a, b in zip(self.starts, self.starts[1:])]
        self.letters = [text[s, t] for t, s in enumerate(self.starts[1:])]

    def walk(self, vendors: Patterns, need: np.ndarray, visits: np.ndarray, most: int):
        """(vendor, string, upper bound of the LCS, exact for a whole key) of all that can have
        ``need`` in common; ``visits`` counts nodes, and a vendor beyond ``most`` is dropped."""
        spare, skip = vendors.n - need, self.length - need
        who = np.flatnonzero((spare >= 0) & (skip >= 0) & (visits <= most))
        step = max(1, MASK_WORDS // ((1 + len(self.alphabet)) * vendors.words))
        for some in (who[at : at + step] for at in range(0, len(who), step)):
            masks, todo = vendors.masks(some, self.alphabet), [(0, some, np.arange(len(some)), np.zeros(len(some), dtype=np.int64), vendors.full[some])]
            while todo:
                depth, row, mask, node, v = todo.pop()
                first = self.children[depth][node]
                size = self.children[depth][node + 1] - first
                if size.sum() > FRONTIER and len(row) > 1:
                    half = len(row) // 2
                    todo += [(depth, *(x[part] for x in (row, mask, node, v))) for part in (slice(None, half), slice(half, None))]
                    continue
                back = np.repeat(np.arange(len(row)), size)
                child = np.arange(len(back)) + np.repeat(first - np.cumsum(size) + size, size)
                letter = self.letters[depth][child]
                ended = np.flatnonzero(letter == 0)
                if len(ended):
                    starts = np.append(self.starts[depth + 1], self.size)
                    lo, at = starts[child[ended]], back[ended]
                    number = starts[child[ended] + 1] - lo
                    common = _lcs_of(v[at], vendors.n[row[at]]) + self.length - depth
                    yield np.repeat(row[at], number), np.arange(number.sum()) + np.repeat(lo - np.cumsum(number) + number, number), np.repeat(common, number)
                    back, child, letter = (x[letter > 0] for x in (back, child, letter))
                row, mask = row[back], mask[back]
                v, pm, full = v[back], masks[mask, letter], vendors.full[row]
                if vendors.words > 1:
                    v = _step(v, pm, full)
                else:
                    u = v & pm
                    v = ((v + u) | (v & ~u)) & full
                visits += np.bincount(row, minlength=len(visits))
                good = np.flatnonzero((_kept(v, spare[row], vendors.n[row]) > depth - skip[row]) & (visits[row] <= most))
                if len(good):
                    todo.append((depth + 1, row[good], mask[good], child[good], v[good]))


def grow(keys: list[str], length: np.ndarray) -> list[tuple[Tree, np.ndarray]]:
    """A tree for each length, with the places in ``keys`` of its strings (``length``: of the
    keys of which these are the beginnings)."""
    short = [k[:DEEP] for k in keys]
    out = []
    for m in np.unique(length):
        at = sorted(np.flatnonzero(length == m).tolist(), key=short.__getitem__)
        out.append((Tree([short[k] for k in at], int(m)), np.array(at, dtype=np.int64)))
    return out


def near(trees: list[tuple[Tree, np.ndarray]], vendors: list[str], least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vendor, place, upper bound of the LCS, length of the key) of all pairs that can score
    ``least``, and marks of the vendors left out because they would visit more than ``most`` nodes."""
    n = np.array([len(v) for v in vendors], dtype=np.int64)
    left, found = ~(least > 0), [(np.zeros(0, np.int64),) * 4]
    words = np.where(n > 64, 1 << np.ceil(np.log2(np.maximum(-(-n // 64), 1))).astype(np.int64), 1)
    for w in np.unique(words):
        rows = np.flatnonzero((words == w) & ~left & (n > 0))
        if not len(rows):
            continue
        mine, visits = Patterns([vendors[r] for r in rows], int(w)), np.zeros(len(rows), dtype=np.int64)
        for tree, at in trees:
            for row, string, common in tree.walk(mine, needed_common(mine.n, tree.length, least[rows]), visits, most):
                found.append((rows[row], at[string], common, np.full(len(row), tree.length)))
        left[rows] = visits > most
    vendor, place, common, m = (np.concatenate(x) for x in zip(*found))
    good = ~left[vendor]
    return vendor[good], place[good], np.minimum(common[good], np.minimum(n[vendor[good]], m[good])), m[good], left
