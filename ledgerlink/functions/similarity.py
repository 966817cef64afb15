"""String and vector similarity.

``wratio`` reproduces the weighted-ratio string score (0..100) for strings that
hold no white space (match keys never do).  For such strings it reduces to::

    ratio(a, b)   = 100 * (1 - (|a| + |b| - 2 * LCS(a, b)) / (|a| + |b|))
    partial(s, l) = max ratio(s, w) over windows w of the longer string l, n = |s|:
                    prefixes of length < n, every window of length n,
                    suffixes of length < n
    q = max(|a|, |b|) / min(|a|, |b|)
    wratio = 0 if a or b is empty
           = ratio                      if q < 1.5
           = max(ratio, c * partial)    otherwise, c = 0.9 if q <= 8 else 0.6

LCS uses the bit-parallel recurrence.  ``wratio_batch`` does the work; the plain
functions above it state the definition for single pairs and serve the tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# --- fixed values: scaling constants of the weighted ratio -----------------
PARTIAL_SCALE = 0.9
LONG_PARTIAL_SCALE = 0.6
PARTIAL_MIN_LEN_RATIO = 1.5
LONG_LEN_RATIO = 8.0
# ---------------------------------------------------------------------------


def _pattern_masks(s: str) -> dict:
    masks: dict = {}
    for i, ch in enumerate(s):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _lcs(masks: dict, n: int, t: str) -> int:
    """Length of the LCS of the pattern (given by its masks, length n) and t."""
    if n == 0 or not t:
        return 0
    full = (1 << n) - 1
    v = full
    for ch in t:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - bin(v).count("1")


def lcs_length(a: str, b: str) -> int:
    return _lcs(_pattern_masks(a), len(a), b)


def _ratio_from_lcs(lcs: int, lensum: int) -> float:
    if lensum == 0:
        return 100.0
    return (1.0 - (lensum - 2 * lcs) / lensum) * 100.0


def ratio(a: str, b: str) -> float:
    return _ratio_from_lcs(lcs_length(a, b), len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of the longer one.

    Windows ending (prefixes, full windows) or starting (suffixes) with a
    character absent from the shorter string are skipped: such a window never
    beats the neighbouring window without that character, so the maximum is
    unchanged.
    """
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(s), len(l)
    if n == 0:
        return 0.0
    masks = _pattern_masks(s)
    best = 0.0
    for i in range(1, n):  # prefixes shorter than n
        if l[i - 1] in masks:
            best = max(best, _ratio_from_lcs(_lcs(masks, n, l[:i]), n + i))
    for i in range(0, m - n + 1):  # full windows
        if l[i + n - 1] in masks:
            best = max(best, _ratio_from_lcs(_lcs(masks, n, l[i : i + n]), 2 * n))
            if best == 100.0:
                return best
    for i in range(m - n + 1, m):  # suffixes shorter than n
        if l[i] in masks:
            best = max(best, _ratio_from_lcs(_lcs(masks, n, l[i:]), n + m - i))
    return best


def wratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    la, lb = len(a), len(b)
    q = max(la, lb) / min(la, lb)
    s, l = (a, b) if la <= lb else (b, a)
    masks = _pattern_masks(s)
    full_lcs = _lcs(masks, len(s), l)
    r = _ratio_from_lcs(full_lcs, la + lb)
    if q < PARTIAL_MIN_LEN_RATIO:
        return r
    scale = PARTIAL_SCALE if q <= LONG_LEN_RATIO else LONG_PARTIAL_SCALE
    # Any window's LCS is at most the full LCS L, so partial <= 200 L / (n + L).
    n = len(s)
    if full_lcs == 0 or scale * (200.0 * full_lcs / (n + full_lcs)) <= r:
        return r
    return max(r, partial_ratio(s, l) * scale)


#: Positions of longer strings (times 64-bit words of the shorter ones) worked on at once.
BATCH_CELLS = 2_000_000


def _ratio_arr(lcs: np.ndarray, lensum: np.ndarray) -> np.ndarray:
    return (1.0 - (lensum - 2 * lcs) / lensum) * 100.0


def _code_points(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)


def _step(v: np.ndarray, pm: np.ndarray, full: np.ndarray) -> np.ndarray:
    """One character of the LCS recurrence for many pairs; patterns are rows of 64-bit words."""
    u = v & pm
    total = np.empty_like(v)
    carry = np.zeros(len(v), dtype=np.uint64)
    for w in range(v.shape[1]):
        t = v[:, w] + u[:, w]
        over = t < v[:, w]
        t2 = t + carry
        carry = (over | (t2 < t)).astype(np.uint64)
        total[:, w] = t2
    return (total | (v & ~u)) & full


def _lcs_of(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return n - np.bitwise_count(v).sum(axis=1, dtype=np.int64)


def _wratio_class(short: list[str], long: list[str], words: int) -> np.ndarray:
    """WRatio of non-empty pairs whose shorter strings have at most 64 x ``words``
    characters.  Longer strings lie end to end, so none is padded to another's length."""
    n = np.array([len(x) for x in short], dtype=np.int64)
    m = np.array([len(x) for x in long], dtype=np.int64)
    order = np.argsort(-m, kind="stable")  # longest first: the pairs still being read are a prefix
    back = np.argsort(order, kind="stable")
    n, m = n[order], m[order]
    off = np.concatenate([[0], np.cumsum(m)])[:-1]
    pair = np.repeat(np.arange(len(m)), m)
    text = np.concatenate([_code_points(long[k]) for k in order])
    width = int(n.max())
    pattern = np.full((len(n), width), 0xFFFFFFFF, dtype=np.uint32)
    for r, k in enumerate(order):
        pattern[r, : n[r]] = _code_points(short[k])
    pm = np.zeros((len(text), words), dtype=np.uint64)  # bit j of pm[t]: pattern[j] == text[t]
    for j in range(width):
        pm[:, j >> 6] |= (pattern[pair, j] == text).astype(np.uint64) << np.uint64(j & 63)
    left = np.clip(n[:, None] - 64 * np.arange(words)[None], 0, 64)
    full = np.where(left == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
    v = full.copy()
    live = len(m)
    for t in range(int(m[0])):
        while m[live - 1] <= t:
            live -= 1
        v[:live] = _step(v[:live], pm[off[:live] + t], full[:live])
    lcs = _lcs_of(v, n)
    r = _ratio_arr(lcs, n + m)
    q = m / n
    same = (n == m) & (lcs == n)
    need = np.flatnonzero((q >= PARTIAL_MIN_LEN_RATIO) & ~same & (lcs > 0))
    if len(need):
        r[need] = np.maximum(r[need], _partial(pm, full, n, m, off, need) * np.where(q[need] <= LONG_LEN_RATIO, PARTIAL_SCALE, LONG_PARTIAL_SCALE))
    r[same] = 100.0
    return r[back]


def _partial(pm: np.ndarray, full: np.ndarray, n: np.ndarray, m: np.ndarray, off: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Best window ratio of each needed pair.  Every start in a longer string is a row, and
    all rows read one character a step: from the first start come the prefixes, from
    others a full window or a suffix."""
    lens = m[need]
    row = np.repeat(need, lens)
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    st = np.arange(len(row)) - np.repeat(starts, lens)
    at, nn, rest = off[row] + st, n[row], m[row] - st
    best, v = np.zeros(len(row)), full[row]
    for k in range(int(n[need].max())):
        act = np.flatnonzero((k < nn) & (k < rest))
        if not len(act):
            break
        v[act] = _step(v[act], pm[at[act] + k], full[row[act]])
        ends = act[(k == nn[act] - 1) | (k == rest[act] - 1) | (st[act] == 0)]
        best[ends] = np.maximum(best[ends], _ratio_arr(_lcs_of(v[ends], nn[ends]), nn[ends] + k + 1))
    return np.maximum.reduceat(best, starts)


def wratio_batch(a, b) -> np.ndarray:
    """WRatio of many pairs at once (same values as ``wratio``; null gives nan).

    Pairs are grouped by the words their shorter string needs and worked on in
    slices of bounded size, so a long string costs its own length only.
    """
    a, b = list(a), list(b)
    out = np.full(len(a), np.nan)
    classes: dict[int, list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b)):
        if isinstance(x, str) and isinstance(y, str):
            if x == y:
                out[k] = 100.0 if x else 0.0
            elif not x or not y:
                out[k] = 0.0
            else:
                classes.setdefault(1 << (max(0, -(-min(len(x), len(y)) // 64) - 1)).bit_length(), []).append(k)
    for words, rows in classes.items():
        rows.sort(key=lambda k: max(len(a[k]), len(b[k])))
        at = 0
        while at < len(rows):
            end, cells = at, 0
            while end < len(rows) and (end == at or cells + words * max(len(a[rows[end]]), len(b[rows[end]])) <= BATCH_CELLS):
                cells += words * max(len(a[rows[end]]), len(b[rows[end]]))
                end += 1
            part = rows[at:end]
            short = [a[k] if len(a[k]) <= len(b[k]) else b[k] for k in part]
            long = [b[k] if len(a[k]) <= len(b[k]) else a[k] for k in part]
            out[part] = _wratio_class(short, long, words)
            at = end
    return out


def wratio_bound(common: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Upper bound of WRatio from the number of characters that two strings have in common
    (with multiplicity): the LCS of strings or windows is no longer than that."""
    n, m = np.minimum(la, lb), np.maximum(la, lb)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = 200.0 * common / (n + m)
        window = 200.0 * common / (n + common)
        q = m / n
        scale = np.where(q < PARTIAL_MIN_LEN_RATIO, 0.0, np.where(q <= LONG_LEN_RATIO, PARTIAL_SCALE, LONG_PARTIAL_SCALE))
        bound = np.maximum(whole, scale * window)
    return np.where((n == 0) | (common == 0), 0.0, bound)


@pandas_udf(T.DoubleType())
def wratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(wratio_batch(a, b), dtype="float64")


def wratio_col(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return wratio_udf(a, b)


# --------------------------------------------------------------------------
# Native (JVM) form of the indel ratio, used as an independent cross-check in
# tests: LCS by the classic DP row with nested aggregate().  Too slow for the
# hot path (arrays rebuilt per cell), exact for short strings.
def native_lcs(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    ca = F.regexp_extract_all(a, F.lit("(?s)."), 0)
    cb = F.regexp_extract_all(b, F.lit("(?s)."), 0)
    n = F.size(ca)
    init = F.array_repeat(F.lit(0), n + 1)

    def step_row(prev, ch):
        # new[0] = 0; new[j] = prev[j-1] + 1 if a[j-1] == ch else max(prev[j], new[j-1])
        def cell(acc, j):
            val = F.when(
                F.element_at(ca, j) == ch, F.element_at(prev, j) + 1
            ).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(val))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(F.lit(0)), cell)

    last = F.aggregate(cb, init, step_row)
    return F.when(n == 0, F.lit(0)).otherwise(F.element_at(last, -1))
