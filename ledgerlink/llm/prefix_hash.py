"""Document fingerprints from prefix polynomial hashes.

For code points c_0, c_1, ... and base B the prefix array is
H[i] = sum over j < i of c_j * B^j (mod 2^31 - 1), for two bases.  Any span
then hashes in O(1) as (H[r] - H[l]) / B^l, two spans are equal when their
hashes are, and the longest common extension of two places is found by binary
search over span lengths.

A fingerprint is the hash and length of the whole text and a bottom-k sketch of
its window spans; likeness is the share of windows that two texts have in
common (Dice), estimated from their sketches, and 1 for equal texts.

Defined cases: a null text counts as empty, and two empty texts are alike (1);
a text shorter than a window is one window; rows that repeat a doc_id are
ordered by their text; null ids come first; the only document of a table is
its own next; an empty table gives no rows; other columns are ignored.
Memory per task follows the longest text (about 100 bytes a character).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import range_buckets, release, shuffle_partitions, text_of

P = (1 << 31) - 1
BASES = (1_000_003_193, 1_644_587_321)
WINDOW = 16
SKETCH = 64
_P, _31 = np.uint64(P), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return x - _P * (x >= _P)


class _Powers:
    """Powers of a base (or of its inverse) modulo P, grown by doubling."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            k = len(self.table)
            self.table = np.concatenate([self.table, _mod(self.table * np.uint64(pow(self.base, k, P)))])
        return self.table[:n]


_POWERS = [_Powers(b) for b in BASES]
_INVERSE = [_Powers(pow(b, -1, P)) for b in BASES]


def _mixed(pairs: np.ndarray) -> np.ndarray:
    """48 well-mixed bits of a span's two hashes."""
    h = pairs
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(33))) >> np.uint64(16)


def _bottom(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values."""
    if len(values) > 4 * k:
        few = np.unique(np.partition(values, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(values)[:k]


class PrefixHash:
    """Prefix arrays of a text."""

    def __init__(self, text: str, window: int = WINDOW, sketch: int = SKETCH):
        self.text, self.window, self.k = text, window, sketch
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = n = len(codes)
        self.prefix = []
        for powers in _POWERS:
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(_mod(codes * powers.upto(n)), out=h[1:])
            self.prefix.append(_mod(h))
        self.marks = self._marks()

    def _marks(self) -> np.ndarray:
        """Mixed hashes of all windows."""
        if not self.n:
            return np.zeros(0, np.uint64)
        w = min(self.window, self.n)
        return _mixed(self._spans(w, 0, self.n - w + 1))

    def _spans(self, w: int, first: int, last: int) -> np.ndarray:
        """Both hashes, as one number, of the spans of length w that begin at first .. last - 1."""
        out = []
        for h, inverse in zip(self.prefix, _INVERSE, strict=True):
            out.append(_mod(_mod(h[first + w : last + w] + (_P - h[first:last])) * inverse.upto(last)[first:]))
        return out[0] | (out[1] << _31)

    def span(self, left: int, right: int) -> tuple[int, int]:
        """Hash of text[left:right], alike wherever the span stands."""
        return tuple((int(h[right]) - int(h[left])) * int(inv.upto(left + 1)[left]) % P for h, inv in zip(self.prefix, _INVERSE, strict=True))

    def equal(self, left: int, right: int, other: PrefixHash, at: int) -> bool:
        return at + right - left <= other.n and self.span(left, right) == other.span(at, at + right - left)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of text[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, i + mid, other, j):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> tuple[int, int]:
        return tuple(int(h[self.n]) for h in self.prefix)

    def sketch(self) -> np.ndarray:
        return _bottom(self.marks, self.k)

    def spliced(self, keep: int, other: PrefixHash, take: int) -> tuple[tuple[int, int], int, np.ndarray]:
        """Hash, length and sketch of text[:keep] + other[:take], from both prefix
        arrays; only the windows across the seam are hashed anew."""
        n, w = keep + take, self.window
        whole = tuple((int(a[keep]) + int(b[take]) * pow(base, keep, P)) % P for a, b, base in zip(self.prefix, other.prefix, BASES, strict=True))
        if n < 2 * w or keep < w or take < w:
            marks = PrefixHash(self.text[:keep] + other.text[:take], w, self.k).marks
        else:
            seam = PrefixHash(self.text[keep - w + 1 : keep] + other.text[: w - 1], w, self.k).marks
            marks = np.concatenate([self.marks[: keep - w + 1], seam, other.marks[: take - w + 1]])
        return whole, n, _bottom(marks, self.k)


def fingerprint(whole: tuple[int, int], n: int, sketch: np.ndarray) -> str:
    """16 hex digits for the whole text, 10 for its length, 12 for each sketched window."""
    return f"{whole[0] | whole[1] << 31:016x}{n:010x}" + "".join([f"{v:012x}" for v in sketch.tolist()])


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> float:
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 0.0
    j = float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum()) / len(union)
    return 2 * j / (1 + j)


def likeness(a: str, b: str, sketch: int = SKETCH) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    return _shared(*(np.array([int(x[i : i + 12], 16) for i in range(26, len(x), 12)], np.uint64) for x in (a, b)), sketch)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "edited_prefix long, next_prefix long")


def fingerprints(docs: DataFrame, window: int = WINDOW, sketch: int = SKETCH, buckets: int | None = None) -> DataFrame:
    """Every text against its edited form and against the next document by doc_id.

    edited_prefix and next_prefix are longest common prefixes, by binary search.
    Texts are exchanged once, into equal-depth ranges of doc_id.  The first
    document of a range also goes to the range before (the first of all to the
    last range); it is known beforehand, because the bounds are ids of
    documents, so a task streams its sorted range and finds every neighbour there.
    """
    buckets = buckets or shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    bounds, bucket = range_buckets(docs, "doc_id", buckets)
    ends = docs.agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    first = F.col("doc_id").isNull() if ends["nulls"] else F.col("doc_id") == F.lit(ends["least"])
    last = len(bounds)
    to = [F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))]
    to.append(F.when(first, F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("extra"))))
    if bounds:
        to.append(F.when(F.col("doc_id").isin(bounds), F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("extra"))))
    dealt = docs.withColumn("to", F.explode(F.array_compact(F.array(*to)))).select("to.bucket", "to.extra", "doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        release()
        held = None  # the bucket and the document that waits for its next one

        def row(doc_id, a: PrefixHash, b: PrefixHash) -> tuple:
            cut = a.n // 2
            keep, take = a.n - cut, min(cut, b.n)
            edited = a.spliced(keep, b, take)
            mine, own, theirs = a.sketch(), (a.whole(), a.n), (b.whole(), b.n)
            near = [1.0 if own == whole else _shared(mine, s, sketch) for whole, s in ((edited[:2], edited[2]), (theirs, b.sketch()))]
            text = a.text[:keep] + b.text[:take]
            common = keep + min(a.extension(keep, b, 0), take)
            return (doc_id, a.n, hashlib.sha256(text.encode()).hexdigest(), fingerprint(*own, mine), fingerprint(*edited), *near, common, a.extension(0, b, 0))

        for batch in batches:
            rows = []
            for at, extra, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if extra and (held is None or held[0] != at):
                    continue
                now = PrefixHash(text.as_py(), window, sketch)
                if held is not None and held[0] == at:
                    rows.append(row(held[1], held[2], now))
                held = None if extra else (at, doc_id, now)
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    placed = dealt.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", "doc_id", "text")
    return placed.mapInArrow(run, SCHEMA)
