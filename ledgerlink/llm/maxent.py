"""Hashed maximum-entropy language model with a class-factored softmax.

    P(word | history) = P(class | history) * P(unit | class, history) * P(word | unit)

The commonest words are *units* of their own, any other word belongs to the unit of its
ending, and units belong to classes: the ``singles`` commonest words are classes of their
own, the others are clustered by what stands beside them.  Both factors are
softmaxes over the same kinds of features, the unit before (n-gram), the unit before
that (skip): the logits of all classes add up rows of one hashed table, those of a class's units rows that the feature and the class pick from another, beside the
units' shares of the class.  Below a unit words share out by count, with half a count for each word and for
one unknown word, so every history has a proper distribution over the vocabulary
and an unknown word of each ending.

Training reads every training token once.  In each round a task runs mini-batch
gradient steps over its rows from the shared weights, and the tasks' changes are averaged by tokens (sums by
block of the weights, in two levels).  The number of units, classes, table rows and
cells grows with the counted tokens (see ``sizes_for``).

Counts of words are kept for the whole vocabulary, in a distributed table; a word of
over 64 bytes is kept as 128 bits of its digest.  Only the commonest words (at most
``HEAD``) are broadcast; counts of all others reach their documents by a join.  A word
outside the head has less than 1 / ``HEAD`` of the tokens or ties with one that has, so that
join has no hot key.

Defined cases: a null text counts as empty: one token, its end; with nothing to
learn from every token has probability 1; rows that repeat a doc_id are scored
each, and count as often; a null id is in fold 0, so it is learnt from; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import release, shuffle_partitions, stored, text_of

HEAD, HEAD_BYTES = 1 << 17, 64
NEIGHBOURS = 48
ROUNDS, BATCH, RATE = 2, 2048, 2.0
#: Tokens of the texts that are worked on at once.
RUN = 32 * BATCH
BLOCKS = 64
END = b""  # no word is empty


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, cut at ASCII white space, then the end.  A word of over
    ``HEAD_BYTES`` stands as its digest, after a byte that UTF-8 never has."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes both know ASCII only
    if max(map(len, words), default=0) > HEAD_BYTES:
        words = [w if len(w) <= HEAD_BYTES else b"\xff" + hashlib.sha256(w).digest()[:16] for w in words]
    words.append(END)
    return words


class Sizes(NamedTuple):
    """Of a model: units that are words, units of endings, single-word classes, most units
    of any other class, rows of the table of classes, rows of the table of units."""

    words: int
    endings: int
    singles: int
    most: int
    table: int
    unit_table: int

    @property
    def units(self) -> int:
        return self.words + self.endings


def sizes_for(tokens: int, distinct: int) -> Sizes:
    """Units grow with the fifth root of the training tokens (1,024 words or all at least), the
    units of a class with the root of that, table rows with the units."""
    words = int(max(64, min(distinct, 32_768, max(1024, 40 * max(tokens, 1) ** 0.2))))
    units = words + max(16, words // 4)
    rows = 1 << max(10, (8 * words).bit_length())
    return Sizes(words, units - words, min(24, words), 1 << max(5, (math.isqrt(2 * units)).bit_length()), rows, rows)


def ending_unit(word: bytes, sizes: Sizes) -> int:
    return sizes.words + zlib.crc32(word[-3:]) % sizes.endings


# -- counts -------------------------------------------------------------------

def word_counts(docs: DataFrame, learn: Column, flush: int = 300_000) -> DataFrame:
    """word, c over the rows that ``learn`` picks; tasks count before the exchange and
    hold at most about ``flush`` words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        seen: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > flush:
                    yield made()
        yield made()

    return docs.filter(learn).select(text_of().alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon(NamedTuple):
    """What every worker knows: the head's words, by falling count, and their counts."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def index(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words)), strict=True))


def lexicon(counts: DataFrame, head: int = HEAD) -> Lexicon:
    """The commonest words.  A histogram over count levels (32 an octave) finds the
    level from which on there are at most ``head`` words; only those are collected."""
    level = F.floor(F.log2("c") * 32)
    eligible = counts.withColumn("level", level)
    ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    bins = sorted(((r["level"], r["n"]) for r in eligible.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, head
    for value, n in bins:
        if n > room:
            break
        least, room = value, room - n
    rows = eligible.filter(F.col("level") >= least).select("word", "c").toPandas() if least is not None else None
    if rows is None or not len(rows):
        return Lexicon([], np.zeros(0, np.int64), ends["n"], ends["v"])
    rows["word"] = rows["word"].map(bytes)
    rows = rows.sort_values(["c", "word"], ascending=[False, True])
    return Lexicon(rows["word"].tolist(), rows["c"].to_numpy(np.int64), ends["n"], ends["v"])


# -- encoding -----------------------------------------------------------------

ENCODED = "doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, head_free_log double, units binary, tail array<binary>, tail_n array<int>"


def encode(docs: DataFrame, held_out: Column, lex, sizes: Sizes) -> DataFrame:
    """Each text as units (two bytes a token), the logs of its head words' counts (all,
    and those below the units), and its other words, each with its number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = lex.value
        at = known.index()
        logs = np.append(np.log10(known.counts + 0.5), 0.0)
        free = logs.copy()
        free[: min(sizes.words, len(known.words))] = 0.0  # units of their own: nothing to share out
        miss = len(known.words)
        own = np.arange(miss + 1)
        own[sizes.words : miss] = [ending_unit(w, sizes) for w in known.words[sizes.words :]]
        names = [x.split()[0] for x in ENCODED.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        for b in batches:
            rows = []
            for doc_id, held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = tokens(t.as_py())
                ids = np.fromiter(map(at.get, words, repeat(miss)), np.int64, len(words))
                units = own[ids]
                outside = np.flatnonzero(ids == miss)
                rare = [words[k] for k in outside.tolist()]
                tail = Counter(rare)
                if rare:
                    unit = {w: ending_unit(w, sizes) for w in tail}
                    units[outside] = list(map(unit.__getitem__, rare))
                rows.append((doc_id, held, len(words), len(words) - len(outside), float(logs[ids].sum()), float(free[ids].sum()),
                             units.astype("<u2").tobytes(), list(tail.keys()), list(tail.values())))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_of().alias("text")).mapInArrow(run, ENCODED)


def tail_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """row, tail_log, tail_known: what the words outside the head add to their documents."""
    words = encoded.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    found = words.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return found.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + F.lit(0.5))).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).cast("long").alias("tail_known"))


# -- units and classes --------------------------------------------------------

def neighbours(encoded: DataFrame, sizes: Sizes) -> np.ndarray:
    """How often each unit follows and precedes each of the commonest words, and how
    often it occurs: units x (2 x NEIGHBOURS + 1) counters, from every training token."""
    width = 2 * NEIGHBOURS + 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(sizes.units * width, np.int64)
        for _, _, units, starts in _texts(batches, 0):
            u = units.astype(np.int64)
            inner = np.ones(len(u), bool)
            inner[starts] = False
            z, a = u[inner], u[np.flatnonzero(inner) - 1]
            cells = np.concatenate([(z * width + a)[a < NEIGHBOURS], (a * width + NEIGHBOURS + z)[z < NEIGHBOURS], u * width + 2 * NEIGHBOURS])
            total += np.bincount(cells, minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["cell", "n"])

    got = encoded.filter("not held_out").select("units").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(sizes.units * width)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(sizes.units, width)


def cluster(table: np.ndarray, words: int, sizes: Sizes, seed: int = 1) -> np.ndarray:
    """Class of each unit.  The first ``singles`` are their own; the others are clustered
    (k-means on root shares of their neighbours, weighted by the root of their count),
    and clusters are cut into classes of at most ``most`` units."""
    out = np.full(sizes.units + 1, sizes.singles, np.int64)
    singles = min(sizes.singles, words)
    out[:singles] = np.arange(singles)
    rest = np.array([u for u in range(singles, sizes.units) if table[u, -1] > 0], np.int64)
    groups = _groups(table[rest], sizes, seed) if len(rest) else []
    label, left = sizes.singles, []
    for own in groups:  # whole classes first, then what is left of all clusters together
        mine = rest[own]
        whole = len(mine) // sizes.most * sizes.most
        for a in range(0, whole, sizes.most):
            out[mine[a : a + sizes.most]] = label
            label += 1
        left.extend(mine[whole:].tolist())
    left += [u for u in range(singles, sizes.units) if table[u, -1] == 0]
    for a in range(0, len(left), sizes.most):
        out[left[a : a + sizes.most]] = label + a // sizes.most
    return out


def _groups(counts: np.ndarray, sizes: Sizes, seed: int) -> list[np.ndarray]:
    """Rows of each cluster."""
    x = np.sqrt(counts[:, :-1] / counts[:, -1:])
    weight, r = np.sqrt(counts[:, -1]), np.random.default_rng(seed)

    def gaps(centres: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)

    centres = x[[int(np.argmax(weight))]]
    nearest = gaps(centres)[:, 0]
    while len(centres) < min(-(-sizes.units // sizes.most), len(counts)):
        gap = weight * nearest
        if gap.sum() < 1e-9:
            break
        centres = np.concatenate([centres, x[[r.choice(len(counts), p=gap / gap.sum())]]])
        nearest = np.minimum(nearest, gaps(centres[-1:])[:, 0])
    for _ in range(20):
        own = np.argmin(gaps(centres), axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = np.average(x[own == k], axis=0, weights=weight[own == k])
    return [np.flatnonzero(own == k) for k in range(len(centres))]


def unit_sizes(counts: DataFrame, lex, sizes: Sizes) -> np.ndarray:
    """Tokens and distinct words of each unit, over the whole vocabulary: 2 x units."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = {w: k for k, w in enumerate(lex.value.words[: sizes.words])}
        total = np.zeros((2, sizes.units), np.int64)
        for b in batches:
            for w, c in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                word = w.as_py()
                k = at[word] if word in at else ending_unit(word, sizes)
                total[0, k] += c
                total[1, k] += 1
        hit = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[0, hit], pa.int64()), pa.array(total[1, hit], pa.int64())], ["k", "n", "v"])

    out = np.zeros((2, sizes.units))
    for k, n, v in counts.select("word", "c").mapInArrow(run, "k int, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        out[:, k] = n, v
    return out


# -- the softmaxes ------------------------------------------------------------

class Model:
    """The two tables.  Row 0 of ``table`` starts as the classes' log shares of the tokens,
    ``share`` has each unit's log share of its class: without training these are
    what the softmaxes give."""

    def __init__(self, sizes: Sizes, classes: np.ndarray, counts: np.ndarray):
        self.sizes, self.classes = sizes, classes
        self.n = int(classes.max()) + 1
        total = np.bincount(classes[: sizes.units], weights=counts, minlength=self.n)
        self.table = np.zeros((sizes.table, self.n), np.float32)
        self.table[0] = np.log((total + 0.5) / (total.sum() + 0.5 * self.n))
        self.units = np.zeros((sizes.unit_table, sizes.most), np.float32)
        self.place = np.zeros(sizes.units + 1, np.int64)  # of a unit in its class
        self.share = np.full((self.n, sizes.most), -1e9, np.float32)
        self.several = np.zeros(self.n, bool)
        for k in range(self.n):
            members = np.flatnonzero(classes[: sizes.units] == k)
            self.place[members] = np.arange(len(members))
            self.several[k] = len(members) > 1
            if len(members):
                self.share[k, : len(members)] = np.log((counts[members] + 0.5) / (counts[members] + 0.5).sum())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.table.ravel(), self.units.ravel()])

    def load(self, flat: np.ndarray) -> Model:
        k = self.table.size
        self.table, self.units = flat[:k].reshape(self.table.shape).copy(), flat[k:].reshape(self.units.shape).copy()
        return self


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(24)


def history(units: np.ndarray, starts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; ``start`` stands before a text.
    ``starts`` are the texts' first tokens."""
    n = len(units)
    one, two = np.full(n, start, np.uint64), np.full(n, start, np.uint64)
    one[1:], two[2:] = units[:-1], units[:-2]
    one[starts] = start
    two[starts] = start
    two[starts[starts + 1 < n] + 1] = start
    return one, two


def feature_rows(one: np.ndarray, two: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the table of classes for each token: before, skip.  (Row 0 is the bias.)"""
    keys = np.stack([one * np.uint64(2), two * np.uint64(2) + np.uint64(1)])
    return (_mixed(keys) % np.uint64(rows - 1)).astype(np.int64) + 1


def unit_rows(one: np.ndarray, two: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the table of units for tokens of the classes ``y``: before, skip."""
    k = y.astype(np.uint64) << np.uint64(32)
    return (_mixed(np.stack([(k | one) * np.uint64(2), (k | two) * np.uint64(2) + np.uint64(1)])) % np.uint64(rows)).astype(np.int64)


def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    z += bias
    np.clip(z, -60, 60, out=z)  # no logit is that large; the padding's is less
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def _texts(batches: Iterator, column: int, size: int = RUN) -> Iterator:
    """Runs of whole texts of about ``size`` tokens: (batch rows, units, starts).  A text
    beyond that is a run of its own."""
    for b in batches:
        held, at, first = [], 0, 0
        lens = [len(raw.as_py()) // 2 for raw in b.column(column)]
        for k, n in enumerate(lens):
            held.append(n)
            at += n
            if at >= size or k == len(lens) - 1:
                units = np.concatenate([np.frombuffer(b.column(column)[j].as_py(), "<u2") for j in range(first, k + 1)])
                yield b, range(first, k + 1), units, np.concatenate([[0], np.cumsum(held)])[:-1].astype(np.int64)
                held, at, first = [], 0, k + 1


class Trainer:
    """Mini-batch gradient steps on a model, in place.  Sums of squared gradients set the
    rate of each table row (Adagrad)."""

    def __init__(self, model: Model):
        self.model = model
        self.slow, self.slow_units = (np.full(len(t), 1e-6, np.float32) for t in (model.table, model.units))

    def steps(self, units: np.ndarray, starts: np.ndarray, rate: float) -> None:
        m = self.model
        one, two = history(units, starts, m.sizes.units)
        rows, y = feature_rows(one, two, len(m.table)), m.classes[units]
        inner = np.flatnonzero(m.several[y])
        own, place, classes = unit_rows(one[inner], two[inner], y[inner], len(m.units)), m.place[units[inner]], y[inner]
        for a in range(0, len(y), BATCH):
            r, t = rows[:, a : a + BATCH], y[a : a + BATCH]
            g = _gradient(_softmax(m.table, r, m.table[0]), t)
            _descend(m.table, self.slow, np.zeros(1, np.int64), g.sum(axis=0, keepdims=True), rate)
            _scatter(m.table, self.slow, r, g, rate)
        for a in range(0, len(inner), BATCH):
            r, t = own[:, a : a + BATCH], place[a : a + BATCH]
            _scatter(m.units, self.slow_units, r, _gradient(_softmax(m.units, r, m.share[classes[a : a + BATCH]]), t), rate)


def _gradient(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    p[np.arange(len(t)), t] -= 1
    p *= np.float32(1 / len(t))
    return p


def _descend(table: np.ndarray, slow: np.ndarray, hit: np.ndarray, grads: np.ndarray, rate: float) -> None:
    slow[hit] += np.einsum("ij,ij->i", grads, grads)
    grads *= (-rate / (np.sqrt(slow[hit]) + 1e-8))[:, None]
    table[hit] += grads


def _scatter(table: np.ndarray, slow: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """A step for each feature's rows, with the sums of their tokens' gradients."""
    n, flat = table.shape[1], g.astype(np.float64).ravel()
    for f in rows.astype(np.uint16) if len(table) <= 1 << 16 else rows:  # 16 bits sort by radix
        order = f.argsort(kind="stable")
        ranked = f[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        to = np.empty(len(f), np.int64)
        to[order] = (np.cumsum(new) - 1) * n
        hit = ranked[new].astype(np.int64)
        sums = np.bincount((to[:, None] + np.arange(n)).ravel(), weights=flat, minlength=len(hit) * n)
        _descend(table, slow, hit, sums.reshape(len(hit), n).astype(np.float32), rate)


def train(encoded: DataFrame, model: Model, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """``model``, trained in place.  Round r reads the training rows of part r of ``rounds``."""
    sc = encoded.sparkSession.sparkContext
    weights = model.flat()
    size = -(-len(weights) // BLOCKS)
    for k in range(rounds):
        shared = sc.broadcast(model)

        def run(batches: Iterator, shared=shared, step=rate / (1 + k)) -> Iterator:
            import copy

            import pyarrow as pa
            from pyspark import TaskContext

            first = shared.value
            own, seen = copy.copy(first).load(first.flat()), 0
            trainer = Trainer(own)
            for _, _, units, starts in _texts(batches, 0):
                trainer.steps(units, starts, step)
                seen += len(units)
            if seen:
                change, part = own.flat() - first.flat(), TaskContext.get().partitionId()
                for block in range(BLOCKS):
                    c = change[block * size : (block + 1) * size]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([float(seen)]), pa.array([c.tobytes()], pa.binary())], ["block", "part", "tokens", "change"])

        def mean(group):
            import pandas as pd

            n = group["tokens"].sum()
            c = sum(t * np.frombuffer(raw, np.float32) for t, raw in zip(group["tokens"], group["change"], strict=True)) / n
            return pd.DataFrame({"block": [group["block"].iloc[0]], "part": [0], "tokens": [float(n)], "change": [c.astype(np.float32).tobytes()]})

        schema = "block int, part int, tokens double, change binary"
        share = encoded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)).select("units")
        changes = share.mapInArrow(run, schema)
        spread = max(1, int(shuffle_partitions(encoded.sparkSession) ** 0.5))
        changes = changes.withColumn("part", F.col("part") % spread).groupBy("block", "part").applyInPandas(mean, schema).groupBy("block").applyInPandas(mean, schema)
        for r in changes.select("block", "change").toLocalIterator():
            weights[r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["change"], np.float32)
        model.load(weights)
        shared.unpersist()
    return model


def unit_logs(model: Model, units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 probability of each token's unit, its class first, in sparse batches: two rows of
    either table a token."""
    one, two = history(units, starts, model.sizes.units)
    rows, y = feature_rows(one, two, len(model.table)), model.classes[units]
    out = np.empty(len(y))
    for a in range(0, len(y), BATCH):
        t = y[a : a + BATCH]
        out[a : a + BATCH] = np.log10(np.maximum(_softmax(model.table, rows[:, a : a + BATCH], model.table[0])[np.arange(len(t)), t], 1e-30))
    inner = np.flatnonzero(model.several[y])
    own = unit_rows(one[inner], two[inner], y[inner], len(model.units))
    for a in range(0, len(inner), BATCH):
        at = inner[a : a + BATCH]
        q = _softmax(model.units, own[:, a : a + BATCH], model.share[y[at]])
        out[at] += np.log10(np.maximum(q[np.arange(len(at)), model.place[units[at]]], 1e-30))
    return out


def score_units(encoded: DataFrame, model: Model, below: np.ndarray) -> DataFrame:
    """row, unit_log: the sum over a text's tokens of their units' logs less the log of
    what a unit's words share out (``below``)."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, below))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m, size = shared.value
        for b, rows, units, starts in _texts(batches, 1):
            each = unit_logs(m, units, starts) - size[units]
            yield pa.RecordBatch.from_arrays([b.column(0)[rows.start : rows.stop], pa.array(np.add.reduceat(each, starts))], ["row", "unit_log"])

    return encoded.select("row", "units").mapInArrow(run, "row long, unit_log double")


def fitted(docs: DataFrame, held_out: Column):
    """(encoded rows, counts, lexicon, trained model, what each unit's words share out as a log10)."""
    counts = stored(word_counts(docs, ~held_out), "words")
    lex = lexicon(counts)
    sizes = sizes_for(lex.total, lex.distinct)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    encoded = stored(encode(docs, held_out, shared, sizes).withColumn("row", F.monotonically_increasing_id()), "units")
    near = neighbours(encoded, sizes)
    classes = cluster(near, len(lex.words), sizes)
    per_unit = unit_sizes(counts, shared, sizes)
    below = np.where(np.arange(sizes.units) < min(sizes.words, len(lex.words)), 0.0, np.log10(per_unit[0] + 0.5 * (per_unit[1] + 1)))
    model = Model(sizes, classes, per_unit[0])
    return encoded, counts, lex, train(encoded, model) if lex.total else model, below


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every
    text; the model learns from rows where ``held_out`` is false.

    base_score is the unigram with half a count more for each word and one unknown word.
    """
    encoded, counts, lex, model, below = fitted(docs, F.coalesce(held_out, F.lit(False)))
    scored = score_units(encoded, model, below)
    flat = encoded.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "head_free_log")
    all_ = flat.join(scored, "row").join(tail_sums(encoded, counts), "row", "left").withColumns({"tail_log": F.coalesce("tail_log", F.lit(0.0)), "tail_known": F.coalesce("tail_known", F.lit(0))})
    base = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))
    learnt = F.col("head_free_log") + F.col("tail_log") + F.col("unit_log")
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (learnt if lex.total else F.lit(0.0)).alias("score"))
