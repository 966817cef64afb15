"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself, its prefixes and its ending;
filters of widths 1 to 3 run over the words of the whole text, their rectified
responses are max-pooled, and a logistic layer gives the score.  Since a
filter's response is a sum of per-word terms, a scoring worker computes the
terms of each distinct word once.

The classifier is fitted on at most ``max_docs`` labelled rows (half of them
toxic, where there are as many; weights undo that), in the order of a hash of
the id.  A fifth of these are kept back to stop the training.  The threshold of each
language comes from histograms over every labelled training row: rows outside the
sample have the classifier's score, and each fifth of the sample the score of a classifier
fitted on the other four.  Labels, language, source and id never enter a
score; the language only picks the threshold of ``flagged``.

Defined cases: a null text counts as empty and has a score too; labels that are
null or of unknown documents have no effect, of several for one document the greatest
counts; without any usable label every score is the prior 0.5 / (1 + 1) = 0.25;
rows that repeat a doc_id are scored each, and of those in the sample one counts for
thresholds; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.common import fold, per_worker, release, stored, text_of
from ledgerlink.session import cut_lineage

BUCKETS = 1 << 18
DIMS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7, 8)
#: Folds of the sample, and bins of scores for thresholds.
FOLDS, BINS = 5, 10_000
#: Rows of a fold: its scores, and fold 0's model (8 MB) in parts, since arrays of many MB make a driver's heap grow.
FITTED, PART_BYTES = "doc_id array<long>, lang array<string>, toxic array<int>, score array<double>, at int, model binary", 1 << 18


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features(word: str) -> list[int]:
    """Buckets of a word: itself without outer punctuation, its prefixes, its ending."""
    w = word.strip(string.punctuation) or word
    parts = [f"w {w}", f"e {w[-4:]}", *[f"p {w[:k]}" for k in PREFIXES if len(w) >= k]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Vocabulary:
    """Rows for words; row 0 is padding without a feature.  Features lie end to end."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def ids(self, words: list[str]) -> list[int]:
        rows, out = self.rows, []
        for w in words:
            k = rows.get(w)
            if k is None:
                k = rows[w] = len(self.ends)
                self.flat.extend(features(w))
                self.ends.append(len(self.flat))
            out.append(k)
        return out

    def features_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of these rows, end to end, and how many each has."""
        rows, ends = rows.astype(np.int64), np.frombuffer(self.ends, np.int64)
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        first = np.where(rows > 0, ends[np.maximum(rows - 1, 0)], 0)
        counts = ends[rows] - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        return flat[at], counts


def vectors(table: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word vectors: sums of their features' embeddings, scaled by the root of their number."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
        out[full] = np.add.reduceat(table[flat], starts) / np.sqrt(counts[full])[:, None].astype(np.float32)
    return out


def scores_of(model: Model, vocab: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """Scores of texts given as rows; only the words of a block of texts are expanded at once."""
    out = []
    for a in range(0, len(docs), 64):
        block = docs[a : a + 64]
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *block]))
        terms = model.terms(vectors(model.table, *vocab.features_of(used)))
        out += [model.score(terms, np.searchsorted(used, d)) for d in block]
    return np.array(out)


class Model:
    """Embeddings, filters (width -> width x dims x filters), filter biases, output layer."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((BUCKETS, DIMS)) * 0.01).astype(np.float32)
        self.filters = {k: (r.standard_normal((k, DIMS, FILTERS)) * 0.1).astype(np.float32) for k in WIDTHS}
        self.shift = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.bias = np.zeros(1, np.float32)
        for k in WIDTHS:  # dimension 0 starts as the evidence of a feature (see ``fit``)
            self.filters[k][:, 0, :] += 0.5 / k

    def terms(self, v: np.ndarray) -> np.ndarray:
        """A word's term for every filter and place in it."""
        return np.concatenate([v @ self.filters[k][j] for k in WIDTHS for j in range(k)], axis=1)

    def score(self, terms: np.ndarray, ids: np.ndarray) -> float:
        """Score of a text whose words have these rows in ``terms`` (row 0 is padding)."""
        n = max(len(ids), 1)
        got = terms[np.concatenate([ids, np.zeros(max(WIDTHS), np.int64)])]
        pooled, at = [], 0
        for k in WIDTHS:
            r = got[:n, at : at + FILTERS]
            for j in range(1, k):
                r = r + got[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            pooled.append(r.max(axis=0) + self.shift[k])
            at += k * FILTERS
        z = float(np.maximum(np.concatenate(pooled), 0) @ self.out + self.bias[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def copy(self) -> Model:
        new = object.__new__(Model)
        new.table, new.out, new.bias = self.table.copy(), self.out.copy(), self.bias.copy()
        new.filters = {k: v.copy() for k, v in self.filters.items()}
        new.shift = {k: v.copy() for k, v in self.shift.items()}
        return new


def _evidence(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Shrunken log-odds of each bucket's presence in toxic against clean texts."""
    seen = np.zeros((2, BUCKETS))
    for d, label, w in zip(docs, y, weight, strict=True):
        buckets = np.unique(vocab.features_of(np.unique(d))[0])
        seen[int(label), buckets] += w
    a, b = seen[1], seen[0]
    na, nb = max(weight[y == 1].sum(), 1e-9), max(weight[y == 0].sum(), 1e-9)
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    return (odds * (a + b) / (a + b + 4)).astype(np.float32)


def fit(docs: list[np.ndarray], vocab: Vocabulary, y: np.ndarray, weight: np.ndarray, kept_back: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, seed: int = 1) -> Model:
    """Train by mini-batches (Adagrad); the state with the least loss on the rows
    kept back is returned."""
    model = Model(seed)
    y, weight = np.asarray(y, np.float64), np.asarray(weight, np.float64)
    train, check = np.flatnonzero(~kept_back), np.flatnonzero(kept_back)
    share = (weight[train] * y[train]).sum() + 0.5, (weight[train] * (1 - y[train])).sum() + 0.5
    model.table[:, 0] = _evidence([docs[i] for i in train], y[train], weight[train], vocab) if len(train) else 0
    model.bias[0] = np.log(share[0] / share[1]) - 1
    slow = {k: np.zeros_like(v) for k, v in (("table", model.table), ("out", model.out), ("bias", model.bias), *((("f", k), model.filters[k]) for k in WIDTHS), *((("s", k), model.shift[k]) for k in WIDTHS))}

    def step(key, param: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        slow[key][rows] += grad * grad
        param[rows] -= (rate * grad / (np.sqrt(slow[key][rows]) + 1e-6)).astype(np.float32)

    r, best, patience = np.random.default_rng(seed), None, 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            if at == 0:
                order = r.permutation(train)
            rows = order[at : at + batch]
            _train(model, [docs[i] for i in rows], y[rows], weight[rows], vocab, step)
        judged = check if len(check) else train
        s = scores_of(model, vocab, [docs[i] for i in judged])
        loss = float(-(weight[judged] * np.where(y[judged] == 1, np.log(s + 1e-9), np.log(1 - s + 1e-9))).sum())
        if best is None or loss < best[0]:
            best, patience = (loss, model.copy()), 0
        elif (patience := patience + 1) >= 3:
            break
    return best[1] if best else model


def _train(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, vocab: Vocabulary, step) -> None:
    pad = np.zeros(max(WIDTHS), np.int64)
    flat = np.concatenate([np.concatenate([d, pad]) for d in docs])
    used, flat = np.unique(flat, return_inverse=True)
    own, sizes = vocab.features_of(used)
    v = vectors(model.table, own, sizes)
    lens = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(lens + len(pad))])[:-1]
    spans = np.stack([starts, starts + lens], axis=1).ravel()
    n = len(flat) - len(pad) + 1
    peaks, pooled = [], []
    for k in WIDTHS:
        resp = sum((v @ model.filters[k][j])[flat[j : n + j]] for j in range(k)) + model.shift[k]
        top = np.maximum.reduceat(resp, spans)[::2]
        place = np.empty((len(docs), FILTERS), np.int64)
        for d, (a, m) in enumerate(zip(starts, lens, strict=True)):
            place[d] = a + resp[a : a + m].argmax(axis=0)
        peaks.append(place)
        pooled.append(top)
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias[0], -30, 30)))
    err = (weight * (p - y) / max(weight.sum(), 1e-9)).astype(np.float32)
    gh = err[:, None] * model.out[None, :] * (h > 0)
    gv = np.zeros_like(v)
    for i, k in enumerate(WIDTHS):
        g, place = gh[:, i * FILTERS : (i + 1) * FILTERS], peaks[i]
        grad = np.zeros_like(model.filters[k])
        for j in range(k):
            at = flat[place + j]  # docs x filters
            grad[j] = np.einsum("dfe,df->ef", v[at], g)
            np.add.at(gv, at.ravel(), (g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIMS))
        step(("f", k), model.filters[k], grad)
        step(("s", k), model.shift[k], g.sum(axis=0))
    step("out", model.out, h.T @ err)
    step("bias", model.bias, err.sum(keepdims=True))
    each = np.repeat(gv / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32), sizes, axis=0)
    hit = np.flatnonzero(each.any(axis=1))
    if len(hit):
        rows, back = np.unique(own[hit], return_inverse=True)
        grad = np.zeros((len(rows), DIMS), np.float32)
        np.add.at(grad, back, each[hit])
        step("table", model.table, grad, rows)


def best_cut(bins: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The cut with the best F0.5 (clean documents count more than missed toxic ones), from
    how many rows, and toxic ones, each bin of scores has."""
    order = np.argsort(-bins)
    bins, hits, taken = bins[order], np.cumsum(toxic[order]), np.cumsum(n[order])
    k = int(np.argmax(1.25 * hits / (taken + 0.25 * max(hits[-1], 1e-9))))
    low = bins[k + 1] + 1 if k + 1 < len(bins) else 0
    return float(np.clip((bins[k] + low) / 2 / BINS, 0.2, 0.8))


def thresholds(scored: DataFrame, marked: DataFrame, fitted, least: int = 20) -> dict:
    """A threshold for each language with at least ``least`` toxic rows, and the one over
    all rows (key None), from every labelled training row.

    ``scored``: doc_id, lang, score of all rows; ``marked``: ``_id`` and toxic of the training
    labels.  Rows of the sample count with the scores in ``fitted`` (doc_id, lang,
    toxic, score), by models that weren't fitted on them.  One row a language, and at most
    ``BINS`` + 1 bins, reach the driver.
    """
    spark, bin_ = scored.sparkSession, F.floor(F.col("score") * BINS).cast("int")
    own = spark.createDataFrame(fitted, "doc_id long, lang string, toxic int, score double")
    others = scored.join(marked, scored["doc_id"] == marked["_id"]).join(F.broadcast(own.select(F.col("doc_id").alias("_own"))), F.col("doc_id") == F.col("_own"), "left_anti")
    rows = others.select("lang", "toxic", "score").unionByName(own.select("lang", "toxic", "score"))
    hist = cut_lineage(rows.groupBy("lang", bin_.alias("bin")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")))
    every = hist.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toPandas()

    def cut(group):
        import pandas as pd

        enough = group["toxic"].sum() >= least
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "cut": [best_cut(*(group[c].to_numpy() for c in ("bin", "toxic", "n"))) if enough else -1.0]})

    out = {None: best_cut(*(every[c].to_numpy() for c in ("bin", "toxic", "n"))) if every["toxic"].sum() >= least else 0.5}
    for r in hist.filter("lang is not null").groupBy("lang").applyInPandas(cut, "lang string, cut double").filter("cut >= 0").collect():
        out[r["lang"]] = r["cut"]
    return out


def usable_labels(labels: DataFrame, train: F.Column) -> DataFrame:
    """``_id`` and toxic (0 or 1), a row an id, of the ids that satisfy ``train``."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and _id is not null")
    return marked.groupBy("_id").agg(F.max("toxic").alias("toxic")).filter(train)


def sample(docs: DataFrame, labels: DataFrame, train: F.Column, max_docs: int) -> DataFrame:
    """The labelled rows to fit on: doc_id, text, lang, toxic, part (fold), n (rows of that label)."""
    usable = usable_labels(labels, train)
    # ids first: only the chosen rows' texts move.  Half the sample for each label, the rest to the other
    have = docs.select("doc_id").distinct()
    usable = usable.join(have, usable["_id"] == have["doc_id"], "left_semi")
    key = F.xxhash64("_id")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = max_docs // 2
    quota = {t: max(half, max_docs - counts.get(1 - t, 0)) for t in (0, 1)}
    bins = 1 << 12  # equal shares of the hash range: enough of them to hold the quota and not much more
    share = F.pmod(F.shiftright(key, 20), F.lit(bins))
    wide = {t: min(bins, int(np.ceil(bins * (quota[t] * 1.2 + 50) / max(counts.get(t, 1), 1)))) for t in (0, 1)}
    near = usable.filter(share < F.when(F.col("toxic") == 1, wide[1]).otherwise(wide[0]))
    first = [near.filter(F.col("toxic") == t).orderBy(key, "_id").limit(quota[t]).select("_id", "toxic") for t in (0, 1)]
    chosen = first[0].unionByName(first[1])  # at most max_docs ids: what is broadcast below is bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one"))  # of rows that repeat an id, one
    part = F.crc32(F.concat(F.lit("v"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS
    n = F.when(F.col("toxic") == 1, F.lit(counts.get(1, 0))).otherwise(F.lit(counts.get(0, 0))).cast("long")
    return one.select("doc_id", "one.text", "one.lang", "toxic", part.alias("part"), n.alias("n"))


def fit_sample(docs: DataFrame, labels: DataFrame, train: F.Column, max_docs: int):
    """The model, and the sample's rows (doc_id, lang, toxic, score), each scored by a
    model fitted on the other folds; None and no rows without a usable label.

    A task a fold has the whole sample, whose size is bounded; its texts don't reach the
    driver.  The model itself is the one with fold 0 kept back; it comes in rows of ``PART_BYTES``."""
    rows = sample(docs, labels, train, max_docs)
    fold_of = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))
    got = rows.withColumn("fold", fold_of).groupBy("fold").applyInPandas(_fit_fold, FITTED).collect()
    model = b"".join(r["model"] for r in sorted((r for r in got if r["model"] is not None), key=lambda r: r["at"]))
    rows = [x for r in got for x in zip(r["doc_id"], r["lang"], r["toxic"], r["score"], strict=True)]
    return (pickle.loads(model) if model else None), sorted(rows, key=lambda x: x[0])


def _fit_fold(key, rows):
    """A model fitted on the other folds scores this one; fold 0's model comes with it, in parts."""
    import pandas as pd

    release()
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    y, part, back = rows["toxic"].to_numpy(np.float64), rows["part"].to_numpy(np.int64), rows["part"].to_numpy() == key[0]
    weight = rows["n"].to_numpy(np.float64) / np.where(y == 1, max((y == 1).sum(), 1), max((y == 0).sum(), 1))
    weight /= weight.mean()
    vocab = Vocabulary()
    texts = [np.array(vocab.ids(words_of(t)) or [0], np.int32) for t in rows.pop("text")]
    vocab.rows.clear()  # the words themselves aren't needed any more
    fitted = fit(texts, vocab, y, weight, part == key[0]) if back.any() or not key[0] else None
    scores = scores_of(fitted, vocab, [texts[i] for i in np.flatnonzero(back)]) if back.any() else np.zeros(0)
    own = rows[back]
    lang = [x if isinstance(x, str) else None for x in own["lang"]]
    model = b"" if key[0] else pickle.dumps(fitted)
    parts = [model[a : a + PART_BYTES] for a in range(0, len(model), PART_BYTES)]
    scored = (own["doc_id"].tolist(), lang, own["toxic"].tolist(), scores.tolist(), -1, None)
    return pd.DataFrame([scored, *(([], [], [], [], k, part) for k, part in enumerate(parts))], columns=["doc_id", "lang", "toxic", "score", "at", "model"])


def train_model(docs: DataFrame, labels: DataFrame, train: F.Column, max_docs: int = 6000) -> tuple[Model | None, dict]:
    """Model and thresholds from labelled rows whose id (``_id``) satisfies ``train``."""
    model, fitted = fit_sample(docs, labels, train, max_docs)
    return model, thresholds(score(docs, model), usable_labels(labels, train), fitted) if model else {None: 0.5}


class Scorer:
    """Scores texts; the terms of the last ``limit`` distinct words are remembered."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.terms = np.zeros((4096, FILTERS * sum(WIDTHS)), np.float32)
        self.used = 1

    def score(self, text: str) -> float:
        words = words_of(text)
        ids = list(map(self.rows.get, words))
        if None in ids:
            new = list(dict.fromkeys([w for w, i in zip(words, ids, strict=True) if i is None]))
            if self.used > 1 and self.used + len(new) > self.limit:
                self.reset()
                return self.score(text)
            need = self.used + len(new)
            if need > len(self.terms):
                self.terms = np.concatenate([self.terms, np.zeros((max(need - len(self.terms), len(self.terms)), self.terms.shape[1]), np.float32)])
            feats = [features(w) for w in new]
            flat = np.fromiter((b for f in feats for b in f), np.int64)
            self.terms[self.used : need] = self.model.terms(vectors(self.model.table, flat, np.array([len(f) for f in feats])))
            self.rows.update(zip(new, range(self.used, need), strict=True))
            self.used = need
            ids = list(map(self.rows.__getitem__, words))
        return self.model.score(self.terms, np.array(ids, np.int64))


def _scorer(shared, name: str) -> Scorer | None:
    """One scorer a worker process and model."""
    return None if shared.value is None else per_worker(("scorer", name), lambda: Scorer(shared.value))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, score.  A narrow pass; the model (8 MB, whatever the data) is broadcast."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = _scorer(shared, name)
        for b in batches:
            scores = [scorer.score(t.as_py()) if scorer else 0.25 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")


#: Column of a row's score in ``accepted``.
SCORE = "_ledgerlink_toxicity"


def scored_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, and ``SCORE``; a narrow pass."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    text = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = _scorer(shared, name)
        for b in batches:
            scores = [scorer.score(t.as_py() or "") for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, SCORE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def threshold_of(cuts: dict, lang: F.Column) -> F.Column:
    """The threshold of a row's language, or the one over all."""
    names = [x for x in cuts if x is not None]
    if not names:
        return F.lit(cuts[None])
    named = F.map_from_arrays(F.lit(names).cast("array<string>"), F.lit([cuts[x] for x in names]).cast("array<double>"))
    return F.coalesce(F.try_element_at(named, lang), F.lit(cuts[None]))


def accepted(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, max_docs: int = 6000) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't flagged.  Each row is scored once:
    the scores are stored beside it, thresholds and choice read them there."""
    train = fold("_id") != 0 if train is None else train
    model, fitted = fit_sample(docs, labels, train, max_docs)
    if model is None:
        return docs
    rows = stored(scored_rows(docs, model), "toxicity")
    lang = F.col("lang").cast("string")
    cuts = thresholds(rows.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col(SCORE).alias("score")), usable_labels(labels, train), fitted)
    return rows.filter(F.col(SCORE) < threshold_of(cuts, lang)).drop(SCORE)


def toxicity(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, max_docs: int = 6000) -> DataFrame:
    """Train on the labels of rows whose id satisfies ``train`` (an expression over
    ``_id``; default: crc32 of the id, modulo 5, isn't 0) and score all of ``docs``."""
    train = fold("_id") != 0 if train is None else train
    model, fitted = fit_sample(docs, labels, train, max_docs)
    scored = stored(score(docs, model), "scores")  # thresholds and result read the same scores
    cuts = thresholds(scored, usable_labels(labels, train), fitted) if model else {None: 0.5}
    return scored.select("doc_id", "score", threshold_of(cuts, F.col("lang")).alias("threshold")).withColumn("flagged", F.col("score") >= F.col("threshold"))
