"""Text encoders: text column -> L2-normalised ``array<double>`` column.

The default encoder hashes character 1..3-grams of the raw text into ``dim``
buckets with a rule both Spark and plain SQL can evaluate:

    bucket(gram) = (sum over its code points c_j of c_j * 31^(len-1-j)) mod dim

It runs as an Arrow-batched pandas UDF (one call per batch of distinct texts);
``ngram_vector`` is the same rule as pure column expressions, kept as a
cross-check (its nested higher-order functions are interpreted and slow).
``FittedEncoder`` learns from a master's texts: inverse document frequencies of the
buckets, and the directions that these texts span, from a Gram matrix added up in
tasks.  What a text has beside the master (a mistyped character, a branch's
name) lies outside these directions, so a misspelt name comes close to its own
again.  A precomputed vector column can be used instead (``PrecomputedEncoder``), and a
user model can be plugged in as any object with the same ``encode`` method
(e.g. a pandas UDF that loads the model once per executor and encodes a batch).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def ngram_array(text: str | None, dim: int = 128, n_max: int = 3) -> np.ndarray:
    """The hashed n-gram vector of one text (L2-normalised; zeros for empty text)."""
    t = text or ""
    v = np.zeros(dim, dtype=np.float64)
    for n in range(1, n_max + 1):
        for i in range(len(t) - n + 1):
            h = 0
            for ch in t[i : i + n]:
                h = h * 31 + ord(ch)
            v[h % dim] += 1.0
    norm = math.sqrt(float(np.dot(v, v)))
    return v / norm if norm > 0 else v


def ngram_counts(texts: list[str | None], dim: int, n_max: int = 3) -> np.ndarray:
    """Hashed n-gram counts, a row a text, for a batch at once."""
    texts = [t or "" for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out, h = np.zeros(len(texts) * dim), np.zeros(len(code), np.int64)
    for n in range(1, n_max + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * 31 + code[n - 1 :]
        inside = row[: len(h)] == row[n - 1 :]
        out += np.bincount((row[: len(h)] * dim + h % dim)[inside], minlength=len(out))
    return out.reshape(len(texts), dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


#: Texts whose dense counts are held at once.
_BATCH = 2048


def _ngram_udf(dim: int, n_max: int):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(texts: pd.Series) -> pd.Series:
        parts = [_unit(ngram_counts(list(texts[a : a + _BATCH]), dim, n_max)) for a in range(0, len(texts), _BATCH)]
        return pd.Series([v for p in parts for v in p], dtype=object)

    return enc


def _grams(t: Column, n: int) -> Column:
    length = F.char_length(t)
    return F.when(
        length >= n, F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(t, i, n))
    ).otherwise(F.array().cast("array<string>"))


def _bucket(g: Column, dim: int) -> Column:
    codes = F.transform(F.regexp_extract_all(g, F.lit("(?s)."), 0), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc * 31 + x), F.lit(dim))


def normalize(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def ngram_vector(text: Column, dim: int = 128, n_max: int = 3) -> Column:
    t = F.coalesce(text, F.lit(""))
    grams = F.flatten(F.array(*[_grams(t, n) for n in range(1, n_max + 1)]))
    buckets = F.transform(grams, lambda g: _bucket(g, dim))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"),
    )
    return normalize(counts)


class HashedNgramEncoder:
    def __init__(self, dim: int = 128, n_max: int = 3):
        self.dim = dim
        self.n_max = n_max

    def encode(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        return df.withColumn(out_col, _ngram_udf(self.dim, self.n_max)(F.col(text_col)))

    def encode_native(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        return df.withColumn(out_col, ngram_vector(F.col(text_col), self.dim, self.n_max))


class PrecomputedEncoder:
    """Uses an existing vector column (e.g. from a model run elsewhere), L2-normalised."""

    def __init__(self, vec_col: str):
        self.vec_col = vec_col

    def encode(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        return df.withColumn(out_col, normalize(F.col(self.vec_col).cast("array<double>")))


def bucket_weights(texts: DataFrame, text_col: str, dim: int, n_max: int = 3) -> DataFrame:
    """(bucket, texts, weight): in how many texts a bucket occurs, and its inverse document
    frequency ln((1 + N) / (1 + texts)) + 1.  Buckets of no text are absent."""
    grams = F.flatten(F.array(*[_grams(F.coalesce(F.col(text_col), F.lit("")), n) for n in range(1, n_max + 1)]))
    rows = texts.select(F.explode(F.array_distinct(F.transform(grams, lambda g: _bucket(g, dim)))).alias("bucket"))
    n = texts.agg(F.count(F.lit(1))).first()[0]
    weight = F.log(F.lit(1.0 + n) / (1.0 + F.col("texts"))) + 1.0
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).withColumn("weight", weight)


def gram_matrix(texts: DataFrame, text_col: str, weights: np.ndarray, n_max: int = 3) -> np.ndarray:
    """Sum of the outer products of the texts' weighted unit vectors.  Tasks add up
    their texts; a row of the matrix is then summed over the tasks."""
    dim = len(weights)
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for a in range(0, len(b), _BATCH):
                x = _unit(ngram_counts(b[text_col].iloc[a : a + _BATCH].tolist(), dim, n_max) * shared.value)
                total += x.T @ x
        hit = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"i": hit, "row": [total[i].tobytes() for i in hit]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "row": [sum(np.frombuffer(r) for r in group["row"]).tobytes()]})

    rows = texts.select(text_col).mapInPandas(run, "i long, row binary").groupBy("i").applyInPandas(add, "i long, row binary")
    out = np.zeros((dim, dim))
    for r in rows.toLocalIterator():  # at most ``dim`` rows
        out[r["i"]] = np.frombuffer(r["row"])
    return out


class FittedEncoder:
    """Hashed n-grams, weighted and projected as a master's texts have it.

    ``fit`` reads all texts, twice; what it keeps (``dim`` weights and a ``dim`` x ``rank``
    projection) has a size of its own.  A text of whose n-grams the master knows less than
    the share ``min_known`` gets the zero vector: what little it has in common would
    fill its whole direction.
    """

    def __init__(self, weights: np.ndarray, projection: np.ndarray | None, n_max: int = 3, min_known: float = 0.5):
        self.weights, self.projection, self.n_max, self.min_known = weights, projection, n_max, min_known

    @classmethod
    def fit(cls, master: DataFrame, alias: DataFrame, dim: int = 1024, rank: int | None = 64, n_max: int = 3, min_known: float = 0.5) -> FittedEncoder:
        """``rank``: directions kept at most; None keeps the weighted buckets as they are."""
        from ledgerlink.operators.lookup import build_vector_index

        texts = build_vector_index(master, alias).select("text")
        weights = np.zeros(dim)
        for r in bucket_weights(texts, "text", dim, n_max).collect():  # at most ``dim`` rows
            weights[r["bucket"]] = r["weight"]
        if rank is None:
            return cls(weights, None, n_max, min_known)
        value, vector = np.linalg.eigh(gram_matrix(texts, "text", weights, n_max))
        keep = [k for k in np.argsort(-value)[:rank] if value[k] > 1e-9 * max(value.max(), 1e-300)]
        return cls(weights, np.ascontiguousarray(vector[:, keep]), n_max, min_known)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        counts = ngram_counts(texts, len(self.weights), self.n_max)
        unknown = counts[:, self.weights > 0].sum(axis=1) < self.min_known * counts.sum(axis=1)
        x = counts * self.weights
        x[unknown] = 0.0
        if self.projection is not None:
            x = x @ self.projection
            x[np.abs(x).max(axis=1, initial=0.0) < 1e-9] = 0.0
        return _unit(x)

    def encode(self, df: DataFrame, text_col: str, out_col: str = "vec") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @pandas_udf(T.ArrayType(T.DoubleType()))
        def enc(texts: pd.Series) -> pd.Series:
            parts = [shared.value.vectors(list(texts[a : a + _BATCH])) for a in range(0, len(texts), _BATCH)]
            return pd.Series([v for p in parts for v in p], dtype=object)

        return df.withColumn(out_col, enc(F.col(text_col)))
