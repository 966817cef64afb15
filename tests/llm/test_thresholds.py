"""Thresholds by language come from all labelled training rows."""

import numpy as np
from llm_rows import frame, sentence
from pyspark.sql import functions as F

from ledgerlink.llm import toxicity


def test_a_language_outside_the_sample_has_its_threshold(spark):
    rows, labels = [], []
    for i in range(2000):
        toxic, lang = i % 4 == 0, "xx" if i % 40 < 2 else "en"  # xx: 50 toxic rows, of 500
        rows.append((i, sentence(i, 12) + (" snarl" if toxic else ""), lang, "a"))
        labels.append((i, 1, int(toxic)))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, cuts = toxicity.train_model(frame(spark, rows), marked, F.lit(True), max_docs=200)
    assert set(cuts) == {None, "en", "xx"}
    seen = []
    cut = toxicity.best_cut
    toxicity.best_cut = lambda bins, toxic, n: seen.append((int(toxic.sum()), int(n.sum()))) or cut(bins, toxic, n)
    try:
        toxicity.train_model(frame(spark, rows), marked, F.lit(True), max_docs=200)
    finally:
        toxicity.best_cut = cut
    assert seen == [(500, 2000)]  # on the driver: over all rows


def test_best_cut():
    bins, toxic, n = np.array([9000, 5000, 4000, 100]), np.array([10, 5, 0, 0]), np.array([10, 5, 80, 900])
    assert abs(toxicity.best_cut(bins, toxic, n) - (5000 + 4001) / 2 / toxicity.BINS) < 1e-9
