"""Rows of the pipeline are told apart by their own key, not by doc_id."""

import os
import sys
from collections import Counter

from llm_rows import frame, sentence

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

A, B = sentence(1), sentence(6, 60)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_dedup_keeps_each_text_once(spark, small_dir):
    rows = [(5, A, "en", "a"), (5, B, "en", "a"), (3, B, "en", "a")]
    assert pairs(corpus_pipeline.exact_dedup(spark, frame(spark, rows), small_dir)) == {(5, A): 1, (3, B): 1}


def test_rows_without_an_id_stay_by_their_texts(spark, small_dir):
    texts = [sentence(k, 30 + 3 * k) for k in range(6)]
    rows = [(None, t, "en", "a") for t in texts] + [(7, A + " more of it", "en", "a"), (7, A + " more  of it", "en", "a"), (None, texts[1], "en", "a")]
    docs = frame(spark, rows).repartition(3)
    got = corpus_pipeline.exact_dedup(spark, docs, small_dir)
    assert sorted(t.replace(" ", "") for _, t in pairs(got).elements()) == sorted({t.replace(" ", "") for _, t, _, _ in rows})
    assert (7, A + " more  of it") in pairs(got) and got.columns == docs.columns


def test_texts_that_share_an_id_all_stay(spark, small_dir):
    rows = [(5, A, "en", "a"), (5, B, "en", "a"), (6, sentence(9, 45), "en", "a")]
    docs = frame(spark, rows)
    assert pairs(corpus_pipeline.exact_dedup(spark, docs, small_dir)) == {(5, A): 1, (5, B): 1, (6, sentence(9, 45)): 1}
    assert pairs(corpus_pipeline.near_dedup(spark, docs, small_dir)) == {(5, A): 1, (5, B): 1, (6, sentence(9, 45)): 1}


def test_near_dedup_keeps_one_row_of_each_component(spark, small_dir):
    rows = [(5, A, "en", "a"), (5, B, "en", "a"), (3, B, "en", "a"), (None, sentence(9, 50), "en", "a"), (None, sentence(11, 70), "en", "a"), (None, A, "en", "a")]
    got = pairs(corpus_pipeline.near_dedup(spark, frame(spark, rows), small_dir))
    assert got == {(5, A): 1, (3, B): 1, (None, sentence(9, 50)): 1, (None, sentence(11, 70)): 1}


def test_mixing_counts_and_chooses_rows(spark, small_dir):
    rows = [(None if k % 2 else 4, sentence(k, 20), "en", "a") for k in range(40)]
    got = corpus_pipeline.mixing(spark, frame(spark, rows), small_dir).collect()
    assert len(got) == 30  # 600 of 800 tokens


def test_stored_data_sets_are_cleaned_up(spark):
    from ledgerlink.llm.common import _STORED, clean_up, stored

    kept = _STORED[:]
    _STORED.clear()
    path = stored(spark.range(5), "some").inputFiles()[0].removeprefix("file://")
    try:
        assert os.path.exists(path) and clean_up(spark) == 1 and not os.path.exists(path) and clean_up(spark) == 0
    finally:
        _STORED[:] = kept
