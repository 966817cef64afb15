"""Language model and toxicity classifier."""

import hashlib
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import MESSY, WORDS, frame, sentence
from pyspark.sql import functions as F

from ledgerlink.llm import maxent, toxicity
from ledgerlink.llm.common import fold


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_scores(rows):
    texts = [(i, maxent.tokens(t or "")) for i, t, *_ in rows]
    c = Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    out = []
    for i, ws in texts:
        out.append((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)))
    return sorted(out)


def found(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)


def test_tokens_cut_and_fold_ascii_only():
    assert maxent.tokens("A B \x0b\x1c c É") == ["a b".encode(), b"\x1c", b"c", "É".encode(), b""]


def test_long_words_are_counted_as_digests(spark):
    long = "x" * 65
    assert maxent.tokens(f"{'y' * 64} {long}")[:2] == [b"y" * 64, b"\xff" + hashlib.sha256(long.encode()).digest()[:16]]
    rows = [(i, f"{'-' * 80} {'=' * (70 + i % 3)} " * 20 + sentence(i, 10), "en", "a") for i in range(60)]
    got = maxent.score(frame(spark, rows), fold() == 1).collect()
    assert found(got) == base_scores(rows) and all(r.n_known == r.n_tokens for r in got)


def test_neighbours_count_pairs_inside_texts(spark):
    units = [[3, 1, 2, 60], [1], [2, 2], [700, 0]]
    df = spark.createDataFrame([(np.array(u, "<u2").tobytes(), False) for u in units] + [(np.array([5, 5], "<u2").tobytes(), True)], "units binary, held_out boolean")
    got = maxent.neighbours(df, maxent.Sizes(700, 100, 24, 32, 1024, 1024))
    want = np.zeros_like(got)
    for u in units:
        for x in u:
            want[x, -1] += 1
        for a, z in zip(u[:-1], u[1:]):
            if a < maxent.NEIGHBOURS:
                want[z, a] += 1
            if z < maxent.NEIGHBOURS:
                want[a, maxent.NEIGHBOURS + z] += 1
    assert (got == want).all()


def test_base_scores_on_messy_rows(messy, empty):
    rows = maxent.score(messy, fold() == 1).collect()
    assert found(rows) == base_scores(MESSY)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert maxent.score(empty, fold() == 1).count() == 0


def test_a_small_head_gives_the_same_base_scores(spark, monkeypatch):
    monkeypatch.setattr(maxent.lexicon, "__defaults__", (8,))
    rows = [(i, sentence(i, 30 + i % 7) + f" rare{i % 11}", "en", "a") for i in range(120)]
    assert found(maxent.score(frame(spark, rows), fold() == 1).collect()) == base_scores(rows)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held(i)][:3]
    rows = maxent.score(frame(spark, [(i, sentence(i), "en", "a") for i in ids]), fold() == 1).collect()
    assert [r.train_tokens for r in rows] == [0, 0, 0] and all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-6 and r.n_known == 0 for r in rows)


def test_context_beats_the_unigram_on_held_out_texts(spark):
    """Two languages with words of their own: the class factor learns which one a text is in."""
    r = np.random.default_rng(4)
    left, right = [f"ka{w}ra" for w in range(300)], [f"mo{w}tin" for w in range(300)]
    rows = [(i, " ".join(r.choice(left if i % 2 else right, 60)), "en", "a") for i in range(500)]
    got = maxent.score(frame(spark, rows), fold() == 1).filter("held_out").toPandas()
    assert (got.score > got.base_score).all()
    gain = (got.score.sum() - got.base_score.sum()) / got.n_tokens.sum()
    assert gain > 0.06  # of log10(2) = 0.30 at most, from 24,000 tokens


def random_model(sizes, seed=9):
    r = np.random.default_rng(seed)
    counts = r.integers(1, 50, sizes.units).astype(float)
    classes = maxent.cluster(np.c_[r.integers(0, 9, (sizes.units, 2 * maxent.NEIGHBOURS)), counts + 9], sizes.words, sizes)
    m = maxent.Model(sizes, classes, counts)
    return m.load(m.flat() + r.standard_normal(len(m.flat())).astype(np.float32))


def test_classes_have_at_most_so_many_units():
    sizes = maxent.Sizes(200, 50, 24, 16, 1024, 1024)
    classes = random_model(sizes).classes[: sizes.units]
    sizes_ = np.bincount(classes)
    assert classes[:24].tolist() == list(range(24)) and (sizes_[:24] == 1).all() and sizes_[24:].max() <= 16 and sizes_.sum() == sizes.units


def test_units_have_probabilities_that_add_up_to_one():
    """After any history, over all units: class factor times unit factor."""
    sizes = maxent.Sizes(60, 20, 24, 8, 1024, 1024)
    m = random_model(sizes)
    for before in ([], [3], [59, 3], [7, 70]):
        p = [10 ** maxent.unit_logs(m, np.array([*before, u]), np.array([0]))[-1] for u in range(sizes.units)]
        assert abs(sum(p) - 1) < 1e-4 and min(p) > 0


def test_scores_are_the_models_and_add_up_to_one(spark):
    """First words: all units and, below an ending, its words and an unknown one share the whole
    probability; and a text's score is the sum of its tokens' logs."""
    held_ids = [i for i in range(10_000, 40_000) if held(i)]
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(12)), "en", "a") for i in range(150)]
    rows += [(held_ids[k], f"w{k} w{k + 1} never{k}", "en", "a") for k in range(30)]
    docs = frame(spark, rows).coalesce(1)
    got = {r.doc_id: r.score for r in maxent.score(docs, fold() == 1).collect()}
    _, _, lex, model, below = maxent.fitted(docs, fold() == 1)
    at = {w: k for k, w in enumerate(lex.words)}
    assert len(at) < model.sizes.words and (below[len(at) :] == np.log10(0.5)).all()  # known words are units; an ending has its unknown word
    first = [10 ** maxent.unit_logs(model, np.array([u]), np.array([0]))[0] for u in range(model.sizes.units)]
    assert abs(sum(first) - 1) < 1e-4
    for i, text, *_ in rows:
        units = np.array([at.get(w, maxent.ending_unit(w, model.sizes)) for w in maxent.tokens(text)])
        unknown = sum(w not in at for w in maxent.tokens(text))
        want = maxent.unit_logs(model, units, np.array([0])).sum() + unknown * (np.log10(0.5) - np.log10(0.5))
        assert abs(got[i] - want) < 1e-2


def test_features_stay_inside_their_text():
    units = np.arange(10)
    alone = maxent.history(units[4:], np.array([0]), 99)
    both = maxent.history(units, np.array([0, 4]), 99)
    assert all((b[4:] == a).all() for a, b in zip(alone, both))
    one, two = maxent.history(np.array([7, 7, 7]), np.array([0, 1, 2]), 99)
    assert (one == 99).all() and (two == 99).all()


def test_gradient_steps_lower_the_loss():
    sizes = maxent.Sizes(100, 20, 24, 16, 1024, 1024)
    m = random_model(sizes).load(np.zeros_like(random_model(sizes).flat()))
    units, starts = np.tile([40, 41, 42, 5], 3 * maxent.BATCH), np.array([0])  # twelve batches
    before = maxent.unit_logs(m, units, starts).mean()
    own = maxent.unit_logs(m, units, starts)[1::4].mean()
    maxent.Trainer(m).steps(units, starts, 0.3)
    assert maxent.unit_logs(m, units, starts).mean() > before / 4 and maxent.unit_logs(m, units, starts)[1::4].mean() > own / 4


def test_sizes_grow_with_the_corpus():
    a, b, c = (maxent.sizes_for(10**k, 10**9) for k in (6, 9, 12))
    assert a.units < b.units < c.units < 65_535 and a.table < b.table < c.table and maxent.sizes_for(10**9, 200).words == 200


# -- toxicity -----------------------------------------------------------------

BAD = ["grumble", "snarl", "hiss"]


def labelled(n=400):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(i, 25).split()
        if toxic:
            words.insert(i % 20, BAD[i % 3] + ("!!" if i % 2 else ""))
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    y = np.array([i % 4 == 0 for i in got.doc_id])
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    assert (((got.score >= 0.5) == y)[out]).mean() > 0.95 and (got.flagged == y)[out].mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = labelled(200)
    docs = frame(spark, rows)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (labels, flip))
    assert a == b


def test_messy_rows_and_labels(spark, messy, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (None, 1, 1), (6, 1, 0), (7, 1, None), (8, None, 1), (9, 1, 0), (11, 1, 0), (777, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(messy, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in MESSY)
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(messy, labels.limit(0)).collect()} == {0.25}
    kept = toxicity.accepted(messy, labels)
    assert kept.columns == messy.columns and kept.count() == sum(not r.flagged for r in rows)


def test_of_several_labels_the_greatest_counts(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 5), (4, 1), (4, 0)], "doc_id long, toxic int")
    assert {(r._id, r.toxic) for r in toxicity.usable_labels(labels, F.lit(True)).collect()} == {(1, 1), (2, 0), (4, 1)}


def test_sample_is_bounded_and_balanced(spark):
    rows, labels = labelled(400)
    got = toxicity.sample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), 60).toPandas()
    assert len(got) == 60 and got.toxic.sum() == 30 and set(got[got.toxic == 1].n) == {100}


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_give_the_convolution(seed):
    """A text's score from per-word terms equals filters run over its word vectors."""
    m, v = toxicity.Model(seed), toxicity.Vocabulary()
    ids = np.array(v.ids(sentence(seed).split() + WORDS))
    x = toxicity.vectors(m.table, *v.features_of(np.arange(len(v.ends))))
    padded = np.concatenate([x[ids], np.zeros((3, toxicity.DIMS))])
    h = [np.max([sum(padded[t + j] @ m.filters[k][j] for j in range(k)) for t in range(len(ids))], axis=0) + m.shift[k] for k in toxicity.WIDTHS]
    z = np.maximum(np.concatenate(h), 0) @ m.out + m.bias[0]
    assert abs(m.score(m.terms(x), ids) - 1 / (1 + np.exp(-z))) < 1e-5
    scorer = toxicity.Scorer(m, limit=5)
    assert abs(scorer.score(sentence(seed)) - toxicity.Scorer(m).score(sentence(seed))) < 1e-6


def test_model_reaches_the_driver_in_small_parts():
    import pandas as pd

    rows = pd.DataFrame([(k, sentence(k, 12), "en", k % 2, k % toxicity.FOLDS, 20) for k in range(40)], columns=["doc_id", "text", "lang", "toxic", "part", "n"])
    got = toxicity._fit_fold((0,), rows.copy())
    parts = got[got["at"] >= 0].sort_values("at")["model"].tolist()
    assert max(map(len, parts)) <= toxicity.PART_BYTES
    model = pickle.loads(b"".join(parts))
    own = rows[rows["part"] == 0]
    assert got["doc_id"][0] == own["doc_id"].tolist()
    assert np.allclose(got["score"][0], [toxicity.Scorer(model).score(t) for t in own["text"]], atol=1e-6)
    assert toxicity._fit_fold((1,), rows.copy())["model"].tolist() == [None]
