import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.functions.similarity import lcs_length, native_lcs, partial_ratio, ratio, wratio, wratio_col


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


# golden scores on match keys (fixed master, fuzzy step)
GOLDEN = [
    ("NONGHYUPBANK", "NHBANK", 72.0),
    ("OO농협", "농협(대출)", 60.0),
    ("OO농협", "NH농협", 50.0),
    ("ABC부품", "KB국민", 22.222222),
    ("농협", "NH농협", 90.0),
    ("농협은행부산지점", "농협은행", 90.0),
    ("(주)농협은행", "농협은행", 90.0),
    ("테스트전자", "KB국민은행", 0.0),
]


@pytest.mark.parametrize("a,b,score", GOLDEN)
def test_golden_scores(a, b, score):
    assert round(wratio(a, b), 6) == score


def test_short_name_reaches_threshold_exactly():
    assert wratio("농협", "NH농협") >= 90.0  # never round before the threshold test


def test_one_letter_typo_stays_below_threshold():
    best = max(wratio("농협은헹", k) for k in ["NH농협은행", "농협은행", "농은", "KB국민은행", "국민은행"])
    assert 70 <= best < 90


def test_empty_is_zero_and_identical_is_100():
    assert wratio("", "ABC") == 0.0
    assert wratio("ABC", "ABC") == 100.0
    assert wratio(None, "A") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AB농협은행X", max_size=12), st.text(alphabet="AB농협은행Y", max_size=12))
def test_wratio_symmetric_bounded_and_lcs_exact(a, b):
    assert lcs_length(a, b) == _lcs_dp(a, b)
    w = wratio(a, b)
    assert w == wratio(b, a)
    assert 0.0 <= w <= 100.0
    if a and b and not set(a) & set(b):
        assert w == 0.0


def test_partial_ratio_takes_best_window():
    assert partial_ratio("BANK", "NONGHYUPBANK") == 100.0
    assert ratio("AB", "AB") == 100.0


def test_udf_and_native_lcs_match_python(spark):
    rng = random.Random(7)
    alpha = "가나다ABC"
    rows = [("".join(rng.choice(alpha) for _ in range(rng.randint(0, 7))), "".join(rng.choice(alpha) for _ in range(rng.randint(0, 7)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select("a", "b", wratio_col("a", "b").alias("w"), native_lcs(F.col("a"), F.col("b")).alias("l")).collect()
    for r in out:
        assert r.w == wratio(r.a, r.b)
        assert r.l == _lcs_dp(r.a, r.b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="AB농협은행X ", max_size=14)),
                          st.one_of(st.none(), st.text(alphabet="AB농협은행Y ", max_size=40))), min_size=1, max_size=30))
def test_vectorised_batch_equals_scalar(pairs):
    import math

    from ledgerlink.functions.similarity import wratio_batch

    got = wratio_batch([p[0] for p in pairs], [p[1] for p in pairs])
    for (a, b), g in zip(pairs, got):
        w = wratio(a, b)
        assert (w is None and math.isnan(g)) or w == g


def test_vectorised_batch_long_strings():
    from ledgerlink.functions.similarity import wratio_batch

    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("가나AB") for _ in range(n))
    pairs = [("가" * 70 + "A", "가" * 200)] + [(make(a), make(b)) for a, b in ((63, 64), (64, 64), (64, 130), (65, 200), (128, 129), (129, 500), (300, 310), (2, 900))]
    assert wratio_batch(*zip(*pairs)).tolist() == [wratio(a, b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="AB농협X", max_size=20), st.text(alphabet="AB농협Y", max_size=40))
def test_bound_is_never_below_the_score(a, b):
    import numpy as np

    from ledgerlink.functions.similarity import wratio_bound

    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    assert wratio(a, b) <= wratio_bound(np.array([common]), np.array([len(a)]), np.array([len(b)]))[0] + 1e-9
