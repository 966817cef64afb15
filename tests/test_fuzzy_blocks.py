import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlink.functions.similarity import wratio, wratio_batch, wratio_bound
from ledgerlink.operators import fuzzy_index as FI
from ledgerlink.operators import key_tree
from ledgerlink.operators.lookup import ORDER_COLS, build_lookup
from ledgerlink.operators.match import fuzzy_topk
from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA


def _lookup(spark, names):
    return build_lookup(spark.createDataFrame([(i + 1, n, "BANK", None, None, None, True) for i, n in enumerate(names)], MASTER_SCHEMA), spark.createDataFrame([], ALIAS_SCHEMA))


def test_exchanged_rows_do_not_grow_with_the_pairs(spark):
    """300 vendors that reach thousands of like keys: a row a vendor and slab, a row a key."""
    names = [f"LARGERING{i:04d}" for i in range(3000)]
    keys = spark.createDataFrame([(f"ARGERING{i:04d}",) for i in range(0, 3000, 10)], "vkey string")
    lk = _lookup(spark, names)
    postings = FI.build(lk)
    assert postings.laid.count() == postings.keys == 3000
    asked, served, rest = FI.plan(keys, FI.thresholds(keys, lk, 2, "vkey", postings), postings, "vkey")
    slabs = postings.laid.select("slab").distinct().count()
    assert served.count() == 300 and rest.isEmpty() and asked.count() <= 300 * slabs
    got = FI.best(asked, postings, "vkey", 2)
    assert got.count() <= 2 * 300 * slabs


@pytest.mark.parametrize("slab", [40, 5000])
def test_blocks_give_the_exact_top_with_ties_in_lookup_order(spark, monkeypatch, slab):
    monkeypatch.setattr(FI, "SLAB_ROWS", slab)
    monkeypatch.setattr(FI, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("AB농협12"), rng.integers(1, 9))) for _ in range(160)} | {"A" * 300, "농협" * 90})
    vendors = sorted({"".join(rng.choice(list("AB농협13Z"), rng.integers(0, 9))) for _ in range(50)} | {"A" * 290, "QQ", ""})
    lk = _lookup(spark, names)
    order = {r.key: tuple(r[c] for c in ORDER_COLS) for r in lk.collect()}
    got = {}
    for r in fuzzy_topk(spark.createDataFrame([(v,) for v in vendors], "vkey string"), lk, 2, "vkey", max_index_rows=0, chunk_rows=50).orderBy("vkey", "rank").collect():
        got.setdefault(r.vkey, []).append((r.key, r.score))
    for v in vendors:
        want = sorted((-wratio(v, n), order[n], n) for n in names)[:2]
        assert got[v] == [(n, -s) for s, _, n in want], v


def test_a_product_of_counts_bounds_the_score():
    rng = np.random.default_rng(8)
    a, b = (["".join(rng.choice(list("ABC농협1"), rng.integers(1, 40))) for _ in range(60)] for _ in range(2))
    bound = FI._reach(FI.counts(a), FI.counts(b), FI._lengths(a), FI._lengths(b))
    score = wratio_batch([x for x in a for _ in b], b * len(a)).reshape(len(a), len(b))
    assert (bound >= score - 1e-9).all()


def test_keys_of_the_same_characters_in_another_order_are_not_looked_at(spark):
    """720 keys that counts of characters can't tell apart: a vendor meets those with one character moved."""
    names = ["LARGERING" + "".join(p) for p in itertools.permutations("123456")]
    keys = spark.createDataFrame([(n[1:],) for n in names[::72]], "vkey string")
    lk = _lookup(spark, names)
    postings = FI.build(lk)
    asked, served, rest = FI.plan(keys, FI.thresholds(keys, lk, 2, "vkey", postings), postings, "vkey")
    assert served.count() == 10 and rest.isEmpty()
    assert FI.candidates(asked, postings, "vkey").count() < 0.1 * 10 * 720


@pytest.mark.parametrize("letters, longest, deep, frontier", [("AB농협12", 9, 96, 50), ("AB", 150, 96, 100_000), ("ABCDE😀", 90, 7, 50)])
def test_a_walk_finds_all_pairs_that_reach_a_score(monkeypatch, letters, longest, deep, frontier):
    monkeypatch.setattr(key_tree, "DEEP", deep)
    monkeypatch.setattr(key_tree, "FRONTIER", frontier)
    rng = np.random.default_rng(5)
    keys = ["".join(rng.choice(list(letters), rng.integers(1, longest))) for _ in range(120)]
    vendors = [k[: len(k) // 2] + "A" * (i % 3) + k[len(k) // 2 + i % 2 :] for i, k in enumerate(keys[:40])]
    least = rng.choice([0.0, 40.0, 75.0, 90.0, 100.0], len(vendors))
    trees = key_tree.grow(keys, FI._lengths(keys))
    vendor, place, common, m, left = key_tree.near(trees, vendors, least, 10**9)
    score = wratio_batch([v for v in vendors for _ in keys], keys * len(vendors)).reshape(len(vendors), len(keys))
    met = np.zeros(score.shape, dtype=bool)
    met[vendor, place] = True
    n = FI._lengths(vendors)
    assert (left == (least == 0)).all()
    assert met.sum() == len(vendor) and met[(score >= least[:, None]) & ~left[:, None] & (score > 0)].all()
    assert (wratio_bound(common, n[vendor], m) >= score[vendor, place] - 1e-9).all()
    wide = key_tree.near(trees, vendors, least, 50)
    assert wide[4].sum() > left.sum() and set(zip(wide[0], wide[1])) == {(v, p) for v, p in zip(vendor, place) if not wide[4][v]}
