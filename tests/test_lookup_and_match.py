import random

import numpy as np

from pyspark.sql import functions as F

from ledgerlink.functions.similarity import wratio
from ledgerlink.functions.text import match_key
from ledgerlink.operators.lookup import (
    ORDER_COLS,
    add_aliases,
    add_institutions,
    build_lookup,
    build_vector_index,
    master_with_aliases,
    seed_if_absent,
    set_active,
)
from ledgerlink.operators.match import fuzzy_topk
from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA


def test_seeded_lookup_has_15_keys_in_name_order(seed):
    m, a = seed
    lk = build_lookup(m, a).orderBy(*ORDER_COLS).collect()
    assert len(lk) == 15
    assert lk[0].canonical_name == "KB국민은행" and lk[0].match_source == "CANONICAL"
    assert [r.canonical_name for r in lk][-3:] == ["신한은행"] * 3


def test_first_wins_inactive_and_null_alias_type(spark):
    m = spark.createDataFrame(
        [(1, "B은행", "BANK", None, None, None, True), (2, "A은행", "BANK", None, None, None, True),
         (3, "C은행", "BANK", None, None, None, False)], MASTER_SCHEMA)
    a = spark.createDataFrame(
        [(10, 1, "공통", "공통", None, True), (11, 2, "공 통", "공 통", "TYPO", True), (12, 1, "꺼진별칭", "꺼진별칭", "ALIAS", False),
         (13, 3, "죽은기관별칭", "죽은기관별칭", "ALIAS", True)], ALIAS_SCHEMA)
    lk = {r.key: r for r in build_lookup(m, a).collect()}
    assert lk["공통"].canonical_name == "A은행" and lk["공통"].match_source == "TYPO"  # A sorts first
    assert "꺼진별칭" not in lk and "죽은기관별칭" not in lk and "C은행" not in lk
    only_b = build_lookup(m.where("institution_id = 1"), a)
    assert {r.key: r.match_source for r in only_b.collect()}["공통"] == "ALIAS"  # null type -> ALIAS
    idx = build_vector_index(m, a).collect()
    assert sorted(r.text for r in idx) == sorted(["A은행", "B은행", "공 통", "공통"])  # no key de-duplication


def _random_lookup(spark, rng, n):
    alpha = "가나다라AB"
    rows = [(i + 1, "".join(rng.choice(alpha) for _ in range(rng.randint(1, 6))) + f"#{i}", "BANK", None, None, None, True) for i in range(n)]
    return spark.createDataFrame(rows, MASTER_SCHEMA), spark.createDataFrame([], ALIAS_SCHEMA)


def _brute_top2(vkeys, entries):
    out = {}
    for v in vkeys:
        scored = sorted(((-wratio(v, e[0]), e[1], e[0]) for e in entries))
        out[v] = [(e[2], round(-e[0], 6)) for e in scored[:2]]
    return out


def test_few_pairs_are_scored(spark):
    """Noisy copies of 2,000 names: the bounds leave under 5 % of the pairs to score."""
    from pyspark.sql import Observation

    rng = random.Random(5)
    words = "almond antique azure beige bisque black blue blush brown chiffon coral cream cyan dark deep drab forest ghost green grey hot indian ivory khaki lace lemon lime linen".split()
    names = sorted({"".join(rng.sample(words, 3)) for _ in range(2000)})
    m = spark.createDataFrame([(i + 1, n, "BANK", None, None, None, True) for i, n in enumerate(names)], MASTER_SCHEMA)
    vk = spark.createDataFrame([(n[:4].upper() + n[5:].upper(),) for n in names[::10]], "vkey string")
    seen = Observation("scored")
    out = fuzzy_topk(vk, build_lookup(m, spark.createDataFrame([], ALIAS_SCHEMA)), 2, "vkey", with_scored=True).where("rank = 1")
    rows = out.observe(seen, F.sum("scored").alias("n")).collect()
    assert {r.vkey: r.key for r in rows} == {n[:4].upper() + n[5:].upper(): n.upper() for n in names[::10]}
    assert seen.get["n"] < 0.05 * vk.count() * len(names)


def test_pairs_at_a_floor_equal_brute_force(spark):
    from ledgerlink.operators.match import fuzzy_pairs

    rng = random.Random(3)
    m, a = _random_lookup(spark, rng, 40)
    keys = [r.key for r in build_lookup(m, a).collect()]
    vk = sorted({"".join(rng.choice("가나다라AB#1") for _ in range(rng.randint(0, 7))) for _ in range(80)})
    for bounds in ({}, {"max_index_rows": 0, "chunk_rows": 9}):
        got = {(r.vkey, r.key): r.score for r in fuzzy_pairs(spark.createDataFrame([(v,) for v in vk], "vkey string"), build_lookup(m, a), 60.0, **bounds).collect()}
        assert got == {(v, k): wratio(v, k) for v in vk for k in keys if wratio(v, k) >= 60.0}


def test_blocked_top2_equals_brute_force_on_both_plans(spark):
    rng = random.Random(11)
    m, a = _random_lookup(spark, rng, 25)
    lk = build_lookup(m, a)
    entries = [(r.key, (r.ord_name, r.ord_alias, r.ord_alias_id)) for r in lk.collect()]
    vk = sorted({"".join(rng.choice("가나다라ABXY") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    vdf = spark.createDataFrame([(v,) for v in vk], "vkey string")
    expect = _brute_top2(vk, entries)
    for bounds in ({}, {"max_index_rows": 0, "chunk_rows": 7}):  # whole lookup in each worker, and chunks x buckets
        got = {}
        for r in fuzzy_topk(vdf, lk, 2, "vkey", **bounds).orderBy("vkey", "rank").collect():
            got.setdefault(r.vkey, []).append((r.key, round(r.score, 6)))
        assert got == expect


def test_master_maintenance(spark, seed):
    m, a = seed
    m2 = add_institutions(m, spark.createDataFrame([("하나은행", "BANK", None, None, None), ("신한은행", "BANK", None, None, None)],
                                                   "canonical_name string, institution_type string, english_name string, keywords string, negative_keywords string"))
    rows = {r.canonical_name: r.institution_id for r in m2.collect()}
    assert rows["하나은행"] == 4 and len(rows) == 4
    a2 = add_aliases(a, spark.createDataFrame([(4, " 하나 ", "ABBREVIATION")], "institution_id long, alias_text string, alias_type string"))
    new = a2.where("institution_id = 4").first()
    assert new.alias_id == 13 and new.normalized_alias == "하나"
    m3 = set_active(m2, "institution_id", spark.createDataFrame([(4,)], "institution_id long"), False)
    assert m3.where("institution_id = 4").first().active is False
    try:
        set_active(m2, "institution_id", spark.createDataFrame([(99,)], "institution_id long"), False)
        raise AssertionError("unknown id must raise")
    except ValueError:
        pass
    nm, na, added = seed_if_absent(m2, a2, *seed)
    assert added.first().added == 0 and nm.count() == 4
    j = master_with_aliases(m, a).groupBy("canonical_name").agg(F.count("alias_id").alias("n")).collect()
    assert {r.canonical_name: r.n for r in j} == {"NH농협은행": 6, "KB국민은행": 4, "신한은행": 2}


def test_match_key_of_lookup_equals_python_rule(spark, seed):
    m, a = seed
    for r in build_lookup(m, a).select("key", "match_text", match_key("match_text").alias("k2")).collect():
        assert r.key == "".join(r.match_text.split()).upper() == r.k2


def _index_case(seed, n_names, n_vendors, words):
    rng = random.Random(seed)
    names = sorted({"".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", "#", str(rng.randrange(99))]) for _ in range(n_names)})
    vendors = set()
    for n in rng.sample(names, min(n_vendors, len(names))):
        k = rng.randrange(len(n))
        vendors.add(rng.choice([n, n[:k] + n[k + 1 :], n + "본점", "ZQ" + n, n[k:], "", rng.choice(words)]))
    return names, sorted(vendors)


def _name_lookup(spark, names):
    m = spark.createDataFrame([(i + 1, n, "BANK", None, None, None, True) for i, n in enumerate(names)], MASTER_SCHEMA)
    return build_lookup(m, spark.createDataFrame([], ALIAS_SCHEMA))


def test_inverted_index_equals_brute_force(spark):
    """Seeds, probes and dense rest together, with keys beyond the index's length on both sides."""
    words = "ALMOND ANTIQUE AZURE 농협 은행 신한 국민 증권 BEIGE 🙂X BLACK".split()
    names, vendors = _index_case(7, 150, 60, words)
    names, vendors = [*names, "ALMOND" * 14, "농협" * 40 + "X"], [*vendors, "ALMOND" * 13 + "Z", "농협" * 40]
    lk = _name_lookup(spark, names)
    entries = [(r.key, (r.ord_name, r.ord_alias, r.ord_alias_id)) for r in lk.collect()]
    got = {}
    for r in fuzzy_topk(spark.createDataFrame([(v,) for v in vendors], "vkey string"), lk, 2, "vkey", max_index_rows=0, chunk_rows=50).orderBy("vkey", "rank").collect():
        got.setdefault(r.vkey, []).append((r.key, round(r.score, 6)))
    assert got == _brute_top2(vendors, entries)


def test_inverted_index_looks_at_few_pairs(spark):
    """The bound of under 5 % of all pairs is ever computed, dense rest included (100 vendors, 2,000 names)."""
    from ledgerlink.operators import fuzzy_index
    from ledgerlink.plans import queries

    lk, vk = queries._wide_lookup(spark, "/root/testdata/sf0.01"), queries._wide_vendors(spark, "/root/testdata/sf0.01")
    postings = fuzzy_index.build(lk)
    asked, served, rest = fuzzy_index.plan(vk, fuzzy_index.thresholds(vk, lk, 2, "vkey"), postings, "vkey")
    assert served.count() + rest.count() == vk.count()
    looked = fuzzy_index.candidates(asked, postings, "vkey").count() + rest.count() * postings.keys
    assert looked < 0.05 * vk.count() * postings.keys


def test_needed_characters_invert_the_bound(spark):
    from ledgerlink.functions.similarity import wratio_bound
    from ledgerlink.operators import fuzzy_index

    rows = [(n, m, t / 2) for n in (1, 2, 5, 9, 30) for m in (1, 3, 7, 14, 60) for t in range(1, 201, 7)]
    for r in spark.createDataFrame(rows, "n int, m int, t double").withColumn("c", fuzzy_index.needed(F.col("n"), F.col("m"), F.col("t"))).collect():
        reach = [c for c in range(1, min(r.n, r.m) + 1) if wratio_bound(np.array([c]), np.array([r.n]), np.array([r.m]))[0] >= r.t - 1e-9]
        assert (reach[0] if reach else min(r.n, r.m) + 1) == min(r.c, min(r.n, r.m) + 1)
