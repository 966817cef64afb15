"""Exact dedup, SimHash near-dedup, prefix-hash fingerprints."""

import hashlib
import os
import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.llm import exact_dedup, prefix_hash, simhash

from llm_rows import MESSY, frame, sentence


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 2**32))
def test_filter_has_no_false_negatives(n, seed):
    keys = np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64)
    f = exact_dedup.build_filter(keys)
    assert exact_dedup.may_contain(f, keys).all()


def test_filter_rejects_most_others():
    r = np.random.default_rng(5)
    f = exact_dedup.build_filter(r.integers(0, 2**62, 100_000, dtype=np.uint64))
    others = r.integers(2**62, 2**63, 100_000, dtype=np.uint64)
    assert exact_dedup.may_contain(f, others).mean() < 0.006
    assert len(f[3]) < 100_000 * 1.3


def expected_groups(rows):
    groups = {}
    for i, t, *_ in rows:
        key = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t or ""), i is None, i if i is not None else 0))
    return {k: (min(v)[2] if not min(v)[1] else None, len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("side", [None, "all", "none"])
def test_exact_groups(spark, messy, side):
    how = {None: None, "all": F.lit(True), "none": F.lit(False)}[side]
    rows = exact_dedup.exact_groups(messy, how).collect()
    want = expected_groups(MESSY)
    assert len(rows) == len(MESSY)
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in rows} == want
    kept = [r for r in rows if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(want) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_over_many_shards(spark):
    rows = [(i, sentence(i % 60) + str(i % 97), "en", "a") for i in range(600)]
    docs = frame(spark, rows)
    got = exact_dedup.digests(docs).withColumn("old", F.col("doc_id") % 3 > 0)
    buckets, filters, shards = exact_dedup.build_snapshot(got.filter("old"), shards=5)
    assert filters.count() == 5
    groups = exact_dedup.merge(buckets, exact_dedup.screen(exact_dedup.grouped(got.filter(~F.col("old"))), filters, shards)).collect()
    assert {r.digest: (r.best.doc_id, r.group_size) for r in groups} == expected_groups(rows)


def test_screening_is_spread_over_parts(spark):
    rows = exact_dedup.digests(frame(spark, [(i, str(i), "en", "a") for i in range(4000)])).withColumn("key", exact_dedup._key())
    n = [r["count"] for r in rows.groupBy(F.shiftright("key", 30) % 8).count().collect()]
    assert len(n) == 8 and max(n) < 2 * min(n)


def test_exact_groups_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def test_equal_digests_of_different_texts_are_noticed(spark, messy):
    groups = spark.createDataFrame([(hashlib.sha256(b"HelloWorld").hexdigest(), 2)], "digest string, group_size long")
    assert exact_dedup.colliding(messy, groups).count() == 0


def model_fingerprint(text):
    import xxhash

    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs_of, first):
    """first: fingerprint -> smallest id."""
    fps = np.array(sorted(first), np.uint64)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= pairs_of).tolist():
            parent[find(i)] = find(i + 1 + j)
    low = {}
    for i, f in enumerate(fps.tolist()):
        low[find(i)] = min(low.get(find(i), 2**62), first[f])
    return {f: low[find(i)] for i, f in enumerate(fps.tolist())}


def test_near_duplicates_on_messy_rows(messy, empty):
    rows = simhash.near_duplicates(messy).collect()
    first = {}
    for i, t, *_ in MESSY:
        f = model_fingerprint(t)
        first[f] = min(first.get(f, 2**62), i if i is not None else 2**62)
    want = brute_components(3, first)
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(i), f"{model_fingerprint(t):016x}") for i, t, *_ in MESSY)
    for r in rows:
        w = want[int(r.fingerprint, 16)]
        assert r.component_id == (w if w < 2**62 else None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("max_bits, thresholds", [(3, None), (3, [3, -1]), (3, [0, 2]), (3, [1, 0, 0]), (3, [-1, 1, 1]), (2, None), (4, [1, 2]), (0, None)])
def test_links_equal_brute_force(spark, max_bits, thresholds):
    r = random.Random(7)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(8):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    n, both = simhash.bit_counts(df)
    assert n == len(fps) and both[5, 9] == sum(f >> 5 & f >> 9 & 1 for f in fps)
    if thresholds is None:
        groups, thresholds = simhash.allot(n, both, max_bits, tuple(m for m in (2, 3) if m <= max_bits + 1) if max_bits else (1,))
    else:
        groups = simhash.group_bits(n, both, len(thresholds))
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(thresholds) == max_bits - len(groups) + 1
    got = {(x.a % 2**64, x.b % 2**64) for x in simhash.links(df, groups, thresholds, max_bits).collect()}
    want = {(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= max_bits}
    assert {tuple(sorted(p)) for p in got} == want


def test_correlated_bits_share_a_group():
    r = np.random.default_rng(3)
    bits = r.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    groups = simhash.group_bits(4000, (bits.T @ bits).astype(float), 3)
    assert any({3, 40} <= set(g) for g in groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(-5, 900), (900, 901), (3, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 700)} | {-5: -5, 900: -5, 901: -5}
    assert got == want


def test_components_keep_the_drivers_jobs_few(spark):
    def jobs(edges):
        group = f"components-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, "test")
        try:
            got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    got, n = jobs([(3, 3)])
    assert got == {} and n <= 4
    got, n = jobs([(k, 0) for k in range(1, 40)] + [(100, 101)])
    assert got == dict.fromkeys(range(40), 0) | {100: 100, 101: 100} and n <= 14


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = prefix_hash.PrefixHash(a), prefix_hash.PrefixHash(b + a)
    assert x.extension(0, y, len(b)) == len(a)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b + a)))
    assert x.extension(i, y, j) == len(os.path.commonprefix([a[i:], (b + a)[j:]]))
    keep, take = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b + a)))
    whole, n, sketch = x.spliced(keep, y, take)
    z = prefix_hash.PrefixHash(a[:keep] + (b + a)[:take])
    assert prefix_hash.fingerprint(whole, n, sketch) == prefix_hash.fingerprint(z.whole(), z.n, z.sketch())


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 2
        yield i, t, t[: len(t) - cut] + nxt[:cut], nxt


@pytest.mark.parametrize("buckets", [1, 4])
def test_fingerprints_on_messy_rows(messy, buckets):
    rows = prefix_hash.fingerprints(messy, buckets=buckets).collect()

    def of(t):
        p = prefix_hash.PrefixHash(t)
        return prefix_hash.fingerprint(p.whole(), p.n, p.sketch())

    want = [(str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), of(t), of(e), prefix_hash.likeness(of(t), of(e)), prefix_hash.likeness(of(t), of(n)),
             len(os.path.commonprefix([t, e])), len(os.path.commonprefix([t, n]))) for i, t, e, n in edited(MESSY)]
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == sorted(want)


def test_fingerprints_empty_and_single(spark, empty):
    assert prefix_hash.fingerprints(empty).count() == 0
    (r,) = prefix_hash.fingerprints(frame(spark, [(5, "abcd", "en", "a")])).collect()
    assert r.near_next == 1.0 and r.edited_prefix == 2


def test_likeness_follows_the_shared_part():
    r = random.Random(2)
    a, b = ("".join(r.choice("abcdefghij ") for _ in range(4000)) for _ in range(2))
    prints = {}
    for share in (0, 0.5, 0.9, 1):
        p = prefix_hash.PrefixHash(a[: int(4000 * share)] + b[int(4000 * share) :])
        prints[share] = prefix_hash.fingerprint(p.whole(), p.n, p.sketch())
    near = [prefix_hash.likeness(prints[1], prints[s]) for s in (0, 0.5, 0.9, 1)]
    assert near[0] == 0 and abs(near[1] - 0.5) < 0.2 and abs(near[2] - 0.9) < 0.15 and near[3] == 1
