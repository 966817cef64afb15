"""The Spark fast path against a direct Python model of the cascade on random masters."""

import random

from ledgerlink.functions.similarity import wratio
from ledgerlink.plans.resolve import resolve
from ledgerlink.schema import ALIAS_SCHEMA, MASTER_SCHEMA

SYL = ["농", "협", "은", "행", "국", "민", "신", "한", "KB", "NH", "B", "A"]


def _word(rng, lo=1, hi=4):
    return "".join(rng.choice(SYL) for _ in range(rng.randint(lo, hi)))


def _model(master, alias, vendors, threshold=90.0):
    key = lambda t: "".join(t.split()).upper()
    lookup = {}
    for iid, name, *_rest, active in sorted(master, key=lambda m: m[1]):
        if not active:
            continue
        lookup.setdefault(key(name), (iid, name, "CANONICAL"))
        for aid, a_iid, text, _n, typ, a_active in sorted(alias, key=lambda a: a[0]):
            if a_iid == iid and a_active:
                lookup.setdefault(key(text), (iid, name, typ or "ALIAS"))
    out = {}
    for v in vendors:
        k = key(v)
        if k in lookup:
            src = lookup[k][2]
            out[v] = ("EXACT" if src == "CANONICAL" else "ALIAS", lookup[k][1], 100.0, None, None, "AUTO")
            continue
        scored = sorted(((wratio(k, lk), i) for i, lk in enumerate(lookup)), key=lambda p: -p[0])
        if not scored:
            out[v] = ("UNRESOLVED", None, None, None, None, "NEEDS_REVIEW")
            continue
        keys = list(lookup)
        (s1, i1), second = scored[0], (scored[1] if len(scored) > 1 else None)
        t2 = (lookup[keys[second[1]]][1], round(second[0], 6)) if second else (None, None)
        if s1 >= threshold:
            out[v] = ("FUZZY", lookup[keys[i1]][1], round(s1, 6), *t2, "AUTO")
        else:
            out[v] = ("UNRESOLVED", None, round(s1, 6), *t2, "NEEDS_REVIEW")
    return out


def test_fast_path_equals_python_model(spark):
    rng = random.Random(2024)
    master, alias, aid = [], [], 1
    names = set()
    while len(master) < 8:
        n = _word(rng, 2, 4) + "은행"
        if n in names:
            continue
        names.add(n)
        iid = len(master) + 1
        master.append((iid, n, "BANK", None, None, None, rng.random() > 0.15))
        for _ in range(rng.randint(0, 3)):
            t = _word(rng, 1, 3) + (" " if rng.random() < 0.3 else "") + _word(rng, 0, 2)
            alias.append((aid, iid, t, t.strip().upper(), rng.choice(["ALIAS", "TYPO", None]), rng.random() > 0.2))
            aid += 1
    vendors = sorted({_word(rng, 1, 6) for _ in range(120)} | {m[1] for m in master[:3]} | {a[2] for a in alias[:4]})
    m = spark.createDataFrame(master, MASTER_SCHEMA)
    a = spark.createDataFrame(alias, ALIAS_SCHEMA)
    df = spark.createDataFrame([(v,) for v in vendors], "vendor string")
    got = {
        r.vendor: (r.normalization_method, r.canonical_institution, None if r.top1_score is None else round(r.top1_score, 6),
                   r.top2_candidate, None if r.top2_score is None else round(r.top2_score, 6), r.review_status)
        for r in resolve(df, "vendor", m, a, use_embedding=False).collect()
    }
    assert got == _model(master, alias, vendors)
