"""Chat formatting, source mixing, the pipeline and the registered queries."""

import hashlib
import math
import os
import re
import sys
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_rows import MESSY, frame, sentence
from pyspark.sql import functions as F

from ledgerlink.llm import chat, mixing, oracle, queries
from ledgerlink.llm.common import range_buckets

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

NASTY = ["", "~", "~0", "~1", "<", "[", "<s>", "</s>", "[INST]", "[/INST]", "[INST~]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "</s", ">", "/s>", "[/INST", "]", "\\", "$1", "a\nb", "é🙂"]


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("rendered", "begin", "formatted", "loss", "turns", "source", "span")})


def expected_talk(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["user", "assistant", "system", "tool", "", None, "[TEXT]", "a[/ROLE]"]),
                          st.one_of(st.none(), st.lists(st.sampled_from(NASTY), max_size=4).map("".join))), max_size=30))
def test_round_trip_of_any_turns(spark, rows):
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(talk(spark, rows))).collect()}
    assert got == expected_talk(rows)


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a < b [c] ~"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "x"), (None, 0, "user", None), (2, 0, "system", "s")]
    got = {r.conv_id: r for r in chat.format_conversations(talk(spark, rows)).collect()}
    assert got[1].formatted == "[INST]a < b [c] ~[/INST]<s~>~1/s>~2INST] ok ~2/INST]</s><s>x</s>"
    assert [None if m.length is None else got[1].formatted[m.start : m.start + m.length] for m in got[1].loss] == [None, "~1/s>~2INST] ok ~2/INST]", "x"]
    assert got[None].formatted == "[INST][/INST]" and got[2].formatted == "<<SYS>>s<</SYS>>"
    assert chat.digests(chat.format_conversations(talk(spark, []))).count() == 0


def test_chat_runs_no_python(spark, small_dir):
    plan = queries.op9_chat_formatting(spark, small_dir)._jdf.queryExecution().toString()
    made = chat.format_conversations(spark.read.parquet(f"{small_dir}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan + made)


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "y" * 200 + "</s>" * (k % 3)) for k in range(3000)]
    (r,) = chat.digests(chat.format_conversations(talk(spark, rows))).collect()
    assert tuple(r)[1:5] == expected_talk(rows)[1]


# -- mixing -------------------------------------------------------------------

def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("a", "en", "1"): 10, ("a", "en", "2"): 1000, ("a", "de", "3"): 1000, ("b", "en", "4"): 1000}
    got = mixing.budgets(leaves, 400)
    assert got == {("a", "en", "1"): 10, ("a", "en", "2"): 90, ("a", "de", "3"): 100, ("b", "en", "4"): 200}
    leaves[("a", "en", "2")] = 20  # the language is short: first the other language, not the other domain
    assert mixing.budgets(leaves, 400) == {("a", "en", "1"): 10, ("a", "en", "2"): 20, ("a", "de", "3"): 170, ("b", "en", "4"): 200}
    leaves[("a", "de", "3")] = 50  # the domain is short
    assert mixing.budgets(leaves, 400) == {("a", "en", "1"): 10, ("a", "en", "2"): 20, ("a", "de", "3"): 50, ("b", "en", "4"): 320}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 100)), max_size=8), st.integers(0, 400))
def test_water_fill(nodes, budget):
    weights, limits = [float(w) for w, _ in nodes], [float(n) for _, n in nodes]
    got = mixing.water_fill(budget, weights, limits)
    assert all(-1e-9 <= g <= n + 1e-9 for g, n in zip(got, limits))
    assert math.isclose(sum(got), min(budget, sum(n for w, n in zip(weights, limits) if w)), abs_tol=1e-6)
    levels = [g / w for g, w, n in zip(got, weights, limits) if w and g < n - 1e-9]
    assert not levels or max(levels) - min(levels) < 1e-6


def brute_mix(spark, rows, share, max_epochs, weights=None, seed=17, temperature=None):
    """How often each (doc_id, epoch, tokens) is chosen; every row is a document."""
    leaves = {}
    for i, t, la, s in rows:
        n = len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
        leaves.setdefault(("short" if n < 128 else "medium" if n < 1024 else "long", la or "", s or ""), []).append((i, t or "", n))
    all_ = {p: sum(n for *_, n in v) for p, v in leaves.items()}
    told = weights if temperature is None else mixing.by_temperature(all_, temperature, weights)
    given_ = mixing.budgets({p: n * max_epochs for p, n in all_.items()}, share * sum(all_.values()), told)
    out = Counter()
    for p, v in leaves.items():
        b = math.floor(given_[p] + 1e-6)
        full = b // all_[p] if all_[p] else 0
        out.update((i, e, n) for i, _, n in v for e in range(full))
        rest = b - full * all_[p]
        place = mixing.order_of(seed, F.lit(full), F.col("i"), F.xxhash64("t"))
        places = {(r.i, r.t): r.h for r in spark.createDataFrame([(i, t) for i, t, _ in v], "i long, t string").select("i", "t", place.alias("h")).collect()}
        run = 0
        for i, t, n in sorted(v, key=lambda x: places[x[:2]]):
            run += n
            if run > rest or b == 0 or (rest == 0 and all_[p]):
                break
            out[i, full, n] += 1
    return out


def mix_rows():
    rows = [(1000 + i, sentence(i, 5 + i % 40), ["en", "de"][i % 2], f"src{i % 6 if i % 3 else 0}") for i in range(300)]
    rows += [(None if i % 2 else 77, sentence(i, 130), "en", "src1") for i in range(30)]  # no id, or the same one
    rows += [(None, sentence(3, 25), "fr", "copies")] * 150  # and the same text
    return MESSY + rows


@pytest.mark.parametrize("share, epochs, weights, temperature", [
    (0.5, 1.0, None, None), (0.75, 2.0, {("medium",): 3.0, ("short", "de"): 0.0}, None), (3.0, 2.5, None, 0.5), (0.0, 1.0, None, None), (0.6, 1.0, queries.MIXTURE["weights"], 0.5)])
def test_mix_equals_brute_force(spark, share, epochs, weights, temperature):
    rows = mix_rows()
    for max_leaves in (200_000, 3):  # the tree on the driver, and level by level in Spark
        got = mixing.mix(frame(spark, rows).repartition(3), share=share, max_epochs=epochs, weights=weights, temperature=temperature, max_leaves=max_leaves)
        assert Counter((r.doc_id, r.epoch, r.n_tokens) for r in got.collect()) == brute_mix(spark, rows, share, epochs, weights, temperature=temperature)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 200)), min_size=1, max_size=12, unique_by=lambda x: x[:2]), st.integers(0, 900), st.integers(0, 3))
def test_budgets_level_by_level_equal_those_of_the_tree(spark, leaves, budget, k):
    held = {(f"a{a}", f"b{b}"): n for a, b, n in leaves}
    weights = {("a0",): 0.0, ("a1",): 2.5, ("a2", "b1"): 0.0, ("a3", "b2"): 4.0} if k % 2 else {}
    temperature = 0.5 if k > 1 else None
    told = weights if temperature is None else mixing.by_temperature(held, temperature, weights)
    want = mixing.budgets({p: 1.5 * n for p, n in held.items()}, budget, told)
    df = spark.createDataFrame([(*p, n, 1.5 * n) for p, n in held.items()], "_l0 string, _l1 string, n long, most double")
    got = {(r._l0, r._l1): r.given for r in mixing.spread_budgets(df, ["_l0", "_l1"], budget, weights, temperature).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-6) for p in want)


def test_a_group_of_copies_is_cut_in_ranges(spark):
    """Copies without an id, more than an exchange's bound for one key."""
    rows = [(None, "one two three four", "en", "a")] * 2500
    got = mixing.mix(frame(spark, rows, clashes=False).repartition(4), budget=4002).collect()
    assert len(got) == 1000 and {(r.doc_id, r.epoch, r.n_tokens) for r in got} == {(None, 0, 4)}


def test_mix_weights_and_empty(spark, empty):
    rows = [(i, sentence(i, 20), "en", "x" if i % 2 else "y") for i in range(200)]
    levels = {"source": F.col("source")}
    got = mixing.mix(frame(spark, rows), budget=1000, weights={("x",): 3.0}, levels=levels).collect()
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in "xy"}
    assert tokens == {"x": 740, "y": 240}
    assert {r.source for r in mixing.mix(frame(spark, rows), budget=100, weights={("x",): 0}, levels=levels).collect()} == {"y"}
    assert mixing.mix(empty).count() == 0


# -- helpers, pipeline, registration ------------------------------------------

def test_range_buckets_keep_order(spark):
    for keys in ([], [5] * 50, list(range(1000)), [0] * 500 + list(range(10**6, 10**6 + 37))):
        df = spark.createDataFrame([(k,) for k in keys] + ([(None,)] if keys else []), "k long")
        bounds, bucket = range_buckets(df, "k", 30)
        for r in df.select("k", bucket.alias("b")).collect():
            assert r.b == (0 if r.k is None else sum(x <= r.k for x in bounds))


def stages(spark, docs, sf_dir):
    out = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir).persist()
        out.append(docs)
    return out


def test_pipeline_on_messy_rows(spark, messy, empty, small_dir):
    tox, exact, near, mixed, packed = stages(spark, messy, small_dir)
    for s in (tox, exact, near, mixed):
        assert s.columns == messy.columns
    assert {r.doc_id for r in exact.collect()} <= {r.doc_id for r in tox.collect()}
    assert Counter(re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in exact.collect()) == Counter({re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in tox.collect()})
    assert 2 not in {r.doc_id for r in exact.collect()} and {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert [s.count() for s in stages(spark, empty, small_dir)] == [0] * 5


def test_pipeline_on_the_documents(spark):
    small_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    tox, exact, near, mixed, packed = stages(spark, docs, small_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = re.compile(r"\b(idiot|moron|trash|scum|loser|stupid|worthless|pathetic|clown|disgusting)\b")
    assert sum(bool(bad.search(r.text)) for r in tox.collect()) <= 0.3 * sum(bool(bad.search(t)) for t in texts.values())
    clean = {i for i, t in texts.items() if not bad.search(t)}
    assert len({r.doc_id for r in tox.collect()} & clean) >= 0.95 * len(clean)

    def key(t):
        return re.sub("[\x20\x09-\x0d]", "", t)

    assert sorted({key(r.text) for r in tox.collect()}) == sorted(key(r.text) for r in exact.collect())
    assert len({r.sequence_id for r in packed.collect()}) <= 1.02 * sum(r.length for r in packed.collect()) / 2048 + 1
    assert corpus_pipeline.run(spark, small_dir).select("doc_id", "piece").distinct().count() == packed.count()


def test_each_operator_has_its_query(spark, small_dir):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in known) for n in range(1, 14)] == [1] * 13 and "pipeline" in known
    assert set(oracle.ORACLE_SQL) <= set(known)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_oracle_sql(spark, small_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    want, got = db.sql(oracle.ORACLE_SQL[name]), queries.QUERIES[name](spark, small_dir)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(repr, want.select(*columns).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
