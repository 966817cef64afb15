"""Prefix trie, structure repair and line dedup against brute force."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.llm import line_dedup, prefix_trie, structure_repair
from ledgerlink.llm.common import hot_join, stored

from llm_rows import CLASHES, LONG, MESSY, frame

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def messy_conversations(seed=3, n=260):
    r = random.Random(seed)
    texts = ["Hello.", "Hello there", "", None, " \t\n\x0b", "What is it?\n", "Sûr!", "日本 。", "ok .", "a\x1c", "x" * 9, LONG[:30_000]]
    rows = []
    for c in [*range(n), 300, 305, 411, -7, -100, -142]:
        if 3 < c < 40 and c % 9 == 0:
            continue
        turns = r.choice([0, 1, 2, 2, 3, 4, 6, 9])
        for t in range(turns + 1):
            rows.append((c, r.choice([t, t, t, t + 2, t, None]) if c % 5 == 0 else t, r.choice(["user", "assistant", "system", None, "tool", ""]) if c % 4 == 0 else ["user", "assistant"][t % 2], texts[r.randrange(2)] if c % 3 else r.choice(texts)))
    rows += [(7, 0, "user", "Hello."), (7, 0, "user", "Hello."), (8, None, None, None)]  # ties and repeated rows
    rows += [(c, t, ["user", "assistant"][t % 2], f"turn {t}") for c in (120, 121, 122) for t in range(70 if c < 122 else 71)]  # deep, shared to the end
    return rows


def conversations(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES + ["path", "code", "codes", "alive", "copy", "plan", "kind", "d1", "depth", "shared"]}).repartition(parts)


# -- prefix trie ----------------------------------------------------------------

def ordered_turns(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32].upper() + f"{len(text):08X}"
            convs.setdefault(c, []).append(((turn is not None, turn or 0), code.lower(), role, text))
    return {c: [(x[2], x[3]) for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}


def rebuilt_by_hand(rows):
    convs = ordered_turns(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = [*convs.get(c - int(math.fmod(c, 100)), [])[:h], *own[h:]]
    return out


def trie_by_hand(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    figures = {}
    for p in sorted(members, key=len, reverse=True):
        below = [figures[k] for k in kids.get(p, [])]
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        figures[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *figures[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items())


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(r) for r in df.collect())


def test_trie_equals_brute_force(spark):
    rows = messy_conversations()
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.coded(conversations(spark, [*rows, (None, 0, "user", "lost")])))))
    assert got == trie_by_hand(rebuilt_by_hand(rows))
    assert max(r[1] for r in got) >= 69


def test_trie_without_rebuilding_and_with_a_hot_node(spark):
    """A third of all conversations are equal; many blocks of ids end at one node."""
    rows = [(c, t, "user", f"{t}") for c in range(3000) for t in range(2 if c % 3 == 0 else 1 + c % 4)]
    rows += [(c, 2, "user", f"{c}") for c in range(0, 3000, 7)]
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.coded(conversations(spark, rows))))
    assert got == trie_by_hand(ordered_turns(rows))


def test_trie_parents_with_many_children_are_broadcast(spark, monkeypatch):
    rows = [(c, t, "user", "first" if t == 0 else f"{c}") for c in range(2500) for t in range(2)]
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.coded(conversations(spark, rows))))
    assert got == trie_by_hand(ordered_turns(rows))


def test_trie_of_nothing_and_of_one(spark):
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.coded(conversations(spark, []))))) == []
    one = [(5, 0, "user", "Hi")]
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.coded(conversations(spark, one)))) == trie_by_hand(ordered_turns(one))


def test_a_conversation_without_turns_is_in_the_root(spark):
    rows = [(c, 0, "user", "Hi") for c in range(1, 30)]  # no first conversation of the block: h > 0 leaves nothing
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.coded(conversations(spark, rows)))))
    assert got == trie_by_hand(rebuilt_by_hand(rows)) and got[0][3] == 29


def test_trie_peels_shared_levels_only(spark, monkeypatch):
    """A lone long conversation costs no level of its own."""
    made = []
    monkeypatch.setattr(prefix_trie, "_node", lambda rows, depth, f=prefix_trie._node: made.append(depth) or f(rows, depth))
    rows = [(1, t, "user", f"{t}") for t in range(3000)] + [(2, t, "user", f"{t}" if t < 2 else "x") for t in range(5)]
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.coded(conversations(spark, rows))))
    assert got == trie_by_hand(ordered_turns(rows)) and made == [2, 1, 0]


# -- structure repair -------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def damaged_by_hand(rows):
    out = {}
    for c, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        d1 = xxhash.xxh64_intdigest(f"{len(role)}:{role}{text}".encode(), seed=42)
        key = ((turn is not None, turn or 0), d1 - (1 << 64) if d1 >= 1 << 63 else d1)
        out.setdefault(c, []).extend([(key, turn, role, text)] * {0: 0, 3: 2}.get(code, 1))
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def repaired_by_hand(rows):
    """Every sequence of edits that can be of use, by recursion over whole audits and texts."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(k, state, inserts):
        options = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        name = {"u": "user", "a": "assistant"}
        if inserts < 2:
            x = nexts[state][-1]
            cost, audit, out = best(k, x, inserts + 1)
            options.append((cost + 5, "I" + audit, (name[x] + ":", *out)))
        if k < len(rows):
            _, role, text = rows[k]
            cost, audit, out = best(k + 1, state, 0)
            options.append((cost + 2, "D" + audit, out))
            if faults[k] not in "bd":
                more = 5 * (faults[k] == "t")
                if role[:1] and role[:1] in nexts[state]:
                    cost, audit, out = best(k + 1, role[:1], 0)
                    options.append((cost + more, "K" + audit, (f"{role}:{text}", *out)))
                if role[:1] != (x := nexts[state][-1]):
                    cost, audit, out = best(k + 1, x, 0)
                    options.append((cost + more + 1, "R" + audit, (f"{name[x]}:{text}", *out)))
        return min(options, default=(1 << 30, "~", ()))

    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = best(0, "", 0)
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_repair_equals_brute_force(spark):
    rows = [*messy_conversations(11), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, "user", "And")]
    rows += [(c, 0, "user", "Hi.") for c in range(500, 560)]  # some lose their only row
    got = structure_repair.repair(structure_repair.damaged(conversations(spark, rows)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {c: repaired_by_hand(v) for c, v in damaged_by_hand(rows).items()}
    assert by_id(map(tuple, got.collect())) == by_id((c, *v) for c, v in want.items())
    assert any(v == (0, 0, 0, 0, 0, 0, "", EMPTY) for v in want.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["a.", "b", " ", "c!"])), max_size=9))
def test_automaton_equals_brute_force(turns):
    rows = [(t, role, text) for t, (role, text) in enumerate(turns)]
    seen, letters = set(), ""
    for role, text in turns:
        x = role[0] if role[0] in "sua" else "o"
        letters += "x" if not text.strip() or (role, text) in seen else x.upper() if text[-1] not in ".!" else x
        seen.add((role, text))
    cost, audit = structure_repair.Ending().move(letters)
    want = repaired_by_hand(rows)
    assert (cost, audit) == want[5:7]
    repair = structure_repair.Repair(audit)
    out = [f"{role}:{text}" for t in turns for _, role, text in repair.row(*t)] + [f"{role}:{text}" for _, role, text in repair.rest()]
    assert hashlib.sha256("\n".join(out).encode()).hexdigest() == want[7]


def test_endings_are_shared_and_the_automaton_is_finite():
    r = random.Random(1)
    signatures = sorted({"".join(r.choice("suaoSUAOx") for _ in range(r.randrange(12))) for _ in range(5000)}, key=lambda s: s[::-1])
    shared = structure_repair.Ending()
    assert [shared.move(s) for s in signatures] == [structure_repair.Ending().move(s) for s in signatures]
    assert len(shared.automaton.costs) < 100


def test_a_long_conversation_is_linear():
    ending = structure_repair.Ending()
    cost, audit = ending.move("uaUoxS" * 100_000)
    assert len(audit) >= 600_000 and cost > 0
    assert ending.move("a" + "uaUoxS" * 100_000)[0] > cost


def test_repaired_turns_follow_the_grammar(spark):
    rows = messy_conversations(23)
    damaged = structure_repair.damaged(conversations(spark, rows))
    got = structure_repair.repaired_turns(damaged).collect()
    by_conv = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for turns in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert [t.turn for t in turns] == list(range(len(turns)))
    digests = {r.conv_id: r.repaired_sha256 for r in structure_repair.repair(damaged).collect()}
    assert all(digests[c] == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in v).encode()).hexdigest() for c, v in by_conv.items())
    assert all(d == EMPTY for c, d in digests.items() if c not in by_conv)


def test_repair_of_nothing(spark):
    assert structure_repair.repair(structure_repair.damaged(conversations(spark, []))).collect() == []
    assert structure_repair.repaired_turns(structure_repair.damaged(conversations(spark, []))).collect() == []


# -- line dedup ---------------------------------------------------------------------

def lines_by_hand(rows, min_docs=2, min_chars=10):
    """(doc_id, n_lines, n_dropped, text) of each row."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    keyed = [(i, [(x, x.strip(SPACES).translate(lower)) for x in (t or "").split("\n")]) for i, t, *_ in rows]
    docs = {}
    for i, lines in keyed:
        for _, k in lines:
            if len(k) >= min_chars:
                docs.setdefault(k, set()).add(i)
    owner = {k: min((x for x in d if x is not None), default=None) for k, d in docs.items() if len(d) >= min_docs}
    out = []
    for i, lines in keyed:
        kept = [x for x, k in lines if k not in owner or owner[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = ["Share this story", "  share THIS story\t", "Étage numéro un", "étage NUMÉRO un", "short", "Zehn Buchstaben ß", "", " ", "exactly 10", "exactly 9", "\x0bA line with a tab\there\r", "a line with a tab\there", "unique"]


def line_rows(seed=4, n=150):
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choice(LINES) + (f" {i}" if r.random() < 0.2 else "") for _ in range(r.randrange(9))), "en", "a") for i in range(n)]
    return [*rows, *MESSY, (None, "Share this story\nof no one in particular", "en", "a"), (None, "of no one in particular", "en", "a"), (3000, "of everyone in particular\nof everyone in particular", "en", "a"), (3000, "of everyone in particular", "en", "b")]


@pytest.mark.parametrize("min_docs", [2, 4])
def test_lines_equal_brute_force(spark, min_docs):
    rows = line_rows()
    got = line_dedup.line_dedup(frame(spark, rows).withColumns({c: F.lit("clash") for c in ("h1", "h2", "pos", "line", "owner", "n_lines", "_gone", "_lines", "docs")}).repartition(4), min_docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lines_by_hand(rows, min_docs), key=str)


def test_lines_of_nothing(spark, empty):
    assert line_dedup.line_dedup(empty).collect() == []


def test_a_line_of_every_document(spark):
    """More documents than a key may have in an exchange."""
    rows = [(i, f"this line is in all of them\nthis one is in number {i} only", "en", "a") for i in range(2500)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, rows, clashes=False)).collect()}
    assert got == {i: t if i == 0 else t.split("\n")[1] for i, t, *_ in rows}


def test_lines_run_no_python(spark, messy):
    plan = line_dedup.line_dedup(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hot_join_is_an_inner_join(spark):
    r = random.Random(2)
    many = stored(spark.createDataFrame([(r.choice([1, 1, 1, 2, r.randrange(500)]), i) for i in range(6000)], "k long, x long"), "many")
    few = stored(many.filter("k % 7 <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least")), "few")
    got = sorted(map(tuple, hot_join(many, few, ["k"]).select("k", "x", "least").collect()))
    assert got == sorted(map(tuple, many.join(few, "k").select("k", "x", "least").collect()))
    assert few.filter("n > 1000").count() >= 1
