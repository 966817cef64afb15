"""Cheapest repairs of conversations' turn structure, over a suffix-shared automaton.

A conversation's *signature* has a letter a row, for its role and fault.  Signatures
are dealt by range in the order of their reversals, so those with a common ending lie
side by side and share the automaton's nodes for it: a task keeps the nodes of
the current ending only, cuts them back to what the next signature shares and adds
its further letters.  A node has, for each state of the grammar, the cost to go
and the first edit of the best audit; nodes that agree in these up to a constant are
one (the automaton is minimal, and finite), and each is worked out once.  As the
edits possible in a state begin with different letters, the first letter settles
ties, so an audit is read by following first edits.

The grammar of role initials is ``(s?(ua)+)?``.  Edits: Keep (0), Rerole to
the role that the grammar has next, user or assistant (1), Delete (2; the only one for blank and
repeated rows), Insert an empty user or assistant row (5); a truncated row that stays
costs 5 more.  Of the cheapest edits the ASCII-least audit counts.

Texts are exchanged once, to apply the audits.  Conversations are read as sorted
rows, never as groups: a task holds a byte a row of one conversation (its signature)
and its audit, whatever the texts' lengths.

Defined cases: null ids, roles and texts count as one space (so such a text is blank);
rows are ordered by turn (null first), equal turns by a digest of role and text; an
empty role can't be kept, whatever the grammar; rows with a null conv_id
form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlink.llm.common import shuffle_partitions, stored

#: ASCII white space, by character.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: at the start, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> role that must come next (at the start a system row may, too), and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _known(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive, copy: the rows after damage by
    crc32(conv_id:turn) modulo 20; dropped ones stay with ``alive`` false."""
    code = F.crc32(F.concat(_known("conv_id"), F.lit(":"), _known("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _known("role").alias("role"), _known("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") != 0).alias("alive"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, alive) with d1, d2: 128 bits of role and text."""
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumns({"d1": F.xxhash64(whole), "d2": F.xxhash64(F.lit(1), whole)})


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, alive, d1, d2, nth, initial, fault: each row's role initial (o for
    others) and first fault (b blank, d duplicate, t truncated, - none)."""
    bare = F.btrim(F.col("text"), F.lit(SPACE))
    nth = F.row_number().over(W.partitionBy("conv_id", "alive", "d1", "d2").orderBy(F.col("turn").asc_nulls_first()))
    initial = F.left("role", F.lit(1))
    own = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    seen = _told(rows).select("conv_id", "turn", "alive", "d1", "d2", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), own.alias("own"))
    dealt = seen.repartition(shuffle_partitions(rows.sparkSession), "conv_id").withColumn("nth", nth)
    return dealt.withColumn("fault", F.when((F.col("own") != "b") & (F.col("nth") > 1), "d").otherwise(F.col("own"))).drop("own")


_LEGAL = {"su", "ua", "au"}


def _signatures(batches: Iterator) -> Iterator:
    """Rows by conversation, in order: one signature and its figures each."""
    import pyarrow as pa

    names, types = ["conv_id", "signature", *COLUMNS], [pa.int64(), pa.string(), *[pa.int64()] * len(COLUMNS)]
    begun, conv, letters, turns, count, before = False, None, bytearray(), [None, None, 0], {}, ""

    def ended() -> tuple:
        first, last, distinct = turns
        gaps = 0 if first is None else last - first + 1 - distinct
        return (conv, letters.decode(), gaps, *(count.get(k, 0) for k in "bdt"), count.get("illegal", 0))

    for b in batches:
        done = []
        for c, turn, alive, initial, fault in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "alive", "initial", "fault")), strict=True):
            if not begun or c != conv:
                if begun:
                    done.append(ended())
                begun, conv, letters, turns, count, before = True, c, bytearray(), [None, None, 0], {}, ""
            if not alive:
                continue
            letters += (b"x" if fault in "bd" else initial.upper().encode() if fault == "t" else initial.encode())
            count[fault] = count.get(fault, 0) + 1
            if before and before + initial not in _LEGAL:
                count["illegal"] = count.get("illegal", 0) + 1
            before = initial
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * len(names), types, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(ended(), types, strict=True)], names)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal: one row a conversation."""
    order = ["conv_id", "turn", "d1", "d2", "nth"]
    ordered = faults(rows).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return ordered.select("conv_id", "turn", "alive", "initial", "fault").mapInArrow(_signatures, "conv_id long, signature string, " + ", ".join(f"{c} long" for c in COLUMNS))


class Automaton:
    """Nodes of the minimal automaton of signature endings.

    ``costs[k]`` has, for each grammar state, the cost to go from node k less that
    from its cheapest state, ``first[k]`` the edit to begin with there.
    """

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.first: list[tuple[str, ...]] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.end, self.end_cost = self._node({s: [(0, "")] if s in (START, ASSISTANT) else [] for s in NEXT})

    def _node(self, options: dict[int, list[tuple[int, str]]]) -> tuple[int, int]:
        """Node and cost of its cheapest state, from the edits that take a row (or end)."""
        best = {s: min(o, default=(1 << 40, "~")) for s, o in options.items()}
        for _ in range(2):  # a second inserted row is the last that can be of use
            best = {s: min(best[s], (best[NEXT[s][1]][0] + INSERT, "I")) for s in NEXT}
        least = min(c for c, _ in best.values())
        key = tuple((best[s][0] - least, best[s][1]) for s in sorted(NEXT))
        if key not in self.known:
            self.known[key] = len(self.costs)
            self.costs.append(tuple(c for c, _ in key))
            self.first.append(tuple(e for _, e in key))
        return self.known[key], least

    def step(self, node: int, letter: str) -> tuple[int, int]:
        """The node for ``letter`` and then what ``node`` stands for, and what it costs more."""
        got = self.steps.get((node, letter))
        if got is None:
            to, options = self.costs[node], {}
            extra = TRUNCATED if letter.isupper() else 0
            for s, (role, after) in NEXT.items():
                options[s] = [(to[s] + DELETE, "D")]
                if letter != "x":
                    same = letter.lower() == role[0]
                    options[s].append((to[after] + extra + (KEEP if same else REROLE), "K" if same else "R"))
                    if s == START and letter.lower() == "s":
                        options[s].append((to[SYSTEM] + extra + KEEP, "K"))
            got = self.steps[node, letter] = self._node(options)
        return got


def after(state: int, edit: str, letter: str) -> int:
    """The grammar state after an edit (of a row with ``letter``, but for an insertion)."""
    if edit == "D":
        return state
    return SYSTEM if edit == "K" and state == START and letter.lower() == "s" else NEXT[state][1]


class Ending:
    """The nodes of one signature's endings, from the empty one on."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.letters = ""  # the signature's reversal
        self.nodes, self.cost = array("q", [self.automaton.end]), array("q", [self.automaton.end_cost])

    def move(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature, from the nodes of the last one's shared ending."""
        letters = signature[::-1]
        if letters != self.letters:
            same = _common(letters, self.letters)
            del self.nodes[same + 1 :], self.cost[same + 1 :]
            node, cost = self.nodes[-1], self.cost[-1]
            for x in letters[same:]:
                node, more = self.automaton.step(node, x)
                cost += more
                self.nodes.append(node)
                self.cost.append(cost)
            self.letters = letters
        state, k, audit = START, len(letters), []
        total = self.cost[k] + self.automaton.costs[self.nodes[k]][START]
        while edit := self.automaton.first[self.nodes[k]][state]:
            audit.append(edit)
            state = after(state, edit, letters[k - 1] if k else "")
            k -= edit != "I"
        return total, "".join(audit)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] is common
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _audits(batches: Iterator) -> Iterator:
    import pyarrow as pa

    ending = Ending()
    for b in batches:
        got = [ending.move(s) for s in b.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], [*b.schema.names, "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """``signed`` (see ``signatures``) with cost and audit.  Equal signatures are dealt on by
    conversation, so none fills a task."""
    order = [F.reverse("signature"), F.col("conv_id")]
    dealt = signed.repartitionByRange(shuffle_partitions(signed.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_audits, "conv_id long, signature string, " + ", ".join(f"{c} long" for c in [*COLUMNS, "cost"]) + ", audit string")


class Repair:
    """Applies one audit, row by row: (edit, role, text) of what there is to see."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield "I", NEXT[self.state][0], ""
            self.at, self.state = self.at + 1, NEXT[self.state][1]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        if edit != "D":
            yield edit, NEXT[self.state][0] if edit == "R" else role, text
        self.at, self.state = self.at + 1, after(self.state, edit, role[:1] if role[:1] in ("s", "u", "a") else "o")

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _headed(rows: DataFrame, plans: DataFrame, figures: list[str]) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one partition."""
    told = _told(rows).filter("alive").select("conv_id", F.lit(1).alias("kind"), "turn", "d1", "d2", "role", "text")
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.struct(*figures, "audit").alias("plan"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "d1", "d2")]
    both = heads.unionByName(told, allowMissingColumns=True)
    return both.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "plan", "role", "text")


def _read(b) -> Iterator[tuple]:
    for at in range(0, b.num_rows, 1000):
        part = b.slice(at, 1000)
        yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "plan", "role", "text")), strict=True)


def _digests(names: list[str]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(done: list[dict]) -> pa.RecordBatch:
            types = [pa.int64(), *[pa.string() if c == "audit" else pa.int64() for c in names], pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in zip(["conv_id", *names, "repaired_sha256"], types, strict=True)], ["conv_id", *names, "repaired_sha256"])

        plan, repair, state, empty = None, None, None, True

        def add(turns: Iterator) -> None:
            nonlocal empty
            for _, role, text in turns:
                state.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False

        def ended() -> dict:
            add(repair.rest())
            return plan | {"repaired_sha256": state.hexdigest()}

        for b in batches:
            done = []
            for conv, kind, head, role, text in _read(b):
                if kind == 0:
                    if plan:
                        done.append(ended())
                    plan, repair, state, empty = head | {"conv_id": conv}, Repair(head["audit"]), hashlib.sha256(), True
                else:
                    add(repair.row(role, text))
            yield made(done)
        if plan:
            yield made([ended()])

    return run


def _repaired_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def made(done: list[tuple]) -> pa.RecordBatch:
        types, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "turn", "edit", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * 5, types, strict=True)], names)

    conv, repair, n = None, None, 0
    for b in batches:
        done: list[tuple] = []
        for c, kind, head, role, text in _read(b):
            turns = repair.rest() if kind == 0 and repair else repair.row(role, text) if kind else ()
            for turn in turns:
                done.append((conv, n, *turn))
                n += 1
            if kind == 0:
                conv, repair, n = c, Repair(head["audit"]), 0
        yield made(done)
    if repair:
        yield made([(conv, n + i, *turn) for i, turn in enumerate(repair.rest())])


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, signature, figures, cost and audit: one row a conversation of ``rows``
    (conv_id, turn, role, text, alive; rows that aren't alive only name it)."""
    return audits(stored(signatures(rows), "signatures"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of the repaired ``role:text``, joined by line ends)."""
    names = [*COLUMNS, "cost", "audit"]
    schema = "conv_id long, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in names) + ", repaired_sha256 string"
    return _headed(rows, plans(rows), names[:-1]).mapInArrow(_digests(names), schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), edit (K, R or I), role, text of the repaired conversations."""
    return _headed(rows, plans(rows), []).mapInArrow(_repaired_rows, "conv_id long, turn long, edit string, role string, text string")
