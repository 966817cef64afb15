"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link when they differ in at most ``max_bits`` bits.  Their 64 bits
are grouped into ``m`` partitions, correlated bits together, and partition i
gets a threshold t_i >= -1 with the sum max_bits - m + 1: two fingerprints
within max_bits then differ in at most t_i bits in some partition i, so probing
each partition within its own threshold finds every link.  A dynamic program
allots the thresholds (and m) by the number of probes and of candidates that
they are estimated to cost, from bit statistics over all fingerprints.
Candidates are verified on all 64 bits inside the join.

Only distinct fingerprints are probed, so copies never form pairs.  Components
come from alternating large-star and small-star steps on the links.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; rows that repeat a doc_id are
fingerprinted each; a null doc_id is never a component's id unless it is alone;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlink.llm.common import ROW, release, text_of
from ledgerlink.session import cut_lineage

BITS = 64
#: A candidate pair is taken to cost as much as so many probes.
PAIR_COST = 8


# -- fingerprints -------------------------------------------------------------

def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The majority of each bit over the XXH64 of all word shingles, repeats included."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):  # bounded memory for long texts
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the row's key where it has one; a narrow pass over the texts."""
    key = [ROW] if ROW in docs.columns else []

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *key])

    schema = "doc_id long, fp long" + "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in key)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *key).mapInArrow(run, schema)


# -- partitions and thresholds ------------------------------------------------

def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j both set, over all of
    them: a matrix product a batch, then sums of at most 2,080 counters."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b["fp"].to_numpy().view(np.uint64)
            x = (v[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
            total, n = total + x.T @ x, n + len(v)
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, k in rows:
        if i < 0:
            n = k
        else:
            both[i, j] = both[j, i] = k
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of nearly equal size: each starts with the most correlated
    free pair and takes the free bit that goes best with those it has."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(r, -1)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        order = sorted(free)
        sub = r[np.ix_(order, order)]
        group = [order[int(np.argmax(sub)) // len(order)]]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (r[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def pair_share(agree: np.ndarray, t: int) -> float:
    """Share of pairs that differ in at most ``t`` of the bits with these chances to agree."""
    dist = np.zeros(t + 2)
    dist[0] = 1
    for a in agree:
        dist[1 : t + 1] = dist[1 : t + 1] * a + dist[:t] * (1 - a)
        dist[0] *= a
    return float(dist[: t + 1].sum())


def n_probes(width: float, t: int) -> float:
    """Probes of a fingerprint in one partition (see ``_masks``)."""
    return 0 if t < 0 else 1 if t == 0 else 1 + width / 2 if t == 1 else sum(math.comb(int(width), k) for k in range(t + 1))


def allot(n: int, both: np.ndarray, max_bits: int = 3, choices: tuple[int, ...] = (2, 3)) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost.

    cost(i, t) = probes + ``PAIR_COST`` x candidate pairs of partition i within t;
    the dynamic program runs over partitions and the thresholds' sum.
    """
    p = both.diagonal() / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best = None
    for m in choices:
        groups = group_bits(n, both, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of (t + 1) -> cost, thresholds
        for g in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for t in range(-1, max_bits - used + 1):
                    c = cost + n * n_probes(len(g), t) + (PAIR_COST * n * n / 2 * pair_share(agree[g], t) if t >= 0 else 0)
                    if used + t + 1 not in step or c < step[used + t + 1][0]:
                        step[used + t + 1] = c, [*ts, t]
            table = step
        cost, ts = table[max_bits + 1]
        if best is None or cost < best[0]:
            best = cost, groups, ts
    return best[1], best[2]


# -- links --------------------------------------------------------------------

def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _masks(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in itertools.combinations(bits, k)]


def _flipped(part: int, key: Column, t: int):
    return lambda m: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(m).alias("key"), F.lit(t > 1).alias("ordered"))


def links(fps: DataFrame, groups: list[list[int]], thresholds: list[int], max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``max_bits`` bits.

    Probes of threshold 1 only clear bits: of two keys that differ in one bit,
    the one that has it finds the other.  Larger thresholds flip bits both
    ways and keep a < b.  Both sides of the join are exchanged by (partition,
    key), and verification is part of the join's condition.
    """
    index, probes = [], []
    for k, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in g))))
        index.append(F.struct(F.lit(k).alias("part"), key.alias("key")))
        own = F.struct(F.lit(k).alias("part"), key.alias("key"), F.lit(True).alias("ordered"))
        probes.append(F.array(own))
        if t:
            masks = F.lit(_masks(g, t)).cast("array<bigint>")
            if t == 1:
                masks = F.filter(masks, lambda m: F.col("fp").bitwiseAND(m) != 0)
            probes.append(F.transform(masks, _flipped(k, key, t)))
    right = fps.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("i")).select("b", "i.part", "i.key")
    left = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("p")).select("a", "p.part", "p.key", "p.ordered")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    joined = left.join(right, (left["part"] == right["part"]) & (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & near & (~F.col("ordered") | (F.col("a") < F.col("b"))))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- components ---------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node that has an edge (a, b).

    Each round: every node points its larger neighbours to its smallest one
    (large star), then its smaller ones (small star).  A node's smallest
    neighbour is a partial aggregate; the join with it splits at hot nodes.
    Ends when a round changes nothing (O(log^2 n) rounds); edges that already are
    stars, the usual case, take one round, and no edges take none.
    Each job leaves garbage on the driver, so a round is one checkpoint: it counts
    its edges as it writes them, and only its end makes them distinct (the large
    star has no more rows than there are edges).
    """
    edges, state = _counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["w"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, large["u"] == least["w"]).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        seen = state
        edges, state = _counted(small.filter("u != v").distinct())
        if state == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` checkpointed, with their number and the sum of their hashes from the same job."""
    seen = Observation(f"edges_{uuid.uuid4().hex[:12]}")
    out = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get["n"], seen.get["sum"])


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable); with
    the key of each row where ``docs`` has keys, and ``kept``: true for one row of each
    component, the one with the smallest doc_id (null ids last), then key."""
    rows = cut_lineage(fingerprints(docs, shingle, seed))
    keyed = ROW in rows.columns
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW) if keyed else F.col("doc_id")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("first")))
    n, both = bit_counts(nodes)
    groups, thresholds = allot(n, both, max_bits)
    roots = components(links(nodes, groups, thresholds, max_bits))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # a root may stand for many fingerprints, and a fingerprint for many rows; both joins split there
    named = cut_lineage(placed.join(ids, "root").select("fp", "component_id"))
    named = rows.join(named, "fp")
    if keyed:
        first = F.col("component_id")
        return named.select("doc_id", "fp", hex16("fp").alias("fingerprint"), first["doc_id"].alias("component_id"), ROW, (F.col(ROW) == first[ROW]).alias("kept"))
    return named.select("doc_id", "fp", hex16("fp").alias("fingerprint"), "component_id")


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
