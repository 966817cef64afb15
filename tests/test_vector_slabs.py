import numpy as np
import pytest

from ledgerlink.operators import vector_cells as VC
from ledgerlink.operators.lookup import ORDER_COLS
from ledgerlink.operators.vector import vector_topk

INDEX = "institution_id long, canonical_name string, text string, ord_name string, ord_alias int, ord_alias_id long, vec array<double>"


def _frames(spark, rows, queries):
    idx = spark.createDataFrame([(o, f"owner{o}", f"t{i}", f"owner{o}", 1, i, [float(x) for x in v]) for i, (o, v) in enumerate(rows)], INDEX)
    return idx, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, vec array<double>")


def _brute(rows, queries, k):
    out = set()
    for q, v in enumerate(queries):
        best = {}
        for i, (o, w) in enumerate(rows):
            best.setdefault(o, []).append((-round(float(np.dot(v, w)), 10), f"owner{o}", i))
        for rank, (s, _, i) in enumerate(sorted(min(x) for x in best.values())[:k], 1):
            out.add((q, rank, rows[i][0], f"t{i}", round(-s, 9)))
    return out


@pytest.mark.parametrize("slab", [7, 40, 1000])
def test_slabs_give_the_exact_owners(spark, monkeypatch, slab):
    """Cells larger than a slab, copies, zero rows, a null owner; buckets of a few queries."""
    monkeypatch.setattr(VC, "SLAB_ROWS", slab)
    monkeypatch.setattr(VC, "BUCKET_ROWS", 11)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 5)) or None, rng.normal(size=12)) for _ in range(90)] + [(6, np.zeros(12))]
    rows += [(7, rows[0][1])] * 12
    queries = [*rng.normal(size=(40, 12)), rows[0][1], np.zeros(12)]
    idx, q = _frames(spark, rows, queries)
    for k in (1, 2, 9):
        got = vector_topk(q, idx, "qid", k=k, max_broadcast_rows=0, chunk_rows=4, query_rows_per_group=3).collect()
        assert {(r.qid, r["rank"], r.institution_id, r.matched_text, round(r.score, 9)) for r in got if r.qid != 41} == {x for x in _brute(rows, queries, k) if x[0] != 41}
        assert len(got) == len(queries) * min(k, 7)


def test_a_query_goes_once_to_a_slab(spark):
    """Random vectors of many dimensions, where bounds exclude no cell: a copy a slab, not a copy a cell."""
    rng = np.random.default_rng(5)
    idx, q = _frames(spark, [(i % 10, rng.normal(size=64)) for i in range(900)], rng.normal(size=(50, 64)))
    _, cells = VC.build(idx.select("institution_id", *ORDER_COLS, "vec"), "vec")
    slabs = VC.Slabs(cells, 300)
    assert slabs.number <= 6 and sorted(c for s in range(slabs.number) for c in range(len(cells.cell))[slabs.cells_of(s)]) == list(range(len(cells.cell)))
    least = q.selectExpr("qid", "-1.0D AS least")
    asked = VC.other_cells(q, least, cells, "qid", "vec", slabs)
    assert asked.count() == asked.select("qid", "slab").distinct().count() == 50 * slabs.number
    assert VC.home_cells(q, cells, "qid", "vec", slabs).count() <= 50 * VC.HOME
    assert VC.other_cells(q, least, cells, "qid", "vec").count() > 4 * asked.count()
