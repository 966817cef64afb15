import numpy as np

from ledgerlink.functions.encoder import HashedNgramEncoder, ngram_array
from ledgerlink.operators.vector import vector_topk


def _index(spark, rows):
    return spark.createDataFrame(
        [(o, f"owner{o}", t, f"owner{o}", 1, i, [float(x) for x in v]) for i, (o, t, v) in enumerate(rows)],
        "institution_id long, canonical_name string, text string, ord_name string, ord_alias int, ord_alias_id long, vec array<double>",
    )


def test_best_text_per_owner_then_top2_with_index_order_ties(spark):
    idx = _index(spark, [(1, "a", [1, 0]), (1, "b", [0.9, 0.1]), (2, "c", [1, 0]), (3, "d", [0, 1])])
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, vec array<double>")
    for bound in (100, 0):  # broadcast plan and blocked cogroup plan
        out = {(r.qid, r.rank): (r.institution_id, r.matched_text, round(r.score, 6))
               for r in vector_topk(q, idx, "qid", k=2, max_broadcast_rows=bound, chunk_rows=2, query_rows_per_group=1).collect()}
        assert out[(1, 1)] == (1, "a", 1.0)  # tie between owners 1 and 2 -> index order
        assert out[(1, 2)] == (2, "c", 1.0)
        assert out[(2, 1)] == (3, "d", 1.0)
        assert len(out) == 4


def test_random_vectors_both_plans_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 6)), f"t{i}", rng.normal(size=8)) for i in range(40)]
    idx = _index(spark, rows)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)], "qid long, vec array<double>")
    a = sorted(tuple(r) for r in vector_topk(q, idx, "qid", max_broadcast_rows=1000).select("qid", "rank", "institution_id", "matched_text").collect())
    b = sorted(tuple(r) for r in vector_topk(q, idx, "qid", max_broadcast_rows=0, chunk_rows=7, query_rows_per_group=10).select("qid", "rank", "institution_id", "matched_text").collect())
    assert a == b and len(a) == 60


def test_encoder_udf_equals_native_and_python(spark):
    texts = ["농협은행", "NH Bank", "", "a", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    enc = HashedNgramEncoder(dim=16)
    u = {r.text: r.vec for r in enc.encode(df, "text").collect()}
    n = {r.text: r.vec for r in enc.encode_native(df, "text").collect()}
    for t in texts:
        assert np.allclose(u[t], n[t]) and np.allclose(u[t], ngram_array(t, 16))
    assert np.isclose(np.linalg.norm(u["농협은행"]), 1.0)
    assert not any(u[""])


def test_scoring_in_slices_matches_one_matrix(monkeypatch):
    import ledgerlink.operators.vector as V

    rng = np.random.default_rng(9)
    q, idx = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    owners = rng.integers(0, 5, size=30)
    whole = V._topk_owners(q, idx, owners, 2)
    monkeypatch.setattr(V, "SCORE_CELLS", 61)  # two query rows per slice
    sliced = V._topk_owners(q, idx, owners, 2)
    assert (whole[0] == sliced[0]).all() and np.allclose(whole[1], sliced[1])


def _both_plans(spark, rows, queries, **kw):
    idx, q = _index(spark, rows), spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, vec array<double>")
    cols = ["qid", "rank", "institution_id", "matched_text", "score"]
    return [sorted(tuple(r) for r in vector_topk(q, idx, "qid", max_broadcast_rows=b, chunk_rows=9, query_rows_per_group=20, **kw).select(*cols).collect()) for b in (1000, 0)]


def test_cells_keep_ties_zero_vectors_and_lengths(spark):
    """Not normalised, with zero rows and queries, copies, and one owner holding most rows."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 6))
    rows = [(0 if i % 3 else int(rng.integers(0, 7)), f"t{i}", rng.uniform(0.1, 3) * (centres[i % 5] + 0.05 * rng.normal(size=6))) for i in range(120)]
    rows += [(8, "zero", np.zeros(6)), (9, "zero too", np.zeros(6)), (3, "copy", rows[4][2]), (2, "copy too", rows[4][2])]
    queries = [*(c + 0.1 * rng.normal(size=6) for c in centres for _ in range(6)), np.zeros(6), -centres[0], rows[4][2]]
    for k in (1, 2, 20):  # 20: more than there are owners
        small, large = _both_plans(spark, rows, queries, k=k)
        assert small == large and len(small) == len(queries) * min(k, len({r[0] for r in rows}))


def _scored_share(spark, q, idx, vec_col="vec", query_id="vec_id"):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerlink.operators import vector_cells as VC
    from ledgerlink.operators.lookup import ORDER_COLS

    placed, cells = VC.build(idx.select("institution_id", *ORDER_COLS, vec_col), vec_col)
    top = vector_topk(q, idx, query_id, k=2)
    least = top.where("rank = 2").select(query_id, F.col("score").alias("least"))  # what home cells can tell at best
    asked = VC.home_cells(q, cells, query_id, vec_col).unionByName(VC.other_cells(q, least, cells, query_id, vec_col))
    sizes = spark.createDataFrame(cells.stats[["cell", "n"]])
    assert asked.groupBy(query_id, "cell").count().where("count > 1").count() == 0
    return asked.join(sizes, "cell").agg(F.sum("n")).first()[0] / (q.count() * idx.count())


def test_few_cells_are_scored(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    idx = _index(spark, [(i % 30, f"t{i}", centres[i % 30] + 0.1 * rng.normal(size=16)) for i in range(900)])
    q = spark.createDataFrame([(i, [float(x) for x in centres[i % 30] + 0.1 * rng.normal(size=16)]) for i in range(60)], "vec_id long, vec array<double>")
    share = _scored_share(spark, q, idx)
    assert share < 0.7, share


def test_share_of_scored_cells_on_the_embeddings(spark):
    from ledgerlink.plans.queries import _emb_split

    share = _scored_share(spark, *_emb_split(spark, "/root/testdata/sf0.01"))
    assert share < 1.0, share


def test_batched_ngram_counts_equal_the_rule():
    from ledgerlink.functions.encoder import _unit, ngram_counts

    texts = ["농협은행", "NH Bank", "", None, "a", "ab", "🙂x", "농협은행"]
    for dim in (16, 512):
        assert np.allclose(_unit(ngram_counts(texts, dim)), [ngram_array(t, dim) for t in texts])
    assert ngram_counts([], 8).shape == (0, 8)


def test_fitted_encoder_is_the_span_of_the_masters_texts(spark, seed):
    """Weights and Gram matrix against numpy; names keep their own direction."""
    from ledgerlink.functions.encoder import FittedEncoder, _unit, gram_matrix, ngram_counts
    from ledgerlink.operators.lookup import build_vector_index

    texts = [r.text for r in build_vector_index(*seed).collect()]
    enc = FittedEncoder.fit(*seed, dim=256)
    counts = ngram_counts(texts, 256)
    df = (counts > 0).sum(axis=0)
    assert np.allclose(enc.weights, np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 0))
    x = _unit(counts * enc.weights)
    index = build_vector_index(*seed).repartition(5)
    assert np.allclose(gram_matrix(index, "text", enc.weights), x.T @ x)
    own = enc.vectors(texts)
    assert np.allclose(own @ own.T, x @ x.T)  # full rank: the span keeps every cosine
    few = FittedEncoder.fit(*seed, dim=256, rank=4)
    assert few.projection.shape == (256, 4)
    assert not FittedEncoder.fit(*seed).vectors(["전혀 다른", "", None]).any()
    got = enc.encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert np.allclose([r.vec for r in got], enc.vectors([r.text for r in got]))


def test_fitted_encoder_confirms_a_typo_that_fuzzy_refuses(spark, seed):
    from ledgerlink.functions.encoder import FittedEncoder
    from ledgerlink.plans.queries import TYPO_ROWS
    from ledgerlink.plans.resolve import resolve

    df = spark.createDataFrame([(v, c) for v, c, _ in TYPO_ROWS], "vendor string, ctx string")
    plain = {r.vendor: r for r in resolve(df, "vendor", *seed, context_col="ctx").collect()}
    assert all(r.review_status == "NEEDS_REVIEW" for r in plain.values())
    got = {r.vendor: r for r in resolve(df, "vendor", *seed, context_col="ctx", encoder=FittedEncoder.fit(*seed)).collect()}
    confirmed = {v: r.canonical_institution for v, r in got.items() if r.review_status == "AUTO"}
    assert confirmed == {v: t for v, _, t in TYPO_ROWS if t}
    assert got["NH농헙은행"].normalization_method == "CONTEXT_RERANK"
    assert "Negative keywords" in got["농협은헹"].reason
