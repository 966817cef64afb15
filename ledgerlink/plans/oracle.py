"""Oracle SQL (DuckDB dialect) for every registered query that SQL can express.

The SQL is an independent formulation: brute force over all (vendor, key)
pairs instead of blocking, an LCS by the bit-parallel recurrence over 128-bit
integers instead of the Python UDF, sparse n-gram counts instead of dense
vectors.  Fixed values (templates, seeded master, cases) are rendered from
the same constants the library uses.
"""

from __future__ import annotations

from ledgerlink.schema import EMBEDDING_FLOOR, FUZZY_AUTO_THRESHOLD, FUZZY_DISABLED_THRESHOLD, MIN_SCORE_MARGIN
from ledgerlink.sources.journal import EVALUATION_CASES, TEMPLATES, TOTAL_WEIGHT
from ledgerlink.sources.master import seed_rows


def lit(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def mkey(x: str) -> str:
    return f"upper(regexp_replace({x}, '\\s+', '', 'g'))"


# ------------------------------------------------------------------ WRatio
def _full(p):
    return f"((1::HUGEINT << length({p})) - 1)"


def _mask(p, c):
    return (
        f"coalesce(list_sum(list_transform(range(length({p})), lambda mi: "
        f"CASE WHEN substr({p}, mi + 1, 1) = {c} THEN (1::HUGEINT << mi) ELSE 0::HUGEINT END)), 0::HUGEINT)"
    )


def lcs(p, t):
    m = _mask(p, "lc")
    return (
        f"(length({p}) - bit_count(list_reduce(string_split({t}, ''), lambda lv, lc: "
        f"(((lv + (lv & {m})) | (lv - (lv & {m}))) & {_full(p)}), {_full(p)})))"
    )


def ratio(p, t):
    return f"((1.0 - (length({p}) + length({t}) - 2 * {lcs(p, t)}) / (length({p}) + length({t}))) * 100.0)"


def partial(s, l):
    wins = (
        f"list_concat(list_concat("
        f"list_transform(range(1, length({s})), lambda wi: substr({l}, 1, wi)), "
        f"list_transform(range(0, length({l}) - length({s}) + 1), lambda wi: substr({l}, wi + 1, length({s})))), "
        f"list_transform(range(length({l}) - length({s}) + 1, length({l})), lambda wi: substr({l}, wi + 1)))"
    )
    return f"list_max(list_transform({wins}, lambda ww: {ratio(s, 'ww')}))"


def wratio(s, l):
    """s: the shorter key, l: the longer key (columns)."""
    q = f"(length({l}) / length({s}))"
    return (
        f"(CASE WHEN length({s}) = 0 THEN 0.0 WHEN {s} = {l} THEN 100.0 "
        f"WHEN {q} < 1.5 THEN {ratio(s, l)} "
        f"ELSE greatest({ratio(s, l)}, {partial(s, l)} * (CASE WHEN {q} <= 8.0 THEN 0.9 ELSE 0.6 END)) END)"
    )


# ------------------------------------------------------------------ sources
def templates_cte() -> str:
    rows, lo = [], 0
    for i, (v, d, a, c, w) in enumerate(TEMPLATES):
        rows.append(f"({i}, {lit(v)}, {lit(d)}, {lit(a)}, {lit(c)}, {lo}, {lo + w})")
        lo += w
    return "tpl(t, vendor, description, account, counter_account, lo, hi) AS (VALUES " + ", ".join(rows) + ")"


def journal_cte() -> str:
    pick = f"((l_orderkey * 7 + l_linenumber) % {TOTAL_WEIGHT})"
    return (
        templates_cte()
        + ", journal AS (SELECT 'V' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS voucher_no, "
        "CAST(l_shipdate AS DATE) AS voucher_date, t.vendor, t.description, t.account, t.counter_account, "
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, "
        "t.vendor || ' | ' || t.description || ' | ' || t.account || ' | ' || t.counter_account AS context_text "
        f"FROM lineitem JOIN tpl t ON {pick} >= t.lo AND {pick} < t.hi)"
    )


def eval_cte() -> str:
    rows = [
        f"({i}, {lit(v)}, {lit(c)}, {lit(lbl)})" for i, (v, c, lbl) in enumerate(EVALUATION_CASES)
    ]
    n = len(EVALUATION_CASES)
    return (
        "cases(ci, vendor, context_text, true_label) AS (VALUES " + ", ".join(rows) + "), "
        "ev AS (SELECT 'V' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS voucher_no, "
        f"c.vendor, c.context_text, c.true_label FROM lineitem JOIN cases c ON ((l_orderkey * 7 + l_linenumber) % {n}) = c.ci)"
    )


def seed_master_cte() -> str:
    m, a = seed_rows()
    mrows = ", ".join(
        f"(CAST({i} AS BIGINT), {lit(n)}, {lit(t)}, {lit(e)}, {lit(k)}, {lit(nk)}, {lit(act)})" for i, n, t, e, k, nk, act in m
    )
    arows = ", ".join(
        f"(CAST({aid} AS BIGINT), CAST({iid} AS BIGINT), {lit(txt)}, {lit(typ)}, {lit(act)})" for aid, iid, txt, _n, typ, act in a
    )
    return (
        f"master(institution_id, canonical_name, institution_type, english_name, keywords, negative_keywords, active) AS (VALUES {mrows}), "
        f"alias(alias_id, institution_id, alias_text, alias_type, active) AS (VALUES {arows})"
    )


def supplier_master_cte() -> str:
    return (
        "master AS (SELECT CAST(s_suppkey AS BIGINT) AS institution_id, s_name AS canonical_name, "
        "['BANK','SECURITIES','INSURANCE','OTHER'][(s_nationkey % 4) + 1] AS institution_type, "
        "CAST(NULL AS VARCHAR) AS english_name, CAST(NULL AS VARCHAR) AS keywords, CAST(NULL AS VARCHAR) AS negative_keywords, "
        "s_acctbal >= 0 AS active FROM supplier), "
        "alias AS (SELECT (CAST(li.l_suppkey AS BIGINT) << 32) + li.l_partkey AS alias_id, CAST(li.l_suppkey AS BIGINT) AS institution_id, "
        "p_name AS alias_text, ['ALIAS','ABBREVIATION','ENGLISH','TYPO', NULL][(li.l_partkey % 5) + 1] AS alias_type, "
        "(li.l_partkey % 7) <> 0 AS active FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) li JOIN part ON li.l_partkey = p_partkey)"
    )


def part_master_cte() -> str:
    return (
        "master AS (SELECT CAST(min(p_partkey) AS BIGINT) AS institution_id, p_name AS canonical_name, 'OTHER' AS institution_type, "
        "CAST(NULL AS VARCHAR) AS english_name, CAST(NULL AS VARCHAR) AS keywords, CAST(NULL AS VARCHAR) AS negative_keywords, "
        "TRUE AS active FROM part GROUP BY p_name), "
        "alias AS (SELECT CAST(NULL AS BIGINT) AS alias_id, CAST(NULL AS BIGINT) AS institution_id, CAST(NULL AS VARCHAR) AS alias_text, "
        "CAST(NULL AS VARCHAR) AS alias_type, FALSE AS active WHERE FALSE)"
    )


def noisy_vendors_cte() -> str:
    k = "(p_partkey % length(p_name))"
    return (
        "nv AS (SELECT p_partkey, CASE p_partkey % 6 "
        "WHEN 0 THEN p_name "
        "WHEN 1 THEN p_name || ' branch ' || CAST(p_partkey % 10 AS VARCHAR) "
        f"WHEN 2 THEN substr(p_name, 1, {k}) || substr(p_name, {k} + 2) "
        f"WHEN 3 THEN CASE WHEN {k} + 1 >= length(p_name) THEN p_name ELSE "
        f"substr(p_name, 1, {k}) || substr(p_name, {k} + 2, 1) || substr(p_name, {k} + 1, 1) || substr(p_name, {k} + 3) END "
        "WHEN 4 THEN p_brand || ' ' || p_name "
        "ELSE p_type END AS vendor, CASE WHEN p_partkey % 6 = 5 THEN CAST(NULL AS VARCHAR) ELSE p_name END AS true_label FROM part)"
    )


def lookup_cte() -> str:
    return (
        "entries AS (SELECT institution_id, canonical_name, canonical_name AS text, 'CANONICAL' AS match_source, "
        "canonical_name AS ord_name, 0 AS ord_alias, CAST(-1 AS BIGINT) AS ord_alias_id FROM master WHERE active "
        "UNION ALL SELECT a.institution_id, m.canonical_name, a.alias_text, coalesce(a.alias_type, 'ALIAS'), m.canonical_name, 1, a.alias_id "
        "FROM alias a JOIN master m ON a.institution_id = m.institution_id WHERE a.active AND m.active), "
        f"lookup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord_name, ord_alias, ord_alias_id) AS rn "
        f"FROM (SELECT *, text AS match_text, {mkey('text')} AS key FROM entries)) WHERE rn = 1)"
    )


def fast_cte(vendors_sql: str, threshold: float, p: str = "") -> str:
    """{p}fast(vendor, <10 result columns>) for the distinct vendors of ``vendors_sql`` (column vendor).

    ``p`` prefixes every CTE name so two cascades can share one WITH clause.
    """
    th = repr(float(threshold))
    return (
        f"{p}vk AS (SELECT DISTINCT vendor, {mkey('vendor')} AS vkey FROM ({vendors_sql}) WHERE vendor IS NOT NULL), "
        f"{p}keys AS (SELECT DISTINCT vkey FROM {p}vk), "
        f"{p}ex AS (SELECT k.vkey, l.institution_id, l.canonical_name, l.match_text, l.match_source FROM {p}keys k LEFT JOIN lookup l ON k.vkey = l.key), "
        f"{p}fp AS (SELECT e.vkey, l.key, l.institution_id, l.canonical_name, l.match_text, l.ord_name, l.ord_alias, l.ord_alias_id, "
        "CASE WHEN length(e.vkey) <= length(l.key) THEN e.vkey ELSE l.key END AS s_, "
        "CASE WHEN length(e.vkey) <= length(l.key) THEN l.key ELSE e.vkey END AS l_ "
        f"FROM {p}ex e CROSS JOIN lookup l WHERE e.match_source IS NULL), "
        f"{p}fs AS (SELECT *, {wratio('s_', 'l_')} AS score FROM {p}fp), "
        f"{p}fr AS (SELECT *, row_number() OVER (PARTITION BY vkey ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS rnk FROM {p}fs), "
        f"{p}top AS (SELECT vkey, max(CASE WHEN rnk = 1 THEN score END) AS s1, max(CASE WHEN rnk = 1 THEN match_text END) AS m1, "
        "max(CASE WHEN rnk = 1 THEN canonical_name END) AS c1, max(CASE WHEN rnk = 1 THEN institution_id END) AS i1, "
        "max(CASE WHEN rnk = 2 THEN score END) AS s2, max(CASE WHEN rnk = 2 THEN canonical_name END) AS c2, "
        f"max(CASE WHEN rnk = 2 THEN 1 ELSE 0 END) AS has2 FROM {p}fr WHERE rnk <= 2 GROUP BY vkey), "
        f"{p}fastk AS (SELECT ex.vkey, "
        f"CASE WHEN ex.match_source IS NOT NULL THEN ex.match_text WHEN t.s1 >= {th} THEN t.m1 END AS normalized_expression, "
        f"CASE WHEN ex.match_source IS NOT NULL THEN ex.canonical_name WHEN t.s1 >= {th} THEN t.c1 END AS canonical_institution, "
        f"CASE WHEN ex.match_source IS NOT NULL THEN ex.institution_id WHEN t.s1 >= {th} THEN t.i1 END AS institution_id, "
        "CASE WHEN ex.match_source = 'CANONICAL' THEN 'EXACT' WHEN ex.match_source IS NOT NULL THEN 'ALIAS' "
        f"WHEN t.s1 >= {th} THEN 'FUZZY' ELSE 'UNRESOLVED' END AS normalization_method, "
        "CASE WHEN ex.match_source IS NOT NULL THEN 100.0 ELSE t.s1 END AS top1_score, "
        "CASE WHEN ex.match_source IS NULL THEN t.c2 END AS top2_candidate, "
        "CASE WHEN ex.match_source IS NULL THEN t.s2 END AS top2_score, "
        "CASE WHEN ex.match_source IS NULL AND t.has2 = 1 THEN t.s1 - t.s2 END AS score_margin, "
        f"CASE WHEN ex.match_source IS NOT NULL OR t.s1 >= {th} THEN 'AUTO' ELSE 'NEEDS_REVIEW' END AS review_status, "
        "CASE WHEN ex.match_source = 'CANONICAL' THEN 'Exact match on master name' "
        "WHEN ex.match_source IS NOT NULL THEN 'Exact match on alias (' || ex.match_text || ')' "
        "WHEN t.s1 IS NULL THEN 'No master or alias entries to compare against' "
        f"WHEN t.s1 >= {th} THEN printf('Fuzzy similarity %.1f >= threshold %.1f', t.s1, {th}) "
        f"ELSE printf('Fuzzy similarity %.1f < threshold %.1f (continues to the vector path)', t.s1, {th}) END AS reason "
        f"FROM {p}ex ex LEFT JOIN {p}top t ON ex.vkey = t.vkey), "
        f"{p}fast AS (SELECT vk.vendor, f.* EXCLUDE (vkey) FROM {p}vk vk JOIN {p}fastk f ON vk.vkey = f.vkey)"
    )


def kwlist(csv: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({csv}, ''), ','), lambda kk: trim(kk)), lambda kk: kk <> '')"


def hits(ctx: str, csv: str) -> str:
    return f"(CASE WHEN coalesce({ctx}, '') = '' THEN []::VARCHAR[] ELSE list_filter({kwlist(csv)}, lambda hk: contains({ctx}, hk)) END)"


def veto_cte(src: str, name: str = "vetoed") -> str:
    """Apply the negative-keyword veto to ``src`` (vendor, context_text, result columns) -> vetoed."""
    h = hits("r.context_text", "m.negative_keywords")
    fire = f"(r.normalization_method = 'FUZZY' AND r.review_status = 'AUTO' AND m.negative_keywords IS NOT NULL AND len({h}) > 0)"
    return (
        f"{name} AS (SELECT r.* REPLACE ("
        f"CASE WHEN {fire} THEN 'NEEDS_REVIEW' ELSE r.review_status END AS review_status, "
        f"CASE WHEN {fire} THEN '[Safeguard] fuzzy auto-confirmed ''' || m.canonical_name || ''' but the context holds negative keywords [' "
        f"|| array_to_string({h}, ', ') || ']; sent to review' ELSE r.reason END AS reason) "
        f"FROM {src} r LEFT JOIN master m ON r.institution_id = m.institution_id)"
    )


RESULT_COLS = (
    "normalized_expression, canonical_institution, institution_id, normalization_method, round(top1_score, 6) AS top1_score, "
    "top2_candidate, round(top2_score, 6) AS top2_score, round(score_margin, 6) AS score_margin, review_status, reason"
)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# ------------------------------------------------------------------ encoder + vector path
DIM = 128


def ngram_buckets(t: str) -> str:
    """SQL of the buckets of a text's n-grams, with repeats."""
    grams = " , ".join(
        f"list_transform(range(1, length({t}) - {n} + 2), lambda gi: substr({t}, gi, {n}))" for n in (1, 2, 3)
    )
    g = f"list_concat(list_concat({grams.split(' , ')[0]}, {grams.split(' , ')[1]}), {grams.split(' , ')[2]})"
    return f"list_transform({g}, lambda gg: list_reduce(list_transform(string_split(gg, ''), lambda gc: CAST(unicode(gc) AS BIGINT)), lambda ga, gx: ga * 31 + gx, 0::BIGINT) % {DIM})"


def ngram_counts(t: str) -> str:
    return f"list_transform(range({DIM}), lambda bb: CAST(len(list_filter({ngram_buckets(t)}, lambda bx: bx = bb)) AS DOUBLE))"


def vector_ctes(unresolved: str, has_context: bool, floor: float = EMBEDDING_FLOOR, min_margin: float = MIN_SCORE_MARGIN) -> str:
    """From ``unresolved`` (vendor, context_text, ...) -> ai(vendor, context_text, <result columns>)."""
    ctx = "u.context_text" if has_context else "CAST(NULL AS VARCHAR)"
    fl, mm = repr(float(floor)), repr(float(min_margin))
    neg = hits(ctx, "m.negative_keywords")
    pos = hits(ctx, "m.keywords")
    margin = "(CASE WHEN c.o2 IS NOT NULL THEN c.s1 - c.s2 END)"
    return (
        "vidx AS (SELECT institution_id, canonical_name, text, ord_name, ord_alias, ord_alias_id, "
        f"{ngram_counts('text')} AS vec FROM entries), "
        f"vq AS (SELECT q, {ngram_counts('q')} AS vec FROM (SELECT DISTINCT CAST(vendor AS VARCHAR) AS q FROM {unresolved})), "
        "vs AS (SELECT vq.q, i.institution_id, i.canonical_name, i.text, i.ord_name, i.ord_alias, i.ord_alias_id, "
        "round(coalesce(list_cosine_similarity(vq.vec, i.vec), 0.0), 10) AS score FROM vq CROSS JOIN vidx i), "
        "vbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, institution_id ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS r1 FROM vs) WHERE r1 = 1), "
        "vtop AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS rk FROM vbest), "
        "vc AS (SELECT q, max(CASE WHEN rk = 1 THEN score END) AS s1, max(CASE WHEN rk = 1 THEN text END) AS t1, "
        "max(CASE WHEN rk = 1 THEN canonical_name END) AS c1, max(CASE WHEN rk = 1 THEN institution_id END) AS o1, "
        "max(CASE WHEN rk = 2 THEN score END) AS s2, max(CASE WHEN rk = 2 THEN canonical_name END) AS c2, "
        "max(CASE WHEN rk = 2 THEN institution_id END) AS o2 FROM vtop WHERE rk <= 2 GROUP BY q), "
        "ai AS (SELECT u.vendor, u.context_text, c.t1 AS normalized_expression, c.c1 AS canonical_institution, c.o1 AS institution_id, "
        f"CASE WHEN {ctx} IS NOT NULL THEN 'CONTEXT_RERANK' ELSE 'EMBEDDING' END AS normalization_method, "
        f"c.s1 AS top1_score, c.c2 AS top2_candidate, c.s2 AS top2_score, {margin} AS score_margin, "
        f"CASE WHEN {ctx} IS NOT NULL AND m.institution_id IS NOT NULL AND len({neg}) = 0 "
        f"AND NOT ({margin} IS NOT NULL AND {margin} < {mm}) AND len({pos}) > 0 AND c.s1 >= {fl} "
        "THEN 'AUTO' ELSE 'NEEDS_REVIEW' END AS review_status, CAST(NULL AS VARCHAR) AS reason "
        f"FROM {unresolved} u JOIN vc c ON CAST(u.vendor AS VARCHAR) = c.q LEFT JOIN master m ON c.o1 = m.institution_id)"
    )


# ------------------------------------------------------------------ queries
def _journal_fast(threshold=FUZZY_AUTO_THRESHOLD) -> list[str]:
    return [journal_cte(), seed_master_cte(), lookup_cte(), fast_cte("SELECT vendor FROM journal", threshold),
            "jr0 AS (SELECT j.*, f.* EXCLUDE (vendor) FROM journal j LEFT JOIN fast f ON j.vendor = f.vendor)",
            veto_cte("jr0"), "jr AS (SELECT * FROM vetoed)"]


def _eval_result(variant: str) -> list[str]:
    threshold = FUZZY_DISABLED_THRESHOLD if variant == "Baseline1_Exact_Alias" else FUZZY_AUTO_THRESHOLD
    base = [eval_cte(), seed_master_cte(), lookup_cte(), fast_cte("SELECT vendor FROM ev", threshold),
            "er0 AS (SELECT e.*, f.* EXCLUDE (vendor) FROM ev e LEFT JOIN fast f ON e.vendor = f.vendor)"]
    if variant != "Model4_ContextRerank":
        return base + ["er AS (SELECT * FROM er0)"]
    return base + [
        veto_cte("er0"),
        "unres AS (SELECT DISTINCT vendor, context_text FROM vetoed WHERE normalization_method = 'UNRESOLVED')",
        vector_ctes("unres", True),
        "er AS (SELECT v.* REPLACE (coalesce(a.canonical_institution, v.canonical_institution) AS canonical_institution, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.review_status ELSE v.review_status END AS review_status) "
        "FROM vetoed v LEFT JOIN ai a ON v.vendor = a.vendor AND v.context_text = a.context_text "
        "AND v.normalization_method = 'UNRESOLVED')",
    ]


def _rerank_confirm_sql() -> str:
    """The cascade with vectors from a table, reasons included."""
    from ledgerlink.plans.queries import AXES, RERANK_ROWS, VENDOR_VECTORS

    vecs = ", ".join(f"({lit(t)}, {v}::DOUBLE[])" for t, v in AXES + VENDOR_VECTORS)
    more = ", ".join(f"({k}, {lit(v)}, {lit(c)})" for k, (v, c) in enumerate(RERANK_ROWS))
    fl, mm = repr(float(EMBEDDING_FLOOR)), repr(float(MIN_SCORE_MARGIN))
    neg, pos, margin = hits("u.context_text", "m.negative_keywords"), hits("u.context_text", "m.keywords"), "(c.s1 - c.s2)"
    ok = f"len({neg}) = 0 AND NOT coalesce({margin} < {mm}, false) AND len({pos}) > 0 AND c.s1 >= {fl}"
    why = (
        "CASE WHEN u.context_text IS NULL THEN printf('Embedding top1=%.3f, top2=%.3f', c.s1, c.s2) || '; no context to rerank with, review needed' "
        f"WHEN len({neg}) > 0 THEN '[Context rerank] Negative keywords [' || array_to_string({neg}, ', ') || '] in context; auto-confirm refused' "
        f"WHEN {margin} < {mm} THEN printf('[Context rerank] Top1/top2 margin %.3f < threshold %.2f; candidates too close, review needed', {margin}, {mm}) "
        f"WHEN {ok} THEN printf('[Context rerank] Embedding %.3f >= threshold %.2f and keywords [', c.s1, {fl}) || array_to_string({pos}, ', ') || '] in context; auto-normalized' "
        f"ELSE printf('[Context rerank] Embedding %.3f, keywords ', c.s1) || CASE WHEN len({pos}) > 0 THEN '[' || array_to_string({pos}, ', ') || ']' ELSE 'none' END "
        "|| '; auto-confirm conditions not met, review needed' END"
    )
    return with_(
        eval_cte(), seed_master_cte(), f"more(k, vendor, context_text) AS (VALUES {more})",
        "allrows AS (SELECT voucher_no, vendor, context_text FROM ev UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), o.vendor, o.context_text "
        f"FROM supplier JOIN more o ON s_suppkey % {len(RERANK_ROWS)} = o.k)",
        lookup_cte(), fast_cte("SELECT vendor FROM allrows", FUZZY_AUTO_THRESHOLD),
        "er0 AS (SELECT e.*, f.* EXCLUDE (vendor) FROM allrows e LEFT JOIN fast f ON e.vendor = f.vendor)", veto_cte("er0"),
        f"tv(t, v) AS (VALUES {vecs})",
        "vidx AS (SELECT e.*, coalesce(tv.v, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS v FROM entries e LEFT JOIN tv ON e.text = tv.t)",
        "vq AS (SELECT q, coalesce(tv.v, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS v FROM (SELECT DISTINCT vendor AS q FROM vetoed WHERE normalization_method = 'UNRESOLVED') LEFT JOIN tv ON q = tv.t)",
        "vs AS (SELECT vq.q, i.institution_id, i.canonical_name, i.text, i.ord_name, i.ord_alias, i.ord_alias_id, "
        "round(CASE WHEN list_dot_product(vq.v, vq.v) = 0 OR list_dot_product(i.v, i.v) = 0 THEN 0.0 ELSE list_cosine_similarity(vq.v, i.v) END, 10) AS score FROM vq CROSS JOIN vidx i)",
        "vbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, institution_id ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS r1 FROM vs) WHERE r1 = 1)",
        "vtop AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS rk FROM vbest)",
        "c AS (SELECT q, max(CASE WHEN rk = 1 THEN score END) AS s1, max(CASE WHEN rk = 1 THEN text END) AS t1, max(CASE WHEN rk = 1 THEN canonical_name END) AS c1, "
        "max(CASE WHEN rk = 1 THEN institution_id END) AS o1, max(CASE WHEN rk = 2 THEN score END) AS s2, max(CASE WHEN rk = 2 THEN canonical_name END) AS c2 FROM vtop WHERE rk <= 2 GROUP BY q)",
    ) + (
        "SELECT u.voucher_no, u.vendor, u.context_text, "
        "CASE WHEN c.q IS NULL THEN u.normalized_expression ELSE c.t1 END AS normalized_expression, CASE WHEN c.q IS NULL THEN u.canonical_institution ELSE c.c1 END AS canonical_institution, "
        "CASE WHEN c.q IS NULL THEN u.institution_id ELSE c.o1 END AS institution_id, "
        "CASE WHEN c.q IS NULL THEN u.normalization_method WHEN u.context_text IS NULL THEN 'EMBEDDING' ELSE 'CONTEXT_RERANK' END AS normalization_method, "
        "round(CASE WHEN c.q IS NULL THEN u.top1_score ELSE c.s1 END, 6) AS top1_score, CASE WHEN c.q IS NULL THEN u.top2_candidate ELSE c.c2 END AS top2_candidate, "
        "round(CASE WHEN c.q IS NULL THEN u.top2_score ELSE c.s2 END, 6) AS top2_score, round(CASE WHEN c.q IS NULL THEN u.score_margin ELSE c.s1 - c.s2 END, 6) AS score_margin, "
        f"CASE WHEN c.q IS NULL THEN u.review_status WHEN u.context_text IS NOT NULL AND {ok} THEN 'AUTO' ELSE 'NEEDS_REVIEW' END AS review_status, "
        f"CASE WHEN c.q IS NULL THEN u.reason ELSE {why} END AS reason "
        "FROM vetoed u LEFT JOIN c ON u.normalization_method = 'UNRESOLVED' AND u.vendor = c.q LEFT JOIN master m ON c.o1 = m.institution_id"
    )


def _metrics_sql(src: str) -> str:
    pred = "(CASE WHEN review_status IN ('AUTO', 'HUMAN') THEN canonical_institution END)"
    c = (
        f"cnt AS (SELECT count(*) AS total, "
        f"count_if(true_label IS NOT NULL AND {pred} = true_label) AS true_positive, "
        f"count_if(true_label IS NOT NULL AND {pred} IS NULL) AS false_negative, "
        f"count_if((true_label IS NOT NULL AND {pred} IS NOT NULL AND {pred} <> true_label) OR (true_label IS NULL AND {pred} IS NOT NULL)) AS false_positive, "
        f"count_if(true_label IS NULL AND {pred} IS NULL) AS true_negative FROM {src})"
    )
    sel = (
        "SELECT total, true_positive, false_negative, false_positive, true_negative, "
        "round(CASE WHEN total > 0 THEN (true_positive + true_negative) / total END, 6) AS accuracy, "
        "round(CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) END, 6) AS precision, "
        "round(CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) END, 6) AS recall, "
        "round(CASE WHEN true_positive > 0 THEN 2.0 * (true_positive / (true_positive + false_positive)) * (true_positive / (true_positive + false_negative)) "
        "/ ((true_positive / (true_positive + false_positive)) + (true_positive / (true_positive + false_negative))) END, 6) AS f1, "
        "round(CASE WHEN total > 0 THEN (true_positive + false_positive) / total END, 6) AS coverage, "
        "round(CASE WHEN total > 0 THEN 1 - (true_positive + false_positive) / total END, 6) AS manual_review_rate, "
        "round(CASE WHEN true_positive + false_positive > 0 THEN false_positive / (true_positive + false_positive) ELSE 0.0 END, 6) AS false_normalization_rate "
        "FROM cnt"
    )
    return c, sel


def _eval_sql(variant: str) -> str:
    c, sel = _metrics_sql("er")
    return with_(*_eval_result(variant), c) + sel


def _company_values() -> str:
    from ledgerlink.plans.queries import COMPANY_ENTRIES

    vals = ", ".join(f"({lit(n)})" for n in COMPANY_ENTRIES)
    return f"company(institution_name) AS (SELECT * FROM (VALUES {vals}) UNION ALL SELECT s_name FROM supplier)"


def _completeness_ctes() -> list[str]:
    return _journal_fast() + [
        _company_values(),
        fast_cte("SELECT institution_name AS vendor FROM company", FUZZY_AUTO_THRESHOLD, "c"),
        "cr AS (SELECT c.institution_name, f.* EXCLUDE (vendor) FROM company c LEFT JOIN cfast f ON c.institution_name = f.vendor)",
        "a AS (SELECT DISTINCT canonical_institution AS canonical_name FROM cr WHERE review_status IN ('AUTO','HUMAN') AND canonical_institution IS NOT NULL)",
        "b AS (SELECT DISTINCT canonical_institution AS canonical_name FROM jr WHERE review_status IN ('AUTO','HUMAN') AND canonical_institution IS NOT NULL)",
        "cmp AS (SELECT coalesce(a.canonical_name, b.canonical_name) AS canonical_name, a.canonical_name IS NOT NULL AS company_list_exists, "
        "b.canonical_name IS NOT NULL AS journal_detected, CASE WHEN a.canonical_name IS NOT NULL AND b.canonical_name IS NOT NULL THEN 'MATCHED' "
        "WHEN b.canonical_name IS NOT NULL THEN 'ADDITIONAL_CANDIDATE' ELSE 'COMPANY_ONLY_NOT_FOUND' END AS status "
        "FROM a FULL OUTER JOIN b ON a.canonical_name = b.canonical_name)",
    ]


def _decisions_values(rows=None) -> str:
    """dec: all decisions; ld: the latest of each (expression, context)."""
    from ledgerlink.plans.queries import DECISION_ROWS

    vals = ", ".join(
        f"({i}, {lit(e)}, {lit(c)}, {lit(a)}, {'NULL' if oid is None else oid}, {lit(on)}, TIMESTAMP '2025-01-02 {h:02d}:00:00')"
        for i, e, c, a, oid, on, h in rows or DECISION_ROWS
    )
    return (
        f"dec0(decision_id, detected_expression, context_text, action, override_id, override_name, decided_at) AS (VALUES {vals}), "
        "dec AS (SELECT CAST(decision_id AS BIGINT) AS decision_id, detected_expression, context_text, action, "
        "CAST(override_id AS BIGINT) AS override_id, override_name, decided_at FROM dec0), "
        "ld AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY detected_expression, context_text "
        "ORDER BY decided_at DESC NULLS LAST, decision_id DESC) AS rn FROM dec) WHERE rn = 1)"
    )


def _any_context_sql(src: str = "jr") -> str:
    """oc: rows of ``src`` with the latest decision whose context is theirs or null."""
    return (
        f"oc AS (SELECT * FROM (SELECT j.*, d.action, d.override_id, d.override_name, row_number() OVER (PARTITION BY j.rid "
        f"ORDER BY d.decided_at DESC NULLS LAST, d.decision_id DESC) AS rn FROM (SELECT *, row_number() OVER () AS rid FROM {src}) j LEFT JOIN dec d ON j.vendor = d.detected_expression "
        "AND (d.context_text IS NULL OR d.context_text = j.context_text)) WHERE rn = 1)"
    )


OVERLAY = (
    "CASE WHEN action = 'CHANGE_INSTITUTION' THEN override_name WHEN action = 'NOT_FINANCIAL_INSTITUTION' THEN NULL ELSE canonical_institution END AS canonical_institution, "
    "CASE WHEN action = 'CHANGE_INSTITUTION' THEN override_id WHEN action = 'NOT_FINANCIAL_INSTITUTION' THEN NULL ELSE institution_id END AS institution_id, "
    "CASE WHEN action IS NOT NULL THEN 'HUMAN' ELSE normalization_method END AS normalization_method, "
    "CASE WHEN action IN ('APPROVE', 'CHANGE_INSTITUTION') THEN 'AUTO' WHEN action IS NOT NULL THEN action ELSE review_status END AS review_status, "
    "action IS NOT NULL AS user_confirmed"
)


def _reviews_cte(name: str = "rv", src: str = "jr", first: str = "0") -> str:
    """A review for every decision and row it reaches, numbered by (decision, row) after ``first``."""
    return (
        f"{name} AS (SELECT {first} + row_number() OVER (ORDER BY d.decision_id, j.voucher_no) AS review_id, d.decision_id, j.voucher_no AS original_row_id, "
        "j.canonical_institution AS model_prediction, "
        "CASE WHEN d.action = 'APPROVE' THEN j.canonical_institution WHEN d.action = 'CHANGE_INSTITUTION' THEN d.override_name ELSE d.action END AS user_decision, "
        f"d.action AS review_action FROM {src} j JOIN dec d ON j.vendor = d.detected_expression "
        "AND (d.context_text IS NULL OR j.context_text IS NOT DISTINCT FROM d.context_text))"
    )


def _two_runs() -> list[str]:
    """jr (run 1), evetoed (run 2) and their reviews rv1, rv2."""
    return [
        *_journal_fast(), eval_cte(), fast_cte("SELECT vendor FROM ev", FUZZY_AUTO_THRESHOLD, "e"),
        "er0 AS (SELECT e.*, f.* EXCLUDE (vendor) FROM ev e LEFT JOIN efast f ON e.vendor = f.vendor)",
        veto_cte("er0", "evetoed"), _decisions_values(), _reviews_cte("rv1", "jr"),
        _reviews_cte("rv2", "evetoed", "(SELECT coalesce(max(review_id), 0) FROM rv1)"),
    ]


def _result_table() -> list[str]:
    """rt: the 15 stored columns of both runs."""
    cols = (
        "voucher_no AS original_row_id, vendor AS detected_expression, normalized_expression, canonical_institution, r.institution_id, m.institution_type, "
        "normalization_method, round(top1_score, 4) AS top1_score, top2_candidate, round(top2_score, 4) AS top2_score, round(score_margin, 4) AS score_margin, "
        "review_status, context_text, reason, FALSE AS user_confirmed"
    )
    return [*_two_runs(), "rt AS (" + " UNION ALL ".join(
        f"SELECT {cols}, CAST({n} AS BIGINT) AS run_id FROM {src} r LEFT JOIN master m ON r.institution_id = m.institution_id" for n, src in ((1, "jr"), (2, "evetoed"))) + ")"]


def _count_if_to_filter(sql: str) -> str:
    """count_if(x) -> count(*) FILTER (WHERE x): same value, BIGINT like Spark's count."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"count(*) FILTER (WHERE {_count_if_to_filter(sql[j + len(key):k - 1])})")
        i = k


def oracle_sql() -> dict[str, str]:
    return {k: _count_if_to_filter(v) for k, v in _oracle_sql().items()}


def _oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["context_text"] = with_(journal_cte()) + f"SELECT voucher_no, vendor, context_text, {mkey('vendor')} AS match_key FROM journal"
    q["lookup_first_wins"] = with_(supplier_master_cte(), lookup_cte()) + "SELECT key, institution_id, canonical_name, match_text, match_source FROM lookup"
    q["master_with_aliases"] = with_(supplier_master_cte()) + (
        "SELECT m.institution_id, m.canonical_name, m.institution_type, a.alias_id, a.alias_text, a.alias_type, a.active AS alias_active "
        "FROM master m LEFT JOIN alias a ON m.institution_id = a.institution_id WHERE m.active"
    )
    sm, sa = seed_rows()
    seed_vals = ", ".join(f"({lit(n)}, {sum(1 for x in sa if x[1] == i)})" for i, n, *_r in sm)
    q["seed_if_absent"] = with_(
        supplier_master_cte(),
        f"seed(canonical_name, n_al) AS (VALUES {seed_vals})",
        "fresh AS (SELECT s.* FROM seed s WHERE s.canonical_name NOT IN (SELECT canonical_name FROM master))",
        "mx AS (SELECT coalesce(max(institution_id), 0) AS mx FROM master)",
    ) + (
        "SELECT m.institution_id, m.canonical_name, count(a.alias_id) AS n_aliases FROM master m LEFT JOIN alias a ON m.institution_id = a.institution_id "
        "GROUP BY m.institution_id, m.canonical_name "
        "UNION ALL SELECT mx.mx + row_number() OVER (ORDER BY f.canonical_name) AS institution_id, f.canonical_name, f.n_al AS n_aliases FROM fresh f, mx"
    )
    q["master_upsert"] = with_(
        supplier_master_cte(),
        "fresh AS (SELECT DISTINCT p_name AS canonical_name FROM part WHERE p_name NOT IN (SELECT canonical_name FROM master))",
        "mx AS (SELECT coalesce(max(institution_id), 0) AS mx FROM master)",
    ) + (
        "SELECT institution_id, canonical_name, institution_type, active FROM master UNION ALL "
        "SELECT mx.mx + row_number() OVER (ORDER BY f.canonical_name), f.canonical_name, 'OTHER', TRUE FROM fresh f, mx"
    )
    q["exact_alias_match"] = with_(journal_cte(), seed_master_cte(), lookup_cte()) + (
        f"SELECT v.vendor, v.vkey, l.institution_id, l.canonical_name, l.match_text, "
        "CASE WHEN l.match_source = 'CANONICAL' THEN 'EXACT' ELSE 'ALIAS' END AS normalization_method "
        f"FROM (SELECT DISTINCT vendor, {mkey('vendor')} AS vkey FROM journal) v JOIN lookup l ON v.vkey = l.key"
    )
    jf = _journal_fast()
    q["fast_join_back"] = with_(*jf) + f"SELECT voucher_no, vendor, context_text, {RESULT_COLS} FROM jr"
    q["method_counts"] = with_(*jf) + "SELECT normalization_method, count(*) AS n_rows FROM jr GROUP BY 1"
    q["method_status_counts"] = with_(*jf) + "SELECT normalization_method, review_status, count(*) AS n_rows FROM jr GROUP BY 1, 2"
    q["run_summary"] = with_(*jf) + (
        "SELECT count(*) AS total_rows, count_if(review_status = 'AUTO') AS auto_rows, "
        "count_if(review_status = 'NEEDS_REVIEW') AS review_rows, 20 AS n_columns FROM jr"
    )
    q["institution_summary"] = with_(*jf) + (
        "SELECT canonical_institution, count(*) AS n_rows FROM jr WHERE canonical_institution IS NOT NULL GROUP BY 1"
    )
    q["run_stats"] = with_(*jf) + (
        "SELECT count(*) AS total_rows, count_if(normalization_method = 'EXACT') AS fast_path_count, "
        "count_if(normalization_method = 'ALIAS') AS alias_count, count_if(normalization_method = 'FUZZY') AS fuzzy_count, "
        "count_if(normalization_method = 'EMBEDDING') AS embedding_count, count_if(normalization_method = 'CONTEXT_RERANK') AS context_rerank_count, "
        "count_if(review_status = 'NEEDS_REVIEW') AS manual_review_count, count_if(normalization_method = 'UNRESOLVED') AS unresolved_count, "
        "count(DISTINCT (vendor, context_text)) AS distinct_pairs, count(*) - count(DISTINCT (vendor, context_text)) AS cache_hit_count FROM jr"
    )
    q["distinct_pairs"] = with_(journal_cte()) + "SELECT vendor, context_text, count(*) AS n_rows FROM journal GROUP BY 1, 2"

    pm = [part_master_cte(), lookup_cte(), noisy_vendors_cte()]
    pairs = (
        f"pp AS (SELECT v.vkey, l.key, CASE WHEN length(v.vkey) <= length(l.key) THEN v.vkey ELSE l.key END AS s_, "
        f"CASE WHEN length(v.vkey) <= length(l.key) THEN l.key ELSE v.vkey END AS l_, l.institution_id, l.ord_name, l.ord_alias, l.ord_alias_id "
        f"FROM (SELECT DISTINCT {mkey('vendor')} AS vkey FROM nv) v CROSS JOIN lookup l)"
    )
    q["fuzzy_scores"] = with_(*pm, pairs, f"sc AS (SELECT vkey, key, {wratio('s_', 'l_')} AS score FROM pp)") + (
        f"SELECT vkey, key, round(score, 6) AS score FROM sc WHERE score >= {FUZZY_AUTO_THRESHOLD}"
    )
    q["fuzzy_top2"] = with_(
        *pm, pairs, f"sc AS (SELECT *, {wratio('s_', 'l_')} AS score FROM pp)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY vkey ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS rank FROM sc)",
    ) + "SELECT vkey, CAST(rank AS INTEGER) AS rank, key, institution_id, round(score, 6) AS score FROM rk WHERE rank <= 2"
    wide = (
        "master AS (SELECT CAST(p_partkey AS BIGINT) AS institution_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS canonical_name, 'OTHER' AS institution_type, "
        "CAST(NULL AS VARCHAR) AS english_name, CAST(NULL AS VARCHAR) AS keywords, CAST(NULL AS VARCHAR) AS negative_keywords, TRUE AS active FROM part), "
        "alias AS (SELECT CAST(NULL AS BIGINT) AS alias_id, CAST(NULL AS BIGINT) AS institution_id, CAST(NULL AS VARCHAR) AS alias_text, "
        "CAST(NULL AS VARCHAR) AS alias_type, FALSE AS active WHERE FALSE)"
    )
    wide_pairs = pairs.replace(f"SELECT DISTINCT {mkey('vendor')} AS vkey FROM nv", f"SELECT DISTINCT {mkey('substr(p_name, 2) || CAST(s_suppkey AS VARCHAR)')} AS vkey FROM supplier JOIN part ON s_suppkey = p_partkey")
    q["fuzzy_wide_lookup"] = with_(
        wide, lookup_cte(), wide_pairs, f"sc AS (SELECT *, {wratio('s_', 'l_')} AS score FROM pp)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY vkey ORDER BY score DESC, ord_name, ord_alias, ord_alias_id) AS rank FROM sc)",
    ) + "SELECT vkey, CAST(rank AS INTEGER) AS rank, key, institution_id, round(score, 6) AS score FROM rk WHERE rank <= 2"
    q["fuzzy_high_cardinality"] = with_(*pm, fast_cte("SELECT vendor FROM nv", FUZZY_AUTO_THRESHOLD)) + (
        f"SELECT n.p_partkey, n.vendor, n.true_label, {RESULT_COLS} FROM nv n LEFT JOIN fast f ON n.vendor = f.vendor"
    )
    hot = (
        "hj AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 < 3 THEN 'small ring' ELSE vendor END AS vendor "
        "FROM lineitem JOIN nv ON l_partkey = p_partkey)"
    )
    q["join_back_hot_vendor"] = with_(*pm, hot, fast_cte("SELECT vendor FROM hj", FUZZY_AUTO_THRESHOLD)) + (
        "SELECT l_orderkey, l_linenumber, h.vendor, canonical_institution, normalization_method, round(top1_score, 6) AS top1_score, review_status "
        "FROM hj h LEFT JOIN fast f ON h.vendor = f.vendor"
    )
    ev_fast = [eval_cte(), seed_master_cte(), lookup_cte(), fast_cte("SELECT vendor FROM ev", FUZZY_AUTO_THRESHOLD)]
    q["fast_cascade"] = with_(*ev_fast) + f"SELECT vendor, {RESULT_COLS} FROM fast"
    q["fuzzy_veto"] = with_(
        *ev_fast, "er0 AS (SELECT e.*, f.* EXCLUDE (vendor) FROM ev e LEFT JOIN fast f ON e.vendor = f.vendor)", veto_cte("er0")
    ) + f"SELECT voucher_no, vendor, context_text, {RESULT_COLS} FROM vetoed"

    # vectors on the embeddings table: index = vec_id % 5 = 0, queries = the other rows
    emb = (
        "idx AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 = 0), "
        "qry AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0), "
        "sc AS (SELECT q.vec_id, i.label AS owner, i.vec_id AS ivec, round(list_cosine_similarity(q.v, i.v), 10) AS score FROM qry q CROSS JOIN idx i), "
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, owner ORDER BY score DESC, ivec) AS r1 FROM sc) WHERE r1 = 1), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, 'label_' || CAST(owner AS VARCHAR), ivec) AS rank FROM best)"
    )
    q["vector_top2_by_owner"] = f"WITH {emb} SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(owner AS BIGINT) AS owner, ivec AS best_vec_id, round(score, 6) AS score FROM rk WHERE rank <= 2"
    q["vector_top2_blocked"] = q["vector_top2_by_owner"]
    q["score_margin"] = f"WITH {emb} " + (
        "SELECT vec_id, CAST(max(CASE WHEN rank = 1 THEN owner END) AS BIGINT) AS top1_owner, round(max(CASE WHEN rank = 1 THEN score END), 6) AS top1_score, "
        "CAST(max(CASE WHEN rank = 2 THEN owner END) AS BIGINT) AS top2_owner, round(max(CASE WHEN rank = 2 THEN score END), 6) AS top2_score, "
        "round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS score_margin FROM rk WHERE rank <= 2 GROUP BY vec_id"
    )

    comp = _completeness_ctes()
    q["completeness_sets"] = with_(*comp) + "SELECT canonical_name, company_list_exists, journal_detected, status FROM cmp"
    q["completeness_rows"] = with_(
        *comp,
        "summ AS (SELECT canonical_institution AS canonical_name, count(*) AS journal_count, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount "
        "FROM jr WHERE review_status IN ('AUTO','HUMAN') AND canonical_institution IN (SELECT canonical_name FROM cmp) GROUP BY 1)",
    ) + (
        "SELECT m.institution_id, c.canonical_name, c.company_list_exists, c.journal_detected, CAST(coalesce(s.journal_count, 0) AS BIGINT) AS journal_count, "
        "s.total_amount, c.status AS review_status FROM cmp c LEFT JOIN master m ON c.canonical_name = m.canonical_name "
        "LEFT JOIN summ s ON c.canonical_name = s.canonical_name"
    )
    q["amount_summary"] = with_(*jf) + (
        "SELECT canonical_institution, count(*) AS journal_count, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS total_amount "
        "FROM jr WHERE review_status IN ('AUTO','HUMAN') AND canonical_institution IS NOT NULL GROUP BY 1"
    )
    q["institution_detail"] = with_(*comp) + (
        "SELECT voucher_no, vendor, amount, canonical_institution FROM jr WHERE review_status IN ('AUTO','HUMAN') "
        "AND canonical_institution IN (SELECT canonical_name FROM cmp WHERE status = 'ADDITIONAL_CANDIDATE')"
    )
    q["unidentified"] = with_(*comp) + (
        "SELECT DISTINCT institution_name FROM cr WHERE review_status IS NULL OR review_status NOT IN ('AUTO','HUMAN')"
    )
    q["review_queue"] = with_(*jf) + (
        "SELECT detected_expression, context_text, canonical_institution, round(top1_score, 6) AS top1_score, top2_candidate, "
        "round(top2_score, 6) AS top2_score, normalization_method FROM (SELECT vendor AS detected_expression, context_text, "
        "arg_min(struct_pack(canonical_institution, top1_score, top2_candidate, top2_score, normalization_method), "
        "struct_pack(k1 := coalesce(-top1_score, 'inf'::DOUBLE), k2 := reason)) AS r FROM jr WHERE review_status = 'NEEDS_REVIEW' "
        "GROUP BY 1, 2) t, LATERAL (SELECT r.canonical_institution, r.top1_score, r.top2_candidate, r.top2_score, r.normalization_method) "
        "ORDER BY detected_expression, context_text"
    )
    q["decisions_overlay"] = with_(*jf, _decisions_values()) + (
        "SELECT j.voucher_no, j.vendor AS detected_expression, "
        "CASE WHEN d.action = 'CHANGE_INSTITUTION' THEN d.override_name WHEN d.action = 'NOT_FINANCIAL_INSTITUTION' THEN NULL ELSE j.canonical_institution END AS canonical_institution, "
        "CASE WHEN d.action = 'CHANGE_INSTITUTION' THEN d.override_id WHEN d.action = 'NOT_FINANCIAL_INSTITUTION' THEN NULL ELSE j.institution_id END AS institution_id, "
        "CASE WHEN d.action IS NOT NULL THEN 'HUMAN' ELSE j.normalization_method END AS normalization_method, "
        "CASE WHEN d.action IN ('APPROVE', 'CHANGE_INSTITUTION') THEN 'AUTO' WHEN d.action IS NOT NULL THEN d.action ELSE j.review_status END AS review_status, "
        "d.action IS NOT NULL AS user_confirmed FROM jr j LEFT JOIN ld d ON j.vendor = d.detected_expression AND j.context_text IS NOT DISTINCT FROM d.context_text"
    )
    q["reviews_from_decisions"] = with_(*jf, _decisions_values(), _reviews_cte()) + "SELECT * FROM rv"
    q["labels_from_decisions"] = with_(*jf, _decisions_values(), _reviews_cte()) + (
        "SELECT r.decision_id, d.detected_expression AS original_expression, d.context_text, max(r.model_prediction) AS model_prediction, "
        "max(r.user_decision) AS confirmed_label, count(*) AS n_reviews, max(r.review_id) AS source_review_id FROM rv r JOIN dec d ON r.decision_id = d.decision_id "
        "GROUP BY r.decision_id, d.detected_expression, d.context_text"
    )
    rr = _eval_result("Model4_ContextRerank")[:-1] + [
        "er AS (SELECT v.* REPLACE (coalesce(a.normalized_expression, v.normalized_expression) AS normalized_expression, "
        "coalesce(a.canonical_institution, v.canonical_institution) AS canonical_institution, "
        "coalesce(a.institution_id, v.institution_id) AS institution_id, "
        "coalesce(a.normalization_method, v.normalization_method) AS normalization_method, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.top1_score ELSE v.top1_score END AS top1_score, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.top2_candidate ELSE v.top2_candidate END AS top2_candidate, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.top2_score ELSE v.top2_score END AS top2_score, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.score_margin ELSE v.score_margin END AS score_margin, "
        "CASE WHEN a.vendor IS NOT NULL THEN a.review_status ELSE v.review_status END AS review_status) "
        "FROM vetoed v LEFT JOIN ai a ON v.vendor = a.vendor AND v.context_text = a.context_text "
        "AND v.normalization_method = 'UNRESOLVED')"
    ]
    q["rerank_rules"] = with_(*rr) + (
        "SELECT voucher_no, vendor, context_text, normalized_expression, canonical_institution, institution_id, normalization_method, "
        "round(top1_score, 6) AS top1_score, top2_candidate, round(top2_score, 6) AS top2_score, round(score_margin, 6) AS score_margin, "
        "review_status FROM er"
    )
    q["rerank_confirm"] = _rerank_confirm_sql()
    q["result_preview"] = with_(*jf) + (
        "SELECT detected_expression, context_text, canonical_institution, normalization_method, round(top1_score, 6) AS top1_score, "
        "top2_candidate, review_status, reason FROM (SELECT DISTINCT vendor AS detected_expression, context_text, canonical_institution, "
        "normalization_method, top1_score, top2_candidate, review_status, reason FROM jr)"
    )
    q["table_counts"] = with_(*jf, _decisions_values(), _reviews_cte()) + (
        "SELECT 'institution_master' AS table_name, count(*) AS n_rows FROM supplier "
        "UNION ALL SELECT 'institution_alias', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) li "
        "JOIN part ON li.l_partkey = p_partkey "
        "UNION ALL SELECT 'human_reviews', count(*) FROM rv "
        "UNION ALL SELECT 'feedback_labels', count(DISTINCT decision_id) FROM rv"
    )
    comp_all = _completeness_ctes()
    rows_sql = (
        "SELECT m.institution_id, c.canonical_name, c.company_list_exists, c.journal_detected, "
        "CAST(coalesce(s.journal_count, 0) AS BIGINT) AS journal_count, s.total_amount, c.status AS review_status "
        "FROM {cmp} c LEFT JOIN master m ON c.canonical_name = m.canonical_name LEFT JOIN summ s ON c.canonical_name = s.canonical_name"
    )
    q["replace_completeness"] = with_(
        *comp_all,
        "summ AS (SELECT canonical_institution AS canonical_name, count(*) AS journal_count, CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount "
        "FROM jr WHERE review_status IN ('AUTO','HUMAN') GROUP BY 1)",
        f"run2 AS ({rows_sql.format(cmp='cmp')})",
    ) + (
        # run 1's old rows are gone; its replacement is run 2's journal-detected rows
        "SELECT *, CAST(2 AS BIGINT) AS run_id FROM run2 UNION ALL "
        "SELECT *, CAST(1 AS BIGINT) AS run_id FROM run2 WHERE journal_detected"
    )
    q["delete_run_keep_labels"] = with_(*_two_runs()) + (
        "SELECT decision_id, max(user_decision) AS confirmed_label, CAST(NULL AS BIGINT) AS source_review_id FROM rv1 GROUP BY decision_id UNION ALL "
        "SELECT decision_id, max(user_decision), max(review_id) FROM rv2 GROUP BY decision_id"
    )
    from ledgerlink.plans.queries import ANY_CONTEXT_ROWS

    anyc = _decisions_values(ANY_CONTEXT_ROWS)
    q["decisions_any_context"] = with_(*jf, anyc, _any_context_sql()) + f"SELECT voucher_no, vendor AS detected_expression, {OVERLAY} FROM oc"
    rt = _result_table()
    q["result_rows"] = with_(*rt) + "SELECT * EXCLUDE (run_id) FROM rt WHERE run_id = 1"
    q["load_run_status"] = with_(*rt) + (
        "SELECT original_row_id, detected_expression, institution_type, top1_score, top2_score, review_status FROM rt WHERE run_id = 2 AND review_status = 'NEEDS_REVIEW'"
    )
    q["stored_review"] = with_(*jf, anyc, _any_context_sql()) + (
        f"SELECT o.voucher_no AS original_row_id, m.institution_type, round(o.top1_score, 4) AS top1_score, {OVERLAY.replace('ELSE institution_id', 'ELSE o.institution_id')} "
        "FROM oc o LEFT JOIN master m ON o.institution_id = m.institution_id"
    )
    q["matching_results"] = with_(*rt, anyc.replace("dec0(", "kd0(").replace("FROM dec0", "FROM kd0").replace("dec AS", "kd AS").replace("FROM dec)", "FROM kd)").replace("ld AS", "kl AS")) + (
        "SELECT run_id, original_row_id FROM rt WHERE EXISTS (SELECT 1 FROM kd WHERE kd.detected_expression = rt.detected_expression "
        "AND (kd.context_text IS NULL OR kd.context_text = rt.context_text))"
    )
    q["drop_run_tables"] = with_(*rt) + (
        "SELECT 'normalization_results' AS table_name, count(*) AS n_rows FROM rt WHERE run_id = 2 "
        "UNION ALL SELECT 'human_reviews', count(*) FROM rv2 "
        "UNION ALL SELECT 'feedback_labels', (SELECT count(DISTINCT decision_id) FROM rv1) + (SELECT count(DISTINCT decision_id) FROM rv2) "
        "UNION ALL SELECT 'linked_labels', count(DISTINCT decision_id) FROM rv2 "
        "UNION ALL SELECT 'deleted_results', count(*) FROM rt WHERE run_id = 1"
    )
    q["stored_lookup"] = q["matching_results"]
    q["stored_rows"] = with_(*rt) + "SELECT * FROM rt"
    q["stored_runs"] = with_(*rt) + (
        "SELECT run_id, CASE run_id WHEN 1 THEN 'journal.csv' ELSE 'labelled.parquet' END AS file_name, CASE run_id WHEN 1 THEN 'csv' ELSE 'parquet' END AS file_type, "
        "'COMPLETED' AS status, count(*) AS total_rows, TRUE AS timed, count_if(normalization_method = 'EXACT') AS fast_path_count, "
        "count_if(normalization_method = 'ALIAS') AS alias_count, count_if(normalization_method = 'FUZZY') AS fuzzy_count, "
        "count_if(review_status = 'NEEDS_REVIEW') AS manual_review_count, count_if(normalization_method = 'UNRESOLVED') AS unresolved_count, "
        "count(*) - count(DISTINCT (detected_expression, context_text)) AS cache_hit_count FROM rt GROUP BY run_id"
    )
    pairs = "count(DISTINCT (detected_expression, context_text)) AS exact_pairs, CAST(0 AS DOUBLE) AS pairs_error, count(DISTINCT original_row_id) AS exact_rows, TRUE AS rows_within"
    q["distinct_over_runs"] = with_(*rt) + (
        f"SELECT CAST(run_id AS VARCHAR) AS scope, count(*) AS total_rows, {pairs} FROM rt GROUP BY run_id UNION ALL SELECT 'all', count(*), {pairs} FROM rt"
    )
    q["csv_documents"] = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents"
    q["csv_journal"] = with_(journal_cte()) + "SELECT CAST(voucher_no AS VARCHAR) AS voucher_no, vendor, context_text, CAST(amount AS DECIMAL(18,2)) AS amount FROM journal"
    q["report_written"] = with_(*jf) + (
        "SELECT 'full_result' AS table_name, count(*) AS n_rows FROM jr "
        "UNION ALL SELECT 'institution_summary', count(DISTINCT canonical_institution) FROM jr "
        "UNION ALL SELECT 'manual_review', count(*) FROM jr WHERE review_status = 'NEEDS_REVIEW' UNION ALL SELECT 'nothing', CAST(1 AS BIGINT)"
    )
    q["detail_of_institution"] = with_(*jf) + (
        "SELECT voucher_no, vendor, normalization_method FROM jr WHERE review_status IN ('AUTO', 'HUMAN') AND canonical_institution = 'KB국민은행'"
    )
    reached = q["matching_results"].split("SELECT run_id, original_row_id FROM rt WHERE ")[1]
    confirmed = "(SELECT count(DISTINCT canonical_institution) FROM rt WHERE run_id = 2 AND review_status IN ('AUTO', 'HUMAN'))"
    ones, labels = "(SELECT count(*) FROM rt WHERE run_id = 1)", "(SELECT count(DISTINCT decision_id) FROM rv1)"
    steps = {
        "loaded": ones, "needs_review": "(SELECT count(*) FROM rt WHERE run_id = 1 AND review_status = 'NEEDS_REVIEW')", "reviews": "(SELECT count(*) FROM rv1)",
        "labels": labels, "rewritten": ones, "human": f"(SELECT count(*) FROM rt WHERE run_id = 1 AND {reached})", "completeness": confirmed, "completeness_read": confirmed,
        "clustered": ones, "dropped": ones, "left": "(SELECT count(*) FROM rt WHERE run_id = 2)", "runs_left": "CAST(1 AS BIGINT)", "labels_left": labels, "labels_linked": "CAST(0 AS BIGINT)",
    }
    q["store_life_cycle"] = q["matching_results"].split("SELECT run_id, original_row_id FROM rt WHERE ")[0] + " UNION ALL ".join(f"SELECT {lit(k)} AS step, {v} AS n_rows" for k, v in steps.items())
    q["add_aliases"] = with_(
        supplier_master_cte(), "mx AS (SELECT coalesce(max(alias_id), 0) AS mx FROM alias)",
        "fresh AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS institution_id, ' ' || p_name AS alias_text FROM part)",
    ) + (
        "SELECT alias_id, institution_id, alias_text, upper(trim(alias_text)) AS normalized_alias, alias_type, active FROM alias UNION ALL "
        "SELECT mx.mx + row_number() OVER (ORDER BY f.institution_id, f.alias_text), f.institution_id, f.alias_text, upper(trim(f.alias_text)), 'ALIAS', TRUE FROM fresh f, mx"
    )
    q["set_active"] = with_(supplier_master_cte()) + (
        "SELECT institution_id, canonical_name, active AND institution_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS active FROM master"
    )
    q["list_institutions"] = with_(supplier_master_cte()) + "SELECT institution_id, canonical_name, institution_type FROM master WHERE active"
    q["list_aliases"] = with_(supplier_master_cte()) + "SELECT alias_id, alias_text, alias_type, active FROM alias WHERE institution_id = 3"
    q["recent_orders"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC NULLS LAST, o_orderkey DESC LIMIT 50"
    q["distinct_count"] = with_(*jf) + "SELECT count(DISTINCT canonical_institution) + max(CASE WHEN canonical_institution IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM jr"
    q["performance_row"] = q["run_stats"].replace("SELECT count(*) AS total_rows", "SELECT CAST(3 AS BIGINT) AS run_id, CAST(1.5 AS DECIMAL(12,3)) AS processing_seconds, count(*) AS total_rows").replace(
        "count(DISTINCT (vendor, context_text)) AS distinct_pairs, ", "")
    q["candidate_rows"] = q["fuzzy_top2"].replace(
        "SELECT vkey, CAST(rank AS INTEGER) AS rank, key, institution_id, round(score, 6) AS score FROM rk",
        "SELECT vkey AS detected_expression, CAST(rank AS INTEGER) AS candidate_rank, institution_id, ord_name AS candidate_name, round(score, 4) AS fuzzy_score FROM rk")
    q["report_manual_review"] = with_(*jf) + "SELECT voucher_no, vendor, normalization_method, reason FROM jr WHERE review_status = 'NEEDS_REVIEW'"
    q["report_completeness"] = with_(*comp) + (
        "SELECT CASE status WHEN 'MATCHED' THEN 'both' WHEN 'ADDITIONAL_CANDIDATE' THEN 'additional_candidates' ELSE 'company_only' END AS table_name, canonical_name FROM cmp"
    )
    q["evaluate_variants"] = " UNION ALL ".join(
        f"SELECT {lit(v)} AS variant, * FROM ({_eval_sql(v)})" for v in ("Baseline1_Exact_Alias", "Baseline2_Fuzzy", "Model3_Embedding", "Model4_ContextRerank"))
    q["encoder_weights"] = with_(supplier_master_cte(), lookup_cte(), f"b AS (SELECT unnest(list_distinct({ngram_buckets('text')})) AS bucket FROM entries)") + (
        "SELECT bucket, count(*) AS texts, round(ln((1.0 + (SELECT count(*) FROM entries)) / (1.0 + count(*))) + 1.0, 6) AS weight FROM b GROUP BY bucket"
    )
    q["evaluate_baseline1"] = _eval_sql("Baseline1_Exact_Alias")
    q["evaluate_baseline2"] = _eval_sql("Baseline2_Fuzzy")
    q["evaluate_model3"] = _eval_sql("Model3_Embedding")
    q["evaluate_model4"] = _eval_sql("Model4_ContextRerank")
    return q
