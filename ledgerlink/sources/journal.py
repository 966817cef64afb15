"""Journal sources and sinks.

* ``read_journal`` / ``write_journal``: CSV or Parquet, chosen by suffix.
* ``template_journal``: the weighted-template journal.  A row's template is
  picked from an integer in [0, total weight) by a literal lookup array (no join).
* ``lineitem_journal``: that journal built on every ``lineitem`` row.
* ``synth_journal``: the same generator driven by ``spark.range`` and a seed.
* ``evaluation_journal``: the labelled evaluation cases spread over ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.session import file_positions, read_table

SUPPORTED_SUFFIXES = ("csv", "parquet")

# Column names of the sample journal and its mapping to logical fields.
JOURNAL_MAPPING = {
    "voucher_no": "전표번호",
    "voucher_date": "전표일자",
    "vendor": "거래처",
    "description": "적요",
    "account": "계정과목",
    "counter_account": "상대계정",
    "amount": "금액",
}

# --- fixed values: journal templates ---------------------------------------
# (vendor, description, account, counter_account, weight)
TEMPLATES = [
    ("NH농협은행", "정기예금 이자 수령", "이자수익", "정기예금", 3),
    ("농협은행", "운영자금 대출이자 지급", "이자비용", "장기차입금", 3),
    ("NH농협", "계좌이체 수수료 지급", "수수료비용", "보통예금", 2),
    ("농은", "운영자금 대출이자 지급", "이자비용", "장기차입금", 2),
    ("Nonghyup Bank", "외화 송금", "외화예금", "보통예금", 1),
    ("NH Bank", "외화 송금 수수료", "수수료비용", "보통예금", 1),
    ("농협 강남", "정기예금 예치", "정기예금", "보통예금", 1),
    ("농협(대출)", "시설자금 대출 이자 지급", "이자비용", "장기차입금", 1),
    ("OO농협", "농산물 구매대금 지급", "원재료", "외상매입금", 2),
    ("농협유통", "상품 매입대금 지급", "상품", "외상매입금", 2),
    ("NH투자", "증권 매매 정산", "단기매매증권", "보통예금", 1),
    ("KB국민은행", "보통예금 입금", "보통예금", "제품매출", 3),
    ("국민은행", "대출이자 지급", "이자비용", "장기차입금", 2),
    ("KB국민", "계좌이체 수수료 지급", "수수료비용", "보통예금", 1),
    ("KB BANK", "외화송금", "외화예금", "보통예금", 1),
    ("케이비국민", "외화송금 수수료 지급", "수수료비용", "보통예금", 1),
    ("신한은행", "보통예금 이자 수령", "이자수익", "보통예금", 3),
    ("신한", "대출이자 지급", "이자비용", "장기차입금", 2),
    ("신한 BIZ", "은행수수료 지급", "수수료비용", "보통예금", 1),
    ("테스트전자", "제품 판매대금 수령", "제품매출", "보통예금", 3),
    ("샘플물류", "운송비 지급", "운반비", "외상매입금", 3),
    ("가상상사", "용역비 지급", "용역비", "외상매입금", 2),
    ("ABC부품", "부품 구매대금 지급", "원재료", "외상매입금", 2),
]

# Labelled evaluation cases: (vendor, context, true_label);
# a null label means the row must not resolve to any institution.
EVALUATION_CASES = [
    ("NH농협은행", "NH농협은행 | 대출이자 지급 | 이자비용 | 장기차입금", "NH농협은행"),
    ("농협은행", "농협은행 | 정기예금 예치 | 정기예금 | 보통예금", "NH농협은행"),
    ("NH농협", "NH농협 | 계좌이체 수수료 | 수수료비용 | 보통예금", "NH농협은행"),
    ("농은", "농은 | 대출이자 지급 | 이자비용 | 장기차입금", "NH농협은행"),
    ("Nonghyup Bank", "Nonghyup Bank | 외화 송금 | 외화예금 | 보통예금", "NH농협은행"),
    ("NH Bank", "NH Bank | 외화 송금 수수료 | 수수료비용 | 보통예금", "NH농협은행"),
    ("농협은행 부산지점", "농협은행 부산지점 | 대출이자 지급 | 이자비용 | 장기차입금", "NH농협은행"),
    ("(주)농협은행", "(주)농협은행 | 보통예금 입금 | 보통예금 | 제품매출", "NH농협은행"),
    ("농협", "농협 | 운영자금 대출이자 지급 | 이자비용 | 장기차입금", "NH농협은행"),
    ("농협", "농협 | 정기예금 이자 수령 | 이자수익 | 정기예금", "NH농협은행"),
    ("농협", "농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금", None),
    ("KB국민은행", "KB국민은행 | 보통예금 입금 | 보통예금 | 제품매출", "KB국민은행"),
    ("국민은행", "국민은행 | 대출이자 지급 | 이자비용 | 장기차입금", "KB국민은행"),
    ("KB국민", "KB국민 | 계좌이체 수수료 | 수수료비용 | 보통예금", "KB국민은행"),
    ("KB BANK", "KB BANK | 외화송금 | 외화예금 | 보통예금", "KB국민은행"),
    ("케이비국민", "케이비국민 | 외화송금 수수료 | 수수료비용 | 보통예금", "KB국민은행"),
    ("신한은행", "신한은행 | 보통예금 이자 수령 | 이자수익 | 보통예금", "신한은행"),
    ("신한", "신한 | 대출이자 지급 | 이자비용 | 장기차입금", "신한은행"),
    ("신한 BIZ", "신한 BIZ | 은행수수료 지급 | 수수료비용 | 보통예금", "신한은행"),
    ("OO농협", "OO농협 | 농산물 구매대금 지급 | 원재료 | 외상매입금", None),
    ("농협유통", "농협유통 | 상품 매입대금 지급 | 상품 | 외상매입금", None),
    ("NH투자", "NH투자 | 증권 매매 정산 | 단기매매증권 | 보통예금", None),
    ("테스트전자", "테스트전자 | 제품 판매대금 수령 | 제품매출 | 보통예금", None),
    ("샘플물류", "샘플물류 | 운송비 지급 | 운반비 | 외상매입금", None),
    ("가상상사", "가상상사 | 용역비 지급 | 용역비 | 외상매입금", None),
    ("ABC부품", "ABC부품 | 부품 구매대금 지급 | 원재료 | 외상매입금", None),
]

# Sample company list: submitted institution names.
COMPANY_LIST = ["NH농협은행", "신한은행"]
# ---------------------------------------------------------------------------

TOTAL_WEIGHT = sum(t[4] for t in TEMPLATES)


def _sql_str(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _template_array() -> Column:
    """The templates as one literal array of structs (a single SQL expression, folded to a constant)."""
    items = ", ".join(
        f"named_struct('template', {i}, 'vendor', {_sql_str(v)}, 'description', {_sql_str(d)}, "
        f"'account', {_sql_str(a)}, 'counter_account', {_sql_str(c)})"
        for i, (v, d, a, c, _w) in enumerate(TEMPLATES)
    )
    return F.expr(f"array({items})")


def _pick_array() -> Column:
    """Template index for every value in [0, TOTAL_WEIGHT): cumulative-weight buckets."""
    idx = [i for i, t in enumerate(TEMPLATES) for _ in range(t[4])]
    return F.expr("array(" + ", ".join(str(i) for i in idx) + ")")


def template_journal(rows: DataFrame, pick: Column, voucher: Column, voucher_date: Column, amount: Column) -> DataFrame:
    """One journal row per input row; ``pick`` is an integer in [0, TOTAL_WEIGHT)."""
    t = F.element_at(_template_array(), F.element_at(_pick_array(), pick.cast("int") + 1) + 1)
    m = JOURNAL_MAPPING
    return rows.select(
        voucher.alias(m["voucher_no"]),
        voucher_date.alias(m["voucher_date"]),
        t["vendor"].alias(m["vendor"]),
        t["description"].alias(m["description"]),
        t["account"].alias(m["account"]),
        t["counter_account"].alias(m["counter_account"]),
        amount.alias(m["amount"]),
    )


def lineitem_pick() -> Column:
    return F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(TOTAL_WEIGHT))


def lineitem_voucher() -> Column:
    return F.concat(F.lit("V"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


def lineitem_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template journal over every lineitem row (amount = extended price)."""
    li = read_table(spark, sf_dir, "lineitem")
    return template_journal(
        li,
        lineitem_pick(),
        lineitem_voucher(),
        F.to_date("l_shipdate"),
        F.col("l_extendedprice").cast("decimal(18,2)"),
    )


def synth_journal(spark: SparkSession, n_rows: int, seed: int = 42) -> DataFrame:
    """Seeded template journal of ``n_rows`` rows (reproducible per seed).

    Same template distribution, date range (2025-01-01 + 0..364 days) and amount
    grid (10..5000 x 1000) as the sample generator; a hash stream, not the same
    random stream.
    """
    rows = spark.range(n_rows)
    h = lambda salt: F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt))
    return template_journal(
        rows,
        F.pmod(h(0), F.lit(TOTAL_WEIGHT)),
        F.format_string("V%06d", F.col("id") + 1),  # at least six digits, never cut
        F.date_add(F.lit("2025-01-01").cast("date"), F.pmod(h(1), F.lit(365)).cast("int")),
        ((F.pmod(h(2), F.lit(4991)) + 10) * 1000).cast("long"),
    )


def evaluation_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled cases spread over every lineitem row: vendor, context_text, true_label."""
    li = read_table(spark, sf_dir, "lineitem")
    cases = F.expr(
        "array("
        + ", ".join(
            f"named_struct('vendor', {_sql_str(v)}, 'context_text', {_sql_str(c)}, 'true_label', {_sql_str(lbl)})"
            for v, c, lbl in EVALUATION_CASES
        )
        + ")"
    )
    case = F.element_at(cases, (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(len(EVALUATION_CASES))) + 1).cast("int"))
    return li.select(
        lineitem_voucher().alias("voucher_no"),
        case["vendor"].alias("vendor"),
        case["context_text"].alias("context_text"),
        case["true_label"].alias("true_label"),
    )


#: A quote inside a quoted value is doubled; white space at the edges belongs to the value.
CSV_OPTIONS = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
INFER_ROWS = 10_000


def _inferred(text: DataFrame, rows: int) -> dict[str, str]:
    """Type of each column from the first ``rows`` rows: the first of int, bigint,
    double, date that all their values can be cast to; string if none or no value."""
    kinds = ("int", "bigint", "double", "date")
    head = text.limit(rows)
    sums = [F.count_if(F.col(f"`{c}`").isNotNull()).alias(f"{k}_any") for k, c in enumerate(text.columns)]
    for k, c in enumerate(text.columns):
        sums += [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"{k}_{t}") for t in kinds]
    got = head.agg(*sums).first()
    return {c: next((t for t in kinds if got[f"{k}_any"] and not got[f"{k}_{t}"]), "string") for k, c in enumerate(text.columns)}


def line_end_files(spark: SparkSession, path) -> tuple[list[str], list[str]]:
    """(files in which each line has its quotes in pairs, other files).

    Read as plain lines, split like any text file: in a file of the first kind no record
    goes over a line end, whatever its values hold, so it can be split for reading too.
    One row a file reaches the driver.
    """
    odd = F.max(F.regexp_count("value", F.lit('"')) % 2).alias("odd")
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(odd).collect()
    return [r["file"] for r in files if not r["odd"]], [r["file"] for r in files if r["odd"]]


def read_journal(spark: SparkSession, path: str, schema=None, multi_line: bool | None = None, infer_rows: int = INFER_ROWS,
                 position_col: str | None = None) -> DataFrame:
    """Read a journal by suffix: CSV (header, UTF-8, given or inferred schema) or Parquet.

    Without a schema the types come from the first ``infer_rows`` rows, so the
    input isn't read once more; a later value that doesn't fit its column's type
    is an error, never a null.  ``multi_line=False`` lets Spark split a CSV file
    and is right only where no value holds a line end; by default a pass over the
    quotes finds the files for which it is, and only the others are read in one
    task each.  ``position_col`` adds the row's number in file order, stamped on the
    scan (files of both kinds together are then read whole).
    """
    suffix = str(path).lower().rsplit(".", 1)[-1].rstrip("/")
    if suffix == "csv":
        # only an unquoted empty value is null: the reader gives it the null text, which no value equals
        def scan(files, whole: bool) -> DataFrame:
            r = spark.read.options(**CSV_OPTIONS).option("multiLine", whole).option("nullValue", "\u0000").option("emptyValue", "")
            return (r.schema(schema) if schema is not None else r).csv(files)

        even, odd = line_end_files(spark, path) if multi_line is None else ([], [])
        if even and odd and not position_col:
            df = scan(even, False).unionByName(scan(odd, True))
        else:
            df = scan(path, bool(odd) if multi_line is None else multi_line)
        if schema is None:
            kinds = _inferred(df, infer_rows)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file type: .{suffix} (csv, parquet)")
    if position_col:
        df = file_positions(df, position_col)
    if suffix == "csv" and schema is None:
        df = df.select(*[F.col(f"`{c}`").cast(kinds.get(c, "bigint")).alias(c) for c in df.columns])
    return df


def write_journal(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a journal; a CSV keeps line ends, quotes and edge spaces, and tells null from empty."""
    if fmt == "csv":
        df.write.mode(mode).options(**CSV_OPTIONS).option("emptyValue", '""').csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def noisy_part_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vendor string per ``part`` row: a deterministic corruption of its name.

    Kind by part key mod 6: 0 copy, 1 branch suffix, 2 dropped character,
    3 swapped neighbours, 4 brand prefix, 5 unrelated name (label null).
    """
    p = read_table(spark, sf_dir, "part")
    name, key = F.col("p_name"), F.col("p_partkey")
    n = F.char_length(name)
    k = (F.pmod(key, n) + 1).cast("int")  # 1-based position
    kind = F.pmod(key, F.lit(6))
    vendor = (
        F.when(kind == 0, name)
        .when(kind == 1, F.concat(name, F.lit(" branch "), F.pmod(key, F.lit(10)).cast("string")))
        .when(kind == 2, F.concat(F.expr("substring(p_name, 1, pmod(p_partkey, char_length(p_name)))"),
                                  F.expr("substring(p_name, pmod(p_partkey, char_length(p_name)) + 2)")))
        .when(kind == 3, F.when(k >= n, name).otherwise(
            F.concat(F.expr("substring(p_name, 1, pmod(p_partkey, char_length(p_name)))"),
                     F.expr("substring(p_name, pmod(p_partkey, char_length(p_name)) + 2, 1)"),
                     F.expr("substring(p_name, pmod(p_partkey, char_length(p_name)) + 1, 1)"),
                     F.expr("substring(p_name, pmod(p_partkey, char_length(p_name)) + 3)"))))
        .when(kind == 4, F.concat(F.col("p_brand"), F.lit(" "), name))
        .otherwise(F.col("p_type"))
    )
    return p.select(
        "p_partkey",
        vendor.alias("vendor"),
        F.when(kind == 5, F.lit(None).cast("string")).otherwise(name).alias("true_label"),
    )
