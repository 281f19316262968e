"""Table-driven cases for the column functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.operators import manual as man


def one_column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


DATES = {
    "05/06/2026": "2026-06-05",
    "13/1/2026": "2026-01-13",
    "01/13/2026": "2026-01-13",
    "1/13/2026": None,
    "5-6-2026": "2026-06-05",
    "15-06-2026": "2026-06-15",
    "2026-06-15": "2026-06-15",
    "2026/06/15": "2026-06-15",
    "2026-6-5": None,
    "2026/6/5": None,
    "15-06-26": None,
    "5/6/26": None,
    "31-02-2026": None,
    "29-02-2023": None,
    "29-02-2024": "2024-02-29",
    "  07-08-2026 ": "2026-08-07",
    "\t07-08-2026": None,
    "07-08-2026\n": None,
    "07-08-2026 10:00": None,
    "07-08/2026": None,
    "01-13-2026": None,
    "0000-01-01": None,
    "2026": None,
    "2026-06": None,
    "": None,
    None: None,
}


def test_parse_date(spark):
    got = one_column(spark, list(DATES), lambda c: fn.parse_date(c).cast("string"))
    assert dict(zip(DATES, got)) == DATES


def test_parse_date_equals_one_formatter_per_layout(spark):
    """Every day/month combination in every layout, against the layouts tried one by one."""
    def pad(n):
        return str(n).zfill(2)

    texts = []
    for a in (0, 1, 9, 12, 13, 28, 30, 31, 32):
        for b in (0, 1, 2, 9, 12, 13, 31):
            for y in ("2023", "2024"):
                for x, z in ((pad(a), pad(b)), (str(a), str(b)), (pad(a), str(b))):
                    texts += [f"{x}-{z}-{y}", f"{x}/{z}/{y}", f"{y}-{x}-{z}", f"{y}/{x}/{z}"]
    slow = one_column(spark, texts, lambda c: F.coalesce(*[F.try_to_date(F.trim(c), f) for f in fn.DATE_FORMATS]))
    assert one_column(spark, texts, fn.parse_date) == slow


AMOUNTS = {
    "Rs. 45,000.00": 45000.0,
    "1,234.56 Cr": 1234.56,
    "(500.00)": 500.0,
    "Rs.500/-": None,
    "INR 7": 7.0,
    "₹ 12.5": 12.5,
    "rs 3": 3.0,
    "-250": -250.0,
    "12e3": 123.0,
    "1.": 1.0,
    ".5": 0.5,
    "1.2.3": None,
    "--5": None,
    "1-2": None,
    "-": None,
    ".": None,
    "": None,
    "   ": None,
    "NaN": None,
    "Infinity": None,
    None: None,
}


def test_parse_amount(spark):
    assert dict(zip(AMOUNTS, one_column(spark, list(AMOUNTS), fn.parse_amount))) == AMOUNTS


def test_signed_amount(spark):
    df = spark.createDataFrame([(10.0, None), (10.0, 0.0), (None, 5.0), (None, None), (-250.0, None)], "d double, c double")
    got = [r[0] for r in df.select(fn.signed_amount(F.col("d"), F.col("c"))).collect()]
    assert got == [-10.0, 0.0, 5.0, None, 250.0]


def test_clean_text(spark):
    cases = {"a  b": "a b", "a\tb\n": "a b", " a b ": "a b", "a b": "a b", "   ": None, "\n": None, "": None, None: None}
    assert dict(zip(cases, one_column(spark, list(cases), fn.clean_text))) == cases


def test_money(spark):
    values = [0.125, 2.675, -0.001, 1234567.891, 0.0, 1e9]
    assert one_column(spark, values, fn.plain_money, "double") == [f"{v:.2f}" for v in values]
    assert one_column(spark, values, fn.grouped_money, "double") == [f"{v:,.2f}" for v in values]


def test_keys(spark):
    row = {"source_file": "f", "source_page": None, "source_row_index": "3", "transaction_date_raw": "d",
           "description_raw": None, "debit_raw": "1", "credit_raw": None}
    df = spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))
    want = hashlib.sha256("||".join(v or "" for v in row.values()).encode()).hexdigest()
    assert df.select(fn.row_hash()).first()[0] == want
    key = spark.range(1).select(
        fn.txn_key_hash(F.lit("2026-01-02").cast("date"), F.lit(-1234.5), F.lit("x"), F.lit(None).cast("double"))
    ).first()[0]
    assert key == hashlib.sha256(b"2026-01-02||-1,234.50||x||").hexdigest()
    assert one_column(spark, ["e1"], fn.manual_key) == [hashlib.sha256(b"manual::e1").hexdigest()]


def test_render_document(spark):
    df = spark.createDataFrame([(10.0,), (-10.0,), (0.0,)], "a double").select(
        fn.render_document(F.lit("2026-01-02").cast("date"), F.col("a"), F.lit("tea"), F.lit("Other"), F.lit("CSV"))
    )
    assert [r[0] for r in df.collect()] == [
        "On 2026-01-02, received Rs 10.00 (tea), category: Other, source: CSV.",
        "On 2026-01-02, spent Rs 10.00 (tea), category: Other, source: CSV.",
        "On 2026-01-02, spent Rs 0.00 (tea), category: Other, source: CSV.",
    ]


def test_quarantine_reason(spark):
    df = spark.createDataFrame([(None, None, None), ("2026-01-01", 1.0, None), ("2026-01-01", 1.0, "x")], "d string, a double, t string")
    got = [r[0] for r in df.select(fn.quarantine_reason(F.col("d"), F.col("a"), F.col("t"))).collect()]
    assert got == ["unparseable_date,missing_amount,missing_description", "missing_description", None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(fn.l2_normalize(F.col("v"))).collect()]
    assert got == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    d = df.limit(1).select(fn.cosine_distance(F.col("v"), F.array(F.lit(4.0), F.lit(3.0)))).first()[0]
    assert math.isclose(d, 1 - 24 / 25)


def test_manual_rules(spark):
    df = spark.createDataFrame(
        [("a", None, " ", "2001-01-02"), ("b", 0.0, "x", "2001-01-01"), ("c", 2.345, "\tshop\n", "2000-01-01"), ("d", -1.0, None, None)],
        "entry_id string, amount double, merchant string, txn_date string",
    ).withColumn("txn_date", F.col("txn_date").cast("date")).withColumn("direction", F.lit("Expense (money out)"))
    as_of = F.lit("2001-01-01").cast("date")
    errors = {r["entry_id"]: r["errors"] for r in man.validate_manual(df, as_of).collect()}
    assert errors == {
        "a": ["amount_not_positive", "merchant_blank", "date_in_future"],
        "b": ["amount_not_positive"],
        "c": [],
        "d": ["amount_not_positive", "merchant_blank"],
    }
    kept = man.log_entries(df, as_of).collect()
    assert [(r["entry_id"], r["amount"], r["merchant"]) for r in kept] == [("c", -2.35, "shop")]
    assert man.rejected(man.validate_manual(df, as_of)).count() == 3
    assert one_column(spark, ["", "Uncategorized", "Rent", None], man.has_explicit_category) == [False, False, True, False]
