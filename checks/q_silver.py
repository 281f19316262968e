"""Cleaning, quarantine, dedupe, manual entries."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from passbook import functions as fn
from passbook.operators import dedupe as dd
from passbook.operators import manual as man
from passbook.operators import quality as qa
from passbook.plans.refine import silver_rows

DAY = "strftime(txn_date,'%Y-%m-%d')"


def day(name="txn_date"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("B1_parse_date", f"SELECT row_hash, transaction_date_raw, {DAY} AS txn_date FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "transaction_date_raw", day())


@query("B2_parse_amount", "SELECT row_hash, debit_amount, credit_amount, balance_amount FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "debit_amount", "credit_amount", "balance_amount")


@query("B3_signed_amount", "SELECT row_hash, amount FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "amount")


@query("B4_clean_text", "SELECT row_hash, description FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "description")


@query("B6_txn_key_hash", "SELECT row_hash, txn_key_hash FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "txn_key_hash")


@query("B7_quarantine_reason", "SELECT row_hash, quarantine_reason FROM cleaned", ["cleaned"])
def _(spark, sf):
    return fx.cleaned(spark, sf).select("row_hash", "quarantine_reason")


@query(
    "C1_split_valid_quarantine",
    "SELECT row_hash, CASE WHEN quarantine_reason IS NULL THEN 'valid' ELSE 'quarantine' END AS part FROM cleaned",
    ["cleaned"],
)
def _(spark, sf):
    good, bad = qa.split_valid(fx.cleaned(spark, sf))
    return good.select("row_hash", F.lit("valid").alias("part")).unionByName(
        bad.select("row_hash", F.lit("quarantine").alias("part"))
    )


_SILVER_SQL = f"SELECT txn_key_hash, {DAY} AS txn_date, amount, description, balance_amount, source_file, source_row_index FROM silver"


def _silver(spark, sf):
    return silver_rows(fx.bronze(spark, sf)).select(
        "txn_key_hash", day(), "amount", "description", "balance_amount", "source_file", "source_row_index"
    )


for name in ("E8_dedupe_valid", "F2_keep_first", "D10_source_dup_across_uploads"):
    query(name, _SILVER_SQL, ["silver"])(_silver)


@query(
    "E1_layer_counts",
    """SELECT count(*) AS rows_read, count(*) FILTER (quarantine_reason IS NULL) AS rows_valid,
       count(*) FILTER (quarantine_reason IS NOT NULL) AS rows_quarantined FROM cleaned""",
    ["cleaned"],
)
def _(spark, sf):
    return qa.layer_counts(fx.cleaned(spark, sf))


@query(
    "C2_all_invalid_guard",
    "SELECT count(*) AS rows_valid, count(*) = 0 AS all_invalid FROM cleaned WHERE quarantine_reason IS NULL",
    ["cleaned"],
)
def _(spark, sf):
    counts = qa.layer_counts(fx.cleaned(spark, sf))
    return counts.select("rows_valid", (F.col("rows_valid") == 0).alias("all_invalid"))


@query("C8_non_empty_guard", "SELECT txn_key_hash FROM silver", ["silver"])
def _(spark, sf):
    return qa.require_rows(fx.silver(spark, sf), "silver").select("txn_key_hash")


@query("B8_manual_key", "SELECT entry_id, sha256('manual::' || entry_id) AS txn_key_hash FROM form", ["form"])
def _(spark, sf):
    return fx.manual_form(spark, sf).select("entry_id", fn.manual_key(F.col("entry_id")).alias("txn_key_hash"))


@query(
    "B9_has_explicit_category",
    "SELECT entry_id, (category <> '' AND category <> 'Uncategorized') AS explicit FROM form",
    ["form"],
)
def _(spark, sf):
    return fx.manual_form(spark, sf).select("entry_id", man.has_explicit_category(F.col("category")).alias("explicit"))


@query(
    "B10_manual_to_gold",
    f"SELECT txn_key_hash, {DAY} AS txn_date, merchant AS description, amount, 'MANUAL' AS source_type, 'manual_entry' AS source_file FROM manual",
    ["manual"],
)
def _(spark, sf):
    return man.manual_to_gold(fx.manual(spark, sf)).withColumn("txn_date", day())


@query(
    "B11_sign_manual",
    "SELECT entry_id, CAST(CASE WHEN direction LIKE 'Expense%' THEN -abs(amount) ELSE abs(amount) END AS DOUBLE) AS amount FROM form",
    ["form"],
)
def _(spark, sf):
    return fx.manual_form(spark, sf).select(
        "entry_id", man.sign_manual(F.col("amount"), F.col("direction")).alias("amount")
    )


@query("C3_validate_manual", "SELECT entry_id, errors FROM judged", ["judged"])
def _(spark, sf):
    judged = man.validate_manual(fx.manual_form(spark, sf), F.lit(fx.AS_OF).cast("date"))
    return judged.select("entry_id", F.concat_ws(",", "errors").alias("errors"))


@query(
    "A19_manual_store",
    "SELECT merchant, amount, category, count(*) AS entries FROM manual GROUP BY ALL",
    ["manual"],
)
def _(spark, sf):
    from passbook.plans.workspace import Workspace
    from passbook.scratch import scratch_folder
    from passbook.sources.manual_store import append_manual

    table = Workspace(spark, scratch_folder(spark, "manual")).manual
    append_manual(table, fx.manual(spark, sf))
    return table.read().groupBy("merchant", "amount", "category").agg(F.countDistinct("entry_id").alias("entries"))


_LOG_SQL = f"""SELECT amount, merchant, {DAY} AS txn_date, category, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at
  FROM manual ORDER BY logged_at DESC, entry_id DESC"""


def _log(spark, sf):
    return man.manual_log(fx.manual(spark, sf))


query("B19_manual_log_view", _LOG_SQL, ["manual"])(_log)
query("G5_newest_first", _LOG_SQL, ["manual"])(_log)


@query(
    "B12_gold_contract",
    f"SELECT txn_key_hash, {DAY} AS txn_date, description, amount, source_type, source_file FROM silver",
    ["silver"],
)
def _(spark, sf):
    from passbook.schemas import GOLD_CONTRACT, conform

    return conform(fx.silver(spark, sf), GOLD_CONTRACT).withColumn("txn_date", day())


_UNION_SQL = "SELECT txn_key_hash, description, amount, source_type FROM combined"


def _union(spark, sf):
    return dd.union_sources(
        fx.silver(spark, sf).select("txn_key_hash", "description", "amount", "source_type", "source_file"),
        man.manual_to_gold(fx.manual(spark, sf)).select("txn_key_hash", "description", "amount", "source_type", "source_file"),
    )


@query("H1_union_sources", _UNION_SQL, ["combined"])
def _(spark, sf):
    return _union(spark, sf).select("txn_key_hash", "description", "amount", "source_type")


@query(
    "E7_dedupe_keep_last",
    """SELECT txn_key_hash, 'MANUAL' AS source_type FROM manual UNION ALL SELECT txn_key_hash, source_type FROM silver""",
    ["silver", "manual"],
)
def _(spark, sf):
    """Every manual key also arrives as an older statement row and must lose to the entry."""
    rows = _union(spark, sf)
    older = rows.filter("source_priority = 1").withColumns(
        {"source_priority": F.lit(0), "source_type": F.lit("OLD")}
    )
    return dd.dedupe_keep_last(rows.unionByName(older)).select("txn_key_hash", "source_type")


@query("K2_refine", f"SELECT txn_key_hash, {DAY} AS txn_date, amount, description, quarantine_reason FROM silver", ["silver"])
def _(spark, sf):
    from passbook.plans.refine import refine
    from passbook.plans.workspace import Workspace
    from passbook.scratch import scratch_folder

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    workspace.bronze.append(fx.bronze(spark, sf))
    refine(workspace)
    return workspace.silver.read().select("txn_key_hash", day(), "amount", "description", "quarantine_reason")
