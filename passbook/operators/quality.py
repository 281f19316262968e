"""Row-level cleaning and the gates around it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.schemas import EmptyTable


def clean_rows(bronze: DataFrame) -> DataFrame:
    """Add the typed columns, business key and quarantine reason. Keeps every row and column."""
    typed = bronze.withColumns(
        {
            "txn_date": fn.parse_date(F.col("transaction_date_raw")),
            "debit_amount": fn.parse_amount(F.col("debit_raw")),
            "credit_amount": fn.parse_amount(F.col("credit_raw")),
            "balance_amount": fn.parse_amount(F.col("balance_raw")),
            "description": fn.clean_text(F.col("description_raw")),
        }
    )
    signed = typed.withColumn(
        "amount", fn.signed_amount(F.col("debit_amount"), F.col("credit_amount"))
    )
    day, amount, text = F.col("txn_date"), F.col("amount"), F.col("description")
    return signed.withColumns(
        {
            "txn_key_hash": fn.txn_key_hash(day, amount, text, F.col("balance_amount")),
            "quarantine_reason": fn.quarantine_reason(day, amount, text),
        }
    )


def is_valid():
    """Same as a NULL quarantine_reason, without building the reason text in the filter."""
    return F.col("txn_date").isNotNull() & F.col("amount").isNotNull() & F.col("description").isNotNull()


def split_valid(cleaned: DataFrame):
    """(valid, quarantined). Quarantined rows are never deduplicated."""
    return cleaned.filter(is_valid()), cleaned.filter(~is_valid())


def layer_counts(cleaned: DataFrame) -> DataFrame:
    """Rows read, valid and quarantined in one pass."""
    reason = F.col("quarantine_reason")
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(reason.isNull()).alias("rows_valid"),
        F.count_if(reason.isNotNull()).alias("rows_quarantined"),
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Refuse an empty table; reads at most one row."""
    if df.isEmpty():
        raise EmptyTable(f"refusing an empty {what} table")
    return df
