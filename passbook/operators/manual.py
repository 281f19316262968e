"""Manually logged entries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.schemas import MANUAL_SOURCE, UNSET_CATEGORY


def manual_errors(as_of: Column) -> Column:
    """ARRAY of every rule an entry breaks, empty when it is fine."""
    merchant = fn.strip_whitespace(F.col("merchant"))
    return F.filter(
        F.array(
            F.when(F.col("amount").isNull() | (F.col("amount") <= 0), "amount_not_positive"),
            F.when(F.coalesce(merchant, F.lit("")) == "", "merchant_blank"),
            F.when(F.col("txn_date") > as_of, "date_in_future"),
        ),
        lambda e: e.isNotNull(),
    )


def validate_manual(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.withColumn("errors", manual_errors(as_of))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)


def sign_manual(amount: Column, direction: Column) -> Column:
    """Expense becomes negative, income positive, to the cent."""
    size = F.round(F.abs(amount).cast("decimal(18,4)"), 2)
    return F.when(direction.startswith("Expense"), -size).otherwise(size).cast("double")


def log_entries(entries: DataFrame, as_of: Column) -> DataFrame:
    """Form rows -> signed, trimmed entries; rejected rows are dropped (see ``rejected``)."""
    good = accepted(validate_manual(entries, as_of))
    return good.withColumns(
        {
            "amount": sign_manual(F.col("amount"), F.col("direction")),
            "merchant": fn.strip_whitespace(F.col("merchant")),
        }
    ).drop("direction")


def has_explicit_category(category: Column) -> Column:
    return F.coalesce((category != "") & (category != UNSET_CATEGORY), F.lit(False))


def manual_to_gold(entries: DataFrame, keep=()) -> DataFrame:
    """Entries in the Gold contract, plus the columns named in ``keep``."""
    return entries.select(
        fn.manual_key(F.col("entry_id")).alias("txn_key_hash"),
        F.col("txn_date").cast("date").alias("txn_date"),
        F.col("merchant").alias("description"),
        F.col("amount").cast("double").alias("amount"),
        F.lit(MANUAL_SOURCE).alias("source_type"),
        F.lit("manual_entry").alias("source_file"),
        *keep,
    )


def manual_overrides(entries: DataFrame) -> DataFrame:
    """(key, category) of the entries whose category a person chose."""
    return entries.filter(has_explicit_category(F.col("category"))).select(
        fn.manual_key(F.col("entry_id")).alias("txn_key_hash"), "category"
    )


def manual_log(entries: DataFrame) -> DataFrame:
    """Display rows, newest first."""
    return entries.orderBy(F.desc("logged_at"), F.desc("entry_id")).select(
        F.col("amount"),
        F.col("merchant"),
        F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"),
        F.col("category"),
        F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
    )
