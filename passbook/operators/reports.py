"""Filters and figures of the dashboard."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.schemas import MANUAL_SOURCE

MONEY = "decimal(38,10)"


def exact_sum(amount: Column) -> Column:
    """Sum to ten decimals, so the result does not depend on the order partitions arrive in.

    Where an amount or the sum does not fit (1e28 and more), the sum is one of doubles.
    """
    exact = F.try_sum(amount.try_cast(MONEY))
    fits = F.count_if(amount.isNotNull() & amount.try_cast(MONEY).isNull()) == 0
    plain = F.coalesce(F.sum(amount.cast("double")), F.lit(0.0))
    return F.when(fits & exact.isNotNull(), exact.cast("double")).otherwise(plain)


def filter_date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends inclusive; ignored unless both are given."""
    if start is None or end is None:
        return df
    return df.filter(F.col("txn_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_categories(df: DataFrame, categories=()) -> DataFrame:
    """An empty selection selects everything."""
    return df.filter(F.col("category").isin(*categories)) if categories else df


def filter_source(df: DataFrame, source="All") -> DataFrame:
    if source == "Statement":
        return df.filter(F.col("source_type") != MANUAL_SOURCE)
    if source == "Manual":
        return df.filter(F.col("source_type") == MANUAL_SOURCE)
    return df


def kpi(df: DataFrame) -> DataFrame:
    amount = F.col("amount")
    sums = df.agg(
        exact_sum(F.when(amount > 0, amount)).alias("income"),
        exact_sum(F.when(amount < 0, -amount)).alias("expense"),
        exact_sum(amount).alias("net"),
        F.count(F.lit(1)).alias("transactions"),
    )
    return sums


def spend_by_category(df: DataFrame) -> DataFrame:
    spending = df.filter((F.col("amount") < 0) & (F.col("category") != "Income"))
    return (
        spending.groupBy("category")
        .agg(exact_sum(-F.col("amount")).alias("spend"))
        .orderBy(F.desc("spend"), "category")
    )


def net_by_month(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(fn.month_bucket(F.col("txn_date")).alias("month"))
        .agg(exact_sum(F.col("amount")).alias("net"))
        .orderBy("month")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("txn_date").alias("first_day"), F.max("txn_date").alias("last_day"))


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


def display_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.date_format("txn_date", "yyyy-MM-dd").alias("date"),
        "description",
        "amount",
        "category",
        F.col("source_type").alias("source"),
    )


def listing(df: DataFrame, limit=None) -> DataFrame:
    """Newest first. ``limit`` turns the range sort into a top-k."""
    ordered = df.orderBy(F.desc("txn_date"), "txn_key_hash")
    return display_columns(ordered if limit is None else ordered.limit(limit))
