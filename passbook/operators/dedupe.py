"""Keep one row per key, chosen by an explicit order.

Each is a ``row_number() = 1`` filter: Spark puts a group limit in front of the shuffle, so every
task sends at most one row per key. A key that holds a third of all rows therefore costs its
final task one row per map task, not a third of the table.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions import packed, unpacked


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_raw(df: DataFrame) -> DataFrame:
    """One row per row_hash; copies can differ in the balance only, so that decides."""
    return keep_first(df, ["row_hash"], [F.asc_nulls_last("balance_raw")])


SURVIVOR_ORDER = (
    "ingested_at",
    "source_file",
    "source_page",
    "source_row_index",
    # equal keys may still differ in the raw text, so the order is made total
    "transaction_date_raw",
    "description_raw",
    "debit_raw",
    "credit_raw",
    "balance_raw",
)


def dedupe_valid(df: DataFrame) -> DataFrame:
    """One row per business key: the earliest upload survives."""
    present = [c for c in SURVIVOR_ORDER if c in df.columns]
    return keep_first(df, ["txn_key_hash"], [F.asc_nulls_first(c) for c in present])


def dedupe_cleaned(df: DataFrame) -> DataFrame:
    """``dedupe_valid`` of the valid rows, taking cleaned rows of both kinds.

    Filtering first would push the test below the cleaning expressions and evaluate every parse
    twice; behind the ranking it reads the finished column. Quarantined rows cannot displace a
    valid one: a valid key has no empty date, amount or description, and valid rows rank first.
    """
    present = [c for c in ("quarantine_reason", *SURVIVOR_ORDER) if c in df.columns]
    digests = [c for c in ("txn_key_hash", "row_hash") if c in df.columns]
    dealt = df.withColumns({c: packed(F.col(c)) for c in digests})
    ranked = keep_first(dealt, ["txn_key_hash"], [F.asc_nulls_first(c) for c in present])
    return ranked.filter(F.col("quarantine_reason").isNull()).withColumns({c: unpacked(F.col(c)) for c in digests})


def union_sources(statements: DataFrame, manual: DataFrame) -> DataFrame:
    """Statements, then manual entries, with the priority the later dedupe needs."""
    return statements.withColumn("source_priority", F.lit(0)).unionByName(
        manual.withColumn("source_priority", F.lit(1))
    )


def dedupe_keep_last(df: DataFrame) -> DataFrame:
    """One row per key, the last source winning; expects ``source_priority``."""
    order = [F.desc("source_priority"), F.desc("source_file"), F.desc("description")]
    return keep_first(df, ["txn_key_hash"], order).drop("source_priority")
