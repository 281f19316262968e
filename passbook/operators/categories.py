"""Category cache, overrides and the rule-based default."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.schemas import CATEGORY_OPTIONS, UNSET_CATEGORY

# Keyword rules, first match by position; a positive amount is Income before any.
CATEGORY_RULES = (
    ("SWIGGY", "Food & Dining"),
    ("ZOMATO", "Food & Dining"),
    ("BIGBASKET", "Groceries"),
    ("GROCERIES", "Groceries"),
    ("UBER", "Transport"),
    ("AMAZON", "Shopping"),
    ("FLIPKART", "Shopping"),
    ("ELECTRICITY BILL", "Bills & Utilities"),
    ("JIO PREPAID", "Bills & Utilities"),
    ("RENT PAYMENT", "Rent"),
    ("NETFLIX", "Entertainment"),
    ("IRCTC", "Travel"),
    ("ATM WDL", "Other"),
)


def rule_category(description: Column, amount: Column, rules=CATEGORY_RULES) -> Column:
    """One CASE expression: no join, no shuffle, stays inside code generation."""
    upper = F.upper(description)
    case = F.when(amount > 0, "Income")
    for pattern, category in rules:
        case = case.when(upper.contains(pattern), category)
    return case.otherwise(UNSET_CATEGORY)


def allowed_category(category: Column) -> Column:
    """Anything outside the list, NULL included, becomes the unset category."""
    return F.when(category.isin(*CATEGORY_OPTIONS), category).otherwise(UNSET_CATEGORY)


def merge_overrides(cache: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cache with every override on top. Both sides hold one row per key."""
    chosen = overrides.select("txn_key_hash", F.col("category").alias("_chosen"))
    return cache.join(chosen, "txn_key_hash", "full").select(
        "txn_key_hash",
        F.coalesce("_chosen", "category").alias("category"),
        F.when(F.col("_chosen").isNotNull(), "override").otherwise(F.col("origin")).alias("origin"),
    )


def uncached(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.join(cache.select("txn_key_hash"), "txn_key_hash", "left_anti")


def look_up(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with their cached category, NULL when there is none: one join tells both apart."""
    return rows.join(cache.select("txn_key_hash", "category"), "txn_key_hash", "left")


def attach_category(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return look_up(rows, cache).withColumn(
        "category", F.coalesce("category", F.lit(UNSET_CATEGORY))
    )


def cache_stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(
        F.count("category").alias("already_categorized"),
        F.count_if(F.col("category").isNull()).alias("new_rows"),
        F.count_if(F.coalesce("category", F.lit(UNSET_CATEGORY)) == UNSET_CATEGORY).alias(
            "still_uncategorized"
        ),
    )


def cache_entries(results: DataFrame, origin: Column) -> DataFrame:
    """Results as cache rows. Fallbacks are cached as well, so they are not asked again."""
    return results.select("txn_key_hash", "category", origin.alias("origin"), F.current_timestamp().alias("decided_at"))


def readable_cache(cache: DataFrame, retry_fallbacks: bool = False, with_model: bool = False) -> DataFrame:
    """The decisions that count as answers: the last one of each key, one row per key.

    ``retry_fallbacks`` leaves out what a model failed to answer; ``with_model`` leaves out what the
    rules left unset, so that a model plugged in later is asked.
    """
    last = F.max_by(F.struct("category", "origin"), F.struct("decided_at", "origin", "category"))
    answers = cache.groupBy("txn_key_hash").agg(last.alias("_last")).select("txn_key_hash", "_last.*")
    if retry_fallbacks:
        answers = answers.filter(F.col("origin") != "fallback")
    if with_model:
        answers = answers.filter((F.col("origin") != "rule") | (F.col("category") != UNSET_CATEGORY))
    return answers
