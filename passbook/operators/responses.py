"""Checking model responses as a table operation.

Local ids are 0..n-1 inside a batch, so an id is known when it lies in that range and a batch is
complete when n distinct known ids were answered. Only the per-batch row count is joined.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.operators.categories import allowed_category
from passbook.schemas import UNSET_CATEGORY


def _items(responses: DataFrame) -> DataFrame:
    # try_parse_json ignores what follows the first value. Inside a list and inside an object the
    # text must be one value: whatever follows it would have to close both.
    listed = F.try_parse_json(F.concat(F.lit("["), "raw", F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), "raw", F.lit("}")))
    one = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & named.isNotNull()
    doc = F.when(one & F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).startswith("OBJECT"), F.try_parse_json("raw"))
    parsed = responses.withColumn("_doc", doc).withColumn(
        "_results", F.try_variant_get("_doc", "$.results", "array<variant>")
    )
    return parsed.select(
        "batch_id",
        "attempt",
        "n_rows",
        F.col("_doc").isNotNull().alias("_is_json"),
        F.col("_results").isNotNull().alias("_has_list"),
        F.posexplode_outer("_results").alias("_pos", "_item"),
    )


def validate_responses(batch_sizes: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per (batch, attempt): ``ok``, ``reason``, unknown and missing ids, and the answers.

    ``batch_sizes``: batch_id, n_rows. ``responses``: batch_id, attempt, raw.
    """
    items = _items(responses.join(batch_sizes.select("batch_id", "n_rows"), "batch_id"))
    id_value = F.try_variant_get("_item", "$.id", "variant")
    category_value = F.try_variant_get("_item", "$.category", "variant")
    id_kind = F.schema_of_variant(id_value)
    category_kind = F.schema_of_variant(category_value)
    malformed = (
        id_kind.isNull()
        | category_kind.isNull()
        | category_kind.startswith("ARRAY")
        | category_kind.startswith("OBJECT")
    )
    local_id = F.when(id_kind == "BIGINT", F.try_variant_get("_item", "$.id", "bigint"))
    read = items.select(
        "batch_id",
        "attempt",
        "n_rows",
        "_is_json",
        "_has_list",
        "_pos",
        (F.col("_pos").isNotNull() & malformed).alias("_malformed"),
        local_id.alias("local_id"),
        F.try_variant_get("_item", "$.category", "string").alias("category"),
    ).withColumn(
        "_unknown",
        F.col("_pos").isNotNull()
        & ~F.coalesce(F.col("local_id").between(0, F.col("n_rows") - 1), F.lit(False)),
    )
    # the last answer for an id wins; a response repeating ids collapses map-side here
    per_id = read.groupBy("batch_id", "attempt", "local_id").agg(
        F.max("n_rows").alias("n_rows"),
        F.bool_and("_is_json").alias("_is_json"),
        F.bool_and("_has_list").alias("_has_list"),
        F.bool_or("_malformed").alias("_malformed"),
        F.count_if("_unknown").alias("unknown_ids"),
        F.max_by("category", "_pos").alias("category"),
        F.max("_pos").alias("_pos"),
    )
    known = F.col("_pos").isNotNull() & (F.col("unknown_ids") == 0) & ~F.col("_malformed")
    answer = F.struct("local_id", allowed_category(F.col("category")).alias("category"))
    # only ids inside 0..n_rows-1 are collected, so the list is no longer than its batch
    verdict = per_id.groupBy("batch_id", "attempt").agg(
        F.max("n_rows").alias("n_rows"),
        F.bool_and("_is_json").alias("_is_json"),
        F.bool_and("_has_list").alias("_has_list"),
        F.bool_or("_malformed").alias("_malformed"),
        F.sum("unknown_ids").alias("unknown_ids"),
        F.count_if(known).alias("_known"),
        F.array_sort(F.collect_list(F.when(known, answer))).alias("answers"),
    )
    reason = (
        F.when(~F.col("_is_json"), "invalid_json")
        .when(~F.col("_has_list"), "no_results_list")
        .when(F.col("_malformed"), "malformed_item")
        .when(F.col("unknown_ids") > 0, "unknown_id")
        .when(F.col("_known") < F.col("n_rows"), "missing_id")
    )
    return verdict.select(
        "batch_id",
        "attempt",
        reason.isNull().alias("ok"),
        reason.alias("reason"),
        "unknown_ids",
        (F.col("n_rows") - F.col("_known")).alias("missing_ids"),
        "answers",
    )


def first_valid_attempt(validated: DataFrame) -> DataFrame:
    """(batch_id, local_id, category) from the earliest attempt that passed."""
    order = Window.partitionBy("batch_id").orderBy("attempt")
    first = (
        validated.filter("ok")
        .withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
    )
    return first.select("batch_id", F.inline("answers"))


def with_fallback(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Every batched row with its category; rows of a failed batch become unset."""
    joined = batched.select("batch_id", "local_id", "txn_key_hash").join(
        answers, ["batch_id", "local_id"], "left"
    )
    return joined.select(
        "txn_key_hash",
        F.coalesce("category", F.lit(UNSET_CATEGORY)).alias("category"),
        F.when(F.col("category").isNull(), "fallback").otherwise("model").alias("origin"),
    )
