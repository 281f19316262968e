"""Groups of rows for one model request each.

A global row number would put every row in one task. The key is a sha256, so its leading hex
digits cut the rows into even shards; ranking inside a shard is enough to form batches. The
number of digits follows the row count, keeping a shard near ROWS_PER_SHARD at any scale.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH_SIZE = 25
ROWS_PER_SHARD = 100_000


def shard_digits(rows: int, rows_per_shard: int = ROWS_PER_SHARD) -> int:
    digits = 1
    while rows > rows_per_shard * 16**digits:
        digits += 1
    return digits


def assign_batches(
    rows: DataFrame, digits: int, size: int = BATCH_SIZE, key: str = "txn_key_hash"
) -> DataFrame:
    """Add ``batch_id`` (text) and ``local_id`` (0-based position in the batch)."""
    shard = F.substring(key, 1, digits)
    place = F.row_number().over(Window.partitionBy(shard).orderBy(key)) - 1
    return (
        rows.withColumn("_place", place)
        .withColumn("batch_id", F.concat_ws("-", shard, F.expr(f"_place div {size}")))
        .withColumn("local_id", (F.col("_place") % size).cast("bigint"))
        .drop("_place")
    )


def _item() -> Column:
    return F.struct(
        F.col("local_id").alias("id"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
    )


def request_payloads(batched: DataFrame) -> DataFrame:
    """One JSON array per batch; a batch holds at most ``size`` rows, so the list is bounded."""
    items = F.array_sort(F.collect_list(_item()))
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.to_json(items).alias("payload")
    )


def map_local_ids(answers: DataFrame, batched: DataFrame) -> DataFrame:
    """(batch, local id) answers back to transaction keys."""
    return batched.select("batch_id", "local_id", "txn_key_hash").join(
        answers, ["batch_id", "local_id"]
    )
