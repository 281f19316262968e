"""Running balance that never drops below zero.

With ``S`` the running sum including the opening balance, the floored balance is
``S - least(0, min of S so far)``. Both parts are prefix aggregates, so an account is cut into
ordered chunks that are scanned on their own and stitched through one small row per chunk: an
account holding a third of all rows is spread over as many tasks as it has chunks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"
SEQ_PER_CHUNK = 1_000_000


def running_balance(
    moves: DataFrame, opening: DataFrame, seq_per_chunk: int = SEQ_PER_CHUNK
) -> DataFrame:
    """``moves``: account, d, seq, amount. ``opening``: account, opening (missing counts as 0).

    A move without an account, day or sequence number has no place in a balance and is left out.

    ``seq`` is unique inside an account and day, so a chunk (account, day, seq range) never
    holds more than ``seq_per_chunk`` rows.
    """
    chunk = ["account", "d", "seq_range"]
    # the null tests are those both uses of the rows need, so that they share one shuffle
    parts = (
        moves.withColumn("seq_range", F.expr(f"seq div {int(seq_per_chunk)}"))
        .withColumn("amount", F.col("amount").cast(MONEY))
        .filter("account IS NOT NULL AND d IS NOT NULL AND seq_range IS NOT NULL")
    )
    in_chunk = Window.partitionBy(*chunk).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_sum", F.sum("amount").over(in_chunk).cast(MONEY)).withColumn(
        "_low", F.min("_sum").over(in_chunk)
    )

    totals = local.groupBy(*chunk).agg(
        F.sum("amount").cast(MONEY).alias("_total"), F.min("_sum").alias("_chunk_low")
    )
    before = Window.partitionBy("account").orderBy("d", "seq_range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.join(opening, "account", "left")
        .withColumn("_open", F.coalesce("opening", F.lit(0)).cast(MONEY))
        .withColumn(
            "_start",
            (F.col("_open") + F.coalesce(F.sum("_total").over(earlier), F.lit(0))).cast(MONEY),
        )
        .withColumn(
            "_floor",
            F.least(
                F.lit(0).cast(MONEY),
                F.min((F.col("_start") + F.col("_chunk_low")).cast(MONEY)).over(earlier),
            ),
        )
        .select(*chunk, "_start", "_floor")
    )
    reached = (F.col("_start") + F.col("_sum")).cast(MONEY)
    lowest = F.least("_floor", (F.col("_start") + F.col("_low")).cast(MONEY))
    return local.join(offsets, chunk).select(
        "account",
        "d",
        "seq",
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        (reached - lowest).cast("decimal(18,2)").alias("balance"),
    )
