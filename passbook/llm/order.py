"""Running sums in a global order, without one task ever seeing a whole group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.scratch import written


def running(rows: DataFrame, group: list[str], order: list[str], amount: str, folder: str, name: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same group that come earlier in ``order``.

    Rows are dealt out by ranges of (group, order), so a group that holds most rows is many pieces. Sums
    run inside the pieces; each piece adds the total of the pieces before it. ``group`` columns hold no
    nulls. Rows that tie in every column of ``order`` keep an arbitrary, but single, order among
    themselves. The pieces are a written table, so a lost executor changes no sum.
    """
    pieces = written(rows.repartitionByRange(*group, *order).withColumn("_piece", F.spark_partition_id()), folder, name)
    inside = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*group, "_piece").agg(F.sum(amount).alias("_total"))
    starts = totals.select(*group, "_piece", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    summed = pieces.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(starts, [*group, "_piece"]).withColumn("before", F.col("_start") + F.col("_inside")).drop("_piece", "_start", "_inside")


def numbered_sources(rows: DataFrame, nulls_last: bool, folder: str) -> DataFrame:
    """(source, number, and the other columns of ``rows``): one row per source, numbered from 0 in code point order."""
    last = F.col("source").isNull().cast("int") if nulls_last else F.col("source").isNotNull().cast("int")
    keyed = rows.withColumns({"_last": last, "_name": F.coalesce("source", F.lit("")), "_one": F.lit(1)})
    placed = running(keyed, [], ["_last", "_name"], "_one", folder, "sources")
    return placed.withColumnRenamed("before", "number").drop("_last", "_name", "_one")
