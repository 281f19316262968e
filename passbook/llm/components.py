"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.scratch import scratch_folder, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round of star contraction (Kiveris et al. 2014); edges are (a, b) with a > b."""
    if large:
        sides = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    met = sides.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the least node reachable.

    Rounds of large and small stars alternate until nothing changes; their number grows with the
    logarithm of a component's size. Each round is a written table, so a lost executor costs one round.
    Edges with a null end and loops are ignored.
    """
    spark = edges.sparkSession
    folder = scratch_folder(spark, name)
    now = edges.where("a is not null and b is not null and a <> b")
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges")
    digest = None
    for turn in range(100):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == digest:
            break
        digest = state
        now = written(_stars(_stars(now, large=True), large=False), folder, f"round-{turn}")
    else:
        raise RuntimeError("components did not settle in 100 rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return ends.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
