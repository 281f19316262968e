"""Vector arithmetic on ARRAY columns, for projections. Bulk search is in operators.search."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; the zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
