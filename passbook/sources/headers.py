"""Resolving header spellings to the canonical columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import strip_whitespace
from passbook.schemas import RAW_FIELDS

# Header spellings accepted for each canonical column.
HEADER_ALIASES = {
    "transaction_date_raw": ("date", "txn date", "transaction date", "value date"),
    "description_raw": ("description", "narration", "particulars", "remarks", "details"),
    "debit_raw": ("debit", "withdrawal", "debit amount", "dr"),
    "credit_raw": ("credit", "deposit", "credit amount", "cr"),
    "balance_raw": ("balance", "closing balance", "available balance"),
}
REQUIRED = ("transaction_date_raw", "description_raw")


def canonical_name(header: Column) -> Column:
    """Canonical column a header spelling stands for, NULL when it is unknown."""
    key = F.lower(strip_whitespace(header))
    case = None
    for name, aliases in HEADER_ALIASES.items():
        hit = key.isin(*aliases)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case


def column_positions(cells: Column) -> Column:
    """STRUCT canonical -> 0-based position of the first header claiming it, NULL if none."""
    names = F.transform(cells, lambda c: F.coalesce(canonical_name(c), F.lit("")))
    return F.struct(
        *[
            (F.nullif(F.array_position(names, name), F.lit(0)) - 1).cast("int").alias(name)
            for name in RAW_FIELDS
        ]
    )


def missing_required(positions: str) -> Column:
    return F.filter(
        F.array(*[F.when(F.col(f"{positions}.{n}").isNull(), n) for n in REQUIRED]),
        lambda n: n.isNotNull(),
    )


def map_headers(headers: DataFrame) -> DataFrame:
    """``file, pos, header`` rows -> the claimed canonical column, NULL when ignored.

    In a file, the smallest position claims a column and later spellings of it are ignored.
    """
    named = headers.withColumn("_name", canonical_name(F.col("header")))
    claims = (
        named.filter(F.col("_name").isNotNull())
        .groupBy("file", "_name")
        .agg(F.min("pos").alias("pos"))
        .select("file", "pos", F.col("_name").alias("canonical"))
    )
    return named.drop("_name").join(claims, ["file", "pos"], "left")


def required_columns_report(mapped: DataFrame) -> DataFrame:
    """Per file: which required columns are missing and how many headers were ignored."""
    def claimed(name):
        return F.coalesce(F.bool_or(F.col("canonical") == name), F.lit(False))

    return mapped.groupBy("file").agg(
        F.concat_ws(",", *[F.when(~claimed(n), n) for n in REQUIRED]).alias("missing_required"),
        F.count_if(F.col("canonical").isNull()).alias("ignored_headers"),
    )


def fill_and_blank(rows: DataFrame) -> DataFrame:
    """Absent canonical columns become NULL, empty strings become NULL."""
    have = set(rows.columns)
    return rows.withColumns(
        {
            n: F.nullif(F.col(n), F.lit("")) if n in have else F.lit(None).cast("string")
            for n in RAW_FIELDS
        }
    )
