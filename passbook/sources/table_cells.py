"""Rows of tables already extracted from paged statements."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import strip_whitespace
from passbook.schemas import RAW_FIELDS

# A row naming at least three of these is a repeated header.
HEADER_TOKENS = ("date", "description", "debit", "credit", "balance")


def header_overlap(cells: Column) -> Column:
    """How many distinct header tokens the row names."""
    names = F.transform(cells, lambda c: F.lower(strip_whitespace(c)))
    return F.size(F.array_intersect(names, F.array(*[F.lit(t) for t in HEADER_TOKENS])))


def clean_cell(cell: Column) -> Column:
    return F.nullif(strip_whitespace(F.replace(cell, F.lit("\n"), F.lit(" "))), F.lit(""))


def normalize_table_rows(table_rows: DataFrame) -> DataFrame:
    """``source_file, page, table_no, row_index, cells`` -> raw rows.

    NULL, header and blank rows go; short rows are padded, long ones cut to five cells. The index
    counts from 0 in each table, skipped rows included.
    """
    cells = F.transform("cells", clean_cell)
    kept = (
        table_rows.filter(F.col("cells").isNotNull() & (header_overlap(F.col("cells")) < 3))
        .withColumn("_cells", cells)
        .filter(F.exists("_cells", lambda c: c.isNotNull()))
    )
    return kept.select(
        *[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(RAW_FIELDS)],
        F.col("page").cast("string").alias("source_page"),
        F.col("row_index").cast("string").alias("source_row_index"),
        "source_file",
        "table_no",
    )
