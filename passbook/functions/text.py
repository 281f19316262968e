"""Text cleaning and rendering."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(raw: Column) -> Column:
    """Collapse whitespace runs, trim, blank becomes NULL. Text without runs is not rewritten."""
    collapsed = F.when(raw.rlike(r"[\t\n\x0B\f\r]| {2}"), F.regexp_replace(raw, r"\s+", " "))
    return F.nullif(F.trim(F.coalesce(collapsed, raw)), F.lit(""))


def empty_to_null(raw: Column) -> Column:
    """Only the empty string becomes NULL; whitespace is kept for the cleaning step."""
    return F.nullif(raw, F.lit(""))


def strip_whitespace(raw: Column) -> Column:
    """Trim spaces, tabs and line breaks (``trim`` alone strips spaces only)."""
    return F.regexp_replace(raw, r"^\s+|\s+\z", "")


def grouped_money(amount: Column) -> Column:
    """``1,234.50`` with half-even rounding, as used inside keys."""
    return F.format_number(amount, 2)


def plain_money(amount: Column) -> Column:
    """``1234.50`` with half-even rounding."""
    return F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))


def iso_day(day: Column) -> Column:
    """``yyyy-MM-dd`` of a DATE; the cast needs no time zone and no formatter."""
    return day.cast("string")


def month_bucket(day: Column) -> Column:
    return F.substring(iso_day(day), 1, 7)


def month_number(day: Column) -> Column:
    """Months since year 0; -1 without a date."""
    return F.coalesce(F.year(day) * 12 + F.month(day) - 1, F.lit(-1))


def render_document(
    txn_date: Column, amount: Column, description: Column, category: Column, source_type: Column
) -> Column:
    """One sentence per transaction, the text that is embedded and shown as evidence."""
    direction = F.when(amount > 0, "received").otherwise("spent")
    return F.concat(
        F.lit("On "),
        iso_day(txn_date),
        F.lit(", "),
        direction,
        F.lit(" Rs "),
        plain_money(F.abs(amount)),
        F.lit(" ("),
        description,
        F.lit("), category: "),
        category,
        F.lit(", source: "),
        source_type,
        F.lit("."),
    )
