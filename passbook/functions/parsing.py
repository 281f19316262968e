"""Dates, amounts and the reasons a row is set aside."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, first match wins, day-first before month-first.
DATE_FORMATS = (
    "dd-MM-yyyy",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "d-M-yyyy",
    "d/M/yyyy",
)

# The seven layouts are three shapes. A shape test plus a string-to-date cast gives the same
# answers as one formatter per layout without raising an exception inside the JVM for every
# layout that does not fit. \z, not $: a trailing newline is not part of a date.
_DAY_FIRST = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2((?!0000)[0-9]{4})\z"
_YEAR_FIRST = r"^((?!0000)[0-9]{4})([-/])([0-9]{2})\2([0-9]{2})\z"
_MONTH_FIRST = r"^([0-9]{2})/([0-9]{2})/((?!0000)[0-9]{4})\z"

_CURRENCY = r"(?i)(rs\.?|inr|₹)"
_NOT_NUMERIC = r"[^0-9.\-]"


def parse_date(raw: Column) -> Column:
    """DATE from any of DATE_FORMATS, NULL when none fits or the day does not exist."""
    text = F.trim(raw)

    def reorder(shape, order):
        iso = F.regexp_replace(text, shape, order)
        return F.when(text.rlike(shape), iso.try_cast("date"))

    return F.coalesce(
        reorder(_DAY_FIRST, "$4-$3-$1"),
        reorder(_YEAR_FIRST, "$1-$3-$4"),
        reorder(_MONTH_FIRST, "$3-$1-$2"),
    )


def parse_amount(raw: Column) -> Column:
    """DOUBLE from a printed amount; currency marks go first so the dot of ``Rs.`` goes too.

    What is left may be blank or no number; the cast turns both into NULL. Amounts printed as
    bare digits, the common case, skip both replacements.
    """
    unmarked = F.regexp_replace(raw, _CURRENCY, "")
    digits = F.regexp_replace(unmarked, _NOT_NUMERIC, "")
    return F.when(raw.rlike(_NOT_NUMERIC), digits).otherwise(raw).try_cast("double")


def signed_amount(debit: Column, credit: Column) -> Column:
    """Credit when present (even 0.00), otherwise the debit negated."""
    return F.coalesce(credit, -debit)


def quarantine_reason(txn_date: Column, amount: Column, description: Column) -> Column:
    reasons = F.concat_ws(
        ",",
        F.when(txn_date.isNull(), "unparseable_date"),
        F.when(amount.isNull(), "missing_amount"),
        F.when(description.isNull(), "missing_description"),
    )
    return F.nullif(reasons, F.lit(""))
