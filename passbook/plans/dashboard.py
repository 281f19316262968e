"""The dashboard as tables."""

from pyspark.sql import DataFrame

from passbook.operators import reports


def filtered(gold: DataFrame, start=None, end=None, categories=(), source="All") -> DataFrame:
    by_day = reports.filter_date_range(gold, start, end)
    return reports.filter_source(reports.filter_categories(by_day, categories), source)


def dashboard_report(gold: DataFrame, listing_limit=None, **filters) -> dict[str, DataFrame]:
    """One lazy DataFrame per panel; filters reach the Parquet scan of each."""
    rows = filtered(gold, **filters)
    return {
        "kpi": reports.kpi(rows),
        "spend_by_category": reports.spend_by_category(rows),
        "net_by_month": reports.net_by_month(rows),
        "listing": reports.listing(rows, listing_limit),
    }
