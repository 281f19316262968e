"""Column functions: every one is a composition of built-in expressions."""

from passbook.functions.keys import document_hash, manual_key, packed, row_hash, txn_key_hash, unpacked
from passbook.functions.parsing import (
    DATE_FORMATS,
    parse_amount,
    parse_date,
    quarantine_reason,
    signed_amount,
)
from passbook.functions.text import (
    clean_text,
    empty_to_null,
    grouped_money,
    iso_day,
    month_bucket,
    month_number,
    plain_money,
    render_document,
    strip_whitespace,
)
from passbook.functions.vectors import cosine_distance, dot, l2_normalize

__all__ = [
    "DATE_FORMATS",
    "clean_text",
    "cosine_distance",
    "document_hash",
    "dot",
    "empty_to_null",
    "grouped_money",
    "iso_day",
    "l2_normalize",
    "manual_key",
    "month_bucket",
    "month_number",
    "packed",
    "parse_amount",
    "parse_date",
    "plain_money",
    "quarantine_reason",
    "render_document",
    "row_hash",
    "signed_amount",
    "strip_whitespace",
    "txn_key_hash",
    "unpacked",
]
