"""Hash keys. Every part is coalesced because concat_ws would drop a NULL and shift the rest."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from passbook.functions.text import grouped_money, iso_day


def _sha256_of(parts) -> Column:
    return F.sha2(F.concat_ws("||", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def row_hash() -> Column:
    """Identity of a printed row inside its file; the balance is not part of it."""
    names = (
        "source_file",
        "source_page",
        "source_row_index",
        "transaction_date_raw",
        "description_raw",
        "debit_raw",
        "credit_raw",
    )
    return _sha256_of([F.col(n) for n in names])


def txn_key_hash(
    txn_date: Column, amount: Column, description: Column, balance: Column
) -> Column:
    """Business identity of a transaction, equal across overlapping uploads."""
    return _sha256_of(
        [
            iso_day(txn_date),
            grouped_money(amount),
            description,
            grouped_money(balance),
        ]
    )


def manual_key(entry_id: Column) -> Column:
    """Key of a manual entry: its own id, so equal-looking entries never collapse."""
    return F.sha2(F.concat(F.lit("manual::"), entry_id), 256)


def packed(digest: Column) -> Column:
    """A key as bytes for a shuffle: the 32 of a sha256 in lower-case hexadecimal text, of any other text its own behind 33 zeros."""
    other = F.concat(F.lit(bytes(33)), digest.cast("binary"))
    # cheaper than a pattern: ``unhex`` gives nothing for other letters
    is_digest = (F.length(digest) == 64) & (F.lower(digest) == digest) & F.unhex(digest).isNotNull()
    return F.when(is_digest, F.unhex(digest)).otherwise(other)


def unpacked(key: Column) -> Column:
    """The text of a ``packed`` key."""
    other = F.expr(f"substring({{}}, 34)")
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(F.substr(key, F.lit(34)).cast("string"))


def document_hash(document: Column, amount: Column) -> Column:
    """What an index row is made of: the text, and the amount beyond the printed cents."""
    return F.sha2(F.concat_ws("||", document, amount.cast("string")), 256)
