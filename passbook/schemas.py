"""Table contracts shared by every layer."""

from pyspark.sql import types as T

# The category list every layer agrees on. The first entry means "not decided".
CATEGORY_OPTIONS = (
    "Uncategorized",
    "Food & Dining",
    "Groceries",
    "Transport",
    "Shopping",
    "Bills & Utilities",
    "Rent",
    "Entertainment",
    "Health & Wellness",
    "Travel",
    "Investments",
    "Income",
    "Other",
)
UNSET_CATEGORY = "Uncategorized"
MANUAL_SOURCE = "MANUAL"


def _strings(names):
    return [T.StructField(n, T.StringType()) for n in names]


RAW_FIELDS = (
    "transaction_date_raw",
    "description_raw",
    "debit_raw",
    "credit_raw",
    "balance_raw",
)

RAW_ROW = T.StructType(
    _strings(RAW_FIELDS + ("source_page", "source_row_index", "source_file", "source_type"))
)

BRONZE = T.StructType(
    RAW_ROW.fields
    + _strings(["batch_id"])
    + [T.StructField("ingested_at", T.TimestampType())]
    + _strings(["row_hash"])
)

SILVER = T.StructType(
    BRONZE.fields
    + [
        T.StructField("txn_date", T.DateType()),
        T.StructField("debit_amount", T.DoubleType()),
        T.StructField("credit_amount", T.DoubleType()),
        T.StructField("balance_amount", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
    ]
    + _strings(["description", "txn_key_hash", "quarantine_reason"])
)

GOLD_CONTRACT = T.StructType(
    [
        T.StructField("txn_key_hash", T.StringType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)

GOLD = T.StructType(GOLD_CONTRACT.fields + _strings(["category"]))

MANUAL = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)

CACHE = T.StructType(_strings(["txn_key_hash", "category", "origin"]) + [T.StructField("decided_at", T.TimestampType())])

MANIFEST = T.StructType(
    _strings(["file_hash", "file_name", "batch_id"])
    + [T.StructField("processed_at", T.TimestampType())]
)

#: Which partition of Bronze a file's rows go to, decided before they are read.
INGEST_PLAN = T.StructType(_strings(["file_hash", "part"]) + [T.StructField("planned_at", T.TimestampType())])
PART = T.StructType(_strings(["part"]))

#: One row per attempt: the request (hash of text and instructions), what came back or why nothing did.
ANSWERS = T.StructType(
    _strings(["request", "run"])
    + [T.StructField("attempt", T.IntegerType())]
    + _strings(["raw", "error"])
    + [T.StructField("final", T.BooleanType()), T.StructField("asked_at", T.TimestampType())]
)

INDEX_METADATA = T.StructType(
    [
        T.StructField("txn_date", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("source_type", T.StringType()),
    ]
)

INDEX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("document_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", INDEX_METADATA),
    ]
)


class MissingColumns(ValueError):
    """A table lacks columns its consumer needs."""


class EmptyTable(ValueError):
    """A table that must hold rows is empty."""


def require_names(have, names):
    missing = [n for n in names if n not in have]
    if missing:
        raise MissingColumns(f"missing column(s): {', '.join(missing)}")


def require_columns(df, names):
    require_names(df.columns, names)
    return df


def conform(df, schema):
    """Project to ``schema`` in order, casting each column; absent columns become NULL."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
