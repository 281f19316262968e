"""The CSV uploads of the statement rows as real files, written by Spark into one flat folder."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from passbook.scratch import scratch_folder
from passbook.schemas import RAW_FIELDS

_WRITTEN = {}


def landing_folder(spark, sf_dir) -> str:
    """Files of at most 500 rows, so their number grows with the data; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = scratch_folder(spark, "landing")
        write_landing(spark, sf_dir, _WRITTEN[key])
    return _WRITTEN[key]


def write_landing(spark, sf_dir, folder) -> None:
    rows = fx.statement_rows(spark, sf_dir).filter("source_type = 'CSV'")
    named = rows.select(
        F.col("transaction_date_raw").alias("Txn Date"),
        F.col("description_raw").alias("Narration"),
        F.col("debit_raw").alias("Withdrawal"),
        F.col("credit_raw").alias("Deposit"),
        F.col("balance_raw").alias("Closing Balance"),
        "source_file",
    )
    placed = named.repartition("source_file").sortWithinPartitions("source_file").drop("source_file")
    placed.write.mode("append").option("emptyValue", "").option("maxRecordsPerFile", 500).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder, header=True, quote='"', escape='"')


_KINDS = {}


def landing_kinds(spark, sf_dir) -> str:
    """Files of every kind in one folder: those of ``landing_folder``, and all events as plain files, in
    Latin-1, with line breaks inside quotes, without the needed headers (twice), and as text; one file
    has no rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KINDS:
        folder = scratch_folder(spark, "landing-kinds")
        events = fx.table(spark, sf_dir, "events")
        as_rows = lambda text: events.select(
            F.col("event_id").cast("string").alias("Txn Date"), text.alias("Narration"), F.col("value").cast("string").alias("Withdrawal")
        )
        kind = F.col("event_type")

        def put(df, **options):
            df.write.mode("append").options(**{"header": True, "quote": '"', "escape": '"', **options}).csv(folder)

        write_landing(spark, sf_dir, folder)
        put(as_rows(kind))
        put(as_rows(F.concat(F.lit("café "), kind)), encoding="ISO-8859-1")
        put(as_rows(F.concat(kind, F.lit("\nline two"))))
        put(as_rows(kind).withColumnsRenamed({"Txn Date": "When", "Narration": "What"}))
        put(as_rows(kind).withColumnsRenamed({"Txn Date": "Day", "Narration": "Text"}))
        put(as_rows(kind).limit(0))
        events.select(kind).write.mode("append").text(folder)
        _KINDS[key] = folder
    return _KINDS[key]
