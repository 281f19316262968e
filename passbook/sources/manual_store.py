"""Manual entries: the JSON export form and the appended table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions import strip_whitespace
from passbook.schemas import MANUAL, conform
from passbook.sources.tables import AppendTable


def read_manual_json(spark: SparkSession, path) -> DataFrame:
    """``{"entries": [...]}`` documents, one or many files."""
    document = T.StructType().add("entries", T.ArrayType(MANUAL))
    entries = spark.read.schema(document).json(path, multiLine=True)
    return conform(entries.select(F.explode("entries").alias("e")).select("e.*"), MANUAL)


def append_manual(table: AppendTable, entries: DataFrame) -> None:
    """Give every new entry its id and log time and append. The ids are fixed by the write."""
    table.append(
        entries.withColumns(
            {
                "entry_id": F.expr("replace(uuid(), '-', '')"),
                "merchant": strip_whitespace(F.col("merchant")),
                "logged_at": F.current_timestamp(),
            }
        )
    )
