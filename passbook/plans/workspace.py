"""Where the tables of one installation live."""

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from passbook import schemas
from passbook.functions import month_number
from passbook.sources.tables import AppendTable, KeyedTable, SlicedTable, VersionedTable

@dataclass
class Workspace:
    spark: SparkSession
    base: str

    @property
    def bronze(self):
        """Partitioned by the part of the ingest plan, so that a part can be written again."""
        return AppendTable(self.spark, f"{self.base}/bronze", schemas.BRONZE, ["part"], schemas.PART)

    @property
    def ingest_plan(self):
        return AppendTable(self.spark, f"{self.base}/ingest_plan", schemas.INGEST_PLAN)

    @property
    def manifest(self):
        return AppendTable(self.spark, f"{self.base}/manifest", schemas.MANIFEST)

    @property
    def rejected_files(self):
        schema = StructType([StructField(n, StringType()) for n in ("batch_id", "path", "reason")])
        return AppendTable(self.spark, f"{self.base}/rejected_files", schema, ["part"], schemas.PART)

    @property
    def silver(self):
        return VersionedTable(self.spark, f"{self.base}/silver", schemas.SILVER)

    @property
    def quarantine(self):
        return VersionedTable(self.spark, f"{self.base}/quarantine", schemas.SILVER)

    @property
    def manual(self):
        return AppendTable(self.spark, f"{self.base}/manual", schemas.MANUAL)

    @property
    def cache(self):
        return AppendTable(self.spark, f"{self.base}/category_cache", schemas.CACHE)

    @property
    def gold(self):
        """In slices of a month, so that a change writes the months it touches."""
        hidden = StructType([StructField("category_origin", StringType())])
        return SlicedTable(
            self.spark, f"{self.base}/gold", schemas.GOLD, hidden,
            slice_of=month_number(F.col("txn_date")), order=["txn_date", "txn_key_hash"],
            figures={
                "rows": F.count(F.lit(1)),
                "new": F.count_if(~F.col("category_origin").isin("cache", "override")),
                "unset": F.count_if(F.col("category") == schemas.UNSET_CATEGORY),
            },
            digests=["txn_key_hash"],
        )

    @property
    def index(self):
        return KeyedTable(self.spark, f"{self.base}/index", schemas.INDEX, digests=["id", "document_hash"])

    @property
    def answers(self):
        """What models answered, by request; read before a model is asked."""
        return AppendTable(self.spark, f"{self.base}/answers", schemas.ANSWERS)
