"""Durable tables on a shared file system.

A versioned table is replaced as a whole: a run writes its own folder and becomes visible by one
appended pointer row, so readers never see half a table and a failed run leaves the old version.
An append table grows by one write per run.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, MapType, StringType, StructField, StructType

from passbook.functions import packed, unpacked
from passbook.schemas import EmptyTable, conform
from passbook.scratch import STORED_AS


class TableMissing(FileNotFoundError):
    """Nothing has been published yet."""


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _each(df: DataFrame, change, names) -> DataFrame:
    """``df`` with ``change`` applied to those of the columns ``names`` it has."""
    return df.withColumns({n: change(F.col(n)) for n in names if n in df.columns})


class AppendTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition_by=(), hidden: StructType | None = None):
        """``hidden``: columns stored next to the contract and read only on request."""
        self.spark, self.path, self.schema = spark, path, schema
        self.stored = StructType(schema.fields + (hidden.fields if hidden else []))
        self.partition_by = list(partition_by)

    def read(self, stored: bool = False) -> DataFrame:
        """All rows, none when nothing was written yet."""
        df = _read(self.spark, self.path, self.stored)
        df = self.spark.createDataFrame([], self.stored) if df is None else df
        return df.select(self.stored.names if stored else self.schema.names)

    def append(self, df: DataFrame, replace: bool = False) -> None:
        """``replace``: the partitions that ``df`` has rows of are replaced, so a repeated run adds nothing."""
        writer = conform(df, self.stored).write.mode("append")
        if replace and self.partition_by:
            writer = conform(df, self.stored).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer = writer.options(**STORED_AS)
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)


class VersionedTable:
    _POINTER = StructType().add("version", "string").add("published_at", "long")

    def __init__(self, spark: SparkSession, path: str, schema: StructType, hidden: StructType | None = None):
        """``hidden``: columns stored next to the contract and read only on request."""
        self.spark, self.path, self.schema = spark, path, schema
        self.stored = StructType(schema.fields + (hidden.fields if hidden else []))

    def latest(self) -> str | None:
        pointers = _read(self.spark, f"{self.path}/versions", self._POINTER)
        row = None if pointers is None else pointers.agg(F.max_by("version", "published_at")).first()
        return row[0] if row else None

    def read(self, stored: bool = False) -> DataFrame:
        version = self.latest()
        if version is None:
            raise TableMissing(self.path)
        df = self.spark.read.schema(self.stored).parquet(f"{self.path}/data/{version}")
        return df if stored else df.select(self.schema.names)

    def exists(self) -> bool:
        return self.latest() is not None

    def stored_columns(self) -> list[str]:
        """The columns the files really hold; ``read`` fills absent ones with NULL."""
        version = self.latest()
        if version is None:
            raise TableMissing(self.path)
        return self.spark.read.parquet(f"{self.path}/data/{version}").columns

    def write(self, df: DataFrame, allow_empty: bool = False) -> str:
        """Write one version without showing it to readers."""
        version = uuid.uuid4().hex
        target = f"{self.path}/data/{version}"
        conform(df, self.stored).write.mode("errorifexists").options(**STORED_AS).parquet(target)
        # the check reads what was written, so the plan behind df runs once
        if not allow_empty and self.spark.read.schema(self.stored).parquet(target).isEmpty():
            raise EmptyTable(self.path)
        return version

    def show(self, version: str) -> None:
        row = self.spark.createDataFrame([(version, time.time_ns())], self._POINTER)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def publish(self, df: DataFrame, allow_empty: bool = False) -> str:
        version = self.write(df, allow_empty)
        self.show(version)
        return version


class SlicedTable(VersionedTable):
    """A versioned table whose rows lie in slices (say, months); a change writes only the slices it touches.

    A version is a list of slices, each in the folder of the write that made it. ``slice_of`` gives a row's
    slice, a whole number; a slice that holds most rows is cut by ``order`` into as many files as the shuffle
    has parts. The driver sees the list: one row per slice. A slice's ``mark`` says what it was made from.
    The columns ``digests`` are packed while rows are dealt.
    """

    _SLICE = (
        StructType().add("slice", "integer").add("folder", "string").add("mark", "string")
        .add("figures", MapType(StringType(), LongType()))
    )
    _NOTE = StructType().add("note", "string")

    def __init__(self, spark, path, schema, hidden=None, *, slice_of: Column, order, figures: dict[str, Column], digests=()):
        super().__init__(spark, path, schema, hidden)
        self.slice_of, self.order, self.figures, self.digests = slice_of, list(order), figures, list(digests)

    def slices(self, version: str | None = None) -> dict[int, Row] | None:
        """The slices of a version, the latest by default; None for a version without a list (or no version)."""
        version = version or self.latest()
        rows = _read(self.spark, f"{self.path}/slices/{version}", self._SLICE) if version else None
        return None if rows is None else {r.slice: r for r in rows.collect()}

    def _folders(self, version: str, slices) -> list[str]:
        state = self.slices(version)
        if state is None:
            return [f"{self.path}/data/{version}"]
        return [f"{self.path}/data/{r.folder}/slice={s}" for s, r in state.items() if slices is None or s in slices]

    def read(self, stored: bool = False, slices=None, version: str | None = None) -> DataFrame:
        """All rows, or those of some slices; ``version`` may be one that is not shown yet."""
        version = version or self.latest()
        if version is None:
            raise TableMissing(self.path)
        folders = self._folders(version, slices)
        if not folders:
            df = self.spark.createDataFrame([], self.stored)
        else:
            df = self.spark.read.schema(self.stored).parquet(*folders)
        return df if stored else df.select(self.schema.names)

    def stored_columns(self) -> list[str]:
        version = self.latest()
        if version is None:
            raise TableMissing(self.path)
        folders = self._folders(version, None)
        return self.spark.read.parquet(*folders).columns if folders else self.stored.names

    def write(self, df: DataFrame, allow_empty: bool = False, replaced=None, marks: dict[int, str] | None = None) -> str:
        """Write a version without showing it: ``df`` in place of the slices ``replaced`` (all by default)."""
        version, marks = uuid.uuid4().hex, marks or {}
        target = f"{self.path}/data/{version}"
        placed = _each(conform(df, self.stored).withColumn("slice", self.slice_of), packed, self.digests)
        placed = placed.repartitionByRange("slice", *self.order).sortWithinPartitions("slice", *self.order)
        placed = _each(placed, unpacked, self.digests)
        placed.write.partitionBy("slice").mode("errorifexists").options(**STORED_AS).parquet(target)
        made = self.spark.read.schema(StructType([*self.stored.fields, StructField("slice", IntegerType())])).parquet(target)
        counted = [column.cast("bigint").alias(name) for name, column in self.figures.items()]
        rows = [
            (r["slice"], version, marks.get(r["slice"]), {name: r[name] for name in self.figures})
            for r in made.groupBy("slice").agg(*counted).collect()
        ]
        if replaced is not None:
            strays = {r[0] for r in rows} - set(replaced)
            if strays:
                raise ValueError(f"rows of slices that are not replaced: {sorted(strays)}")
            rows += [tuple(r) for s, r in (self.slices() or {}).items() if s not in replaced]
        if not rows and not allow_empty:
            raise EmptyTable(self.path)
        self.spark.createDataFrame(rows, self._SLICE).coalesce(1).write.parquet(f"{self.path}/slices/{version}")
        return version

    def note(self, version: str, text: str) -> None:
        """Keep a word about a version; a stopped write leaves none."""
        self.spark.createDataFrame([(text,)], self._NOTE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/{version}")

    def noted(self, version: str) -> str | None:
        row = _read(self.spark, f"{self.path}/notes/{version}", self._NOTE)
        row = None if row is None else row.first()
        return row[0] if row else None


class KeyedTable:
    """Rows by key, dealt into buckets; a change writes only the buckets it touches.

    Every write has a folder of its own, and one append of pointer rows shows all its buckets together, so
    readers see whole states and a failed write leaves the old one. The number of buckets follows the rows
    when the table is written as a whole, up to ``MOST_BUCKETS``; that is also what a reader collects.

    Rows are dealt once, with the columns ``digests`` packed. What is dear to send, such as vectors, is made
    afterwards by ``finish``, which gets the dealt rows with their ``bucket`` and must keep that column.
    """

    ROWS_PER_BUCKET, MOST_BUCKETS = 10_000, 4_096
    # buckets that a task writes, where there are more than the shuffle has parts
    BUCKETS_AT_ONCE = 8
    _POINTER = StructType().add("bucket", "integer").add("buckets", "integer").add("version", "string").add("published_at", "long")

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", digests=()):
        self.spark, self.path, self.schema, self.key, self.digests = spark, path, schema, key, list(digests)

    def latest(self) -> dict[int, str | None]:
        """The version of every bucket; None for one without rows. Empty when nothing was published."""
        pointers = _read(self.spark, f"{self.path}/versions", self._POINTER)
        if pointers is None:
            return {}
        last = F.max_by(F.struct("version", "buckets", "published_at"), "published_at").alias("last")
        rows = pointers.groupBy("bucket").agg(last).collect()
        newest = max(rows, key=lambda r: r.last.published_at)
        return {r.bucket: r.last.version for r in rows if r.last.buckets == newest.last.buckets}

    def exists(self) -> bool:
        return bool(self.latest())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        state = self.latest()
        if not state:
            raise TableMissing(self.path)
        wanted = state if buckets is None else {b: state[b] for b in buckets}
        paths = [f"{self.path}/data/{version}/bucket={b}" for b, version in wanted.items() if version]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that the keys of ``changes`` belong to."""
        return sorted(r[0] for r in changes.select(self.bucket(len(self.latest()))).distinct().collect())

    def outgrown(self, rows: int) -> bool:
        """Whether the buckets hold so many rows that the table should be written as a whole again."""
        buckets = len(self.latest())
        return buckets < self.MOST_BUCKETS and rows > 4 * buckets * self.ROWS_PER_BUCKET

    def publish(self, df: DataFrame, allow_empty: bool = False, finish=None, rows: int | None = None) -> None:
        """Replace all rows; ``rows`` is their number where the caller has counted them."""
        rows = df.select(self.key).count() if rows is None else rows
        if not rows and not allow_empty:
            raise EmptyTable(self.path)
        buckets = min(self.MOST_BUCKETS, max(1, -(-rows // self.ROWS_PER_BUCKET)))
        self._write(df, buckets, list(range(buckets)), finish)

    def replace(self, df: DataFrame, buckets: list[int], finish=None) -> None:
        """Replace the rows of some buckets by ``df``, whose keys belong to them."""
        self._write(df, len(self.latest()), buckets, finish)

    def _write(self, df: DataFrame, count: int, buckets: list[int], finish) -> None:
        version = uuid.uuid4().hex
        target = f"{self.path}/data/{version}"
        rows = conform(df, self.schema) if finish is None else df
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-len(buckets) // self.BUCKETS_AT_ONCE))
        placed = _each(rows.withColumn("bucket", self.bucket(count)), packed, self.digests)
        placed = _each(placed.repartition(min(len(buckets), parts), "bucket"), unpacked, self.digests)
        if finish is not None:
            placed = conform(finish(placed), StructType([*self.schema.fields, StructField("bucket", IntegerType())]))
        placed.write.partitionBy("bucket").mode("errorifexists").options(**STORED_AS).parquet(target)
        stored = self.spark.read.schema(StructType().add("bucket", "integer")).parquet(target)
        filled = {r[0] for r in stored.distinct().collect()}
        now = time.time_ns()
        rows = [(b, count, version if b in filled else None, now) for b in buckets]
        self.spark.createDataFrame(rows, self._POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
