"""The landing folder as a table of files.

A file is known by its decoded full path everywhere; ``_metadata.file_path`` is URL-encoded and goes
through ``plain_path``.
"""

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.scratch import written

STATEMENT_SUFFIXES = ("pdf", "csv")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
#: Spark reads a file's bytes as one row, which holds less than 2 GB; uploads are far smaller.
MAX_FILE_BYTES = 2**31 - 1


def plain_path(encoded: Column) -> Column:
    """The path that an encoded ``file_path`` stands for; a plus sign is itself."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path to hand to a reader, with the characters of patterns taken literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """Lower-cased text after the last dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file_name, suffix, bytes, modified of every file; contents are not read.

    Spark lists no files of 0 bytes. They hold no rows, so ingestion misses nothing; a form that
    knows the size of an upload gets its ``empty_file`` from ``admission``.
    """
    return _binary(spark, folder).select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        suffix(F.col("path")).alias("suffix"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """Statement files only, in path order."""
    return list_files(spark, folder).filter(F.col("suffix").isin(*STATEMENT_SUFFIXES)).orderBy("path")


def fingerprints(files: DataFrame) -> DataFrame:
    """path, file_name, suffix, file_hash (sha256 of the bytes) of the statement files among ``files``."""
    statements = files.withColumn("suffix", suffix(F.col("path"))).filter(F.col("suffix").isin(*STATEMENT_SUFFIXES))
    digest = F.sha2("content", 256).alias("file_hash")
    return statements.select("path", file_name(F.col("path")).alias("file_name"), "suffix", digest)


def fingerprint_files(spark: SparkSession, folder: str | list[str], **options) -> DataFrame:
    """The fingerprints of every statement file of a folder (or of named files), one rule for all sizes."""
    files = spark.read.format("binaryFile").options(**options).load(folder)
    return fingerprints(files.filter(F.col("length") <= MAX_FILE_BYTES))


#: What an error says when a file cannot be opened or read to its end.
READ_FAILURES = ("FAILED_READ_FILE", "PATH_NOT_FOUND", "FileNotFoundException", "AccessControlException", "ChecksumException", "Permission denied")


def read_failure(error: Exception) -> str | None:
    """The first word of ``READ_FAILURES`` that an error or its causes name, None for other errors."""
    text = str(error)
    return next((word for word in READ_FAILURES if word in text), None)


def by_halves(paths: list[str], attempt: Callable[[list[str]], object]) -> tuple[list, list[tuple[str, str]]]:
    """What ``attempt`` returned for as many of ``paths`` as can be read, and (path, failure) of the rest.

    A set that fails is tried in halves until the bad file is alone, so one bad file among n costs about
    ``2 log2(n)`` attempts. Errors that are not about reading a file are raised at once.
    """
    if not paths:
        return [], []
    try:
        return [attempt(paths)], []
    except (PySparkException, Py4JJavaError) as error:
        failure = read_failure(error)
        if failure is None:
            raise
        if len(paths) == 1:
            return [], [(paths[0], failure)]
    half = len(paths) // 2
    (first, bad), (second, also_bad) = by_halves(paths[:half], attempt), by_halves(paths[half:], attempt)
    return first + second, bad + also_bad


def readable_fingerprints(spark: SparkSession, folder: str, scratch: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of a folder, and (path, reason) of the statement files that have none.

    A fingerprint exists only for bytes read to the end, so files that vanish or break off while they
    are read are simply left over. What Spark never skips, such as a forbidden file, is found by halves.
    """
    listed = written(discover_files(spark, folder), scratch, "listed")
    try:
        skip = {"ignoreMissingFiles": True, "ignoreCorruptFiles": True}
        prints = written(fingerprint_files(spark, folder, **skip), scratch, "prints")
    except (PySparkException, Py4JJavaError) as error:
        if read_failure(error) is None:
            raise
        paths = [r["path"] for r in listed.select("path").collect()]  # only after a failure
        turns = iter(range(2 * len(paths)))
        attempt = lambda some: written(fingerprint_files(spark, [literal_path(p) for p in some]), scratch, f"prints-{next(turns)}")
        parts, _ = by_halves(paths, attempt)
        prints = fingerprints(_binary(spark, folder).limit(0)) if not parts else parts[0]
        for part in parts[1:]:
            prints = prints.unionByName(part)
    reason = F.when(F.col("bytes") > MAX_FILE_BYTES, "too_large").otherwise("unreadable")
    return prints, listed.join(prints, "path", "left_anti").select("path", reason.alias("reason"))


def skip_ingested(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content is not recorded yet. Equal files of one batch all pass."""
    return files.join(manifest.select("file_hash").distinct(), "file_hash", "left_anti")


def admission(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``reason``: why a file may not be uploaded, NULL when it may."""
    reason = (
        F.when(~F.col("suffix").isin(*STATEMENT_SUFFIXES), "unsupported_type")
        .when(F.col("bytes") > max_bytes, "too_large")
        .when(F.col("bytes") == 0, "empty_file")
    )
    return files.withColumn("reason", reason)


def list_staged(files: DataFrame) -> DataFrame:
    """Name and size in KB with one decimal."""
    return (
        files.filter(F.col("suffix").isin(*STATEMENT_SUFFIXES))
        .select("file_name", F.round(F.col("bytes") / 1024, 1).alias("size_kb"))
        .orderBy("file_name")
    )


def unique_name(name: Column, token: Column | None = None) -> Column:
    """``stem__token.suffix``. The random token must be stored before the name is used twice."""
    token = F.expr("substr(replace(uuid(), '-', ''), 1, 8)") if token is None else token
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    extension = F.regexp_extract(name, r"(?<=.)(\.[^.]*)\z", 1)
    return F.concat(stem, F.lit("__"), token, extension)


def source_type(name: Column) -> Column:
    return F.when(suffix(name) == "pdf", "PDF").otherwise("CSV")
