"""The batch functions on unbounded input.

Every sink writes one folder per micro-batch, overwriting it when the batch is replayed, so a
restart after a lost driver neither loses nor repeats rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passbook.operators.quality import clean_rows, split_valid
from passbook.plans.ingest import ingest
from passbook.plans.workspace import Workspace
from passbook.schemas import BRONZE
from passbook.scratch import scratch_folder, written
from passbook.sources import files as landing

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def bronze_stream(workspace: Workspace, folder: str, checkpoint: str, once: bool = True, max_files: int = 10_000) -> StreamingQuery:
    """Ingest the files of each micro-batch; earlier files are not read again.

    The file source knows files by path; the manifest decides by content, so a copy under a new name
    is not ingested again. The batch id follows from the files' hashes, so a replayed micro-batch
    replaces what it wrote before it was stopped.
    """
    source = workspace.spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files)

    def arrived(files: DataFrame, batch: int) -> None:
        prints = written(landing.fingerprints(files), scratch_folder(workspace.spark, "stream"), "files")
        digest = prints.agg(F.hex(F.bit_xor(F.xxhash64("file_hash"))), F.count("*")).first()
        if digest[1]:
            ingest(workspace, folder, batch_id=f"stream_{digest[0]}_{digest[1]}", files=prints)

    return _start(source.load(folder).writeStream.foreachBatch(arrived), checkpoint, once)


def bronze_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """Bronze as a stream; ``maxFilesPerTrigger`` bounds a micro-batch."""
    return spark.readStream.schema(BRONZE).options(**options).parquet(path)


def silver_stream(bronze: DataFrame, valid_path: str, quarantine_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Cleaning is stateless, so it is the batch function; two sinks per micro-batch."""

    def both(rows: DataFrame, batch: int) -> None:
        # cleaned once: both sinks read what was stored
        valid, bad = split_valid(written(rows, scratch_folder(rows.sparkSession, "silver"), "cleaned"))
        _write(valid, valid_path, batch)
        _write(bad, quarantine_path, batch)

    return _start(clean_rows(bronze).writeStream.foreachBatch(both), checkpoint, once)


def dedupe_stream(valid: DataFrame, horizon: str | None = None) -> DataFrame:
    """One row per business key across the stream.

    Without ``horizon`` every key is remembered for good. With one (such as ``"30 days"``) state is
    dropped after that much ingestion time, and a copy arriving later passes again.
    """
    if horizon is None:
        return valid.dropDuplicates(["txn_key_hash"])
    return valid.withWatermark("ingested_at", horizon).dropDuplicatesWithinWatermark(["txn_key_hash"])


def start_dedupe(valid: DataFrame, path: str, checkpoint: str, horizon: str | None = None, once: bool = True) -> StreamingQuery:
    writer = dedupe_stream(valid, horizon).writeStream.foreachBatch(
        lambda rows, batch: _write(rows, path, batch)
    )
    return _start(writer, checkpoint, once)
