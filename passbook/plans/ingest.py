"""Landing files -> Bronze."""

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.operators.dedupe import dedupe_raw
from passbook.plans.workspace import Workspace
from passbook.schemas import RAW_ROW, conform
from passbook.scratch import STORED_AS, scratch_folder, written
from passbook.sources import files as landing
from passbook.sources.csv_files import scan_csv
from passbook.sources.table_cells import normalize_table_rows

# about this many new CSV files are named to one scan and written as one part
NAMED_FILES = 10_000
# paged statements are not named, their rows come with the table of cells, so a part may hold more of them
FILES_PER_PART = 10 * NAMED_FILES
# tasks that write the cells of one part
CELL_PARTS = 16


def new_batch_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ_") + uuid.uuid4().hex[:8]


def tag_source(rows: DataFrame) -> DataFrame:
    """Raw rows in the fixed all-string schema, with the source type of their file."""
    tagged = rows.withColumn("source_type", landing.source_type(F.col("source_file")))
    return conform(tagged, RAW_ROW)


def stamp_batch(rows: DataFrame, batch_id: str, ingested_at=None) -> DataFrame:
    return rows.withColumns(
        {
            "batch_id": F.lit(batch_id),
            "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
            "row_hash": fn.row_hash(),
        }
    )


def bronze_rows(raw: DataFrame, batch_id: str, ingested_at=None) -> DataFrame:
    return dedupe_raw(stamp_batch(tag_source(raw), batch_id, ingested_at))


@dataclass
class IngestResult:
    batch_id: str
    rows: int
    files: int


def planned_parts(workspace: Workspace, fresh: DataFrame, batch_id: str, folder: str) -> DataFrame:
    """``fresh`` with the ``part`` of Bronze each file's rows go to.

    A file's part is written down before the file is read, and stays its part until the manifest lists a
    file of it. So a part that a stopped run left behind is written again as a whole, by whichever run
    comes next and whatever files have arrived since. A part the manifest knows is never written again:
    files of it that gave no rows get a new one.
    """
    plan, manifest = workspace.ingest_plan.read(), workspace.manifest.read()
    closed = plan.join(manifest.select("file_hash"), "file_hash", "left_semi").select("part").distinct()
    latest = plan.groupBy("file_hash").agg(F.max_by("part", "planned_at").alias("part"))
    known = written(fresh.join(latest.join(closed, "part", "left_anti"), "file_hash", "left"), folder, "known")
    new, named = known.filter("part is null").agg(F.count(F.lit(1)), F.count_if(F.col("suffix") == "csv")).first()
    if not new:
        return known
    # Equal files go to one part. Parts hold about NAMED_FILES CSV files, or FILES_PER_PART of all; their names are never used again.
    turn = F.pmod(F.xxhash64("file_hash"), F.lit(max(-(-named // NAMED_FILES), -(-new // FILES_PER_PART))))
    name = F.concat_ws("_", F.lit(batch_id), F.lit(uuid.uuid4().hex[:8]), turn.cast("string"))
    planned = written(known.withColumn("_new", F.col("part").isNull()).withColumn("part", F.coalesce("part", name)), folder, "planned")
    entries = planned.filter("_new").select("file_hash", "part").distinct()
    workspace.ingest_plan.append(entries.withColumn("planned_at", F.current_timestamp()).coalesce(1))
    return planned.drop("_new")


def ingest(
    workspace: Workspace,
    folder: str,
    table_rows: DataFrame | None = None,
    batch_id: str | None = None,
    files: DataFrame | None = None,
) -> IngestResult | None:
    """Append the rows of every file not seen before; None when there is nothing new.

    ``table_rows`` holds the cells extracted from paged statements of the same folder, by
    ``source_file``. ``files`` gives the fingerprints of the files to look at instead of all of
    ``folder``. A file that fails or has no rows is reported and tried again next time.

    Every file's rows are in Bronze exactly once, wherever a run stops and whatever batch id the next one
    has: files are dealt into parts first (``planned_parts``), a part's rows replace what a stopped run
    left of it, and one append to the manifest closes it. Runs of one workspace must not overlap. Rows of
    a stopped run stay if all files of their part have gone from the folder since.
    """
    spark = workspace.spark
    batch_id = batch_id or new_batch_id()
    scratch = scratch_folder(spark, "ingest")
    if files is None:
        files, unreadable = landing.readable_fingerprints(spark, folder, scratch)
        _report(workspace, unreadable, batch_id, f"{batch_id}_unread")
    fresh = written(landing.skip_ingested(files, workspace.manifest.read()), scratch, "fresh")
    planned = _by_part(planned_parts(workspace, fresh, batch_id, scratch), ["part"], scratch, "parts")
    # one part per NAMED_FILES files
    parts = sorted(r["part"] for r in planned.select("part").distinct().collect())
    cells = None if table_rows is None else _cells_by_part(table_rows, planned, scratch)
    done = 0
    for part in parts:
        files, rows = (df if df is None else df.filter(F.col("part") == part).drop("part") for df in (planned, cells))
        done += _ingest_part(workspace, files, rows, batch_id, part)
    if not done:
        return None
    rows = workspace.bronze.read(stored=True).filter(F.col("part").isin(parts)).count()
    return IngestResult(batch_id, rows, done)


def _by_part(df: DataFrame, dealt_by: list, folder: str, name: str) -> DataFrame:
    """``df`` written in a folder for each ``part``, so that a part is read alone and the rounds read every row once."""
    path = f"{folder}/{name}"
    df.repartition(*dealt_by).write.partitionBy("part").options(**STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cells_by_part(table_rows: DataFrame, planned: DataFrame, folder: str) -> DataFrame:
    """The rows of the paged files of ``planned`` with the part their file goes to."""
    paged = planned.filter("suffix = 'pdf'").select(F.col("file_name").alias("source_file"), "part").distinct()
    cells = normalize_table_rows(table_rows).select(RAW_ROW.names[:-1]).join(paged, "source_file")
    spread = F.pmod(F.xxhash64("source_file", "source_page", "source_row_index"), F.lit(CELL_PARTS))
    return _by_part(cells, ["part", spread], folder, "cells")


def _report(workspace: Workspace, files: DataFrame, batch_id: str, part: str) -> None:
    """``files``: path, reason. A part that is written again replaces its report."""
    workspace.rejected_files.append(files.withColumns({"batch_id": F.lit(batch_id), "part": F.lit(part)}), replace=True)


def _ingest_part(workspace: Workspace, fresh: DataFrame, cells: DataFrame | None, batch_id: str, part: str) -> int:
    """The number of files that gave rows. ``cells``: the rows of its paged files."""
    spark = workspace.spark
    rows, contributed = [], []
    paths = sorted(r["path"] for r in fresh.filter("suffix = 'csv'").select("path").collect())
    scans, unreadable = landing.by_halves(paths, lambda some: scan_csv(spark, [landing.literal_path(p) for p in some]))
    bad = [scan.rejected for scan in scans]
    if unreadable:
        bad.append(spark.createDataFrame([(path, f"unreadable:{why}") for path, why in unreadable], "path string, reason string"))
    if bad:
        _report(workspace, _union(bad), batch_id, part)
    for scan in scans:
        rows.append(scan.rows.select(RAW_ROW.names[:-1]))
        contributed.append(scan.accepted.select("path"))
    if cells is not None:
        paged = fresh.filter("suffix = 'pdf'").select(F.col("file_name").alias("source_file"), "path")
        rows.append(cells.select(RAW_ROW.names[:-1]))
        contributed.append(paged.join(cells.select("source_file"), "source_file", "left_semi").select("path"))
    if not rows:
        return 0
    entries = fresh.join(_union(contributed), "path", "left_semi").select(
        "file_hash", "file_name", F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("processed_at")
    )
    entries = written(entries, scratch_folder(spark, "ingest"), "entries")
    done = entries.count()
    if done:
        workspace.bronze.append(bronze_rows(_union(rows), batch_id).withColumn("part", F.lit(part)), replace=True)
        workspace.manifest.append(entries.coalesce(1))
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
