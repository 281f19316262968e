"""Files, cells and raw rows."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.landing import landing_folder, landing_kinds
from checks.registry import query
from passbook import functions as fn
from passbook.operators.dedupe import dedupe_raw
from passbook.plans import ingest as plan
from passbook.plans.workspace import Workspace
from passbook.scratch import scratch_folder
from passbook.schemas import BRONZE, RAW_FIELDS
from passbook.sources import files as landing
from passbook.sources import headers as hd
from passbook.sources.csv_files import preview, scan_csv
from passbook.sources.table_cells import header_overlap, normalize_table_rows
from passbook.sources.tables import AppendTable, VersionedTable

RAW = ", ".join(RAW_FIELDS)


_ROWS_SQL = "SELECT (SELECT count(*) FROM fx WHERE source_type = 'CSV') AS statements, (SELECT count(*) FROM events) AS events"


@query(
    "A1_discover_files",
    f"""SELECT 'csv' AS suffix, TRUE AS enough_files, TRUE AS all_hold_bytes, TRUE AS in_order FROM ({_ROWS_SQL})""",
    ["fx"],
)
def _(spark, sf):
    """All statement files of a folder that holds other files as well; a landing file has at most 500 rows."""
    files = landing.discover_files(spark, landing_kinds(spark, sf))
    statements = fx.statement_rows(spark, sf).filter("source_type = 'CSV'").agg(F.count(F.lit(1)).alias("n"))
    found = files.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(F.col("bytes") > 0).alias("all_hold_bytes"), F.collect_list("path").alias("paths")
    )
    enough = F.col("files") * 500 >= F.col("n")
    return found.crossJoin(statements).select("suffix", enough.alias("enough_files"), "all_hold_bytes", (F.col("paths") == F.array_sort("paths")).alias("in_order"))


@query("A2_file_fingerprint", "SELECT 0 AS unlike_the_text, 0 AS without_hash, TRUE AS same_bytes_same_hash")
def _(spark, sf):
    """Each hash against one of the bytes as text, for the files that are UTF-8; every statement file has one."""
    folder = landing_kinds(spark, sf)
    prints = landing.fingerprint_files(spark, folder)
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.csv").select(
        landing.plain_path(F.col("_metadata.file_path")).alias("path"), "value", F.sha2("value", 256).alias("again")
    )
    joined = whole.join(prints, "path", "left")
    return joined.agg(
        F.count_if(F.is_valid_utf8("value") & (F.col("file_hash") != F.col("again"))).alias("unlike_the_text"),
        F.count_if(F.col("file_hash").isNull()).alias("without_hash"),
        (F.countDistinct("file_hash") == F.countDistinct("again")).alias("same_bytes_same_hash"),
    )


def _files(spark, sf):
    return fx.statement_rows(spark, sf).select(
        F.sha2("source_file", 256).alias("file_hash"), F.col("source_file").alias("file_name"), "source_type"
    ).distinct()


_SKIP_SQL = """SELECT file_hash, file_name FROM (SELECT DISTINCT sha256(source_file) AS file_hash,
  source_file AS file_name, source_type FROM fx) WHERE source_type <> 'PDF'"""


def _skip(spark, sf):
    files = _files(spark, sf)
    return landing.skip_ingested(files, files.filter("source_type = 'PDF'")).select("file_hash", "file_name")


query("A3_skip_ingested", _SKIP_SQL, ["fx"])(_skip)
query("D1_anti_join_manifest", _SKIP_SQL, ["fx"])(_skip)


@query("A4_scan_csv_any_encoding", f"SELECT {', '.join(f'nullif({c}, {chr(39)*2}) AS {c}' for c in RAW_FIELDS)} FROM fx WHERE source_type = 'CSV'", ["fx"])
def _(spark, sf):
    return scan_csv(spark, landing_folder(spark, sf)).rows.select(*RAW_FIELDS)


@query("A5_map_headers", "SELECT file, pos, header, coalesce(canonical, '') AS canonical FROM claimed", ["claimed"])
def _(spark, sf):
    return hd.map_headers(fx.headers(spark, sf)).select(
        "file", "pos", "header", F.coalesce("canonical", F.lit("")).alias("canonical")
    )


@query(
    "A6_require_columns",
    """SELECT file, concat_ws(',', CASE WHEN NOT bool_or(coalesce(canonical, '') = 'transaction_date_raw') THEN 'transaction_date_raw' END,
         CASE WHEN NOT bool_or(coalesce(canonical, '') = 'description_raw') THEN 'description_raw' END) AS missing_required,
         count(*) FILTER (canonical IS NULL) AS ignored_headers FROM claimed GROUP BY file""",
    ["claimed"],
)
def _(spark, sf):
    return hd.required_columns_report(hd.map_headers(fx.headers(spark, sf)))


@query(
    "A7_fill_missing_columns",
    f"SELECT {', '.join(RAW_FIELDS[:4])}, CAST(NULL AS VARCHAR) AS balance_raw, source_row_index FROM fx",
    ["fx"],
)
def _(spark, sf):
    rows = fx.statement_rows(spark, sf).drop("balance_raw")
    return hd.fill_and_blank(rows).select(*RAW_FIELDS, "source_row_index")


_INDEX_SQL = "SELECT count(*) AS row_count, 0 AS broken_files FROM fx WHERE source_type = 'CSV'"


def _row_index(spark, sf):
    """Indexes must be exactly 0..n-1 in every file."""
    rows = scan_csv(spark, landing_folder(spark, sf)).rows
    position = F.col("source_row_index").cast("bigint")
    per_file = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(position).alias("distinct_n"), F.max(position).alias("last")
    )
    whole = (F.col("n") == F.col("distinct_n")) & (F.col("last") == F.col("n") - 1)
    return per_file.agg(F.sum("n").alias("row_count"), F.count_if(~whole).alias("broken_files"))


query("A8_row_index_in_file", _INDEX_SQL, ["fx"])(_row_index)
query("F4_row_index_in_file", _INDEX_SQL, ["fx"])(_row_index)


_CELL = "nullif(trim(replace(cells[{i}], chr(10), ' ')), '')"
_TOKENS = "['date','description','debit','credit','balance']"


@query(
    "A9_normalize_table_rows",
    "SELECT " + ", ".join(f"{_CELL.format(i=i + 1)} AS {c}" for i, c in enumerate(RAW_FIELDS))
    + f""", CAST(page AS VARCHAR) AS source_page, CAST(row_index AS VARCHAR) AS source_row_index, source_file
      FROM cells WHERE cells IS NOT NULL
        AND len(list_intersect(list_transform(cells, lambda c: lower(trim(coalesce(c, '')))), {_TOKENS})) < 3
        AND len(list_filter(cells, lambda c: trim(coalesce(c, '')) <> '')) > 0""",
    ["cells"],
)
def _(spark, sf):
    return normalize_table_rows(fx.table_rows(spark, sf)).drop("table_no")


@query(
    "H3_header_intersection",
    f"""SELECT source_file, page, row_index,
        coalesce(len(list_intersect(list_transform(cells, lambda c: lower(trim(coalesce(c, '')))), {_TOKENS})), -1) AS overlap FROM cells""",
    ["cells"],
)
def _(spark, sf):
    return fx.table_rows(spark, sf).select(
        "source_file", "page", "row_index", F.coalesce(header_overlap(F.col("cells")), F.lit(-1)).alias("overlap")
    )


@query(
    "A10_tag_source",
    "SELECT source_file, CASE WHEN lower(source_file) LIKE '%.pdf' THEN 'PDF' ELSE 'CSV' END AS source_type, source_page, source_row_index FROM fx",
    ["fx"],
)
def _(spark, sf):
    rows = fx.statement_rows(spark, sf).drop("source_type")
    return plan.tag_source(rows).select("source_file", "source_type", "source_page", "source_row_index")


@query(
    "A11_isolate_bad_files",
    f"""SELECT 'accepted' AS outcome, statements + 3 * events AS row_count FROM ({_ROWS_SQL}) UNION ALL SELECT 'no_rows', 0
       UNION ALL SELECT 'missing_required:transaction_date_raw,description_raw', 0""",
    ["fx"],
)
def _(spark, sf):
    """Rows by outcome: bad files stay out and take nothing with them."""
    scan = scan_csv(spark, landing_kinds(spark, sf))
    held = scan.rows.groupBy("path").agg(F.count(F.lit(1)).alias("held"))
    good = scan.accepted.join(held, "path", "left").select(F.lit("accepted").alias("outcome"), F.when(F.col("rows") == F.col("held"), F.col("rows")).alias("n"))
    bad = scan.rejected.join(held, "path", "left").select(F.col("reason").alias("outcome"), F.coalesce("held", F.lit(0)).alias("n"))
    return good.unionByName(bad).groupBy("outcome").agg(F.sum("n").alias("row_count"))


@query("A12_enforce_raw_schema", f"SELECT {RAW}, source_page, source_row_index, source_file, source_type FROM fx", ["fx"])
def _(spark, sf):
    return plan.tag_source(fx.statement_rows(spark, sf))


@query(
    "A13_stamp_batch",
    f"""SELECT source_file, source_row_index, '{fx.BATCH_ID}' AS batch_id, '{fx.INGESTED_AT}' AS ingested_at FROM fx""",
    ["fx"],
)
def _(spark, sf):
    return fx.bronze(spark, sf).select(
        "source_file", "source_row_index", "batch_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at")
    )


@query(
    "B5_row_hash",
    "SELECT row_hash, source_file, source_row_index FROM cleaned",
    ["cleaned"],
)
def _(spark, sf):
    return fx.statement_rows(spark, sf).select(fn.row_hash().alias("row_hash"), "source_file", "source_row_index")


@query(
    "E9_dedupe_raw",
    """SELECT row_hash, source_file, source_row_index, balance_raw FROM cleaned""",
    ["cleaned"],
)
def _(spark, sf):
    rows = fx.bronze(spark, sf)
    doubled = rows.unionByName(rows.withColumn("balance_raw", F.lit(None).cast("string")))
    return dedupe_raw(doubled).select("row_hash", "source_file", "source_row_index", "balance_raw")


_BATCHES_SQL = f"SELECT {RAW}, source_file, batch_id FROM fx, (SELECT unnest(['b1', 'b2']) AS batch_id)"


def _two_batches(spark, sf):
    """Two appended batches, read back as one scan."""
    table = AppendTable(spark, scratch_folder(spark, "bronze"), BRONZE, ["batch_id"])
    for batch in ("b1", "b2"):
        table.append(plan.stamp_batch(fx.statement_rows(spark, sf), batch))
    return table


@query("A14_sink_bronze", "SELECT batch_id, count(*) AS row_count FROM fx, (SELECT unnest(['b1', 'b2']) AS batch_id) GROUP BY batch_id", ["fx"])
def _(spark, sf):
    return _two_batches(spark, sf).read().groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"))


def _scan_bronze(spark, sf):
    return _two_batches(spark, sf).read().select(*RAW_FIELDS, "source_file", "batch_id")


query("A15_scan_bronze", _BATCHES_SQL, ["fx"])(_scan_bronze)
query("H4_multi_file_union", _BATCHES_SQL, ["fx"])(_scan_bronze)


@query(
    "A16_sink_overwrite_atomic",
    "SELECT txn_key_hash, description FROM silver",
    ["silver"],
)
def _(spark, sf):
    from passbook.schemas import SILVER

    table = VersionedTable(spark, scratch_folder(spark, "silver"), SILVER)
    table.publish(fx.valid(spark, sf))
    table.publish(fx.silver(spark, sf))
    return table.read().select("txn_key_hash", "description")


@query(
    "A17_sink_quarantine",
    "SELECT row_hash, quarantine_reason FROM cleaned WHERE quarantine_reason IS NOT NULL",
    ["cleaned"],
)
def _(spark, sf):
    from passbook.plans.refine import quarantined_rows
    from passbook.schemas import SILVER

    table = VersionedTable(spark, scratch_folder(spark, "quarantine"), SILVER)
    table.publish(fx.valid(spark, sf).filter("false"), allow_empty=True)
    table.publish(quarantined_rows(fx.bronze(spark, sf)), allow_empty=True)
    return table.read().select("row_hash", "quarantine_reason")


@query(
    "A20_admit_files",
    """SELECT 'usual' AS "limit", 'admitted' AS outcome, 'csv' AS suffix UNION ALL SELECT 'usual', 'unsupported_type', 'txt'
       UNION ALL SELECT 'a byte', 'too_large', 'csv' UNION ALL SELECT 'a byte', 'unsupported_type', 'txt'""",
)
def _(spark, sf):
    """What becomes of the files of each type, under the usual limit and under one of a byte."""
    files = landing.list_files(spark, landing_kinds(spark, sf))
    limits = {"usual": landing.MAX_UPLOAD_BYTES, "a byte": 1}
    judged = [landing.admission(files, most).withColumn("limit", F.lit(name)) for name, most in limits.items()]
    return judged[0].unionByName(judged[1]).select("limit", F.coalesce("reason", F.lit("admitted")).alias("outcome"), "suffix").distinct()


@query(
    "A21_unique_name",
    """SELECT source_file, regexp_replace(source_file, '\\.[^.]*$', '') || '__' || substr(md5(source_file), 1, 8)
         || regexp_extract(source_file, '\\.[^.]*$') AS stored_name FROM (SELECT DISTINCT source_file FROM fx)""",
    ["fx"],
)
def _(spark, sf):
    token = F.substring(F.md5("source_file"), 1, 8)
    return fx.statement_rows(spark, sf).select("source_file").distinct().select(
        "source_file", landing.unique_name(F.col("source_file"), token).alias("stored_name")
    )


def _preview(spark, sf):
    """Five rows, all of them rows of the scan."""
    rows = scan_csv(spark, landing_folder(spark, sf)).rows.select(*RAW_FIELDS)
    shown = preview(rows)
    return shown.agg(F.count(F.lit(1)).alias("shown")).crossJoin(shown.exceptAll(rows).agg(F.count(F.lit(1)).alias("unknown")))


query("A22_preview", "SELECT 5 AS shown, 0 AS unknown")(_preview)
query("G4_preview5", "SELECT 5 AS shown, 0 AS unknown")(_preview)


@query("A23_list_staged", "SELECT 0 AS unlisted, 0 AS wrong_sizes, TRUE AS in_order")
def _(spark, sf):
    """Every statement file with its size, against the sizes of the files as they are read."""
    folder = landing_kinds(spark, sf)
    staged = landing.list_staged(landing.list_files(spark, folder))
    read = landing.fingerprints(spark.read.format("binaryFile").load(folder)).join(
        spark.read.format("binaryFile").load(folder).select("path", F.octet_length("content").alias("n")), "path"
    )
    met = read.select("file_name", "n").join(staged, "file_name", "left")
    wrong = F.abs(F.col("size_kb") - F.col("n") / 1024) > 0.05 + 1e-9
    names = staged.agg(F.collect_list("file_name").alias("names")).select((F.col("names") == F.array_sort("names")).alias("in_order"))
    return met.agg(F.count_if(F.col("size_kb").isNull()).alias("unlisted"), F.count_if(wrong).alias("wrong_sizes")).crossJoin(names)


class _Stopped(RuntimeError):
    pass


class _StopsBeforeManifest(Workspace):
    """A run that ends when Bronze is written and the manifest is not."""

    @property
    def manifest(self):
        table = super().manifest

        def append(df, replace=False):
            raise _Stopped

        table.append = append
        return table


@query(
    "K1_ingest",
    f"SELECT {', '.join(f'nullif({c}, {chr(39)*2}) AS {c}' for c in RAW_FIELDS)}, 'CSV' AS source_type FROM fx WHERE source_type = 'CSV' UNION ALL SELECT "
    + ", ".join(f"{_CELL.format(i=i + 1)}" for i in range(len(RAW_FIELDS)))
    + f""", 'PDF' FROM cells WHERE cells IS NOT NULL
        AND len(list_intersect(list_transform(cells, lambda c: lower(trim(coalesce(c, '')))), {_TOKENS})) < 3
        AND len(list_filter(cells, lambda c: trim(coalesce(c, '')) <> '')) > 0""",
    ["fx", "cells"],
)
def _(spark, sf):
    """CSV files and paged statements; the first run stops before the manifest, a second one follows, a third finds nothing."""
    base, folder, cells = scratch_folder(spark, "workspace"), landing_folder(spark, sf), fx.table_rows(spark, sf)
    name = F.col("source_file")
    pages = cells.select(F.concat(F.lit("pages/"), name).alias("path"), name.alias("file_name"), F.lit("pdf").alias("suffix"), F.sha2(name, 256).alias("file_hash")).distinct()
    files = landing.fingerprint_files(spark, folder).unionByName(pages)
    try:
        plan.ingest(_StopsBeforeManifest(spark, base), folder, cells, files=files)
    except _Stopped:
        pass
    workspace = Workspace(spark, base)
    plan.ingest(workspace, folder, cells, files=files)
    if plan.ingest(workspace, folder, cells, files=files) is not None:
        raise AssertionError("files were ingested twice")
    return workspace.bronze.read().select(*RAW_FIELDS, "source_type")
