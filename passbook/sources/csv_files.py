"""CSV exports of any header layout and either encoding, scanned in one plan.

Files are profiled line by line (splittable, pre-aggregated), giving per file its header, whether
its bytes are UTF-8, and whether every line stands alone. Files without line breaks inside quotes
are then parsed line by line. In the others a prefix scan of quote states tells where records begin,
so they are read by many tasks as well. A row's index in its file is its offset in its split plus
the rows of the earlier splits, which takes one small row per split instead of a sort.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.schemas import RAW_FIELDS
from passbook.scratch import scratch_folder, written
from passbook.sources.files import file_name, literal_path, plain_path
from passbook.sources.headers import column_positions, missing_required

CSV_GLOB = "*.[cC][sS][vV]"
CSV_OPTIONS = {"quote": '"', "escape": '"'}
# complete quoted fields; what is left over tells whether a line stands alone
_QUOTED_FIELD = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|\z)'
LATIN1 = "ISO-8859-1"


@dataclass
class CsvScan:
    rows: DataFrame  # RAW_FIELDS, source_page, source_row_index, path, source_file
    accepted: DataFrame  # path, rows
    rejected: DataFrame  # path, reason
    ignored: DataFrame  # path, header


def _bare(line: Column) -> Column:
    return F.when(line.contains('"'), F.regexp_replace(line, _QUOTED_FIELD, "$1")).otherwise(line)


def _field_count(line: Column) -> Column:
    bare = _bare(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _with_cells(df: DataFrame, line: Column, width: int, out: str) -> DataFrame:
    """Add ``out``: the fields of a CSV line. Lines without a quote are simply split."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    quoted = F.when(line.contains('"'), F.from_csv(line, schema, CSV_OPTIONS))
    parsed = F.array(*[F.col(f"_fields.c{i}") for i in range(width)])
    # _fields is a column of its own, so a quoted line is parsed once and not once per field
    return (
        df.withColumn("_fields", quoted)
        .withColumn(out, F.when(F.col("_fields").isNull(), F.split(line, ",")).otherwise(parsed))
        .drop("_fields")
    )


def _lines(spark: SparkSession, source) -> DataFrame:
    """Non-blank lines with their file, split and a task-ordered id."""
    scan = spark.read.option("pathGlobFilter", CSV_GLOB).text(source)
    return (
        scan.select(
            "value",
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .filter(F.trim("value") != "")
        .withColumn("_id", F.monotonically_increasing_id())
    )


def _profile(lines: DataFrame) -> DataFrame:
    """One row per split."""
    bare = _bare(F.col("value"))
    return lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_id").alias("first_id"),
        F.min_by("value", "_id").alias("first_line"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_and(~bare.contains('"')).alias("plain"),
        F.max(_field_count(F.col("value"))).alias("fields"),
    )


def _decoded(value: Column, utf8: Column) -> Column:
    return F.when(utf8, value).otherwise(F.decode(value.cast("binary"), LATIN1))


def _described(blocks: DataFrame) -> DataFrame:
    """One row per file: header text, flags, widest row, data row count."""
    files = blocks.groupBy("path").agg(
        F.min_by("first_line", "block").alias("_header"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_and("plain").alias("plain"),
        F.max("fields").alias("fields"),
        (F.sum("n") - 1).alias("rows"),
    )
    return files.withColumn("header", _decoded(F.col("_header"), F.col("utf8"))).drop("_header")


def _pick(cells: Column) -> list[Column]:
    return [
        F.nullif(F.get(cells, F.col(f"positions.{n}")), F.lit("")).alias(n) for n in RAW_FIELDS
    ]


def _finish(df: DataFrame, cells: Column, index: Column) -> DataFrame:
    return df.select(
        *_pick(cells),
        F.lit(None).cast("string").alias("source_page"),
        index.cast("string").alias("source_row_index"),
        "path",
        file_name(F.col("path")).alias("source_file"),
    )


def _plain_rows(lines, blocks, usable, width):
    earlier = (
        Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(
        "path",
        "block",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_id")).alias("_shift"),
    ).join(usable.filter("plain").select("path", "utf8", "positions"), "path")
    numbered = lines.join(starts, ["path", "block"]).withColumn(
        "_row", F.col("_id") + F.col("_shift") - 1
    )
    text = numbered.filter("_row >= 0").withColumn("_line", _decoded(F.col("value"), F.col("utf8")))
    return _finish(_with_cells(text, F.col("_line"), width, "_cells"), F.col("_cells"), F.col("_row"))


# a quoted field with all that follows it up to the next comma, the start of one, and the end of one
_CLOSED_FIELD = r'(^|,)"[^"]*+(?:""[^"]*+)*+"[^,]*'
_OPEN_FIELD = r'(?:^|,)"'
_CLOSING = r'\A[^"]*+(?:""[^"]*+)*+"'


def _line_ends_inside(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field, if it begins outside of one and if it begins inside.

    A quote opens a field only at the field's start; a single one closes it, whatever follows.
    """
    opened = lambda text: F.regexp_replace(text, _CLOSED_FIELD, "$1").rlike(_OPEN_FIELD)
    closing = F.regexp_extract(line, _CLOSING, 0)
    rest = F.regexp_replace(F.substring(line, F.length(closing) + 1, F.length(line)), r"\A[^,]*", "")
    return opened(line), (closing == "") | opened(rest)


def _quote_states(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` with ``begins`` and ``ends`` (1 inside a quoted field), and the splits with their end state.

    A line is a function from the state before it to the state after it: a constant, the identity, or a
    swap. Such functions compose, so a running state needs no pass over the file by one task: the last
    constant and the swaps since then tell it within a split, and one row per split carries it on.
    """
    outside, inside = _line_ends_inside(F.col("_line"))
    steps = lines.withColumns({"_out": outside.cast("int"), "_in": inside.cast("int")})
    swap = F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0)
    here = Window.partitionBy("path", "block").orderBy("_id")
    steps = steps.withColumn("_swaps", F.sum(swap).over(here))
    anchor = F.when(F.col("_out") == F.col("_in"), F.pmod(F.col("_out") - F.col("_swaps"), F.lit(2)))
    steps = steps.withColumn("_anchor", F.last(anchor, ignorenulls=True).over(here))

    splits = steps.groupBy("path", "block").agg(F.max_by(F.struct("_swaps", "_anchor"), "_id").alias("_end")).select("path", "block", "_end.*")
    earlier = Window.partitionBy("path").orderBy("block")
    splits = splits.withColumn("_all", F.sum("_swaps").over(earlier))
    far = F.when(F.col("_anchor").isNotNull(), F.pmod(F.col("_anchor") + F.col("_swaps") - F.col("_all"), F.lit(2)))
    splits = splits.withColumn("state", F.pmod(F.coalesce(F.last(far, ignorenulls=True).over(earlier), F.lit(0)) + F.col("_all"), F.lit(2)))
    splits = splits.withColumn("_before", F.lag("state", 1, 0).over(earlier)).select("path", "block", "state", "_before")
    after = F.pmod(F.coalesce("_anchor", "_before") + F.col("_swaps"), F.lit(2))
    known = steps.join(splits.drop("state"), ["path", "block"]).withColumn("ends", after)
    known = known.withColumn("begins", F.coalesce(F.lag("ends").over(here), "_before"))
    return known.drop("_out", "_in", "_swaps", "_anchor", "_before"), splits.drop("_before")


def _quoted_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, record, text) of the records of files with line breaks inside quotes, record 0 being the
    header, and per split its state at the end. Only lines of broken records are shuffled."""
    known, splits = _quote_states(lines)
    first = (F.col("begins") == 0) & (F.trim(F.rtrim("_line", F.lit("\r"))) != "")
    known = known.filter((F.col("begins") == 1) | first).withColumn("_first", (F.col("begins") == 0).cast("int"))
    counts = known.groupBy("path", "block").agg(F.sum("_first").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_earlier"))
    here = Window.partitionBy("path", "block").orderBy("_id")
    numbered = known.withColumn("_running", F.sum("_first").over(here)).join(counts, ["path", "block"])
    numbered = numbered.withColumn("record", F.col("_earlier") + F.col("_running") - 1)
    whole = (F.col("begins") == 0) & (F.col("ends") == 0)
    alone = numbered.filter(whole).select("path", "record", F.col("_line").alias("text"))
    pieces = F.array_sort(F.collect_list(F.struct("_id", "_line")))
    broken = numbered.filter(~whole).groupBy("path", "record").agg(F.array_join(pieces["_line"], "\n").alias("text"))
    records = alone.unionByName(broken)
    return records.withColumn("text", F.regexp_replace("text", r"\r\z", "")), splits


def _quoted_rows(spark, usable, width, folder):
    """Rows of files with line breaks inside quotes, plus (path, rows, _reason) of these files.

    Only these files are read again, each by its name; there are at most as many as were scanned. They
    are split like all others.
    """
    known = usable.filter(~F.col("plain"))
    source = [literal_path(r["path"]) for r in known.select("path").collect()]
    scan = spark.read.option("pathGlobFilter", CSV_GLOB).option("lineSep", "\n").text(source)
    lines = scan.select("value", plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = written(lines.withColumn("_id", F.monotonically_increasing_id()), folder, "quoted-lines")
    text = lines.join(known.select("path", "utf8"), "path").withColumn("_line", _decoded(F.col("value"), F.col("utf8"))).drop("value", "utf8")
    records, splits = _quoted_records(text)
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    parsed = records.withColumn("_fields", F.from_csv("text", schema, CSV_OPTIONS))
    cells = F.array(*[F.col(f"_fields.c{i}") for i in range(width + 1)])
    rows = written(parsed.select("path", "record", cells.alias("cells")).join(known.drop("rows"), "path"), folder, "quoted-rows")
    wide = F.exists(F.slice("cells", F.col("header_fields") + 1, width + 1), lambda c: c.isNotNull())
    per_file = rows.groupBy("path").agg(F.bool_or(wide).alias("_wide"), (F.count(F.lit(1)) - 1).alias("rows"))
    per_file = per_file.join(splits.groupBy("path").agg(F.max_by("state", "block").alias("_open")), "path")
    reason = F.when(F.col("_open") == 1, "unclosed_quote").when(F.col("_wide"), "row_wider_than_header").when(F.col("rows") <= 0, "no_rows")
    per_file = per_file.select("path", "rows", reason.alias("_reason"))
    good = rows.filter("record > 0").join(per_file.filter(F.col("_reason").isNull()).select("path"), "path")
    return _finish(good, F.col("cells"), F.col("record") - 1), per_file


def scan_csv(spark: SparkSession, source) -> CsvScan:
    """``source``: a folder or a list of paths (plain names go through ``literal_path``).

    The numbered lines are stored once: profile and rows come from the same lines, however the
    files are split later. No file is read after this function returns, so a file that cannot be read
    fails here. Collected are one width, one count, and the names of the files with line
    breaks inside quotes.
    """
    folder = scratch_folder(spark, "csv")
    lines = written(_lines(spark, source), folder, "lines")
    blocks = written(_profile(lines), folder, "splits")
    described = _described(blocks).withColumn("header_fields", _field_count(F.col("header")))
    width = described.agg(F.max("header_fields")).first()[0] or 1
    named = _with_cells(described, F.col("header"), width, "names").withColumn(
        "positions", column_positions(F.col("names"))
    )
    missing = F.concat_ws(",", missing_required("positions"))
    reason = (
        F.when(missing != "", F.concat(F.lit("missing_required:"), missing))
        .when(F.col("rows") <= 0, "no_rows")
        .when(F.col("plain") & (F.col("fields") > F.col("header_fields")), "row_wider_than_header")
    )
    judged = written(named.withColumn("reason", reason), folder, "files")
    usable = judged.filter(F.col("reason").isNull())
    quoted_files = usable.filter(~F.col("plain")).count()

    rows = _plain_rows(lines, blocks, usable, width)
    accepted = usable.filter("plain").select("path", "rows")
    rejected = judged.filter(F.col("reason").isNotNull()).select("path", "reason")
    if quoted_files:
        quoted, per_file = _quoted_rows(spark, usable, width, folder)
        per_file = written(per_file, folder, "quoted")
        rows = rows.unionByName(quoted)
        per_file = per_file.withColumnRenamed("_reason", "reason")
        accepted = accepted.unionByName(
            per_file.filter(F.col("reason").isNull()).select("path", "rows")
        )
        rejected = rejected.unionByName(
            per_file.filter(F.col("reason").isNotNull()).select("path", "reason")
        )
    claimed = F.array(*[f"positions.{n}" for n in RAW_FIELDS])
    ignored = (
        judged.select("path", claimed.alias("claimed"), F.posexplode("names").alias("pos", "header"))
        .filter(~F.exists("claimed", lambda p: p.eqNullSafe(F.col("pos"))))
        .select("path", "header")
    )
    return CsvScan(rows, accepted, rejected, ignored)


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.limit(n)
