"""File-level behaviour of the CSV scan, on small files of every awkward kind."""

import hashlib

import pytest
from pyspark.sql import functions as F

from passbook.plans.ingest import ingest
from passbook.plans.workspace import Workspace
from passbook.schemas import RAW_FIELDS
from passbook.sources import files as landing
from passbook.sources.csv_files import _lines, scan_csv

HEADER = "Date,Description,Debit,Credit,Balance\n"


@pytest.fixture()
def folder(tmp_path):
    def add(name, text, encoding="utf-8"):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode(encoding))

    add("plain.csv", HEADER + "01-02-2026,coffee,10,,90\n\n   \n02-02-2026,tea,5\n")
    add("quoted.csv", HEADER + '01-02-2026,"UPI, X ""q""",10,,90\n')
    add("multi.CSV", HEADER + '01-02-2026,"two\nlines",10,,90\n02-02-2026,next,1,,89\n')
    add("latin.csv", "Txn Date,Narration,Withdrawal\n01-02-2026,café,7\n", "latin-1")
    add("multi_latin.csv", 'Txn Date,Narration,Withdrawal\n01-02-2026,"caf\xe9\nbar",7\n', "latin-1")
    add("twice.csv", "Txn Date,Value Date,Remarks,Date\n1,2,three,4\n")
    add("bom.csv", "﻿Date,Details\n01-02-2026,x\n")
    add("wide.csv", HEADER + "1,2,3,4,5\n1,2,3,4,5,6\n")
    add("multi_wide.csv", HEADER + '1,"2\n",3,4,5,6\n')
    add("no_date.csv", "Description,Debit\nx,1\n")
    add("header_only.csv", HEADER)
    add("empty.csv", b"")
    add("notes.txt", "not a statement")
    return tmp_path


def by_file(rows):
    out = {}
    for r in rows.orderBy("source_file", F.col("source_row_index").cast("int")).collect():
        out.setdefault(r["source_file"], []).append(tuple(r[n] for n in RAW_FIELDS) + (r["source_row_index"],))
    return out


def test_rows(spark, folder):
    got = by_file(scan_csv(spark, str(folder)).rows)
    assert got["plain.csv"] == [
        ("01-02-2026", "coffee", "10", None, "90", "0"),
        ("02-02-2026", "tea", "5", None, None, "1"),
    ]
    assert got["quoted.csv"] == [("01-02-2026", 'UPI, X "q"', "10", None, "90", "0")]
    assert got["multi.CSV"] == [
        ("01-02-2026", "two\nlines", "10", None, "90", "0"),
        ("02-02-2026", "next", "1", None, "89", "1"),
    ]
    assert got["latin.csv"] == [("01-02-2026", "café", "7", None, None, "0")]
    assert got["multi_latin.csv"] == [("01-02-2026", "café\nbar", "7", None, None, "0")]
    assert got["twice.csv"] == [("1", "three", None, None, None, "0")]
    assert got["bom.csv"] == [("01-02-2026", "x", None, None, None, "0")]
    assert set(got) == {"plain.csv", "quoted.csv", "multi.CSV", "latin.csv", "multi_latin.csv", "twice.csv", "bom.csv"}


def test_rejected_and_ignored(spark, folder):
    scan = scan_csv(spark, str(folder))
    reasons = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in scan.rejected.collect()}
    assert reasons == {
        "wide.csv": "row_wider_than_header",
        "multi_wide.csv": "row_wider_than_header",
        "no_date.csv": "missing_required:transaction_date_raw",
        "header_only.csv": "no_rows",
    }
    ignored = {(r["path"].rsplit("/", 1)[-1], r["header"]) for r in scan.ignored.collect()}
    assert ("twice.csv", "Value Date") in ignored and ("twice.csv", "Date") in ignored
    assert not any(name == "plain.csv" for name, _ in ignored)


def test_row_index_of_a_file_read_by_many_tasks(spark, tmp_path):
    lines = [f"01-02-2026,item {i},{i}" for i in range(5000)]
    (tmp_path / "long.csv").write_text("Date,Description,Debit\n" + "\n".join(lines) + "\n")
    (tmp_path / "short.csv").write_text("Date,Description,Debit\n01-02-2026,only,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = scan_csv(spark, str(tmp_path))
        assert _lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 10
        long = scan.rows.filter("source_file = 'long.csv'")
        assert long.count() == 5000
        assert long.filter("source_row_index <> debit_raw").count() == 0
        assert long.filter("description_raw <> 'item ' || source_row_index").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listing_hash_admission(spark, folder):
    names = [r["file_name"] for r in landing.discover_files(spark, str(folder)).collect()]
    assert names == sorted(names) and "notes.txt" not in names and "multi.CSV" in names
    hashes = {r["file_name"]: r["file_hash"] for r in landing.fingerprint_files(spark, str(folder)).collect()}
    assert hashes["wide.csv"] == hashlib.sha256((folder / "wide.csv").read_bytes()).hexdigest()
    files = landing.list_files(spark, str(folder))
    uploads = files.select("file_name", "suffix", "bytes").unionByName(
        spark.createDataFrame([("none.csv", "csv", 0)], "file_name string, suffix string, bytes bigint")
    )
    reasons = {r["file_name"]: r["reason"] for r in landing.admission(uploads, max_bytes=80).collect()}
    assert reasons["none.csv"] == "empty_file"
    assert reasons["notes.txt"] == "unsupported_type"
    assert reasons["plain.csv"] == "too_large"
    assert reasons["bom.csv"] is None
    kb = {r["file_name"]: r["size_kb"] for r in landing.list_staged(files).collect()}
    assert kb["plain.csv"] == 0.1 and "notes.txt" not in kb


def test_unique_name(spark):
    df = spark.createDataFrame([("a.b.pdf",), ("noext",), (".hidden",)], "n string")
    got = [r[0] for r in df.select(landing.unique_name(F.col("n"), F.lit("0123abcd"))).collect()]
    assert got == ["a.b__0123abcd.pdf", "noext__0123abcd", ".hidden__0123abcd"]
    random = df.select(landing.unique_name(F.col("n")).alias("u")).first()["u"]
    assert len(random) == len("a.b__.pdf") + 8


def test_ingest_is_idempotent_by_content(spark, folder, tmp_path_factory):
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    first = ingest(ws, str(folder), batch_id="b1")
    assert (first.files, first.rows) == (7, 9)
    assert ingest(ws, str(folder), batch_id="b2") is None
    (folder / "copy_of_plain.csv").write_bytes((folder / "plain.csv").read_bytes())
    assert ingest(ws, str(folder), batch_id="b3") is None
    (folder / "new.csv").write_text(HEADER + "03-02-2026,fresh,1,,2\n")
    assert ingest(ws, str(folder), batch_id="b4").rows == 1
    assert ws.bronze.read().count() == 10
    assert {r["file_name"] for r in ws.manifest.read().collect()} >= {"plain.csv", "new.csv"}
    assert ws.bronze.read().filter("source_type <> 'CSV'").count() == 0


def test_ingest_of_extracted_cells(spark, tmp_path, tmp_path_factory):
    (tmp_path / "s.pdf").write_bytes(b"%PDF-1")
    cells = spark.createDataFrame(
        [
            ("s.pdf", 1, 0, 0, ["Date", "Description", "Debit", "Credit", "Balance"]),
            ("s.pdf", 1, 0, 1, ["01-02-2026", "tea\ncup", "5", "", "95"]),
            ("s.pdf", 1, 0, 2, ["", None, " "]),
            ("s.pdf", 2, 0, 1, ["02-02-2026", "x"]),
            ("s.pdf", 2, 0, 2, None),
        ],
        "source_file string, page int, table_no int, row_index int, cells array<string>",
    )
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    assert ingest(ws, str(tmp_path), table_rows=cells).rows == 2
    got = {tuple(r) for r in ws.bronze.read().select(*RAW_FIELDS, "source_page", "source_row_index", "source_type").collect()}
    assert got == {
        ("01-02-2026", "tea cup", "5", None, "95", "1", "1", "PDF"),
        ("02-02-2026", "x", None, None, None, "2", "1", "PDF"),
    }
    assert ingest(ws, str(tmp_path), table_rows=cells) is None


def test_many_files_are_taken_in_rounds(spark, folder, tmp_path_factory, monkeypatch):
    from passbook.plans import ingest as plan

    monkeypatch.setattr(plan, "NAMED_FILES", 2)
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    assert ingest(ws, str(folder)).rows == 9
    (folder / "new.csv").write_text(HEADER + "03-02-2026,fresh,1,,2\n")
    (folder / "newer.csv").write_text(HEADER + "03-02-2026,fresher,1,,2\n")
    assert ingest(ws, str(folder)).rows == 2


NAMES = ["June statement.csv", "a+b.csv", "100%25.csv", "x#1.csv", "stmt[1].csv", "{a,b}?*.csv", "été.csv"]


def test_odd_file_names_are_ingested_once(spark, tmp_path, tmp_path_factory):
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    for turn, name in enumerate(NAMES):
        (tmp_path / name).write_text(HEADER + f'03-02-2026,"item\n{turn}",1,,2\n' if turn % 2 else HEADER + f"03-02-2026,item {turn},1,,2\n")
        result = ingest(ws, str(tmp_path))
        assert (result.files, result.rows) == (1, 1)
    assert ingest(ws, str(tmp_path)) is None
    assert sorted(r["source_file"] for r in ws.bronze.read().collect()) == sorted(NAMES)
    assert sorted(r["file_name"] for r in ws.manifest.read().collect()) == sorted(NAMES)


def test_order_of_lines_is_part_of_the_identity(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,a,1,,\n2,b,2,,\n")
    (tmp_path / "b.csv").write_text(HEADER + "2,b,2,,\n1,a,1,,\n")
    assert len({r["file_hash"] for r in landing.fingerprint_files(spark, str(tmp_path)).collect()}) == 2


def test_rows_do_not_depend_on_later_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "".join(f"01-02-2026,item {i},{i},,\n" for i in range(3000)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        scan = scan_csv(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        rows = scan.rows.select("description_raw", "source_row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000 and all(r["description_raw"] == f"item {r['source_row_index']}" for r in rows)


def test_a_repeated_batch_replaces_its_rows(spark, folder, tmp_path_factory):
    ws = Workspace(spark, str(tmp_path_factory.mktemp("ws")))
    prints = landing.fingerprint_files(spark, str(folder))
    first = ingest(ws, str(folder), batch_id="b", files=prints)
    lost = Workspace(spark, ws.base)
    entries = lost.manifest.read().limit(0)
    import shutil

    shutil.move(f"{ws.base}/manifest", str(tmp_path_factory.mktemp("old") / "manifest"))  # as if stopped before the manifest
    assert entries is not None and ingest(ws, str(folder), batch_id="b", files=prints).rows == first.rows
    assert ws.bronze.read().count() == first.rows


def _quoted_file(rng, rows, end):
    """Rows with commas, doubled quotes, blank lines and line breaks inside quotes, and stray quotes."""
    def field():
        kind = rng.random()
        if kind < 0.4:
            return rng.choice(["plain", "5 inch", 'a 5" pipe', "x y", "é"])
        inner = "".join(rng.choice(["a", " ", ",", '""', "\n", "\n\n", "b"]) for _ in range(rng.randint(1, 12)))
        return f'"{inner}"'

    lines = ["Date,Description,Debit,Credit,Balance"]
    for i in range(rows):
        lines.append(f"01-02-2026,{field()},{i},,{field()}")
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "  "]))
    return end.join(lines) + rng.choice(["", end])


@pytest.mark.parametrize("size", ["1k", "5k", "128m"])
def test_quoted_files_are_split_and_read_as_by_a_plain_reader(spark, tmp_path, size):
    import csv
    import io
    import random

    rng, want = random.Random(9), {}
    for name, rows, end in (("a.csv", 400, "\n"), ("b.csv", 200, "\r\n"), ("c.csv", 1, "\n")):
        text = _quoted_file(rng, rows, end) if rows > 1 else HEADER + '01-02-2026,"one\ntwo",1,,"x"\n'
        (tmp_path / name).write_bytes(text.encode())
        read = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
        want[name] = [(r[1] or None, r[2], str(i)) for i, r in enumerate(read[1:])]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        scan = scan_csv(spark, str(tmp_path))
        found = scan.rows.select("source_file", "description_raw", "debit_raw", "source_row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert scan.rejected.isEmpty()
    for name, rows in want.items():
        assert sorted(((r[1], r[2], r[3]) for r in found if r[0] == name), key=lambda r: int(r[2])) == rows


def test_a_quote_that_is_never_closed_rejects_its_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text(HEADER + '01-02-2026,"never closed,1,,\n' + "01-02-2026,x,1,,\n" * 50)
    (tmp_path / "good.csv").write_text(HEADER + '01-02-2026,"two\nlines",1,,\n')
    long = "x, " * 100_000
    (tmp_path / "long.csv").write_text(HEADER + f'01-02-2026,"{long}\n{long}",1,,\n')
    scan = scan_csv(spark, str(tmp_path))
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in scan.rejected.collect()] == [("open.csv", "unclosed_quote")]
    assert {r["description_raw"] for r in scan.rows.collect()} == {"two\nlines", f"{long}\n{long}"}
