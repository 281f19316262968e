"""Every file's rows are in Bronze exactly once, wherever a run stops; files that cannot be read stay out alone."""

import shutil
from collections import Counter

import pytest

from passbook.plans import ingest as plan
from passbook.plans.ingest import ingest
from passbook.plans.workspace import Workspace
from passbook.schemas import RAW_FIELDS
from passbook.sources import files as landing
from passbook.sources.tables import AppendTable

HEADER = "Date,Description,Debit,Credit,Balance\n"


def put(folder, name, rows):
    (folder / name).write_text(HEADER + "".join(f"01-02-2026,{name} item {i},{i},,\n" for i in range(rows)))


def content(ws):
    return Counter(tuple(r) for r in ws.bronze.read().select(*RAW_FIELDS, "source_file", "source_row_index").collect())


class Stopped(RuntimeError):
    pass


def stop_after(monkeypatch, writes):
    """The n-th append of a table ends the run, after its rows are there."""
    left, append = [writes], AppendTable.append

    def counted(self, df, replace=False):
        append(self, df, replace)
        left[0] -= 1
        if not left[0]:
            raise Stopped

    monkeypatch.setattr(AppendTable, "append", counted)


CELLS = "source_file string, page int, table_no int, row_index int, cells array<string>"


@pytest.fixture
def landing_zone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan, "NAMED_FILES", 2)  # several parts
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        put(folder, f"f{i}.csv", 3 + i)
    (folder / "bad.csv").write_text("When,What\n1,2\n")
    (folder / "paged.pdf").write_bytes(b"not read")
    cells = spark.createDataFrame([("paged.pdf", 1, 0, i, ["01-02-2026", f"cell {i}", "1", None, "2"]) for i in range(5)], CELLS)
    return folder, cells


@pytest.fixture
def clean(spark, landing_zone, tmp_path):
    folder, cells = landing_zone
    later = tmp_path / "later"
    shutil.copytree(folder, later)
    put(later, "new.csv", 2)
    ws = Workspace(spark, str(tmp_path / "clean"))
    ingest(ws, str(later), cells)
    return content(ws)


@pytest.mark.parametrize("writes, again", [(2, "b"), (4, "other"), (5, "b"), (7, None)])
def test_a_stopped_run_is_completed_by_the_next(spark, landing_zone, clean, tmp_path, monkeypatch, writes, again):
    folder, cells = landing_zone
    ws = Workspace(spark, str(tmp_path / "ws"))
    with monkeypatch.context() as patch:
        stop_after(patch, writes)
        with pytest.raises(Stopped):
            ingest(ws, str(folder), cells, batch_id="b")
    put(folder, "new.csv", 2)
    ingest(ws, str(folder), cells, batch_id=again)
    assert content(ws) == clean
    assert len(clean) == 3 + 4 + 5 + 6 + 5 + 2 and set(clean.values()) == {1}
    assert {r["file_name"] for r in ws.manifest.read().collect()} == {"f0.csv", "f1.csv", "f2.csv", "f3.csv", "paged.pdf", "new.csv"}
    assert ingest(ws, str(folder), cells, batch_id="b") is None
    assert content(ws) == clean


def test_a_batch_id_used_again_keeps_what_is_there(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ws = Workspace(spark, str(tmp_path / "ws"))
    put(folder, "a.csv", 10)
    assert ingest(ws, str(folder), batch_id="b").rows == 10
    put(folder, "b.csv", 3)
    assert ingest(ws, str(folder), batch_id="b").rows == 3
    assert ws.bronze.read().count() == 13 and ws.manifest.read().count() == 2


def test_a_file_that_gave_no_rows_gets_a_part_of_its_own_later(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ws = Workspace(spark, str(tmp_path / "ws"))
    put(folder, "a.csv", 4)
    (folder / "paged.pdf").write_bytes(b"not read")
    assert ingest(ws, str(folder)).rows == 4
    cells = spark.createDataFrame([("paged.pdf", 1, 0, 0, ["01-02-2026", "cell", "1", None, "2"])], CELLS)
    assert ingest(ws, str(folder), cells).rows == 1
    assert ws.bronze.read().count() == 5


def spoil(folder, name):
    """Checksums that do not fit, as of a file that broke off: reading it fails."""
    (folder / f".{name}.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + bytes(4 * 64))


def test_a_file_that_breaks_off_stays_out_alone(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ws = Workspace(spark, str(tmp_path / "ws"))
    for i in range(3):
        put(folder, f"f{i}.csv", 2)
    spoil(folder, "f1.csv")
    assert ingest(ws, str(folder)).files == 2
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in ws.rejected_files.read().collect()} == {("f1.csv", "unreadable")}
    (folder / ".f1.csv.crc").write_bytes(b"")
    shutil.move(folder / ".f1.csv.crc", tmp_path / "crc")
    assert ingest(ws, str(folder)).files == 1 and ws.bronze.read().count() == 6


def test_files_that_vanish_or_break_after_the_listing_stay_out_alone(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ws = Workspace(spark, str(tmp_path / "ws"))
    for i in range(6):
        put(folder, f"f{i}.csv", 2)
    prints = spark.createDataFrame(landing.fingerprint_files(spark, str(folder)).collect())
    shutil.move(folder / "f2.csv", tmp_path / "gone")
    spoil(folder, "f4.csv")
    (folder / "f5.csv").write_text(HEADER + '01-02-2026,"two\nlines",1,,\n')
    assert ingest(ws, str(folder), files=prints).files == 4
    assert sorted(r["source_file"] for r in ws.bronze.read().distinct().collect()) == ["f0.csv"] * 2 + ["f1.csv"] * 2 + ["f3.csv"] * 2 + ["f5.csv"]
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in ws.rejected_files.read().collect()}
    assert set(reasons) == {"f2.csv", "f4.csv"} and all(r.startswith("unreadable:") for r in reasons.values())


def test_halves_isolate_every_bad_file_and_nothing_else():
    from pyspark.errors import PySparkException

    calls = []

    def attempt(paths):
        calls.append(len(paths))
        if set(paths) & {"p7", "p500"}:
            raise PySparkException("java.io.IOException: AccessControlException: forbidden")
        return paths

    good, bad = landing.by_halves([f"p{i}" for i in range(1000)], attempt)
    assert sorted(sum(good, [])) == sorted(f"p{i}" for i in range(1000) if i not in (7, 500))
    assert {p for p, _ in bad} == {"p7", "p500"} and len(calls) < 45

    def broken(paths):
        raise PySparkException("no space left on device")

    with pytest.raises(PySparkException):
        landing.by_halves(["a", "b"], broken)


def test_cells_are_read_once_however_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan, "NAMED_FILES", 1)
    monkeypatch.setattr(plan, "FILES_PER_PART", 2)
    folder, calls, normalize = tmp_path / "in", [], plan.normalize_table_rows
    monkeypatch.setattr(plan, "normalize_table_rows", lambda rows: calls.append(1) or normalize(rows))
    folder.mkdir()
    put(folder, "a.csv", 2)
    for i in range(6):
        (folder / f"p{i}.pdf").write_bytes(b"paged %d" % i)
    cells = spark.createDataFrame(
        [(f"p{i}.pdf", 1, 0, r, ["01-02-2026", f"cell {r}", "1", None, "2"]) for i in range(5) for r in range(3)] + [("away.pdf", 1, 0, 0, ["01-02-2026", "x", "1", None, "2"])], CELLS
    )
    ws = Workspace(spark, str(tmp_path / "ws"))
    result = ingest(ws, str(folder), cells)
    assert (result.rows, result.files, len(calls)) == (17, 6, 1)
    assert ws.bronze.read(stored=True).select("part").distinct().count() > 1
    found = Counter((r.source_file, r.source_row_index) for r in ws.bronze.read().filter("source_type = 'PDF'").collect())
    assert found == Counter((f"p{i}.pdf", str(r)) for i in range(5) for r in range(3))
