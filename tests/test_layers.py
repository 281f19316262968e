"""What the stored layers cost follows their rows: bounded sorts, digests that compress."""

import pyarrow.parquet as pq

from checks import fixtures as fx
from passbook.plans.workspace import Workspace
from passbook.scratch import written


def codecs(folder):
    found = [pq.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
    return {m.row_group(0).column(0).compression for m in found if m.num_rows}


def events(spark, folder, n):
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp'2020-01-05 00:00:00' AS ts", "id % 7 AS user_id", "'click' AS event_type", "1.5D AS value", "'{}' AS props"
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_bronze_has_more_parts_where_there_are_more_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "EVENTS_PER_PART", 20)
    events(spark, tmp_path, 600)
    rows = fx.bronze(spark, str(tmp_path))
    assert rows.count() == 600
    assert len({r[0] for r in rows.selectExpr("_metadata.file_path").collect()}) == 30
    assert rows.select("source_row_index").distinct().count() == 600


def test_tables_are_stored_with_zstd(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Rent", "rule")], "txn_key_hash string, category string, origin string")
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.cache.append(rows)
    assert codecs(tmp_path / "ws") == {"ZSTD"}
    written(rows, str(tmp_path / "scratch"), "rows")
    assert codecs(tmp_path / "scratch") == {"ZSTD"}


def test_batches_are_made_once(spark, tmp_path):
    events(spark, tmp_path, 40)
    sf = str(tmp_path)
    assert fx.batched(spark, sf).inputFiles() == fx.batched(spark, sf).inputFiles()
    assert "Window" not in fx.batched(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
