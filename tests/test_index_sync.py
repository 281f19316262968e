"""Syncing the index sends every row once, and no vector that is made on the way."""

import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from passbook import functions as fn
from passbook.operators import index as ix
from passbook.plans.indexing import sync_index
from passbook.plans.workspace import Workspace
from passbook.sources.tables import KeyedTable

GOLD = "txn_key_hash string, txn_date date, description string, amount double, source_type string, source_file string, category string"


def gold(spark, n, changed=()):
    """Rows 0 to n - 1; those of ``changed`` have another description."""
    rows = spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("txn_key_hash"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("txn_date"),
        F.concat(F.when(F.col("id").isin(*changed, -1), "new ").otherwise("old "), F.col("id").cast("string")).alias("description"),
        (F.col("id") + 0.5).alias("amount"), F.lit("CSV").alias("source_type"), F.lit("f").alias("source_file"), F.lit("Rent").alias("category"),
    )
    return rows.select([c.split()[0] for c in GOLD.split(", ")])


@pytest.fixture
def plans(monkeypatch):
    """The plans of what was written as data of an index."""
    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        if "/index/data/" in path:
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    return seen


def recording(folder):
    """An embedder that keeps every text it was given."""

    def load():
        def embed(texts):
            with open(f"{folder}/texts", "a") as file:
                file.writelines(f"{t}\n" for t in texts)
            return np.array([[len(str(t)), 1.0] for t in texts], dtype=np.float64).reshape(len(texts), 2)

        return embed

    return load


def test_rows_are_dealt_once_and_embedded_where_they_arrive(spark, tmp_path, plans, monkeypatch):
    monkeypatch.setattr(KeyedTable, "ROWS_PER_BUCKET", 10)
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.gold.publish(gold(spark, 60))
    sync_index(ws)
    ws.gold.publish(gold(spark, 70, changed=range(40)))
    sync_index(ws)
    assert len(plans) == 2
    for plan in plans:
        exchanges = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
        assert len(exchanges) == 1, plan
        assert plan.index("ArrowEvalPython") < plan.index("Exchange")
    assert "Window" not in plans[0] and "Window" in plans[1]


def test_only_new_texts_reach_the_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyedTable, "ROWS_PER_BUCKET", 10)
    ws, load = Workspace(spark, str(tmp_path / "ws")), recording(tmp_path)
    ws.gold.publish(gold(spark, 60))
    assert sync_index(ws, load) == {"upserted": 60, "removed_stale": 0, "re_embedded": 60}
    before = {r["id"]: r for r in ws.index.read().collect()}
    (tmp_path / "texts").unlink()

    later = gold(spark, 65, changed=[3, 7]).filter("description NOT IN ('old 5', 'old 6', 'old 8')")
    ws.gold.publish(later)
    assert sync_index(ws, load) == {"upserted": 62, "removed_stale": 3, "re_embedded": 7}
    told = (tmp_path / "texts").read_text().splitlines()
    assert sorted(re.search(r"\((.*)\)", t)[1] for t in told) == ["new 3", "new 7", *(f"old {i}" for i in range(60, 65))]
    after = {r["id"]: r for r in ws.index.read().collect()}
    want = {r["id"]: r for r in ix.index_documents(later).collect()}
    assert after.keys() == want.keys()
    for key, row in after.items():
        assert (row["document"], row["document_hash"], row["metadata"]) == tuple(want[key][c] for c in ("document", "document_hash", "metadata"))
        assert row["embedding"] == [len(row["document"]), 1.0]
    unchanged = [k for k in after if k in before and before[k]["document_hash"] == after[k]["document_hash"]]
    assert len(unchanged) == 55 and all(after[k] == before[k] for k in unchanged)


def test_an_undated_row_is_a_row_of_the_index(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.gold.publish(gold(spark, 3).withColumn("txn_date", F.when(F.col("description") != "old 1", F.col("txn_date"))))
    for re_embedded in (3, 0):
        assert sync_index(ws)["re_embedded"] == re_embedded
        rows = ws.index.read().collect()
        assert len(rows) == 3 and sum(r["document"] is None for r in rows) == 1 and all(len(r["embedding"]) == ix.HASHED_DIMS for r in rows)


def test_packed_keys_come_back(spark):
    digest = "0123456789abcdef" * 4
    keys = [digest, digest.upper(), digest + "\n", digest[:63], "g" * 64, "é" * 64, "", "x" * 32, "\0" * 33 + "x" * 32, "é-old", digest + "-old", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("p", fn.packed(F.col("k"))).cache()
    assert [r[0] for r in rows.select(fn.unpacked(F.col("p"))).collect()] == keys
    assert len(rows.first()["p"]) == 32 and rows.select("p").distinct().count() == len(keys)
