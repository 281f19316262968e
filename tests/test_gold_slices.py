"""Gold by month: what a change writes, and that the result is the one of a build from nothing."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from passbook.plans.gold import build_gold
from passbook.plans.workspace import Workspace
from passbook.schemas import EmptyTable, MANUAL
from passbook.sources.tables import AppendTable
from tests.conftest import SF


@pytest.fixture()
def ws(spark, tmp_path):
    made = Workspace(spark, str(tmp_path / "ws"))
    made.silver.publish(fx.silver(spark, SF))
    # the entries of one year are enough months
    made.manual.append(fx.manual(spark, SF).where("year(txn_date) = 1996"))
    return made


def folders(ws):
    return {s: r.folder for s, r in ws.gold.slices().items()}


def moved(before, after):
    return {s for s in before.keys() | after.keys() if before.get(s) != after.get(s)}


def rows_of(df):
    return sorted(df.collect(), key=str)


def fresh(ws, tmp_path, name="fresh"):
    """Gold of the same inputs, built from nothing."""
    other = Workspace(ws.spark, str(tmp_path / name))
    other.silver.publish(ws.silver.read())
    other.manual.append(ws.manual.read())
    build_gold(other)
    return rows_of(other.gold.read())


def months(ws):
    return [r[0] for r in ws.silver.read().select(F.year("txn_date") * 12 + F.month("txn_date") - 1).distinct().collect()]


def test_nothing_new_writes_nothing(ws, tmp_path):
    first = build_gold(ws).first()
    version, logged = ws.gold.latest(), ws.cache.read().count()
    assert len(folders(ws)) > 12 and first.new_rows > 0
    # Silver published again holds the same rows in another version, in another order
    ws.silver.publish(ws.silver.read().orderBy(F.rand(3)))
    second = build_gold(ws).first()
    assert ws.gold.latest() == version and ws.cache.read().count() == logged
    assert second.new_rows == 0 and second.already_categorized == ws.gold.read().count()
    assert second.still_uncategorized == first.still_uncategorized == ws.gold.read().filter("category = 'Uncategorized'").count()
    assert rows_of(ws.gold.read()) == fresh(ws, tmp_path)


def test_changes_write_their_months_only(ws, tmp_path):
    spark = ws.spark
    build_gold(ws)
    before, month = folders(ws), sorted(months(ws))[5]
    silver = ws.silver.read()
    row = silver.where(F.year("txn_date") * 12 + F.month("txn_date") - 1 == month).orderBy("txn_key_hash").first()
    # an insert, a delete and a manual entry that another day's entry of the same id replaces
    added = silver.where(F.col("txn_key_hash") == row.txn_key_hash).withColumn("txn_key_hash", F.lit("new"))
    added = added.withColumn("description", F.lit("UBER TRIP"))
    ws.silver.publish(silver.where(F.col("txn_key_hash") != row.txn_key_hash).unionByName(added))
    figures = build_gold(ws).first()
    after = folders(ws)
    assert moved(before, after) == {month} and figures.new_rows == 1
    assert rows_of(ws.gold.read()) == fresh(ws, tmp_path)

    entry = ws.manual.read().orderBy("entry_id").first()
    before, was = folders(ws), entry.txn_date.year * 12 + entry.txn_date.month - 1
    again = entry.asDict() | {"merchant": "~ later", "txn_date": entry.txn_date.replace(year=1950), "category": "Travel"}
    ws.manual.append(spark.createDataFrame([tuple(again[n] for n in MANUAL.names)], MANUAL))
    build_gold(ws)
    assert moved(before, folders(ws)) == {was, 1950 * 12 + entry.txn_date.month - 1}
    gold = ws.gold.read()
    assert [r.category for r in gold.where("description = '~ later'").collect()] == ["Travel"]
    assert gold.count() == gold.select("txn_key_hash").distinct().count()
    assert rows_of(gold) == fresh(ws, tmp_path, "fresh-2")


def test_a_month_that_loses_its_rows_goes(ws, tmp_path):
    build_gold(ws)
    gone = sorted(months(ws))[0]
    number = F.year("txn_date") * 12 + F.month("txn_date") - 1
    ws.silver.publish(ws.silver.read().where(number != gone))
    kept = ws.manual.read().where(number != gone)
    lean = Workspace(ws.spark, str(tmp_path / "lean"))
    lean.silver.publish(fx.silver(ws.spark, SF))
    lean.manual.append(kept)
    build_gold(lean)
    before = folders(lean)
    lean.silver.publish(ws.silver.read())
    build_gold(lean)
    assert gone in before and moved(before, folders(lean)) == {gone} and gone not in folders(lean)
    assert lean.gold.read().where(number == gone).isEmpty()


def test_a_decision_made_elsewhere_reaches_its_month(ws):
    build_gold(ws)
    before = folders(ws)
    row = ws.gold.read().where("source_type <> 'MANUAL'").orderBy("txn_key_hash").first()
    later = F.current_timestamp() + F.expr("INTERVAL 1 SECOND")
    one = ws.spark.createDataFrame([(row.txn_key_hash, "Travel", "override")], "txn_key_hash string, category string, origin string")
    ws.cache.append(one.withColumn("decided_at", later))
    assert build_gold(ws).first().new_rows == 0
    assert moved(before, folders(ws)) == {row.txn_date.year * 12 + row.txn_date.month - 1}
    assert ws.gold.read().where(F.col("txn_key_hash") == row.txn_key_hash).first().category == "Travel"


def test_a_stop_before_the_cache_is_made_good(ws, monkeypatch):
    def stop(self, df, replace=False):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(AppendTable, "append", stop)
        with pytest.raises(KeyboardInterrupt):
            build_gold(ws)
    assert ws.gold.exists() and ws.cache.read().isEmpty()
    shown = rows_of(ws.gold.read())
    build_gold(ws)
    assert rows_of(ws.gold.read()) == shown
    assert ws.cache.read().count() == ws.gold.read().count()
    version = ws.gold.latest()
    build_gold(ws)
    assert ws.gold.latest() == version


def test_gold_published_by_hand_is_built_again(ws, tmp_path):
    build_gold(ws)
    ws.gold.publish(ws.gold.read(stored=True).withColumn("category", F.lit("Other")))
    assert ws.gold.read().filter("category <> 'Other'").isEmpty()
    build_gold(ws)
    assert rows_of(ws.gold.read()) == fresh(ws, tmp_path)


def test_slices_without_dates_and_stray_rows(spark, ws):
    build_gold(ws)
    stray = ws.gold.read(stored=True).limit(1).withColumn("txn_date", F.lit("1901-02-03").cast("date"))
    with pytest.raises(ValueError, match="not replaced"):
        ws.gold.write(stray, replaced={5})
    undated = ws.gold.read(stored=True).limit(3).withColumn("txn_date", F.lit(None).cast("date"))
    ws.gold.publish(undated)
    assert set(ws.gold.slices()) == {-1} and ws.gold.read().count() == 3
    with pytest.raises(EmptyTable):
        ws.gold.publish(undated.limit(0))
    assert ws.gold.read().count() == 3
    ws.gold.publish(undated.limit(0), allow_empty=True)
    assert ws.gold.read().isEmpty() and ws.gold.stored_columns() == ws.gold.stored.names


def test_a_hot_month_is_several_files(spark, tmp_path):
    made = Workspace(spark, str(tmp_path / "hot"))
    rows = spark.range(4000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("txn_key_hash"),
        F.when(F.col("id") % 4 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")))
        .otherwise(F.lit("2021-06-15").cast("date")).alias("txn_date"),
        F.lit("Other").alias("category"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made.gold.publish(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    places = made.gold.read().select(F.month("txn_date").alias("m"), F.year("txn_date").alias("y"), F.input_file_name().alias("file"))
    files = places.groupBy("m", "y").agg(F.countDistinct("file").alias("n")).collect()
    hot = [r.n for r in files if (r.y, r.m) == (2021, 6)]
    assert hot[0] > 1 and made.gold.read().count() == 4000
