"""Layers end to end: properties, skew, guards, model rounds, streams."""

import json

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from passbook.operators import balance, batching, categories, context, dedupe, enrichment, responses
from passbook.operators.quality import clean_rows, split_valid
from passbook.plans import dashboard
from passbook.plans.ask import ask
from passbook.plans.full_run import full_run, quick_refresh
from passbook.plans.gold import build_gold, categorized_gold
from passbook.plans.indexing import sync_index
from passbook.plans.refine import AllRowsInvalid, refine, silver_rows
from passbook.plans.workspace import Workspace
from passbook.schemas import ANSWERS, CATEGORY_OPTIONS, EmptyTable, MissingColumns, require_columns
from passbook.scratch import scratch_folder
from passbook.sources.manual_store import append_manual, read_manual_json
from passbook.sources.tables import AppendTable, TableMissing, VersionedTable
from tests.conftest import SF


@pytest.fixture()
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path))


@pytest.fixture()
def filled(spark, ws):
    ws.bronze.append(fx.bronze(spark, SF))
    ws.manual.append(fx.manual(spark, SF))
    return ws


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_refine_counts_and_idempotence(spark, filled):
    result = refine(filled)
    assert result.rows_read == fx.bronze(spark, SF).count() == result.rows_valid + result.rows_quarantined
    assert filled.quarantine.read().count() == result.rows_quarantined
    first = filled.silver.read()
    keys = {r[0] for r in first.select("txn_key_hash").collect()}
    assert len(keys) == first.count() == result.rows_published
    again = refine(filled)
    assert again == result
    assert {r[0] for r in filled.silver.read().select("txn_key_hash").collect()} == keys


def test_dedupe_of_doubled_input_changes_nothing(spark):
    valid, _ = split_valid(clean_rows(fx.bronze(spark, SF)))
    once = dedupe.dedupe_valid(valid)
    twice = dedupe.dedupe_valid(valid.unionByName(valid))
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    both = silver_rows(fx.bronze(spark, SF))
    assert once.exceptAll(both).isEmpty() and both.exceptAll(once).isEmpty()


def test_dedupe_limits_hot_keys_before_the_shuffle(spark):
    plan = plan_of(silver_rows(fx.bronze(spark, SF)))
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan


def test_hot_key_dedupe_is_right(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("txn_key_hash"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("source_file"),
    )
    kept = dedupe.dedupe_valid(rows)
    assert kept.count() == 20_001
    assert kept.filter("txn_key_hash = 'hot'").first()["source_file"] == "000000"


def test_dedupe_raw_keeps_rows_that_differ_in_balance_only_once(spark):
    rows = spark.createDataFrame([("h", "5"), ("h", None), ("g", "1")], "row_hash string, balance_raw string")
    assert {tuple(r) for r in dedupe.dedupe_raw(rows).collect()} == {("h", "5"), ("g", "1")}


def test_all_rows_invalid_still_publishes_quarantine(spark, ws):
    ws.bronze.append(fx.bronze(spark, SF).withColumn("transaction_date_raw", F.lit("never")))
    with pytest.raises(AllRowsInvalid):
        refine(ws)
    assert not ws.silver.exists()
    assert ws.quarantine.read().count() == fx.bronze(spark, SF).count()


def test_guards(spark, ws):
    with pytest.raises(EmptyTable):
        refine(ws)
    with pytest.raises(TableMissing):
        build_gold(ws)
    with pytest.raises(TableMissing):
        sync_index(ws)
    with pytest.raises(MissingColumns):
        require_columns(spark.range(1), ["id", "category"])
    with pytest.raises(EmptyTable):
        ws.gold.publish(spark.createDataFrame([], "txn_key_hash string"))
    assert not ws.gold.exists()


def test_gold_rerun_uses_the_cache(spark, filled):
    refine(filled)
    first = build_gold(filled).first()
    rows = filled.gold.read()
    assert rows.columns == ["txn_key_hash", "txn_date", "description", "amount", "source_type", "source_file", "category"]
    assert rows.filter(~F.col("category").isin(*CATEGORY_OPTIONS)).isEmpty()
    before = {tuple(r) for r in rows.select("txn_key_hash", "category").collect()}
    second = build_gold(filled).first()
    assert second["new_rows"] == 0 and second["already_categorized"] == first["already_categorized"] + first["new_rows"]
    assert {tuple(r) for r in filled.gold.read().select("txn_key_hash", "category").collect()} == before
    assert filled.cache.read().count() == filled.cache.read().select("txn_key_hash").distinct().count() == len(before)


def test_explicit_choice_beats_rules_and_cache(spark, filled):
    gold = categorized_gold(fx.silver(spark, SF), fx.manual(spark, SF), fx.cache(spark, SF))
    manual = gold.filter("source_type = 'MANUAL'")
    chosen = fx.manual(spark, SF).filter("category <> 'Uncategorized'").count()
    assert manual.filter("category IN ('Rent', 'Travel', 'Groceries')").count() == chosen
    cached = gold.join(fx.cache(spark, SF).select("txn_key_hash"), "txn_key_hash", "left_semi")
    assert cached.filter("category <> 'Shopping'").isEmpty()


RAW = {
    1: ('{"results":[{"id":0,"category":"Rent"},{"id":1,"category":"Pets"}]}', None),
    2: ("Sure!", "invalid_json"),
    3: ('{"results":[{"id":"0","category":"Rent"},{"id":1,"category":"Rent"}]}', "unknown_id"),
    4: ('{"results":[{"id":0},{"id":1,"category":"Rent"}]}', "malformed_item"),
    5: ('[{"id":0,"category":"Rent"}]', "invalid_json"),
    6: ('{"results":{"id":0}}', "no_results_list"),
    7: ('{"results":[{"id":0,"category":null},{"id":1,"category":5}]}', None),
    8: ('{"results":[3]}', "malformed_item"),
    9: (None, "invalid_json"),
    10: ('{"results":[{"id":0.5,"category":"Rent"},{"id":1,"category":"Rent"}]}', "unknown_id"),
    11: ('{"results":[]} trailing', "invalid_json"),
    12: ('```json\n{"results":[]}\n```', "invalid_json"),
    13: ('{"results":[]}', "missing_id"),
    14: ('{"results":[{"id":0,"category":"Rent"},{"id":1,"category":"Rent"},{"id":0,"category":"Travel"}]}\n', None),
    15: ('{"results":[{"id":0,"category":"Rent"},{"id":2,"category":"Rent"}]}', "unknown_id"),
    16: ('{"results":[{"id":0,"category":["Rent"]},{"id":1,"category":"Rent"}]}', "malformed_item"),
    17: ('{"other":[]}', "no_results_list"),
    18: ('{"results":[{"id":1,"category":"Rent"}]}', "missing_id"),
}


def test_response_checks(spark):
    raw = spark.createDataFrame([(str(i), 1, r) for i, (r, _) in RAW.items()], "batch_id string, attempt int, raw string")
    sizes = raw.select("batch_id", F.lit(2).alias("n_rows"))
    got = {int(r["batch_id"]): r for r in responses.validate_responses(sizes, raw).collect()}
    assert {i: got[i]["reason"] for i in RAW} == {i: reason for i, (_, reason) in RAW.items()}
    assert [tuple(a) for a in got[1]["answers"]] == [(0, "Rent"), (1, "Uncategorized")]
    assert [tuple(a) for a in got[7]["answers"]] == [(0, "Uncategorized"), (1, "Uncategorized")]
    assert [tuple(a) for a in got[14]["answers"]] == [(0, "Travel"), (1, "Rent")]


def test_first_valid_attempt_wins(spark):
    raw = spark.createDataFrame(
        [("a", 1, "no"), ("a", 2, '{"results":[{"id":0,"category":"Rent"}]}'), ("a", 3, '{"results":[{"id":0,"category":"Travel"}]}'), ("b", 1, "no")],
        "batch_id string, attempt int, raw string",
    )
    sizes = raw.select("batch_id", F.lit(1).alias("n_rows")).distinct()
    answers = responses.first_valid_attempt(responses.validate_responses(sizes, raw))
    batched = spark.createDataFrame([("a", 0, "ka"), ("b", 0, "kb")], "batch_id string, local_id bigint, txn_key_hash string")
    assert {tuple(r) for r in responses.with_fallback(batched, answers).collect()} == {
        ("ka", "Rent", "model"),
        ("kb", "Uncategorized", "fallback"),
    }


def test_batches_are_small_and_complete(spark):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("txn_key_hash"))
    batched = batching.assign_batches(rows, digits=2)
    per_batch = batched.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("local_id").alias("lo"), F.max("local_id").alias("hi"))
    assert per_batch.filter("n > 25 OR lo <> 0 OR hi <> n - 1").isEmpty()
    assert per_batch.agg(F.sum("n")).first()[0] == 3000
    assert [batching.shard_digits(n) for n in (1, 1_600_000, 1_600_001, 10**11)] == [1, 1, 2, 5]


def counting_client(folder, fail_first=(), refuse=False):
    """Fails the first calls of a payload; the count survives in files, as tasks do not."""

    def load():
        import hashlib
        import os

        from checks.clients import rule_client

        good = rule_client()

        def call(payload, system):
            path = os.path.join(folder, hashlib.md5(payload.encode()).hexdigest())
            seen = os.path.getsize(path) if os.path.exists(path) else 0
            with open(path, "a") as f:
                f.write(".")
            if refuse:
                raise enrichment.Refused("no quota")
            if seen < len(fail_first):
                if fail_first[seen] == "transient":
                    raise enrichment.Transient("busy")
                return fail_first[seen]
            return good(payload, system)

        return call

    return load


@pytest.mark.parametrize(
    ("client", "origin", "calls"),
    [
        ({"fail_first": ("transient", "not json")}, "model", 3),
        ({"fail_first": ("x",) * 9}, "fallback", 4),
        ({"refuse": True}, "fallback", 1),
    ],
)
def test_model_rounds(spark, tmp_path, client, origin, calls):
    waits = []
    rows = fx.silver(spark, SF).limit(60).select("txn_key_hash", "description", "amount")
    (tmp_path / "calls").mkdir()
    batched = batching.assign_batches(rows, 1)
    done = enrichment.categorize_with_model(
        batched, counting_client(str(tmp_path / "calls"), **client), str(tmp_path / "run"), tasks=2, pause=waits.append
    )
    assert {r["origin"] for r in done.collect()} == {origin} and done.count() == 60
    assert {p.stat().st_size for p in (tmp_path / "calls").iterdir()} == {calls}
    assert waits == [2.0, 4.0, 8.0][: calls - 1]


def test_gold_with_a_model_caches_fallbacks(spark, filled, tmp_path):
    refine(filled)
    (tmp_path / "calls").mkdir()
    policy = enrichment.RetryPolicy(attempts=1)
    figures = build_gold(filled, counting_client(str(tmp_path / "calls"), refuse=True), policy=policy).first()
    assert figures["new_rows"] == figures["still_uncategorized"] > 0
    assert filled.cache.read().filter("origin = 'fallback'").count() == figures["new_rows"]
    assert build_gold(filled).first()["new_rows"] == 0
    # asked again only on request, and then the rules answer
    assert build_gold(filled, retry_fallbacks=True).first()["still_uncategorized"] < figures["still_uncategorized"]


def test_running_balance_equals_the_loop(spark):
    import random

    random.seed(3)
    moves, want = [], {}
    for account in range(4):
        n, balance_now = (400 if account == 0 else 40), 100.0
        for seq in range(n):
            day, amount = f"2026-01-{1 + seq * 20 // n:02d}", round(random.uniform(-300, 250), 2)
            moves.append((account, day, seq, amount))
            balance_now = max(round(balance_now + amount, 2), 0.0)
            want[account, seq] = balance_now
    df = spark.createDataFrame(moves, "account int, d string, seq bigint, amount double").withColumn("d", F.col("d").cast("date"))
    opening = spark.createDataFrame([(a, 100.0) for a in range(4)], "account int, opening double")
    for width in (7, 1_000_000):
        got = {(r["account"], r["seq"]): float(r["balance"]) for r in balance.running_balance(df, opening, width).collect()}
        assert got == want


def test_sync_twice_embeds_nothing_the_second_time(spark, filled):
    refine(filled)
    build_gold(filled)
    n = filled.gold.read().count()
    assert sync_index(filled) == {"upserted": n, "removed_stale": 0, "re_embedded": n}
    version = filled.index.latest()
    assert sync_index(filled) == {"upserted": n, "removed_stale": 0, "re_embedded": 0}
    assert filled.index.latest() == version
    filled.gold.publish(filled.gold.read(stored=True).filter("source_type <> 'CSV'").withColumn(
        "category", F.when(F.col("source_type") == "PDF", "Other").otherwise(F.col("category"))
    ))
    counts = sync_index(filled)
    assert counts["removed_stale"] > 0 and 0 < counts["re_embedded"] < counts["upserted"]
    index = filled.index.read()
    assert index.count() == counts["upserted"] == index.select("id").distinct().count()
    assert index.filter("document LIKE '%source: PDF%' AND document NOT LIKE '%category: Other%'").isEmpty()


def test_a_change_writes_only_its_bucket(spark, filled, monkeypatch):
    from passbook.sources.tables import KeyedTable

    refine(filled)
    build_gold(filled)
    monkeypatch.setattr(KeyedTable, "ROWS_PER_BUCKET", filled.gold.read().count() // 12)
    sync_index(filled)
    before, rows = filled.index.latest(), {r["id"]: r for r in filled.index.read().collect()}
    assert len(before) == 13
    changed = sorted(rows)[7]
    gold = filled.gold.read(stored=True)
    filled.gold.publish(gold.withColumn("category", F.when(F.col("txn_key_hash") == changed, "Travel").otherwise(F.col("category"))))
    assert sync_index(filled)["re_embedded"] == 1
    after = filled.index.latest()
    moved = [b for b in after if after[b] != before[b]]
    assert len(moved) == 1 and changed in {r["id"] for r in filled.index.read(moved).collect()}
    again = {r["id"]: r for r in filled.index.read().collect()}
    assert set(again) == set(rows) and "Travel" in again[changed]["document"]
    assert all(again[i] == rows[i] for i in rows if i != changed)
    # a bucket that loses its last rows has none; a table that outgrew its buckets gets more
    kept = filled.index.touched(filled.index.read().filter(F.col("id") == changed))
    gold = filled.gold.read(stored=True)
    filled.gold.publish(gold.join(filled.index.read(kept).select(F.col("id").alias("txn_key_hash")), "txn_key_hash", "left_anti"))
    sync_index(filled)
    assert filled.index.latest()[kept[0]] is None and filled.index.read(kept).isEmpty()
    assert filled.index.read().count() == filled.gold.read().count()
    monkeypatch.setattr(KeyedTable, "ROWS_PER_BUCKET", 2)
    filled.gold.publish(gold)
    sync_index(filled)
    assert len(filled.index.latest()) > 13 and {r["id"] for r in filled.index.read().collect()} == set(rows)


def test_a_failed_write_leaves_the_index_as_it_was(spark, filled):
    refine(filled)
    build_gold(filled)
    sync_index(filled)
    rows = filled.index.read().count()
    filled.gold.publish(filled.gold.read(stored=True).withColumn("category", F.lit("Other")))

    def broken():
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        sync_index(filled, broken)
    assert filled.index.read().count() == rows and filled.index.read().filter("document LIKE '%category: Other%'").count() < rows


def test_index_failure_leaves_gold(spark, filled):
    def broken():
        raise OSError("no model")

    refine(filled)
    result = quick_refresh(filled, load_embedder=broken)
    assert result["index"] is None and filled.gold.exists() and not filled.index.exists()


def test_full_run_without_new_files(spark, filled, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    (folder / "a.csv").write_text("Date,Description,Debit\n01-02-2026,UPI-UBER INDIA,5\n")
    first = full_run(filled, str(folder))
    assert first["ingest"].rows == 1 and first["index"]["upserted"] == filled.gold.read().count()
    second = full_run(filled, str(folder))
    assert second["ingest"] is None and second["index"]["re_embedded"] == 0


def test_dashboard_filters_reach_the_scan(spark, filled):
    refine(filled)
    build_gold(filled)
    rows = dashboard.filtered(filled.gold.read(), "2024-01-05", "2024-01-09", ("Shopping",), "Statement")
    plan = plan_of(rows.groupBy("category").agg(F.sum("amount")))
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThanOrEqual(txn_date", "IsNotNull(category)", "IsNotNull(source_type)"):
        assert part in pushed
    assert "description" not in pushed[pushed.index("ReadSchema") :]
    panels = dashboard.dashboard_report(filled.gold.read(), listing_limit=5, source="Manual")
    assert panels["listing"].count() == 5 and "TakeOrdered" in plan_of(panels["listing"])
    assert dashboard.filtered(filled.gold.read(), start="2024-01-05").count() == filled.gold.read().count()


def test_ask(spark):
    index = fx.index(spark, SF)
    questions = spark.createDataFrame([("q1", " Uber cab "), ("q2", "  "), ("q3", None)], "query_id string, question string")

    def picky():
        def call(prompt, system):
            raise ValueError("down")

        return call

    got = {r["query_id"]: r["answer"] for r in ask(questions, index, k=3).collect()}
    assert len(got["q1"].split("\n")) == 3 and got["q1"].startswith("- On ")
    assert got["q2"] == got["q3"] == context.BLANK_QUESTION
    failed = {r["query_id"]: r["answer"] for r in ask(questions, index, k=3, load_model=picky).collect()}
    assert failed["q1"] == "Sorry, I couldn't generate an answer right now (down). Please try again."
    empty = {r["query_id"]: r["answer"] for r in ask(questions, index.filter("false"), k=3).collect()}
    assert empty["q1"] == context.NO_EVIDENCE


def test_missing_configuration_stops_the_job(spark):
    def unconfigured():
        def call(prompt, system):
            raise RuntimeError("no key")

        return call

    questions = spark.createDataFrame([("q1", "Uber")], "query_id string, question string")
    with pytest.raises(Exception, match="no key"):
        ask(questions, fx.index(spark, SF), load_model=unconfigured).collect()


def test_manual_store(spark, ws, tmp_path):
    entries = [{"entry_id": "e1", "amount": -5.5, "merchant": "m", "txn_date": "2026-01-02", "category": "Rent", "logged_at": "2026-01-02T10:00:00"}]
    (tmp_path / "manual.json").write_text(json.dumps({"entries": entries}, indent=2))
    row = read_manual_json(spark, str(tmp_path / "manual.json")).first()
    assert (row["entry_id"], row["amount"], str(row["txn_date"])) == ("e1", -5.5, "2026-01-02")
    same = spark.createDataFrame([(-3.0, "\tcoffee ", "Other")] * 2, "amount double, merchant string, category string").withColumn(
        "txn_date", F.lit("2026-01-02").cast("date")
    )
    append_manual(ws.manual, same)
    stored = ws.manual.read().collect()
    assert len({r["entry_id"] for r in stored}) == 2 and {r["merchant"] for r in stored} == {"coffee"}


def test_merge_overrides_and_rules(spark):
    cache = spark.createDataFrame([("a", "Rent", "model"), ("b", "Other", "model")], "txn_key_hash string, category string, origin string")
    chosen = spark.createDataFrame([("b", "Travel"), ("c", "Rent")], "txn_key_hash string, category string")
    assert {tuple(r) for r in categories.merge_overrides(cache, chosen).collect()} == {
        ("a", "Rent", "model"), ("b", "Travel", "override"), ("c", "Rent", "override"),
    }
    texts = [("upi-uber-zomato", -1.0, "Food & Dining"), ("Uber", 5.0, "Income"), ("x", -1.0, "Uncategorized"), ("irctc", None, "Travel")]
    df = spark.createDataFrame(texts, "t string, a double, want string")
    assert df.filter(categories.rule_category(F.col("t"), F.col("a")) != F.col("want")).isEmpty()


def test_streams_equal_batch(spark, tmp_path):
    from passbook.streaming.streams import bronze_source, silver_stream, start_dedupe

    source = str(tmp_path / "bronze")
    for part in range(3):
        fx.bronze(spark, SF).filter(F.pmod(F.xxhash64("row_hash"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(source)
    out = str(tmp_path / "out")
    stream = bronze_source(spark, source, maxFilesPerTrigger=1)
    silver_stream(stream, f"{out}/valid", f"{out}/bad", f"{out}/state").awaitTermination()
    good, bad = split_valid(clean_rows(fx.bronze(spark, SF)))
    for path, batch in ((f"{out}/valid", good), (f"{out}/bad", bad)):
        got = spark.read.parquet(path).select("row_hash")
        assert got.exceptAll(batch.select("row_hash")).isEmpty() and batch.select("row_hash").exceptAll(got).isEmpty()
    for horizon in (None, "30 days"):
        cleaned, _ = split_valid(clean_rows(bronze_source(spark, source, maxFilesPerTrigger=1)))
        path = f"{out}/deduped-{horizon is None}"
        start_dedupe(cleaned, path, f"{path}-state", horizon).awaitTermination()
        keys = spark.read.parquet(path).select("txn_key_hash")
        assert keys.count() == keys.distinct().count() == silver_rows(fx.bronze(spark, SF)).count()


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_retried_fallbacks_leave_one_decision_per_key(spark, filled, tmp_path):
    refine(filled)
    (tmp_path / "calls").mkdir()
    build_gold(filled, counting_client(str(tmp_path / "calls"), refuse=True), policy=enrichment.RetryPolicy(attempts=1))
    for retry in (True, False):
        build_gold(filled, retry_fallbacks=retry)
        rows = filled.gold.read()
        assert rows.count() == rows.select("txn_key_hash").distinct().count()
    known = categories.readable_cache(filled.cache.read())
    assert known.count() == known.select("txn_key_hash").distinct().count() and known.filter("origin = 'fallback'").isEmpty()
    # what the rules left unset is asked when there is a model, and only then
    unset = known.filter("category = 'Uncategorized'").count()
    asked = categories.readable_cache(filled.cache.read(), with_model=True).count()
    assert unset > 0 and asked == known.count() - unset


@pytest.mark.parametrize("raw", ['{"results":[]} {"note":1}', '{"results":[]},{"a":1}', '{"results":[]}}', '[{"results":[]}]', '{"results":[]}] [{"x":1}', '{"results":[]}} {"a":{}'])
def test_a_response_is_one_object(spark, raw):
    sizes = spark.createDataFrame([("b", 0)], "batch_id string, n_rows bigint")
    answer = spark.createDataFrame([("b", 1, raw), ("b", 2, ' {"results":[]}\n')], "batch_id string, attempt int, raw string")
    got = {r["attempt"]: r["reason"] for r in responses.validate_responses(sizes, answer).collect()}
    assert got[1] == "invalid_json" and got[2] != "invalid_json"


def test_models_get_their_instructions(spark, tmp_path):
    def repeats():
        return lambda prompt, system: system

    prompts = context.build_prompts(
        spark.createDataFrame([("q", "where?")], "query_id string, question string"), spark.createDataFrame([("q", "- x")], "query_id string, context string")
    )
    assert enrichment.answer_prompts(prompts, repeats).first()["answer"] == context.SYSTEM_TEXT
    store = AppendTable(spark, str(tmp_path / "answers"), ANSWERS)
    batched = batching.assign_batches(spark.createDataFrame([("a", "UBER", -1.0)], "txn_key_hash string, description string, amount double"), 1)
    enrichment.categorize_with_model(batched, repeats, str(tmp_path / "run"), enrichment.RetryPolicy(attempts=1), store=store)
    assert all(c in store.read().first()["raw"] for c in CATEGORY_OPTIONS)


def test_sums_keep_their_digits(spark):
    from passbook.operators import reports

    small = spark.range(1000).select(F.lit(0.004).alias("amount"))
    assert reports.kpi(small).first()["net"] == 4.0
    large = spark.createDataFrame([(1e20,), (-1e20,), (0.125,), (None,)], "amount double")
    assert reports.kpi(large).first()["net"] == 0.125
    huge = spark.createDataFrame([(1e30,), (1.0,)], "amount double")
    assert reports.kpi(huge).first()["net"] == 1e30


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from passbook.scratch import NoSharedFolder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(NoSharedFolder):
        scratch_folder(cluster, "x")


def answering_client(folder, failing=()):
    """Counts its calls in files, one per prompt; ``failing`` errors come first for every prompt."""

    def load():
        import hashlib
        import os

        def call(prompt, system):
            path = os.path.join(folder, hashlib.md5(prompt.encode()).hexdigest())
            seen = os.path.getsize(path) if os.path.exists(path) else 0
            with open(path, "a") as f:
                f.write(".")
            if seen < len(failing):
                raise failing[seen]
            return prompt.upper()

        return call

    return load


def prompt_rows(spark, texts):
    rows = [(f"q{i}", t, "be brief", None if t else "no question") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, prompt string, system string, message string")


def calls_in(folder):
    return sorted(p.stat().st_size for p in folder.iterdir())


def test_a_question_is_asked_once_whatever_is_done_with_the_answers(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    load, store = answering_client(str(tmp_path / "calls")), AppendTable(spark, str(tmp_path / "answers"), ANSWERS)
    prompts = prompt_rows(spark, ["where?", "when?", None, "where?"])
    answers = enrichment.answer_prompts(prompts, load, store=store)
    want = {"q0": "WHERE?", "q1": "WHEN?", "q2": "no question", "q3": "WHERE?"}
    assert {r["query_id"]: r["answer"] for r in answers.collect()} == want
    answers.write.parquet(str(tmp_path / "out"))
    assert calls_in(tmp_path / "calls") == [1, 1]
    again = enrichment.answer_prompts(prompt_rows(spark, ["when?", "why?"]), load, store=store)
    assert sorted(r["answer"] for r in again.collect()) == ["WHEN?", "WHY?"] and calls_in(tmp_path / "calls") == [1, 1, 1]
    without = enrichment.answer_prompts(prompts, load)
    assert without.count() == without.filter("answer is not null").count() == 4 and calls_in(tmp_path / "calls") == [1, 2, 2]


def test_attempts_of_answers_are_rows(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    store, waits = AppendTable(spark, str(tmp_path / "answers"), ANSWERS), []
    busy = enrichment.Transient("busy")
    load = answering_client(str(tmp_path / "calls"), [busy, busy])
    told = enrichment.answer_prompts(prompt_rows(spark, ["a"]), load, store=store, pause=waits.append)
    assert told.first()["answer"] == "A" and waits == [2.0, 4.0]
    assert sorted((r["attempt"], r["raw"], r["error"]) for r in store.read().collect()) == [(1, None, "busy"), (2, None, "busy"), (3, "A", None)]
    lost = enrichment.answer_prompts(prompt_rows(spark, ["b"]), answering_client(str(tmp_path / "calls"), [ValueError("odd")] * 9), store=store)
    assert lost.first()["answer"] == enrichment.FAILED_ANSWER.format("odd") and calls_in(tmp_path / "calls") == [1, 3]


def test_answers_outlive_a_lost_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    monkeypatch.setattr(enrichment, "CALLS_PER_SAVE", 3)
    load, store = answering_client(str(tmp_path / "calls")), AppendTable(spark, str(tmp_path / "answers"), ANSWERS)
    prompts, append = prompt_rows(spark, [f"p{i}" for i in range(12)]), AppendTable.append

    def stops(self, df, replace=False):
        append(self, df, replace)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(AppendTable, "append", stops)
        with pytest.raises(KeyboardInterrupt):
            enrichment.answer_prompts(prompts, load, store=store)
    assert 0 < store.read().count() < 12
    assert enrichment.answer_prompts(prompts, load, store=store).filter("answer is not null").count() == 12
    assert calls_in(tmp_path / "calls") == [1] * 12


def test_a_stopped_gold_run_asks_only_what_is_open(spark, filled, tmp_path, monkeypatch):
    refine(filled)
    (tmp_path / "calls").mkdir()
    load = counting_client(str(tmp_path / "calls"))
    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "show", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            build_gold(filled, load)
    asked = calls_in(tmp_path / "calls")
    assert asked and set(asked) == {1} and not filled.gold.exists()
    build_gold(filled, load)
    assert calls_in(tmp_path / "calls") == asked
    assert filled.gold.read(stored=True).filter("category_origin = 'model'").count() > 0
