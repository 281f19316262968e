"""Categories, batching, responses, reports, balance."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.q_silver import DAY, day
from checks.oracle_ctes import RULE
from checks.registry import query
from passbook.functions import month_bucket
from passbook.operators import balance as bal
from passbook.operators import batching as bt
from passbook.operators import categories as cat
from passbook.operators import manual as man
from passbook.operators import reports as rp
from passbook.operators import responses as rs
from passbook.operators.enrichment import categorize_with_model
from passbook.plans.dashboard import dashboard_report
from passbook.plans.workspace import Workspace
from passbook.scratch import scratch_folder
from passbook.schemas import CATEGORY_OPTIONS

ALLOWED = ", ".join(f"'{c}'" for c in CATEGORY_OPTIONS)


@query("A18_category_cache", "SELECT txn_key_hash, category, origin FROM cache", ["cache"])
def _(spark, sf):
    table = Workspace(spark, scratch_folder(spark, "cache")).cache
    table.append(fx.cache(spark, sf))
    return cat.readable_cache(table.read())


@query(
    "A24_scan_gold",
    f"SELECT txn_key_hash, {DAY} AS txn_date, description, amount, source_type, source_file, category FROM gold",
    ["gold"],
)
def _(spark, sf):
    table = Workspace(spark, scratch_folder(spark, "gold")).gold
    table.publish(fx.gold(spark, sf))
    return table.read().withColumn("txn_date", day())


_UNCACHED_SQL = "SELECT txn_key_hash, description FROM silver WHERE txn_key_hash NOT IN (SELECT txn_key_hash FROM cache)"


@query("D2_uncached", _UNCACHED_SQL, ["silver", "cache"])
def _(spark, sf):
    return cat.uncached(fx.silver(spark, sf), fx.cache(spark, sf)).select("txn_key_hash", "description")


@query(
    "D3_attach_category",
    "SELECT s.txn_key_hash, coalesce(c.category, 'Uncategorized') AS category FROM silver s LEFT JOIN cache c USING (txn_key_hash)",
    ["silver", "cache"],
)
def _(spark, sf):
    rows = fx.silver(spark, sf).select("txn_key_hash")
    return cat.attach_category(rows, fx.cache(spark, sf)).select("txn_key_hash", "category")


@query(
    "D4_merge_overrides",
    """SELECT coalesce(o.txn_key_hash, c.txn_key_hash) AS txn_key_hash, coalesce(o.category, c.category) AS category,
         CASE WHEN o.category IS NOT NULL THEN 'override' ELSE c.origin END AS origin
       FROM (SELECT txn_key_hash, category, origin FROM cache UNION ALL
             SELECT txn_key_hash, 'Other', 'model' FROM manual) c
       FULL JOIN (SELECT txn_key_hash, category FROM manual WHERE category <> 'Uncategorized') o
         ON o.txn_key_hash = c.txn_key_hash""",
    ["cache", "manual"],
)
def _(spark, sf):
    entries = fx.manual(spark, sf)
    guessed = man.manual_to_gold(entries).select("txn_key_hash", F.lit("Other").alias("category"), F.lit("model").alias("origin"))
    return cat.merge_overrides(fx.cache(spark, sf).unionByName(guessed), man.manual_overrides(entries))


@query("C7_allowed_category", f"SELECT o_orderkey, CASE WHEN c IN ({ALLOWED}) THEN c ELSE 'Uncategorized' END AS category FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Travel' WHEN o_orderstatus = 'O' THEN o_orderpriority END AS c FROM orders)")
def _(spark, sf):
    status = F.col("o_orderstatus")
    value = F.when(status == "F", "Travel").when(status == "O", F.col("o_orderpriority"))
    return fx.table(spark, sf, "orders").select("o_orderkey", cat.allowed_category(value).alias("category"))


@query("I1_categorize_rules", f"SELECT txn_key_hash, {RULE} AS category FROM silver", ["silver"])
def _(spark, sf):
    return fx.silver(spark, sf).select(
        "txn_key_hash", cat.rule_category(F.col("description"), F.col("amount")).alias("category")
    )


@query(
    "E10_gold_stats",
    """SELECT count(c.category) AS already_categorized, count(*) FILTER (c.category IS NULL) AS new_rows,
       count(*) FILTER (coalesce(c.category, 'Uncategorized') = 'Uncategorized') AS still_uncategorized
       FROM silver s LEFT JOIN cache c USING (txn_key_hash)""",
    ["silver", "cache"],
)
def _(spark, sf):
    return cat.cache_stats(cat.look_up(fx.silver(spark, sf).select("txn_key_hash"), fx.cache(spark, sf)))


@query("F1_assign_batches", "SELECT txn_key_hash, batch_id, local_id FROM batched", ["batched"])
def _(spark, sf):
    return fx.batched(spark, sf).select("txn_key_hash", "batch_id", "local_id")


@query(
    "B17_request_payload",
    """SELECT batch_id, local_id, coalesce(description, '') AS description, coalesce(amount, 0.0) AS amount FROM batched""",
    ["batched"],
)
def _(spark, sf):
    """The JSON of every request, read back as columns."""
    items = F.from_json("payload", "array<struct<id: bigint, description: string, amount: double>>")
    return fx.payloads(spark, sf).select("batch_id", F.inline(items)).withColumnRenamed("id", "local_id")


@query("D7_match_response_ids", "SELECT batch_id, attempt, unknown_ids, missing_ids FROM verdicts", ["verdicts"])
def _(spark, sf):
    verdicts = rs.validate_responses(fx.payloads(spark, sf), fx.responses(spark, sf))
    return verdicts.select("batch_id", "attempt", "unknown_ids", "missing_ids")


@query("I3_validate_responses", "SELECT batch_id, attempt, reason IS NULL AS ok, coalesce(reason, '') AS reason FROM verdicts", ["verdicts"])
def _(spark, sf):
    verdicts = rs.validate_responses(fx.payloads(spark, sf), fx.responses(spark, sf))
    return verdicts.select("batch_id", "attempt", "ok", F.coalesce("reason", F.lit("")).alias("reason"))


def _answers(spark, sf):
    return rs.first_valid_attempt(rs.validate_responses(fx.payloads(spark, sf), fx.responses(spark, sf)))


@query(
    "D9_map_local_ids",
    f"SELECT txn_key_hash, CASE WHEN a.category IN ({ALLOWED}) THEN a.category ELSE 'Uncategorized' END AS category FROM batched JOIN answers a USING (batch_id, local_id)",
    ["batched", "answers"],
)
def _(spark, sf):
    return bt.map_local_ids(_answers(spark, sf), fx.batched(spark, sf)).select("txn_key_hash", "category")


_FALLBACK_SQL = f"""SELECT txn_key_hash, CASE WHEN a.category IN ({ALLOWED}) THEN a.category ELSE 'Uncategorized' END AS category,
  CASE WHEN a.batch_id IS NULL THEN 'fallback' ELSE 'model' END AS origin
  FROM batched b LEFT JOIN answers a ON a.batch_id = b.batch_id AND a.local_id = b.local_id"""


@query("I4_first_valid_attempt", _FALLBACK_SQL, ["batched", "answers"])
def _(spark, sf):
    return rs.with_fallback(fx.batched(spark, sf), _answers(spark, sf))


@query(
    "I5_cache_results",
    f"SELECT txn_key_hash, category, origin FROM cache UNION ALL {_FALLBACK_SQL} WHERE txn_key_hash NOT IN (SELECT txn_key_hash FROM cache)",
    ["cache", "batched", "answers"],
)
def _(spark, sf):
    results = rs.with_fallback(fx.batched(spark, sf), _answers(spark, sf))
    table = Workspace(spark, scratch_folder(spark, "cache")).cache
    known = fx.cache(spark, sf)
    table.append(known)
    table.append(cat.cache_entries(cat.uncached(results, known), F.col("origin")))
    return cat.readable_cache(table.read())


@query(
    "I2_retry",
    f"""SELECT txn_key_hash, CASE WHEN n_rows % 2 = 1 THEN 'Uncategorized' ELSE {RULE} END AS category,
          CASE WHEN n_rows % 2 = 1 THEN 'fallback' ELSE 'model' END AS origin FROM batched JOIN sizes USING (batch_id)""",
    ["batched", "sizes"],
)
def _(spark, sf):
    """A client that never gets batches of an odd size right: they use up every attempt."""
    from checks.clients import half_trained_client

    rounds = scratch_folder(spark, "retry")
    return categorize_with_model(fx.batched(spark, sf), half_trained_client, rounds, pause=lambda _: None)


@query(
    "K3_categorized_gold",
    f"SELECT txn_key_hash, {DAY} AS txn_date, description, amount, source_type, source_file, category FROM gold",
    ["gold"],
)
def _(spark, sf):
    return fx.gold_plan(spark, sf).withColumn("txn_date", day())


@query(
    "K3_incremental_gold",
    f"""SELECT txn_key_hash, {DAY} AS txn_date, description, amount, source_type, source_file,
          coalesce(chosen, {RULE}) AS category FROM combined""",
    ["combined"],
)
def _(spark, sf):
    """Gold of the CSV statements and the entries without a category, then the rest arrives and it is built again."""
    from passbook.plans.gold import build_gold

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    silver, manual = fx.silver(spark, sf), fx.manual(spark, sf)
    workspace.silver.publish(silver.filter("source_type = 'CSV'"))
    workspace.manual.append(manual.filter("category = 'Uncategorized'"))
    build_gold(workspace)
    workspace.silver.publish(silver)
    workspace.manual.append(manual.filter("category <> 'Uncategorized'"))
    build_gold(workspace)
    return workspace.gold.read().withColumn("txn_date", day())


_SELECTION = {"start": "1996-01-01", "end": "2024-01-15", "categories": ("Shopping", "Rent", "Income"), "source": "All"}
_RANGE_SQL = "txn_date BETWEEN DATE '1996-01-01' AND DATE '2024-01-15'"


@query("C4_filter_date_range", f"SELECT txn_key_hash, {DAY} AS txn_date FROM gold WHERE {_RANGE_SQL}", ["gold"])
def _(spark, sf):
    return rp.filter_date_range(fx.gold(spark, sf), "1996-01-01", "2024-01-15").select("txn_key_hash", day())


@query("C5_filter_categories", "SELECT txn_key_hash, category FROM gold WHERE category IN ('Shopping', 'Rent', 'Income')", ["gold"])
def _(spark, sf):
    return rp.filter_categories(fx.gold(spark, sf), ("Shopping", "Rent", "Income")).select("txn_key_hash", "category")


@query(
    "C6_filter_source",
    """SELECT 'All' AS source, txn_key_hash FROM gold UNION ALL SELECT 'Statement', txn_key_hash FROM gold WHERE source_type <> 'MANUAL'
       UNION ALL SELECT 'Manual', txn_key_hash FROM gold WHERE source_type = 'MANUAL'""",
    ["gold"],
)
def _(spark, sf):
    rows = fx.gold(spark, sf)
    parts = [
        rp.filter_source(rows, s).select(F.lit(s).alias("source"), "txn_key_hash") for s in ("All", "Statement", "Manual")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _cents(expression):
    # through text, as DuckDB's casts between doubles and wide decimals are off in the last digits
    return f"CAST(CAST(coalesce(sum(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,10))), 0) AS VARCHAR) AS DOUBLE)"


_KPI_SQL = f"""SELECT {_cents('CASE WHEN amount > 0 THEN amount END')} AS income,
  {_cents('CASE WHEN amount < 0 THEN -amount END')} AS expense, {_cents('amount')} AS net, count(*) AS transactions FROM {{src}}"""
_SPEND_SQL = f"""SELECT category, {_cents('-amount')} AS spend FROM {{src}} WHERE amount < 0 AND category <> 'Income'
  GROUP BY category ORDER BY spend DESC, category"""
_MONTH_SQL = f"SELECT strftime(txn_date, '%Y-%m') AS month, {_cents('amount')} AS net FROM {{src}} GROUP BY 1 ORDER BY 1"


@query("E2_kpi", _KPI_SQL.format(src="gold"), ["gold"])
def _(spark, sf):
    return rp.kpi(fx.gold(spark, sf))


def _spend(spark, sf):
    return rp.spend_by_category(fx.gold(spark, sf))


query("E3_spend_by_category", _SPEND_SQL.format(src="gold"), ["gold"])(_spend)
query("G2_spend_sorted", _SPEND_SQL.format(src="gold"), ["gold"])(_spend)


@query("E4_net_by_month", _MONTH_SQL.format(src="gold"), ["gold"])
def _(spark, sf):
    return rp.net_by_month(fx.gold(spark, sf))


@query(
    "E5_date_bounds",
    "SELECT strftime(min(txn_date), '%Y-%m-%d') AS first_day, strftime(max(txn_date), '%Y-%m-%d') AS last_day FROM gold",
    ["gold"],
)
def _(spark, sf):
    return rp.date_bounds(fx.gold(spark, sf)).select(day("first_day"), day("last_day"))


@query("E6_distinct_categories", "SELECT DISTINCT category FROM gold WHERE category IS NOT NULL ORDER BY 1", ["gold"])
def _(spark, sf):
    return rp.distinct_categories(fx.gold(spark, sf))


@query("B15_month_bucket", "SELECT txn_key_hash, strftime(txn_date, '%Y-%m') AS month FROM gold", ["gold"])
def _(spark, sf):
    return fx.gold(spark, sf).select("txn_key_hash", month_bucket(F.col("txn_date")).alias("month"))


_LISTING_SQL = f"SELECT {DAY} AS date, description, amount, category, source_type AS source FROM gold"


@query("B16_display_projection", _LISTING_SQL, ["gold"])
def _(spark, sf):
    return rp.display_columns(fx.gold(spark, sf))


@query("G1_listing", _LISTING_SQL + " ORDER BY txn_date DESC, txn_key_hash", ["gold"])
def _(spark, sf):
    return rp.listing(fx.gold(spark, sf))


_PICKED = f"(SELECT * FROM gold WHERE {_RANGE_SQL} AND category IN ('Shopping', 'Rent', 'Income'))"


@query(
    "K6_dashboard_report",
    f"""SELECT 'kpi' AS panel, 'income' AS label, income AS value FROM ({_KPI_SQL.format(src=_PICKED)})
    UNION ALL SELECT 'kpi', 'expense', expense FROM ({_KPI_SQL.format(src=_PICKED)})
    UNION ALL SELECT 'kpi', 'net', net FROM ({_KPI_SQL.format(src=_PICKED)})
    UNION ALL SELECT 'listing', concat_ws('|', strftime(txn_date, '%Y-%m-%d'), description, category, source_type), amount FROM {_PICKED}
    UNION ALL SELECT 'kpi', 'transactions', CAST(transactions AS DOUBLE) FROM ({_KPI_SQL.format(src=_PICKED)})
    UNION ALL SELECT 'spend_by_category', category, spend FROM ({_SPEND_SQL.format(src=_PICKED)})
    UNION ALL SELECT 'net_by_month', month, net FROM ({_MONTH_SQL.format(src=_PICKED)})""",
    ["gold"],
)
def _(spark, sf):
    panels = dashboard_report(fx.gold(spark, sf), **_SELECTION)
    kpi = panels["kpi"].select(
        F.lit("kpi").alias("panel"),
        F.explode(F.create_map(
            F.lit("income"), F.col("income"), F.lit("expense"), F.col("expense"), F.lit("net"), F.col("net"),
            F.lit("transactions"), F.col("transactions").cast("double"),
        )).alias("label", "value"),
    )
    spend = panels["spend_by_category"].select(F.lit("spend_by_category").alias("panel"), F.col("category").alias("label"), F.col("spend").alias("value"))
    months = panels["net_by_month"].select(F.lit("net_by_month").alias("panel"), F.col("month").alias("label"), F.col("net").alias("value"))
    label = F.concat_ws("|", "date", "description", "category", "source")
    listed = panels["listing"].select(F.lit("listing").alias("panel"), label.alias("label"), F.col("amount").alias("value"))
    return kpi.unionByName(spend).unionByName(months).unionByName(listed)


@query(
    "F5_running_balance",
    """WITH m AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount FROM orders),
       s AS (SELECT account, d, seq, amount, CAST(coalesce(c_acctbal, 0) AS DECIMAL(18,2)) + sum(amount) OVER w AS s
         FROM m LEFT JOIN customer ON c_custkey = account
         WINDOW w AS (PARTITION BY account ORDER BY d, seq ROWS UNBOUNDED PRECEDING))
       SELECT account, strftime(d, '%Y-%m-%d') AS d, seq, CAST(amount AS DOUBLE) AS amount,
         CAST(s - least(0, min(s) OVER (PARTITION BY account ORDER BY d, seq ROWS UNBOUNDED PRECEDING)) AS DOUBLE) AS balance FROM s""",
)
def _(spark, sf):
    # a small chunk width makes every account span several chunks even on small data
    rows = bal.running_balance(fx.account_moves(spark, sf), fx.opening_balances(spark, sf), seq_per_chunk=1000)
    return rows.select(
        "account", day("d"), "seq", F.col("amount").cast("double").alias("amount"), F.col("balance").cast("double").alias("balance")
    )


_RULED = f"SELECT source_type, category, count(*) AS row_count FROM (SELECT source_type, coalesce(chosen, {RULE}) AS category FROM combined) GROUP BY ALL"


@query("K5_quick_refresh", _RULED, ["combined"])
def _(spark, sf):
    from passbook.plans.full_run import quick_refresh

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    workspace.silver.publish(fx.silver(spark, sf))
    workspace.manual.append(fx.manual(spark, sf))
    quick_refresh(workspace)
    return workspace.gold.read().groupBy("source_type", "category").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "K4_full_run",
    f"""SELECT source_type, category, count(*) AS row_count FROM (
          SELECT DISTINCT txn_key_hash, 'CSV' AS source_type, {RULE} AS category FROM cleaned
          WHERE quarantine_reason IS NULL AND source_type = 'CSV'
          UNION ALL SELECT txn_key_hash, source_type, coalesce(chosen, {RULE}) FROM combined WHERE source_type = 'MANUAL')
        GROUP BY ALL""",
    ["cleaned", "combined"],
)
def _(spark, sf):
    from checks.landing import landing_folder
    from passbook.plans.full_run import full_run

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    workspace.manual.append(fx.manual(spark, sf))
    full_run(workspace, landing_folder(spark, sf), table_rows=None)
    return workspace.gold.read().groupBy("source_type", "category").agg(F.count(F.lit(1)).alias("row_count"))
