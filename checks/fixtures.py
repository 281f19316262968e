"""Statement-shaped inputs derived from the driver tables.

The SELECT lists are shared with the oracle, so both engines start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.operators import categories as cat
from passbook.operators import index as ix
from passbook.operators import manual as man
from passbook.operators.batching import assign_batches, request_payloads, shard_digits
from passbook.operators.quality import clean_rows, split_valid
from passbook.plans import ingest
from passbook.plans.gold import categorized_gold
from passbook.plans.refine import silver_rows
from passbook.scratch import STORED_AS, scratch_folder

AS_OF = "2001-01-01"
BATCH_ID = "20260101T000000Z_00000000"
INGESTED_AT = "2026-01-01 00:00:00"
EVENTS_PER_PART = 200_000

# The layout of a row varies with its id; the last days of the period were uploaded twice.
STATEMENT_COLUMNS = """
  CASE WHEN event_id % 97 = 0 THEN 'n/a'
       WHEN event_id % 101 = 0 THEN NULL
       WHEN event_id % 8 = 0 THEN dd || '-' || mm || '-' || yy
       WHEN event_id % 8 = 1 THEN yy || '-' || mm || '-' || dd
       WHEN event_id % 8 = 2 THEN dd || '/' || mm || '/' || yy
       WHEN event_id % 8 = 3 THEN yy || '/' || mm || '/' || dd
       WHEN event_id % 8 = 4 THEN mm || '/' || dd || '/' || yy
       WHEN event_id % 8 = 5 THEN d1 || '-' || m1 || '-' || yy
       WHEN event_id % 8 = 6 THEN d1 || '/' || m1 || '/' || yy
       ELSE '  ' || dd || '-' || mm || '-' || yy || ' ' END AS transaction_date_raw,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN '   '
       WHEN event_type = 'purchase' THEN 'UPI-AMAZON PAY-' || eid || '@apl-Shopping'
       WHEN event_type = 'click'    THEN 'UPI-SWIGGY-' || eid || '@ybl-Food  Order'
       WHEN event_type = 'view'     THEN 'UPI-UBER INDIA-' || eid || '@ybl-Cab'
       WHEN event_type = 'signup'   THEN 'NEFT-SALARY   CREDIT-' || eid
       ELSE 'ATM WDL-' || CAST(user_id AS VARCHAR(20)) END AS description_raw,
  CASE WHEN event_id % 79 = 0 OR event_type = 'signup' THEN NULL
       WHEN event_id % 5 = 0 THEN 'Rs. ' || vv
       WHEN event_id % 5 = 1 THEN '₹' || vv
       WHEN event_id % 71 = 0 THEN 'Rs.' || vv || '/-'
       ELSE vv END AS debit_raw,
  CASE WHEN event_type = 'signup' THEN 'INR 4' || CAST(event_id % 10 AS VARCHAR(1)) || ','
            || lpad(CAST(event_id % 1000 AS VARCHAR(3)), 3, '0') || '.50'
       WHEN event_id % 73 = 0 THEN '0.00' ELSE NULL END AS credit_raw,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(v + 1000 AS VARCHAR(30)) END AS balance_raw,
  CASE WHEN event_id % 2 = 0 THEN CAST(1 + event_id % 4 AS VARCHAR(2)) ELSE NULL END AS source_page,
  eid AS source_row_index,
  CASE WHEN event_id % 2 = 0
       THEN 'stmt_' || CAST(user_id AS VARCHAR(20)) || '_' || CAST(copy_no AS VARCHAR(1)) || '.pdf'
       ELSE 'upi_' || CAST(user_id AS VARCHAR(20)) || '_' || CAST(copy_no AS VARCHAR(1)) || '.csv'
  END AS source_file,
  CASE WHEN event_id % 2 = 0 THEN 'PDF' ELSE 'CSV' END AS source_type
"""

EVENT_PARTS = """
  event_id, user_id, event_type, CAST(event_id AS VARCHAR(20)) AS eid,
  CAST(value AS DECIMAL(18,2)) AS v, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(30)) AS vv,
  lpad(CAST(day(ts) AS VARCHAR(2)), 2, '0') AS dd, CAST(day(ts) AS VARCHAR(2)) AS d1,
  lpad(CAST(month(ts) AS VARCHAR(2)), 2, '0') AS mm, CAST(month(ts) AS VARCHAR(2)) AS m1,
  CAST(year(ts) AS VARCHAR(4)) AS yy
"""

MANUAL_COLUMNS = """
  CAST(o_orderkey AS VARCHAR(20)) AS entry_id,
  CASE WHEN o_orderkey % 410 = 0 THEN CAST(0 AS DECIMAL(18,2))
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
  CASE WHEN o_orderkey % 30 = 0 THEN 'Income (money in)' ELSE 'Expense (money out)' END AS direction,
  CASE WHEN o_orderkey % 430 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS merchant,
  CAST(o_orderdate AS DATE) AS txn_date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Uncategorized' WHEN o_orderkey % 4 = 1 THEN 'Rent'
       WHEN o_orderkey % 4 = 2 THEN 'Travel' ELSE 'Groceries' END AS category,
  CAST(o_orderdate AS TIMESTAMP) AS logged_at
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement_rows(spark, sf_dir) -> DataFrame:
    return statement_rows_from(table(spark, sf_dir, "events"))


def statement_rows_from(events: DataFrame) -> DataFrame:
    copies = F.when(F.dayofmonth("ts") >= 28, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    parts = events.withColumn("copy_no", F.explode(copies)).selectExpr("copy_no", *_columns(EVENT_PARTS))
    return parts.selectExpr(*_columns(STATEMENT_COLUMNS))


def _columns(text: str) -> list[str]:
    """Split a SELECT list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and depth == 0 and ch == ",":
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


_STORED = {}


def stored(spark, sf_dir, name, build) -> DataFrame:
    """``build()`` written once per session to the shared folder, as the layers are in real use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_folder(spark, name)
        build().write.options(**STORED_AS).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def bronze(spark, sf_dir) -> DataFrame:
    at = F.lit(INGESTED_AT).cast("timestamp")
    return stored(spark, sf_dir, "bronze", lambda: ingest.stamp_batch(statement_rows_from(dealt_events(spark, sf_dir)), BATCH_ID, at))


def dealt_events(spark, sf_dir) -> DataFrame:
    """The events in even parts, as many as keep what a task sorts the same at any size; dealt before a row is made of them."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.repartition(max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_PART)))


def cleaned(spark, sf_dir) -> DataFrame:
    return clean_rows(bronze(spark, sf_dir))


def valid(spark, sf_dir) -> DataFrame:
    return split_valid(cleaned(spark, sf_dir))[0]


def silver(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "silver", lambda: silver_rows(bronze(spark, sf_dir)))


def manual_form(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_columns(MANUAL_COLUMNS))


def manual(spark, sf_dir) -> DataFrame:
    return stored(
        spark, sf_dir, "manual",
        lambda: man.log_entries(manual_form(spark, sf_dir), F.lit(AS_OF).cast("date")),
    )


def cache(spark, sf_dir) -> DataFrame:
    """An earlier run had seen the CSV uploads."""
    return silver(spark, sf_dir).filter("source_type = 'CSV'").select(
        "txn_key_hash", F.lit("Shopping").alias("category"), F.lit("model").alias("origin")
    )


def gold_plan(spark, sf_dir) -> DataFrame:
    return categorized_gold(silver(spark, sf_dir), manual(spark, sf_dir), cache(spark, sf_dir))


def gold(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "gold", lambda: gold_plan(spark, sf_dir))


def documents(spark, sf_dir) -> DataFrame:
    return ix.index_documents(gold(spark, sf_dir))


def index_plan(spark, sf_dir) -> DataFrame:
    return ix.embed(documents(spark, sf_dir), "document")


def index(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "index", lambda: index_plan(spark, sf_dir))


def previous_documents(spark, sf_dir) -> DataFrame:
    """An index from before the cache and the manual entries, with rows since quarantined."""
    rows = silver(spark, sf_dir).withColumn(
        "category", cat.rule_category(F.col("description"), F.col("amount"))
    )
    stale = split_valid(cleaned(spark, sf_dir))[1].select(
        F.concat(F.col("row_hash"), F.lit("-old")).alias("id"),
        F.lit("old").alias("document"),
        F.lit("old").alias("document_hash"),
        F.lit(None).cast(documents(spark, sf_dir).schema["metadata"].dataType).alias("metadata"),
    )
    return ix.index_documents(rows).unionByName(stale)


def batched(spark, sf_dir) -> DataFrame:
    """Stored, as an answer is made, checked and matched against the same batches."""
    rows = silver(spark, sf_dir).select("txn_key_hash", "description", "amount")
    return stored(spark, sf_dir, "batched", lambda: assign_batches(rows, shard_digits(rows.count())))


# One raw response per batch and attempt; what is wrong with it depends on batch and attempt.
RESPONSE_KIND = (
    "(instr('0123456789abcdef', substr(batch_id, 1, 1)) + CAST(split_part(batch_id, '-', 2) AS INT)"
    " + attempt) % 13"
)
RESPONSE_RAW = """
  CASE kind
    WHEN 0 THEN '{"results":[' || items || ']}'
    WHEN 1 THEN 'Sure, here are the categories.'
    WHEN 2 THEN '{"results":[{"id":"0","category":"Other"}]}'
    WHEN 3 THEN '{"results":[{"id":0}]}'
    WHEN 4 THEN '[' || items || ']'
    WHEN 5 THEN '{"results":{"id":0}}'
    WHEN 6 THEN '{"results":[' || items || ',{"id":99,"category":"Other"}]}'
    WHEN 7 THEN '{"results":[]}'
    WHEN 8 THEN '{"results":[' || items || ',{"id":0,"category":null}]}'
    WHEN 9 THEN '{"results":[' || items || ',{"id":0,"category":"Pets"}]}'
    WHEN 10 THEN NULL
    WHEN 11 THEN '{"results":[' || items || ',{"id":0,"category":"Other"}]}'
    ELSE '{"results":[' || items || ']} Done.' END AS raw
"""


def responses(spark, sf_dir) -> DataFrame:
    item = F.concat(
        F.lit('{"id":'), F.col("local_id").cast("string"), F.lit(',"category":"'),
        cat.rule_category(F.col("description"), F.col("amount")), F.lit('"}'),
    )
    lines = F.array_sort(F.collect_list(F.struct("local_id", item.alias("item"))))
    per_batch = batched(spark, sf_dir).groupBy("batch_id").agg(
        F.array_join(F.transform(lines, lambda x: x["item"]), ",").alias("items")
    )
    return stored(spark, sf_dir, "responses", lambda: (
        per_batch.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("kind", F.expr(RESPONSE_KIND))
        .selectExpr("batch_id", "attempt", RESPONSE_RAW)
    ))


def payloads(spark, sf_dir) -> DataFrame:
    return request_payloads(batched(spark, sf_dir))


def table_rows(spark, sf_dir) -> DataFrame:
    """Extracted cells of the PDF rows: after each row a repeated header, a blank row, a short
    row, a long row, and a cell holding a line break, by row number."""
    rows = statement_rows(spark, sf_dir).filter("source_type = 'PDF'")
    return rows.selectExpr(
        "source_file",
        "CAST(source_page AS INT) AS page",
        "0 AS table_no",
        "CAST(source_row_index AS INT) AS row_index",
        f"{CELLS.format(arr='array')} AS cells",
    )


# {arr} is the array constructor of the engine
CELLS = """
  CASE CAST(source_row_index AS INT) % 26
    WHEN 0 THEN {arr}(' DATE ', 'Description', 'debit', 'CREDIT', 'Balance')
    WHEN 2 THEN {arr}('', '  ', NULL, '', NULL)
    WHEN 4 THEN {arr}(transaction_date_raw, description_raw, debit_raw)
    WHEN 6 THEN {arr}(transaction_date_raw, description_raw, debit_raw, credit_raw, balance_raw, 'x', 'y')
    WHEN 8 THEN {arr}('date', 'Date', 'balance', NULL, '')
    WHEN 10 THEN NULL
    ELSE {arr}(transaction_date_raw, 'line' || chr(10) || description_raw, debit_raw, credit_raw, balance_raw) END"""


def headers(spark, sf_dir) -> DataFrame:
    """Header rows of every uploaded file; spelling and order depend on the file's name."""
    files = statement_rows(spark, sf_dir).select("source_file").distinct()
    listed = files.selectExpr("source_file AS file", f"{HEADER_LISTS.format(arr='array')} AS headers")
    return listed.select("file", F.posexplode("headers").alias("pos", "header"))


HEADER_LISTS = """
  CASE length(source_file) % 4
    WHEN 0 THEN {arr}('Date', 'Description', 'Debit', 'Credit', 'Balance')
    WHEN 1 THEN {arr}(' Txn Date ', 'NARRATION', 'Withdrawal', 'Deposit', 'Closing Balance', 'Branch')
    WHEN 2 THEN {arr}('Value Date', 'Txn Date', 'Remarks', 'Dr', 'Cr', 'Details')
    ELSE {arr}('Particulars', 'Debit Amount', 'Mode') END"""


def questions(spark, sf_dir) -> DataFrame:
    """Every user turn, plus a blank question per conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").selectExpr(
        "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS query_id", "text AS question"
    )
    blanks = turns.selectExpr("CAST(conv_id AS STRING) || '-blank' AS query_id", "'  ' AS question").distinct()
    return asked.unionByName(blanks)


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", "label")


def account_moves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS account",
        "CAST(o_orderdate AS DATE) AS d",
        "o_orderkey AS seq",
        "CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount",
    )


def opening_balances(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS account", "CAST(c_acctbal AS DECIMAL(18,2)) AS opening"
    )
