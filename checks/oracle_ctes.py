"""Common table expressions the oracle statements share, in DuckDB SQL."""

from checks import fixtures as fx

_AMOUNT = (
    "try_cast(nullif(regexp_replace(trim(regexp_replace(trim({c}),'(?i)(rs\\.?|inr|₹)','','g')),"
    "'[^0-9.\\-]','','g'),'') AS DOUBLE)"
)

_DATE = """CAST(coalesce(
    CASE WHEN regexp_full_match(x,'[0-9]{2}-[0-9]{2}-[0-9]{4}') THEN try_strptime(x,'%d-%m-%Y') END,
    CASE WHEN regexp_full_match(x,'[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(x,'%Y-%m-%d') END,
    CASE WHEN regexp_full_match(x,'[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN try_strptime(x,'%d/%m/%Y') END,
    CASE WHEN regexp_full_match(x,'[0-9]{4}/[0-9]{2}/[0-9]{2}') THEN try_strptime(x,'%Y/%m/%d') END,
    CASE WHEN regexp_full_match(x,'[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN try_strptime(x,'%m/%d/%Y') END,
    CASE WHEN regexp_full_match(x,'[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}') THEN try_strptime(x,'%d-%m-%Y') END,
    CASE WHEN regexp_full_match(x,'[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN try_strptime(x,'%d/%m/%Y') END) AS DATE)"""

RULE = """CASE WHEN amount > 0 THEN 'Income'
       WHEN contains(upper(description), 'SWIGGY') OR contains(upper(description), 'ZOMATO') THEN 'Food & Dining'
       WHEN contains(upper(description), 'BIGBASKET') OR contains(upper(description), 'GROCERIES') THEN 'Groceries'
       WHEN contains(upper(description), 'UBER') THEN 'Transport'
       WHEN contains(upper(description), 'AMAZON') OR contains(upper(description), 'FLIPKART') THEN 'Shopping'
       WHEN contains(upper(description), 'ELECTRICITY BILL') OR contains(upper(description), 'JIO PREPAID') THEN 'Bills & Utilities'
       WHEN contains(upper(description), 'RENT PAYMENT') THEN 'Rent'
       WHEN contains(upper(description), 'NETFLIX') THEN 'Entertainment'
       WHEN contains(upper(description), 'IRCTC') THEN 'Travel'
       WHEN contains(upper(description), 'ATM WDL') THEN 'Other'
       ELSE 'Uncategorized' END"""

DOCUMENT = """'On ' || strftime(txn_date,'%Y-%m-%d') || ', '
       || CASE WHEN amount > 0 THEN 'received' ELSE 'spent' END || ' Rs ' || format('{:.2f}', abs(amount))
       || ' (' || description || '), category: ' || category || ', source: ' || source_type || '.'"""

# tokens -> signed counts in 64 buckets -> unit vector as FLOAT
_EMBED = """
  SELECT id, list(v ORDER BY b) AS embedding FROM (
    SELECT g.id, g.b, CAST(CASE WHEN n.norm > 0 THEN coalesce(c.c, 0) / n.norm ELSE 0 END AS FLOAT) AS v
    FROM (SELECT id, unnest(range(64)) AS b FROM {src}) g
    LEFT JOIN {src}_counts c ON c.id = g.id AND c.b = g.b
    LEFT JOIN (SELECT id, sqrt(sum(c * c)) AS norm FROM {src}_counts GROUP BY id) n ON n.id = g.id
  ) GROUP BY id"""
_COUNTS = """
  SELECT id, b, CAST(sum(s) AS DOUBLE) AS c FROM (
    SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b,
           CASE WHEN contains('02468ace', substr(md5(t), 9, 1)) THEN 1 ELSE -1 END AS s
    FROM (SELECT id, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS t FROM {src})
  ) GROUP BY id, b"""


def _hash(parts):
    return "sha256(concat_ws('||', " + ", ".join(f"coalesce({p}, '')" for p in parts) + "))"


ROW_HASH = _hash(
    ["source_file", "source_page", "source_row_index", "transaction_date_raw", "description_raw", "debit_raw", "credit_raw"]
)
TXN_KEY = _hash(
    ["strftime(txn_date,'%Y-%m-%d')", "format('{:,.2f}',amount)", "description", "format('{:,.2f}',balance_amount)"]
)
_ARR = "list_value"

CTES = {
    "fx": (
        [],
        f"SELECT {fx.STATEMENT_COLUMNS} FROM (SELECT *, unnest(CASE WHEN dd >= '28' THEN [0, 1] ELSE [0] END)"
        f" AS copy_no FROM (SELECT {fx.EVENT_PARTS} FROM events))",
    ),
    "cleaned": (
        ["fx"],
        f"""SELECT *, {TXN_KEY} AS txn_key_hash, {ROW_HASH} AS row_hash,
          nullif(concat_ws(',', CASE WHEN txn_date IS NULL THEN 'unparseable_date' END,
             CASE WHEN amount IS NULL THEN 'missing_amount' END,
             CASE WHEN description IS NULL THEN 'missing_description' END),'') AS quarantine_reason
          FROM (SELECT *, coalesce(credit_amount, -debit_amount) AS amount FROM (
            SELECT *, {_DATE} AS txn_date, {_AMOUNT.format(c='debit_raw')} AS debit_amount,
              {_AMOUNT.format(c='credit_raw')} AS credit_amount, {_AMOUNT.format(c='balance_raw')} AS balance_amount,
              nullif(trim(regexp_replace(description_raw,'\\s+',' ','g')),'') AS description
            FROM (SELECT *, trim(transaction_date_raw) AS x FROM fx)))""",
    ),
    "silver": (
        ["cleaned"],
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY txn_key_hash ORDER BY
             source_file NULLS FIRST, source_page NULLS FIRST, source_row_index NULLS FIRST,
             transaction_date_raw NULLS FIRST, description_raw NULLS FIRST, debit_raw NULLS FIRST,
             credit_raw NULLS FIRST, balance_raw NULLS FIRST) AS rn
           FROM cleaned WHERE quarantine_reason IS NULL) WHERE rn = 1""",
    ),
    "form": ([], f"SELECT {fx.MANUAL_COLUMNS} FROM orders"),
    "judged": (
        ["form"],
        f"""SELECT *, concat_ws(',', CASE WHEN amount IS NULL OR amount <= 0 THEN 'amount_not_positive' END,
             CASE WHEN trim(merchant) = '' THEN 'merchant_blank' END,
             CASE WHEN txn_date > DATE '{fx.AS_OF}' THEN 'date_in_future' END) AS errors FROM form""",
    ),
    "manual": (
        ["judged"],
        """SELECT entry_id, CAST(CASE WHEN direction LIKE 'Expense%' THEN -amount ELSE amount END AS DOUBLE) AS amount,
             trim(merchant) AS merchant, txn_date, category, logged_at,
             sha256('manual::' || entry_id) AS txn_key_hash FROM judged WHERE errors = ''""",
    ),
    "combined": (
        ["silver", "manual"],
        """SELECT txn_key_hash, txn_date, description, amount, source_type, source_file, NULL AS chosen FROM silver
           UNION ALL SELECT txn_key_hash, txn_date, merchant, amount, 'MANUAL', 'manual_entry',
             CASE WHEN category <> 'Uncategorized' THEN category END FROM manual""",
    ),
    "cache": (
        ["silver"],
        "SELECT txn_key_hash, 'Shopping' AS category, 'model' AS origin FROM silver WHERE source_type = 'CSV'",
    ),
    "gold": (
        ["combined", "cache"],
        f"""SELECT txn_key_hash, txn_date, description, amount, source_type, source_file,
             coalesce(chosen, cached, {RULE}) AS category
           FROM (SELECT c.*, k.category AS cached FROM combined c LEFT JOIN cache k USING (txn_key_hash))""",
    ),
    "docs": (["gold"], f"SELECT txn_key_hash AS id, {DOCUMENT} AS txt, category, source_type, txn_date, amount FROM gold"),
    "docs_counts": (["docs"], _COUNTS.format(src="docs")),
    "vecs": (["docs_counts"], _EMBED.format(src="docs")),
    "prev": (
        ["cleaned", "silver"],
        f"""SELECT txn_key_hash AS id, {DOCUMENT} AS txt FROM (SELECT *, {RULE} AS category FROM silver)
           UNION ALL SELECT row_hash || '-old', 'old' FROM cleaned WHERE quarantine_reason IS NOT NULL""",
    ),
    "asked": (
        [],
        """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
             regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS txt FROM conversations WHERE role = 'user'
           UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR) || '-blank', '' FROM conversations""",
    ),
    "q": (["asked"], "SELECT id, txt FROM asked WHERE txt <> ''"),
    "q_counts": (["q"], _COUNTS.format(src="q")),
    "qvecs": (["q_counts"], _EMBED.format(src="q")),
    "hits": (
        ["vecs", "qvecs", "docs"],
        """SELECT query_id, rank, h.id, distance, txt AS document, category FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
               SELECT query_id, id,
                 round(1 - CASE WHEN isnan(s) THEN 0 ELSE s END, 6) + 0.0 AS distance FROM (
                 SELECT q.id AS query_id, d.id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS s
                 FROM qvecs q, vecs d))) h JOIN docs USING (id) WHERE rank <= 15""",
    ),
    "batched": (
        ["silver"],
        """SELECT txn_key_hash, description, amount, shard || '-' || CAST((place // 25) AS VARCHAR) AS batch_id,
             place % 25 AS local_id FROM (
             SELECT *, row_number() OVER (PARTITION BY shard ORDER BY txn_key_hash) - 1 AS place FROM (
               SELECT *, substr(txn_key_hash, 1, CASE WHEN n <= 1600000 THEN 1 WHEN n <= 25600000 THEN 2 ELSE 3 END) AS shard
               FROM silver, (SELECT count(*) AS n FROM silver)))""",
    ),
    "sizes": (["batched"], "SELECT batch_id, count(*) AS n_rows FROM batched GROUP BY batch_id"),
    "responses": (
        ["batched"],
        f"""SELECT batch_id, attempt, {fx.RESPONSE_RAW} FROM (SELECT *, {fx.RESPONSE_KIND} AS kind FROM (
             SELECT batch_id, items, unnest([1, 2, 3]) AS attempt FROM (
               SELECT batch_id, string_agg('{{"id":' || CAST(local_id AS VARCHAR) || ',"category":"' || {RULE} || '"}}', ','
                 ORDER BY local_id) AS items FROM batched GROUP BY batch_id)))""",
    ),
    "parsed": (
        ["responses"],
        """SELECT batch_id, attempt, CASE WHEN regexp_matches(raw, '\\}\\s*$') AND json_valid(raw) THEN CAST(raw AS JSON) END AS j
           FROM responses""",
    ),
    "items": (
        ["parsed"],
        """SELECT batch_id, attempt, pos, json_extract(j, '$.results[' || CAST(pos AS VARCHAR) || ']') AS item FROM (
             SELECT batch_id, attempt, j, unnest(range(CAST(json_array_length(j, '$.results') AS BIGINT))) AS pos FROM parsed
             WHERE json_type(j, '$.results') = 'ARRAY')""",
    ),
    "read_items": (
        ["items", "sizes"],
        """SELECT *, (json_type(item, '$.id') IS NULL OR json_type(item, '$.category') IS NULL) AS malformed,
             NOT coalesce(local_id BETWEEN 0 AND n_rows - 1, FALSE) AS unknown FROM (
             SELECT i.*, n_rows, CASE WHEN json_type(item, '$.id') IN ('BIGINT', 'UBIGINT')
               THEN CAST(json_extract_string(item, '$.id') AS BIGINT) END AS local_id,
               json_extract_string(item, '$.category') AS category FROM items i JOIN sizes USING (batch_id))""",
    ),
    "verdicts": (
        ["parsed", "sizes", "read_items"],
        """SELECT batch_id, attempt, coalesce(unknown_ids, 0) AS unknown_ids,
             n_rows - coalesce(known, 0) AS missing_ids,
             CASE WHEN j IS NULL THEN 'invalid_json' WHEN coalesce(json_type(j, '$.results'), '') <> 'ARRAY' THEN 'no_results_list'
               WHEN malformed THEN 'malformed_item' WHEN unknown_ids > 0 THEN 'unknown_id'
               WHEN coalesce(known, 0) < n_rows THEN 'missing_id' END AS reason
           FROM parsed JOIN sizes USING (batch_id) LEFT JOIN (
             SELECT batch_id, attempt, bool_or(malformed) AS malformed, count(*) FILTER (unknown) AS unknown_ids,
               count(DISTINCT local_id) FILTER (NOT unknown AND NOT malformed) AS known
             FROM read_items GROUP BY batch_id, attempt) USING (batch_id, attempt)""",
    ),
    "answers": (
        ["verdicts", "read_items"],
        """SELECT batch_id, local_id, category FROM (
             SELECT r.batch_id, r.attempt, r.local_id, r.category,
               row_number() OVER (PARTITION BY r.batch_id, r.attempt, r.local_id ORDER BY pos DESC) AS rn
             FROM read_items r JOIN (SELECT batch_id, min(attempt) AS attempt FROM verdicts WHERE reason IS NULL GROUP BY batch_id)
               USING (batch_id, attempt)) WHERE rn = 1""",
    ),
    "cells": (
        ["fx"],
        f"""SELECT source_file, CAST(source_page AS INT) AS page, 0 AS table_no, CAST(source_row_index AS INT) AS row_index,
             {fx.CELLS.format(arr=_ARR)} AS cells FROM fx WHERE source_type = 'PDF'""",
    ),
    "headers": (
        ["fx"],
        f"""SELECT file, i - 1 AS pos, headers[i] AS header FROM (
             SELECT file, headers, unnest(range(1, len(headers) + 1)) AS i FROM (
               SELECT source_file AS file, {fx.HEADER_LISTS.format(arr=_ARR)} AS headers
               FROM (SELECT DISTINCT source_file FROM fx)))""",
    ),
    "claimed": (
        ["headers"],
        """SELECT file, pos, header, CASE WHEN name IS NOT NULL AND pos = min(pos) OVER (PARTITION BY file, name) THEN name END AS canonical
           FROM (SELECT *, CASE WHEN k IN ('date','txn date','transaction date','value date') THEN 'transaction_date_raw'
             WHEN k IN ('description','narration','particulars','remarks','details') THEN 'description_raw'
             WHEN k IN ('debit','withdrawal','debit amount','dr') THEN 'debit_raw'
             WHEN k IN ('credit','deposit','credit amount','cr') THEN 'credit_raw'
             WHEN k IN ('balance','closing balance','available balance') THEN 'balance_raw' END AS name
             FROM (SELECT *, lower(trim(header)) AS k FROM headers))""",
    ),
}


def with_ctes(needs, sql: str) -> str:
    order = []

    def visit(name):
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + sql
