"""Index, search, prompts, streams."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from passbook import functions as fn
from passbook.operators import context as ctx
from passbook.operators import index as ix
from passbook.operators import search as se
from passbook.plans import ask as plan
from passbook.plans.workspace import Workspace
from passbook.scratch import scratch_folder

K = 15


@query("B13_render_document", "SELECT id, txt AS document FROM docs", ["docs"])
def _(spark, sf):
    return fx.documents(spark, sf).select("id", "document")


@query("B14_index_metadata", "SELECT id, strftime(txn_date, '%Y-%m-%d') AS txn_date, category, amount, source_type FROM docs", ["docs"])
def _(spark, sf):
    return fx.documents(spark, sf).select("id", "metadata.*")


@query(
    "B20_l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared_norm, round(v[1], 6) + 0.0 AS first_value FROM (
       SELECT vec_id, list_transform(e, lambda x: x / n) AS v FROM (
         SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))""",
)
def _(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("vec_id", fn.l2_normalize(F.col("embedding")).alias("v"))
    return v.select(
        "vec_id", F.round(fn.dot(F.col("v"), F.col("v")), 6).alias("squared_norm"), (F.round(F.col("v")[0], 6) + 0.0).alias("first_value")
    )


@query(
    "I6_embed",
    """SELECT id, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS BIGINT) AS non_zero,
         round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(range(1, 65) AS DOUBLE[])), 5) + 0.0 AS weighted FROM vecs""",
    ["vecs"],
)
def _(spark, sf):
    weights = F.sequence(F.lit(1), F.lit(ix.HASHED_DIMS))
    return fx.index(spark, sf).select(
        "id",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("non_zero"),
        (F.round(fn.dot(F.col("embedding"), weights), 5) + 0.0).alias("weighted"),
    )


_STALE_SQL = "SELECT id FROM prev WHERE id NOT IN (SELECT id FROM docs)"


def _stale(spark, sf):
    return ix.stale_ids(fx.previous_documents(spark, sf), fx.documents(spark, sf))


query("D5_stale_ids", _STALE_SQL, ["prev", "docs"])(_stale)
query("H2_id_difference", _STALE_SQL, ["prev", "docs"])(_stale)


@query("D6_upsert_index", "SELECT id, txt AS document FROM docs UNION ALL SELECT id, txt FROM prev WHERE id NOT IN (SELECT id FROM docs)", ["prev", "docs"])
def _(spark, sf):
    return ix.upsert(fx.previous_documents(spark, sf), fx.documents(spark, sf)).select("id", "document")


@query(
    "E11_sync_stats",
    """SELECT (SELECT count(*) FROM docs) AS upserted, (SELECT count(*) FROM prev WHERE id NOT IN (SELECT id FROM docs)) AS removed_stale,
       (SELECT count(*) FROM docs d LEFT JOIN prev p USING (id) WHERE p.txt IS DISTINCT FROM d.txt) AS re_embedded""",
    ["prev", "docs"],
)
def _(spark, sf):
    return ix.sync_stats(ix.compare_index(fx.previous_documents(spark, sf), fx.documents(spark, sf)))


@query("E12_index_size", "SELECT count(id) AS indexed FROM docs", ["docs"])
def _(spark, sf):
    return ix.index_size(fx.documents(spark, sf))


@query("E12_indexed_ids", "SELECT id FROM docs", ["docs"])
def _(spark, sf):
    return fx.documents(spark, sf).select("id")


@query(
    "I7_sync_index",
    "SELECT d.id, txt AS document, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(range(1, 65) AS DOUBLE[])), 5) + 0.0 AS weighted FROM docs d JOIN vecs USING (id)",
    ["docs", "vecs"],
)
def _(spark, sf):
    from passbook.plans.indexing import sync_index

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    workspace.index.publish(fx.previous_documents(spark, sf), finish=lambda rows: ix.embed(rows, "document"))
    workspace.gold.publish(fx.gold(spark, sf))
    sync_index(workspace)
    weights = F.sequence(F.lit(1), F.lit(ix.HASHED_DIMS))
    return workspace.index.read().select("id", "document", (F.round(fn.dot(F.col("embedding"), weights), 5) + 0.0).alias("weighted"))


def _topk_sql(k, where="TRUE"):
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, id, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
        SELECT q.vec_id AS query_id, i.vec_id AS id,
          round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) + 0.0 AS distance
        FROM embeddings q, (SELECT * FROM embeddings WHERE {where}) i)) WHERE rank <= {k}"""


def _vector_queries(spark, sf):
    return fx.vectors(spark, sf).select(F.col("id").alias("query_id"), "embedding")


def _similar(spark, sf):
    return se.similarity_topk(_vector_queries(spark, sf), fx.vectors(spark, sf), K)


query("D8_similarity_join", _topk_sql(K))(_similar)
query("F3_topk_per_query", _topk_sql(K))(_similar)


@query("G3_semantic_topk", _topk_sql(plan.STORE_K))
def _(spark, sf):
    """The same answer from the grouped plan used for many queries."""
    return se.similarity_topk(
        _vector_queries(spark, sf), fx.vectors(spark, sf), plan.STORE_K,
        travelling=0, rows_per_anchor=100, tiles=(128, 128),
    )


@query("C9_metadata_filter", _topk_sql(K, "label = 3"))
def _(spark, sf):
    return se.similarity_topk(_vector_queries(spark, sf), fx.vectors(spark, sf), K, where=F.col("label") == 3)


RECALL = 0.95


def _approximate(spark, sf):
    return se.similarity_topk(_vector_queries(spark, sf), fx.vectors(spark, sf), K, recall=RECALL, rows_per_anchor=100)


query("I8_approximate_search")(_approximate)


@query("I8_approximate_recall", "SELECT TRUE AS reaches_target")
def _(spark, sf):
    """The approximate answer against that of the exact scan, over all queries."""
    exact = _similar(spark, sf).select("query_id", "id")
    found = exact.join(_approximate(spark, sf).select("query_id", "id"), ["query_id", "id"])
    return found.agg(F.count(F.lit(1)).alias("found")).crossJoin(exact.agg(F.count(F.lit(1)).alias("all"))).select(
        (F.col("found") >= RECALL * F.col("all")).alias("reaches_target")
    )


def _hits(spark, sf):
    return plan.semantic_search(fx.questions(spark, sf), fx.index(spark, sf), K).withColumn("category", F.col("metadata.category"))


@query("I8_semantic_search", "SELECT query_id, CAST(rank AS INT) AS rank, id, distance, document, category FROM hits", ["hits"])
def _(spark, sf):
    return _hits(spark, sf).select("query_id", "rank", "id", "distance", "document", "category")


_LINE = """'- ' || document || ' [category: ' || coalesce(category, 'Unknown') || ', relevance: ' || format('{:.2f}', 1.0 - distance) || ']'"""


@query("B18_relevance", f"SELECT query_id, CAST(rank AS INT) AS rank, {_LINE} AS line FROM hits", ["hits"])
def _(spark, sf):
    line = ctx.evidence_line(F.col("document"), F.col("category"), F.col("distance"))
    return _hits(spark, sf).select("query_id", "rank", line.alias("line"))


_CONTEXT = f"SELECT query_id, string_agg({_LINE}, chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id"


@query("E13_context_concat", _CONTEXT, ["hits"])
def _(spark, sf):
    return ctx.context_per_question(_hits(spark, sf))


_MESSAGE = f"""CASE WHEN txt = '' THEN '{ctx.BLANK_QUESTION}' WHEN context IS NULL THEN '{ctx.NO_EVIDENCE.replace("'", "''")}' END"""


@query("C10_question_guard", f"SELECT id AS query_id, coalesce({_MESSAGE}, '') AS message FROM asked LEFT JOIN ({_CONTEXT}) c ON c.query_id = id", ["asked", "hits"])
def _(spark, sf):
    prompts = plan.prompts_for(fx.questions(spark, sf), fx.index(spark, sf), K)
    return prompts.select("query_id", F.coalesce("message", F.lit("")).alias("message"))


@query(
    "I9_build_prompts",
    f"""SELECT id AS query_id, CASE WHEN txt <> '' AND context IS NOT NULL THEN
          'Relevant transactions:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || txt END AS prompt
        FROM asked LEFT JOIN ({_CONTEXT}) c ON c.query_id = id""",
    ["asked", "hits"],
)
def _(spark, sf):
    return plan.prompts_for(fx.questions(spark, sf), fx.index(spark, sf), K).select("query_id", "prompt")


def _ask(spark, sf):
    return plan.ask(fx.questions(spark, sf), fx.index(spark, sf), K)


_ANSWER_SQL = f"SELECT id AS query_id, coalesce({_MESSAGE}, context) AS answer FROM asked LEFT JOIN ({_CONTEXT}) c ON c.query_id = id"

query("I10_answer", _ANSWER_SQL, ["asked", "hits"])(_ask)
query("K7_ask", _ANSWER_SQL, ["asked", "hits"])(_ask)


def _event_stream(spark, sf):
    """The events file as a stream, shaped into statement rows."""
    from passbook.plans.ingest import stamp_batch

    schema = fx.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    at = F.lit(fx.INGESTED_AT).cast("timestamp")
    return stamp_batch(fx.statement_rows_from(events), fx.BATCH_ID, at)


@query("J1_bronze_stream", "SELECT count(*) AS row_count, count(*) AS distinct_rows FROM fx WHERE source_type = 'CSV'", ["fx"])
def _(spark, sf):
    from checks.landing import landing_folder
    from passbook.streaming.streams import bronze_stream

    workspace = Workspace(spark, scratch_folder(spark, "workspace"))
    state = scratch_folder(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        bronze_stream(workspace, landing_folder(spark, sf), state).awaitTermination()
    return workspace.bronze.read().agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("row_hash").alias("distinct_rows")
    )


@query("J2_silver_stream", "SELECT row_hash, txn_key_hash, quarantine_reason FROM cleaned", ["cleaned"])
def _(spark, sf):
    from passbook.streaming.streams import silver_stream

    out = scratch_folder(spark, "stream")
    silver_stream(_event_stream(spark, sf), f"{out}/valid", f"{out}/bad", f"{out}/state").awaitTermination()
    names = ["row_hash", "txn_key_hash", "quarantine_reason"]
    return spark.read.parquet(f"{out}/valid").select(names).unionByName(spark.read.parquet(f"{out}/bad").select(names))


@query("J3_dedupe_stream", "SELECT txn_key_hash FROM silver", ["silver"])
def _(spark, sf):
    from passbook.operators.quality import clean_rows, split_valid
    from passbook.streaming.streams import start_dedupe

    out = scratch_folder(spark, "stream")
    valid, _ = split_valid(clean_rows(_event_stream(spark, sf)))
    start_dedupe(valid, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("txn_key_hash")
