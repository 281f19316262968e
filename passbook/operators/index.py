"""Index rows: rendering, embedding, and keeping an index in step with Gold."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook import functions as fn

HASHED_DIMS = 64
# texts that are embedded at once, however many a batch holds
TEXTS_AT_ONCE = 2_048


def index_documents(gold: DataFrame, keep=()) -> DataFrame:
    """One document per Gold row: id, document, document_hash, metadata, plus the columns named in ``keep``."""
    text = fn.render_document(
        F.col("txn_date"),
        F.col("amount"),
        F.col("description"),
        F.col("category"),
        F.col("source_type"),
    )
    metadata = F.struct(
        fn.iso_day(F.col("txn_date")).alias("txn_date"),
        F.col("category").alias("category"),
        F.col("amount").cast("double").alias("amount"),
        F.col("source_type").alias("source_type"),
    )
    rows = gold.select(
        F.col("txn_key_hash").alias("id"), text.alias("document"), metadata.alias("metadata"), *keep
    )
    digest = fn.document_hash(F.col("document"), F.col("metadata.amount"))
    return rows.select("id", "document", digest.alias("document_hash"), "metadata", *keep)


def hashed_embedder(dims: int = HASHED_DIMS):
    """Factory of the offline embedder: signed token counts in ``dims`` buckets, unit length.

    A token's md5 gives its bucket (first 8 hex digits) and its sign (next digit, even is plus).
    Tokens are the runs of a-z and 0-9 in the lower-cased text.
    """

    def load():
        token = re.compile(r"[a-z0-9]+|\n")

        def embed(texts: pd.Series) -> np.ndarray:
            if texts.empty:
                return np.zeros((0, dims))
            # one pass over the whole batch; a line break ends a text, its own become spaces
            lowered = texts.fillna("").str.lower().str.replace("\n", " ", regex=False)
            found = token.findall("\n".join([*lowered, ""]))
            codes, distinct = pd.factorize(np.array(found, dtype=object))
            ends = codes == np.flatnonzero(distinct == "\n")[0]
            row = np.cumsum(ends)[~ends]
            digests = [hashlib.md5(t.encode()).hexdigest() for t in distinct]
            bucket = np.array([int(h[:8], 16) % dims for h in digests], dtype=np.int64)
            sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in digests])
            seen = codes[~ends]
            counts = np.bincount(row * dims + bucket[seen], sign[seen], minlength=len(texts) * dims)
            counts = counts.reshape(len(texts), dims).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)

        return embed

    return load


def embed(df: DataFrame, text: str, load=None, out: str = "embedding") -> DataFrame:
    """Add ``out`` = unit vector of ``text``. ``load()`` runs once per task and returns the model."""
    load, at_once = load or hashed_embedder(), TEXTS_AT_ONCE

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            yield _vectors_of(model, texts, at_once)

    return df.withColumn(out, vectors(F.col(text)))


def _vectors_of(model, texts: pa.Array, at_once: int) -> pa.Array:
    parts = [texts.slice(at, at_once) for at in range(0, max(1, len(texts)), at_once)]
    matrix = np.concatenate([np.asarray(model(part.to_pandas()), dtype=np.float32) for part in parts])
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] if len(matrix) else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))


def embed_missing(df: DataFrame, text: str, load=None, out: str = "embedding") -> DataFrame:
    """``embed`` for the rows whose ``out`` is null; the model sees no other text and is not loaded without one."""
    load, at_once = load or hashed_embedder(), TEXTS_AT_ONCE

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = None
        for texts, known in batches:
            missing = known.is_null()
            if missing.true_count:
                model = model or load()
                fresh = _vectors_of(model, texts.filter(missing), at_once).cast(known.type)
                # every row's place among the known vectors, followed by the fresh ones
                place = np.arange(len(known))
                place[missing.to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(fresh))
                known = pa.concat_arrays([known, fresh]).take(pa.array(place))
            yield known

    return df.withColumn(out, vectors(F.col(text), F.col(out)))


def compare_index(previous: DataFrame, documents: DataFrame) -> DataFrame:
    """Every id of either side with its ``action``: keep, embed or drop.

    One full join of ids and hashes; texts and vectors stay where they are. A row whose hash is
    unchanged is kept as it is.
    """
    old = previous.select("id", F.col("document_hash").alias("_old_hash"))
    action = (
        F.when(F.col("document_hash").isNull(), "drop")
        .when(F.col("_old_hash") == F.col("document_hash"), "keep")
        .otherwise("embed")
    )
    return documents.select("id", "document_hash").join(old, "id", "full").withColumn("action", action).drop("_old_hash")


def sync_figures():
    """The aggregates of a comparison, for ``agg`` or ``observe``."""
    return [
        F.count_if(F.col("action") != "drop").alias("upserted"),
        F.count_if(F.col("action") == "drop").alias("removed_stale"),
        F.count_if(F.col("action") == "embed").alias("re_embedded"),
    ]


def sync_stats(compared: DataFrame) -> DataFrame:
    return compared.agg(*sync_figures())


GOLD_SHOWN = ("txn_date", "description", "amount", "category", "source_type")


def gold_side(gold: DataFrame) -> DataFrame:
    """What is sent of Gold's rows: id and ``GOLD_SHOWN``. Documents are rendered and vectors made where the rows arrive."""
    return gold.select(F.col("txn_key_hash").alias("id"), *GOLD_SHOWN)


def all_new(dealt: DataFrame, load=None) -> DataFrame:
    """The index rows of a dealt ``gold_side``, every document embedded."""
    return embed(index_documents(dealt.withColumnRenamed("id", "txn_key_hash"), keep=["bucket"]), "document", load)


def both_sides(previous: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows of the index (id, document_hash, embedding) and ``gold_side`` in one table, to be dealt together."""
    old = previous.select("id", "document_hash", "embedding", F.lit(False).alias("in_gold"))
    return old.unionByName(gold_side(gold).withColumn("in_gold", F.lit(True)), allowMissingColumns=True)


def merged(dealt: DataFrame, figures, load=None) -> DataFrame:
    """The new index rows from ``both_sides`` dealt by ``bucket``: an unchanged document keeps its vector, rows that are
    only in the index go. The sort by id needs no other shuffle. ``figures`` observes what was done."""
    same_id = Window.partitionBy("bucket", "id")
    known = F.first(F.when(~F.col("in_gold"), F.struct("document_hash", "embedding")), ignorenulls=True)
    rows = dealt.withColumns({"_known": known.over(same_id), "_stays": F.max("in_gold").over(same_id)})
    rows = index_documents(rows.withColumnRenamed("id", "txn_key_hash"), keep=["bucket", "in_gold", "_known", "_stays"])
    action = (
        F.when(~F.col("in_gold"), F.when(~F.col("_stays"), "drop"))
        .when(F.col("_known.document_hash") == F.col("document_hash"), "keep")
        .otherwise("embed")
    )
    rows = rows.withColumn("action", action).observe(figures, *sync_figures()).filter("in_gold")
    vector = F.when(F.col("action") == "keep", F.col("_known.embedding"))
    rows = rows.select("id", "document", "document_hash", "metadata", "bucket", vector.alias("embedding"))
    return embed_missing(rows, "document", load)


def stale_ids(previous: DataFrame, documents: DataFrame) -> DataFrame:
    return previous.select("id").join(documents.select("id"), "id", "left_anti")


def upsert(previous: DataFrame, rows: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Replace rows with the same id, keep the others, add the new ones.

    ``changed`` names the ids that change where ``rows`` are dear to compute or some ids just go.
    """
    ids = (rows if changed is None else changed).select("id")
    return previous.join(ids, "id", "left_anti").unionByName(rows)


def index_size(index: DataFrame) -> DataFrame:
    return index.agg(F.count("id").alias("indexed"))
