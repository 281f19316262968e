"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from passbook.llm import bpe, decontaminate, pii, quality, simhash
from passbook.scratch import scratch_folder, written


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. It learns from the labelled rows of this stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, quality.training_rows()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies (fingerprints of op7, and five words, similarity of 0.8 or more)."""
    return simhash.drop_near_copies(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ``benchmark``."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.mask(docs, pii.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids of the text and of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_leaked),
    ("personal_data", mask_personal_data),
    ("encode", encode),
]

#: No stage after the first can be said in SQL, and the first is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
