"""The corpus pipeline on a table with known copies, leaks and personal data."""

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n)) + "."
    items = [(i, sentence(25)) for i in range(5)]
    rows = [(i, sentence(120)) for i in range(60)]
    near = rows[7][1].split()
    near[50] = "changed"
    rows += [(100, rows[5][1]), (101, " ".join(near)), (102, sentence(40) + " " + items[2][1] + " " + sentence(40)), (103, rows[9][1] + " mail jo.do@mail.example.org now")]
    rows += [(200 + i, " ".join(f"{w}&&&" for w in sentence(80).split())) for i in range(30)]
    folder = tmp_path_factory.mktemp("pipeline")
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows)


def test_run(spark, table):
    folder, texts = table
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = set(rows)
    assert not kept & {100, 101, 102, *range(200, 230)}
    assert len(set(range(60)) - kept) <= 1
    for i in set(range(60)) & kept:
        assert rows[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
    masked = texts[103].replace("jo.do@mail.example.org", "<EMAIL>")
    assert 103 not in kept or rows[103].decoded_sha256 == hashlib.sha256(masked.encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, table, tmp_path):
    folder, _ = table
    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
