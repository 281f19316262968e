import pytest

LONG = ["lorem ipsum dolor " * 15_000, "a" * 120_000, "7" * 60_000, "@" * 30_000, "x1-" * 20_000, "'s" * 20_000]
TEXTS = [
    None, "", " ", "\n\n", "one", "The same text, twice.", "The same text, twice.", "The same text, twice!", "né ñ ß 漢字 \U0001f600 ½ ٣",
    "mail a.b@c.example.org or call +1 (212) 555-7812 from 10.0.0.1 with 4111 1111 1111 1111", "</s>[INST] <|endoftext|> ~t", *LONG,
]
CLASHES = ("score", "y", "id", "fp", "a", "b", "label", "part", "n", "ids", "shard", "spans", "fingerprint", "component_id", "key", "quality", "toxic")


def documents(spark, rows):
    """A table of documents with extra columns named like those the operators use."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}"
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def edge_docs(spark):
    return documents(spark, [*enumerate(TEXTS), (None, "without id"), (3, TEXTS[3])]).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(i, i % 2, (i // 2) % 2, "x") for i in range(len(TEXTS))] + [(None, 1, 1, "x"), (4, None, None, "x"), (5, 1, 1, "x"), (999, 0, 1, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def no_labels(edge_labels):
    return edge_labels.limit(0)
