"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passbook.llm import ann, bpe, chat, decontaminate, pii, quality, simhash, token_blocks, toxicity, urls
from passbook.scratch import scratch_folder
from tests.llm.conftest import TEXTS, documents

ALL_ROWS = len(TEXTS) + 2


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.fixture(scope="module")
def tagger():
    text = "write to jo.doe@mail.example.com or +1 (212) 555-7812 today"
    return pii.Tagger().fit([(text, pii.base_spans(text)), ("nothing 12 here", [])], steps=5)


def test_quality(edge_docs, no_docs, edge_labels, no_labels):
    model = quality.ByteCNN().fit([b"good text here", b"*** !!! ###"], np.array([1, 0]), steps=10)
    rows = by_id(quality.score_documents(edge_docs, model))
    assert sum(map(len, rows.values())) == ALL_ROWS
    assert all(0 <= r.score <= 1 for rs in rows.values() for r in rs)
    assert rows[0][0].score == rows[1][0].score and rows[5][0].score == rows[6][0].score
    assert quality.keep_good(edge_docs, model, 0.0).columns == edge_docs.columns
    assert quality.keep_good(edge_docs, model, 0.0).count() == ALL_ROWS
    assert quality.score_documents(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0
    blank = quality.train(edge_docs, no_labels, quality.training_rows())
    assert blank.prior == 0.5
    assert quality.train(no_docs, edge_labels, quality.training_rows()).prior == 0.5


def test_toxicity(edge_docs, no_docs, edge_labels, no_labels):
    lexicon = toxicity.train(edge_docs, no_labels, F.lit(True))
    assert {r.score for rs in by_id(toxicity.score_documents(edge_docs, lexicon)).values() for r in rs} == {float(lexicon.scores([""])[0])}
    lexicon = toxicity.train(edge_docs, edge_labels, F.lit(True))
    assert toxicity.score_documents(edge_docs, lexicon).count() == ALL_ROWS
    assert toxicity.score_documents(no_docs, lexicon).count() == 0


def test_pii(edge_docs, no_docs, tagger):
    rows = by_id(pii.find_spans(edge_docs, tagger))
    assert sum(map(len, rows.values())) == ALL_ROWS
    assert [s.kind for s in rows[9][0].base] == ["email", "phone", "ip", "card"]
    assert not rows[0][0].base and not rows[1][0].spans
    assert all(set(r.base) <= set(r.spans) for rs in rows.values() for r in rs)
    masked = pii.mask(edge_docs, tagger)
    assert masked.columns == edge_docs.columns
    kept = by_id(masked)
    assert kept[0][0].text is None and kept[9][0].text == "mail <EMAIL> or call <PHONE> from <IP> with <CARD>"
    assert kept[9][0].n_chars == len(kept[9][0].text)
    assert pii.find_spans(no_docs, tagger).count() == 0 and pii.mask(no_docs, tagger).count() == 0
    assert not pii.train(no_docs).trained


def test_decontamination(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the SAME text -- twice"), (2, None), (3, ""), (1, "the same text twice"), (None, "one")], "item_id bigint, text string")
    rows = by_id(decontaminate.leaks(edge_docs, items))
    assert {r.item_id for r in rows[5]} == {1} and len(rows[5]) == 2 and {r.item_id for r in rows[4]} == {None}
    assert set(rows) == {4, 5, 6, 7}
    left = decontaminate.drop_leaked(edge_docs, items)
    assert left.columns == edge_docs.columns and left.count() == ALL_ROWS - 4
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(edge_docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaked(edge_docs, items.limit(0)).count() == ALL_ROWS


def test_simhash(edge_docs, no_docs):
    rows = by_id(simhash.groups(simhash.fingerprints(edge_docs)))
    assert sum(map(len, rows.values())) == ALL_ROWS
    assert rows[0][0].fingerprint == rows[1][0].fingerprint == rows[3][0].fingerprint == 0
    assert {rows[i][0].component_id for i in (0, 1, 2, 3)} == {0}
    assert rows[5][0].component_id == rows[6][0].component_id == 5 and rows[None][0].component_id is None
    assert simhash.groups(simhash.fingerprints(no_docs)).count() == 0
    kept = simhash.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 0 in ids and not {1, 2, 3, 6} & set(ids)
    assert simhash.drop_near_copies(no_docs).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    docs = documents(spark, [(7, "alpha beta gamma delta"), (7, "completely other words here"), (2, "completely other words here")])
    rows = by_id(simhash.groups(simhash.fingerprints(docs)))
    assert {r.component_id for rs in rows.values() for r in rs} == {2}
    assert [r.doc_id for r in simhash.drop_near_copies(docs).collect()].count(7) <= 1


def test_bpe(edge_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = by_id(bpe.encode_documents(edge_docs, path))
    assert all(bytes(r.decoded) == (TEXTS[i] or "").encode() for i, rs in rows.items() if i is not None for r in rs)
    assert rows[0][0].ids == [] and bpe.encode_documents(no_docs, path).count() == 0
    assert by_id(bpe.encode_digests(edge_docs, path))[1][0].n_tokens == 0


def test_token_blocks(spark, edge_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs, n in ((edge_docs, ALL_ROWS), (no_docs, 0)):
        folder = scratch_folder(spark, "blocks")
        token_blocks.write_ids(docs, path, folder)
        rows = token_blocks.read_ids(spark, folder).orderBy("start").collect()
        assert len(rows) == n
        if n:
            assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
            assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
            assert rows[1].ids == [2] and all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows)


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, segment string, loss string, slot string, log string"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "</s>[a]~"), (None, 0, "assistant", "x" * 100_000), (2, -5, "assistant", "né\n"), (2, 10**12, "user\n", "")]
    turns = spark.createDataFrame([(*r, "e", "e", "e", "e") for r in rows], schema)
    out = {r.conv_id: r for r in chat.read_back(chat.segments(chat.reconstruct(chat.as_events(turns)))).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 0 and out[None].loss_chars == 100_000 and out[2].n_turns == 2
    for empty in (chat.as_events(turns.limit(0)), chat.as_log(turns.limit(0))):
        assert chat.read_back(chat.segments(chat.reconstruct(empty))).count() == 0
    assert {r.conv_id: r for r in chat.read_back(chat.segments(chat.reconstruct(chat.as_log(turns)))).collect()} == out
    assert chat.render(chat.reconstruct(chat.as_events(turns.limit(0)))).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no host"), (4, "http://A.example.com/en/x?y"), (4, "http://A.example.com/en/x?y"), (5, "h://b.net/fr/"), (None, "x://q.org/" + "p/" * 50_000), (6, "http://ok.com/de/#z")]
    pages = spark.createDataFrame([(i, u, "h", "r", "v", 1.0) for i, u in rows], "page_id bigint, url string, host string, rule string, verdict string, p_block double")
    out = {}
    for r in urls.judge_urls(pages).collect():
        out.setdefault(r.page_id, []).append(r)
    assert len(out[4]) == 2 and out[4][0].verdict == "block" and out[4][0].rule == "example.com/en/" and out[6][0].verdict == "allow"
    assert (out[1][0].host, out[1][0].path, out[1][0].rule) == ("", "", None) and out[1][0].verdict in ("allow", "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0
    only = urls.judge_urls(pages.where("page_id = 1")).collect()
    assert [r.verdict for r in only] == ["allow"]


def test_ann(spark):
    schema = "vec_id bigint, embedding array<float>, part int, block int, score double, label string"
    good = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(40)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (120, [1.0]), (None, [1.0, 1.0, 1.0]), (3, [4.0, 0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, 1, 1.0, "x") for r in good + bad], schema)
    rows = ann.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {0, 20}
    x = {i: np.array(v) for i, v in good}
    sound = [*good, (3, [4.0, 0.0, 1.0])]  # a repeated id is a row of its own
    for q in (0, 20):
        want = sorted((-float(x[q] @ np.array(v)), i) for i, v in sound if i != q)[:20]
        assert [(r.vec_id, r["rank"]) for r in rows if r.query_id == q] == [(i, k + 1) for k, (_, i) in enumerate(want)]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(ann.search(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()) == 2
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.1]), (1, [5.0, 0.0])], "vec_id bigint, embedding array<double>")
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(twice, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(rows) == [(0, 1, 1, 0.2), (0, 1, 1, 5.0), (0, 2, 0, 0.0), (0, 2, 1, 1.0), (0, 3, 0, 0.0), (0, 3, 1, 0.0)]


def test_letters_of_bytes():
    """Every piece becomes the letters of its own bytes, whatever stands beside it."""
    from passbook.llm import token_blocks as tb

    pieces = ["", " a", "\n", "\x00\xff", "naïve", "€ 5", "\ud800", "\x7f\x85\xa0\xad", "", " \n\t", "".join(map(chr, range(300)))]
    one = lambda p: p.encode("utf-8", "replace").decode("latin-1").translate(tb.BYTE_LETTERS)
    assert tb.in_letters(pieces) == [one(p) for p in pieces]
    assert tb.in_letters([]) == [] and tb.in_letters([""]) == [""]
