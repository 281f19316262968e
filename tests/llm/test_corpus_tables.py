"""Spelling variants, mixing and the manifest, each against a plain restatement."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from passbook.llm import merkle, mixture, spelling
from passbook.llm.order import running
from tests.llm.conftest import documents

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def table(spark, rows):
    """(doc_id, text, source) with the columns of ``documents``."""
    made = documents(spark, [(i, t) for i, t, _ in rows])
    names = spark.createDataFrame([(n, s) for n, (_, _, s) in enumerate(rows)], "n long, source string")
    plain = spark.createDataFrame([(n, i, t) for n, (i, t, _) in enumerate(rows)], "n long, doc_id long, text string")
    return plain.join(names, "n").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit("x").alias(c) for c in made.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")])


# ---- running sums

def test_running_sums_cross_the_pieces(spark, tmp_path):
    rows = [(g, (7 * i) % 500, i % 5) for g in ("a", "b") for i in range(500 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = running(df, ["g"], ["k"], "v", str(tmp_path), "t").collect()
    for g in ("a", "b"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == total
            total += r.v
    assert len(got) == len(rows)


# ---- spelling

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def plain_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def found_variants(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}


@pytest.mark.parametrize("longer", [False, True])
def test_a_band_tells_single_edits(longer):
    rng = random.Random(longer)
    for _ in range(3000):
        word = "".join(rng.choices("ab", k=rng.randint(1, 7)))
        other = "".join(rng.choices("ab", k=len(word) + longer))
        band = spelling.Band(word, longer)
        dead = band.extend(other, 0, len(other))
        last = (band.more if longer else band.same)[len(other)]
        assert (not dead and last == 1) == (distance(word, other) == 1)


@pytest.mark.parametrize("letters, block", [("ab", 40), ("abcdeé", 7), ("abcdefgh", 20_000)])
def test_words_one_edit_apart_are_those_of_brute_force(spark, tmp_path, monkeypatch, letters, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(block)
    words = {"".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(400)} | {"a" * 1000, "a" * 1001, "a" * 999}
    words |= {w[:2] + w[3:] for w in words if len(w) > 5}
    df = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, str(tmp_path)).collect()]
    short = sorted(w for w in words if len(w) < 100)
    want = {(a, len(a), b, len(b)) for a in short for b in short if abs(len(a) - len(b)) < 2 and distance(a, b) == 1}
    want |= {("a" * i, i, "a" * j, j) for i in range(998, 1002) for j in range(998, 1002) if abs(i - j) == 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_against_brute_force(spark):
    rng = random.Random(5)
    base = ["house", "mouse", "spell", "Ébène", "straße", "letter", "lettre"]
    texts = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choices(base, weights=range(1, 8))[0]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, ", ".join(words)))
    want = plain_variants(plain_words(texts))
    assert found_variants(documents(spark, texts)) == want
    assert any(v[0] and v[1] != v[0] for v in want.values()), "no chain of forms in the fixture"


def test_ties_go_to_the_first_word(spark):
    rows = [(i, "stone " + "stoney " * (i < 3) + "store " * 2 + "stole " * 2) for i in range(6)]
    got = found_variants(documents(spark, rows))
    assert got == plain_variants(plain_words(rows)) and got["stone"][0] == "stole"


def test_spelling_of_odd_rows_and_empty_tables(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert found_variants(edge_docs) == plain_variants(plain_words(rows))
    assert found_variants(no_docs) == {}


def test_long_chains_of_forms_are_followed(spark, tmp_path):
    rows = [(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)]
    got = spelling.follow(spark.createDataFrame(rows, "word string, form string"), str(tmp_path))
    assert {r.root for r in got.collect()} == {"w40"}


def test_cycles_are_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError):
        spelling.follow(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "word string, form string"), str(tmp_path))


# ---- mixing

def mix_rows(df):
    return sorted((r.doc_id, r.size, r.source_size, r.target, r.repeats, r.part) for r in df.collect())


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choices(["a", "b", "c", "d", None, ""], weights=[60, 1, 8, 8, 3, 3])[0]) for i in range(900)]
    plan = mixture.mix(table(spark, rows))
    found = plan.collect()
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    clamped = set()
    while True:  # the plain rule: clamp, deal anew, until none is above
        free = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in clamped)
        share = {s: free * weight[s] / sum(weight[x] for x in names if x not in clamped) for s in names if s not in clamped}
        above = {s for s in share if share[s] > 2 * sizes[s]}
        if not above:
            break
        clamped |= above
    want = {s: 2.0 * sizes[s] if s in clamped else share[s] for s in names}
    assert clamped and len(found) == len(rows)
    taken = Counter()
    for r in found:
        words = r.repeats * r.size + r.part
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= words <= 2 * r.size and 0 <= r.part <= r.size
        taken[r.source] += words
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mixture.mix(table(spark, rows).repartition(13))
    assert mix_rows(again) == mix_rows(plan)
    assert mix_rows(mixture.mix(table(spark, rows), seed="other")) != mix_rows(plan)


def test_mixed_texts_hold_the_words_of_the_plan(spark):
    docs = table(spark, [(i, "  a\tb\nc d " * (i + 1), "ab"[i % 2]) for i in range(20)] + [(50, None, "a"), (51, "", "b")])
    plan = mixture.mix(docs)
    texts = defaultdict(list)
    for r in mixture.mixed_texts(docs, plan).collect():
        texts[r.doc_id].append((r.copy, r.text))
    for r in plan.collect():
        copies = sorted(texts[r.doc_id])
        assert [c for c, _ in copies] == list(range(1, r.repeats + (r.part > 0) + 1))
        assert sum(len((t or "").split()) for _, t in copies) == r.repeats * r.size + r.part
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all((whole[i] or "").startswith(t or "") for i, made in texts.items() for _, t in made)


def test_level_when_the_caps_are_too_small(spark):
    sources = spark.createDataFrame([(10, 1), (20, 3)], "source_size long, weight int")
    assert mixture.water_level(sources, 1000.0, 2) == float("inf")
    assert mixture.water_level(sources, 40.0, 2) == 10.0
    assert mixture.water_level(sources, 56.0, 2) == 16.0
    assert mixture.water_level(sources.limit(0), 0.0, 2) == 0.0


def test_mix_of_odd_rows_and_empty_tables(spark, edge_docs, no_docs):
    found = mixture.mix(edge_docs).collect()
    assert len(found) == edge_docs.count()
    total = sum(r.size for r in found)
    assert sum(r.repeats * r.size + r.part for r in found) == round(1.5 * total)
    assert mixture.mix(no_docs).collect() == []
    silent = mixture.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.repeats, r.part) for r in silent] == [(0, 0.0, 0, 0)] * 2


# ---- the manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and per leaf its steps (left siblings, right siblings)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, holders = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for slot, own in enumerate(owners[a : a + 16]):
                for o in own:
                    paths[o].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(sha("".join(run)))
            holders.append(sum(owners[a : a + 16], []))
        nodes, owners = above, holders
    return nodes[0], paths


def plain_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        leaf = plain_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        by_source[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (known, i, leaf), path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            out.append((i if known else None, s, leaf, trees[s][0], root, tuple(path + up)))
    return Counter(out)


def found_manifest(docs):
    rows = merkle.manifest(docs).collect()
    return Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in rows)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 17}, {"a": 1, None: 16, "é": 33, "z": 300}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_against_a_plain_tree(spark, counts):
    names = [s for s, n in counts.items() for _ in range(n)]
    random.Random(1).shuffle(names)
    docs = table(spark, [(i * 7 % 1009, f"Text {i}", s) for i, s in enumerate(names)])
    assert found_manifest(docs) == plain_manifest(docs.collect())


def test_manifest_of_odd_rows_and_empty_tables(spark, edge_docs, no_docs):
    assert found_manifest(edge_docs) == plain_manifest(edge_docs.collect())
    assert merkle.manifest(no_docs).collect() == []


def test_a_tampered_row_does_not_lead_to_the_root(spark):
    docs = table(spark, [(i, "Some Text" if i % 2 else "plain", f"s{i % 3}") for i in range(100)])
    proofs = merkle.manifest(docs, F.lower("text")).withColumn("to", merkle.fold(F.col("found"), F.col("path")))
    for r in proofs.collect():
        assert (r.to == r.root) == (r.doc_id % 2 == 0)


def test_leaves_tell_null_from_empty_and_fields_apart(spark):
    row = spark.createDataFrame([(None, "", "a", "1:a")], "n string, e string, a string, b string")
    made = row.select(merkle.leaf_digest(F.col("n"), F.col("a")), merkle.leaf_digest(F.col("e"), F.col("a")), merkle.leaf_digest(F.col("b"), F.col("n"))).first()
    assert tuple(made) == (plain_leaf(None, "a"), plain_leaf("", "a"), plain_leaf("1:a", None)) and len(set(made)) == 3
