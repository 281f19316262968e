"""The index of a full block in bounded memory; several blocks give what one gives."""

import functools
import subprocess
import sys

from passbook.llm import decontaminate

FULL_BLOCK = """
import random, resource
from passbook.llm import decontaminate as d
rng = random.Random(5)
items = [(i, " ".join(f"w{rng.randrange(300_000)}" for _ in range(30))) for i in range(20_000)]
index = d.Index(items)
texts = [" ".join(f"w{rng.randrange(300_000)}" for _ in range(400)) + " " + items[i][1] + " end" for i in range(0, 20_000, 100)]
found = d.find_items(index, texts)
assert all((100 * k, 0) in {h[:2] for h in hits} for k, hits in enumerate(found)), "a copy was missed"
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_full_block_needs_little_memory():
    out = subprocess.run([sys.executable, "-c", FULL_BLOCK], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500  # MB of the whole process, the library's imports included


def test_many_blocks_equal_one(spark, monkeypatch):
    texts = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}" for i in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)) + [(12, None), (13, "")], "item_id long, text string")
    docs = [(i, f"before it {t} after it" if i % 3 else t.replace(f"zeta{i}", "other")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*docs, (50, "nothing of the kind"), (51, None), (51, None)], "doc_id long, text string")

    def results():
        found = sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())
        return found, sorted(r.doc_id for r in decontaminate.drop_leaked(docs, items).collect())

    one = results()
    assert [r[:3] for r in one[0]] == [(i, i, 0 if i % 3 else 1) for i in range(12)] and one[1] == [50, 51, 51]
    for bound in ({"items": 3}, {"chars": 200}):
        with monkeypatch.context() as patch:
            patch.setattr(decontaminate, "benchmark_blocks", functools.partial(decontaminate.benchmark_blocks, **bound))
            assert len(decontaminate.benchmark_blocks(items)) > 3
            assert results() == one


def test_words_held_and_openers_equal_plain_sets():
    items = [(0, "a b c d e f g h i j k"), (1, "b b c x y z q r s t u"), (2, "m"), (3, "")]
    index = decontaminate.Index(items)
    words = {w: k for w, k in index.number.items()}
    for n, ids in index.by_length.items():
        for c, i in enumerate(ids):
            own = set(index.items[i].tolist())
            first = set(index.items[i][: decontaminate.edits_allowed(len(index.items[i])) + 1].tolist())
            for k in [0, *words.values()]:
                pair = decontaminate.np.array([c]), decontaminate.np.array([k], dtype=decontaminate.np.int32)
                assert index.may_begin(n, *pair)[0] == (k in first)
                assert index.words_held(n, pair[0], pair[1][:, None])[0] == (k in own)
                assert k not in first or index.openers[n][k]
