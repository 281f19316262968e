"""Documents that hold benchmark passages, within a small edit distance.

Texts and items are sequences of lower-cased words (runs of letters and digits). A CGK walk
(Chakraborty, Goldenberg, Koucky 2016) reads a sequence with a pointer that moves or waits by a
pseudo-random bit of (step, word); sequences at a small edit distance fall back into step, so their
outputs have a small Hamming distance. Sampling positions of the outputs of several walks gives the
keys of an LSH index of the items. Windows as long as an item (lengths rounded down to a ladder) at
every word of a text are looked up there; what they meet is verified by exact edit distance between
the whole item and the text from that word on. The number of tables of each window length follows from
the recall asked for, simulated on items of that length at the largest distance allowed; where no
number of tables suffices, every window that can match is verified.

Before that, windows are left out that cannot match: an item within d edits keeps at least n - d of its
words and n - 1 - 2d of its word pairs, and its best alignment can begin at one of its first d + 1
words. This loses nothing.

Benchmark items are taken in blocks of bounded items and characters; a block's index is arrays over its
words and items (no table of items x vocabulary) and every block meets all documents. Where there are
several blocks, each one's result is written before the next is indexed, so the driver and the tasks hold one
index at a time. No rows are shuffled.

Defined results: null texts and items are empty; an item without words matches nothing; an item of
fewer than five words matches only exactly; a document's repeated hits of an item give one row;
repeated document rows give repeated rows; repeated items count as separate items.
"""

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import text_slices, whole_texts
from passbook.scratch import scratch_folder, written

SHARE = 0.2  # edits allowed per word of an item: similarity of 0.8 or more
RECALL = 0.97
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000  # bounds of an index; every block is one more pass over the documents
CELLS = 2_000_000  # window words, or pairs of windows and items, looked at together
WALKS, SAMPLED = 8, 3
TOLD = 2  # places are sampled in the first 2 n of the 3 n steps: later most rows have ended, and all keys would be equal
MOST_TABLES = 40  # per walk; a window length that needs more meets all its items
SIMULATED, TRIALS = 12, 12  # items of a window length, and edited copies of each, to set its tables by
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BYTES).split()


def ladder(n: int) -> int:
    """The window length for an item of ``n`` words: at most an eighth shorter."""
    step = 1
    while step * 16 <= n:
        step *= 2
    return n // step * step


def edits_allowed(n: int) -> int:
    return int(SHARE * n)


def walk(rows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """CGK outputs (3 x length symbols) of rows of word numbers; 0 stands after the end of a row."""
    rng = np.random.default_rng([seed, 5])
    steps = 3 * length
    odd = rng.integers(0, 1 << 63, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(rows)
    padded = np.concatenate([rows, np.zeros((m, 1), rows.dtype)], axis=1)
    flat, base = padded.ravel(), np.arange(m) * (length + 1)
    at = np.zeros(m, dtype=np.int64)
    out = np.empty((steps, m), dtype=rows.dtype)
    for j in range(steps):
        symbol = flat[base + at]
        out[j] = symbol
        at += ((symbol.astype(np.uint64) + np.uint64(1)) * odd[j] >> np.uint64(63)).astype(np.int64)
        np.minimum(at, length, out=at)
    return out


def edit_distances(items: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least edits from each item (rows, one length) to a prefix of its window, of the given lengths."""
    k, n = items.shape
    w = windows.shape[1]
    kind = np.int16 if n + w < 30_000 else np.int32
    row = np.broadcast_to(np.arange(w + 1), (k, w + 1)).astype(kind)
    steps = np.arange(w + 1, dtype=kind)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != items[:, i : i + 1]), row[:, 1:] + 1)
        # Insertions: new[j] = min over j' <= j of new[j'] + j - j'.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    row[steps[None, :] > lengths[:, None]] = n + w
    return row.min(axis=1)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


class Index:
    """The items of one block: vocabulary, word pairs, and the LSH tables of each window length."""

    def __init__(self, items: list[tuple[int, str]], recall: float = RECALL):
        self.ids = [i for i, _ in items]
        split = [words_of(t or "") for _, t in items]
        self.number: dict[bytes, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], dtype=np.int32) for ws in split]
        v = len(self.number) + 1
        pairs = [x[:-1].astype(np.int64) * v + x[1:] for x in self.items if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.by_length: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            if len(x):
                self.by_length.setdefault(ladder(len(x)), []).append(i)
        self.per_walk = {n: self._tables_needed(n, recall) for n in self.by_length}
        self.places = {n: self._places(n) for n, k in self.per_walk.items() if k}
        self.keys, self.order = {}, {}
        for n in self.places:
            ids = self.by_length[n]
            keys = self.window_keys(np.array([self.items[i][:n] for i in ids]), n)
            order = np.argsort(keys, axis=1, kind="stable")
            self.keys[n], self.order[n] = np.take_along_axis(keys, order, 1), order.astype(np.int32)
        # Per window length: least words and pairs kept, and the longest text an alignment can span.
        self.needs = {}
        for n, ids in self.by_length.items():
            kept = [(len(self.items[i]) - (d := edits_allowed(len(self.items[i]))), len(self.items[i]) - 1 - 2 * d, len(self.items[i]) + d) for i in ids]
            self.needs[n] = tuple(f(x) for f, x in zip((min, min, max), zip(*kept, strict=True), strict=True))
        # Per window length, sorted codes (item of the length, word): the words an alignment may begin with, and
        # all words of the item; and which words any alignment may begin with.
        self.vocabulary = np.int64(v)
        self.begins, self.holds, self.openers = {}, {}, {}
        for n, ids in self.by_length.items():
            first = [self.items[i][: edits_allowed(len(self.items[i])) + 1] for i in ids]
            self.begins[n], self.holds[n] = self._codes(first), self._codes([self.items[i] for i in ids])
            self.openers[n] = np.zeros(v, dtype=bool)
            self.openers[n][np.concatenate(first)] = True

    def _codes(self, words: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
        return np.unique(owner * self.vocabulary + np.concatenate(words))

    def may_begin(self, n: int, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _among(item * self.vocabulary + word, self.begins[n])

    def words_held(self, n: int, item: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many words of each row its item holds."""
        return _among(item[:, None] * self.vocabulary + rows, self.holds[n]).sum(1)

    def _tables_needed(self, n: int, recall: float) -> int | None:
        """Tables per walk such that each item of this window length, edited as much as allowed, is found with
        probability ``recall``; None if more than ``MOST_TABLES`` would be needed."""
        ids = sorted(self.by_length[n], key=lambda i: (len(self.items[i]), i))
        ids = [ids[k] for k in np.unique(np.linspace(0, len(ids) - 1, SIMULATED).astype(int))]
        if not any(edits_allowed(len(self.items[i])) for i in ids):
            return 1
        rng = np.random.default_rng([n, 3])
        edited = []
        for x in (self.items[i] for i in ids):
            for _ in range(TRIALS):
                y = list(x)
                for _ in range(edits_allowed(len(x))):
                    at, kind = int(rng.integers(0, len(y))), int(rng.integers(0, 3))
                    if kind == 0:
                        y[at] = 0
                    elif kind == 1 and len(y) > n:
                        del y[at]
                    else:
                        y.insert(at, 0)
                edited.append(y[:n])
        rows = np.array([self.items[i][:n] for i in ids] + edited, dtype=np.int32)
        whole = np.repeat(np.arange(len(ids)), TRIALS)
        miss = np.zeros(len(edited))
        for s in range(WALKS):
            seen = walk(rows, n, s)
            same = (seen[: TOLD * n, whole] == seen[: TOLD * n, len(ids) :]).mean(axis=0) ** SAMPLED
            miss += np.log1p(-np.minimum(same, 1 - 1e-9))
        for k in range(1, MOST_TABLES + 1):
            if (1 - np.exp(k * miss)).reshape(len(ids), TRIALS).mean(axis=1).min() >= recall:
                return k
        return None

    def _places(self, n: int) -> np.ndarray:
        return np.random.default_rng([n, 9]).integers(0, TOLD * n, size=(WALKS, self.per_walk[n], SAMPLED))

    def window_keys(self, rows: np.ndarray, n: int) -> np.ndarray:
        """(tables, rows): the sampled symbols of each table, mixed to one number."""
        out = []
        for w in range(WALKS):
            seen = walk(rows, n, w).astype(np.uint64)
            for places in self.places[n][w]:
                key = np.zeros(rows.shape[0], dtype=np.uint64)
                for p in places:
                    key = (key ^ seen[p]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out.append(key)
        return np.array(out)

    def met(self, rows: np.ndarray, n: int):
        """Pairs (row, item of this length) that share a key of some table, in parts of about ``CELLS`` shared keys;
        all pairs where tables don't suffice."""
        count = len(self.by_length[n])
        if n not in self.places:
            some = max(1, CELLS // count)
            for a in range(0, len(rows), some):
                r, c = np.divmod(np.arange(min(some, len(rows) - a) * count), count)
                yield a + r, c
            return
        keys, known = self.window_keys(rows, n), self.keys[n]
        lo = np.array([np.searchsorted(b, a, "left") for a, b in zip(keys, known, strict=True)])
        shared = np.array([np.searchsorted(b, a, "right") for a, b in zip(keys, known, strict=True)]) - lo
        ends = np.cumsum(shared.sum(0))
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
            found = []
            for first, times, order in zip(lo[:, a:b], shared[:, a:b], self.order[n], strict=True):
                hit = np.repeat(np.arange(a, b), times)
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append(hit * count + order[np.repeat(first, times) + within])
            yield np.divmod(np.unique(np.concatenate(found)), count)
            a = b


def _windowed(total: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return total[np.minimum(starts + size, len(total) - 1)] - total[starts]


def _window_hits(index: Index, n: int, rows: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For windows (rows of word numbers, one window length): (item, edits) of the items verified there."""
    hits: dict[int, list[tuple[int, int]]] = {}
    step = max(1, min(20_000, CELLS // (2 * n)))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        for r, c in index.met(np.ascontiguousarray(part[:, :n]), n):
            able = index.may_begin(n, c, part[r, 0])
            _verify(index, n, part, r[able], c[able], a, hits)
    return hits


def _verify(index: Index, n: int, rows: np.ndarray, r: np.ndarray, c: np.ndarray, offset: int, hits: dict) -> None:
    """Add to ``hits`` the pairs (row, item of this length) within the edits allowed."""
    item_of = np.array(index.by_length[n])[c]
    sizes = np.array([len(index.items[i]) for i in item_of.tolist()], dtype=np.int64)
    enough, some = np.zeros(len(r), dtype=bool), max(1, CELLS // rows.shape[1] // 4)
    for b in range(0, len(r), some):
        at = slice(b, b + some)
        enough[at] = index.words_held(n, c[at], rows[r[at]]) >= sizes[at] - (SHARE * sizes[at]).astype(np.int64)
    r, item_of, sizes = r[enough], item_of[enough], sizes[enough]
    for length in np.unique(sizes):
        pick = np.flatnonzero(sizes == length)
        d, some = edits_allowed(int(length)), max(1, min(5000, CELLS // int(length)))
        for b in range(0, len(pick), some):
            p = pick[b : b + some]
            near = edit_distances(np.array([index.items[i] for i in item_of[p]]), rows[r[p], : length + d], np.full(len(p), length + d))
            for k in np.flatnonzero(near <= d):
                hits.setdefault(offset + int(r[p[k]]), []).append((int(item_of[p[k]]), int(near[k])))


def find_items(index: Index, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text its hits (item, edits, first word), the best place of each item."""
    get = index.number.get
    numbers, ends = [], []
    gap = max((need[2] for need in index.needs.values()), default=0) + 1
    for t in texts:
        numbers.extend(map(get, words_of(t), repeat(0)))
        ends.append(len(numbers))
        numbers += [0] * gap  # no window reaches from one text into the next
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    flow = np.array(numbers, dtype=np.int32)
    if not len(flow) or not index.needs:
        return out
    ends_at = np.array(ends)
    known = flow > 0
    code = flow[:-1].astype(np.int64) * (len(index.number) + 1) + flow[1:]
    both = np.flatnonzero(known[:-1] & known[1:])
    pair = np.zeros(len(flow), dtype=bool)
    if len(index.pairs) and len(both):
        at = np.minimum(np.searchsorted(index.pairs, code[both]), len(index.pairs) - 1)
        pair[both] = index.pairs[at] == code[both]
    words = np.concatenate([[0], np.cumsum(known)])
    pairs = np.concatenate([[0], np.cumsum(pair)])
    # A first, cheap look: some stretch of 16 words holds its share of the pairs that any item needs.
    least = min(-(-q // -(-span // 16)) for _, q, span in index.needs.values())
    starts = np.flatnonzero(known)
    if least > 0:
        rich = np.zeros(len(flow) + 1, dtype=np.int64)
        dense = np.flatnonzero(_windowed(pairs, np.arange(len(flow)), 16) >= least)
        rich[dense] = 1
        rich = np.concatenate([[0], np.cumsum(rich[:-1])])
        reach = max(span for _, _, span in index.needs.values())
        starts = starts[(rich[np.minimum(starts + reach, len(flow))] - rich[np.maximum(starts - 16, 0)]) > 0]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for n, (u, q, span) in index.needs.items():
        s = starts[index.openers[n][flow[starts]]]
        s = s[(_windowed(words, s, span) >= u) & (_windowed(pairs, s, span) >= q)]
        s = s[s < len(flow) - span]
        together = max(1, CELLS // span)
        for a in range(0, len(s), together):
            part = s[a : a + together]
            windows = flow[part[:, None] + np.arange(span)]
            _, first, inverse = np.unique(windows.view([("", windows.dtype)] * span).ravel(), return_index=True, return_inverse=True)
            hits = _window_hits(index, n, windows[first])
            if not hits:
                continue
            matched = np.isin(inverse, list(hits))
            docs = np.searchsorted(ends_at, part[matched], "right")
            for start, row, doc in zip(part[matched].tolist(), inverse[matched].tolist(), docs.tolist(), strict=True):
                for item, edits in hits[row]:
                    key = (doc, item)
                    if key not in best or (edits, start) < best[key]:
                        best[key] = (edits, start)
    begins = np.concatenate([[0], ends_at[:-1] + gap])
    for (doc, item), (edits, start) in sorted(best.items()):
        out[doc].append((item, edits, int(start - begins[doc])))
    return out


def benchmark_blocks(benchmark: DataFrame, items: int = BLOCK_ITEMS, chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The items in blocks of about so many rows and characters, dealt by hash; at least one block."""
    rows = benchmark.select("item_id", "text")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-size // chars))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)]


def indexed(block: DataFrame, recall: float = RECALL) -> Index:
    return Index(sorted(((r[0], r[1] or "") for r in block.collect()), key=lambda x: (x[0] is not None, x[0], x[1])), recall)


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, first_word) of every item found in a whole text, once per row and item."""
    source, blocks = whole_texts(docs), benchmark_blocks(benchmark)
    if len(blocks) == 1:
        return _found(source, benchmark, indexed(blocks[0], recall))
    folder = scratch_folder(docs.sparkSession, "leaks")
    parts = [written(_found(source, benchmark, indexed(b, recall)), folder, f"block-{k}") for k, b in enumerate(blocks)]
    return docs.sparkSession.read.schema(parts[0].schema).parquet(*(f"{folder}/block-{k}" for k in range(len(parts))))


def _found(source: DataFrame, benchmark: DataFrame, index: Index) -> DataFrame:
    item_type = _arrow_type(benchmark)
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, 8_000_000):
                rows = [(a + i, *hit) for i, hits in enumerate(find_items(index, texts[a:b])) for hit in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([index.ids[r[1]] for r in rows], item_type),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "first_word"],
                )

    return source.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first_word bigint")


def _arrow_type(benchmark: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(benchmark.schema["item_id"].dataType)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns kept, one pass for each block."""
    blocks = benchmark_blocks(benchmark)
    if len(blocks) == 1:
        return docs.where(~_holds(indexed(blocks[0]))("text"))
    kept, folder = docs, scratch_folder(docs.sparkSession, "leaks")
    for k, block in enumerate(blocks):
        kept = written(kept.where(~_holds(indexed(block))("text")), folder, f"kept-{k}")
    return kept


def _holds(index: Index):
    """Column function: does a text hold an item of ``index``."""

    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        values = ["" if t is None else t for t in texts]
        flags = [bool(hits) for a, b in text_slices(values, 8_000_000) for hits in find_items(index, values[a:b])]
        return pd.Series(flags, dtype=bool)

    return leaked


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark)
