"""Spelling variants: words one edit apart, found by dynamic programming along the sorted vocabulary.

A word is compared with a list, sorted by length and letters, row by row of a banded edit matrix. The next word of the list keeps
the rows of the letters it shares with the one before (their longest common prefix); once the rows of a
prefix exceed one edit, all words with that prefix are skipped. The shorter word of a pair (either, if
equally long) looks for the other. If they differ by one edit, they share the first half of the shorter
one's letters, or its last half; so one list is sorted by the words and one by the reversed words, and in
each only the words with the same first half (of the reversed word) are scanned.

Both lists are cut into blocks by range. A word is sent to the blocks its half reaches, less those whose
common prefix already exceeds one edit; the bounds of at most ``BLOCKS`` blocks are all that is broadcast.
A task holds one block, and words stream past it, however many there are.

Defined results: null and empty texts have no words; the deletions of a null id are drawn from an empty id;
repeated rows count repeatedly; ties between forms go to the word first in code point order; an empty
table gives no words. Other columns are not read.
"""

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import whole_texts
from passbook.scratch import scratch_folder, written

LEAST_LETTERS, LEAST_COUNT = 5, 3
DROP_ONE_IN = 97
RATIO = 2  # a form is at least so many times as frequent as its variant
HELD_WORDS = 250_000  # distinct words a task counts before it hands the counts on
BLOCK_WORDS, BLOCKS = 20_000, 4_096
FAR = 9  # any number of edits above one
LAST = "\U0010ffff"
LISTED, SAME = 0, 1  # a row of a list; a word that looks for others of its length; one more: of a letter more
#: In Latin-1 bytes; other characters end a run like any separator, and only A-Z are lower-cased.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)


def count_runs(text: str, doc_id: str, held: Counter) -> None:
    """Add the words of one text of at least five letters to ``held`` (as Latin-1 bytes), hashed deletions done."""
    lowered = text.encode("latin-1", "replace").lower()
    found = RUN.findall(lowered)
    held.update(found)
    begin = zlib.crc32(f"{doc_id}:".encode())
    if lowered.isascii():
        drawn = [r for r in set(found) if zlib.crc32(r, begin) % DROP_ONE_IN == 0]
    else:
        drawn = [r for r in set(found) if zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), begin) % DROP_ONE_IN == 0]
    if drawn:
        times = Counter(found)
        for run in drawn:
            at = zlib.crc32(run.decode("latin-1").encode(), begin) % len(run)
            held[run] -= times[run]
            held[run[:at] + run[at + 1 :]] += times[run]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur often enough, counted over all texts."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            kept = [(w, n) for w, n in held.items() if n and len(w) >= LEAST_LETTERS]
            held.clear()
            words, counts = pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                count_runs(text.as_py(), doc_id.as_py(), held)
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = whole_texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counts = rows.mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Band:
    """Rows of the edit matrix of one word against a growing prefix of an other: ``d`` letters of it read.

    ``same[d]`` is the distance to the first d letters of the word, ``more[d]`` to the first d - 1. An
    other of the same length is one edit away if a letter is replaced, so only ``same`` counts; one that
    is a letter longer if a letter is inserted: no edit in ``same``, or one in ``more``. No other cell of
    the matrix can lead to a single edit.
    """

    def __init__(self, word: str, longer: bool):
        self.word, self.longer, room = word, longer, len(word) + 2
        self.same, self.more = [0] + [FAR] * room, [FAR] * (room + 1)

    def extend(self, prefix: str, start: int, stop: int) -> int:
        """Fill the rows after ``start`` up to ``stop``; returns the first row that exceeds one edit, or 0."""
        word, same = self.word, self.same
        if not self.longer:
            s = same[start]
            for d in range(start, stop):
                s += prefix[d] != word[d]
                if s > 1:
                    return d + 1
                same[d + 1] = s
            return 0
        more, n = self.more, len(word)
        s, m = same[start], more[start]
        for d in range(start, stop):
            letter = prefix[d]
            m += letter != word[d - 1]
            if s + 1 < m:
                m = s + 1
            s = s + (letter != word[d]) if d < n else FAR
            if s and m > 1:
                return d + 1
            same[d + 1], more[d + 1] = s, m
        return 0


class SortedList:
    """A sorted list of distinct words and the common prefixes of neighbours."""

    def __init__(self, words: list[str]):
        self.words = words
        self.shared = [0, *map(common_prefix, words, words[1:])]

    def near(self, word: str, longer: bool, fixed: int) -> Iterator[int]:
        """Places of the words one edit from ``word``, as long (or ``longer`` by one letter), with its first ``fixed`` letters."""
        words, shared, length, end = self.words, self.shared, len(word) + longer, len(self.words)
        prefix, band = word[:fixed], Band(word, longer)
        extend, last = band.extend, band.more if longer else band.same
        at, known = bisect_left(words, prefix), 0
        if at == end or not words[at].startswith(prefix):
            return
        while True:
            other = words[at]
            size = len(other)
            dead = extend(other, known, size if size < length else length)
            if not dead:
                if size == length and last[length] == 1:
                    yield at
                known, at = size if size < length else length, at + 1
            else:
                known, at = dead - 1, at + 1
                if at < end and shared[at] >= dead:
                    at += 1
                    if at < end and shared[at] >= dead:
                        at = bisect_left(words, other[:dead] + LAST, at)
            if at == end or shared[at] < fixed:
                return
            if shared[at] < known:
                known = shared[at]


def length_code(length: int) -> str:
    return f"{min(length, 999):03d}"


def asked_keys(word: str, half: int) -> Iterator[tuple[str, bool, int]]:
    """What a word looks for in a list: (its letters after the length of the other, other is longer, fixed letters)."""
    for longer in (False, True):
        code = length_code(len(word) + longer)
        yield code + word, longer, len(code) + half


def reach(key: str, longer: bool, fixed: int, bounds: list[tuple[int, str, str, str]]) -> Iterator[int]:
    """The blocks, given as (number, first key, last key, their common prefix) in order, that can hold partners."""
    low, high = key[:fixed], key[:fixed] + LAST
    at = bisect_left(bounds, low, key=lambda b: b[2])
    while at < len(bounds) and bounds[at][1] <= high:
        number, _, _, prefix = bounds[at]
        if not Band(key, longer).extend(prefix, 0, min(len(prefix), len(key) + longer)):
            yield number
        at += 1


def _one_side(words: DataFrame, count: int, back: bool, folder: str) -> DataFrame:
    """(word, n, other, other_n): pairs found in the list sorted by the words, or by the reversed words."""
    name, code = "back" if back else "front", len(length_code(0))
    spelled = words.select((F.reverse("word") if back else F.col("word")).alias("word"), "n")
    keyed = spelled.select(F.concat(F.lpad(F.least(F.length("word"), F.lit(999)).cast("string"), code, "0"), "word").alias("key"), "n")
    blocks = min(BLOCKS, max(1, -(-count // BLOCK_WORDS)))
    placed = written(keyed.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), folder, f"{name}-list")
    ends = placed.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    bounds = sorted(((r.block, r.low, r.high, r.low[: common_prefix(r.low, r.high)]) for r in ends), key=lambda b: b[1])
    half = (lambda w: len(w) - len(w) // 2) if back else (lambda w: len(w) // 2)

    def send(batches):
        for batch in batches:
            to, kinds, keys, rows = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                for key, longer, fixed in asked_keys(word, half(word)):
                    for block in reach(key, longer, fixed, bounds):
                        to.append(block)
                        kinds.append(SAME + longer)
                        keys.append(key)
                        rows.append(i)
            n = batch.column(1).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), n], names)

    names = ["block", "asks", "key", "n"]
    asked = spelled.mapInArrow(send, "block int, asks int, key string, n bigint")
    both = placed.select("block", F.lit(LISTED).alias("asks"), "key", "n").unionAll(asked)
    met = both.repartition("block").sortWithinPartitions("block", "asks", "key")

    def scan(batches):
        block, listed, counts, known = None, [], [], None
        for batch in batches:
            found = []
            for b, asks, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, listed, counts, known = b, [], [], None
                if asks == LISTED:
                    listed.append(key)
                    counts.append(n)
                    continue
                known = known or SortedList(listed)
                word = key[code:]
                first = len(word) // 2
                for at in known.near(key, asks != SAME, code + half(word)):
                    other = listed[at][code:]
                    if not back:
                        found.append((word, n, other, counts[at]))
                    elif word[len(word) - first :] != other[len(other) - first :]:
                        # Those that share the first half of the shorter word are found in the other list.
                        found.append((word[::-1], n, other[::-1], counts[at]))
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "other", "other_n"])

    return met.mapInArrow(scan, "word string, n bigint, other string, other_n bigint")


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """(word, n, other, other_n) for all words exactly one edit apart, in both directions, from (word, n)."""
    count = words.count()
    found = written(_one_side(words, count, False, folder).unionAll(_one_side(words, count, True, folder)), folder, "pairs")
    # Equally long words find each other; of others only the shorter one has looked.
    other_way = found.where(F.length("word") < F.length("other")).select(F.col("other"), F.col("other_n"), F.col("word"), F.col("n"))
    return found.unionAll(other_way.toDF("word", "n", "other", "other_n"))


def follow(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one, twice as far in every round.

    A form is at least twice as frequent as its variant, so chains have at most 63 steps.
    """
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    for turn in range(8):
        now = written(now, folder, f"roots-{turn}")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")
    raise RuntimeError("forms do not end; are there cycles?")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the vocabulary of ``docs``."""
    folder = scratch_folder(docs.sparkSession, "spelling")
    words = written(vocabulary(docs), folder, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    per_word = near_words(words, folder).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    judged = words.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    judged = written(judged, folder, "judged")
    return judged.join(follow(judged, folder), "word")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
