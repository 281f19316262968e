"""Toxicity by a weighted lexicon.

Texts are folded to lower-case letters: look-alike letters of other scripts, wide and styled letters,
and digits and signs that stand for letters become the letter meant; accented letters of Latin-1 stay
apart, as they tell words apart; everything else becomes a space. A lexicon
of word beginnings is learned from labelled rows, each with the log odds of being in a toxic text as
its weight, and phrases in which such a word is harmless are learned as exceptions. Both are matched in
one pass by an Aho-Corasick automaton; hits inside an exception phrase don't count. The sum of weights
is divided by a slowly growing function of the length and mapped to a probability.

Defined results: null texts are empty; texts without hits, empty ones included, get the lowest score;
repeated rows get repeated scores; without toxic labels every score is the lowest.
"""

import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import fold_of, labelled_sample, map_texts, sigmoid
from passbook.scratch import scratch_folder, written

SAMPLE_DOCS = 12_000  # bound of the training sample, drawn at the labels' own rates
SHORTEST, LONGEST = 4, 12  # letters of a word beginning
MIN_TOXIC, MIN_SHARE = 8, 0.8  # toxic documents that hold a term; their share of all that hold it
MAX_TERMS, MAX_PHRASES = 2000, 2000  # most of the lexicon and of the exceptions; both are model parameters
#: Words after which the normaliser starts to grow, and the power of its growth.
USUAL_WORDS, GROWTH = 200, 0.15

# Letters of other scripts that look like Latin ones, and signs used in their place.
LOOK_ALIKE = dict(zip("авеһіјкӏмнорсԛѕтухԝԁгпαεηικνορτυχωℓ", "abehijklmhopcqstyxwdrnaenikvoptuxwl", strict=True)) | {"ı": "i", "ł": "l"}
STAND_IN = dict(zip("013457@$", "oieast" "as", strict=True))


@cache
def folding_table() -> np.ndarray:
    """For each code point below 0x20000 the folded letter, a space, or ``~`` for other letters."""
    table = np.full(0x20000, ord(" "), dtype=np.uint8)
    for code in range(0x20000):
        c = chr(code)
        if c in STAND_IN:
            table[code] = ord(STAND_IN[c])
            continue
        kind = unicodedata.category(c)
        if kind == "Mn":
            table[code] = ord("~")
        if kind[0] not in "LS" or 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKC", c.lower())[:1]
        if plain > "\xff":
            plain = unicodedata.normalize("NFKD", plain)[:1]
        plain = LOOK_ALIKE.get(plain, plain)
        if "a" <= plain <= "z" or "\xdf" <= plain <= "\xff" and plain != "\xf7":
            table[code] = ord(plain)
        elif kind[0] == "L":
            table[code] = ord("~")
    return table


def fold(text: str) -> str:
    """As many characters as ``text``; a word starts after a space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table = folding_table()
    return table[np.minimum(codes, len(table) - 1)].tobytes().decode("latin-1")


class Lexicon:
    def __init__(self, terms: dict[str, float], phrases: list[str] = (), fit: tuple[float, float] = (1.0, 0.0)):
        self.terms, self.phrases, self.fit = terms, list(phrases), fit

    @property
    def automaton(self):
        built = self.__dict__.get("_automaton")
        if built is None:
            built = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                built.add_word(f" {term}", (len(term) + 1, weight, False))
            for phrase in self.phrases:
                built.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
            built.make_automaton()
            self.__dict__["_automaton"] = built
        return built

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of terms outside exception phrases; of terms at one place the longest."""
        if not self.terms:
            return []
        longest: dict[int, tuple[int, float]] = {}
        excused = []
        for end, (size, weight, is_phrase) in self.automaton.iter(f" {fold(text)} "):
            start = end - size + 1
            if is_phrase:
                excused.append((start, end))
            else:
                longest[start] = (end, weight)  # longer terms end later
        if excused:
            longest = {s: x for s, x in longest.items() if not any(a <= s and x[0] <= b for a, b in excused)}
        return [(s, e, w) for s, (e, w) in sorted(longest.items())]

    def strength(self, text: str) -> float:
        hits = self.hits(text)
        if not hits:
            return 0.0
        words = 1 + text.count(" ") + text.count("\n")
        return sum(w for _, _, w in hits) / max(1.0, words / USUAL_WORDS) ** GROWTH

    def scores(self, texts: list[str]) -> np.ndarray:
        slope, shift = self.fit
        return sigmoid(slope * np.array([self.strength(t) for t in texts]) + shift)


def _counted(sample: DataFrame, make_terms) -> DataFrame:
    """For each term the number of toxic and of other texts that hold it."""

    def run(batches):
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(term, v) for t, v in zip(texts, y, strict=True) for term in make_terms(t)]
            for a in range(0, max(1, len(rows)), 200_000):
                part = rows[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int32())], ["term", "y"])

    counted = sample.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term")
    return counted.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("all"))


def beginnings(text: str) -> set[str]:
    """The distinct beginnings of a text's folded words, whole words included."""
    return {w[:n] for w in set(fold(text).split()) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms (term, toxic texts, all texts) with their log odds.

    Of beginnings that continue each other the shortest is taken, and made longer as long as that keeps
    nine tenths of its toxic texts.
    """
    odds = {}
    for term, t, n in rows:
        weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((n - t + 0.5) / (clean + 1)))
        if weight > 0:
            odds[term] = (weight, t, n)
    longer: dict[str, list[str]] = {}
    for term in odds:
        longer.setdefault(term[:-1], []).append(term)
    chosen: dict[str, float] = {}
    for root in odds:
        if root[:-1] in odds:
            continue
        term = root
        while (best := max(longer.get(term, ()), key=lambda x: (odds[x][1], x), default=None)) and odds[best][1] >= 0.9 * odds[term][1]:
            term = best
        chosen[term] = odds[term][0]
    ranked = sorted(chosen, key=lambda x: (-odds[x][0] * odds[x][1], x))[:MAX_TERMS]
    return {t: chosen[t] for t in ranked}


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """A lexicon learned from at most ``sample_docs`` labelled documents.

    Counting is done by Spark; the driver gets at most the terms that pass the thresholds, and one
    number per sampled text.
    """
    folder = scratch_folder(docs.sparkSession, "toxicity")
    sample = written(labelled_sample(docs, labels, "toxic", train_rows, sample_docs, by_class=False), folder, "sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({}, fit=(1.0, -4.0))
    passed = _counted(sample, beginnings).where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_SHARE * F.col("all")))
    passed = passed.orderBy(F.desc("toxic"), "all", "term").limit(20 * MAX_TERMS)
    lexicon = Lexicon(choose_terms([(r.term, r.toxic, r["all"]) for r in passed.collect()], toxic, clean))
    if not lexicon.terms:
        return Lexicon({}, fit=(1.0, -4.0))

    def phrases(text):
        folded, out = fold(text), set()
        for start, end, _ in lexicon.hits(text):
            left = folded[:start].rsplit(" ", 2)[-1] if start else ""
            rest = folded[start:].split(" ", 2)
            word, right = rest[0], rest[1] if len(rest) > 1 else ""
            out |= {f"{a} {b}" for a, b in ((left, word), (word, right)) if a and b}
        return out

    # Harmless phrases: seen in several other texts and in hardly any toxic one.
    excused = _counted(sample, phrases).where((F.col("all") - F.col("toxic") >= 3) & (F.col("toxic") * 10 <= F.col("all")))
    found = [r.term for r in excused.orderBy(F.desc("all"), "term").limit(MAX_PHRASES).collect()]
    lexicon = Lexicon(lexicon.terms, sorted(found))

    def strengths(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(t) for t in texts]), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "y").mapInArrow(strengths, "x double, y int").collect()
    x, y = (np.array(sorted((r.x, r.y) for r in rows), dtype=float).T) if rows else (np.empty(0), np.empty(0))
    lexicon.fit = logistic(x, y)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge-damped logistic fit in which both classes weigh the same."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b = 0.0, 0.0
    for _ in range(60):
        p = sigmoid(a * x + b)
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * a, (w * (p - y)).sum()])
        r = w * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; row by row, no shuffle."""
    return map_texts(docs, lambda: lambda texts: [lexicon.scores(texts)], "score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, train(docs, labels, fold_of("doc_id", 5) != 0))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
