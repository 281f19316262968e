"""Allow or block verdicts for URLs: rules first, then gradient-boosted trees on lexical features.

A rule names a host and a path beginning; it fits that host and its subdomains, and the longest rule
that fits wins. URLs that no rule fits are judged by trees trained in numpy on labelled URLs: those the
rules decide. Features are lengths, depth, shares of digits and other characters, entropies, counts of
parameters and labels, and, as suffix statistics, the smoothed share of blocked URLs among labelled
ones with the same last label of the host, the same last two labels and the same first path segment.
These statistics count every labelled URL of the table (for training, those of the half a URL is not
in, so that it can't learn from itself) and are joined to the URLs; the trees see a bounded sample.

Defined results: a null URL or one without ``://`` has an empty host and path and goes to the trees;
repeated rows get repeated verdicts; without labelled URLs of both verdicts, the verdict of the more
frequent one (``allow`` when there are none) holds for all others.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import sigmoid
from passbook.scratch import scratch_folder, written

# The rules (host and path beginning, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SAMPLE = 20_000  # bound of the labelled URLs the trees are trained on
TREES, DEPTH, BINS, RATE, LEAST = 40, 4, 32, 0.2, 8
PRIOR_ROWS = 20.0  # how many rows the overall share weighs in a suffix statistic


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    found = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null: one CASE, longest first."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules for x in pair]), rule)


def split_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule."""
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def suffixes() -> dict[str, Column]:
    return {
        "top": F.element_at(F.split(F.col("host"), r"\."), -1),
        "site": F.substring_index("host", ".", -2),
        "first": F.regexp_extract("path", r"^/([^/]*)", 1),
    }


def half_of() -> Column:
    return F.pmod(F.xxhash64("url", "page_id"), F.lit(2)).cast("int")


def suffix_counts(labelled: DataFrame, folder: str) -> dict[str, DataFrame]:
    """For each statistic a table of all its values (v) with their labelled (n) and blocked (k) URLs in either half."""
    out = {}
    for name, value in suffixes().items():
        sides = [F.coalesce(f(F.when(F.col("half") == h, x)), F.lit(0)).alias(f"{c}{h}") for h in (0, 1) for c, f, x in (("n", F.count, F.lit(1)), ("k", F.sum, F.col("y")))]
        out[name] = written(labelled.groupBy(value.alias("v")).agg(*sides), folder, f"counts-{name}")
    return out


def with_statistics(rows: DataFrame, counts: dict[str, DataFrame], share: float, halves: bool = False) -> DataFrame:
    """``rows`` with a column s_name of each statistic; with ``halves``, from the half a URL is not in."""
    columns = rows.columns
    for name, value in suffixes().items():
        rows = rows.withColumn("v", value).join(counts[name], "v", "left")
        n, k = (
            F.when(F.col("half") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0")) if halves else F.col(f"{c}0") + F.col(f"{c}1")
            for c in "nk"
        )
        smoothed = (F.coalesce(k, F.lit(0)) + F.lit(PRIOR_ROWS * share)) / (F.coalesce(n, F.lit(0)) + F.lit(PRIOR_ROWS))
        columns = [*columns, f"s_{name}"]
        rows = rows.withColumn(f"s_{name}", smoothed).select(*columns)
    return rows


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def lexical_features(url: str, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    n = max(1, len(url))
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), max(map(len, labels), default=0),
        digits / n, sum(c.isdigit() for c in host), sum(not c.isalnum() for c in url) / n, host.count("-") + path.count("-"),
        len(query), query.count("=") + query.count("&"), float("#" in url), float(url.startswith("https")),
        float(path.endswith((".html", ".php", ".htm"))), _entropy(host), _entropy(path),
        max((len(p) for p in path.split("/")), default=0), float(host.startswith("www.")),
    ]


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, grown on quantile bins."""

    def __init__(self):
        self.base, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self._bins(x)
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = sigmoid(f)
            tree = self._grow(bins, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            f += self._leaf_values(tree, bins)
        return self

    def _bins(self, x):
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def _grow(self, bins, g, h):
        """Node k has children 2k + 1 and 2k + 2; (feature, bin) of each split, value of each leaf."""
        split, value, at = {}, {}, np.zeros(len(g), dtype=np.int64)
        for level in range(DEPTH + 1):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value[node] = RATE * total_g / (total_h + 1.0)
                if level == DEPTH or len(rows) < 2 * LEAST:
                    continue
                best = (1e-6, None)
                for j in range(bins.shape[1]):
                    b = bins[rows, j]
                    n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                    left_g = np.cumsum(np.bincount(b, g[rows], BINS))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k))
                if best[1]:
                    split[node] = j, k = best[1]
                    at[rows] = 2 * node + 1 + (bins[rows, j] > k)
        return split, value

    def _leaf_values(self, tree, bins):
        split, value = tree
        at = np.zeros(len(bins), dtype=np.int64)
        for node in sorted(split):
            j, k = split[node]
            rows = np.flatnonzero(at == node)
            at[rows] = 2 * node + 1 + (bins[rows, j] > k)
        return np.array([value[n] for n in at.tolist()]) if len(at) else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        f, bins = np.full(len(x), self.base), self._bins(x) if self.trees else None
        for tree in self.trees:
            f += self._leaf_values(tree, bins)
        return sigmoid(f)


class Judge:
    """Suffix statistics and trees; the probability that a URL should be blocked."""

    def __init__(self, counts: dict[str, DataFrame], share: float):
        self.counts, self.share, self.trees = counts, share, Boosted()


def features(urls, hosts, paths, statistics) -> np.ndarray:
    out = [[*lexical_features(u, h, p), *s] for u, h, p, s in zip(urls, hosts, paths, statistics, strict=True)]
    return np.array(out, dtype=float) if out else np.zeros((0, 0))


def train(split: DataFrame, folder: str, rules=RULES, sample: int = SAMPLE) -> Judge:
    """Fitted to the URLs that ``rules`` decide; the trees to at most ``sample`` of them, chosen by hash."""
    y = (verdict_of(F.col("rule"), rules) == "block").cast("int")
    labelled = split.where("rule is not null").select("page_id", "url", "host", "path", y.alias("y"), half_of().alias("half"))
    n, k = labelled.agg(F.count("*"), F.sum("y")).first()
    judge = Judge(suffix_counts(labelled, folder), float((k or 0) / max(1, n)))
    chosen = written(labelled.orderBy(F.xxhash64("url", "page_id")).limit(sample).select("url", "host", "path", "y", "half"), folder, "sample")
    rows = with_statistics(chosen, judge.counts, judge.share, halves=True).collect()
    rows.sort()
    target = np.array([r.y for r in rows], dtype=float)
    judge.trees.fit(features([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], [tuple(r)[5:] for r in rows]), target)
    return judge


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; p_block is the trees' probability where no rule fits."""
    folder = scratch_folder(pages.sparkSession, "urls")
    split = written(split_urls(pages.select("page_id", "url"), rules), folder, "split")
    judge = train(split, folder, rules)
    trees = judge.trees

    @F.pandas_udf("double")
    def p_block(url: pd.Series, host: pd.Series, path: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        if not len(url):
            return pd.Series(np.empty(0))
        return pd.Series(trees.scores(features(url, host, path, zip(a, b, c, strict=True))))

    # The two halves are disjoint, so that the trees see only URLs without a rule.
    ruled = split.where("rule is not null").withColumn("p_block", F.lit(None).cast("double")).withColumn("verdict", verdict_of(F.col("rule"), rules))
    rest = with_statistics(split.where("rule is null"), judge.counts, judge.share)
    rest = rest.withColumn("p_block", p_block("url", "host", "path", *(f"s_{name}" for name in suffixes())))
    rest = rest.withColumn("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict", "p_block"]
    return ruled.select(*columns).unionAll(rest.select(*columns))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
