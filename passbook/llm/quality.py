"""Document quality by a convolutional network over bytes.

Every text is read as bytes, whole. Each byte has a learned vector; learned filters of ``WIDTH`` bytes
are applied every ``STRIDE`` bytes; the filters' answers are max-pooled within overlapping chunks that
cover the document; the mean and the maximum over chunks go through one logistic unit. All of it is
trained in numpy by back-propagation, on a bounded sample of labelled rows.

Defined results: null and empty texts are one chunk of zero bytes and get a score; repeated rows get
repeated scores; with labels of only one class, or none, every score is the share of good labels
(0.5 without labels).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import SMALL_SLICE, Adam, byte_slices, fold_of, labelled_sample, map_texts, sigmoid

DIM, STRIDE, FILTERS = 8, 4, 24
WIDTH = 2 * STRIDE
HALF_CHUNK = 32  # windows; a chunk is two halves, and chunks overlap by one half
PER_CLASS = 1500  # bound of the training sample, per class
SEGMENT = 3000  # bytes of a training document used in one step, from anywhere in it
STEPS, BATCH = 500, 32
SLICE_BYTES = 250_000  # bytes that go through the filters at once; about 150 bytes of memory each
THRESHOLD = 0.7


def _windows(text: bytes) -> int:
    return max(1, -(-len(text) // STRIDE))


def _pieces(texts: list[bytes], limit: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Runs of pieces of at most ``limit`` bytes together, and the number of windows of each piece.

    A long text is cut between half-chunks; a piece ends with the stride that its last window reaches into.
    """
    most = max(1, limit // (HALF_CHUNK * STRIDE)) * HALF_CHUNK  # windows of a piece
    run, windows, size = [], [], 0
    for t in texts:
        total = _windows(t)
        for begin in range(0, total, most):
            count = min(most, total - begin)
            if run and size + count * STRIDE > limit:
                yield run, np.array(windows)
                run, windows, size = [], [], 0
            run.append(t[begin * STRIDE : (begin + count + 1) * STRIDE])
            windows.append(count)
            size += count * STRIDE
    if run:
        yield run, np.array(windows)


def _pad(texts: list[bytes], windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole strides plus one; the number of windows of each."""
    windows = np.array([_windows(t) for t in texts]) if windows is None else windows
    data = b"".join(t + bytes((w + 1) * STRIDE - len(t)) for t, w in zip(texts, windows.tolist(), strict=True))
    return np.frombuffer(data, dtype=np.uint8), windows


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, DIM)).astype(f32),
            "first": rng.normal(0, 0.15, (STRIDE * DIM, FILTERS)).astype(f32),
            "second": rng.normal(0, 0.15, (STRIDE * DIM, FILTERS)).astype(f32),
            "shift": np.zeros(FILTERS, f32),
            "mean": rng.normal(0, 0.1, FILTERS).astype(f32),
            "max": rng.normal(0, 0.1, FILTERS).astype(f32),
            "bias": np.zeros(1, f32),
        }
        self.prior: float | None = None

    def _answers(self, codes, windows):
        p = self.p
        blocks = p["bytes"][codes].reshape(-1, STRIDE * DIM)  # a stride of bytes per row
        a, b = blocks @ p["first"], blocks @ p["second"]
        # Window i of a text is its blocks i and i + 1; the last block of a text begins no window.
        last = np.cumsum(windows + 1) - 1
        keep = np.ones(len(blocks), dtype=bool)
        keep[last] = False
        rows = np.flatnonzero(keep)
        return blocks, rows, a[rows] + b[rows + 1] + p["shift"]

    def _halves(self, windows):
        """Starts of half-chunks over all windows, and how many each text has."""
        count = -(-windows // HALF_CHUNK)
        first = np.repeat(np.cumsum(windows) - windows, count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return first + within * HALF_CHUNK, count

    def _half_chunks(self, texts: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest answers of every half-chunk of all texts, and how many each text has.

        The bytes go through the filters in runs of pieces, so memory does not depend on a text's length.
        """
        halves = []
        for pieces, windows in _pieces(texts, limit):
            _, _, y = self._answers(*_pad(pieces, windows))
            starts, _ = self._halves(windows)
            halves.append(np.maximum(np.maximum.reduceat(y, starts, axis=0), 0))
        return np.concatenate(halves), np.array([-(-_windows(t) // HALF_CHUNK) for t in texts])

    def logits(self, texts: list[bytes], limit: int = SLICE_BYTES) -> np.ndarray:
        half, count = self._half_chunks(texts, limit)
        ends = np.cumsum(count)
        chunk = half.copy()
        chunk[:-1] = np.maximum(half[:-1], half[1:])
        lasts = ends - 1
        chunk[lasts] = half[lasts]  # the last chunk of a text is its last half alone
        mean = np.add.reduceat(chunk, ends - count, axis=0) / count[:, None]
        top = np.maximum.reduceat(chunk, ends - count, axis=0)
        return mean @ self.p["mean"] + top @ self.p["max"] + self.p["bias"][0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        # Sums of 32-bit numbers depend in their last bits on what is multiplied with them.
        return np.round(sigmoid(self.logits(texts).astype(np.float64)), 5)

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray):
        p = self.p
        codes, windows = _pad(texts)
        blocks, rows, answers = self._answers(codes, windows)
        starts, count = self._halves(windows)
        stops = np.append(starts[1:], len(answers))
        # Position of the largest answer of each half-chunk and filter.
        size = stops - starts
        grid = np.full((len(starts), HALF_CHUNK, FILTERS), -np.inf, dtype=np.float32)
        inside = np.arange(HALF_CHUNK)[None, :] < size[:, None]
        grid[inside] = answers
        best = grid.argmax(1)
        half = np.take_along_axis(grid, best[:, None], 1)[:, 0]
        at = starts[:, None] + best
        ends = np.cumsum(count)
        nxt = np.arange(len(half)) + 1
        nxt[ends - 1] = ends - 1
        use_next = half[nxt] > half
        chunk = np.maximum(np.where(use_next, half[nxt], half), 0)
        source = np.where(use_next, at[nxt], at)
        doc = np.repeat(np.arange(len(texts)), count)
        mean = np.add.reduceat(chunk, ends - count, axis=0) / count[:, None]
        top = np.maximum.reduceat(chunk, ends - count, axis=0)
        z = mean @ p["mean"] + top @ p["max"] + p["bias"][0]
        dz = ((sigmoid(z) - y) * weight / weight.sum()).astype(np.float32)
        out = {"mean": mean.T @ dz, "max": top.T @ dz, "bias": np.array([dz.sum()], np.float32)}
        dchunk = (dz / count)[doc][:, None] * p["mean"]
        is_top = chunk == top[doc]
        dchunk = dchunk + np.where(is_top, dz[doc][:, None] * p["max"], 0) / np.maximum(np.add.reduceat(is_top, ends - count, axis=0)[doc], 1)
        dchunk = np.where(chunk > 0, dchunk, 0).astype(np.float32)
        danswer = np.zeros_like(answers)
        np.add.at(danswer, (source, np.arange(FILTERS)[None, :]), dchunk)
        touched = np.flatnonzero(danswer.any(1))
        d, r = danswer[touched], rows[touched]
        out |= {"first": blocks[r].T @ d, "second": blocks[r + 1].T @ d, "shift": d.sum(0)}
        dbytes = np.zeros_like(p["bytes"])
        grouped = codes.reshape(-1, STRIDE)
        for side, offset in (("first", 0), ("second", 1)):
            np.add.at(dbytes, grouped[r + offset].ravel(), (d @ p[side].T).reshape(-1, DIM))
        out["bytes"] = dbytes
        return out

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> "ByteCNN":
        y = np.asarray(y, dtype=np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return self
        rng, adam = np.random.default_rng(seed), Adam(self.p, 0.01)
        sides = [np.flatnonzero(y == v) for v in (0, 1)]
        for step in range(steps):
            pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
            part = []
            for i in pick.tolist():
                t = texts[i]
                at = int(rng.integers(0, max(1, len(t) - SEGMENT + 1)))
                part.append(t[at : at + SEGMENT])
            grads = self.gradients(part, y[pick], np.ones(len(pick), np.float32))
            adam.step(grads, 0.01 * (1 - step / steps) + 0.0005)
        return self


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = PER_CLASS) -> ByteCNN:
    """A network fitted to at most ``per_class`` labelled documents of each class.

    The sample is chosen by hash of the id; of each document one segment from a hashed place is taken
    to the driver, so what the driver holds is bounded by ``2 * per_class * 4 * SEGMENT`` bytes.
    """
    sample = labelled_sample(docs, labels, "quality", train_rows, per_class)
    span = SEGMENT
    room = F.greatest(F.length("text") - F.lit(span), F.lit(0)) + 1
    rows = sample.select("doc_id", F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(span)).alias("text"), "y").collect()
    rows.sort(key=lambda r: (str(r.doc_id), r.text))
    return ByteCNN().fit([r.text.encode("utf-8", "replace") for r in rows], np.array([r.y for r in rows]))


def score_documents(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every whole text; row by row, no shuffle."""

    def make():
        return lambda texts: [model.scores([t.encode("utf-8", "replace") for t in texts]).astype(np.float64)]

    return map_texts(docs, make, "score double", SMALL_SLICE)


def keep_good(docs: DataFrame, model: ByteCNN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        column = pa.array(texts.fillna(""), pa.string())
        parts = [model.scores([t.encode("utf-8", "replace") for t in run]) for run in byte_slices(column)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.where(score("text") >= threshold)


def training_rows() -> Column:
    return fold_of("doc_id", 4) != 2


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, train(docs, labels, training_rows()))
    return scored.select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
