"""Small helpers the operators of this subpackage share."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text handed to numpy at once; bounds the memory of a task whatever the batch size.
SLICE_CHARS = 2_000_000


def crc32_of(value) -> int:
    return zlib.crc32(str(value).encode())


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``: the split between training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def whole_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, null texts as empty; other columns cannot clash with what an operator adds."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of at most ``limit`` characters together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Bytes of text taken out of an Arrow batch at once where a worker's memory counts.
SMALL_SLICE = 500_000


def byte_slices(texts: pa.Array, limit: int = SMALL_SLICE) -> Iterator[list[str]]:
    """The texts of an Arrow column in runs of at most ``limit`` bytes together; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, stop - start).to_pylist()
        start, before = stop, int(ends[stop - 1])


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], fields: str, slice_bytes: int | None = None) -> DataFrame:
    """``doc_id`` and what ``make()(texts)`` returns for each text: one list per field of ``fields``.

    ``make`` runs once per task. Every row is mapped by itself, so a lost task is simply repeated. With
    ``slice_bytes`` only so many bytes of a batch are Python strings at a time.
    """
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = make()
        names = [x.split()[0] for x in fields.split(",")]
        for batch in batches:
            if slice_bytes is None:
                texts = batch.column(1).to_pylist()
                runs = (texts[a:b] for a, b in text_slices(texts))
            else:
                runs = byte_slices(batch.column(1), slice_bytes)
            b = 0
            for run in runs:
                a, b = b, b + len(run)
                columns = score(run)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)],
                    ["doc_id", *names],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, {fields}")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, by_class: bool = True) -> DataFrame:
    """At most ``most`` labelled training documents (of each class, or of all) as (doc_id, text, y), by hash of the id.

    ``train`` is a condition on ``doc_id``. Labels other than 0 and 1 are ignored; of repeated labels
    the largest counts. The chosen ids are at most ``2 * most`` rows, which bounds the broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = None
    for side in (F.col("y") == 0, F.col("y") == 1) if by_class else (F.lit(True),):
        part = known.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    return whole_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam updates of a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        size = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
