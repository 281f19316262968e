"""Nearest vectors by inner product over learned partitions (Dong, Indyk, Razenshteyn, Wagner 2020).

A neighbour graph of a bounded sample is cut into parts of equal size by recursive bisection, exchanging
nodes as long as that cuts fewer edges. A small network learns to predict, from a vector, how its
neighbours are spread over the parts. Every vector is indexed under its most probable part; a query
goes to its several most probable parts and is compared there with every vector, in double precision.
How many parts a query visits is chosen on held-out sample vectors so that the recall asked for is met.

Parts are cut into blocks of bounded size, and so are the queries of a part; a task compares one block of
vectors with one of queries, so a part that holds most rows is many tasks, and a vector is copied only as
often as the queries routed to its own part fill blocks.

Defined results: vectors that are null, all zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows without an id; rows that repeat an id
are rows of their own, as candidates and, with ranks of their own, as queries; equal scores go by the
smaller id; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passbook.llm.common import Adam
from passbook.scratch import scratch_folder, written

SAMPLE = 8192  # bound of the vectors the parts are learned from
TESTED = 512  # sample vectors held out to choose the number of parts visited
PARTS, PER_PART = 32, 64  # most parts, and least sample vectors of one
NEIGHBOURS, HIDDEN, STEPS = 20, 96, 400
RECALL = 0.94  # asked for on the held-out sample vectors
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & sound)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.empty((0, 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k rows of largest inner product, itself left out."""
    out = []
    for a in range(0, len(x), 256):
        scores = x[a : a + 256] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(graph: np.ndarray, x: np.ndarray, rows: np.ndarray, rng, rounds: int = 12) -> np.ndarray:
    """True for the half of ``rows`` on one side of a balanced cut of few edges."""
    inside = np.full(len(graph), -1)
    inside[rows] = np.arange(len(rows))
    near = inside[graph[rows]]
    known = near >= 0
    # A start along the main axis of variation, found by power iteration.
    centred = x[rows] - x[rows].mean(0)
    axis = rng.normal(size=x.shape[1])
    for _ in range(8):
        axis = centred.T @ (centred @ axis)
        axis /= np.linalg.norm(axis) + 1e-12
    side = np.zeros(len(rows), dtype=bool)
    side[np.argsort(centred @ axis, kind="stable")[: len(rows) // 2]] = True
    back = np.repeat(np.arange(len(rows)), known.sum(1))
    ends = near[known]
    for turn in range(rounds):
        sign = np.where(side, 1.0, -1.0)
        pull = np.bincount(back, sign[ends], len(rows)) + np.bincount(ends, sign[back], len(rows))
        gain = -sign * pull  # edges gained by changing sides
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        good = int((gain[a[:n]] + gain[b[:n]] > 0).sum())
        if not good:
            break
        move = max(1, good // (2 + turn))  # fewer at a time, as moves change each other's gains
        side[a[:move]], side[b[:move]] = False, True
    return side


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A part for each row; parts differ in size by a few rows. ``parts`` is a power of two."""
    rng, label = np.random.default_rng(seed), np.zeros(len(x), dtype=np.int64)
    width = 1
    while width < parts:
        for part in range(width):
            rows = np.flatnonzero(label == part)
            label[rows[bisect(graph, x, rows, rng)]] += width
        width *= 2
    return label


class Router:
    """Probabilities of the parts for a vector: one hidden layer, trained on the spread of its neighbours."""

    def __init__(self, dim: int, parts: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.p = {
            "in": rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)), "shift": np.zeros(HIDDEN),
            "out": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), "direct": np.zeros((dim, parts)), "bias": np.zeros(parts),
        }
        self.visits = parts
        self.scale = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-300) * self.scale
        hidden = np.maximum(x @ self.p["in"] + self.p["shift"], 0)
        return hidden @ self.p["out"] + x @ self.p["direct"] + self.p["bias"]

    def fit(self, x: np.ndarray, spread: np.ndarray, steps: int = STEPS, seed: int = 4) -> "Router":
        self.scale = float(np.sqrt(x.shape[1]))
        rng, adam, p = np.random.default_rng(seed), Adam(self.p, 0.01), self.p
        unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-300) * self.scale
        for step in range(steps):
            pick = rng.integers(0, len(x), 256)
            b = unit[pick]
            raw = b @ p["in"] + p["shift"]
            hidden = np.maximum(raw, 0)
            z = hidden @ p["out"] + b @ p["direct"] + p["bias"]
            q = np.exp(z - z.max(1, keepdims=True))
            d = (q / q.sum(1, keepdims=True) - spread[pick]) / len(pick)
            dh = np.where(raw > 0, d @ p["out"].T, 0)
            adam.step({"in": b.T @ dh, "shift": dh.sum(0), "out": hidden.T @ d, "direct": b.T @ d, "bias": d.sum(0)}, 0.01 * (1 - step / steps) + 1e-4)
        return self

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def route(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.visits]


def learn(x: np.ndarray, recall: float = RECALL) -> Router:
    """A router from sample vectors; a part of them is held out to choose how many parts are visited."""
    held = min(TESTED, len(x) // 5)
    tested, x = x[:held], x[held:]
    parts = 1
    while parts * 2 <= PARTS and parts * 2 * PER_PART <= len(x):
        parts *= 2
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router
    k = min(NEIGHBOURS, len(x) - 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(graph, x, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1.0 / k)
    np.add.at(spread, (np.arange(len(x)), label), 0.5)
    router.fit(x, spread / spread.sum(1, keepdims=True))
    home = router.part_of(x)
    best = np.concatenate([np.argpartition(-(tested[a : a + 128] @ x.T), k - 1, axis=1)[:, :k] for a in range(0, held, 128)])
    place = np.argsort(np.argsort(-router.logits(tested), axis=1), axis=1)
    needed = np.take_along_axis(place, home[best], 1)
    found = [(needed < m).mean() for m in range(1, parts + 1)]
    router.visits = next((m + 1 for m, f in enumerate(found) if f >= recall), parts)
    return router


def top_of(query_rows, queries, rows, ids, vectors, k: int):
    """Places of the queries, ids and scores: per query its k nearest of a block, by (score, smaller id), its own row left out."""
    out_q, out_v, out_s = [], [], []
    order = np.lexsort((rows, ids))
    rows, ids, vectors = rows[order], ids[order], np.ascontiguousarray(vectors[order])
    for a in range(0, len(queries), 256):
        scores = queries[a : a + 256] @ vectors.T
        for i, row in enumerate(scores):
            own = query_rows[a + i]
            row[rows == own] = -np.inf
            if len(row) > k:
                # Sums in another order may differ in the last bits: all near the k-th are scored again.
                least = np.partition(row, len(row) - k)[len(row) - k]
                near = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
            else:
                near = np.arange(len(row))
            near = near[rows[near] != own]
            exact = (vectors[near] * queries[a + i]).sum(1)
            pick = np.lexsort((ids[near], -exact))[:k]
            out_q.append(np.full(len(pick), a + i))
            out_v.append(ids[near[pick]])
            out_s.append(exact[pick])
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.float64)


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector for which ``is_query`` holds.

    ``vectors`` has vec_id (an integer) and embedding; ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    folder = scratch_folder(spark, "ann")
    # Stored, the row numbers stay what they are.
    rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), folder, "usable")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return none
    rows = rows.where(F.size("embedding") == sizes["dim"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow()
    router = learn(_matrix(sample.column("embedding")), recall)

    fields = "vec_id bigint, embedding array<double>, row bigint, part int"
    names = ["vec_id", "embedding", "row", "part"]

    def place(batches):
        for batch in batches:
            if len(batch):
                part = router.part_of(_matrix(batch.column("embedding"))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names)

    def route(batches):
        for batch in batches:
            if len(batch):
                parts = router.route(_matrix(batch.column("embedding")))
                at = np.repeat(np.arange(len(batch)), parts.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(parts.ravel().astype(np.int32))], names)

    indexed = written(rows.mapInArrow(place, fields), folder, "indexed")
    asked = written(indexed.where(is_query).drop("part").mapInArrow(route, fields), folder, "asked")
    sizes = lambda table: {r["part"]: r["count"] for r in table.groupBy("part").count().collect()}
    held, wanted = sizes(indexed), sizes(asked)  # a number per part
    met = sorted(held.keys() & wanted.keys())
    if not met:
        return none

    def blocks(counts, size):
        pairs = [F.lit(x) for part in met for x in (part, -(-counts[part] // size))]
        return F.element_at(F.create_map(*pairs), F.col("part"))

    share = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_part = F.col("part").isin(met)
    many, tiled = blocks(held, BLOCK_VECTORS), blocks(wanted, BLOCK_QUERIES)
    tiles = indexed.where(of_part).withColumn("block", share(many, 1)).withColumn("tile", every(tiled))
    asked = asked.where(of_part).withColumn("tile", share(tiled, 2)).withColumn("block", every(many))
    keys = ["part", "block", "tile"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        at, v, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        column = lambda t, name: t.column(name).to_numpy()
        if len(left) and len(right):
            sides = column(left, "row"), _matrix(left.column("embedding")), column(right, "row"), column(right, "vec_id"), _matrix(right.column("embedding"))
            at, v, s = top_of(*sides, k)
        return pa.table({
            "query_row": pa.array(column(left, "row")[at] if len(at) else at, pa.int64()), "query_id": pa.array(column(left, "vec_id")[at] if len(at) else at, pa.int64()),
            "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64()),
        })

    found = asked.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(compare, "query_row bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
