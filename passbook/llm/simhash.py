"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

``fingerprints`` makes 64-bit fingerprints of word shingles. ``link`` finds all pairs of fingerprints
that differ in at most two bits: split into four blocks, such a pair agrees in two blocks at least, so
equal fingerprints are merged first and the rest are joined on the six pairs of blocks and verified.
Groups are the connected components.

``drop_near_copies`` groups by the same links, and adds documents whose sets of five-word shingles have a
similarity (Jaccard) of 0.8 or more, most of which differ in more than two bits: bands of least hashes (MinHash)
name the candidates, whose whole sets are then compared exactly.

Defined results: null text is empty text; texts without words have the fingerprint zero and are linked
like any other; rows that share an id are one document; a null id takes part in no group (its
component is null, and ``drop_near_copies`` keeps the row).
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import SMALL_SLICE, map_texts
from passbook.llm.components import components
from passbook.scratch import scratch_folder, written

SEED = 42
BLOCK_BITS = 16
TABLES = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Fingerprints in one bucket that are compared with each other; larger buckets are linked through
#: shared one-bit neighbours instead, which is exact and grows with the bucket, not with its square.
PAIRED = 1000


def shingle_hashes(text: str, words: int, hashed=xxhash.xxh64_intdigest) -> np.ndarray:
    """Hashes of all shingles of the lower-cased (A-Z) text; fewer words than a shingle make one."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(w) - words + 1)
    parts = map(b" ".join, zip(*(w[i : i + n] for i in range(words)), strict=True)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter((hashed(x, SEED) for x in parts), dtype=np.uint64, count=n)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit, highest bit of the first byte first."""
    total = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for i in range(0, len(rows), 255):  # sums of 255 bits fit a byte
        total += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str, words: int = 3) -> int:
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = bit_counts(h.astype(">u8").view(np.uint8).reshape(-1, 8)) * 2 > len(h)
    return int.from_bytes(np.packbits(ones).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (bigint holding the 64 bits) of every whole text."""
    return map_texts(docs, lambda: lambda texts: [[fingerprint(t, words) for t in texts]], "fingerprint bigint")


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def link(nodes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) that connect all nodes (fp, id) whose fingerprints differ in at most two bits.

    ``fp`` is unique. Pairs of small buckets appear as edges; in a bucket of over ``paired``
    fingerprints each is linked to the least of those that are one flipped bit from a common value,
    which connects the same components.
    """
    fp = F.col("fp")
    keys = [
        F.struct(F.lit(t).alias("t"), (F.lit(t << 32).bitwiseOR(F.shiftleft(_block(fp, a), BLOCK_BITS)).bitwiseOR(_block(fp, b))).alias("key"))
        for t, (a, b) in enumerate(TABLES)
    ]
    entries = nodes.select("fp", "id", F.explode(F.array(*keys)).alias("k")).select("fp", "id", "k.t", "k.key")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > paired).select("key")
    small = entries.join(sizes.where((F.col("n") > 1) & (F.col("n") <= paired)).select("key"), "key")
    x, y = small.alias("x"), small.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    # A pair that agrees in more than two blocks is made in the first of its tables only.
    first = F.lit(False)
    for t, (a, b) in enumerate(TABLES):
        earlier = [_block(differ, j) != 0 for j in range(b) if j != a]
        here = F.col("x.t") == t
        for e in earlier:
            here = here & e
        first = first | here
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(differ) <= 2) & first
    pairs = x.join(y, near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowded = entries.join(big, "key").select("fp", "id").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    around = crowded.select("id", F.explode(flips).alias("bit"), "fp").select("id", fp.bitwiseXOR(F.col("bit")).alias("v"))
    least = around.groupBy("v").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "v").select(F.col("id").alias("a"), "b").where("a <> b")
    return pairs.unionAll(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for rows of (doc_id, fingerprint)."""
    folder = scratch_folder(prints.sparkSession, "simhash")
    prints = written(prints, folder, "prints")
    nodes = prints.where("doc_id is not null").groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("id"))
    nodes = written(nodes, folder, "nodes")
    shared = prints.groupBy("doc_id").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo <> hi")
    shared = prints.join(shared.select("doc_id"), "doc_id").join(nodes, F.col("fingerprint") == F.col("fp"))
    labels = components(link(nodes).unionAll(shared.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    known = nodes.join(labels, nodes["id"] == labels["node"], "left").select("fp", F.coalesce("label", "id").alias("component_id"))
    out = prints.join(known, prints["fingerprint"] == known["fp"], "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = groups(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity of five-word shingles

WIDE_WORDS = 5
#: Least similarity of near copies: shingles in common over shingles of either, as a fraction.
SHARED, OF = 4, 5
#: Keys of a document, and least hashes mixed into each. A pair of similarity s shares a key with
#: probability 1 - (1 - s^6)^32 whatever the size of the sets: 0.99994 at 0.8, 0.9999995 at 0.85.
BANDS, ROWS = 32, 6
#: Most members of a bucket that meet in one task, and most shingles of them; a larger bucket is cut into
#: blocks that meet two by two.
WIDE_TILE, TILE_SHINGLES = 1024, 250_000
#: Shingles of small buckets that share a task's group.
BIN_SHINGLES = 500_000
#: Ids of candidates that go to the documents, which are then not shuffled; more are joined as Spark sees fit.
BROADCAST_IDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDE_WORDS))


def wide_keys(shingles: np.ndarray) -> np.ndarray:
    """A number for each band: its place and the least of the set under each of its hash functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(shingles), 256):
        np.minimum(least, (shingles[a : a + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def block_keys(fp: int) -> np.ndarray:
    """A number for each pair of blocks of a fingerprint; two within two bits agree in one of them at least."""
    blocks = [fp >> (48 - BLOCK_BITS * i) & ((1 << BLOCK_BITS) - 1) for i in range(4)]
    pairs = np.array([(t + 1) << 32 | blocks[a] << BLOCK_BITS | blocks[b] for t, (a, b) in enumerate(TABLES)], dtype=np.uint64)
    return (pairs * _MIX).view(np.int64)


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp: the sorted hashes of the set of shingles, as bytes."""
    return map_texts(docs, lambda: lambda texts: [pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())], "fp binary", SMALL_SLICE)


def _marks(sets: list[np.ndarray]) -> list:
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array([wide_keys(x) for x in sets], pa.list_(pa.int64()))]


def spanning_edges(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, prints: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between near sets, one of ``left`` and one of ``right``, that connect what such pairs connect.

    With ``prints`` fingerprints of at most two differing bits are near as well.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    seen, mark, out = np.zeros(len(sets), dtype=bool), np.zeros(len(values), dtype=bool), []
    alive, flow, cuts = np.arange(len(sets)), codes, ends  # the sets not yet reached, laid end to end
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            open_ = ~seen[alive]
            if 2 * open_.sum() < len(alive):
                alive = alive[open_]
                flow = np.concatenate([own[k] for k in alive]) if len(alive) else codes[:0]
                cuts = np.concatenate([[0], np.cumsum(sizes[alive])])
                open_ = np.ones(len(alive), dtype=bool)
            if not open_.any():
                continue
            mark[own[i]] = True
            common = np.concatenate([[0], np.cumsum(mark[flow])])
            mark[own[i]] = False
            common = common[cuts[1:]] - common[cuts[:-1]]
            near = common * (OF + SHARED) >= SHARED * (sizes[i] + sizes[alive])
            if prints is not None:
                near |= np.bitwise_count(prints[i] ^ prints[alive]) <= 2
            sides = (left[i] & right[alive]) | (right[i] & left[alive])
            found = alive[near & sides & open_]
            seen[found] = True
            out += [(i, int(k)) for k in found]
            queue += found.tolist()
    return out


def wide_candidates(nodes: DataFrame, folder: str, tile: int = WIDE_TILE) -> DataFrame:
    """(id, size, key, blocks) for nodes (id, size, keys): the buckets with company, and into how many blocks each is cut.

    Of buckets that hold the same members one is kept, as the others would make the same pairs.
    """
    entries = nodes.select("id", "size", F.explode("keys").alias("key")).where("id is not null")
    seals = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"seal{k}") for k in range(2)]
    full = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *seals).where("n > 1")
    full = full.groupBy("n", "total", "seal0", "seal1").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    return written(entries.join(full.select("key", blocks.alias("blocks")), "key").select("id", "size", "key", "blocks"), folder, "met")


def verified_links(met: DataFrame, sets: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect all near members of the buckets ``met``, by the whole ``sets`` (id, fp) and, if
    given, by their fingerprints ``prints`` (id, fingerprint).

    The members meet in groups of bounded size: there all pairs of a bucket are compared exactly, and only
    edges of a spanning forest are returned. A bucket of any size is covered; nothing is left out.
    """
    bins = max(1, -(-(met.agg(F.sum("size")).first()[0] or 0) // BIN_SHINGLES))
    placed = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Small buckets share a bin; a tile of a large one is a group by itself.
    placed = placed.select(
        "id", "key", "block",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(bins))).alias("bin"),
        F.when(F.col("blocks") > 1, F.col("key")).alias("large"),
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    ).join(sets.select("id", "fp") if prints is None else sets.select("id", "fp").join(prints, "id"), "id")

    prints_less = prints is None

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        block, whole = table.column("block").to_numpy(), table.column("fp").to_pylist()
        bits = None if prints_less else table.column("fingerprint").to_numpy().view(np.uint64)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        a, b = [], []
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                part = [np.frombuffer(whole[i], dtype=np.uint64) for i in rows]
                for i, j in spanning_edges(part, block[rows] == lo, block[rows] == hi, None if bits is None else bits[rows]):
                    a.append(rows[i])
                    b.append(rows[j])
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    kind = met.schema["id"].dataType.simpleString()
    return placed.groupBy("bin", "large", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")


def wide_links(nodes: DataFrame, folder: str, tile: int = WIDE_TILE) -> DataFrame:
    """Edges (a, b) that connect all nodes (id, fp) which share a key and are near copies."""
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_marks(sets)], ["id", "size", "keys"])

    marked = nodes.select("id", "fp").mapInArrow(run, f"id {kind}, size bigint, keys array<bigint>")
    return verified_links(wide_candidates(marked, folder, tile), nodes)


def wide_marks(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint, a digest of the set of five-word shingles, its size and its keys."""

    def make():
        def marks(texts):
            sets = [shingle_set(t) for t in texts]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets], pa.binary())
            prints = [fingerprint(t) for t in texts]
            size, keys = _marks(sets)
            keys = pa.array([np.concatenate([k, block_keys(f)]) for k, f in zip(keys.to_pylist(), prints, strict=True)], pa.list_(pa.int64()))
            return [pa.array(prints, pa.int64()), digests, size, keys]

        return marks

    return map_texts(docs, make, "fingerprint bigint, digest binary, size bigint, keys array<bigint>", SMALL_SLICE)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with an id: the least id of its group.

    Documents are linked if their fingerprints differ in at most two bits, or if their sets of shingles are
    similar. Candidates share a pair of blocks of the fingerprint or a band of least hashes; texts equal in set
    and fingerprint are merged first. Only documents with a candidate are read again for their whole sets.
    """
    folder = scratch_folder(docs.sparkSession, "near-copies")
    prints = written(wide_marks(docs.where("doc_id is not null")), folder, "prints")
    nodes = prints.groupBy("digest", "fingerprint").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(nodes, folder, "nodes")
    met = wide_candidates(nodes, folder)
    ids = written(met.select(F.col("id").alias("doc_id")).distinct(), folder, "ids")
    again = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    # Dealt by id, as the join that follows needs it, so that the sets are shuffled once.
    sets = wide_fingerprints(again).select(F.col("doc_id").alias("id"), "fp").repartition("id").distinct()
    labels = components(verified_links(met, sets, nodes.select("id", "fingerprint")))
    known = nodes.join(labels, nodes["id"] == labels["node"], "left").select("digest", "fingerprint", F.coalesce("label", "id").alias("component_id"))
    return prints.join(known, ["digest", "fingerprint"]).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    The document with the least id stays. Of rows that share an id, one stays.
    """
    folder = scratch_folder(docs.sparkSession, "drop-copies")
    found = written(near_copies(docs), folder, "groups")
    per_id = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("least"))
    per_id = written(per_id.where("rows > 1 or least <> doc_id"), folder, "copies")
    gone = per_id.where("least <> doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = per_id.where("rows > 1 and least = doc_id").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionAll(once.select(*docs.columns))
