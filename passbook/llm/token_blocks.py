"""Token ids in patched frame-of-reference blocks.

Documents are encoded, dealt into shards by ranges of doc_id, and written in ascending order of doc_id
(ties by their text's hash). A shard is a run of segments; a segment holds whole documents, about
``SEGMENT_IDS`` ids, and is one row of the file: the documents and their lengths, and one binary value
in the format below. Segments are rows of Parquet files, so Spark's writer commits them, a lost task is
repeated, and any Hadoop file system serves.

A segment's bytes, all little-endian: number of ids and of blocks (uint32 each); per block its minimum
(uint32), its bit width (uint8), its number of exceptions (uint8), and its start in the packed words
(uint32); then all exceptions' places in their blocks (uint8) and values (uint32); then, from a
multiple of 8 bytes on, the packed words (uint64). A block is 128 ids less their minimum, packed at the
width that holds ``COVERED`` of them; ids that need more are in the exception list.

Defined results: null text is empty text; every document ends with the end id, so an empty one has one
id; repeated rows are repeated documents; null ids come first; an empty table makes an empty file.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.bpe import LETTER, NUMBER, OTHER, WHITE, Classes, PieceCache, split_texts
from passbook.llm.common import SMALL_SLICE, map_texts
from passbook.scratch import scratch_folder

BLOCK = 128
COVERED = 115  # of the 128 ids of a block, those that the bit width must hold
SEGMENT_IDS = 1 << 18
END_ID = 2
WORD_BITS = 64


# ---- the block format

def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 numbers below 2 ** width as rows of 2 * width words."""
    out = np.zeros((2 * width, len(values)), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, WORD_BITS)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > WORD_BITS:
            out[word + 1] |= columns[i] >> np.uint64(WORD_BITS - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, len(words)), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, WORD_BITS)
        v = columns[word] >> np.uint64(shift)
        if shift + width > WORD_BITS:
            v = v | (columns[word + 1] << np.uint64(WORD_BITS - shift))
        out[i] = v & mask
    return out.T


def _widths(v: np.ndarray) -> np.ndarray:
    """For each row the least bit width that holds ``COVERED`` of its numbers."""
    width = np.full(len(v), int(v.max(initial=0)).bit_length(), dtype=np.uint8)
    rows = np.arange(len(v))
    for w in range(int(width[0]) - 1 if len(v) else -1, -1, -1):
        rows = rows[(v[rows] >> np.uint32(w) != 0).sum(axis=1) <= BLOCK - COVERED]
        if not len(rows):
            break
        width[rows] = w
    return width


def encode_block_run(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = padded[n - 1]
    v = padded.reshape(blocks, BLOCK)
    least = v.min(axis=1) if blocks else np.empty(0, np.uint32)
    v = v - least[:, None]
    width = _widths(v)
    over = v > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    rows, places = np.nonzero(over)
    values = v[rows, places]
    low = v.copy()
    low[rows, places] = 0
    starts = np.concatenate([[0], np.cumsum(2 * width.astype(np.int64))])
    words = np.zeros(starts[-1], dtype="<u8")
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            words[starts[at][:, None] + np.arange(2 * int(w))] = _pack(low[at], int(w))
    head = b"".join(
        [
            np.array([n, blocks], "<u4").tobytes(), least.astype("<u4").tobytes(), width.tobytes(), over.sum(1).astype(np.uint8).tobytes(),
            starts[:-1].astype("<u4").tobytes(), places.astype(np.uint8).tobytes(), values.astype("<u4").tobytes(),
        ]
    )
    return head + bytes(-len(head) % 8) + words.tobytes()


def decode_block_run(data: bytes) -> np.ndarray:
    n, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8

    def take(kind, count):
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    least, width, count, starts = take("<u4", blocks), take(np.uint8, blocks), take(np.uint8, blocks), take("<u4", blocks)
    places, values = take(np.uint8, int(count.sum())), take("<u4", int(count.sum()))
    words = np.frombuffer(data, "<u8", offset=at + -at % 8)
    v = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            v[rows] = _unpack(words[starts[rows].astype(np.int64)[:, None] + np.arange(2 * int(w))], int(w))
    v[np.repeat(np.arange(blocks), count), places] = values
    return (v + least[:, None]).ravel()[:n]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index of block starts."""
    n, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2))
    least, width = np.frombuffer(data, "<u4", blocks, 8), np.frombuffer(data, np.uint8, blocks, 8 + 4 * blocks)
    count = np.frombuffer(data, np.uint8, blocks, 8 + 5 * blocks)
    starts = np.frombuffer(data, "<u4", blocks, 8 + 6 * blocks)
    total, first = int(count.sum()), int(count[:block].sum())
    at = 8 + 10 * blocks
    places = np.frombuffer(data, np.uint8, int(count[block]), at + first)
    values = np.frombuffer(data, "<u4", int(count[block]), at + total + 4 * first)
    at += 5 * total
    at += -at % 8
    w = int(width[block])
    v = np.zeros((1, BLOCK), dtype=np.uint32)
    if w:
        v = _unpack(np.frombuffer(data, "<u8", 2 * w, at + 8 * int(starts[block]))[None, :], w).astype(np.uint32)
    v[0, places] = values
    return (v[0] + least[block])[: max(0, min(BLOCK, n - block * BLOCK))]


# ---- encoding with the tokenizers library

# The letters that byte-level vocabularies use for bytes. Printable ones stand for themselves, the others
# are numbered from 256 on.
_PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
# the letter of each byte; 255, which no UTF-8 holds, parts pieces by a character that is no letter
_PARTING, _PARTED = b"\xff", "\n"
_LETTER_OF = np.array([BYTE_LETTERS.get(b, b) for b in range(255)] + [ord(_PARTED)], dtype="<u2")
# The split of the library's byte-level step, for texts of Latin-1 characters, with its classes written out.
_LETTERS, _NUMBERS, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
LATIN_PIECE = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_WHITE}{_LETTERS}{_NUMBERS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)


def in_letters(pieces: list[str]) -> list[str]:
    """The bytes of each piece as the letters that byte-level vocabularies use; all pieces in one look-up."""
    if not pieces:
        return []
    data = np.frombuffer(_PARTING.join([p.encode("utf-8", "replace") for p in pieces]), np.uint8)
    return _LETTER_OF[data].tobytes().decode("utf-16-le").split(_PARTED)


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LibraryEncoder:
    """Whole texts through a byte-level BPE file of the tokenizers library, piece by piece with a cache.

    The library splits a text into pieces and merges within a piece only. The split is made here, by one
    pattern for texts of Latin-1 characters and by ``split_texts`` for others, with each character's
    class asked from the library's own splitter; every piece not in the cache is encoded by the library.
    Texts that hold a special token's string, or a file that doesn't work in this way, go to the library
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        split = self.library.pre_tokenizer
        self.by_piece = (
            self.library.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space
            and split.use_regex and isinstance(self.library.model, models.BPE)
        )
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = Classes(self._class_of)
        self.cache = PieceCache(self._encode)

    def _class_of(self, code: int) -> int:
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            return OTHER
        alone = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
        return LETTER if alone(f"a{c}") else NUMBER if alone(f"1{c}") else OTHER if alone(f"!{c}") else WHITE

    def _encode(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece, merged by the library's model, which knows bytes as letters."""
        merge = self.library.model.tokenize
        return [tuple([t.id for t in merge(p)]) for p in in_letters(pieces)]

    def _split(self, texts: list[str]) -> list[list[str]]:
        out = [LATIN_PIECE.findall(t) if is_latin(t) else None for t in texts]
        others = [i for i, pieces in enumerate(out) if pieces is None]
        for i, pieces in zip(others, split_texts([texts[i] for i in others], self.classes) if others else (), strict=True):
            out[i] = pieces
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and where each text's ids end."""
        whole = [not self.by_piece or any(s in t for s in self.special) for t in texts]
        ids, ends = self.cache.flat(self._split(["" if w else t for t, w in zip(texts, whole, strict=True)]))
        if any(whole):
            rows = np.split(ids, ends[:-1])
            for i in np.flatnonzero(whole).tolist():
                rows[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        return ids, ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []


def load(path: str) -> LibraryEncoder:
    """An encoder for one task; workers that are used again keep nothing of it."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return LibraryEncoder(path)


# ---- files

def _shard_bounds(docs: DataFrame, shards: int) -> list:
    """Ids at which shards begin: approximate quantiles of the ids, one aggregate over one column."""
    if shards < 2:
        return []
    cuts = [i / shards for i in range(1, shards)]
    found = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", cuts, 20 * shards)).first()[0]
    return sorted(set(found or ()))


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes every whole text, appends ``end_id``, and writes ``folder``/segments and ``folder``/shards.

    ids travel as 16-bit numbers where the vocabulary allows. The ids are shuffled once, by shard; a
    shard is sorted by doc_id within its task, spilling if need be. ``shards`` holds the number of ids
    before each shard.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _shard_bounds(docs, shards or 4 * parts)

    def make():
        encoder = load(path)

        def run(texts):
            ids, ends = encoder.encode_flat(texts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ids = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            lengths = np.diff(ends, prepend=0) + 1
            bounds = np.concatenate([[0], np.cumsum(lengths)]) * ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
            return [pa.array(lengths, pa.int64()), data.cast(pa.binary()), pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())]

        return run

    encoded = map_texts(docs, make, "n bigint, ids binary, tie bigint", SMALL_SLICE)
    shard = F.lit(0)
    if bounds:
        kind = docs.schema["doc_id"].dataType
        shard = F.coalesce(_bisect(F.col("doc_id"), bounds, kind), F.lit(0))
    placed = encoded.withColumn("shard", shard).repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "tie", "n")
    key = placed.schema["doc_id"].dataType.simpleString()
    _segments(placed, key).write.parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    at, rows = 0, []
    for r in sorted(sizes, key=lambda r: r.shard):  # one row per shard
        rows.append((r.shard, at))
        at += r.n
    spark.createDataFrame(rows, "shard int, start bigint").coalesce(1).write.parquet(f"{folder}/shards")


def _bisect(value, bounds: list, kind):
    """The number of bounds at or below ``value``, by nested comparisons of logarithmic depth."""
    def side(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]).cast(kind), side(lo, mid)).otherwise(side(mid + 1, hi))

    return F.when(value.isNotNull(), side(0, len(bounds)))


def _segments(placed: DataFrame, key: str) -> DataFrame:
    def run(batches):
        shard, number, begins = None, 0, 0
        held: list[tuple] = []
        size = 0

        def emit():
            nonlocal held, size, number, begins
            ids = np.concatenate([np.frombuffer(x, "<u2" if 2 * n == len(x) else "<u4").astype(np.uint32) for _, n, x in held])
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([begins], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.array([[d for d, _, _ in held]], pa.list_(kinds)), pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                    pa.array([encode_block_run(ids)], pa.binary()),
                ],
                ["shard", "segment", "start", "n_ids", "doc_ids", "lengths", "data"],
            )
            number, begins, held, size = number + 1, begins + len(ids), [], 0
            return batch

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for s, d, n, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if held and (s != shard or size + n > SEGMENT_IDS):
                    yield emit()
                if s != shard:
                    shard, number, begins = s, 0, 0
                held.append((d, n, x))
                size += n
        if held:
            yield emit()

    fields = f"shard int, segment int, start bigint, n_ids bigint, doc_ids array<{key}>, lengths array<bigint>, data binary"
    return placed.select("shard", "doc_id", "n", "ids").mapInArrow(run, fields)


def read_ids(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids (or their crc32) of each document."""
    rows = spark.read.parquet(f"{folder}/segments")
    shards = spark.read.parquet(f"{folder}/shards").withColumnRenamed("start", "before")
    key = rows.schema["doc_ids"].dataType.elementType.simpleString()
    # One small row per shard: Spark broadcasts it if it is small enough.
    rows = rows.join(shards, "shard").select((F.col("before") + F.col("start")).alias("start"), "doc_ids", "lengths", "data")

    def run(batches):
        for batch in batches:
            for start, docs, lengths, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_block_run(data).astype("<u4")
                n = np.array(lengths, dtype=np.int64)
                stops = np.cumsum(n)
                pieces = [ids[b - k : b] for b, k in zip(stops.tolist(), lengths, strict=True)]
                last = pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()) if digest_only else pa.array(pieces, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, batch.schema.field("doc_ids").type.value_type), pa.array(start + stops - n), pa.array(n), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"],
                )

    return rows.mapInArrow(run, f"doc_id {key}, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest_only else "ids array<bigint>"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_folder(spark, "token-blocks")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_ids(spark, folder, digest_only=True)
