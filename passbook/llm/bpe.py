"""Byte-level BPE encoding and decoding.

A text becomes an array of code-point classes. Where a piece starts depends on the state of a small
automaton; every class is a function from state to state, functions compose associatively, and a
prefix scan of compositions gives the state before every character without a regular expression and
without a loop over characters. The slices between boundaries go to cached merging of byte pairs.

Defined results: a null text is an empty text; an empty text has no ids and decodes to no bytes;
repeated rows give repeated results; text that looks like a special token is ordinary text.
"""

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from passbook.llm.common import SMALL_SLICE, map_texts

# Character classes. Those after WHITE depend on neighbouring characters: white space before text, a quote
# that may begin a contraction of one or two letters, and the letters that may end one.
OTHER, LETTER, NUMBER, WHITE, WHITE_END, JOINING_SPACE, SHORT_TAIL, LONG_TAIL, TAIL_LETTER = range(9)
# States: what the last character was part of.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, TAIL_2, TAIL_1, TAIL_DONE = range(8)
# The white space of the Unicode property, and the contractions of the pattern.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT_TAILS = "stmd"
LONG_TAILS = ("re", "ve", "ll")


def _step(state: int, kind: int) -> int:
    if kind == TAIL_LETTER:
        return {TAIL_2: TAIL_1, TAIL_1: TAIL_DONE}.get(state, IN_LETTERS)
    if kind in (SHORT_TAIL, LONG_TAIL):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER
        return TAIL_1 if kind == SHORT_TAIL else TAIL_2
    return {OTHER: IN_OTHER, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, WHITE: IN_WHITE, WHITE_END: IN_WHITE, JOINING_SPACE: AFTER_SPACE}[kind]


def _starts_piece(state: int, kind: int) -> bool:
    if kind == WHITE:
        return state != IN_WHITE
    if kind in (WHITE_END, JOINING_SPACE):
        return True
    if state in (AFTER_SPACE, TAIL_2, TAIL_1):
        return False
    return state != {LETTER: IN_LETTERS, TAIL_LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHER)


def _monoid():
    """All functions the classes generate, their composition table, and which of them are constant."""
    functions = [tuple(_step(s, k) for s in range(8)) for k in range(9)]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    listed = list(functions)
    for f in listed:
        for g in functions:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(listed)
                listed.append(h)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in listed] for f in listed], dtype=np.uint8)
    return compose, np.array([len(set(f)) == 1 for f in listed]), np.array([f[IN_WHITE] for f in listed], dtype=np.uint8)


_COMPOSE, _CONSTANT, _FROM_START = _monoid()
_FLAT, _WIDTH = _COMPOSE.ravel(), _COMPOSE.shape[0]
_BOUNDARY = np.array([[_starts_piece(s, k) if k < 9 else False for k in range(16)] for s in range(8)]).ravel()
_SEPARATOR = "\n"
NO_RANK = 1 << 40


def unicode_class(code: int) -> int:
    if code in WHITE_SPACE:
        return WHITE
    kind = unicodedata.category(chr(code))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


class Classes:
    """Classes of code points, asked of ``of`` once for each code point met."""

    def __init__(self, of: Callable[[int], int] = unicode_class):
        self.of, self.table = of, np.full(0x110000, 255, dtype=np.uint8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.table[codes]
        if (kinds == 255).any():
            for code in np.unique(codes[kinds == 255]):
                self.table[code] = self.of(int(code))
            kinds = self.table[codes]
        return kinds


def scan_states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after each character, by doubling compositions until all are constant."""
    found, reach = kinds.copy(), 1
    open_at = np.flatnonzero(~_CONSTANT[found])
    while True:
        # A constant function stays as it is whatever precedes it, so only the others are composed.
        open_at = open_at[(open_at >= reach) & ~_CONSTANT[found[open_at]]]
        if not len(open_at):
            break
        found[open_at] = _FLAT[found[open_at - reach].astype(np.int32) * _WIDTH + found[open_at]]
        reach *= 2
    return _FROM_START[found]


def split_texts(texts: list[str], classes: Classes) -> list[list[str]]:
    """The pieces of each text, in order; joined, they are the text."""
    joined = _SEPARATOR.join(texts) + _SEPARATOR
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kinds = classes(codes)
    white = kinds == WHITE
    before_text = np.zeros(len(codes), dtype=bool)
    before_text[:-1] = white[:-1] & ~white[1:]
    before_text[ends] = False
    kinds = kinds.copy()
    kinds[before_text] = np.where(codes[before_text] == 32, JOINING_SPACE, WHITE_END)
    quotes = np.flatnonzero(codes[:-2] == 39) if len(codes) > 2 else np.empty(0, dtype=np.int64)
    if len(quotes):
        a, b = codes[quotes + 1], codes[quotes + 2]
        short = quotes[np.isin(a, [ord(tail) for tail in SHORT_TAILS])]
        long = quotes[np.any([(a == ord(x)) & (b == ord(y)) for x, y in LONG_TAILS], axis=0)]
        kinds[short], kinds[long] = SHORT_TAIL, LONG_TAIL
        kinds[np.concatenate([short + 1, long + 1, long + 2])] = TAIL_LETTER
    states = scan_states(kinds)
    keys = kinds.copy()
    keys[1:] |= states[:-1] << 4
    keys[0] |= IN_WHITE << 4
    starts = _BOUNDARY[keys]
    first = ends - lengths
    starts[ends] = True
    starts[first] = True
    at = np.flatnonzero(starts)
    bounds = at.tolist()
    pieces = [joined[a:b] for a, b in zip(bounds, [*bounds[1:], len(joined)], strict=True)]
    lo, hi = np.searchsorted(at, first).tolist(), np.searchsorted(at, ends).tolist()
    return [pieces[a:b] for a, b in zip(lo, hi, strict=True)]


def merge_pairs(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the pair of lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(data)
    if whole is not None:
        return (whole,)
    if len(data) > 48:
        return _merge_long(data, ranks)
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [ranks.get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
    while pairs:
        low = min(pairs)
        if low == NO_RANK:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return tuple(map(ranks.__getitem__, parts))


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for long pieces, in the order of a heap instead of a search for each merge."""
    n = len(data)
    end = list(range(1, n + 1))  # where the part that starts here ends
    previous = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            previous[stop] = i
            r = ranks.get(data[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = previous[i]
        if p >= 0:
            r = ranks.get(data[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return tuple(out)


class PieceCache:
    """Ids of pieces: a number for each piece, and all pieces' ids in one array.

    When over ``limit`` pieces are held, those met only once since the last time go, so memory is
    bounded and frequent pieces stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[tuple[int, ...]]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self._reset({}, np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64))

    def _reset(self, slots: dict[str, int], ids: np.ndarray, bounds: np.ndarray, hits: np.ndarray) -> None:
        self.slots, self.store, self.bounds, self.hits = slots, ids, bounds, hits

    def _add(self, pieces: list[str]) -> None:
        made = self.encode(pieces)
        first = len(self.bounds) - 1
        self.slots.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        fresh = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(sizes.sum()))
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self._reset(self.slots, np.concatenate([self.store, fresh]), bounds, np.concatenate([self.hits, np.zeros(len(made), np.int64)]))

    def _shrink(self) -> None:
        keep = self.hits > 1
        number = np.cumsum(keep) - 1
        kept, at = keep.tolist(), number.tolist()
        slots = {p: at[i] for p, i in self.slots.items() if kept[i]}
        sizes = np.diff(self.bounds)
        self._reset(slots, self.store[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), self.hits[keep] // 2)

    def flat(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and where each text's ids end."""
        pieces = list(chain.from_iterable(split))
        if len(self.slots) > self.limit or len(self.store) > 8 * self.limit:
            self._shrink()
        at = np.fromiter(map(self.slots.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        open_at = np.flatnonzero(at < 0).tolist()
        if open_at:
            self._add(list(dict.fromkeys(pieces[i] for i in open_at)))
            at[open_at] = [self.slots[pieces[i]] for i in open_at]
        self.hits += np.bincount(at, minlength=len(self.hits))
        sizes = np.diff(self.bounds)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.store[np.repeat(self.bounds[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))]


class ByteBPE:
    """Encoder and decoder of a rank file (``base64 rank`` lines)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.numerals = [str(i) for i in range(len(self.tokens))]
        self.classes = Classes()
        self.cache = PieceCache(lambda pieces: [merge_pairs(p.encode("utf-8", "replace"), self.ranks) for p in pieces])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.cache.flat(split_texts(texts, self.classes))
        flat, at, out = ids.tolist(), 0, []
        for end in ends.tolist():
            out.append(flat[at:end])
            at = end
        return out

    def encode_with_offsets(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids of one text and the byte offset at which each id's bytes start; the last is the length."""
        ids = self.encode([text])[0]
        return ids, np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids], dtype=np.int64)]).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load(path: str) -> ByteBPE:
    """An encoder for one task; workers that are used again keep nothing of it."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary: the bytes the ids stand for) of every whole text.

    ``path`` is a rank file that every executor can open. Row by row, no shuffle.
    """

    def make():
        bpe = load(path)

        def run(texts):
            ids = bpe.encode(texts)
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())]

        return run

    return map_texts(docs, make, "ids array<int>, decoded binary", SMALL_SLICE)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, without moving the ids."""

    def make():
        bpe = load(path)

        def run(texts):
            ids = bpe.encode(texts)
            numerals = bpe.numerals.__getitem__
            return [
                list(map(len, ids)),
                [hashlib.sha256(",".join(map(numerals, x)).encode()).hexdigest() for x in ids],
                [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            ]

        return run

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", SMALL_SLICE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
