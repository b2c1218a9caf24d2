"""Byte-level BPE: text to ids and back, by a vocabulary of ranks.

Texts are cut without regular expressions. Each code point becomes one of ten symbols (letter, number, white space
before something solid, apostrophe that may open a contraction, ...), and an automaton of eight states says before
which symbols a piece begins. A symbol's effect is a function from state to state; functions compose associatively, so
the text is cut into equal rows, every row's function is found for all states at once, the rows are scanned, and a last
pass over known states yields the cuts. Pieces are looked up in a cache; those not in it are merged together, the
lowest rank of each piece per step.

Null and empty texts give no ids. The cut equals that of the pattern published with the vocabulary::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weft.llm.kernels import runs, text_bytes

# what a code point is, and the symbols that follow from it and its right neighbours
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG, RESET = range(9)
# what the automaton has just read: nothing it may go on with, a run of its kind, the space before a run, white space
# that may go on, a contraction of which one or two letters are to come
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
#: White_Space of the Unicode character database: fixed values.
WHITE_POINTS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                0x3000)
ROW = 256
#: Pieces kept per Python worker, about 150 bytes each.
CACHE = 250_000
LONG_PIECE = 64
_SPREAD = 0x9E3779B97F4A7C15
#: Bytes of text that are cut into pieces at a time.
CHUNK = 1 << 19
#: Rows that are decoded at a time.
DECODE_ROWS = 128


@cache
def _point_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for p in range(0x110000):
        c = unicodedata.category(chr(p))[0]
        if c == "L":
            kinds[p] = LETTER
        elif c == "N":
            kinds[p] = NUMBER
    kinds[list(WHITE_POINTS)] = WHITE
    return kinds


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        after[symbol] = run
        begins[symbol, [run, AFTER_SPACE]] = False
    after[LETTER, [ONE_MORE, TWO_MORE]] = FRESH, ONE_MORE
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    after[SPACE_LAST] = AFTER_SPACE
    after[WHITE_LAST] = FRESH
    after[WHITE] = IN_WHITE
    begins[WHITE, IN_WHITE] = False
    for symbol, pending in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        after[symbol] = pending
        after[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[symbol, [IN_OTHER, AFTER_SPACE]] = False
    after[RESET] = FRESH
    begins[RESET] = False
    return after, begins


def _symbols(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    kinds = _point_kinds()[points]
    kinds[borders] = RESET
    out = kinds.copy()
    white = np.flatnonzero(kinds[:-1] == WHITE)
    last = white[(kinds[white + 1] != WHITE) & (kinds[white + 1] != RESET)]
    out[last] = np.where(points[last] == 0x20, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero(points[:-1] == 0x27)
    one = points[quote + 1]
    two = points[np.minimum(quote + 2, len(points) - 1)]
    out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[quote[pairs]] = LONG
    return out


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin. ``borders``: positions of the marks between texts, one of them the last."""
    symbols = _symbols(points, borders)
    after, begins = _automaton()
    n = len(symbols)
    rows = -(-n // ROW)
    grid = np.full(rows * ROW, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    # each row's function, for all states at once
    flat = after.reshape(-1)
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        function = flat[(column.astype(np.int16) * 8)[:, None] + function]
    # scan over the functions: doubling steps of composition
    step = 1
    while step < rows:
        function[step:] = np.take_along_axis(function[step:], function[:-step], 1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = function[:-1, FRESH]
    cut = np.empty((ROW, rows), bool)
    flat_begins = begins.reshape(-1)
    for i, column in enumerate(grid):
        at = column.astype(np.int16) * 8 + state
        cut[i] = flat_begins[at]
        state = flat[at]
    return np.flatnonzero(cut.T.reshape(-1)[:n])


class _Places(dict):
    """Number of each known piece; an unknown one is numbered and remembered as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Vocabulary:
    """Ranks of byte strings, with the cache of merged pieces."""

    def __init__(self, content: bytes) -> None:
        lines = [line.split() for line in content.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._forget()

    def _joins(self) -> dict[int, int]:
        """Rank by the two ids that make it; needed only until the table holds it."""
        out = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    out[a << 32 | b] = rank
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The joins with open addressing: keys, ranks, and how many slots from its own a key may lie."""
        joins = self._joins()
        self.bits = max(4, (len(joins) * 4).bit_length())
        held = np.full((1 << self.bits) + 64, -1, np.int64)
        joined, reach = np.zeros(len(held), np.int32), 1
        keys = np.array(sorted(joins), np.int64)
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            at = slot
            while held[at] >= 0:
                at += 1
            held[at], joined[at] = key, joins[key]
            reach = max(reach, at - slot + 1)
        return held, joined, reach

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _join(self, a: int, b: int) -> int | None:
        """The rank that two ids make, if they make one."""
        held, joined, reach = self.table
        key = a << 32 | b
        slot = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        hit = np.flatnonzero(held[slot:slot + reach] == key)
        return int(joined[slot + hit[0]]) if len(hit) else None

    def _forget(self) -> None:
        self.place = _Places()
        self.start = np.zeros(1, np.int64)  # of each cached piece in ids, and the end of the last
        self.ids = np.zeros(0, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each join; a padded side (-1) makes a key below zero, which no slot of the table holds."""
        keys, joined, reach = self.table
        key = np.where(right >= 0, left << 32 | right, -2)
        slot = self._slot(key)
        out = np.full(key.shape, np.iinfo(np.int64).max)
        for i in range(reach):
            hit = keys[slot + i] == key
            out[hit] = joined[slot + i][hit]
        return out

    def _merge_table(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row; rows are padded with -1 on the right."""
        out, live = np.full_like(ids, -1), np.arange(len(ids))
        work, none = ids, np.iinfo(np.int64).max
        ranks = self._rank(work[:, :-1], work[:, 1:])
        while len(live):
            best = ranks.argmin(1)  # the leftmost of the lowest
            rank = ranks[np.arange(len(live)), best]
            done = rank == none
            if done.any():
                out[live[done], :work.shape[1]] = work[done]
                keep = ~done
                live, work, best, rank, ranks = live[keep], work[keep], best[keep], rank[keep], ranks[keep]
                if not len(live):
                    break
            row, column = np.arange(len(live)), np.arange(work.shape[1])
            work = np.take_along_axis(work, np.minimum(column + (column > best[:, None]), work.shape[1] - 1), 1)
            work[row, best] = rank
            work[:, -1] = -1
            pair = column[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(pair + (pair > best[:, None]), len(pair) - 1), 1)
            ranks[:, -1] = none
            after = np.minimum(best + 1, work.shape[1] - 1)
            ranks[row, np.minimum(best, len(pair) - 1)] = np.where(
                best + 1 < work.shape[1], self._rank(work[row, best], work[row, after]), none)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._rank(work[left, best[left] - 1], work[left, best[left]])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece by a heap over linked neighbours."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        known: dict[tuple[int, int], int | None] = {}  # long pieces repeat few pairs

        def join(a: int, b: int) -> int | None:
            if (a, b) not in known:
                known[a, b] = self._join(a, b)
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := join(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = rank, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := join(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if alive[i]]

    def _learn(self, new: list[str]) -> None:
        """Merge pieces that are new in the cache, and keep them in their order."""
        coded = [p.encode() for p in new]
        rank = np.fromiter((self.ranks.get(p, -1) for p in coded), np.int64, len(coded))
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        data = self.single[np.frombuffer(b"".join(coded), np.uint8)]
        offset = np.cumsum(length) - length
        size = np.where(rank >= 0, 1, 0)
        parts = [(np.flatnonzero(rank >= 0), rank[rank >= 0])]
        for i in np.flatnonzero((rank < 0) & (length > LONG_PIECE)).tolist():
            ids = self._merge_long(coded[i])
            size[i] = len(ids)
            parts.append((np.full(1, i), np.array(ids, np.int64)))
        rest = np.flatnonzero((rank < 0) & (length <= LONG_PIECE))
        rest = rest[np.argsort(length[rest], kind="stable")]
        for lo in range(0, len(rest), 1 << 13):
            own = rest[lo:lo + (1 << 13)]
            column = np.arange(length[own[-1]])
            inside = column < length[own][:, None]
            table = np.where(inside, data[np.minimum(offset[own][:, None] + column, len(data) - 1)], -1)
            merged = self._merge_table(table)
            solid = merged >= 0
            size[own] = solid.sum(1)
            parts.append((own, merged[solid]))
        start = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        for members, values in parts:
            count = size[members]
            ends = np.cumsum(count)
            ids[np.repeat(start[members] - (ends - count), count) + np.arange(len(values))] = values
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each piece."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.place) > CACHE:
            self._forget()
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        if self.place.new:
            self._learn(self.place.new)
            self.place.new = []
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])], size

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """The vocabulary of a rank file, built once per Python worker."""
    key = zlib.crc32(content)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


def load_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes (under a megabyte for 50,000 ranks) for every executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_runs(texts: pa.Array, vocab: Vocabulary) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """By runs of rows: the first row, the row after the last, ids, and the byte offset at which each id begins."""
    data, offsets = text_bytes(texts)
    for lo, hi in runs(offsets, CHUNK):
        own = offsets[lo:hi + 1]
        decoded = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(own[:-1], own[1:], strict=True)]
        text = "\0".join(decoded) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        borders = np.cumsum(np.fromiter(map(len, decoded), np.int64, len(decoded)) + 1) - 1
        starts = piece_starts(points, borders)
        ends = np.append(starts[1:], len(points))[:len(starts)]
        if len(starts):
            ends = np.minimum(ends, borders[np.searchsorted(borders, starts)])
        pieces = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, size = vocab.encode(pieces)
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, np.concatenate([[0], borders + 1]))]
        length = vocab.lengths[ids].astype(np.int64)
        before = np.cumsum(length) - length
        begins = before - np.repeat(np.append(before, 0)[upto[:-1]], np.diff(upto))
        bounds = pa.array(upto, pa.int32())
        yield (lo, hi, pa.ListArray.from_arrays(bounds, pa.array(ids)),
               pa.ListArray.from_arrays(bounds, pa.array(begins.astype(np.int32))))


def _with_columns(df: DataFrame, drop: list[str], new: list[T.StructField]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + new)


def encode(df: DataFrame, ranks: Broadcast, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``df`` with ``text`` replaced by its ids and by the byte offset of each id in the text.

    Columns already called ``ids`` or ``offsets`` are replaced.
    """
    kept = [c for c in df.columns if c not in (text, ids, offsets)]
    ints = T.ArrayType(T.IntegerType())
    schema = _with_columns(df, [text, ids, offsets], [T.StructField(ids, ints), T.StructField(offsets, ints)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, a, b in encode_runs(batch.column(text), vocabulary(ranks.value)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), a, b],
                                                 [*kept, ids, offsets])

    return df.select(*kept, text).mapInArrow(task, schema)


def decode(df: DataFrame, ranks: Broadcast, ids: str = "ids", offsets: str = "offsets", out: str = "bytes") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for; each id has to begin where ``offsets`` says."""
    kept = [c for c in df.columns if c not in (ids, offsets, out)]
    schema = _with_columns(df, [ids, offsets, out], [T.StructField(out, T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            vocab = vocabulary(ranks.value)
            for at in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                column, begins = batch.column(ids), batch.column(offsets)
                values = column.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(vocab.lengths[values], dtype=np.int64)])
                bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
                if not np.array_equal(ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds)),
                                      begins.flatten().to_numpy()):
                    raise ValueError("offsets do not fit the ids")
                rows = [vocab.decode(values[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(),
                                                                          strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.binary())],
                                                 [*kept, out])

    return df.select(*kept, ids, offsets).mapInArrow(task, schema)
