"""Words of whole Arrow columns as numpy arrays.

The operators of this package share one notion of a word: a maximal run of bytes
other than space, tab, line feed, vertical tab, form feed and carriage return.
UTF-8 never uses those bytes inside a longer character, so words are found on
bytes.  A word's hash is a multilinear hash: a sum of its bytes, each times a
fixed pseudo-random number of its place, then mixed.  Two different words meet
with a chance of at most 2**-57.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: what a byte weighs in a word's hash; spaces weigh nothing
WEIGHT = np.arange(1, 257, dtype=U64)
WEIGHT[IS_SPACE] = 0
#: bytes hashed at a time
CHUNK = 1 << 20
#: bytes of text that a task turns into arrays at a time
SLICE = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random odd 64-bit numbers, the same for the same seed."""
    return mix(np.arange(n, dtype=U64) + U64(seed << 32)) | U64(1)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks may keep several
        column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a column: row i has words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.start), U64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK)))
            start, begin = self.start[at:to], int(self.start[at])
            stop = int(self.end[to - 1])
            place = np.arange(stop - begin) - np.repeat(start - begin, np.diff(start, append=stop))
            terms = WEIGHT[self.data[begin:stop]]
            terms *= odd_numbers(int(place.max()) + 1, seed)[place]
            out[at:to] = np.add.reduceat(terms, start - begin)
            at = to
        return mix(out + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """The words of every row, none for null; ``lower`` lower-cases A to Z first."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    black = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=black[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(black[1:] & (cut | ~black[:-1]))
    end = np.flatnonzero(black[:-1] & (cut | ~black[1:]))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(values: np.ndarray, first: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` values inside a row, and the place each run starts at."""
    total = len(values) - n + 1
    if total <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(total, U64)
    for k, factor in enumerate(odd_numbers(n, seed)):
        out += values[k : k + total] * factor
    left = np.repeat(first[1:], np.diff(first))[:total] - np.arange(total)
    at = np.flatnonzero(left >= n)
    return mix(out[at]), at


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system, where the C library can; a worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def freed(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that leaves no free memory behind."""

    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        release()
        return out

    return run


def freed_pair(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        release()
        return out

    return run


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text (of a struct: its field text), one row at least."""
    strings = pc.struct_field(column, ["text"]) if pa.types.is_struct(column.type) else column
    lengths = pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, to
        at = to


def with_row(row: T.DataType | None, schema: str) -> T.StructType:
    """``schema`` after a column ``row`` of rows that pass through as they are."""
    return T.StructType([*([T.StructField("row", row)] if row else []), *T.StructType.fromDDL(schema).fields])


def map_text(docs: DataFrame, text: str, schema: str, measure: Callable[[pa.Array], dict], keep: list[str] | None = None) -> DataFrame:
    """``docs`` with new columns that ``measure`` makes from slices of the text column.

    Columns pass through (or those of ``keep``); one named as a new column is
    replaced.  Rows never leave their partition and texts are never copied.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    sent = kept if text in kept else [*kept, text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in sent]).alias("row"))
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")).schema["row"].dataType if kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            column = pc.struct_field(row, [sent.index(text)])
            for a, b in slices(column):
                found = measure(column.slice(a, b - a))
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()]
                if kept:
                    parts = [pc.struct_field(row.slice(a, b - a), [i]) for i in range(len(kept))]
                    arrays.insert(0, pa.StructArray.from_arrays(parts, fields=[row.type.field(i) for i in range(len(kept))]))
                yield pa.RecordBatch.from_arrays(arrays, [*["row"] * bool(kept), *found])
                del found, arrays
            release()

    done = packed.mapInArrow(run, with_row(kind, schema))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *names)
