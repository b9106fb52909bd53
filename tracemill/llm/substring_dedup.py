"""Removes passages that an earlier document has, behind a count-min prefilter.

Pass 1: each block of documents counts its windows in a count-min sketch of
``DEPTH`` rows, sent as the cells it touched; shards of the cells merge the blocks'
sketches.  Merged counts are never too low, so every window that two documents
share is estimated repeated.  Pass 2: windows estimated repeated are grouped
exactly (by 96 hash bits) to find the smallest document that has each.
The sketch's width follows the input, so few other windows get into pass 2 at any
size; if they do, they cost time and no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.blocks import bits, cut_shards, dealt, pack, pow2, text_bytes, unbits, unpack
from tracemill.llm.textnum import U64, Words, freed, freed_pair, mix, slices, windows, with_row, words

WINDOW = 13
DEPTH = 2
#: cells of one sketch row that a shard merges, about
SHARD_CELLS = 4_000_000
LAST = np.iinfo(np.int64).max
SENT = "shard int, block int, cells binary, more binary"
FLAGS = "block int, shard int, flags binary"
ASKED = "shard int, block int, high binary, low binary, least binary"
ANSWERS = "block int, high binary, least binary"


def fields(table: pa.Table, names: list[str], key: str, text: str) -> tuple[np.ndarray, pa.Array]:
    """Keys (null: the largest number) and texts of a block's rows."""
    row = table.column("row").combine_chunks()
    row = pa.concat_arrays(row.chunks) if isinstance(row, pa.ChunkedArray) else row
    ids = pc.fill_null(pc.struct_field(row, [names.index(key)]).cast(pa.int64()), LAST)
    return ids.to_numpy(zero_copy_only=False), pc.struct_field(row, [names.index(text)])


def window_hashes(texts: pa.Array, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Hash (and a second one) of every window, its row, and its first word's place in the row."""
    high, low, rows, places = [], [], [], []
    for a, b in slices(texts):
        found: Words = words(texts.slice(a, b - a))
        values = found.hashes()
        h, at = windows(values, found.first, n, 3)
        row = np.searchsorted(found.first, at, "right") - 1
        high.append(h)
        rows.append(row + a)
        places.append(at - found.first[row])
        if second:
            low.append((windows(mix(values), found.first, n, 4)[0] >> U64(32)).astype(np.uint32))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(high, U64), join(low, np.uint32) if second else None, join(rows, np.int64), join(places, np.int64)


def cells_of(h: np.ndarray, depth_row: int, width_bits: int) -> np.ndarray:
    return mix(h ^ U64(depth_row)) >> U64(64 - width_bits)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, layout: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``window`` words over it also starts in a row with
    a smaller key.  Windows are judged on the input.  With ``layout``, kept_text is the
    text as it is but for the removed words and the white space behind each.

    Defined cases: a null or empty text has no words and an empty kept_text; texts
    shorter than a window stay whole; rows of equal key never remove each other's
    words; a null key counts as larger than every other; an empty table gives an
    empty result.  Columns named as a result are replaced, others pass through.
    """
    made = ("n_words", "n_removed", "kept_text")
    names = [c for c in docs.columns if c not in made or c in (key, text)]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    total = text_bytes(docs, text)
    width_bits = max(16, pow2(total))
    shard_bits = min(width_bits - 8, pow2(total / 6 / SHARD_CELLS))
    blocks = dealt(docs, key, text, total)

    def sketch(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        h, _, rows, _ = window_hashes(fields(table, names, key, text)[1], window)
        out = []
        for depth_row in range(DEPTH):
            cells = cells_of(h, depth_row, width_bits)
            order = np.argsort(cells, kind="stable")
            cells, owner = cells[order], rows[order]
            new = np.concatenate(([True], cells[1:] != cells[:-1]))[: len(cells)]
            at = np.flatnonzero(new)
            other = (owner[1:] != owner[:-1]) & ~new[1:]
            several = np.add.reduceat(np.concatenate(([0], other)), at) > 0 if len(at) else np.zeros(0, bool)
            cells = cells[at]
            for shard, a, b in cut_shards(cells, width_bits, shard_bits):
                steps = np.diff(cells[a:b], prepend=U64(shard) << U64(width_bits - shard_bits)).astype(np.uint32)
                out.append((depth_row << 30 | shard, block, pack(steps), bits(several[a:b])))
        return rows_of(out, SENT)

    def merge(table: pa.Table) -> pa.Table:
        shard, sent = table.column("shard")[0].as_py(), table.to_pydict()
        cells = [np.cumsum(unpack(x, np.uint32), dtype=np.int64) for x in sent["cells"]]
        weight = [1 + unbits(x, len(c)) for x, c in zip(sent["more"], cells, strict=True)]
        _, at = np.unique(np.concatenate(cells), return_inverse=True)
        count = np.bincount(at, np.concatenate(weight))
        ends = np.cumsum([len(c) for c in cells])
        flags = np.split(count[at] >= 2, ends[:-1])
        return rows_of([(b, shard, bits(f)) for b, f in zip(sent["block"], flags, strict=True)], FLAGS)

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_of([], ASKED)
        block = table.column("block")[0].as_py()
        ids, texts = fields(table, names, key, text)
        h, low, rows, _ = window_hashes(texts, window, second=True)
        got = {s: f for s, f in zip(answers.column("shard").to_pylist(), answers.column("flags").to_pylist(), strict=True)}
        hit = np.ones(len(h), bool)
        for depth_row in range(DEPTH):
            cells, at = np.unique(cells_of(h, depth_row, width_bits), return_inverse=True)
            flags = [unbits(got[depth_row << 30 | s], b - a) for s, a, b in cut_shards(cells, width_bits, shard_bits)]
            if flags:
                hit &= np.concatenate(flags)[at]
        h, low, owner = h[hit], low[hit], ids[rows[hit]]
        order = np.lexsort((owner, low, h))
        h, low, owner = h[order], low[order], owner[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))[: len(h)]
        h, low, owner = h[first], low[first], owner[first]
        out = [(s, block, pack(h[a:b]), pack(low[a:b]), pack(owner[a:b])) for s, a, b in cut_shards(h, 64, shard_bits)]
        return rows_of(out, ASKED)

    def group(table: pa.Table) -> pa.Table:
        sent = table.to_pydict()
        h = [unpack(x, U64) for x in sent["high"]]
        owner = np.concatenate([unpack(x, np.int64) for x in sent["least"]])
        both = np.empty(len(owner), [("h", U64), ("low", np.uint32)])
        both["h"], both["low"] = np.concatenate(h), np.concatenate([unpack(x, np.uint32) for x in sent["low"]])
        order = np.lexsort((owner, both["low"], both["h"]))
        ranked = both[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        least = np.empty(len(owner), np.int64)
        least[order] = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        parts = np.split(least, np.cumsum([len(x) for x in h])[:-1])
        return rows_of([(b, pack(x), pack(y)) for b, x, y in zip(sent["block"], h, parts, strict=True)], ANSWERS)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({})
        ids, texts = fields(table, names, key, text)
        known = [unpack(x, U64) for x in answers.column("high").to_pylist()]
        least = [unpack(x, np.int64) for x in answers.column("least").to_pylist()]
        h_known = np.concatenate([*known, np.zeros(0, U64)])
        order = np.argsort(h_known, kind="stable")
        h_known, first_id = h_known[order], np.concatenate([*least, np.zeros(0, np.int64)])[order]
        counts, removed, kept = [], [], []
        for a, b in slices(texts):
            found = words(texts.slice(a, b - a))
            h, at = windows(found.hashes(), found.first, window, 3)
            gone = np.zeros(len(found.start) + 1, np.int64)
            if len(h_known) and len(h):
                place = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
                row = np.searchsorted(found.first, at, "right") - 1
                hit = at[(h_known[place] == h) & (first_id[place] < ids[a + row])]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            blob, total_gone = found.data.tobytes(), np.concatenate(([0], np.cumsum(gone)))[found.first]
            for i in range(b - a):
                own, drop = slice(found.first[i], found.first[i + 1]), int(total_gone[i + 1] - total_gone[i])
                counts.append(int(found.first[i + 1] - found.first[i]))
                removed.append(drop)
                if layout:
                    kept.append(_cut(blob, found, own, gone[own], int(found.offsets[i]), int(found.offsets[i + 1])) if drop else blob[found.offsets[i] : found.offsets[i + 1]])
                    continue
                parts = blob[found.offsets[i] : found.offsets[i + 1]].split()
                if drop:
                    parts = [w for w, g in zip(parts, gone[own].tolist(), strict=True) if not g]
                kept.append(b" ".join(parts))
        row = table.column("row")
        return pa.table({"row": row, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    schema = with_row(blocks.schema["row"].dataType, "n_words long, n_removed long, kept_text string")
    flags = blocks.groupBy("block").applyInArrow(freed(sketch), SENT).groupBy("shard").applyInArrow(freed(merge), FLAGS)
    asked = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(freed_pair(ask), ASKED)
    answers = asked.groupBy("shard").applyInArrow(freed(group), ANSWERS)
    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(freed_pair(remove), schema)
    passed = [c for c in names if c not in made]
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in passed], *made)


def _cut(blob: bytes, found: Words, own: slice, gone: np.ndarray, begin: int, end: int) -> bytes:
    """The bytes of one row without each removed word and the white space behind it."""
    start = found.start[own]
    after = np.append(start[1:], end)
    steps = np.zeros(end - begin + 1, np.int8)
    steps[start[gone] - begin] = 1
    steps[after[gone] - begin] -= 1  # the next word's start, which may be removed too
    return np.frombuffer(blob, np.uint8, end - begin, begin)[np.cumsum(steps[:-1]) == 0].tobytes()


def rows_of(rows: list[tuple], schema: str) -> pa.Table:
    """A table of int and binary columns."""
    kinds = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(list(c), pa.int32() if kind == "int" else pa.binary()) for (name, kind), c in zip(kinds, columns, strict=True)})
