"""Near-duplicates by SetSketch registers, and their connected components.

A document is the set of its word shingles.  Register i of its sketch is
``1 + floor(-log_B(x_i))``, cut to 16 bits, where x_i is the smallest of
exponential variates of its shingles: registers are mergeable by maximum, and two
sets agree in one with about the chance of their Jaccard similarity.  Bands of
registers name candidates, the joint likelihood of two sketches drops the hopeless
ones, and full sets decide.  At similarity 0.8 the bands miss one pair in 7 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage
from tracemill.llm.linking import MOST_BROADCAST, classes_of, confirmed, connected, digests, one_key, result, shingle_sets  # noqa: F401
from tracemill.llm.textnum import U64, map_text, mix, odd_numbers, release

BANDS, BAND_ROWS = 40, 5
REGISTERS = BANDS * BAND_ROWS
B, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
FLIP, FACTOR = mix(odd_numbers(REGISTERS, 21)), odd_numbers(REGISTERS, 22)
STEP = 512
#: candidates estimated this far below the threshold are dropped: five deviations
SLACK = 0.14
GRID = np.linspace(0, 1, 101)


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers of one non-empty set."""
    least = np.full(REGISTERS, np.iinfo(U64).max, U64)
    for at in range(0, len(items), STEP):
        part = (items[at : at + STEP, None] ^ FLIP) * FACTOR
        np.minimum(least, part.min(axis=0), out=least)
    unit = ((least >> U64(11)).astype(float) + 0.5) / 2.0**53
    drawn = -np.log1p(-unit) / RATE
    return np.clip(np.floor(1 - np.log(drawn) / np.log(B)), 0, LIMIT).astype(np.uint16)


def likely(u_regs: np.ndarray, v_regs: np.ndarray, u_size: np.ndarray, v_size: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches with known set sizes."""
    above = (u_regs > v_regs).sum(1)[:, None]
    below = (u_regs < v_regs).sum(1)[:, None]
    u = (u_size / (u_size + v_size))[:, None]
    v = 1 - u
    j = GRID * np.minimum(u / v, v / u)
    chance = lambda x: np.clip(-np.log1p(-x * (B - 1) / B) / np.log(B), 1e-12, 1)
    up, down = chance(u - v * j), chance(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    fit = above * np.log(up) + below * np.log(down) + (u_regs.shape[1] - above - below) * np.log(same)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def _measure(n: int):
    def measure(texts: pa.Array) -> dict:
        sets = shingle_sets(texts, n)
        regs = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
        return digests(sets) | {"regs": regs}

    return measure


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = odd_numbers(REGISTERS, 41).reshape(BANDS, BAND_ROWS)
    salt = mix(np.arange(BANDS, dtype=U64))
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _registers(batch.column("regs")).reshape(-1, BANDS, BAND_ROWS).astype(U64)
        keys = mix((regs * factors).sum(2, dtype=U64) + salt).view(np.int64)
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), lists], ["rep", "bands"])


def _hopeful(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sizes = [part.column(c).to_numpy().astype(float) for c in ("u_size", "v_size")]
                good[a : a + 2000] = likely(_registers(part.column("u_regs")), _registers(part.column("v_regs")), *sizes) >= least
            yield batch.select(["u", "v"]).filter(pa.array(good))
            release()

    return run


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) of class representatives whose sizes and sketches allow a link."""
    side = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"{name}_size"), F.col("regs").alias(f"{name}_regs"))
    sized = pairs.join(side("v"), "v").join(side("u"), "u")
    sized = sized.where((100 * F.col("u_size") >= percent * F.col("v_size")) & (100 * F.col("v_size") >= percent * F.col("u_size")))
    return cut_lineage(sized.mapInArrow(_hopeful(percent / 100 - SLACK), "u long, v long"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked if 100 * shared shingles >= ``percent`` * all shingles of both;
    component_id is the smallest key that links reach, and kept says it is the own.

    Defined cases: a null, empty or blank text has no shingles and no links; one
    with fewer words than a shingle has its whole sequence as its only shingle;
    a null key stays alone, with a null component_id, and is kept; repeated rows
    share a component and each is returned; an empty table gives an empty result.
    Keys are unique; where they are not, rows of one key share a component.
    """
    pick = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    base = cut_lineage(map_text(pick, "text", "n_shingles long, high long, low long, regs binary", _measure(shingle), ["key"]))
    classes = classes_of(base, F.first("regs").alias("regs"))
    member = classes.select("rep", "regs").mapInArrow(_bands, "rep long, bands array<long>").select("rep", F.explode("bands").alias("bucket"))
    sizes = cut_lineage(member.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    shared = cut_lineage(member.join(sizes, "bucket"))

    def similar(pairs: DataFrame) -> DataFrame:
        return confirmed(_likely_pairs(pairs, classes, percent), docs, key, text, shingle, percent)

    found = connected(shared, one_key(base, classes), similar, docs, key, text, shingle, percent)
    done = result(base, classes, found, key)
    return done.withColumn("kept", F.coalesce(F.col(f"`{key}`") == F.col("component_id"), F.lit(True)))
