"""Exact links between sets of shingles that meet in buckets, and the components they make.

Links are needed only to connect documents.  Documents of equal sets are one class.
Each bucket first links its members to the one that meets most others in all its
buckets (the original of a family of copies, which resemble it more than each other).
Members that are then still in another component than most of a bucket are compared
exactly with all they share it with, block by block of CHUNK sets.

Small sides of joins on bucket, class or node are written out first: both sides are
then plain exchanges, and adaptive execution splits a bucket, class or node that a
third of all rows have over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage
from tracemill.llm.components import components
from tracemill.llm.textnum import U64, freed, map_text, mix, odd_numbers, release, windows, words

#: most sets in one side of a block
CHUNK = 512
#: ids (8 bytes each) up to which the wanted texts are picked by a broadcast
MOST_BROADCAST = 1_000_000


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a shorter one has its whole sequence as one."""
    found = words(texts, lower=True)
    values = found.hashes()
    h, at = windows(values, found.first, n, 31)
    edge = np.searchsorted(at, found.first)
    sets = [np.unique(h[edge[i] : edge[i + 1]]) for i in range(len(texts))]
    for i in np.flatnonzero((np.diff(found.first) > 0) & (np.diff(found.first) < n)):
        own = values[found.first[i] : found.first[i + 1]]
        sets[i] = mix(np.array([np.sum(own * odd_numbers(len(own), 32), dtype=U64)], U64))
    return sets


def digests(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The size and two 64-bit digests of each set."""
    sums = [(np.sum(s, dtype=U64), np.sum(mix(s ^ U64(99)), dtype=U64)) for s in sets]
    high, low = (np.array([x[k] for x in sums], U64).view(np.int64) for k in (0, 1))
    return {"n_shingles": np.array([len(s) for s in sets], np.int64), "high": high, "low": low}


def of_keys(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, text) of the rows whose key is in ``wanted`` (rep, distinct): picked by a broadcast while the ids are few."""
    few = wanted.count() <= MOST_BROADCAST
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text")).where("rep is not null")
    return texts.join(F.broadcast(wanted) if few else wanted, "rep", "left_semi")


def full_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(rep, items) of the wanted keys; of rows of one key, the least set."""

    def full(column: pa.Array) -> dict:
        sets = shingle_sets(column, n)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
        values = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
        return {"items": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    return map_text(of_keys(docs, wanted, key, text), "text", "items array<long>", full, ["rep"]).groupBy("rep").agg(F.min("items").alias("items"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    edges, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(_lists(batch.column("u_set")), _lists(batch.column("v_set")), strict=True):
                both = np.sort(np.concatenate((a, b)))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
            release()

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    wanted = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    sets = cut_lineage(full_sets(wanted, docs, key, text, n))
    with_v = pairs.join(sets.select(F.col("rep").alias("v"), F.col("items").alias("v_set")), "v")
    with_both = with_v.join(sets.select(F.col("rep").alias("u"), F.col("items").alias("u_set")), "u")
    return with_both.mapInArrow(_confirmed(percent), "u long, v long")


def _compared(percent: int):
    """Links between components in one block: one for each set and component that it is linked to."""

    def run(table: pa.Table) -> pa.Table:
        side, rep, group = (table.column(c).to_numpy() for c in ("side", "rep", "component"))
        sets = [x for chunk in table.column("items").chunks for x in _lists(chunk)]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in ("u", "v")})
        sizes = np.array([len(x) for x in sets])
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        places = np.split(place, np.cumsum(sizes)[:-1])
        there, edge = np.concatenate([places[j] for j in right]), np.cumsum(sizes[right]) - sizes[right]
        mark, links = np.zeros(len(names), np.int64), []
        for i in left:
            mark[places[i]] = 1
            shared = np.add.reduceat(mark[there], edge)
            mark[places[i]] = 0
            hits = right[(100 * shared >= percent * (sizes[i] + sizes[right] - shared)) & (group[right] != group[i])]
            _, first = np.unique(group[hits], return_index=True)
            links += [(min(rep[i], rep[j]), max(rep[i], rep[j])) for j in hits[first]]
        return pa.table({n: pa.array([x[k] for x in links], pa.int64()) for k, n in enumerate(("u", "v"))})

    return run


def _late_links(blobs: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Links (u, v) between components in each of ``blobs`` (head, rep, component).

    Members of a blob's largest component are connected already, so only the others are
    compared with all: in blocks of CHUNK others and CHUNK members.
    """
    sizes = blobs.groupBy("head", "component").agg(F.count("*").alias("m"))
    apart = sizes.groupBy("head").agg(F.sum("m").alias("k"), F.max(F.struct("m", "component")).alias("most")).where("k > most.m and k > 2")
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / CHUNK)).cast("int")
    cuts = cut_lineage(apart.select("head", F.col("most.component").alias("largest"), parts(F.col("k")).alias("all_parts"), parts(F.col("k") - F.col("most.m")).alias("few_parts")))
    live = cut_lineage(blobs.join(cuts, "head"))
    sets = full_sets(live.select("rep").distinct(), docs, key, text, n)
    place = F.xxhash64("rep")
    few = live.where("component <> largest").select("head", F.pmod(place, F.col("few_parts")).cast("int").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("hi"), F.lit(0).alias("side"), "rep", "component")
    rest = live.select("head", F.explode(F.sequence(F.lit(0), F.col("few_parts") - 1)).alias("lo"), F.pmod(place, F.col("all_parts")).cast("int").alias("hi"), F.lit(1).alias("side"), "rep", "component")
    return few.unionByName(rest).join(sets, "rep").groupBy("head", "lo", "hi").applyInArrow(freed(_compared(percent)), "u long, v long").distinct()


def classes_of(base: DataFrame, *more: Column) -> DataFrame:
    """One row (high, low, rep, n, ...) for each different set of ``base`` (key, n_shingles, high, low): rep is the smallest key."""
    some = base.where("n_shingles > 0 and key is not null")
    return cut_lineage(some.groupBy("high", "low").agg(F.min("key").alias("rep"), F.max("n_shingles").alias("n"), *more))


def one_key(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes that rows of one key have: such rows are one node."""
    some = base.where("n_shingles > 0 and key is not null")
    same_key = some.groupBy("high", "low", "key").count().groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    joined = some.join(same_key, "key").join(classes.select("high", "low", "rep"), ["high", "low"])
    return joined.where("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v")).distinct()


def connected(shared: DataFrame, known: DataFrame, similar: Callable[[DataFrame], DataFrame], docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(node, component) of what links connect among the members of each bucket.

    ``shared`` (rep, bucket, c) is written out and has the buckets of more than one
    member; c says how much a member meets others there.  ``similar`` keeps the linked
    ones of pairs (u, v), ``known`` (u, v) holds links that need no look.
    """
    met = cut_lineage(shared.groupBy("rep").agg(F.sum("c").alias("met")))
    ranked = shared.select("rep", "bucket").join(met, "rep")
    heads = cut_lineage(ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("met"), F.col("rep").alias("rep")))["rep"].alias("head")))
    headed = cut_lineage(shared.select("rep", "bucket").join(heads, "bucket").select("rep", "head").distinct())
    star = headed.where("rep <> head").select(F.least("head", "rep").alias("u"), F.greatest("head", "rep").alias("v")).distinct()
    links = cut_lineage(similar(star).union(known))
    found = components(links)
    named = headed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("head", "rep", F.coalesce("component", "rep").alias("component"))
    late = cut_lineage(_late_links(cut_lineage(named), docs, key, text, n, percent))
    return components(links.union(late)) if late.limit(1).count() else found


def result(base: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``base``."""
    rep_of = classes.select("high", "low", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("class"))
    done = base.select("key", "n_shingles", "high", "low").join(rep_of, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class", "key")).otherwise(F.col("key"))
    component = F.when(F.col("key").isNotNull(), component)
    return done.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
