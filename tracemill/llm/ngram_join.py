"""Similarity join of word n-gram sets by partition and enumeration signatures.

Two sets are linked if their Jaccard similarity is at least ``percent`` / 100.  Sizes
fall into bands, each as wide as similar sizes can be apart, so two similar sets are
in one band or in adjacent ones; every set signs for its own band and for the next.
In a band similar sets differ by at most k features.  The features' domain is cut by
a hash into n parts so that some part has at most ``ABSENT`` of these differences, and
each part into ``CUTS`` cuts: leaving out every choice of ``ABSENT`` cuts, one choice
leaves out all differences.  A signature is the hash of what is left of one part, so
similar sets always share one, and no link is lost.  Full sets decide.

Signatures are sorted by ranges of (signature, key): one that very many sets have is
cut over several tasks, and each task hands its first and last run on.  A run links
its members to its first; what travels on are pairs of keys, not signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage
from tracemill.llm.linking import classes_of, confirmed, connected, digests, of_keys, one_key, result, shingle_sets
from tracemill.llm.textnum import U64, map_text, mix, release

CUTS, ABSENT = 3, 1
#: signatures (16 bytes each) that a task of the sort takes, about
TASK_SIGNATURES = 4_000_000
#: sizes of sets that bands are made for
LARGEST = 1 << 40


def size_bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and how many features similar sets differ by there at most.

    k holds for two sets of the band and for one of it with one of the band before.
    """
    first, differ, low = [], [], 1
    while low < LARGEST:
        high = max(low, low * 100 // percent)
        first.append(low)
        differ.append(2 * high * (100 - percent) // (100 + percent))
        low = high + 1
    return np.array(first), np.array(differ)


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Distinct signatures of each set; sets that only an equal one can be similar to have none."""
    first, differ = size_bands(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate([*sets, np.zeros(0, U64)])
    found = [[] for _ in sets]
    own = np.searchsorted(first, sizes, "right") - 1
    for step in (0, 1):
        band = own + step
        k = np.where(sizes > 0, differ[band], 0)
        parts = np.where(k > 0, k // (ABSENT + 1) + 1, 0)
        base = np.cumsum(parts) - parts
        places = mix(items + np.repeat(band.astype(U64) << U64(48), sizes))
        part = ((places >> U64(32)) * np.repeat(parts, sizes).astype(U64) >> U64(32)).astype(np.int64)
        cell = (np.repeat(base, sizes) + part) * CUTS + (places % U64(CUTS)).astype(np.int64)
        kept = np.repeat(k > 0, sizes)
        sums = np.zeros(int(parts.sum()) * CUTS, U64)
        np.add.at(sums, cell[kept], mix(items[kept]))
        sums = sums.reshape(-1, CUTS)
        number = np.arange(len(sums)) - np.repeat(base, parts)
        named = mix(np.repeat(band, parts).astype(U64) << U64(40) | number.astype(U64))
        choices = list(combinations(range(CUTS), CUTS - ABSENT))
        signed = np.stack([mix(mix(sums[:, list(c)] + mix(np.array(c, U64))).sum(1, dtype=U64) + named + U64(i)) for i, c in enumerate(choices)], 1)
        for i in np.flatnonzero(parts):
            found[i].append(signed[base[i] : base[i] + parts[i]].ravel())
    return [np.unique(np.concatenate([*x, np.zeros(0, U64)])) for x in found]


def _signed(n: int, percent: int):
    def measure(texts: pa.Array) -> dict:
        found = signatures(shingle_sets(texts, n), percent)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        values = np.concatenate([*found, np.zeros(0, U64)]).view(np.int64)
        return {"signatures": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    return measure


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (edge, a, b, c) of sorted (signature, rep): how often rep b is in a run that a begins,
    and (edge) the signature a of the first and of the last run, with the rep b that begins it."""
    last = None  # signature, rep that begins its run, whether a second one has come
    edges = []
    for batch in batches:
        if not batch.num_rows:
            continue
        signature, rep = (batch.column(c).to_numpy() for c in ("signature", "rep"))
        carried = last is not None and signature[0] == last[0]
        starts = np.flatnonzero(np.concatenate(([not carried], signature[1:] != signature[:-1])))
        if last is None:
            edges.append((int(signature[0]), int(rep[0])))
        heads = np.concatenate((np.array([last[1]] if carried else [], np.int64), rep[starts]))
        begin = np.concatenate((np.zeros(int(carried), np.int64), starts))
        head = np.repeat(heads, np.diff(np.append(begin, len(rep))))
        other = rep != head
        # a head counts once for each run that has another member
        many = np.add.reduceat(other.astype(np.int64), begin) > 0
        if carried:
            many[0] &= not last[2]
        a = np.concatenate((head[other], heads[many]))
        b = np.concatenate((rep[other], heads[many]))
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            counts = np.diff(np.append(new, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(new), bool)), pa.array(a[new]), pa.array(b[new]), pa.array(counts)], ["edge", "a", "b", "c"])
        before = carried and len(begin) == 1 and last[2]
        last = (int(signature[-1]), int(heads[-1]), bool(before or other[begin[-1] :].any()))
    if last is not None:
        edges.append(last[:2])
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(edges)), *[pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], pa.array([0] * len(edges), pa.int64())], ["edge", "a", "b", "c"])
    release()


def buckets(signed: DataFrame, total: int) -> DataFrame:
    """(rep, bucket, c) from (signature, rep): sets that share a signature share a bucket.

    A bucket is named by the smallest rep of its signatures.  Where ranges cut a signature's
    run, the later pieces' buckets are also given the name of the first.
    """
    parts = max(signed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SIGNATURES))
    # the rows of a run are in the order of rep, so a piece's first is its smallest
    sorted_ = signed.repartitionByRange(parts, "signature", "rep").sortWithinPartitions("signature", "rep")
    runs = cut_lineage(sorted_.mapInArrow(_runs, "edge boolean, a long, b long, c long"))
    cut = runs.where("edge").select(F.col("a").alias("signature"), F.col("b").alias("head")).distinct()
    firsts = cut.groupBy("signature").agg(F.min("head").alias("first"), F.count("*").alias("pieces")).where("pieces > 1")
    # two rows a partition at most
    names = F.broadcast(cut.join(F.broadcast(firsts), "signature").where("head <> first").select("head", "first").distinct())
    own = runs.where("not edge").groupBy("a", "b").agg(F.sum("c").alias("c")).select(F.col("a").alias("bucket"), F.col("b").alias("rep"), "c")
    moved = own.join(names, own["bucket"] == names["head"]).select(F.col("first").alias("bucket"), "rep", "c")
    # heads of pieces whose runs have no second member in their own range
    lone = names.select(F.col("first").alias("bucket"), F.col("head").alias("rep"), F.lit(1).cast("long").alias("c"))
    begin = names.select(F.col("first").alias("bucket"), F.col("first").alias("rep"), F.lit(1).cast("long").alias("c"))
    return cut_lineage(own.union(moved).union(lone).union(begin).groupBy("rep", "bucket").agg(F.sum("c").alias("c")))


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    Rows are linked if 100 * shared n-grams >= ``percent`` * all n-grams of both;
    component_id is the smallest key that links reach.

    Defined cases: a null, empty or blank text has no n-grams and no links; one with
    fewer words than an n-gram has its whole sequence as its only one; a null key stays
    alone, with a null component_id; repeated rows share a component and each is
    returned; an empty table gives an empty result.  Keys are unique; where they are
    not, rows of one key share a component.
    """
    pick = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    base = cut_lineage(map_text(pick, "text", "n_shingles long, high long, low long", lambda texts: digests(shingle_sets(texts, shingle)), ["key"]))
    classes = classes_of(base)
    texts = of_keys(docs, classes.select("rep").distinct(), key, text)
    signed = map_text(texts, "text", "signatures array<long>", _signed(shingle, percent), ["rep"]).select(F.explode("signatures").alias("signature"), "rep")
    first, differ = size_bands(percent)
    most = 2 * float((differ / first).max()) * CUTS / (ABSENT + 1)
    total = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * most)
    shared = buckets(signed, total)
    found = connected(shared, one_key(base, classes), lambda pairs: confirmed(pairs, docs, key, text, shingle, percent), docs, key, text, shingle, percent)
    return result(base, classes, found, key)
