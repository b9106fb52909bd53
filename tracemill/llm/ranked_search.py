"""Ranked lexical search of a set of queries against all documents, exact to the last tie.

Documents become vectors of what each of the queries' terms adds to a score; a score is
a sum over a query's terms.  Every slice of them is a shard of the index.  In a shard,
each term's posting list is cut into blocks of similar documents: some members stand for
the list, and each other one joins the most similar of them, by the angle of projected
vectors.  A block's summary holds the coordinatewise maximum of its documents, so its
sum over a query's terms is never below any document's score.

A query walks its lists from the one that can add most.  A block is skipped only when its
summary's sum is below the score that a document needs, and the walk ends when all lists
that are left can't reach that score together.  Equal bounds are never skipped, as ties
go by key.  The needed score is the best known one of rank ``top``: of the shard so far,
and of a small part of all documents that is searched first.  That part only decides how
much is skipped, never what is found, and it keeps what shards return small: about
``top * FIRST_PART`` documents for each query, however many shards there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage
from tracemill.llm.textnum import LOWER, map_text, raw, release, words

#: documents in a block, about
BLOCK = 16
#: dimensions that documents are compared in
PLANES = 32
#: numbers in a shard's table of documents and terms, at most (one document at least)
CELLS = 8_000_000
#: (query, term) pairs that are searched together; more queries are searched in several rounds
MOST_TERMS = 50_000
#: one document of so many is searched first
FIRST_PART = 32
LAST = np.iinfo(np.int64).max

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = ord(" ")


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of every row, in order, and the n + 1 places where rows begin.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII; A to Z are
    lower-cased.  All else becomes a space, and then terms are words.
    """
    data, offsets = raw(texts)
    folded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data])])
    found = words(folded)
    return found.hashes(), found.first


def _counted(vocabulary: np.ndarray):
    """Length, known terms and their occurrences of each text."""

    def measure(texts: pa.Array) -> dict:
        hashes, first = terms(texts)
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[place] == hashes)
        row = np.searchsorted(first, known, "right") - 1
        codes, times = np.unique(row * len(vocabulary) + place[known], return_counts=True)
        offsets = np.searchsorted(codes, np.arange(len(texts) + 1) * len(vocabulary)).astype(np.int32)
        listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
        return {"n": np.diff(first), "ids": listed(codes % len(vocabulary)), "times": listed(times)}

    return measure


@dataclass
class Queries:
    """Queries as sorted numbers of terms in ``vocabulary``, and how the corpus weighs them."""

    items: list
    terms: list[np.ndarray]
    vocabulary: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    length: int = 0
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def holders(self) -> list[np.ndarray]:
        """Queries that have each term."""
        query = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        every = np.concatenate([*self.terms, np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        return np.split(query[order], np.searchsorted(every[order], np.arange(1, len(self.vocabulary))))

    def weigh(self, held: dict[int, int]) -> None:
        """Weights from how many documents hold each term."""
        of = lambda df: math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))
        self.weight = np.array([of(held.get(t, 0)) for t in range(len(self.vocabulary))], np.int64)

    def gains(self, n: np.ndarray, row: np.ndarray, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What each known term of a document adds to a score."""
        m = 100 - 50 + (50 * n * self.documents) // max(1, self.length)
        return self.weight[ids] * ((1_000_000_000 * times) // (1000 * times + 20 * m[row]))


class Shard:
    """Blocks of similar documents for each term's posting list, with their summaries."""

    def __init__(self, queries: Queries, holders: list[np.ndarray], row: np.ndarray, ids: np.ndarray, gains: np.ndarray, n_docs: int) -> None:
        self.queries, self.holders = queries, holders
        self.table = np.zeros((n_docs, len(queries.vocabulary)), np.int64)
        self.table[row, ids] = gains
        order = np.argsort(ids, kind="stable")
        self.members, self.edge = row[order], np.searchsorted(ids[order], np.arange(len(queries.vocabulary) + 1))
        self.best = np.zeros(len(queries.vocabulary), np.int64)
        np.maximum.at(self.best, ids, gains)
        planes = np.random.default_rng(11).standard_normal((len(queries.vocabulary), PLANES), np.float32)
        self.place = np.zeros((n_docs, PLANES), np.float32)
        for d in range(PLANES):
            self.place[:, d] = np.bincount(row, gains * planes[ids, d], n_docs)
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), 1e-30)
        self.lists: dict[int, tuple] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a posting list by blocks, where blocks begin, the summaries' terms and the summaries.

        A summary has the terms that queries with this term have.  A list is cut when a query first walks it.
        """
        if term not in self.lists:
            docs = self.members[self.edge[term] : self.edge[term + 1]]
            heads = docs[:: max(1, min(BLOCK, len(docs)))]
            nearest = (self.place[docs] @ self.place[heads].T).argmax(1)
            order = np.argsort(nearest, kind="stable")
            docs, begin = docs[order], np.flatnonzero(np.diff(nearest[order], prepend=-1))
            columns = np.unique(np.concatenate([self.queries.terms[q] for q in self.holders[term]]))
            self.lists[term] = docs, begin, columns, np.maximum.reduceat(self.table[np.ix_(docs, columns)], begin, 0)
        return self.lists[term]

    def search(self, query: int, keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard that may be among the best ``top`` of all, and their scores."""
        own = self.queries.terms[query]
        own = own[np.argsort(-self.best[own], kind="stable")]
        reach = np.cumsum(self.best[own][::-1])[::-1]
        needed = max(1, int(self.queries.needed[query]))
        seen, docs, scores = np.zeros(len(self.table), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for term, left in zip(own, reach, strict=True):
            if left < needed:
                break
            members, begin, columns, summaries = self.blocks(term)
            bounds = summaries[:, np.searchsorted(columns, own)].sum(1)
            open_ = np.repeat(bounds >= needed, np.diff(begin, append=len(members)))
            new = members[open_ & ~seen[members]]
            seen[new] = True
            found = self.table[np.ix_(new, own)].sum(1)
            good = found >= needed
            docs, scores = np.append(docs, new[good]), np.append(scores, found[good])
            if len(docs) > top:
                best = np.lexsort((keys[docs], -scores))[:top]
                docs, scores = docs[best], scores[best]
            if len(docs) == top:
                needed = max(needed, int(scores.min()))
        return docs, scores


def _searched(queries: Queries, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, size = queries.holders(), max(1, CELLS // len(queries.vocabulary))
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                ids, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("ids", "times"))
                lengths = np.diff(batch.column("ids").offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), lengths)
                shard = Shard(queries, holders, row, ids, queries.gains(batch.column("n").to_numpy(), row, ids, times), batch.num_rows)
                keys = batch.column("key").fill_null(LAST).to_numpy()
                for q in range(len(queries.items)):
                    docs, scores = shard.search(q, keys, top)
                    if len(docs):
                        yield pa.RecordBatch.from_arrays([pa.array([q] * len(docs), pa.int32()), batch.column("key").take(pa.array(docs)), pa.array(scores)], ["query", "key", "score"])
                del shard
            release()

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _search_round(docs: DataFrame, known: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """The best documents of the queries in ``known`` (item, term)."""
    spark, pairs = docs.sparkSession, known.collect()
    items = sorted({r.item for r in pairs}, key=lambda x: (x is None, x or 0))
    vocabulary = np.unique(np.array([r.term for r in pairs], np.int64).view(np.uint64))
    own = {i: [] for i in items}
    for r in pairs:
        own[r.item].append(r.term)
    queries = Queries(items, [np.searchsorted(vocabulary, np.sort(np.array(own[i], np.int64).view(np.uint64))) for i in items], vocabulary)
    pick = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    vectors = cut_lineage(map_text(pick, "text", "n long, ids array<int>, times array<int>", _counted(vocabulary), ["key"]).where("n > 0"))
    queries.documents, queries.length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("ids").alias("id")).groupBy("id").count()
    queries.weigh({r.id: r["count"] for r in held.collect()})
    queries.needed = np.zeros(len(items), np.int64)
    schema = "query int, key long, score long"
    search = lambda rows: _ranked(rows.select("key", "n", "ids", "times").mapInArrow(_searched(queries, top), schema), top)
    first = search(vectors.where(F.pmod(F.xxhash64("key", "n"), F.lit(FIRST_PART)) == 0)).where(F.col("rank") == top)
    needed = {r["query"]: r.score for r in first.collect()}
    queries.needed = np.array([needed.get(q, 0) for q in range(len(items))], np.int64)
    names = spark.createDataFrame(list(enumerate(items)), "query int, item long")
    return search(vectors).join(F.broadcast(names), "query").select("item", "rank", "key", "score")


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 50) -> DataFrame:
    """(item, rank, key, score) of the ``top`` best documents of every item, equal scores by ascending key.

    Queries are sent to every task, at most MOST_TERMS terms of them in a round; what is
    collected of the corpus is one number for each term of a round's queries and one score
    for each query.

    Defined cases: a null text has no terms; a document without terms counts nowhere; an
    item without terms, or with none that a document has, has no rows; rows of one item
    are one query of all their terms (null is an item too); repeated documents each have a
    rank, and a null key stands behind all others; empty tables give no rows.
    """
    pick = items.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text"))

    def listed(texts: pa.Array) -> dict:
        hashes, first = terms(texts)
        return {"terms": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))}

    known = cut_lineage(map_text(pick, "text", "terms array<long>", listed, ["item"]).select("item", F.explode("terms").alias("term")).distinct())
    rounds = max(1, -(-known.count() // MOST_TERMS))
    done = docs.sparkSession.createDataFrame([], "item long, rank int, key long, score long")
    for r in range(rounds):
        part = known.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        if part.limit(1).count():
            done = done.union(_search_round(docs, part, key, text, top))
    return done.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
