"""How filters that run one after another interact, from survival words.

With five filters there are 32 subsets of them.  A document's survival word is its
truth table: bit S is set if the document passes every filter of subset S.  Adding
words up bit by bit gives the survivors of all subsets at once, and with them every
order of the filters: what a prefix keeps, what the next filter removes, what it
would have removed alone, and its share over all orders.

Bits are added with carry-save adders: three words of one weight become a sum word
of that weight and a carry word of twice the weight, for all 32 places in a few
operations.  Equal documents enter as one word with a multiplicity, at the weights
of its binary digits, so copies cost what one document costs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.textnum import release

MOST_FILTERS = 5
SPACE = r"[\x20\x09-\x0D]+"
#: over how many places rows without a key are dealt
SPREAD = 1024


def passing(k: int, n: int) -> int:
    """The survival word of a document that fails filter ``k`` of ``n`` and no other."""
    return sum(1 << s for s in range(1 << n) if not s >> k & 1)


def survival_word(failed: list[Column]) -> Column:
    """Bit S of the word is set if no filter of subset S fails the document."""
    word = F.lit((1 << (1 << len(failed))) - 1).cast("long")
    for k, fails in enumerate(failed):
        word = word.bitwiseAND(F.when(fails, F.lit(passing(k, len(failed))).cast("long")).otherwise(F.lit(-1).cast("long")))
    return word


def positional_popcount(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each of 32 places, how many of ``words`` (each ``times`` over) have the bit."""
    counts, carried = np.zeros(32, np.int64), np.zeros(0, np.uint32)
    for weight in range(63):
        left = times >> weight
        layer = np.concatenate((carried, words[left & 1 == 1]))
        carries = [np.zeros(0, np.uint32)]
        while len(layer) > 1:
            layer = np.append(layer, np.zeros(int(len(layer) == 2), np.uint32))
            third = len(layer) // 3
            a, b, c = layer[: 3 * third].reshape(3, third)
            either = a ^ b
            carries.append((a & b) | (c & either))
            layer = np.concatenate((either ^ c, layer[3 * third :]))
        if len(layer):
            counts += (layer[0].astype(np.int64) >> np.arange(32) & 1) << weight
        carried = np.concatenate(carries)
        if not len(carried) and not (left >> 1).any():
            break
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of every subset, by part and labels, of each batch."""
    for batch in batches:
        part = batch.column("part").dictionary_encode()
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        group = part.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
        order = np.argsort(group, kind="stable")
        words = batch.column("word").to_numpy().astype(np.uint32)[order]
        times = batch.column("n").to_numpy()[order]
        names, first = np.unique(group[order], return_index=True)
        edges = [*first, len(order)]
        found = [positional_popcount(words[a:b], times[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if found:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * 32), pa.array(np.concatenate(found)))
            columns = [part.dictionary.take(pa.array(names // 4)), pa.array(names // 2 % 2), pa.array(names % 2), lists]
            yield pa.RecordBatch.from_arrays(columns, ["part", "good", "toxic", "survivors"])
    release()


def measured(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, text) of every document and the counts that conditions may use."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    listed = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    return listed.select(
        "key",
        "part",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )


def survivors(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, good, toxic, survivors): for each part and label, how many documents pass each subset of the filters.

    The filters are ``conditions`` in their order and, last, the filter of copies.
    Whether a text is a copy is known once the smallest key of its texts is.  Texts are
    told by SHA-256 and are counted by (text, part, labels) before they meet, so a text
    that a third of all rows have is a few rows by then.
    """
    n = len(conditions) + 1
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have {1 << n} subsets; a word holds those of {MOST_FILTERS}")
    word = survival_word([*map(F.expr, conditions.values()), F.lit(False)])
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    # rows without a key match no label; they are dealt out so that they don't meet in one task
    away = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("text"), F.lit(SPREAD - 1)) + 1).otherwise(F.lit(0)).cast("int")
    words = measured(docs, key, text, part).select("key", away.alias("away"), "part", digest, word.alias("word"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.select(F.col(f"`{key}`").cast("long").alias("key"), "quality", "toxic").where("key is not null")
    known = known.groupBy("key").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("away", F.lit(0))
    marked = words.join(known, ["key", "away"], "left").fillna(0, ["good", "toxic"])
    same = ["digest", "part", "word", "good", "toxic"]
    rows = marked.groupBy("key", "away", *same).agg(F.count("*").alias("n"))
    keyed = F.col("key").isNotNull()
    texts = rows.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.when(keyed, F.struct("key", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(~keyed, F.col("n"))), F.lit(0)).alias("keyless"),
    )
    first = F.when(F.col("least.key") == F.min("least.key").over(Window.partitionBy("digest")), F.col("least.n")).otherwise(F.lit(0)) + F.col("keyless")
    both = texts.withColumn("first", first).select(
        *["part", "good", "toxic"],
        F.explode(F.array(F.struct("word", F.col("first").alias("n")), F.struct(F.col("word").bitwiseAND(F.lit(passing(n - 1, n))).alias("word"), (F.col("n") - F.col("first")).alias("n")))).alias("x"),
    )
    counted = both.select("part", "good", "toxic", "x.*").where("n > 0").mapInArrow(_counted, "part string, good long, toxic long, survivors array<long>")
    each = counted.select("part", "good", "toxic", F.posexplode("survivors").alias("subset", "n")).where(F.col("subset") < 1 << n)
    return each.groupBy("part", "good", "toxic", "subset").agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], copies: str = "E", key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step in it.

    ``conditions`` names up to four failure conditions, in SQL on the columns of ``measured``;
    ``copies`` names the filter that fails a document whose text a smaller key has.
    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (what the filter removes, summed over all orders).

    Defined cases: a null text is an empty one, a null part the part of the empty name;
    a condition that is null does not fail; a row without a key is no copy and makes none;
    repeated rows of one key count each and are no copies of each other; a document with
    several labels is good, or toxic, if one of them says so; a document without a label
    is neither; an empty table has no parts and gives no rows.
    """
    letters = [*conditions, copies]
    n, everything = len(letters), (1 << len(letters)) - 1
    of_label = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0)))
    by_subset = survivors(docs, labels, conditions, key, text, part).groupBy("part", "subset").agg(F.sum("n").alias("every"), of_label("good").alias("good"), of_label("toxic").alias("toxic"))
    by_part = by_subset.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "every", "good", "toxic"))).alias("passing"))
    survive = lambda subset, label="every": F.col("passing")[subset][label]
    shares = [
        sum(((survive(F.lit(s)) - survive(F.lit(s | 1 << k))) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) if not s >> k & 1), F.lit(0))
        for k in range(n)
    ]
    steps = [("".join(letters[k] for k in order), i + 1, k, sum(1 << j for j in order[:i])) for order in permutations(range(n)) for i, k in enumerate(order)]
    fixed = F.from_json(F.lit(json.dumps([{"filter_order": o, "step": i, "k": k, "own": 1 << k, "before": b} for o, i, k, b in steps])), "array<struct<filter_order: string, step: int, k: int, own: int, before: int>>")
    taken = by_part.withColumn("shares", F.array(*shares)).select("part", "passing", "shares", F.inline(fixed))
    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)
    removed = survive(before) - survive(after)
    return taken.select(
        "part",
        "filter_order",
        "step",
        survive(after).alias("kept"),
        removed.alias("removed"),
        (survive(F.lit(0)) - survive(own) - removed).alias("redundant"),
        (survive(F.lit(everything).bitwiseXOR(own)) - survive(F.lit(everything))).alias("unique_fails"),
        (survive(before, "good") - survive(after, "good")).alias("good_lost"),
        (survive(before, "toxic") - survive(after, "toxic")).alias("toxic_lost"),
        F.col("shares")[F.col("k")].alias("shapley"),
    )
