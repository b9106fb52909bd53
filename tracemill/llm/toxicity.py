"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the weighted mean of the embeddings of its character n-grams and of
the word itself (frequent ones weigh less), so a misspelling that was never seen shares most of its vector with
the word it stands for.  The vectors of ``SEGMENT`` consecutive words are averaged
and go through one linear softmax.  A few words can make a long document toxic, so
a document's logit is the smooth maximum of its segments' logits; training runs
through that maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textnum import U64, Words, map_text, mix, odd_numbers, words

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
SEGMENT = 8
#: how close the smooth maximum is to the maximum
SHARP = 3.0
STEPS = 100
RATE = 0.05
DECAY = 1e-5
#: most labelled rows, and most bytes of their texts, that training reads
MAX_TRAIN_ROWS = 4000
MAX_TRAIN_BYTES = 10_000_000
#: a bucket with share p of all buckets weighs RARE / (RARE + p)
RARE = 1e-4
#: and, met in d training documents, d / (d + TRUST) of that: what few documents say counts, but for less
TRUST = 10


@dataclass
class Model:
    """Embeddings (buckets x width), buckets' weights, softmax weights (width x 2), biases (2)."""

    embedding: np.ndarray
    rarity: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds to the logit of class 1 against class 0."""
        return self.rarity * (self.embedding @ (self.weight[:, 1] - self.weight[:, 0]))

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def subwords(found: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words ``pick``, one word after the other, and where each word's begin."""
    start, end = found.start[pick], found.end[pick]
    sizes = end - start + 2
    first = np.concatenate(([0], np.cumsum(sizes)))
    text = np.zeros(int(first[-1]) + max(GRAMS), np.uint8)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], sizes) - 1 + np.repeat(start, sizes)
    text[: first[-1]] = found.data[np.clip(inside, 0, max(0, len(found.data) - 1))]
    text[first[:-1]] = ord("<")
    text[first[1:] - 1] = ord(">")
    owners, buckets = [np.arange(len(pick))], [mix(found.hashes(5)[pick]) % U64(BUCKETS)]
    left = np.repeat(first[1:], sizes) - np.arange(first[-1])
    owner = np.repeat(np.arange(len(pick)), sizes)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, U64)
        for k, factor in enumerate(odd_numbers(n, 9)):
            code += (text[at + k].astype(U64) + U64(1)) * factor
        owners.append(owner[at])
        buckets.append(mix(code) % U64(BUCKETS))
    owned = np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(owned, minlength=len(pick)))))


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each segment among the words, and the first segment of each row."""
    sizes = np.diff(first)
    counts = -(-sizes // SEGMENT)
    seg_first = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(sizes)), counts)
    return first[:-1][row] + SEGMENT * (np.arange(seg_first[-1]) - seg_first[:-1][row]), seg_first


def smooth_max(values: np.ndarray, first: np.ndarray, sharp: float = SHARP) -> tuple[np.ndarray, np.ndarray]:
    """Power mean of each non-empty run of values, and each value's share in it.

    Near the mean for a small ``sharp``, near the maximum for a large one.
    """
    sizes = np.diff(first)
    top = np.maximum.reduceat(values, first[:-1])
    power = np.exp(sharp * (values - np.repeat(top, sizes)))
    total = np.add.reduceat(power, first[:-1])
    return top + np.log(total / sizes) / sharp, power / np.repeat(total, sizes)


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model:
    """Fits embeddings and softmax together by Adam on all of the given rows."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    prior = (float(np.sum(labels)) + 1) / (len(labels) + 2)
    bias = np.array([0, np.log(prior / (1 - prior))], np.float32)
    found = words(pa.array(texts, pa.string()), lower=True)
    busy = np.diff(found.first) > 0
    if not busy.any() or len(set(labels[busy].tolist())) < 2:
        return Model(embedding * 0, np.zeros(BUCKETS), weight, bias)
    y = labels[busy].astype(np.float32)
    first = np.concatenate(([0], np.cumsum(np.diff(found.first)[busy])))
    _, pick, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
    bucket, word_first = subwords(found, pick)
    # buckets of few documents weigh less, or each document's rare words would be learned by heart
    pairs = np.unique(np.repeat(np.arange(len(y)), np.diff(first)) * len(pick) + inverse) % len(pick)
    grams = np.diff(word_first)
    spread = np.bincount(bucket, np.repeat(np.bincount(pairs, minlength=len(pick)), grams), BUCKETS)
    share = np.bincount(bucket, np.repeat(np.bincount(inverse), grams), BUCKETS)
    rarity = RARE / (RARE + share / share.sum()) * spread / (spread + TRUST)
    owner = np.repeat(np.arange(len(pick)), grams)
    seg_start, seg_first = segments(first)
    seg_size = np.diff(seg_start, append=first[-1])
    seg_of = np.repeat(np.arange(len(seg_start)), seg_size)
    scale = rarity[bucket] / grams[owner]
    token, token_seg = inverse, seg_of
    used, where = np.unique(bucket, return_inverse=True)
    part, rows = embedding[used], np.repeat(np.arange(len(y)), np.diff(seg_first))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (part, weight, bias)]
    for step in range(1, STEPS + 1):
        # both averages are linear, so they pass on the one number that the softmax
        # needs of a vector: its product with the difference of the two weights
        side = weight[:, 1] - weight[:, 0]
        word = np.bincount(owner, (part @ side)[where] * scale, len(pick))
        seg = np.bincount(token_seg, word[token], len(seg_start)) / seg_size
        z, held = smooth_max(seg + float(bias[1] - bias[0]), seg_first, SHARP * min(1.0, 2 * step / STEPS))
        pull = ((1 / (1 + np.exp(-z)) - y) / len(y))[rows] * held
        back = np.bincount(token, (pull / seg_size)[token_seg], len(pick))
        slope = np.bincount(where, back[owner] * scale, len(used)).astype(np.float32)
        d_side = slope @ part
        d_bias = float(pull.sum())
        grads = (slope[:, None] * side + DECAY * part, np.stack([-d_side, d_side], 1), np.array([-d_bias, d_bias]))
        for param, grad, (m, v) in zip((part, weight, bias), grads, state, strict=True):
            m += (0.1 * (grad - m)).astype(np.float32)
            v += (0.01 * (grad * grad - v)).astype(np.float32)
            param -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    embedding *= 0  # a bucket that training never met says nothing
    embedding[used] = part
    return Model(embedding, rarity, weight, bias)


def score(column: pa.Array, scores: np.ndarray, offset: float) -> np.ndarray:
    """Probability of class 1 for every text; a text without words gets the bias alone."""
    found = words(column, lower=True)
    z = np.full(len(column), offset)
    busy = np.flatnonzero(np.diff(found.first) > 0)
    if len(busy):
        _, pick, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
        bucket, first = subwords(found, pick)
        word = np.add.reduceat(scores[bucket], first[:-1]) / np.diff(first)
        start, seg_first = segments(np.concatenate((found.first[:-1][busy], found.first[-1:])))
        seg = np.add.reduceat(word[inverse], start) / np.diff(start, append=found.first[-1])
        z[busy] = smooth_max(seg + offset, seg_first)[0]
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id") -> Model:
    """Trains on a sample of labelled rows bounded by MAX_TRAIN_ROWS and MAX_TRAIN_BYTES.

    The sample is the labels whose hashed key comes first: all if the bounds allow,
    else a share of them that their number and the size of their texts decide.  Only
    the sampled labels, a bounded table, are broadcast to the documents, which are
    never shuffled.  Rows without text or label are not used, nor is a text of more than
    a tenth of MAX_TRAIN_BYTES (1 MB); without both classes the model answers with the prior.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1 << 30))
    known = labels.select(F.col(key), F.col(label).cast("int").alias("label"), place.alias("at")).dropna()
    part = min(1.0, MAX_TRAIN_ROWS / max(1, known.count()))

    def sample(share: float) -> DataFrame:
        few = F.broadcast(known.where(F.col("at") < int(share * (1 << 30))))
        found = docs.where(F.octet_length(text) <= MAX_TRAIN_BYTES // 10).join(few, key)
        return found.select("at", F.col(text).alias("text"), "label")

    size = sample(part).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    got = sorted(sample(part * min(1.0, MAX_TRAIN_BYTES / max(1, size))).collect())
    return train([r.text for r in got], np.array([r.label for r in got], np.int64))


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1 and ``predicted``, the class at 0.5.

    Defined cases: null, empty and blank texts get the score of the bias alone;
    equal texts get equal scores; a long text is scored whole; an empty table gives
    an empty result.  Columns pass through (or those of ``keep``); one named as a
    result is replaced.  Rows never leave their partition; each task holds the
    model (256 KB).
    """
    scores, offset = model.bucket_scores(), model.offset()

    def measure(column: pa.Array) -> dict:
        done = score(column, scores, offset)
        return {"score": done, "predicted": (done >= 0.5).astype(np.int32)}

    return map_text(docs, text, "score double, predicted int", measure, keep)
