"""Scores texts by a log-bilinear language model and by unigram counts.

Counts: blocks of documents send their distinct tokens to shards, which add them up
over the whole training part and answer with each block's own tokens' counts.
Model: a token's slot is what the model knows it as.  Frequent tokens have a slot of
their own, the others share the tail slots of their class by a hash, and inside a tail
slot a token has its add-one share of the counts.  There are SLOTS_A_ROOT times the
square root of the distinct training tokens of slots, so they grow with the corpus.
A class (by a token's last three bytes) holds about the same number of slots.  With
``g = sum_j C_j r[slot_j]`` over the last ORDER slots, a slot's probability is the
softmax over classes of ``Q1 g + b1`` times the softmax over its class's slots of
``Q2 g + b2``: both are normalised by matrix products.
Training: both levels by noise-contrastive estimation; the noise of a slot are the
other tokens of its class in the same batch.  Training rows are dealt by hash into
copies of bounded size, however the table is split.  Rounds take one copy, then two,
then four, and so on, each text once; the copies of a round start from the mean of the
round before.  A slot's vectors are averaged by how often each copy met it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import blocks as B
from tracemill.llm.blocks import cut_lineage, cut_shards, pack, pow2, text_bytes, unpack
from tracemill.llm.textnum import U64, freed, freed_pair, mix, slices, with_row, words

CLASSES, ORDER, WIDTH = 128, 4, 16
SLOTS_A_ROOT, FINE = 6, 9  # FINE: bits of a token's hash that choose its tail slot
NOISE, GROUP = 32, 16  # drawn classes of a batch; tokens that are each other's noise within their class
RUN, BATCH, SPEED = 64, 4096, 0.1  # tokens in a row, tokens in a batch, and the length of a step
COPY_BLOCKS, SLOTS_A_COPY = 4, 16384  # blocks that train one copy, and more if the model has more slots
ROWS = 1 << 15  # tokens normalised at a time
CHUNK = 1 << 18  # tokens that a task encodes or scores at a time
PARTS = 32  # parts of the slots that are averaged apart
END = U64(0xE0D0E0D0E0D0E000)
CLASS_BITS = U64(0xFF)
SHARD_KEYS = 1_000_000
SENT = "shard int, block int, keys binary, counts binary"
MERGED = "block int, shard int, counts binary"
CODED = "copy int, order long, n_tokens long, n_known long, base double, inside double, codes binary"


@dataclass
class Text:
    """Token keys of rows (each ends with END) and where each row's begin."""

    keys: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Text:
    """Keys of lower-cased words; a key's low byte is the word's class."""
    found = words(texts, lower=True)
    ending = np.zeros(len(found.start), U64)
    for back in (1, 2, 3):
        inside = found.end - found.start >= back
        ending = ending << U64(8) | np.where(inside, found.data[np.maximum(found.end - back, 0)], 0).astype(U64)
    own = (found.hashes() & ~CLASS_BITS) | (mix(ending) % U64(CLASSES))
    first = found.first + np.arange(len(found.first))
    keys = np.full(int(first[-1]), END, U64)
    inside = np.ones(len(keys), bool)
    inside[first[1:] - 1] = False
    keys[inside] = own
    return Text(keys, first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of every key among them."""
    coded = pc.dictionary_encode(pa.array(keys, pa.uint64()))
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return found[order], place[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Slots:
    """Which slot a token has, and how often slots were met in training."""

    n: int
    v: int
    own: np.ndarray
    own_slot: np.ndarray
    edge: np.ndarray  # class k has the slots edge[k] to edge[k + 1], its tails last
    tails: int
    met: np.ndarray
    bottom: np.ndarray  # of the share of a token in its slot

    @classmethod
    def of(cls, own: np.ndarray, own_count: np.ndarray, n_cell: np.ndarray, v_cell: np.ndarray) -> Slots:
        """From the tokens with own slots, and the counts and distinct tokens of all cells (class, hash bits)."""
        n, v = int(n_cell.sum()), int(v_cell.sum())
        tails = _tails(v)
        kind = (own & CLASS_BITS).astype(np.int64)
        cell = (kind << FINE) + (own >> U64(64 - FINE)).astype(np.int64)
        n_cell, v_cell = n_cell - np.bincount(cell, own_count, len(n_cell)), v_cell - np.bincount(cell, minlength=len(v_cell))
        edge = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=CLASSES) + tails)))
        order = np.lexsort((own, kind))
        own_slot = np.empty(len(own), np.int64)
        own_slot[order] = np.arange(len(own)) + kind[order] * tails
        tail = (edge[1:] - tails)[:, None] + (np.arange(1 << FINE) * tails >> FINE)
        met = np.bincount(tail.ravel(), n_cell, edge[-1])
        bottom = met + np.bincount(tail.ravel(), v_cell, edge[-1]) + 1
        met[own_slot] = own_count
        return cls(n, v, own, own_slot, edge, tails, met, bottom)

    @property
    def total(self) -> int:
        return int(self.edge[-1])

    def kinds(self) -> np.ndarray:
        return np.repeat(np.arange(CLASSES, dtype=np.int16), np.diff(self.edge))

    def codes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of keys, and which of them are their own."""
        fine = (keys >> U64(64 - FINE)).astype(np.int64)
        code = self.edge[1 + (keys & CLASS_BITS).astype(np.int64)] - self.tails + (fine * self.tails >> FINE)
        if not len(self.own):
            return code.astype(np.int32), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)
        alone = self.own[place] == keys
        return np.where(alone, self.own_slot[place], code).astype(np.int32), alone


def _slots(v: float) -> int:
    return min(CLASSES << (FINE + 2), max(2 * CLASSES, int(SLOTS_A_ROOT * v**0.5)))


def _tails(v: float) -> int:
    """Tail slots of a class: a quarter of all slots are tails."""
    return max(1, _slots(v) // (4 * CLASSES))


#: r: a slot as context; c: the context's matrices; q1, b1: classes; q2, b2: slots as what comes next
DENSE, BY_SLOT = ("c", "q1", "b1"), ("r", "q2", "b2")


@dataclass
class Model:
    """Slots, parameters, and the sum of squared steps of each (of a slot: one for each kind of vector)."""

    slots: Slots
    params: dict[str, np.ndarray]
    memory: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, slots: Slots) -> Model:
        """Random contexts; what comes next has its share of the counts."""
        rng = np.random.default_rng(5)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        outer, inner = _shares(slots)
        params = {
            "r": draw(slots.total + 1, WIDTH),
            "c": draw(ORDER * WIDTH, WIDTH),
            "q1": np.zeros((CLASSES, WIDTH), np.float32),
            "b1": np.log(outer),
            "q2": np.zeros((slots.total + 1, WIDTH), np.float32),
            "b2": np.append(np.log(inner), np.float32(0)),
        }
        memory = {k: np.full(len(p) if k in BY_SLOT else p.shape, 1e-6, np.float32) for k, p in params.items()}
        return cls(slots, params, memory)


def _shares(slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Shares of classes, and of slots in their class."""
    met = slots.met + 1
    mass = np.add.reduceat(met, slots.edge[:-1])
    return (mass / mass.sum()).astype(np.float32), (met / np.repeat(mass, np.diff(slots.edge))).astype(np.float32)


def stream(parts: list[np.ndarray], start: int) -> np.ndarray:
    """Codes of texts one after another, each behind ORDER times ``start``."""
    gap = np.full(ORDER, start, np.int32)
    return np.concatenate([x for part in parts for x in (gap, part)]) if parts else gap


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _edges(ranked: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))


def _ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """Sorted codes; small ones by radix."""
    return np.sort(codes.astype(np.uint16), kind="stable").astype(np.int32) if most < 1 << 16 else np.sort(codes)


def _held(vectors: np.ndarray, n: int) -> np.ndarray:
    """The ORDER vectors before each of the last ``n`` of every run, the nearest first."""
    return np.concatenate([vectors[:, ORDER - 1 - j : ORDER - 1 - j + n] for j in range(ORDER)], 2).reshape(-1, ORDER * WIDTH)


class Copy:
    """A model in training: parameters, and how often slots were met."""

    def __init__(self, model: Model) -> None:
        self.slots, self.seen = model.slots, 0
        self.params, self.memory = ({k: x.copy() for k, x in held.items()} for held in (model.params, model.memory))
        self.met, self.place = (np.zeros(model.slots.total + 1, np.int64) for _ in range(2))
        outer, inner = _shares(model.slots)
        self.kinds, self.cdf = np.append(model.slots.kinds(), CLASSES), np.cumsum(outer, dtype=float)
        self.log_outer, self.log_inner = np.log(NOISE * outer), np.append(np.log((GROUP - 1) * inner), np.float32(0))

    def learn(self, codes: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over a stream of texts, in runs of RUN tokens in a random order."""
        runs = -(-(len(codes) - ORDER) // RUN)
        padded = np.full(ORDER + runs * RUN, self.slots.total, np.int32)
        padded[: len(codes)] = codes
        places = np.arange(runs)[:, None] * RUN + np.arange(ORDER + RUN)
        order = rng.permutation(runs)
        for at in range(0, runs, BATCH // RUN):
            self._step(padded[places[order[at : at + BATCH // RUN]]], rng)

    def _step(self, runs: np.ndarray, rng: np.random.Generator) -> None:
        p, start = self.params, self.slots.total
        held = _held(p["r"].take(runs, 0), RUN)
        targets = runs[:, ORDER:].ravel()
        kinds = self.kinds.take(targets)
        order = np.argsort(kinds, kind="stable")
        order = order[: np.searchsorted(kinds, CLASSES, sorter=order)]  # starts of texts are not predicted
        if not len(order):
            return
        t, kind = targets.take(order), kinds.take(order)
        guess = (held @ p["c"]).take(order, 0)
        d_guess, d_q1, d_b1 = self._outer(guess, kind, rng)
        d_next, met_guess = self._inner(guess, t, kind)
        d_guess += met_guess
        whole = np.zeros((len(targets), WIDTH), np.float32)
        whole[order] = d_guess
        d_held = (whole @ p["c"].T).reshape(len(runs), RUN, ORDER * WIDTH)
        steps = np.zeros((*runs.shape, 2 * WIDTH + 1), np.float32)
        for j in range(ORDER):
            steps[:, ORDER - 1 - j : ORDER - 1 - j + RUN, :WIDTH] += d_held[:, :, j * WIDTH : (j + 1) * WIDTH]
        ahead = np.zeros((len(targets), WIDTH + 1), np.float32)
        ahead[order] = d_next
        steps[:, ORDER:, WIDTH:] = ahead.reshape(len(runs), RUN, WIDTH + 1)
        n = np.float32(1 / len(order))
        for name, step in (("c", held.T @ whole), ("q1", d_q1), ("b1", d_b1)):
            step *= n
            self.memory[name] += step * step
            p[name] += SPEED * step / (np.sqrt(self.memory[name]) + 1e-6)
        self._step_slots(runs.ravel(), steps.reshape(-1, 2 * WIDTH + 1), n)
        self.seen += len(order)

    def _outer(self, guess: np.ndarray, kind: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps of the context's guess and of the classes."""
        q, b = self.params["q1"], self.params["b1"] - self.log_outer
        drawn = np.minimum(np.searchsorted(self.cdf, rng.random(NOISE) * self.cdf[-1]), CLASSES - 1)
        own, noise = q.take(kind, 0), q.take(drawn, 0)
        pull = 1 - _sigmoid(np.einsum("ij,ij->i", guess, own) + b[kind])
        push = guess @ noise.T
        push += b[drawn]
        _sigmoid(push)
        d_guess = pull[:, None] * own
        d_guess -= push @ noise
        edge = _edges(kind)
        which = np.zeros((NOISE, CLASSES), np.float32)
        which[np.arange(NOISE), drawn] = 1
        d_q, d_b = which.T @ -(push.T @ guess), which.T @ -push.sum(0)
        d_q[kind[edge]] += np.add.reduceat(pull[:, None] * guess, edge, 0)
        d_b[kind[edge]] += np.add.reduceat(pull, edge)
        return d_guess, d_q, d_b

    def _inner(self, guess: np.ndarray, t: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of the targets' vectors and of the guesses; neighbours of one class are each other's noise."""
        d_next, d_guess = np.zeros((len(t), WIDTH + 1), np.float32), np.zeros_like(guess)
        n = len(t) // GROUP * GROUP
        if not n:
            return d_next, d_guess
        g, q = guess[:n].reshape(-1, GROUP, WIDTH), self.params["q2"].take(t[:n], 0).reshape(-1, GROUP, WIDTH)
        z = g @ q.transpose(0, 2, 1)
        z += (self.params["b2"] - self.log_inner).take(t[:n]).reshape(-1, 1, GROUP)
        _sigmoid(z)
        k = kind[:n].reshape(-1, GROUP)
        same = k[:, :, None] == k[:, None, :]
        others = same.sum(2, dtype=np.float32) - 1
        z *= same
        diagonal = np.arange(GROUP)
        pull = (1 - z[:, diagonal, diagonal]) * (others > 0)
        z *= ((GROUP - 1) / np.maximum(others, 1))[:, :, None]  # as many noise tokens in the sum wherever there are any
        z[:, diagonal, diagonal] = -pull
        d_guess[:n] = -(z @ q).reshape(-1, WIDTH)
        d_next[:n, :WIDTH] = -(z.transpose(0, 2, 1) @ g).reshape(-1, WIDTH)
        d_next[:n, WIDTH] = -z.sum(1).ravel()
        return d_next, d_guess

    def _step_slots(self, codes: np.ndarray, steps: np.ndarray, n: np.float32) -> None:
        """Adds up the steps of equal slots."""
        rows, at = self._rows(codes)
        width = steps.shape[1]
        cell = at[:, None] * width + np.arange(width)
        step = np.bincount(cell.ravel(), steps.ravel(), len(rows) * width).astype(np.float32).reshape(-1, width)
        step *= n
        for name, part in (("r", step[:, :WIDTH]), ("q2", step[:, WIDTH : 2 * WIDTH]), ("b2", step[:, 2 * WIDTH])):
            square = part * part if part.ndim == 1 else np.einsum("ij,ij->i", part, part) / WIDTH
            seen = self.memory[name].take(rows) + square
            self.memory[name][rows] = seen
            rate = SPEED / (np.sqrt(seen) + 1e-6)
            self.params[name][rows] += part * (rate if part.ndim == 1 else rate[:, None])
        self.met[rows] += np.bincount(at)

    def _rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots, and the place of every slot among them."""
        rows = _ranked(codes, self.slots.total)
        rows = rows[_edges(rows)]
        self.place[rows] = np.arange(len(rows))
        return rows, self.place.take(codes)


def log_probabilities(codes: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probabilities of the slots of a stream, one for each that is not the start, in its order."""
    p, slots = model.params, model.slots
    kinds = slots.kinds()
    classes, nexts = (np.ascontiguousarray(np.column_stack((p[f"q{k}"], p[f"b{k}"])).T) for k in (1, 2))
    out = np.zeros(int((codes[ORDER:] < slots.total).sum()))
    done = 0
    for at in range(ORDER, len(codes), ROWS):
        part = codes[at - ORDER : at + ROWS]
        keep = np.flatnonzero(part[ORDER:] < slots.total)
        if not len(keep):
            continue
        t = part[ORDER:].take(keep)
        kind = kinds.take(t)
        order = np.argsort(kind, kind="stable")
        t, kind = t.take(order), kind.take(order)
        guess = np.ones((len(t), WIDTH + 1), np.float32)
        guess[:, :WIDTH] = (_held(p["r"].take(part, 0)[None], len(part) - ORDER) @ p["c"]).take(keep.take(order), 0)
        found = _log_softmax(guess, classes, kind)
        edge = _edges(kind)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(t)], strict=True):
            low, to = slots.edge[kind[a]], slots.edge[kind[a] + 1]
            found[a:b] += _log_softmax(guess[a:b], nexts[:, low:to], t[a:b] - low)
        out[done + order] = found
        done += len(t)
    return out


def _log_softmax(guess: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of ``guess @ vectors`` at one place of each row."""
    logits = guess @ vectors
    own = logits[np.arange(len(logits)), at].astype(float)
    with np.errstate(over="ignore"):
        total = np.exp(logits).sum(1)
    if not (total.min() > 1e-30 and total.max() < 1e30):  # exp may have overflowed
        high = logits.max(1)
        return own - high - np.log(np.exp(logits - high[:, None]).sum(1))
    return own - np.log(total)


def lm_scoring(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, n_known, train_tokens, base_score and score.

    ``trains`` says which rows are learned from (null: not).  Scores are log10
    probabilities of whole texts with their end.

    Defined cases: a null, empty or blank text is its end alone (one token); equal
    texts get equal scores; without training rows every token is unseen; an empty
    table gives an empty result.  Columns named as a result are replaced, others
    pass through, whatever their names.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    total = text_bytes(docs, text)
    n_blocks = max(1, -(-total // B.BLOCK_BYTES))
    shard_bits = pow2(total / 60 / SHARD_KEYS)
    order = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    dealt = docs.select(
        F.pmod(order, F.lit(n_blocks)).cast("int").alias("block"),
        order.alias("order"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
        F.col(f"`{text}`").alias("text"),
        F.struct(F.lit(0), *[F.col(f"`{c}`") for c in names]).alias("row"),
    )

    def count(table: pa.Table) -> pa.Table:
        texts, learned = _whole(table.column("text")), table.column("trains").to_numpy()
        keys, counts = [np.zeros(0, U64)], [np.zeros(0)]
        for a, b in slices(texts):
            found = tokens(texts.slice(a, b - a))
            own, at = distinct(found.keys)
            keys.append(own)
            counts.append(np.bincount(at, np.repeat(learned[a:b], np.diff(found.first)).astype(float), len(own)))
        own, at = distinct(np.concatenate(keys))
        sums = np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)
        block = table.column("block")[0].as_py()
        rows = [(s, block, pack(own[a:b]), pack(sums[a:b])) for s, a, b in cut_shards(own, 64, shard_bits)]
        return _table(rows, ("shard", "block", "keys", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    def merge(table: pa.Table) -> pa.Table:
        shard, sent = table.column("shard")[0].as_py(), table.to_pydict()
        keys = [unpack(x, U64) for x in sent["keys"]]
        own, at = distinct(np.concatenate(keys))
        sums = np.bincount(at, np.concatenate([unpack(x, np.int64) for x in sent["counts"]]), len(own)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(b, shard, pack(x)) for b, x in zip(sent["block"], np.split(sums[at], ends), strict=True)]
        own, sums = own[sums > 0], sums[sums > 0]
        cells, back = np.unique(((own & CLASS_BITS).astype(np.int64) << FINE) + (own >> U64(64 - FINE)).astype(np.int64), return_inverse=True)
        rows.append((-1, shard, pack(np.concatenate((cells, np.bincount(back, sums, len(cells)).astype(np.int64), np.bincount(back, minlength=len(cells)))))))
        share = -(-3 * _slots(len(own) << shard_bits) // 4) >> shard_bits
        top = np.union1d(np.lexsort((own, -sums))[: max(1, share)], np.flatnonzero(own == END))  # the end is always a slot of its own
        rows.append((-2, shard, pack(np.concatenate((own[top].view(np.int64), sums[top])))))
        return _table(rows, ("block", "shard", "counts"), (pa.int32(), pa.int32(), pa.binary()))

    sent = dealt.select("block", "trains", "text").groupBy("block").applyInArrow(freed(count), SENT)
    counted = cut_lineage(sent.groupBy("shard").applyInArrow(freed(merge), MERGED))
    slots = _gather(counted)
    per_copy = COPY_BLOCKS * -(-slots.total // SLOTS_A_COPY)
    log_base = np.log10(slots.n + slots.v + 1)

    def encode(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({})
        texts, learned = _whole(table.column("text")), table.column("trains").to_numpy()
        copy = table.column("block")[0].as_py() // per_copy
        got = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        parts = []
        for a, b in slices(texts):
            found = tokens(texts.slice(a, b - a))
            own, at = distinct(found.keys)
            parts.append((found.first, own, at))
        own = np.unique(np.concatenate([x[1] for x in parts]))
        sums = np.concatenate([unpack(x, np.int64) for _, x in got])
        out: dict[str, list] = {name: [] for name in ("n_tokens", "n_known", "base", "inside", "codes")}
        for first, some, at in parts:
            counts, (codes, alone) = sums[np.searchsorted(own, some)], slots.codes(some)
            edge = first[:-1]
            out["n_tokens"].append(np.diff(first))
            out["n_known"].append(np.add.reduceat((counts > 0).astype(np.int64)[at], edge))
            out["base"].append(np.add.reduceat((np.log10(counts + 1.0) - log_base)[at], edge))
            out["inside"].append(np.add.reduceat(np.where(alone, 0.0, np.log10((counts + 1) / slots.bottom[codes]))[at], edge))
            codes = codes[at]
            out["codes"] += [pack(codes[x:y]) for x, y in zip(edge.tolist(), first[1:].tolist(), strict=True)]
        numbers = {n: np.concatenate(v) for n, v in out.items() if n != "codes"}
        return pa.table({"row": table.column("row"), "copy": pa.array(np.where(learned, copy, -1), pa.int32()), "order": table.column("order"), **numbers, "codes": pa.array(out["codes"], pa.binary())})

    answers = counted.where("block >= 0")
    coded = cut_lineage(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(freed_pair(encode), with_row(dealt.schema["row"].dataType, CODED)))
    model = _train(Model.fresh(slots), coded, -(-n_blocks // per_copy)) if slots.n else Model.fresh(slots)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, codes = batch.column("n_tokens").to_numpy(), batch.column("codes")
            total = np.concatenate(([0], np.cumsum(size)))
            at = 0
            while at < len(codes):
                to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
                found = log_probabilities(stream([unpack(x.as_py(), np.int32) for x in codes[at:to]], slots.total), model) / np.log(10)
                part = batch.slice(at, to - at)
                sums = np.add.reduceat(found, total[at:to] - total[at]) + part.column("inside").to_numpy()
                arrays = [part.column(n) for n in ("row", "n_tokens", "n_known")] + [pa.array(np.full(to - at, slots.n)), part.column("base"), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", *made])
                at = to

    schema = with_row(dealt.schema["row"].dataType, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return coded.mapInArrow(score, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in names], *made)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    return pa.table({name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def _gather(counted: DataFrame) -> Slots:
    """The slots, from each shard's most frequent tokens and its sums of cells: both are bounded over all shards."""
    n_cell, v_cell = np.zeros(CLASSES << FINE), np.zeros(CLASSES << FINE)
    keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for row in counted.where("block < 0").collect():
        parts = np.split(unpack(row.counts, np.int64), 3 if row.block == -1 else 2)
        if row.block == -1:
            np.add.at(n_cell, parts[0], parts[1])
            np.add.at(v_cell, parts[0], parts[2])
        else:
            keys.append(parts[0].view(U64))
            counts.append(parts[1])
    own = np.concatenate(keys)
    order = np.argsort(own)
    return Slots.of(own[order], np.concatenate(counts)[order], n_cell, v_cell)


def _train(model: Model, coded: DataFrame, copies: int) -> Model:
    """Rounds of 1, 2, 4, ... copies, each of which learns its texts once and starts from the last round's mean."""
    first = 0
    while first < copies:
        some = coded.where((F.col("copy") >= first) & (F.col("copy") <= 2 * first)).select("copy", "order", "codes")
        model = _round(model, some)
        first = 2 * first + 1
    return model


def _round(start: Model, coded: DataFrame) -> Model:
    total = start.slots.total
    cuts = np.linspace(0, total + 1, PARTS + 1).astype(int)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        number, copy = table.column("copy")[0].as_py(), Copy(start)
        copy.learn(stream([unpack(x.as_py(), np.int32) for x in table.column("codes")], total), np.random.default_rng(number))
        p, m = copy.params, copy.memory
        dense = np.concatenate([x[k].ravel() for x in (p, m) for k in DENSE])
        rows = [(-1, number, copy.seen, b"", b"", dense.tobytes())]
        for part, (low, to) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = low + np.flatnonzero(copy.met[low:to])
            flat = np.column_stack([p["r"][at], p["q2"][at], p["b2"][at], *[m[k][at] for k in BY_SLOT]])
            if len(at):
                rows.append((part, number, 0, at.astype(np.int32).tobytes(), copy.met[at].tobytes(), flat.astype(np.float32).tobytes()))
        return _table(rows, ("part", "copy", "seen", "at", "met", "x"), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))

    def mean(table: pa.Table) -> pa.Table:
        part, sent = table.column("part")[0].as_py(), table.sort_by("copy").to_pydict()
        if part < 0:
            dense = np.average([np.frombuffer(x, np.float32) for x in sent["x"]], 0, sent["seen"]) if sum(sent["seen"]) else np.frombuffer(sent["x"][0], np.float32)
            return _table([(part, b"", dense.astype(np.float32).tobytes())], ("part", "at", "x"), (pa.int32(), pa.binary(), pa.binary()))
        low, to = cuts[part], cuts[part + 1]
        sums, weight = np.zeros((to - low, 2 * WIDTH + 4)), np.zeros(to - low)
        for at, met, x in zip(sent["at"], sent["met"], sent["x"], strict=True):
            place, met = np.frombuffer(at, np.int32) - low, np.frombuffer(met, np.int64)
            sums[place] += np.frombuffer(x, np.float32).reshape(len(place), -1) * met[:, None]
            weight[place] += met
        at = np.flatnonzero(weight)
        row = (part, (at + low).astype(np.int32).tobytes(), (sums[at] / weight[at, None]).astype(np.float32).tobytes())
        return _table([row], ("part", "at", "x"), (pa.int32(), pa.binary(), pa.binary()))

    sent = coded.groupBy("copy").applyInArrow(freed(learn), "part int, copy int, seen long, at binary, met binary, x binary")
    params, memory = ({k: x.copy() for k, x in held.items()} for held in (start.params, start.memory))
    for row in sent.groupBy("part").applyInArrow(freed(mean), "part int, at binary, x binary").collect():
        flat = np.frombuffer(row.x, np.float32)
        if row.part < 0:
            at = 0
            for held in (params, memory):
                for k in DENSE:
                    held[k] = flat[at : at + held[k].size].reshape(held[k].shape).copy()
                    at += held[k].size
        else:
            at, flat = np.frombuffer(row["at"], np.int32), flat.reshape(-1, 2 * WIDTH + 4)
            params["r"][at], params["q2"][at], params["b2"][at] = flat[:, :WIDTH], flat[:, WIDTH : 2 * WIDTH], flat[:, 2 * WIDTH]
            for j, k in enumerate(BY_SLOT):
                memory[k][at] = flat[:, 2 * WIDTH + 1 + j]
    return Model(start.slots, params, memory)
