"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct stretches of text that no piece can cross are concatenated and their
suffixes sorted.  A binary search for every piece gives the range of its
occurrences; these edges, sorted by position, are the lattice of all pieces.
Relaxing it merges, in every stretch, the two neighbours that the best-scored edge
spans, until no edge spans two neighbours: the result of a BPE model's own order.
Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textnum import U64, map_text

SPACE = "▁"
#: stretches matched together, and most stretches remembered by a worker and most bytes of them
TOGETHER, REMEMBERED, REMEMBERED_BYTES = 40_000, 300_000, 64_000_000
#: stretches of more characters are not remembered
SHORT = 64
#: longer stretches are relaxed one by one with a heap
LONG = 2000
NONE = np.iinfo(np.int64).max


def _message(data: bytes) -> dict[int, list]:
    """Numbers and byte strings of a protocol buffer message by field."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            value, at = data[at : at + size], at + size
        found.setdefault(tag >> 3, []).append(value)
    return found


def unsupported(model: bytes) -> list[str]:
    """What a model file asks for that ``encode`` does not do; of repeated fields the last counts.

    Fixed values: the fields of the file format and their defaults.
    """
    whole = _message(model)
    trainer, normaliser = (_message(b"".join(whole.get(k, []))) for k in (2, 3))
    last = lambda part, field, default: part.get(field, [default])[-1]
    kinds = {1: "unigram", 2: "BPE", 3: "word", 4: "char"}
    rules = {
        f"model type {kinds.get(last(trainer, 3, 1), 'unknown')}": last(trainer, 3, 1) != 2,
        "no byte fallback": not last(trainer, 35, 0),
        "spaces behind words": bool(last(trainer, 24, 0)),
        f"normaliser {last(normaliser, 1, b'').decode('utf-8', 'replace')}": bool(last(normaliser, 2, b"")),
        "no space before the first word": not last(normaliser, 3, 1),
        "spaces collapsed": bool(last(normaliser, 4, 1)),
        "spaces not marked": not last(normaliser, 5, 1),
        "user-defined pieces": any(last(_message(p), 3, 1) == 4 for p in whole.get(1, [])),
    }
    return [name for name, met in rules.items() if met]


@dataclass(frozen=True)
class Vocabulary:
    """Ordinary pieces by id with scores; ids of the 256 bytes; what each id decodes to."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: list[int]
    decoded: list[bytes]
    name: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a model file on the driver.

        Only what ``encode`` does is taken: BPE with byte fallback, texts as they are, a
        space before the first word.  Any other model is a ValueError that says why.
        """
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            odd = unsupported(file.read())
        if odd:
            raise ValueError(f"{path}: not supported: {', '.join(odd)}")
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids, decoded, plain = [0] * 256, [b""] * n, []
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                byte_ids[value], decoded[i] = i, bytes([value])
            elif model.is_unknown(i):
                decoded[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                decoded[i] = name.replace(SPACE, " ").encode()
                plain.append(i)
        plain = [i for i in plain if names[i]]
        scores = np.array([model.get_score(i) for i in plain])
        digest = hashlib.sha256("\0".join(names).encode()).hexdigest()
        return Vocabulary([names[i] for i in plain], np.array(plain), scores, byte_ids, decoded, digest)


def _words(rows: np.ndarray, width: int) -> list[np.ndarray]:
    """Rows of letter numbers packed into 64-bit words, the first letters highest."""
    per = 64 // width
    words = [np.zeros(len(rows), U64) for _ in range(-(-rows.shape[1] // per))]
    for k in range(rows.shape[1]):
        words[k // per] |= rows[:, k].astype(U64) << U64(width * (per - 1 - k % per))
    return words


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """Words as fixed-width byte strings in the same order."""
    packed = np.stack(words, 1).astype(">u8")
    return packed.view(f"S{packed.shape[1] * 8}")[:, 0]


@dataclass
class Encoder:
    """Encodes texts with one vocabulary and remembers the stretches it met."""

    vocabulary: Vocabulary
    known: dict[str, bytes] = field(default_factory=dict)
    held: int = 0

    def __post_init__(self) -> None:
        pieces = self.vocabulary.pieces
        self.longest = max(map(len, pieces), default=1)
        self.factor = self.longest + 1  # positions and lengths share one number
        letters = sorted({c for p in pieces for c in p})
        self.code = np.ones(max(map(ord, letters), default=0) + 2, np.int64)  # 1: in no piece
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.letters = len(letters) + 2
        self.rank = np.empty(len(pieces), np.int64)
        self.rank[np.lexsort((np.arange(len(pieces)), -self.vocabulary.scores))] = np.arange(len(pieces))
        self.by_rank = np.argsort(self.rank)
        self.rows = np.zeros((len(pieces), self.longest), np.int64)
        for i, p in enumerate(pieces):
            self.rows[i, : len(p)] = self.code[[ord(c) for c in p]]
        self.sizes = np.array([len(p) for p in pieces])
        crossed = any(SPACE in p.lstrip(SPACE) for p in pieces)
        line = "" if "\n" in letters else "\n"
        self.stretch = re.compile(".+" if crossed else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else ""), re.S)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece, as sorted position * factor + length, and its rank."""
        there = np.zeros(self.letters, bool)
        there[codes] = there[0] = True
        small = np.cumsum(there) - 1  # the letters of this text alone, so that more of them fit into a word
        width = int(small[-1] + 1).bit_length()
        usable = np.flatnonzero(there[self.rows].all(1))
        rows, sizes = small[self.rows[usable]], self.sizes[usable]
        open_end = np.where(np.arange(self.longest) < sizes[:, None], rows, (1 << width) - 1)
        padded = np.concatenate((small[codes], np.zeros(self.longest, np.int64)))
        words = _words(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(codes)], width)
        order = np.lexsort(words[::-1])
        ranked = _keys([w[order] for w in words])
        low, high = np.searchsorted(ranked, _keys(_words(rows, width)), "left"), np.searchsorted(ranked, _keys(_words(open_end, width)), "right")
        counts = high - low
        into = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
        keys = order[into] * self.factor + np.repeat(sizes, counts)
        by_place = np.argsort(keys, kind="stable")
        return keys[by_place], np.repeat(self.rank[usable], counts)[by_place]

    def _found(self, keys: np.ndarray, ranks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of the piece from start to end, or NONE."""
        size = end - start
        wanted = start * self.factor + np.minimum(size, self.factor - 1)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[place] == wanted) & (size <= self.longest), ranks[place], NONE)

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches."""
        learned: dict[str, bytes] = {}
        text = "\0".join(stretches) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = self.code[np.minimum(points, len(self.code) - 1)]
        sizes = np.array([len(s) for s in stretches])
        first = np.cumsum(sizes + 1) - sizes - 1
        codes[first + sizes] = 0
        keys, ranks = self.edges(codes)
        if not len(keys):
            keys, ranks = np.array([-1]), np.array([NONE])
        inside = np.ones(len(codes), bool)
        inside[first + sizes] = False
        start = np.flatnonzero(inside)
        owner = np.repeat(np.arange(len(stretches)), sizes)
        done_start, done_end, done_owner = [], [], []
        long = sizes[owner] > LONG
        if long.any():
            for i in np.flatnonzero(sizes > LONG):
                cuts = self._relax_long(int(first[i]), int(sizes[i]), keys, ranks)
                done_start.append(cuts[:-1])
                done_end.append(cuts[1:])
                done_owner.append(np.full(len(cuts) - 1, i))
            start, owner = start[~long], owner[~long]
        end = start + 1
        pair = np.full(len(start), NONE)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pair[near] = self._found(keys, ranks, start[near], end[near + 1])
        while len(start):
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(pair, edge)
            count = np.diff(edge, append=len(start))
            over = np.repeat(best == NONE, count)
            if over.any():
                done_start.append(start[over])
                done_end.append(end[over])
                done_owner.append(owner[over])
                start, end, owner, pair = start[~over], end[~over], owner[~over], pair[~over]
                if not len(start):
                    break
                edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                best, count = best[best != NONE], np.diff(edge, append=len(start))
            hits = np.flatnonzero(pair == np.repeat(best, count))
            left = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]  # ties: the leftmost
            end[left] = end[left + 1]
            keep = np.ones(len(start), bool)
            keep[left + 1] = False
            moved = np.cumsum(keep)[left] - 1
            start, end, owner, pair = start[keep], end[keep], owner[keep], pair[keep]
            for change in (moved - 1, moved):
                change = change[change >= 0]
                last = change + 1 >= len(start)
                pair[change[last]] = NONE
                change = change[~last]
                same = owner[change] == owner[change + 1]
                pair[change[~same]] = NONE
                change = change[same]
                pair[change] = self._found(keys, ranks, start[change], end[change + 1])
        start, end, owner = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (done_start, done_end, done_owner))
        order = np.argsort(start, kind="stable")
        start, end, owner = start[order], end[order], owner[order]
        rank = self._found(keys, ranks, start, end)
        ids = np.full(len(start), -1, np.int32)
        ids[rank != NONE] = self.vocabulary.ids[self.by_rank[rank[rank != NONE]]]
        edges = np.searchsorted(owner, np.arange(len(stretches) + 1))
        blob, plain = ids.tobytes(), np.add.reduceat(ids < 0, edges[:-1]) == 0
        for i, s in enumerate(stretches):
            a, b = int(edges[i]), int(edges[i + 1])
            if plain[i]:
                learned[s] = blob[4 * a : 4 * b]
            else:
                out: list[int] = []
                for x, at in zip(ids[a:b].tolist(), start[a:b].tolist(), strict=True):
                    out += [x] if x >= 0 else [self.vocabulary.byte_ids[v] for v in text[at].encode("utf-8", "replace")]
                learned[s] = np.array(out, np.int32).tobytes()
        return learned

    def _relax_long(self, first: int, size: int, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Cuts of one long stretch: merges from a heap of (rank, start, end)."""
        a, b = np.searchsorted(keys, (first * self.factor, (first + size) * self.factor))
        rank = dict(zip(keys[a:b].tolist(), ranks[a:b].tolist(), strict=True))
        end = {i: i + 1 for i in range(first, first + size)}
        begin = {i + 1: i for i in range(first, first + size)}
        heap: list[tuple[int, int, int]] = []

        def offer(x: int, y: int) -> None:
            if y - x <= self.longest and x * self.factor + y - x in rank:
                heapq.heappush(heap, (rank[x * self.factor + y - x], x, y))

        for i in range(first, first + size - 1):
            offer(i, i + 2)
        while heap:
            _, x, y = heapq.heappop(heap)
            middle = end.get(x)
            if middle is None or middle == y or end.get(middle) != y:
                continue
            del end[middle], begin[middle]
            end[x], begin[y] = y, x
            if x in begin:
                offer(begin[x], y)
            if y in end:
                offer(x, end[y])
        return np.array([*sorted(end), first + size])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as little-endian 32-bit numbers; none for null and empty."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        fresh: set[str] = set()
        long: list[str] = []  # known while these texts are encoded

        def learn() -> None:
            for s, ids in (learned := self.learn(sorted(fresh))).items():
                if len(s) > SHORT:
                    long.append(s)
                else:
                    self.held += 4 * len(s) + len(ids)
            self.known.update(learned)
            fresh.clear()

        for t in marked:
            fresh |= set(self.stretch.findall(t)).difference(self.known)
            if len(fresh) >= TOGETHER:
                learn()
        if fresh:
            learn()
        # found twice, as lists of all stretches would live through the learning and leave memory in pieces
        out = [b"".join(map(self.known.__getitem__, self.stretch.findall(t))) for t in marked]
        for s in long:
            self.known.pop(s, None)
        return out


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    text = b"".join(map(vocabulary.decoded.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the ids of the whole text of every row.

    Defined cases: null and empty texts have no ids; characters without a piece
    become their UTF-8 bytes; equal texts have equal ids; a text without spaces is
    one long stretch and takes time in proportion to its length (times a log); an
    empty table gives an empty result.  Columns (or those of ``keep``) pass
    through; one named ``out`` is replaced.  Rows never leave their partition; the
    vocabulary is a bounded file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def measure(column: pa.Array) -> dict:
        own = shared.value
        if own.name not in _ENCODERS:
            _ENCODERS[own.name] = Encoder(own)
        found = _ENCODERS[own.name].encode(column.to_pylist())
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
        return {out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))}

    return map_text(docs, text, f"{out} array<int>", measure, keep)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids of every row.

    Defined cases: null ids give null, no ids the empty text; an empty table gives an
    empty result.  Columns pass through; one named ``out`` is replaced.  Rows never
    leave their partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c != out]

    @F.pandas_udf("string")
    def texts(column):  # noqa: ANN001, ANN202
        return column.map(lambda x: None if x is None else decode_ids(x.tolist(), shared.value))

    return docs.select(*[F.col(f"`{c}`") for c in kept], texts(F.col(f"`{ids}`")).alias(out))
