"""Token counts that follow edits.

A text is cut into leaves where nothing on one side changes the tokens of the other.
Such a cut stands before a space between two other characters; before any white space
and between letters, digits and other characters, as far as the pattern ends its
pre-tokens there; and inside a long run of letters between two whose bytes are neighbours
in no token, so that no merge can reach over them.  Two segment trees over the leaves hold sums of
characters and of tokens.  An edit re-encodes the leaves it touches (and a
neighbour whose cut it may have broken), cuts them anew if they have grown, and
updates the sums above them.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textnum import map_text

LEAF = 512
#: before a space between two characters that are no white space: safe for every pattern
SPACED = r"(?<=[^\p{White_Space}]) (?=[^\p{White_Space}])"
#: kinds of boundaries, and samples that a pattern must cut behind their first part
KINDS = {
    r"(?<=[^\p{White_Space}])(?=\p{White_Space})": [(x, rest) for x in ("a", "1", "!", "'") for rest in ("\nb", "\n\nb", "\tb", "  b", "\r\n1", " \n!", "\n")],
    r"(?<=\p{L})(?=\p{N})": [("ab", "12"), ("字", "9")],
    r"(?<=\p{N})(?=\p{L})": [("12", "ab"), ("9", "字")],
    r"(?<=\p{L})(?=[^\p{L}\p{N}\p{White_Space}])": [("ab", "!!"), ("字", "。"), ("ab", "'"), ("ab", "'s"), ("ab", "\x1c")],
    r"(?<=\p{N})(?=[^\p{L}\p{N}\p{White_Space}])": [("12", "!!"), ("9", "。"), ("1", "'s")],
    r"(?<=[^\p{L}\p{N}\p{White_Space}'])(?=\p{L})": [("!!", "ab"), ("。", "字"), ("\"", "s"), ("\x1c", "a")],
    r"(?<=[^\p{L}\p{N}\p{White_Space}'])(?=\p{N})": [("!!", "12"), ("。", "9")],
}
#: characters around a cut that keep it safe
CONTEXT = 2
RESULTS = ["n_tokens", "n_tokens_edited", "n_reencoded", "n_chars_edited"]


@dataclass(frozen=True)
class Ranks:
    """A public byte-level BPE: mergeable ranks and the pattern of pre-tokens."""

    name: str
    pattern: str
    data: bytes

    @staticmethod
    def load(path: str, pattern: str) -> Ranks:
        with open(path, "rb") as file:
            return Ranks(path, pattern, file.read())


_ENCODINGS: dict[str, object] = {}
_CUTS: dict[str, object] = {}


class Cuts:
    """Where a text may be cut so that both sides have the tokens they have together."""

    def __init__(self, ranks: Ranks) -> None:
        split = regex.compile(ranks.pattern)
        ends = lambda first, rest: split.findall(first + rest)[0] == first
        kept = [kind for kind, samples in KINDS.items() if all(ends(*x) for x in samples)]
        self.boundary = regex.compile("|".join([SPACED, *kept]))
        self.runs = split.findall("abcabc") == ["abcabc"] and split.findall("字字字") == ["字字字"]
        self.joined = np.zeros((256, 256), bool)
        for line in ranks.data.splitlines():
            token = np.frombuffer(base64.b64decode(line.split()[0]), np.uint8)
            self.joined[token[:-1], token[1:]] = True

    def _between(self, a: str, b: str) -> bool:
        """Whether no merge reaches over two letters of one pre-token."""
        return self.runs and a.isalpha() and b.isalpha() and not self.joined[a.encode()[-1], b.encode()[0]]

    def after(self, text: str, start: int) -> int | None:
        """The first place for a cut in the first stretch of LEAF characters from ``start`` that has one."""
        while start < len(text):
            end = min(len(text), start + LEAF)
            found = self.boundary.search(text, start, end)
            if found:
                return found.start()
            for k in range(start, end):
                if self._between(text[k - 1], text[k]):
                    return k
            start = end
        return None


def cuts_of(ranks: Ranks) -> Cuts:
    """The cuts of a worker, worked out once."""
    if ranks.name not in _CUTS:
        _CUTS[ranks.name] = Cuts(ranks)
    return _CUTS[ranks.name]


def encoding(ranks: Ranks):
    """The encoding of a worker, built once."""
    if ranks.name not in _ENCODINGS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.data.splitlines())}
        _ENCODINGS[ranks.name] = tiktoken.Encoding("ranks", pat_str=ranks.pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODINGS[ranks.name]


def leaves(text: str, cuts: Cuts, size: int = LEAF) -> list[str]:
    """The text in parts of about ``size`` characters that don't change each other's tokens."""
    places = [0]
    while places[-1] + size < len(text) and (found := cuts.after(text, places[-1] + size)) is not None:
        places.append(found)
    return [text[a:b] for a, b in zip(places, [*places[1:], len(text)], strict=True)]


class CountTree:
    """Segment trees of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, encode, cuts: Cuts) -> None:  # noqa: ANN001
        self.encode, self.cuts, self.reencoded = encode, cuts, 0
        leaf = leaves(text, cuts)
        self._build(leaf, [len(encode(x)) for x in leaf])

    def _build(self, leaf: list[str], tokens: list[int]) -> None:
        """Both trees over leaves whose tokens are counted."""
        self.leaf = leaf
        self.base = 1 << (len(leaf) - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.base, np.int64) for _ in range(2))
        for tree, sums in ((self.chars, [len(x) for x in leaf]), (self.tokens, tokens)):
            tree[self.base : self.base + len(leaf)] = sums
            level = self.base
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(1)
                level //= 2

    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaf)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if place - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return min(node - self.base, len(self.leaf) - 1), begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaf[leaf] = text
        node = self.base + leaf
        more_chars, more_tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters ``start`` to ``end``; places outside the text are moved into it."""
        size = int(self.chars[1])
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        low, begin = self.find(max(0, start - CONTEXT))
        if begin > start:  # the place is behind the last character
            low, begin = len(self.leaf) - 1, size - int(self.chars[self.base + len(self.leaf) - 1])
        high, _ = self.find(min(size - 1, end + CONTEXT)) if size else (0, 0)
        high = max(low, high)
        old = "".join(self.leaf[low : high + 1])
        text = old[: start - begin] + new + old[end - begin :]
        self.reencoded += len(text)
        cut = leaves(text, self.cuts)
        counts = [len(self.encode(x)) for x in cut]
        if len(cut) == high - low + 1:
            for k, (piece, count) in enumerate(zip(cut, counts, strict=True)):
                self._set(low + k, piece, count)
        else:  # the leaves it touched are cut anew, the others keep their sums
            known = self.tokens[self.base : self.base + len(self.leaf)].tolist()
            self._build([*self.leaf[:low], *cut, *self.leaf[high + 1 :]], [*known[:low], *counts, *known[high + 1 :]])


def token_counts(docs: DataFrame, ranks: Ranks, text: str = "text", edits: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens and, after the ``edits`` of each row, n_tokens_edited.

    ``edits`` names a column of array<struct<start int, end int, new string>>;
    places are characters of the text as the edits before have left it.
    n_reencoded is how many characters the edits had encoded again, n_chars_edited
    how many the text has at last.

    Defined cases: a null or empty text has no tokens and can be edited; null edits
    are none, and so is a null entry among them; a null start is 0, a null end is the
    start (an insertion), a null new text is empty; a text without safe cuts (one sign
    a million times) is one leaf; an empty table gives an empty result.  Columns (or those of ``keep``) pass through; one named as a result is
    replaced.  Rows never leave their partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    made = "__edit"
    while made in docs.columns:
        made += "_"
    source = docs.withColumn(made, F.struct(F.col(f"`{text}`").alias("text"), (F.col(f"`{edits}`") if edits else F.expr("cast(null as array<struct<start:int,end:int,new:string>>)")).alias("edits")))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]

    def measure(rows: pa.Array) -> dict:
        encode, cuts = encoding(shared.value).encode_ordinary, cuts_of(shared.value)
        out: dict[str, list] = {name: [] for name in RESULTS}
        for row in rows.to_pylist():
            tree = CountTree(row["text"] or "", encode, cuts)
            out["n_tokens"].append(tree.total())
            for e in row["edits"] or []:
                if e is not None:
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["new"] or "")
            out["n_tokens_edited"].append(tree.total())
            out["n_reencoded"].append(tree.reencoded)
            out["n_chars_edited"].append(int(tree.chars[1]))
        return {k: pa.array(v, pa.int64()) for k, v in out.items()}

    return map_text(source, made, ", ".join(f"{c} long" for c in RESULTS), measure, kept)
