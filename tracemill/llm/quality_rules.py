"""Quality rules by repetition coverage.

For n-gram lengths from two to ten words, rolling hashes extend each length from
the one before (``h[i] * base + word[i + n - 1]``), so all lengths cost one
multiplication a word.  A document is judged by the share of its characters that
lie in repeated n-grams and repeated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.textnum import IS_SPACE, Words, map_text, mix, odd_numbers, words

#: most share of a text's word characters in repeats of n-grams (first copy excluded);
#: one line of a dozen words that comes twice in a text of fifty must pass
COVER_LIMITS = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: most share of word characters that the most frequent n-gram alone covers
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: most share of the words that are one and the same word
WORD_LIMIT = 0.25
#: most share of a text's bytes in runs of three or more equal characters
RUN_LIMIT = 0.10
#: most share of a text's characters in lines that came before
LINE_LIMIT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
BASE = odd_numbers(1, 77)[0]
LONGEST = max(COVER_LIMITS)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, worst_cover double, worst_top double, top_word_share double, run_share double, base_failed boolean, kept boolean"
)


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that starts at one of ``at``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def top_share(word: np.ndarray) -> float:
    """Share of the most frequent word among all words."""
    if not len(word):
        return 0.0
    ranked = np.sort(word)
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    return float(np.diff(edges).max()) / len(word)


def run_bytes(found: Words) -> np.ndarray:
    """For each row, the bytes that lie in runs of three or more equal visible bytes."""
    data = found.data
    marked = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~IS_SPACE[data[2:]]
        for shift in range(3):
            marked[shift : shift + len(same)] |= same
    summed = np.concatenate(([0], np.cumsum(marked[:-1])))
    return np.diff(summed[found.offsets])


def repetition(word: np.ndarray, chars: np.ndarray) -> tuple[int, float, float]:
    """Words in repeated 3-word windows, worst cover and worst top share over their limits."""
    size, total = len(word), max(1, int(chars.sum()))
    repeat_words, worst_cover, worst_top = 0, 0.0, 0.0
    rolled = word
    for n in range(2, min(LONGEST, size) + 1):
        rolled = rolled[:-1] * BASE + word[n - 1 :]
        order = np.argsort(rolled, kind="stable")
        ranked = rolled[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            break  # what does not repeat at this length repeats at no greater one
        later = order[1:][same]
        if n == 3:
            both = np.zeros(len(order), bool)
            both[1:] |= same
            both[:-1] |= same
            repeat_words = int(covered(order[both], n, size).sum())
        if n in TOP_LIMITS:
            edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            k = int(np.argmax(np.diff(edges)))
            top = covered(order[edges[k] : edges[k + 1]], n, size)
            worst_top = max(worst_top, float(chars[top].sum()) / total / TOP_LIMITS[n])
        if n in COVER_LIMITS:
            share = float(chars[covered(later, n, size)].sum()) / total
            worst_cover = max(worst_cover, share / COVER_LIMITS[n])
    return repeat_words, worst_cover, worst_top


def lines(text: bytes) -> tuple[int, float]:
    """Lines with a word that equal an earlier line, and their share of the text's bytes."""
    seen, repeats, size = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                repeats += 1
                size += len(line)
            else:
                seen.add(line)
    return repeats, size / max(1, len(text))


def judge(column: pa.Array) -> dict[str, list]:
    """One value of each column of SCHEMA for every text of an Arrow column."""
    found = words(column)
    letters = np.concatenate(([0], np.cumsum((found.data & 0xC0) != 0x80)))
    chars = letters[found.end] - letters[found.start]
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[found.data])))[found.offsets]
    hashed, blob, runs = mix(found.hashes()), found.data.tobytes(), run_bytes(found)
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for i in range(len(column)):
        a, b = found.first[i], found.first[i + 1]
        n = int(b - a)
        repeat_words, cover, top = repetition(hashed[a:b], chars[a:b])
        dup_lines, line_share = lines(blob[found.offsets[i] : found.offsets[i + 1]])
        failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
        most, run = top_share(hashed[a:b]), float(runs[i]) / max(1, int(found.offsets[i + 1] - found.offsets[i]))
        good = not failed and cover <= 1 and top <= 1 and line_share <= LINE_LIMIT and most <= WORD_LIMIT and run <= RUN_LIMIT
        row = (n, int(chars[a:b].sum()), int(marks[i + 1] - marks[i]), dup_lines, repeat_words, line_share, cover, top, most, run, failed, good)
        for values, value in zip(out.values(), row, strict=True):
            values.append(value)
    return out


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measures and the verdict ``kept`` of every row.

    Defined cases: a null or empty text has no words, so it fails the base rule
    (fewer than 50 words); repeated rows are judged alike and each is returned; of
    equally frequent n-grams the one with the least hash is the most frequent;
    an empty table gives an empty result.  Columns of ``docs`` (or those of
    ``keep``) pass through; one named as a measure is replaced.  Rows never leave
    their partition, and a text is held a few times over at most.
    """
    return map_text(docs, text, SCHEMA, judge, keep)
