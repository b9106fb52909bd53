"""Plain Python versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def removed(rows, window=13):
    """Which words of each text are in a window that a smaller key has."""
    first, out = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), key)
    for key, text in rows:
        w = words(text)
        out[key] = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                out[key][i : i + window] = [True] * window
    return out


def passages(rows, window=13):
    gone = removed(rows, window)
    return {k: (len(gone[k]), sum(gone[k]), " ".join(x for x, g in zip(words(t), gone[k], strict=True) if not g)) for k, t in rows}


def without(text, gone):
    """The text without each removed word and the white space behind it."""
    out, at = [], 0
    spans = [m.span() for m in WORD.finditer(text or "")]
    for i, ((start, _), g) in enumerate(zip(spans, gone, strict=True)):
        if g:
            out.append(text[at:start])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(text)
    return "".join([*out, (text or "")[at:]])


def shingles(text, n):
    w = words(text, lower=True)
    return set(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, percent=80):
    sets, parent, holders = {k: shingles(t, n) for k, t in rows}, {k: k for k, _ in rows}, defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(sets):
        shared = Counter(j for s in sets[k] for j in holders[s])
        for s in sets[k]:
            holders[s].append(k)
        for j, c in shared.items():
            if 100 * c >= percent * (len(sets[k]) + len(sets[j]) - c):
                a, b = top(k), top(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), top(k), top(k) == k) for k in sets}


def base_measures(text):
    text = text or ""
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = [False] * len(w)
    for i, gram in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if count[gram] > 1:
            covered[i : i + 3] = [True] * 3
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, sum(covered), n < 50 or 100 * sum(covered) > 50 * n


def unigrams(rows, trains):
    tokens = {k: [*words(t, lower=True), None] for k, t in rows}
    count = Counter(x for k in tokens if trains(k) for x in tokens[k])
    n, v = sum(count.values()), len(count)
    return {k: (len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for k, t in tokens.items()}


def prefix(rows, tokens, left, seed, epoch):
    taken, run = [], 0
    for key in sorted(rows, key=lambda k: (hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).hexdigest(), k)):
        run += tokens[key]
        if run > left:
            break
        taken.append((key, epoch))
    return taken


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(rows, items, top):
    """(item, rank, key, score) of the best documents of each item; rows and items are (key, text)."""
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    held = [(k, Counter(terms(t))) for k, t in rows]
    held = [(k, c) for k, c in held if c]
    n, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    wanted, out = defaultdict(set), []
    for item, text in items:
        wanted[item] |= set(terms(text))
    for item, own in wanted.items():
        scored = []
        for k, c in held:
            m = 50 + 50 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, rank, k, -s) for rank, (s, _, _, k) in enumerate(sorted(scored)[:top], 1)]
    return out


def audit(rows, labels):
    """Rows of the audit by the definition: every order, filter by filter; rows are (key, text, lang), labels (key, quality, toxic)."""
    good, toxic = ({k for k, *x in labels if x[i] == 1 and k is not None} for i in (0, 1))
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    fails = []
    for k, t, lang in rows:
        t = t or ""
        w = words(t)
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and first[t] < k,
        }
        fails.append((k, lang or "", {f for f, bad in failed.items() if bad}))
    out = {}
    for part in {p for _, p, _ in fails}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed, kept = [x for x in left if f in x[2]], [x for x in left if f not in x[2]]
                alone = sum(x[2] == {f} for x in fails if x[1] == part)
                out[part, "".join(order), step] = [len(kept), len(removed), sum(f in x[2] for x in gone), alone, sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed), f]
                shapley[f] += len(removed)
                gone, left = gone + removed, kept
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}
