"""Operators 11 to 13 against brute force, and on awkward rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import filter_audit, linking, mixing, ngram_join, queries, ranked_search, sentencepieces, token_counts

DATA = "/root/testdata/sf0.001"


def _rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# 11: ranked search

ITEMS = [(1, "alpha beta GAMMA"), (2, "a b c"), (3, None), (4, ""), (5, "nothing-like-this0"), (1, "delta, alpha"), (None, "line other")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(ranked_search, "CELLS", 2000)
    monkeypatch.setattr(ranked_search, "FIRST_PART", 4)


def _found(df):
    return sorted(_rows(df, "item_id", "rank", "doc_id", "score"), key=repr)


def test_search_equals_brute_force_in_small_shards(spark, docs, small_shards):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    expected = brute.search(_rows(docs, "doc_id", "text"), _rows(items, "item_id", "text"), 50)
    assert _found(queries.op11_ranked_search(spark, DATA)) == sorted(expected, key=repr)


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_of_tied_and_repeated_documents(spark, items, small_shards, top):
    rng = random.Random(top)
    words = ["alpha", "beta", "gamma", "delta", "a", "b", "line", "ä", "9"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(120)]
    rows += [(i, "alpha beta") for i in range(200, 260)] + rows[:5] + [(None, "alpha beta"), (300, None), (301, " . ")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _found(ranked_search.ranked_search(df, items, top=top)) == sorted(brute.search(rows, ITEMS, top), key=repr)


def test_search_in_several_rounds(spark, docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "MOST_TERMS", 200)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    expected = brute.search(_rows(docs, "doc_id", "text"), _rows(items, "item_id", "text"), 7)
    assert _found(ranked_search.ranked_search(docs, items, top=7)) == sorted(expected, key=repr)


def test_search_of_awkward_rows(awkward, nothing, items):
    assert _found(ranked_search.ranked_search(awkward, items)) == sorted(brute.search(_rows(awkward, "doc_id", "text"), ITEMS, 50), key=repr)
    assert ranked_search.ranked_search(nothing, items).count() == 0
    assert ranked_search.ranked_search(awkward, items.where(F.lit(False))).count() == 0


def test_summaries_are_bounds_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    n, width = 3000, 60
    kinds = np.where(rng.random((100, width)) < 0.2, rng.integers(100, 1000, (100, width)), 0)
    drawn = kinds[rng.integers(0, 100, n)]  # documents of one kind are alike
    table = np.where(drawn > 0, drawn + rng.integers(0, 100, (n, width)), 0)
    row, ids = np.nonzero(table)
    search = ranked_search.Queries([0, 1], [np.arange(0, 9), np.arange(5, 30)], np.arange(width, dtype=np.uint64))
    search.needed = np.zeros(2, np.int64)
    shard = ranked_search.Shard(search, search.holders(), row, ids, table[row, ids], n)
    for term in range(30):
        docs, begin, columns, summaries = shard.blocks(term)
        assert sorted(docs) == sorted(np.flatnonzero(table[:, term]))
        for block, summary in zip(np.split(docs, begin[1:]), summaries, strict=True):
            assert (table[np.ix_(block, columns)].max(0) == summary).all()
    for q, own in enumerate(search.terms):
        scores = table[:, own].sum(1)
        best = np.lexsort((np.arange(n), -scores))[:10]
        docs, found = shard.search(q, np.arange(n), 10)
        assert sorted(zip(docs, found, strict=True)) == sorted((d, scores[d]) for d in best)
        # with the needed score known, few blocks are open
        search.needed[q] = scores[best[-1]]
        open_ = sum(int((shard.blocks(t)[3][:, np.searchsorted(shard.blocks(t)[2], own)].sum(1) >= search.needed[q]).sum()) for t in own)
        assert open_ < 0.7 * sum(len(shard.blocks(t)[1]) for t in own)


# 12: n-gram join


def _family(rng, base, size, share):
    """Copies of a list of words with about ``share`` of the words changed."""
    return [[w if rng.random() > share else f"{w}{rng.randrange(9)}" for w in base] for _ in range(size)]


@pytest.fixture
def families():
    rng = random.Random(8)
    texts = []
    for length, size, share in ((300, 12, 0.015), (60, 10, 0.02), (12, 10, 0.03), (900, 8, 0.012), (10, 6, 0.05)):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        texts += [" ".join(t) for t in _family(rng, base, size, share)] + [" ".join(base[: int(length * 0.93)])]
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), "one two", "one two", "one", "", None]
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    return list(zip(keys, texts, strict=True))


@pytest.mark.parametrize("task", [50, 4_000_000])
@pytest.mark.parametrize(("n", "percent"), [(3, 90), (1, 90), (3, 75)])
def test_join_equals_brute_force(spark, families, monkeypatch, n, percent, task):
    monkeypatch.setattr(ngram_join, "TASK_SIGNATURES", task)  # of 50: many ranges, and runs that they cut
    monkeypatch.setattr(linking, "CHUNK", 4)
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, shingle=n, percent=percent).collect()}
    assert got == {k: v[:2] for k, v in brute.groups(families, n, percent).items()}
    assert len({c for _, c in got.values()}) < len(got) - 5


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    while tried < 300:
        size = int(rng.integers(1, 400))
        whole = rng.integers(0, 1 << 62, size + 60).astype(np.uint64)
        drop, extra = int(rng.integers(0, 1 + size // 6)), int(rng.integers(0, 1 + min(60, size // 6)))
        a, b = np.unique(whole[:size]), np.unique(whole[drop : size + extra])
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or np.array_equal(a, b):
            continue
        tried += 1
        first, second = ngram_join.signatures([a, b], percent)
        assert len(np.intersect1d(first, second))


def test_signatures_are_few_and_selective():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64)) for _ in range(50)]
    found = ngram_join.signatures(sets, 90)
    assert max(map(len, found)) < 0.45 * 500
    assert len(np.unique(np.concatenate(found))) == sum(map(len, found))  # sets with nothing in common share none


def test_join_of_awkward_rows(awkward, nothing):
    rows = _rows(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text")
    expected = {k: v[:2] for k, v in brute.groups(rows, 3, 90).items()}
    done = ngram_join.ngram_join(awkward).collect()
    assert len(done) == awkward.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in done if r.doc_id is not None} == expected
    assert [r.component_id for r in done if r.doc_id is None] == [None]
    assert ngram_join.ngram_join(nothing).count() == 0


# 13: filter audit

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit(docs, labels):
    done = filter_audit.filter_audit(docs, labels, queries.AUDITED).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in NAMES) for r in done}


def test_audit_equals_brute_force(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    expected = brute.audit(_rows(docs, "doc_id", "text", "lang"), _rows(labels, "doc_id", "quality", "toxic"))
    assert _audit(docs, labels) == expected and len(expected) == 4 * 600


def test_audit_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (13, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    more = awkward.union(awkward.where("doc_id is null")).union(awkward.limit(3).withColumn("doc_id", F.lit(50).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    assert _audit(more, labels) == brute.audit(_rows(more, "doc_id", "text", "lang"), _rows(labels, "doc_id", "quality", "toxic"))
    assert _audit(nothing, labels) == {} and len(_audit(awkward, labels.where("false"))) > 0


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 7, 100, 1001):
        words = rng.integers(0, 1 << 32, n).astype(np.uint32)
        times = rng.integers(0, 5, n) * rng.integers(1, 10**9, n)
        expected = [int(sum(int(t) for w, t in zip(words, times, strict=True) if w >> i & 1)) for i in range(32)]
        assert filter_audit.positional_popcount(words, times).tolist() == expected


def test_survival_word_is_the_truth_table(spark):
    (row,) = spark.range(1).select(filter_audit.survival_word([F.lit(x).cast("boolean") for x in (True, False, None, True, False)]).alias("w")).collect()
    assert row.w == sum(1 << s for s in range(32) if not s & 0b01001)
    with pytest.raises(ValueError, match="subsets"):
        filter_audit.filter_audit(spark.range(0), spark.range(0), dict.fromkeys("ABCDF", "true"), copies="E")


# models that operator 3 does not know, and what it remembers


def _appended(tmp_path, number, fields):
    """The public model with fields of its part ``number`` given once more: the last ones count."""
    with open(f"{queries.TOKENIZERS}/piece_bpe_32k.model", "rb") as file:
        model = file.read()
    varint = lambda x: bytes([x & 127 | 128, x >> 7]) if x > 127 else bytes([x])
    body = b"".join(varint(k << 3 | (2 if isinstance(v, bytes) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else varint(v)) for k, v in fields.items())
    path = tmp_path / "other.model"
    path.write_bytes(model + bytes([number << 3 | 2, len(body)]) + body)
    return str(path)


@pytest.mark.parametrize(
    ("number", "fields", "said"),
    [(2, {3: 1}, "unigram"), (2, {35: 0}, "byte fallback"), (3, {1: b"nfkc", 2: b"rules"}, "normaliser nfkc"), (3, {4: 1}, "collapsed"), (3, {3: 0}, "first word"), (1, {1: b"<x>", 3: 4}, "user-defined")],
)
def test_other_models_are_turned_away(tmp_path, number, fields, said):
    with pytest.raises(ValueError, match=said):
        sentencepieces.Vocabulary.load(_appended(tmp_path, number, fields))


def test_long_stretches_are_not_remembered():
    encoder = sentencepieces.Encoder(sentencepieces.Vocabulary.load(f"{queries.TOKENIZERS}/piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(3):
        encoder.encode(["".join(rng.choices("abcdefgh", k=50_000)), "short words stay"])
    assert sum(map(len, encoder.known)) < 100 and encoder.held < 1000


# repeated keys of operator 9


def test_mixing_of_repeated_keys_is_the_same_every_time(spark):
    rows = [(7, f"{'w ' * (1 + i % 5)}{i}", "en", "s") for i in range(60)]
    one, two = (spark.createDataFrame(r, "doc_id long, text string, lang string, source string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5)))
    mixed = [sorted(_rows(mixing.mix_sources(df, [F.col("source")], {}, 0.5), "doc_id", "text")) for df in (one, two)]
    assert mixed[0] == mixed[1] != []


# operator 7 in texts without spaces

SCRIPTS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x9FA5, 7)],
    "marked": [*[chr(c) for c in range(0x4E00, 0x5200)], "。", "，", "1", "9"],
    "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="),
    "signs": list("!?.,;:'\"#-_()"),
    "contractions": ["'", "s", "t", "re", "ve", "ll", " ", "a", "1", "!", "'s"],
    "spaces": [" ", "\n", "\t", "\r\n", "a", "é", "9", "!", "\u00a0", "\x1c", "\u3000"],
    "kana": [chr(c) for c in range(0x3041, 0x30FF)],
}


@pytest.fixture(scope="module")
def counter():
    ranks = token_counts.Ranks.load(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", queries.PATTERN)
    return token_counts.encoding(ranks).encode_ordinary, token_counts.cuts_of(ranks)


@pytest.mark.parametrize("script", SCRIPTS)
def test_edits_in_every_script(counter, script, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 16)
    encode, cuts = counter
    rng, letters = random.Random(script), SCRIPTS[script]
    text = "".join(rng.choices(letters, k=600))
    tree = token_counts.CountTree(text, encode, cuts)
    assert tree.total() == len(encode(text))
    for _ in range(300):
        start = rng.randrange(len(text) + 1)
        end = min(len(text), start + rng.randrange(6))
        new = "".join(rng.choices(letters, k=rng.randrange(6)))
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert tree.text() == text and tree.total() == len(encode(text))


@pytest.mark.parametrize("script", ["chinese", "marked", "base64", "kana", "spaces"])
def test_an_edit_encodes_little_of_a_long_text(counter, script):
    encode, cuts = counter
    rng = random.Random(1)
    text = "".join(rng.choices(SCRIPTS[script], k=400_000))
    tree = token_counts.CountTree(text, encode, cuts)
    tree.edit(200_000, 200_005, text[:5])
    assert tree.reencoded < 2500 and tree.total() == len(encode(text[:200_000] + text[:5] + text[200_005:]))


def test_cuts_follow_the_pattern():
    other = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    known = token_counts.Ranks.load(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", queries.PATTERN)
    ranks = token_counts.Ranks("other", other, known.data)
    encode, cuts = token_counts.encoding(ranks).encode_ordinary, token_counts.cuts_of(ranks)
    rng = random.Random(2)
    for letters in SCRIPTS.values():
        text = "".join(rng.choices(letters, k=3000))
        assert sum(len(encode(x)) for x in token_counts.leaves(text, cuts, 16)) == len(encode(text))
