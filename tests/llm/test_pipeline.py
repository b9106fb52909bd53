"""The pipeline against its stages in plain Python."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from tracemill.llm import mixing, queries, quality_rules, sentencepieces

DATA = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "sentencepiece"]


def test_run_equals_brute_force(spark, docs):
    import pyarrow as pa

    rows = {r.doc_id: r for r in docs.collect()}
    judged = quality_rules.judge(pa.array([r.text for r in rows.values()]))
    texts = {k: rows[k].text for k, good in zip(rows, judged["kept"], strict=True) if good}
    kept = {k for k, (_, _, first) in brute.groups(list(texts.items()), 5).items() if first}
    cut = {k: v for k, v in brute.passages([(k, texts[k]) for k in kept]).items() if not v[1] or v[1] < v[0]}
    gone = brute.removed([(k, texts[k]) for k in kept])
    final = {k: brute.without(texts[k], gone[k]) for k in cut}
    assert all(brute.words(final[k]) == brute.words(text) for k, (_, _, text) in cut.items()) and any("\n" in final[k] for k, (_, n, _) in cut.items() if n)
    tokens = {k: len(brute.words(t)) for k, t in final.items()}
    levels = docs.select("doc_id", *[c.alias(f"l{i}") for i, c in enumerate(queries.mix_levels())]).collect()
    leaf = {}
    for r in levels:
        if r.doc_id in final:
            leaf.setdefault((r.l0, r.l1, r.l2), []).append(r.doc_id)
    held = {p: sum(tokens[k] for k in v) for p, v in leaf.items()}
    plan = mixing.budgets(mixing.tree(held, queries.MIX_WEIGHTS, 1), corpus_pipeline.SHARE * sum(held.values()))
    expected = set()
    for p, v in leaf.items():
        whole = plan[p] // held[p] if held[p] else 0
        expected |= set(v) if whole else {k for k, _ in brute.prefix(v, tokens, plan[p], queries.MIX_SEED, 0)} if plan[p] else set()
    done = corpus_pipeline.run(spark, DATA)
    got = {r.doc_id: r for r in done.collect()}
    assert done.columns == [*docs.columns, "token_ids"] and set(got) == expected
    vocabulary = sentencepieces.Vocabulary.load(corpus_pipeline.MODEL)
    for k, r in got.items():
        assert r.text == final[k] and r.n_chars == len(final[k]) and sentencepieces.decode_ids(list(r.token_ids), vocabulary) == final[k]


def test_stages_take_no_rows(spark, docs):
    none = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
