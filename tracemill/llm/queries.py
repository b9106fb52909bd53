"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.filter_audit import filter_audit
from tracemill.llm.lm_scoring import lm_scoring
from tracemill.llm.mixing import mix_sources
from tracemill.llm.near_dedup import near_dedup
from tracemill.llm.ngram_join import ngram_join
from tracemill.llm.quality_rules import quality_rules
from tracemill.llm.ranked_search import ranked_search
from tracemill.llm.sentencepieces import Vocabulary, decode, encode
from tracemill.llm.substring_dedup import substring_dedup
from tracemill.llm.token_counts import Ranks, token_counts
from tracemill.llm.toxicity import fit, toxicity
from tracemill.llm.warc_derivatives import build_derivatives, responses
from tracemill.llm.winnowing import hashes, likeness, winnow, with_next

#: vocabulary files of public tokenizers
TOKENIZERS = "/opt/tokenizers"
#: fixed value: the pre-token pattern that belongs to the byte-level BPE files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned only where crc32(doc_id) mod 5 is not 0; the score sees the text alone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels)
    done = toxicity(docs, model, keep=["doc_id"])
    return done.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Digests of each text's ids and of what they decode to, and whether that is the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = Vocabulary.load(model)
    done = decode(encode(docs, vocabulary), vocabulary)
    ids = F.array_join("token_ids", " ")
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints (``position:hash`` in order) of every text and of its edited text, and likeness of the text's to the edited and the next one's.

    A text is fingerprinted once: the row before it gets its hashes with its text.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def measured(df: DataFrame) -> DataFrame:
        return winnow(df, "text", "own").withColumn("own_set", hashes("own"))

    both = with_next(docs, "doc_id", "text", "after", carried=("text", "own_set"), prepare=measured).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("after.text"), F.lit(1), half))
    done = winnow(both.withColumn("edited", edited), "edited", "changed").withColumn("changed_set", hashes("changed"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["position"].cast("string"), x["hash"].cast("string"))), " ")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        listed("own").alias("fingerprint"),
        listed("changed").alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("changed_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("after.own_set")).alias("near_next"),
        F.size("own").cast("long").alias("n_kept"),
    )


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's response and the two records derived from it, blocks as digests."""
    records = responses(_table(spark, sf_dir, "pages"))
    both = records.unionByName(build_derivatives(records))
    header = F.filter("source_headers", lambda h: F.lower(h["name"]) == "content-type")[0]["value"].alias("source_content_type")
    head = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", header, "block_digest", "payload_digest"]
    return both.select(*head, F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Counts of every text before and after a replacement, an insertion and a deletion in it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    place = lambda share: F.floor(n * share).cast("int")
    edit = lambda start, size, new: F.struct(start.alias("start"), (start + size).cast("int").alias("end"), F.lit(new).alias("new"))
    edits = F.array(edit(place(0.25), 20, " edited"), edit(place(0.5), 0, " some more words"), edit(place(0.75), 15, ""))
    return token_counts(docs.withColumn("edits", edits), Ranks.load(ranks, PATTERN), edits="edits", keep=["doc_id"])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    done = lm_scoring(docs, ~held_out, keep=["doc_id"])
    return done.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), *done.columns[1:])


#: what part of all tokens the mixed corpus has, and the weights of its tree
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7
MIX_WEIGHTS = {
    ("web",): 5.0,
    ("books",): 3.0,
    ("reference",): 2.0,
    **{(domain, lang): weight for domain in ("web", "books", "reference") for lang, weight in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))},
}


def mix_levels() -> list:
    """Domain, language and source; the domain follows from the source's number."""
    number = F.try_to_number(F.regexp_extract("source", r"(\d+)$", 1), F.lit("999999999")).cast("long")
    domain = F.when(F.col("source").isNull(), F.lit(None)).when(number < 5, "web").when(number < 12, "books").otherwise("reference")
    return [domain, F.col("lang"), F.col("source")]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_sources(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", "lang", "source", "mix_tokens", "mix_epoch", "mix_budget")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


#: failure conditions of the audited filters, on the columns of ``measured``; the fifth, E, fails copies
AUDITED = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "text rlike '[#$%&*|]'",
}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), AUDITED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: every window's words joined by spaces, which words do not hold, stand for its word sequence
SUBSTRING_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
     p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
     x as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as s from p),
     f as (select s, min(doc_id) as first_id from x group by s),
     gone as (select distinct doc_id, unnest(range(i, i + 13)) as pos from x join f using (s) where first_id < doc_id),
     t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
     k as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as kept from t anti join gone using (doc_id, pos) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
NEAR_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     s as (select distinct doc_id, w[i] || ' ' || w[i + 1] as s from (select doc_id, w, unnest(range(1, len(w))) as i from d) p union all select doc_id, w[1] from d where len(w) = 1),
     n as (select doc_id, count(*) as n from s group by doc_id),
     c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
     e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
     both_ways as (select a, b from e union all select b, a from e),
     reach(a, b) as (select doc_id, doc_id from d union select reach.a, l.b from reach join both_ways l on reach.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.b) as component_id, d.doc_id = min(reach.b) as kept from d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
SEARCH_SQL = r"""
with t as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
     q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
     d as (select r, doc_id, count(*) as n from t group by all),
     c as (select count(*) as documents, sum(n)::bigint as length from d),
     f as (select r, term, count(*) as tf from t group by all),
     w as (select term, floor(1000 * ln((2 * any_value(documents) + 2)::double / (2 * count(*) + 1)))::bigint as w from f, c group by term),
     s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length))))::bigint as score
           from q join w using (term) join f using (term) join d using (r), c group by all),
     k as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""
JOIN_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
     s as (select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3) p
           union all select doc_id, array_to_string(w, ' ') from d where len(w) in (1, 2)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
     e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
     both_ways as (select a, b from e union all select b, a from e),
     reach(a, b) as (select doc_id, doc_id from d union select reach.a, l.b from reach join both_ways l on reach.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.b) as component_id from d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
AUDIT_SQL = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
     w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, min(doc_id) over (partition by text) as first_id from t),
     l as (select doc_id, max(quality) as good, max(toxic) as toxic from labels group by doc_id),
     f as (select part, coalesce(good = 1, false) as good, coalesce(toxic = 1, false) as toxic,
                  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * upper > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] as fails
           from w left join l using (doc_id)),
     c as (select part, good, toxic, fails, count(*) as n from f group by all),
     x as (select unnest([1, 2, 3, 4, 5]) as k),
     o as (select [a.k, b.k, c.k, d.k, e.k] as ks from x a, x b, x c, x d, x e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
     s as (select array_to_string([substr('ABCDE', i, 1) for i in ks], '') as filter_order, k as step, ks[k] as own, ks[1:k - 1] as earlier from o, x),
     m as (select filter_order, step, own, part, good, toxic, n, fails[own] as failed, len([i for i in earlier if fails[i]]) > 0 as gone, len([y for y in fails if y]) as failures from s, c),
     r as (select part, filter_order, step, own,
                  coalesce(sum(n) filter (where not gone and not failed), 0)::bigint as kept, coalesce(sum(n) filter (where not gone and failed), 0)::bigint as removed,
                  coalesce(sum(n) filter (where gone and failed), 0)::bigint as redundant, coalesce(sum(n) filter (where failed and failures = 1), 0)::bigint as unique_fails,
                  coalesce(sum(n) filter (where not gone and failed and good), 0)::bigint as good_lost, coalesce(sum(n) filter (where not gone and failed and toxic), 0)::bigint as toxic_lost
           from m group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result it can express."""
    return {"op2_substring_dedup": SUBSTRING_SQL, "op6_near_dedup": NEAR_SQL, "op11_ranked_search": SEARCH_SQL, "op12_ngram_join": JOIN_SQL, "op13_filter_audit": AUDIT_SQL}
