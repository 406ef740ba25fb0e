"""Queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fill_in_middle, language, mixing, near_dup, ngram_join, pii, quality, sharding, suffix_dedup, tokens, warc
from .common import read_table


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "piece_bpe_32k.model")
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without doc_id isn't."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    out = language.identify(docs.select("doc_id", "text", "held_out"), docs.filter(~F.col("held_out")).select("text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op10_shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_minhash_odd_sketch, op2_spaced_seeds, op3_quality_llr, op4_mix_sources, op5_warc_index, op6_pii_spans, op7_suffix_array, op8_token_counts, op9_language_id, op10_shard_pack, op11_source_divergence, op12_fill_in_middle, op13_ngram_join)}

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op4_mix_sources": rf"""
with d as (select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
s as (select source, sum(size)::double as s from d group by source),
r as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source)) - 1) % 3 + 1]::double as w from s),
c as (select *, coalesce(sum(s) over b, 0) as below, coalesce(sum(w) over b, 0) as wb, sum(s) over () as total, sum(w) over () as wt
      from r window b as (order by s / w, source is null, source rows between unbounded preceding and 1 preceding)),
l as (select *, 1.5 * total - 2.0 * below as rest, wt - wb as wrest, 2.0 * s as cap from c),
a as (select rest as rest, wrest as wrest from l where rest * w <= cap * wrest order by s / w, below limit 1),
t as (select l.source, l.s, coalesce(least(a.rest::double * l.w / a.wrest::double, l.cap::double), l.cap::double)::double as target from l left join a on true),
m as (select d.doc_id, d.size, t.s::bigint as source_size, t.target, coalesce(t.target / nullif(t.s, 0), 0.0) as rate,
      ('0x' || left(md5(coalesce(d.doc_id::varchar, 'null') || '|' || md5(coalesce(d.text, '')) || '|mix-1'), 12))::bigint / 281474976710656.0::double as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + (u < rate - floor(rate))::bigint) as taken from m""",
    "op5_warc_index": """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest, case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
case when page_id <> first then first end as refers_to from p left join f using (payload_digest)""",
    "op11_source_divergence": r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as k from documents),
w as (select lang, source, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct k) as docs from w group by all),
kept as (select lang, term, sum(n)::hugeint as n from c group by all having sum(docs) >= 30),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by lang),
g as (select distinct lang, source from d),
e as (select g.lang, g.source, kept.term, kept.n as ln, coalesce(c.n, 0)::hugeint as n from g join kept using (lang) left join c using (lang, source, term)),
s as (select lang, source, sum(n)::hugeint as n from e group by all),
p as (select e.lang, e.source, e.term, e.n, 1 + 1000000000::hugeint * (e.n + 5) // (s.n + 5 * l.v) as p, 1 + 1000000000::hugeint * (ln + 5) // (l.n + 5 * l.v) as q
      from e join s using (lang, source) join l using (lang)),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
      left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
k as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r)
select lang, source, part, item, value, rank from k where part = 'pair' or rank <= 50""",
    "op12_fill_in_middle": """
with h as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || doc_id) as h from documents),
k as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
      case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
p as (select *, substring(t, 1, i) as a, substring(t, i + 1, j - i) as b, substring(t, j + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256,
sha256(t) as restored_sha256 from p""",
}
