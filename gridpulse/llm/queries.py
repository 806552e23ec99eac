"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.catalog.base import Catalog
from gridpulse.llm import (
    archives, audit, backoff, chunks, compression, decontamination, exact, forest, language, mixture, quality, simhash,
    toxicity,
)

catalog = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What both engines take as words: A-Z lowered, then runs of letters, digits and non-ASCII.
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@catalog.query(
    rf"""
with d as (
    select doc_id, row_number() over () as row_no,
           regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
b as (
    select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
    select distinct item_id, least(13, len(w)) as n,
           array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as words
    from (select item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i
          from b where len(w) > 0)),
lengths as (select distinct n from windows),
found as (
    select row_no, i, n, item_id
    from (select row_no, i, n, array_to_string(w[i:i + n - 1], ' ') as words
          from (select row_no, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
                from d, lengths where len(w) >= n))
    join windows using (n, words)),
hit as (
    select row_no, count(distinct p) as n_hit
    from (select row_no, unnest(generate_series(i, i + n - 1)) as p from (select distinct row_no, i, n from found))
    group by 1),
named as (
    select row_no, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct row_no, cast(item_id as varchar) as item from found) group by 1)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (row_no) left join named using (row_no)"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@catalog.query(
    r"""
with d as (
    select doc_id, length(coalesce(text, '')) as points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
    from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256 order by points desc, doc_id)"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


@catalog.query()
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


@catalog.query()
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


@catalog.query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@catalog.query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@catalog.query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@catalog.query()
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"))


@catalog.query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents"))


@catalog.query(
    r"""
with p as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages),
f as (
    select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first
    from p)
select page_id, payload_bytes, payload_digest,
       case when page_id <> first then 'revisit' else 'response' end as record_type,
       case when page_id <> first then first end as refers_to
from f"""
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@catalog.query()
def capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages")).drop("archive", "offset", "position")


@catalog.query(
    rf"""
with d as (
    select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
pairs as (
    select doc_id, unnest(list_zip(list_concat(['<s>'], w[:-2]), w)) as p, unnest(w) as second
    from d where len(w) > 0),
duo as (select doc_id, p[1] as first, second from pairs),
firsts as (select doc_id, first from duo union all select doc_id, w[-1] from d where len(w) > 0),
own as (select doc_id, first, second, count(*) as t from duo group by 1, 2, 3),
own_first as (select doc_id, first, count(*) as t from firsts group by 1, 2),
counts as (select first, second, sum(t) as n from own group by 1, 2),
singles as (select first, sum(t) as n from own_first group by 1),
sizes as (select doc_id, len(w) as n, sum(len(w)) over () as total from d where len(w) > 0),
sums as (
    select o.doc_id, sum(o.t) as n_words, sum(case when c.n = o.t then o.t else 0 end) as n_backed_off,
           sum(o.t * case when c.n > o.t then ln((c.n - o.t) / (f.n - of.t))
                          else ln(0.4 * greatest(s.n - os.t, 0.5) / greatest(z.total - z.n, 1)) end) as logs
    from own o join counts c using (first, second)
         join singles f on f.first = o.first join own_first of on of.doc_id = o.doc_id and of.first = o.first
         join singles s on s.first = o.second join own_first os on os.doc_id = o.doc_id and os.first = o.second
         join sizes z on z.doc_id = o.doc_id
    group by 1)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_backed_off, 0) as bigint) as n_backed_off,
       round(coalesce(logs, 0), 4) as log_score
from d left join sums using (doc_id)"""
)
def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"))


@catalog.query(
    r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents),
f as (
    select doc_id, part,
           case when len(w) < 200 then 1 else 0 end
           + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
           + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end
           + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
           + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as fails
    from d),
l as (
    select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
    from labels group by 1),
c as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from f left join l using (doc_id) group by 1, 2),
k(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select [a.letter, b.letter, x.letter, y.letter, z.letter] as letters, [a.bit, b.bit, x.bit, y.bit, z.bit] as bits
    from k a, k b, k x, k y, k z where a.bit + b.bit + x.bit + y.bit + z.bit = 31
      and len(list_distinct([a.bit, b.bit, x.bit, y.bit, z.bit])) = 5),
s as (
    select array_to_string(letters, '') as filter_order, step, bits[step] as own,
           cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as before
    from orders, (select unnest([1, 2, 3, 4, 5]) as step))
select part, filter_order, step,
       cast(sum(case when fails & (own | before) = 0 then n else 0 end) as bigint) as kept,
       cast(sum(case when fails & own <> 0 and fails & before = 0 then n else 0 end) as bigint) as removed,
       cast(sum(case when fails & own <> 0 and fails & before <> 0 then n else 0 end) as bigint) as redundant,
       cast(sum(case when fails = own then n else 0 end) as bigint) as unique_fails,
       cast(sum(case when fails & own <> 0 and fails & before = 0 then good else 0 end) as bigint) as good_lost,
       cast(sum(case when fails & own <> 0 and fails & before = 0 then toxic else 0 end) as bigint) as toxic_lost,
       cast(sum(case when fails & own <> 0 then n * (120 // bit_count(fails)) else 0 end) as bigint) as shapley
from c, s group by 1, 2, 3"""
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _assigned(n: int) -> str:
    return f"""
assigned_{n} as (
    select r, p, min(d * 64 + e) as k
    from (select r, p, e, sum((x - c) * (x - c)) as d from parts join book_{n} using (p, j) group by 1, 2, 3) group by 1, 2)"""


def _improved(n: int) -> str:
    return f"""{_assigned(n)},
book_{n + 1} as (
    select p, e, j, coalesce(m, c) as c
    from book_{n} left join (
        select p, k % 64 as e, j, cast(floor(sum(x) / count(*)) as bigint) as m
        from parts join assigned_{n} using (r, p) group by 1, 2, 3) using (p, e, j))"""


@catalog.query(
    rf"""
with v as (select row_number() over (order by vec_id) - 1 as r, vec_id, label, embedding from embeddings),
values_of as (select r, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from v where embedding is not null),
kept as (
    select r, row_number() over (order by r) - 1 as place
    from (select r from values_of group by 1 having bool_and(x is not null and isfinite(x)))),
parts as (
    select r, i // w as p, i % w as j, cast(floor(256 * cast(x as double)) as bigint) as x
    from values_of join kept using (r), (select (max(i) + 1) // 16 as w from values_of)),
book_0 as (select p, place as e, j, x as c from parts join kept using (r) where place < 64),{_improved(0)},{_improved(1)},{_assigned(2)},
codes as (
    select r, string_agg(lower(lpad(to_hex(cast(k % 64 as bigint)), 2, '0')), '' order by p) as code,
           cast(sum(k // 64) as bigint) as error
    from assigned_2 group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(c as varchar), ',' order by p, e, j)) from book_2) as codebooks_sha256
from codes join v using (r)"""
)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.vector_codes(table(spark, sf_dir, "embeddings"))


@catalog.query()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@catalog.query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
