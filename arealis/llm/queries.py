"""The corpus operators bound to the given tables, each query beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, cotraining, decontaminate, disclosure, hard_negatives, host_rules, html_text, length_histogram, line_dedup, ngram_join, packing, superminhash,
    url_filter,
)
from .common import stash, table

#: The url rules of the contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Domains on the block list.
LISTED_DOMAINS = ["spam-farm.example.org", "spam-farm.example.net", "cheap-pills.example.org", "cheap-pills.example.net", "cheap-pills.example.com"]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    listed = spark.createDataFrame([(x,) for x in LISTED_DOMAINS], "entry string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, listed)


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *host_rules.METRICS, "base_failed", "soft_failed", "host", F.round("rate", 9).alias("rate"), "kept")


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.with_suffix_sums(stash(length_histogram.histogram(length_histogram.token_counts(table(spark, sf_dir, "documents"))), "lengths"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_equal", "n_near")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_url_filter, op3_cotraining_quality, op4_decontaminate, op5_best_fit_packing, op6_html_text, op7_disclosure,
    op8_host_rules, op9_length_histogram, op10_line_dedup, op11_hard_negatives, op12_collocations, op13_superminhash)}

_RULES_SQL = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
_LISTED_SQL = ", ".join(f"('{d}')" for d in LISTED_DOMAINS)

ORACLES = {
    "op1_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g
  from w, unnest(range(1, greatest(2, len(w) - 1))) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
reach as (select doc_id, doc_id as c from documents union select r.doc_id, l.b from reach r join link l on l.a = r.c)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.c) as component_id
from documents d left join n using (doc_id) left join reach r on r.doc_id = d.doc_id group by d.doc_id
""",
    "op11_hard_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (
  select anchor_id, other as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, other) as k from s where same) where k <= 5),
n as (
  select p.*, s.other as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op12_collocations": r"""
with pieces as (
  select row_number() over () as p, lang, piece
  from (select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (
  select lang, s.size, w[i:i + s.size - 1] as g, count(*) as a
  from w, (values (1), (2), (3), (4)) as s(size), unnest(range(1, greatest(1, len(w) - s.size + 2))) as t(i)
  group by all having count(*) >= 30),
c as (select * from g where size > 1),
cuts as (
  select c.lang, c.g, c.size, c.a, k, f.a as l, r.a as r, ((2000000::hugeint * c.a) // (f.a::hugeint + r.a))::bigint as score
  from c, unnest(range(1, c.size)) as t(k)
  join g f on f.lang = c.lang and f.g = c.g[1:k]
  join g r on r.lang = c.lang and r.g = c.g[k + 1:]),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
longer as (
  select c.lang, c.g[i:i + m.m - 1] as g, max(c.a) as above
  from c, (values (2), (3)) as m(m), unnest(range(1, greatest(1, c.size - m.m + 2))) as t(i) where m.m < c.size group by all),
left_over as (
  select best.* from best left join longer on longer.lang = best.lang and longer.g = best.g
  where above is null or 100::hugeint * above < 80::hugeint * best.a),
ranked as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank
  from left_over)
select lang, rank::int as rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
""",
    "op13_superminhash": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from w, unnest(range(1, greatest(2, len(w) - 2))) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id, doc_id as c from documents union select r.doc_id, l.b from reach r join link l on l.a = r.c),
comp as (select doc_id, min(c) as component_id from reach group by doc_id)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from comp left join n using (doc_id)
""",
    "op10_line_dedup": r"""
with l as (
  select doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as raw from documents where text is not null)),
u as (select line, length(line) as n, min((doc_id, pos)) as first from l where length(line) >= 20 group by line),
half as (
  select line, n, first, n as target, 1 as side, substr(line, 1, n // 2) as part from u
  union all select line, n, first, n, 2, substr(line, n // 2 + 1) from u
  union all select line, n, first, n - 1, 1, substr(line, 1, (n - 1) // 2) from u
  union all select line, n, first, n - 1, 2, substr(line, (n - 1) // 2 + 2) from u),
pair as (
  select distinct a.line as x, b.line as y, a.first as fx, b.first as fy
  from half a join half b on a.target = b.target and a.side = b.side and a.part = b.part and a.n = a.target and a.line <> b.line),
near as (
  select distinct case when fx > fy then x else y end as line from pair
  where len(list_filter(range(length(x) + 1), lambda i: substr(x, 1, i) = substr(y, 1, i)
    and substr(x, i + 1 + (length(x) = length(y))::int) = substr(y, i + 2))) > 0),
mark as (
  select l.doc_id, l.pos, l.raw, near.line is not null as is_near, u.line is not null and near.line is null and u.first <> (l.doc_id, l.pos) as is_equal
  from l left join u using (line) left join near using (line)),
a as (
  select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (not is_near and not is_equal), '') as text,
    count(*) as n_lines, count(*) filter (is_equal) as n_equal, count(*) filter (is_near) as n_near
  from mark group by doc_id)
select d.doc_id, a.text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_equal, 0)::bigint as n_equal, coalesce(n_near, 0)::bigint as n_near
from documents d left join a using (doc_id)
""",
    "op2_url_filter": rf"""
with cut as (
  select page_id, url,
    case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
rules(rule, verdict) as (values {_RULES_SQL}),
listed(entry) as (values {_LISTED_SQL}),
fits as (
  select p.*, r.rule, r.verdict, row_number() over (partition by page_id, p.host, p.path order by length(r.rule) desc) as k
  from parts p join rules r
    on (p.host = split_part(r.rule, '/', 1) or ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
   and starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
select p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, case when exists (select 1 from listed l where p.host = l.entry or ends_with(p.host, '.' || l.entry)) then 'block' else 'allow' end) as verdict
from parts p left join fits f on f.page_id = p.page_id and f.host = p.host and f.path = p.path and f.k = 1
""",
    "op4_decontaminate": r"""
with dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
bw as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
  from bw, unnest(range(1, greatest(2, len(w) - 11))) as t(i) where len(w) > 0),
pats as (select n, g, list(item_id) as items from win group by n, g),
sizes as (select distinct n from pats),
dwin as (
  select doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') as g
  from dw, sizes s, unnest(range(1, greatest(1, len(w) - s.n + 2))) as t(i)),
hits as (select doc_id, d.i, d.n, p.items from dwin d join pats p on p.n = d.n and p.g = d.g),
places as (select doc_id, count(distinct k) as n_hit from hits, unnest(range(i, i + n)) as t(k) group by doc_id),
found as (select doc_id, list_sort(list_distinct(list(cast(x as varchar)))) as items from hits, unnest(items) as t(x) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join places using (doc_id) left join found using (doc_id)
""",
    "op8_host_rules": r"""
with raw as (
  select doc_id, source as host, coalesce(text, '') as t from documents),
w as (
  select doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from raw),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, greatest(1, len(w) - 1))) as t(i)),
r as (select doc_id, g from g group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct k) as n from g join r using (doc_id, g), unnest([i, i + 1, i + 2]) as u(k) group by doc_id),
m as (
  select doc_id, host, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines
  from w left join rep using (doc_id)),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as soft_failed
  from m),
h as (select host, count(*) as n, sum((base_failed or soft_failed)::int)::bigint as k from f group by host),
mo as (select sum(k) / sum(n) as mean, count(*) as hosts, sum(n) as docs, sum(n * (k / n) * (k / n)) as square from h),
pr as (
  select mean, greatest(2.0, mean * (1 - mean) / greatest(square / docs - mean * mean - mean * (1 - mean) * hosts / docs, 1e-6) - 1) as weight from mo),
v as (select host, (k + mean * weight) / (n + weight) as rate from h, pr)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, f.host, round(rate, 9) as rate,
  not base_failed and not (rate > 0.5 and soft_failed) as kept
from f join v on f.host is not distinct from v.host
""",
}
