"""Registered queries of the operators, and their check statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (ball_tree, decontamination, fingerprints, licences, near_duplicates, neighbours,
               pieces, pseudonyms, repeats, sharding, toxicity, url_graph, whitening)
from .store import table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


#: DuckDB's patterns have no upper bound of code points beyond \x{10FFFF}; words of the checks.
_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = ("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


#: Key of the registered queries; callers bring their own.
PSEUDONYM_KEY = "key of the registered queries"


def _host_sql(url: str) -> str:
    return _ASCII_LOWER.format(f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')")


def _rule_sql() -> str:
    ordered = sorted(url_graph.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
        for _, h, p in ordered)
    return f"case {cases} end"


_VERDICTS = " ".join(f"when '{h}{p}' then '{v}'" for v, h, p in url_graph.RULES)
#: Of the mass, 0.85 ** 100 = 9e-8 is left unsettled.
_ROUNDS = """ranks as (select 0 as i, kind, host, base as rank from bases
  union all select i, kind, host, cast(sum(part) as hugeint) from (
    select r.i + 1 as i, e.kind, e.dst as host, (r.rank * e.n * 85) // (e.total * 100) as part
    from ranks r join flows e on e.kind = r.kind and e.src = r.host where r.i < 100
    union all select r.i + 1, b.kind, b.host, (b.base * 15) // 100
    from (select distinct i from ranks where i < 100) r cross join bases b)
  group by all)"""


@register("op1_link_graph", f"""
with recursive split as (select page_id, html, {_host_sql("url")} as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
judged as materialized (select *, {_rule_sql()} as rule from split),
told as materialized (select *, case rule {_VERDICTS} end as told from judged),
links as (select host as src, unnest(list_distinct(regexp_extract_all(html,
    '(?i)\\b(?:href|src)\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1))) as url
  from told where host <> ''),
linked as (select src, {_host_sql("case when starts_with(url, '//') then 'http:' || url else url end")} as dst
  from links),
domains as (select distinct array_to_string(list_slice(parts, i, len(parts)), '.') as host from (
  select parts, unnest(range(1, len(parts))) as i from (
    select distinct string_split(host, '.') as parts from told
    where contains(host, '.') and not regexp_full_match(host, '[0-9.]+')))),
family as (select host, regexp_replace(host, '^[^.]+\\.', '') as up from domains
  where regexp_matches(host, '^[^.]+\\.[^.]+\\.[^.]+') and not regexp_full_match(host, '[0-9.]+')),
edges as materialized (select src, dst, count(*) as n from (
  select src, dst from linked where dst <> '' and src <> dst
  union all select host, up from family union all select up, host from family) group by all),
ways as (select 'trust' as kind, src, dst, n from edges union all select 'distrust', dst, src, n from edges),
flows as materialized (select kind, src, dst, cast(n as hugeint) as n,
  cast(sum(n) over (partition by kind, src) as hugeint) as total from ways),
seeds as (select host, count(*) filter (where told = 'allow') as trust,
  count(*) filter (where told = 'block') as distrust from told where host <> '' group by host),
masses as (select 'trust' as kind, host, trust as n from seeds where trust > 0
  union all select 'distrust', host, distrust from seeds where distrust > 0),
bases as materialized (select kind, host, (cast(n as hugeint) * {url_graph.SCALE})
  // cast(sum(n) over (partition by kind) as hugeint) as base from masses),
{_ROUNDS},
spread as (select host, coalesce(max(rank) filter (where kind = 'trust'), 0) as trust,
  coalesce(max(rank) filter (where kind = 'distrust'), 0) as distrust
  from ranks where i = 100 group by host)
select page_id, host, path, rule, coalesce(told, case when coalesce(distrust, 0) > coalesce(trust, 0)
    then 'block' else 'allow' end) as verdict
from told left join spread using (host)""")
def op1(spark, sf):
    return url_graph.filter_urls(table(spark, sf, "pages")).drop("trust", "distrust")


@register("op2_classifier_chain")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.toxic_documents(docs, table(spark, sf, "labels")).select(
        "doc_id", F.col("toxicity.junk").alias("p_junk"), F.col("toxicity.toxic").alias("p_toxic"),
        "toxicity.rejected")


@register("op3_two_pass_shuffle")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sharding.shuffled_shards(docs, shards=16).select(
        "doc_id", sharding.text_bytes("text").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op4_licence_classifier")
def op4(spark, sf):
    return licences.document_licences(table(spark, sf, "documents"))


@register("op5_feistel_pseudonyms")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).select(
        "doc_id", "text", "pseudonyms.n_found", "pseudonyms.n_replaced")


@register("op6_seed_and_extend", f"""
with words as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
windows as (
  select doc_id, s, list_aggregate(list_slice(w, s, s + 19), 'string_agg', ' ') as key
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20)),
ranked as (
  select doc_id, s, row_number() over (partition by key order by doc_id, s) as r from windows),
removed as (
  select distinct doc_id, unnest(range(s, s + 20)) as i from ranked where r > 1),
gone as (select doc_id, list(i) as gone from removed group by doc_id)
select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then w else
    list_transform(list_filter(range(1, len(w) + 1), lambda x: not list_contains(gone, x)), lambda x: w[x]) end, ' '))
    as kept_sha256
from words left join gone using (doc_id)""")
def op6(spark, sf):
    out = repeats.without_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_multiprobe_p_stable")
def op7(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@register("op8_fast_similarity_sketching", f"""
with recursive words as (
  select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_SPACED}') as w
  from documents),
sets as materialized (
  select doc_id, list_distinct(case when len(w) < 2 then
    case when len(w) = 1 then [w[1]] else cast([] as varchar[]) end else
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
shingles as materialized (select doc_id, len(s) as n, hash(unnest(s)) as h from sets),
links as materialized (
  select a.doc_id as u, b.doc_id as v
  from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as materialized (select u, v from links union all select v, u from links),
reach as (
  select distinct u as doc_id, u as other from both_ways
  union
  select r.doc_id, e.v from reach r join both_ways e on e.u = r.other),
least_of as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, len(s) as n_shingles, coalesce(component_id, doc_id) as component_id,
  coalesce(component_id, doc_id) = doc_id as kept
from sets left join least_of using (doc_id)""")
def op8(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents"), shingle=2, percent=80)


@register("op9_backtracking_pieces")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, PIECE_MODEL).select(
        "doc_id", "pieces.n_tokens", "pieces.ids_sha256", "pieces.decoded_sha256")


@register("op10_suffix_automaton", f"""
with doc_words as materialized (
  select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as size,
    list_aggregate(list_slice(w, s, s + least(len(w), 10) - 1), 'string_agg', ' ') as key
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s
        from item_words where len(w) > 0)),
sizes as (select distinct size from item_windows),
doc_windows as (
  select doc_id, s, size, list_aggregate(list_slice(w, s, s + size - 1), 'string_agg', ' ') as key
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s
        from doc_words, sizes where len(w) >= size)),
met as (select doc_id, s, size, item_id from doc_windows join item_windows using (size, key)),
hit as (select doc_id, count(distinct i) as n_hit
        from (select doc_id, unnest(range(s, s + size)) as i from met) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items,
  string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from met group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit using (doc_id) left join named using (doc_id)""")
def op10(spark, sf):
    return decontamination.contamination_digest(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op11_ball_tree", f"""
with doc_words as (
  select doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_LETTERS}')) as term
  from documents),
held as materialized (select doc_id, term, count(*) as tf from doc_words group by all),
sizes as materialized (select doc_id, cast(sum(tf) as bigint) as n from held group by doc_id),
totals as (select count(*) as documents, cast(sum(n) as bigint) as terms from sizes),
lengths as (select doc_id, 25 + (75 * n * documents) // terms as m from sizes, totals),
weights as (select term, cast(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) as bigint) as w
  from held, totals group by term, documents),
asked as (select item_id, term, count(*) as c from (
  select item_id, unnest(regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_LETTERS}')) as term
  from benchmark) group by all),
scores as (select item_id, doc_id,
    cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join weights using (term) join held using (term) join lengths using (doc_id)
  group by item_id, doc_id),
ranked as (select item_id, doc_id, score,
    cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank
  from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10""")
def op11(spark, sf):
    return ball_tree.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


@register("op12_spectrum_slicing")
def op12(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"), components=4)


@register("op13_generalised_pigeonhole")
def op13(spark, sf):
    return fingerprints.fingerprint_groups(table(spark, sf, "documents"), shingle=3, distance=3)
