"""Queries of the numbered operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import bytebpe, decontam, filteraudit, fingerprints, neardup, packing, pii, quality, sharding, tokenfile, toxicity, urls, yinyang
from gatehouse.llm.common import table

WORD_VOCAB, BYTE_VOCAB, BYTE_VOCAB_SIZE, RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", 50_257, "byte_bpe_multi_50k.tiktoken"
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCAB))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCAB), BYTE_VOCAB_SIZE)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.filter_urls(pages, URL_RULES, urls.labelled_outcomes(pages, table(spark, sf_dir, "labels")))
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_bound")})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bytebpe.digest(bytebpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(RANKS), PATTERN))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_token_file, op3_fingerprints, op4_toxicity, op5_url_filter, op6_pii, op7_hash_tree_sharding, op8_decontamination, op9_quality, op10_near_duplicates, op11_byte_bpe, op12_filter_audit, op13_yinyang_clusters, pipeline)
}

_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TWO = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
_HOST = "coalesce(" + _FOLDED.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_LAST = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"
_LEVELS = f"case when {_LAST(2)} in ({_TWO}) then {_LAST(3)} else {_LAST(2)} end as domain, case when {_LAST(2)} in ({_TWO}) then {_LAST(2)} else {_LAST(1)} end as suffix"
_RULES = "case " + " ".join(f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'" for r, _ in sorted(URL_RULES, key=lambda x: (-len(x[0]), x[1] != "block"))) + " end"
_VERDICTS = "case rule " + " ".join(f"when '{r}' then '{v}'" for r, v in URL_RULES)
_STRENGTH = "coalesce((select case when sum(n * pow(bad / n - centre, 2) - centre * (1 - centre)) > 0 then least(1000, greatest(1, sum(n * centre * (1 - centre)) / sum(n * pow(bad / n - centre, 2) - centre * (1 - centre)) - 1)) else 1000 end from {0}), 1000)"


def _level(name: str, groups: str) -> str:
    """A level's groups (key, n, bad, centre) and their posteriors."""
    return f"{name}_in as ({groups}), {name}_tau as (select {_STRENGTH.format(name + '_in')} as tau), {name}_out as (select {name}, (bad + tau * centre) / (n + tau) as {name}_mean, 1 / (n + tau + 1) as {name}_spread from {name}_in, {name}_tau)"


_URLS = f"""
with split as (select page_id, {_HOST} as host, {_PATH} as path from pages),
outcomes as (
  select host, bad from (select host, try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint) as doc_id from split) s
  join (select doc_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad from labels group by doc_id) l using (doc_id)),
counted as (select *, {_LEVELS} from (select host, count(*)::double as n, sum(bad)::double as bad from outcomes group by host) h),
everything as (select coalesce(sum(n), 0) as all_n, (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as top from counted),
{_level("suffix", "select suffix, sum(n) as n, sum(bad) as bad, any_value(top) as centre from counted, everything group by suffix")},
{_level("domain", "select domain, sum(n) as n, sum(bad) as bad, any_value(suffix_mean) as centre from counted join suffix_out using (suffix) group by domain")},
{_level("host", "select host, n, bad, domain_mean as centre from counted join domain_out using (domain)")},
known as (
  select host, coalesce(host_mean, domain_mean, suffix_mean, top) as mean,
    coalesce(host_spread, domain_spread + 1 / (host_tau.tau + 1), suffix_spread + 1 / (host_tau.tau + 1) + 1 / (domain_tau.tau + 1),
      1 / (all_n + 2) + 1 / (host_tau.tau + 1) + 1 / (domain_tau.tau + 1) + 1 / (suffix_tau.tau + 1)) as spread
  from (select *, {_LEVELS} from (select distinct host from split where host <> '') d) p
  left join host_out using (host) left join domain_out using (domain) left join suffix_out using (suffix), everything, host_tau, domain_tau, suffix_tau),
rated as (select host, mean as bad_rate, greatest(0, mean - 1.645 * sqrt(mean * (1 - mean) * spread)) as bad_rate_bound from known),
ruled as (select *, {_RULES} as rule from split)
select page_id, host, path, rule, {_VERDICTS} else case when bad_rate_bound > 0.5 then 'block' else 'allow' end end as verdict, round(bad_rate, 6) as bad_rate, round(bad_rate_bound, 6) as bad_rate_bound
from ruled left join rated using (host)
"""

_WORDS = "regexp_extract_all(" + _FOLDED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION = f"""
with docs as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
test as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0) x),
sizes as (select distinct n from test),
places as (
  select rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n) x),
found as (select rid, i, n, item_id from places join test using (n, win)),
hits as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + n)) as k from found) x group by rid),
hit_items as (select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as all_items from (select distinct rid, item_id from found) x group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(all_items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (rid) left join hit_items using (rid)
"""

_AUDIT = r"""
with words as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
judged as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
fails as (
  select words.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(words.doc_id > min(words.doc_id) over (partition by t), false) as e
  from words left join judged using (doc_id)),
masks as (
  select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic
  from fails group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select concat(p.x, q.x, r.x, s.x, t.x) as filter_order from letters p, letters q, letters r, letters s, letters t
  where q.x <> p.x and r.x not in (p.x, q.x) and s.x not in (p.x, q.x, r.x) and t.x not in (p.x, q.x, r.x, s.x)),
steps as (select filter_order, step, filter_order[step] as x, filter_order[1:step - 1] as earlier from orders, (select unnest(range(1, 6)) as step) k),
places as (
  select part, filter_order, step, x, n, good, toxic, mask, contains(mask, x) as failed, earlier <> '' and regexp_matches(mask, concat('[', case when earlier = '' then '-' else earlier end, ']')) as gone
  from masks, steps),
counts as (
  select part, filter_order, cast(step as int) as step, x, cast(coalesce(sum(n) filter (not failed and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (failed and not gone), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (failed and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (mask = x), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (failed and not gone), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (failed and not gone), 0) as bigint) as toxic_lost
  from places group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from counts
"""

_SQUARES = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::hugeint"


def _kmeans_round(r: int) -> str:
    """Clusters under centroids ``c{r}``, then the centroids of the next round."""
    return f"""a{r} as materialized (select rid, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(c, {_SQUARES} * 64 + c) as c, min({_SQUARES}) as d from kept, c{r} group by rid),
s{r} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(1, 65)) as i from a{r}) group by c, i),
m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as w from s{r} group by c),
c{r + 1} as materialized (select c, coalesce(m{r}.w, c{r}.w) as w from c{r} left join m{r} using (c))"""


_CLUSTERS = f"""
with kept as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64),
c0 as materialized (select row_number() over (order by sha256(concat('2:', vec_id::varchar))) - 1 as c, v as w from kept order by sha256(concat('2:', vec_id::varchar)) limit 40),
{", ".join(_kmeans_round(r) for r in range(6))}
select vec_id, cast(a5.c as int) as cluster, d::bigint as distance, (sum(d) over (partition by a5.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256 from a5 join c5 using (c)
"""

#: The others need something that SQL lacks (a tokenizer, Spark's hashes, training, graph classes,
#: places of matches), so each is tested against a second implementation in tests/llm.
ORACLE_SQL: dict[str, str] = {"op5_url_filter": _URLS, "op8_decontamination": _CONTAMINATION, "op12_filter_audit": _AUDIT, "op13_yinyang_clusters": _CLUSTERS}
