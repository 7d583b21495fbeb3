"""Registered queries and their SQL.

The tables hold nothing that a detector looks for, so both sides plant the same positives and near misses, in
groups that pass and groups that fail. Every query reads its whole table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.globs import globs_regex
from gatehouse.functions.patterns import HOME_PATHS, SECRETS, SPACE, any_of, base_name, content_has_any, evidence_label, redacted_remote
from gatehouse.functions.text import heading_level
from gatehouse.functions.workflows import action_line_numbers
from gatehouse.operators import checks, consistency, dialogue, preferences, readme, scan
from gatehouse.sources import repositories
from gatehouse.sources.archives import write_archives
from gatehouse.sources.staging import staging_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Texts with planted secrets (only in some sources) and near misses.
SECRET_TEXT = "case when doc_id % 7 = 0 and length(source) = 4 then concat(coalesce(text, ''), ' sk-', repeat('A', 24)) when doc_id % 7 = 1 then concat(coalesce(text, ''), ' sk-', repeat('A', 19)) when doc_id % 7 = 2 and source = 'src11' then concat(coalesce(text, ''), ' AKIA', repeat('Z', 16)) else coalesce(text, '') end"
PATH_TEXT = "case when doc_id % 5 = 0 and length(source) = 4 then concat(coalesce(text, ''), ' /home/', 'someone/x') when doc_id % 5 = 1 then concat(coalesce(text, ''), ' /home/', '　', 'x') when doc_id % 11 = 0 and source = 'src12' then concat(coalesce(text, ''), ' C:/Users/', 'abc') else coalesce(text, '') end"
LABEL = "case when doc_id % 9 = 0 then concat('dir/ghp_', repeat('b', 22), '.txt') when doc_id % 9 = 1 then concat('a/b/ghp_', repeat('b', 12)) else concat('docs/', substr(replace(coalesce(text, ''), chr(10), ' '), 1, 80), '.md') end"
DUCK_SECRETS, DUCK_PATHS = _quoted(any_of(SECRETS)), _quoted(any_of(HOME_PATHS))


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.expr(SECRET_TEXT).alias("content"))


@query(f"""select source as repo_id, cast(count(*) filter (where regexp_matches({SECRET_TEXT}, {DUCK_SECRETS})) as bigint) as finding_count,
    case when count(*) filter (where regexp_matches({SECRET_TEXT}, {DUCK_SECRETS})) > 0 then 'fail' else 'pass' end as status from documents group by source""")
def secret_scan_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.secret_scan(_secrets(spark, sf_dir))


@query(f"""with h as (select source as repo_id, concat('docs/', cast(doc_id as varchar), '.md') as label, regexp_matches({PATH_TEXT}, {DUCK_PATHS}) as hit from documents)
    select repo_id, cast(count(*) filter (where hit) as bigint) as finding_count, md5(coalesce(string_agg(label, ',' order by label) filter (where hit), '')) as labels,
    case when count(*) filter (where hit) > 0 then 'fail' else 'pass' end as status from h group by repo_id""")
def personal_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.expr(PATH_TEXT).alias("content"))
    return checks.personal_path_scan(files).withColumn("labels", F.md5(F.concat_ws(",", "labels")))


@query(f"""with l as (select doc_id, regexp_extract({LABEL}, '[^/]*$') as label from documents)
    select doc_id, case when regexp_matches(label, {DUCK_SECRETS}) or regexp_matches(label, {DUCK_PATHS}) then '<redacted-path>' else label end as label from l""")
def redact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", evidence_label(base_name(F.expr(LABEL))).alias("label"))


REMOTE = "case when page_id % 4 = 0 then concat(case when page_id % 8 = 0 then 'a@' else '' end, 'git@host', cast(page_id as varchar(20)), '.org:team/x.git?token=1#f') when page_id % 4 = 1 then replace(replace(url, '://', '://user:secret@Sub.'), 'http', 'HTTP') when page_id % 4 = 2 then concat('/srv/git/', cast(page_id as varchar(20)), '@h:x#x') else url end"


@query(f"""with u as (select page_id, {REMOTE} as url from pages), b as (select page_id, url, regexp_replace(url, '[?#].*$', '', 's') as bare from u)
    select page_id, nullif(case when url like '%://%' then concat(lower(regexp_extract(bare, '(?s)^[^:]*://', 0)), lower(regexp_extract(bare, '(?s)^[^:]*://(?:[^/]*@)?([^/]*)', 1)), regexp_replace(bare, '(?s)^[^:]*://[^/]*', ''))
      else regexp_replace(bare, '^[^@/:]+@([^/:]+:.)', '\\1') end, '') as remote from b""")
def redact_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", redacted_remote(F.expr(REMOTE)).alias("remote"))


@query("""with p as (select distinct c_mktsegment as repo_id, case when c_mktsegment < 'C' then 'one' else concat('p', cast(c_nationkey as varchar)) end as author, 'one' as committer from customer)
    select repo_id, cast(count(*) as bigint) as identities, cast(count(*) filter (where author <> 'one' or committer <> 'one') as bigint) as mismatches, 'expected_identity' as policy,
    case when count(*) filter (where author <> 'one' or committer <> 'one') > 0 then 'fail' else 'pass' end as status from p group by repo_id""")
def commit_identity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").selectExpr("c_mktsegment as repo_id", "case when c_mktsegment < 'C' then ' one   1700000000  +0900' else concat('p', cast(c_nationkey as string), ' 1700000000 -0100') end as author", "'one' as committer")
    return checks.commit_identity(rows, "one")


_NAMES = "', '".join(checks.REQUIRED_DOCUMENTS)


@query(f"""with w as (select n_name as repo_id, n_nationkey as k, unnest(['{_NAMES}']) as path from nation), m as (select * from w where k % 3 <> 0 and (ascii(path) + k) % 4 = 0)
    select n_name as repo_id, coalesce((select string_agg(path, ',' order by path) from m where m.repo_id = n_name), '') as missing, case when exists (select 1 from m where m.repo_id = n_name) then 'fail' else 'pass' end as status from nation""")
def required_documents_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("repo_id"), F.col("n_nationkey").alias("k"))
    files = nation.withColumn("path", F.explode(F.array(*map(F.lit, checks.REQUIRED_DOCUMENTS)))).where("not (k % 3 <> 0 and (ascii(path) + k) % 4 = 0)").withColumn("content", F.lit(""))
    return checks.required_documents(nation, files).select("repo_id", F.concat_ws(",", "missing").alias("missing"), "status")


CHECK_ROWS = "case o_orderkey % 4 when 0 then 'secret_scan' when 1 then 'origin' when 2 then 'ci_configuration' else 'human_visual_review' end as name, case when o_custkey % 50 = 0 then 'tool_error' when o_orderkey % 13 = 0 then 'fail' when o_orderkey % 11 = 0 then 'unknown' when o_orderkey % 7 = 0 then 'not_applicable' else 'pass' end as status"


@query(f"""with c as (select o_custkey as repo_id, {CHECK_ROWS} from orders) select repo_id, cast(count(*) as bigint) as checks,
    case when bool_or(status = 'tool_error') then 'tool_error' when bool_or(status in ('fail', 'unknown')) then 'blocked' else 'pass' end as status from c where name <> 'human_visual_review' group by repo_id""")
def scan_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.rollup(_table(spark, sf_dir, "orders").selectExpr("o_custkey as repo_id", *_split(CHECK_ROWS)))


def _split(two: str) -> list[str]:
    head, tail = two.split(" as name, ")
    return [head + " as name", tail]


@query("""select source as repo_id, cast(count(distinct md5(coalesce(text, ''))) as bigint) as objects from documents where coalesce(n_chars, 0) <= 2000 group by source""")
def object_dedupe_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _table(spark, sf_dir, "documents").selectExpr("source as repo_id", "md5(coalesce(text, '')) as oid", "'blob' as type", "coalesce(n_chars, 0) as size")
    return checks.history_objects(objects, 2000).groupBy("repo_id").agg(F.count("*").alias("objects"))


#: Links at the end of each text, by doc_id: percent-encoded ones, a folder, an absolute path, one that leaves the repository.
LINKED = "concat(coalesce(text, ''), chr(10), 'see [a](../f', cast(doc_id % 40 as varchar(9)), '.md#x) and ![i](no.png)', case when doc_id % 3 = 0 then '[b](<g.md> \"t\")' else '' end, '[c](http://x.y/z) [d](#top) [e](../my%20file.md)', case when doc_id % 8 = 0 then '[f](a%2Bb+c%zz%.md)' else '' end, case when doc_id % 6 = 0 then '[g](../../docs)' else '' end, case when doc_id % 14 = 0 then '[h](/x.md)' else '' end, case when doc_id % 10 = 0 then ' [up](../../../etc)' else '' end)"


@query("""with d as (select source as repo_id, concat('docs/', cast(doc_id as varchar), '/r.md') as path, doc_id from documents),
    tracked as (select distinct source as repo_id, concat('docs/f', cast(doc_id % 35 as varchar), '.md') as path from documents),
    f as (select d.repo_id, concat('markdown_link_missing:', d.path, ':../f', cast(d.doc_id % 40 as varchar), '.md') as finding from d left join tracked t on t.repo_id = d.repo_id and t.path = concat('docs/f', cast(d.doc_id % 40 as varchar), '.md') where t.path is null
      union all select repo_id, concat('markdown_link_missing:', path, ':g.md') from d where doc_id % 3 = 0
      union all select repo_id, concat('markdown_link_missing:', path, ':a+b+c%zz%.md') from d where doc_id % 8 = 0
      union all select repo_id, concat('markdown_link_missing:', path, ':../../docs') from d where doc_id % 6 = 0
      union all select repo_id, concat('markdown_link_outside_repo:', path, ':/x.md') from d where doc_id % 14 = 0
      union all select repo_id, concat('markdown_link_outside_repo:', path, ':../../../etc') from d where doc_id % 10 = 0) select distinct repo_id, finding from f""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("/r.md")).alias("path"), F.expr(LINKED).alias("content"))
    tracked = docs.select(F.col("source").alias("repo_id"), F.explode(F.expr("array(concat('docs/f', cast(doc_id % 35 as string), '.md'), 'docs/my file.md')")).alias("path")).distinct()
    return consistency.link_findings(pages, tracked).distinct()


@query("""with n as (select distinct l_orderkey as repo_id, concat('f', cast(l_partkey % 20 as varchar)) as finding from lineitem where l_returnflag <> 'A'),
    o as (select distinct l_orderkey as repo_id, concat('f', cast(l_partkey % 20 as varchar)) as finding from lineitem where l_returnflag <> 'R'),
    b as (select coalesce(n.repo_id, o.repo_id) as repo_id, coalesce(n.finding, o.finding) as finding, n.finding is not null as now, o.finding is not null as old from n full join o on n.repo_id = o.repo_id and n.finding = o.finding)
    select repo_id, coalesce(string_agg(finding, ',' order by finding) filter (where now and old), '') as accepted, coalesce(string_agg(finding, ',' order by finding) filter (where now and not old), '') as new, coalesce(string_agg(finding, ',' order by finding) filter (where old and not now), '') as resolved from b group by repo_id""")
def ratchet_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as repo_id", "concat('f', cast(l_partkey % 20 as string)) as finding", "l_returnflag as flag")
    out = consistency.ratchet(rows.where("flag <> 'A'"), rows.where("flag <> 'R'"))
    return out.select("repo_id", *[F.concat_ws(",", c).alias(c) for c in ("accepted", "new", "resolved")])


@query("""select source as repo_id, concat(cast(doc_id as varchar), '.txt') as path, case when doc_id % 6 = 0 then 'missing' when sha256(coalesce(text, '')) <> sha256(case when doc_id % 6 = 1 then concat(coalesce(text, ''), '.') else coalesce(text, '') end) then 'drift' else 'current' end as state from documents""")
def artifact_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "source as repo_id", "concat(cast(doc_id as string), '.txt') as path", "coalesce(text, '') as content")
    wanted = docs.select("repo_id", "path", F.sha2(F.expr("case when doc_id % 6 = 1 then concat(content, '.') else content end"), 256).alias("sha256"))
    return consistency.artifact_findings(wanted, docs.where("doc_id % 6 <> 0"))


@query("""with d as (select source as repo_id, concat(cast(doc_id as varchar), '.txt') as path, doc_id % 6 as k, doc_id % 4 = 1 as late from documents)
    select repo_id, path, 'update_missing' as state from d where late union all select repo_id, path, case k when 0 then 'missing' when 1 then 'drift' else 'current' end from d where not late or k < 2""")
def artifact_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts against their sources' changes too: by doc_id the source changed alone, with its artifact, or another path did."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "source as repo_id", "concat(cast(doc_id as string), '.txt') as path", "coalesce(text, '') as content")
    wanted = docs.select("repo_id", "path", F.expr("array(concat('none/', doc_id, '/**'), concat('src/', doc_id, '/**'))").alias("sources"), F.sha2(F.expr("case when doc_id % 6 = 1 then concat(content, '.') else content end"), 256).alias("sha256"))
    changes = docs.select("repo_id", F.explode(F.expr("case doc_id % 4 when 0 then array(path) when 1 then array(concat('src/', doc_id, '/a/b.py')) when 2 then array(path, concat('src/', doc_id, '/b.py')) else array(concat('src/x', doc_id, '/b.py')) end")).alias("path"))
    return consistency.artifact_findings(wanted, docs.where("doc_id % 6 <> 0"), changes)


CHANGED = "case (l_orderkey + l_linenumber) % 6 when 0 then concat('src/a/', cast(l_partkey as varchar(20)), '.py') when 1 then concat('x/docs/g', cast(l_suppkey as varchar(20)), '.md') when 2 then 'sub/README.md' when 3 then concat('web/', cast(l_linenumber as varchar(20)), '.png') when 4 then '.github/workflows/ci.yml' else concat('lib/auth/', cast(l_linenumber as varchar(20)), '.go') end"
IMPACT = ({"change": ("src/**",), "requires_any": ("docs/*.md",)}, {"change": (".github/**",), "requires_any": ("README.md",)})


def _duck_glob(*globs: str) -> str:
    return f"regexp_matches(path, {_quoted(globs_regex(globs))})"


@query(f"""with c as (select l_orderkey as repo_id, {CHANGED} as path from lineitem), g as (select repo_id, {', '.join(f"bool_or({_duck_glob(*r['change'])}) and not bool_or({_duck_glob(*r['requires_any'])}) as r{k}" for k, r in enumerate(IMPACT, 1))} from c group by repo_id)
    select repo_id, 'related_docs_update_missing:impact-1' as finding from g where r1 union all select repo_id, 'related_docs_update_missing:impact-2' from g where r2""")
def impact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.impact_findings(_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as repo_id", f"{CHANGED} as path"), IMPACT)


@query(f"""with c as (select distinct l_suppkey as repo_id, {CHANGED} as path from lineitem), r as ({' union all '.join(f"select repo_id, '{k}' as route, path from c where {_duck_glob(*g)}" for k, g in consistency.ROUTES.items())})
    select repo_id, route, string_agg(path, ',' order by path) as paths from r group by repo_id, route""")
def capability_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as repo_id", f"{CHANGED} as path")
    return consistency.capability_routes(rows).select("repo_id", "route", F.concat_ws(",", "paths").alias("paths"))


HEADED = "concat('# T', chr(10), 'x', chr(10), repeat('#', 2 + cast(doc_id % 3 as int)), ' Usage', chr(10), case when doc_id % 2 = 0 then concat('#### ', chr(9731), ' deep', chr(10)) else '' end, '#no', chr(10), '## Limits', chr(13), chr(10), coalesce(text, ''))"


@query(f"""with l as (select doc_id, unnest(range(1, len(a) + 1)) as n, unnest(a) as line from (select doc_id, regexp_split_to_array({HEADED}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as a from documents)),
    h as (select doc_id, n, length(regexp_extract(line, '^(#{{1,6}})[{SPACE}]+[^{SPACE}]', 1)) as level from l), b as (select *, lag(level) over (partition by doc_id order by n) as before from h where level > 0)
    select doc_id, cast(n as int) as n, cast(before as int) as before, cast(level as int) as level from b where level > before + 1""")
def heading_level_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readme.level_jumps(_table(spark, sf_dir, "documents").select("doc_id", F.expr(HEADED).alias("text")))


#: A README's head before each text, by doc_id with and without H1, summary (too long, or in a fence alone) and sections, and Japanese.
README = "concat(case when doc_id % 4 = 0 then '## Sub' else '# Tool' end, chr(10), case doc_id % 8 when 5 then '' when 6 then concat(repeat('long ', 49), chr(10)) when 7 then concat('```', chr(10), 'fenced', chr(10), '```sh', chr(10)) else concat('What it does.', chr(10)) end, case when doc_id % 3 = 0 then '## Overview' else '## x' end, chr(10), '## Features', chr(10), case when doc_id % 5 < 4 then '## Usage' else '#### Usage' end, chr(10), case when doc_id % 7 = 0 then 'a revolutionary tool' else 'plain' end, chr(10), '## Security', chr(10), case when doc_id % 9 = 0 then repeat('これは日本語', 9 + cast(length(coalesce(text, '')) / 40 as int)) else '' end, chr(10), coalesce(text, ''))"


@query(f"""with t as (select doc_id, regexp_split_to_array(regexp_replace({README}, '\\r\\n?', chr(10), 'g'), '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as a from documents),
    c as (select doc_id, [case when doc_id % 4 = 0 then 'missing_h1' end, case when doc_id % 5 = 4 then 'heading_level_jump' end, case when doc_id % 3 <> 0 then 'missing_purpose_section' end, case when doc_id % 4 = 0 or doc_id % 8 in (5, 7) then 'missing_lead_summary' end, case when doc_id % 8 = 6 then 'lead_summary_too_long' end,
      case when len(a) - case when a[-1] = '' then 1 else 0 end > 300 then 'readme_too_long' end] as bad, case when doc_id % 7 = 0 then 'generic_marketing_copy' end as warn from t)
    select doc_id, array_to_string(list_sort(list_filter(list_append(bad, warn), lambda x: x is not null)), ',') as codes, case when len(list_filter(bad, lambda x: x is not null)) > 0 then 'blocked' else 'pass' end as status, doc_id % 9 = 0 as japanese from c""")
def readme_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readme.review(_table(spark, sf_dir, "documents").select("doc_id", F.expr(README).alias("text"))).withColumn("codes", F.concat_ws(",", "codes"))


#: Before each text, by doc_id: a summary after the H1, too long a one, one in a fence, none; a diagram, steps, a screen with and without an image, Japanese prose.
RELEASE = "case when doc_id % 17 <> 0 then concat('# Tool', chr(10), case doc_id % 4 when 0 then concat(chr(10), 'A short', chr(10), ' summary ', chr(10)) when 1 then concat(repeat('long ', 48), 'x', chr(10)) when 2 then concat('  ~~~~', chr(10), 'no summary', chr(10), '~~~~', chr(10)) else '' end, '## Overview of the UI', chr(10), '## Features', chr(10), '## Usage', chr(10), case when doc_id % 3 = 0 then concat('1. a', chr(10), ' 2) b', chr(10), '3. c', chr(10), '4. d', chr(10)) else '' end, '## Security', chr(10), case when doc_id % 5 = 0 then concat('> ```mermaid', chr(10), '> graph LR', chr(10), '> A[one] --> B>two]', chr(10), '> ```', chr(10)) else '' end, case when doc_id % 7 = 0 then concat(repeat('これは日本語の文章です', 9 + cast(length(coalesce(text, '')) / 80 as int)), chr(10)) else '' end, case when doc_id % 11 = 0 then concat('![i](a.png)', chr(10)) else '' end, case when doc_id % 13 = 0 and doc_id % 5 > 0 then concat('| a | b |', chr(10), '| --- | :---: |', chr(10), '| x \\\\| y | `', repeat('c', 98 + cast(doc_id % 2 as int)), '` `|` |', chr(10)) else '' end, coalesce(text, '')) end"


@query("""with d as (select doc_id, doc_id % 17 = 0 as gone, doc_id % 4 as s, doc_id % 3 = 0 as steps, doc_id % 5 = 0 as fig, doc_id % 7 = 0 as ja, doc_id % 11 <> 0 as bare, doc_id % 13 = 0 and doc_id % 5 > 0 as tab, len(a) - case when a[-1] = '' then 1 else 0 end as own from (select doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') as a from documents)),
    b as (select *, 5 + case s when 0 then 3 when 1 then 1 when 2 then 3 else 0 end + case when steps then 4 else 0 end + case when fig then 4 else 0 end + case when ja then 1 else 0 end + case when bare then 0 else 1 end + case when tab then 3 else 0 end + own as n from d),
    c as (select *, [case when ja and fig then 'diagram_labels_not_localized' end, case when s = 1 then 'lead_summary_too_long' end, case when s > 1 then 'missing_lead_summary' end, case when n > 300 then 'readme_too_long' end, case when ja and tab then 'table_command_cell_too_wide' end] as codes, [case when bare then 'Figma or frontend-design' end, case when ja and fig then 'Localize Diagram' end, case when s > 1 then 'Product Design' end, case when ja and tab then 'Template Creator' end, case when steps and not fig then 'Visualize' end] as advice from b)
    select doc_id, case when gone then 'readme_missing' else array_to_string(list_filter(codes, lambda x: x is not null), ',') end as codes, case when gone or s > 0 or n > 300 then 'blocked' else 'pass' end as status,
      case when gone then 'blocked_readme_missing' when s > 0 or n > 300 then 'blocked_readme_design' else 'passed_readme_design' end as release_gate, case when gone then 'Template Creator' else array_to_string(list_filter(advice, lambda x: x is not null), ',') end as recommended,
      case when not gone then cast(n as int) end as line_count, case when not gone then case when tab then 103 + cast(doc_id % 2 as int) else 0 end end as widest_table_command_cell, case when not gone then 5 end as heading_count,
      case when not gone then case s when 0 then 15 when 1 then 241 else 0 end end as lead_summary_chars, case when not gone then ja end as japanese, case when not gone then case when fig then 1 else 0 end end as diagram_count, case when not gone then case when fig then 2 else 0 end end as diagram_label_count from c""")
def readme_release_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of a README's release with its gate, recommendations and metrics."""
    out = readme.release_review(_table(spark, sf_dir, "documents").select("doc_id", F.expr(RELEASE).alias("text")))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("codes", "recommended")})


PROPOSALS = "event_id, user_id as repo_id, event_type as id, case event_id % 4 when 0 then 'security_hold' when 1 then 'external_evidence' when 2 then 'optional_policy' else 'github_baseline' end as kind, case when event_id % 3 = 0 then 'recommended' else 'required' end as severity"
AS_OF = "date '2024-06-01'"


@query(f"""with p as (select {PROPOSALS} from events), d as (select distinct user_id as repo_id, event_type as id from events where event_id % 5 = 0 or (event_id % 7 = 0 and {AS_OF} <= date '2024-06-01'))
    select p.event_id, case when kind = 'security_hold' then false when d.id is null then false when kind = 'github_baseline' or severity = 'recommended' or kind = 'external_evidence' then true else false end as suppressed
    from p left join d on d.repo_id = p.repo_id and d.id = p.id""")
def dismissal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    props = events.selectExpr(*[c.strip() for c in PROPOSALS.split(", ", 3)[:3]], *_two(PROPOSALS.split(", ", 3)[3]))
    dismissals = events.where("event_id % 5 = 0 or event_id % 7 = 0 or event_id % 11 = 0").selectExpr("user_id as repo_id", "event_type as id", "case when event_id % 5 = 0 then 'forever' else 'snooze' end as mode", "case when event_id % 7 = 0 then date '2024-06-01' else date '2024-05-31' end as until")
    return dialogue.with_suppressed(props, dismissals, F.expr(AS_OF)).select("event_id", "suppressed")


def _two(s: str) -> list[str]:
    head, tail = s.split(" as kind, ")
    return [head + " as kind", tail]


@query(f"""select o_orderkey, case when o_orderkey % 10 = 0 then 'unknown' when date_diff('day', cast(o_orderdate as date), date '1998-08-02') > 90 then 'stale' else 'fresh' end as status from orders""")
def baseline_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("last", F.expr("case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) end"))
    return orders.select("o_orderkey", dialogue.baseline_status(F.col("last"), F.lit(90), F.expr("date '1998-08-02'")).alias("status"))


@query(f"""with c as (select o_custkey as repo_id, {CHECK_ROWS} from orders), s as (select repo_id, case when bool_or(status = 'tool_error') then 'tool_error' when bool_or(status in ('fail', 'unknown')) then 'blocked' else 'pass' end as status from c where name <> 'human_visual_review' group by repo_id),
    p as (select repo_id, bool_or(name = 'secret_scan' and status = 'fail') as hold, bool_or(name = 'origin' and status = 'unknown') as needs from c group by repo_id)
    select s.repo_id, case when s.status = 'tool_error' or p.hold then 'blocked' when p.needs or s.status = 'blocked' then 'needs_human_input' else 'ready_after_confirmation' end as status from s join p on p.repo_id = s.repo_id""")
def dialogue_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey as repo_id", *_split(CHECK_ROWS))
    return dialogue.dialogue_status(checks.rollup(rows), dialogue.proposals(rows, "publish"))


@query(f"""with c as (select o_custkey as repo_id, {CHECK_ROWS} from orders), s as (select repo_id, case when repo_id % 9 = 0 then null when bool_or(status = 'tool_error') then 'tool_error' when bool_or(status in ('fail', 'unknown')) then 'blocked' else 'pass' end as status from c where name <> 'human_visual_review' group by repo_id),
    p as (select repo_id, bool_or(name = 'secret_scan' and status = 'fail') as hold, bool_or(name = 'origin' and status = 'pass') as origin from c group by repo_id),
    l as (select s.repo_id, s.status, hold, case when s.status is null then ['run_scan_first'] when s.status = 'tool_error' then ['fix_tool_error'] else ['choose_audience', case when s.repo_id % 2 = 0 then 'configure_expected_identity' end, case when not origin then 'configure_origin' end, case when s.repo_id % 3 = 0 then 'create_missing_license' end, case when s.repo_id % 3 = 0 then 'create_missing_readme_md' end, case when s.repo_id % 5 = 0 then 'fix_invalid_preflight_md' end, case when hold then 'resolve_secret_findings' end] end as ids from s join p on p.repo_id = s.repo_id)
    select repo_id, array_to_string(list_sort(list_filter(ids, lambda x: x is not null)), ',') as ids, case when status = 'tool_error' or (status is not null and hold) then 'blocked' else 'needs_human_input' end as status from l""")
def dialogue_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proposals for publishing to an audience not chosen, with planted documents, policies and scans not made."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey as repo_id", *_split(CHECK_ROWS))
    scans = checks.rollup(rows).select("repo_id", F.when(F.col("repo_id") % 9 != 0, F.col("status")).alias("status"))
    planted = scans.selectExpr("repo_id", "inline(array(named_struct('name', 'required_documents', 'missing', if(repo_id % 3 = 0, array('README.md', 'LICENSE'), array()), 'invalid', if(repo_id % 5 = 0, array('PREFLIGHT.md'), array()), 'policy', null), named_struct('name', 'commit_identity', 'missing', null, 'invalid', null, 'policy', if(repo_id % 2 = 0, 'not_configured', 'configured'))))").withColumn("status", F.lit("pass"))
    props = dialogue.conversation(scans, rows.unionByName(planted, allowMissingColumns=True), "publish")
    ids = props.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return dialogue.dialogue_status(scans, props).join(ids, "repo_id").select("repo_id", "ids", "status")


FLOW = "concat('name: x', chr(10), case when c_custkey % 4 = 0 then ' jobs:' else 'jobs :' end, chr(10))"


@query("""select n_name as repo_id, cast(count(c_custkey) filter (where n_nationkey % 5 <> 0) as bigint) as workflows, cast(count(*) filter (where n_nationkey % 5 <> 0 and n_nationkey % 2 = 1 and c_custkey % 4 = 0) as bigint) as invalid,
    case when count(*) filter (where n_nationkey % 5 <> 0 and n_nationkey % 2 = 1 and c_custkey % 4 = 0) > 0 then 'fail' when count(c_custkey) filter (where n_nationkey % 5 <> 0) = 0 then 'unknown' else 'pass' end as status from nation left join customer on c_nationkey = n_nationkey group by n_name""")
def ci_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    files = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("repo_id"), F.concat(F.lit(".github/workflows/"), F.col("c_custkey").cast("string"), F.lit(".yml")).alias("path"), F.expr(f"case when n_nationkey % 2 = 1 then {FLOW} else 'jobs:' end").alias("content"))
    return checks.ci_configuration(nation.select(F.col("n_name").alias("repo_id")), files)


@query("""select s_suppkey as repo_id, case when s_suppkey % 3 = 0 then 'go.mod' when s_suppkey % 3 = 1 then 'go.sum' else '' end as files, case when s_suppkey % 3 = 2 then 'not_applicable' else 'pass' end as status from supplier""")
def dependency_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id"))
    files = repos.withColumn("path", F.expr("case repo_id % 3 when 0 then 'go.mod' when 1 then 'go.sum' else 'sub/go.mod' end"))
    return checks.dependency_configuration(repos, files).withColumn("files", F.concat_ws(",", "files"))


#: Fences before each text, by doc_id with longer marks, and after some texts one that nothing closes.
FENCED = "concat('a', chr(10), repeat('`', 3 + cast(doc_id % 2 as int)), 'sh', chr(10), '# in', chr(10), '```', chr(10), case when doc_id % 2 = 1 then concat('````', chr(10)) else '' end, '# out', chr(10), '  ~~~', chr(10), '```', chr(10), '~~~~ more', chr(10), coalesce(text, ''), case when doc_id % 3 = 0 then concat(chr(10), '~~~', chr(10), '## tail') else '' end)"


@query(f"""with l as (select doc_id, a, unnest(range(1, len(a) + 1)) as n, unnest(a) as line from (select doc_id, case when a[-1] = '' then a[:-2] else a end as a from (select doc_id, regexp_split_to_array({FENCED}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as a from documents)))
    select doc_id, cast(n as int) as n, line, cast(coalesce(length(regexp_extract(line, '^(#{{1,6}})[{SPACE}]+[^{SPACE}]', 1)), 0) as int) as level from l
    where (n = 1 or n = 5 + doc_id % 2 or n > 8 + doc_id % 2) and not (doc_id % 3 = 0 and n > len(a) - 2)""")
def outside_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside fenced blocks of whole texts, with the level of headings."""
    return readme.fence_free_lines(_table(spark, sf_dir, "documents").select("doc_id", F.expr(FENCED).alias("text"))).withColumn("level", heading_level(F.col("line"))).select("doc_id", "n", "line", "level")


@query("""select doc_id, concat(cast(doc_id as varchar), ' start,Yes,go on') as labels from documents where doc_id % 2 = 0 union all select doc_id, concat('hello ', cast(doc_id as varchar)) from documents where doc_id % 2 = 1""")
def mermaid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagrams are planted in whole texts, by doc_id fenced, quoted, or at the end without a closing fence."""
    flow = "array('flowchart LR', 'style x fill', concat('A[', cast(doc_id as string), ' start] -->|Yes| B'), 'B -- go on --> C')"
    talk = "array('sequenceDiagram', concat('A->>B: hello ', cast(doc_id as string)))"
    body = f"if(doc_id % 2 = 0, {flow}, {talk})"
    text = f"""case doc_id % 3 when 0 then concat('intro', chr(10), '```mermaid', chr(10), array_join({body}, chr(10)), chr(10), '```', chr(10), coalesce(text, ''))
        when 1 then concat('> ~~~ Mermaid', chr(10), '> ', array_join({body}, concat(chr(10), '> ')), chr(10), '> ~~~', chr(10), coalesce(text, ''))
        else concat('```sh', chr(10), 'A[no diagram]', chr(10), '```', chr(10), coalesce(text, ''), chr(10), '```mermaid', chr(10), array_join({body}, chr(10))) end"""
    found = readme.labels(_table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text")))
    return found.select("doc_id", F.concat_ws(",", "labels").alias("labels"))


SCHEMA_ID = "gatehouse.consistency/v1"
#: A repository a document, by doc_id: no configuration, each mode, a mode that isn't one; paths and commands that the README lacks; artifacts that drifted or are late.
CONFIG = f"""case when doc_id % 5 > 0 then concat('{{"schema": "{SCHEMA_ID}", "mode": "', case doc_id % 5 when 1 then 'shadow' when 2 then 'ratchet' when 3 then 'enforce' else 'other' end, '", "markdown": {{"include": ["README.md", "docs/**"]}}, "ratchet": {{"baseline": ["generated_artifact_drift:out.txt"]}},',
    '"readme_contracts": {{"required_paths": ["docs"', case when doc_id % 11 = 0 then ', "none.md"' else '' end, '], "commands": [{{"text": "make"}}', case when doc_id % 13 = 0 then ', {{"text": "make all", "paths": ["docs/my guide.md"]}}' else '' end, ']}},',
    '"impact_map": [{{"change": ["src/**"], "requires_any": ["docs/*.md"]}}], "generated_artifacts": [{{"path": "out.txt", "sources": ["src/**"], "sha256": "', sha2(case when doc_id % 7 = 0 then concat(coalesce(text, ''), '.') else coalesce(text, '') end, 256), '"}}]}}') end"""


@query("""with d as (select doc_id as repo_id, case doc_id % 5 when 1 then 'shadow' when 2 then 'ratchet' when 3 then 'enforce' end as mode, doc_id % 5 = 4 as broken, sha256(coalesce(text, '')) <> sha256(case when doc_id % 7 = 0 then concat(coalesce(text, ''), '.') else coalesce(text, '') end) as drift from documents),
    f as (select *, list_sort(list_filter([case when drift then 'generated_artifact_drift:out.txt' end, case when repo_id % 4 = 0 then 'generated_artifact_update_missing:out.txt' end, case when repo_id % 3 = 0 then 'markdown_link_missing:README.md:my gone.md' end,
      case when repo_id % 13 = 0 then concat('readme_command_missing:command-2-', left(sha256('make all'), 12)) end, case when repo_id % 11 = 0 then 'readme_path_missing:none.md' end, case when repo_id % 4 = 0 then 'related_docs_update_missing:impact-1' end], lambda x: x is not null)) as found from d),
    r as (select *, mode is not null as live, coalesce(mode = 'ratchet', false) as rat, list_filter(found, lambda x: x <> 'generated_artifact_drift:out.txt') as fresh from f)
    select repo_id, mode, case when broken then 'tool_error' when mode is null then 'not_configured' when rat then case when len(fresh) > 0 or not drift then 'fail' else 'pass' end when len(found) = 0 then 'pass' when mode = 'enforce' then 'fail' else 'shadow_findings' end as status,
      case when broken then 'invalid_consistency_config' when live then array_to_string(found, ',') else '' end as findings, case when rat and drift then 'generated_artifact_drift:out.txt' else '' end as accepted, case when rat then array_to_string(fresh, ',') else '' end as new, case when rat and not drift then 'generated_artifact_drift:out.txt' else '' end as resolved from r""")
def consistency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check of a repository's consistency: configuration, links, README contracts, impact, artifacts, mode."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id as repo_id", "coalesce(text, '') as text")
    readme_ = "concat('# T', chr(10), 'run `make` ', case when doc_id % 3 = 0 then '[gone](my%20gone.md) ' else '[ok](docs/my%20guide.md) ' end, text)"
    files = docs.select("repo_id", F.inline(F.expr(f"array(struct('README.md' as path, {readme_} as content), struct('docs/my guide.md' as path, 'x' as content), struct('out.txt' as path, text as content))"))).withColumn("tracked", F.lit(True))
    changes = docs.select("repo_id", F.explode(F.expr("case doc_id % 4 when 0 then array('src/app.py') when 1 then array('src/app.py', 'docs/my guide.md', 'out.txt') else array('other.txt') end")).alias("path"))
    out = consistency.check(docs, docs.select("repo_id", F.expr(CONFIG).alias("content")).where("content is not null"), files, SCHEMA_ID, changes)
    return out.select("repo_id", "mode", "status", *[F.concat_ws(",", c).alias(c) for c in ("findings", "accepted", "new", "resolved")])


#: A repository a document: files by doc_id, with a secret, a home folder, a document that is missing or lacks its marker, a workflow without jobs.
SCANNED = """array(named_struct('path', 'README.md', 'content', concat(coalesce(text, ''), if(doc_id % 7 = 0, concat(' sk-', repeat('A', 24)), ''))), named_struct('path', if(doc_id % 11 = 0, 'LICENCE', 'LICENSE'), 'content', 'x'), named_struct('path', 'SECURITY.md', 'content', 'x'), named_struct('path', 'CONTRIBUTING.md', 'content', 'x'),
    named_struct('path', 'PREFLIGHT.md', 'content', if(doc_id % 13 = 0, 'x', 'all reviewed')), named_struct('path', '.github/workflows/ci.yml', 'content', if(doc_id % 17 = 0, ' jobs:', 'name: x\njobs:')), named_struct('path', if(doc_id % 3 = 0, 'go.mod', 'sub/go.mod'), 'content', if(doc_id % 19 = 0, concat('/home/', 'someone/x'), 'x')))"""


@query("""with d as (select doc_id as repo_id, doc_id % 31 = 0 as gone, list_sort(list_filter([case when doc_id % 17 = 0 then 'ci_configuration:fail' end, case when doc_id % 23 = 0 then 'clean_worktree:fail' end, case when doc_id % 37 = 0 then 'commit_identity:fail' when doc_id % 47 = 0 then 'commit_identity:unknown' end, case when doc_id % 3 > 0 then 'dependency_configuration:not_applicable' end,
      case when doc_id % 29 = 0 then 'origin:unknown' end, case when doc_id % 19 = 0 then 'personal_path_scan:fail' end, case when doc_id % 43 = 0 then 'repository_consistency:tool_error' end, case when doc_id % 11 = 0 or doc_id % 13 = 0 then 'required_documents:fail' end, case when doc_id % 7 = 0 or doc_id % 41 = 0 then 'secret_scan:fail' end], lambda x: x is not null)) as bad,
      cast(case when doc_id % 7 = 0 then 1 else 0 end + case when doc_id % 41 = 0 then 1 else 0 end as bigint) as n, case when doc_id % 19 = 0 then case when doc_id % 3 = 0 then 'go.mod' else 'sub/go.mod' end end as home, doc_id % 29 <> 0 as remote from documents),
    s as (select *, case when gone or list_contains(bad, 'repository_consistency:tool_error') then 'tool_error' when len(list_filter(bad, lambda x: x not like '%not_applicable')) > 0 then 'blocked' else 'pass' end as status from d)
    select repo_id, status, case when gone then 'not_git_repository' else '' end as issues, case when gone then '' else array_to_string(bad, ',') end as checks, case status when 'pass' then 0 when 'tool_error' then 2 else 1 end as exit_code, case when not gone then n end as finding_count, case when not gone then home end as home, case when not gone and remote then 'https://host.org/x.git' end as origin from s""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole scans with their reports: worktree, documents, contents, history, identities, origin, consistency."""
    docs = _table(spark, sf_dir, "documents")
    repos = docs.selectExpr("doc_id as repo_id", "'h' as head", "doc_id % 23 = 0 as dirty", "case when doc_id % 29 <> 0 then 'https://U:p@Host.org/x.git?q' end as origin", "case when doc_id % 31 = 0 then 'NotARepository' end as error")
    files = docs.select(F.col("doc_id").alias("repo_id"), F.inline(F.expr(SCANNED)))
    commits = docs.selectExpr("doc_id as repo_id", "'me' as author", "if(doc_id % 37 = 0, 'you', 'me') as committer")
    objects = docs.selectExpr("doc_id as repo_id", "md5(cast(doc_id as string)) as oid", "if(doc_id % 41 = 0, concat('AKIA', repeat('Z', 16)), coalesce(text, '')) as content")
    now = docs.selectExpr("doc_id as repo_id", "'me 1700000000 +0900' as author", "case when doc_id % 47 > 0 then 'me 1700000000 +0900' end as committer")
    judged = docs.selectExpr("doc_id as repo_id", "if(doc_id % 43 = 0, 'tool_error', 'pass') as status", "'shadow' as mode", "cast(array() as array<string>) as findings")
    out = scan.scan(repos, files, commits, objects, now, judged, expected="me", marker="reviewed")
    named = F.map_filter("checks", lambda k, v: k.isin(*checks.audited_checks()) & (v != "pass"))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(named), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    of = lambda path: F.get_json_object("report", f"$.checks.{path}")
    return out.select("repo_id", "status", F.concat_ws(",", "issues").alias("issues"), F.coalesce(listed, F.lit("")).alias("checks"), "exit_code", of("secret_scan.finding_count").cast("long").alias("finding_count"), of("personal_path_scan.files[0]").alias("home"), of("origin.url").alias("origin"))


PREFERENCES = """case o_orderkey % 7 when 0 then null when 1 then '{"dismissals": {' when 2 then '[1]' when 3 then '{"dismissals": [1]}' else concat('{"dismissals": {"a": {"mode": "', if(o_orderkey % 3 = 0, 'forever', 'none'), '"}, "b": {"mode": "snooze", "until": "', date_format(o_orderdate, 'yyyy-MM-dd'), 'T09:00"}, "c": "forever"}}') end"""
GUIDE = """case o_orderkey % 5 when 0 then null when 1 then '# Guide' else concat('# Guide\n<!--  guide-age\n last_reviewed: ', if(o_orderkey % 5 = 2, '1998-02-30', date_format(o_orderdate, 'yyyy-MM-dd')), ' max_age_days: ', cast(o_orderkey % 400 as string), '\n-->') end"""


@query("""with d as (select *, date_diff('day', cast(o_orderdate as date), date '1996-06-01') as age from orders)
    select o_orderkey as repo_id, case o_orderkey % 7 when 1 then 'preferences_unreadable' when 2 then 'preferences_invalid' end as load_error,
      case when o_orderkey % 7 > 3 then concat_ws(',', case when o_orderkey % 3 = 0 then 'a' end, case when age <= 0 then 'b' end) else '' end as active,
      case when o_orderkey % 5 < 3 then 'unknown' when age > o_orderkey % 400 then 'stale' else 'fresh' end as status, case o_orderkey % 5 when 0 then 'baseline_document_missing' when 1 then 'baseline_marker_missing' when 2 then 'baseline_marker_missing' end as reason, case when o_orderkey % 5 > 2 then cast(age as int) end as age_days from d""")
def preference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference documents, broken ones too, with the dismissals that hold, and the age of guides by their markers."""
    day = F.expr("date '1996-06-01'")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("repo_id"), F.expr(PREFERENCES).alias("content"), preferences.baseline_document(F.expr(GUIDE), "guide-age", day).alias("guide"))
    prefs = preferences.loaded(rows)
    held = preferences.active(prefs, day).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("active"))
    out = rows.select("repo_id", "guide").join(prefs.select("repo_id", "load_error"), "repo_id").join(held, "repo_id", "left")
    return out.select("repo_id", "load_error", F.coalesce("active", F.lit("")).alias("active"), "guide.status", "guide.reason", "guide.age_days")


@query(f"""with c as (select o_custkey as repo_id, {CHECK_ROWS} from orders), s as (select repo_id, case when bool_or(status = 'tool_error') then 'tool_error' when bool_or(status in ('fail', 'unknown')) then 'blocked' else 'pass' end as status from c where name <> 'human_visual_review' group by repo_id),
    p as (select repo_id, bool_or(name = 'secret_scan' and status = 'fail') as hold, bool_or(name = 'origin' and status = 'unknown') as origin from c group by repo_id),
    l as (select s.repo_id, s.status, hold, origin, s.repo_id % 3 = 0 as audit, s.repo_id % 2 = 0 as no_audit, s.repo_id % 5 = 0 as ci, s.repo_id % 7 = 0 as no_ci from s join p on p.repo_id = s.repo_id)
    select repo_id, case when status = 'tool_error' or hold then 'blocked' when origin or status = 'blocked' or (ci and not no_ci) then 'needs_human_input' else 'ready_after_confirmation' end as status,
      concat_ws(',', case when origin then 'configure_origin' end, case when ci and not no_ci then 'confirm_ci_runtime' end, case when hold then 'resolve_secret_findings' end, case when audit and not no_audit then 'run_dependency_audit' end) as visible,
      concat_ws(',', case when ci and no_ci then 'confirm_ci_runtime' end, case when audit and no_audit then 'run_dependency_audit' end) as suppressed, 'confirm_publish' as confirmation,
      concat_ws(',', case when origin then 'configure_origin:yes/no:yes' end, case when ci and not no_ci then 'confirm_ci_runtime:yes/no/dismiss_30d:yes' end, case when hold then 'resolve_secret_findings:fix/stop:fix' end, case when audit and not no_audit then 'run_dependency_audit:done/later/dismiss_30d/dismiss_90d/dismiss_forever:later' end) as offered,
      case repo_id % 4 when 0 then 'team' when 1 then 'public' else 'unspecified' end as audience, case when repo_id % 6 = 0 then 'fresh' end as guide from l""")
def dialogue_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked before publishing, without what was dismissed; holds are asked whatever was dismissed."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey as repo_id", *_split(CHECK_ROWS))
    scans = checks.rollup(rows).select("repo_id", "status")
    planted = scans.selectExpr("repo_id", "inline(array(struct('dependency_vulnerability_audit' as name, if(repo_id % 3 = 0, 'unknown', 'pass') as status), struct('ci_runtime_result' as name, if(repo_id % 5 = 0, 'unknown', 'pass') as status)))")
    gone = scans.selectExpr("repo_id", "inline(array(struct('run_dependency_audit' as id, if(repo_id % 2 = 0, 'forever', 'none') as mode, cast(null as date) as until), struct('confirm_ci_runtime' as id, 'snooze' as mode, if(repo_id % 7 = 0, date '2024-06-01', date '2024-05-31') as until), struct('resolve_secret_findings' as id, 'forever' as mode, cast(null as date) as until)))")
    differing = scans.selectExpr("repo_id", "status", "case repo_id % 4 when 0 then 'team' when 1 then 'public' end as audience", "if(repo_id % 6 = 0, 'fresh', null) as baseline")
    out = dialogue.packet(differing, dialogue.proposals(rows.unionByName(planted), "publish"), gone, "publish", F.expr(AS_OF))
    offer = F.from_json("packet", "proposals array<struct<id:string,options:array<string>,default:string>>")["proposals"]
    offered = F.array_join(F.transform(offer, lambda p: F.concat_ws(":", p["id"], F.array_join(p["options"], "/"), p["default"])), ",")
    of = lambda path: F.get_json_object("packet", f"$.{path}")
    return out.select("repo_id", "status", F.concat_ws(",", "visible").alias("visible"), F.concat_ws(",", "suppressed").alias("suppressed"), of("confirmations[0].id").alias("confirmation"), offered.alias("offered"), of("audience").alias("audience"), of("guide").alias("guide"))


@query("""select o_orderkey as repo_id, 'confirm_merge' as id, case when o_orderkey % 7 = 0 then 'never_approved' when o_orderkey % 11 = 0 then '' else concat_ws(',', case when o_orderkey % 2 = 0 then 'head_moved' end, case when o_orderkey % 3 = 0 then 'base_moved' end, case when o_orderkey % 5 = 0 then 'consistency_base_moved' end) end as reasons,
      o_orderkey % 7 = 0 or (o_orderkey % 11 <> 0 and (o_orderkey % 2 = 0 or o_orderkey % 3 = 0 or o_orderkey % 5 = 0)) as due from orders""")
def approvals_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of a merge, given when head, base and consistency base were others or the same; by order some were given anew."""
    orders = _table(spark, sf_dir, "orders").withColumn("repo_id", F.col("o_orderkey"))
    now = orders.selectExpr("repo_id", "'pass' as status", "concat('h', o_custkey) as head", "'origin/main' as base_ref", "concat('b', o_orderkey) as base_oid", "'origin/main' as consistency_base_ref", "concat('c', o_orderkey) as consistency_base_oid")
    asked = dialogue.confirmations(now, "merge")
    old = "struct(base_ref, concat({0}, if(repo_id % {1} = 0, 'x', '')) as base_oid, concat(head, if(repo_id % 2 = 0, 'x', '')) as head_oid)"
    given = now.where("repo_id % 7 <> 0").selectExpr("repo_id", "'confirm_merge' as id", old.format("base_oid", 3) + " as binding", old.replace("base_ref", "consistency_base_ref as base_ref", 1).format("consistency_base_oid", 5) + " as consistency_binding")
    anew = asked.where("repo_id % 11 = 0 and repo_id % 7 <> 0").select("repo_id", "id", "binding", "consistency_binding")
    return dialogue.approvals_due(asked, given.unionByName(anew)).withColumn("reasons", F.concat_ws(",", "reasons"))


REQUEST = "event_id as request_id, case when event_id % 7 = 0 then null else concat('r', user_id) end as repo, case event_id % 8 when 0 then 'push' when 1 then 'open_pr' when 2 then 'merge' when 3 then 'publish' when 4 then 'release' when 5 then 'create_repo' when 6 then 'other' end as intent, case when event_id % 3 = 0 then 'origin/main' else '' end as base_ref, case when event_id % 5 = 0 then 'origin/main' end as consistency_base_ref, event_id % 2 = 0 as release"


@query(f"""with r as (select {REQUEST} from events)
    select request_id, case when intent = 'other' then 'unknown_intent' when base_ref <> '' and consistency_base_ref is not null then 'base_refs_are_exclusive' when base_ref <> '' and coalesce(intent not in ('push', 'open_pr', 'merge'), true) then 'base_ref_requires_push_open_pr_or_merge'
      when consistency_base_ref is not null and not (coalesce(intent in ('publish', 'release'), false) or (intent is null and release)) then 'consistency_base_ref_requires_publish_or_release' when repo is null and coalesce(intent, '') <> 'create_repo' then 'repo_required' end as error from r""")
def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for scans and dialogues whose options exclude each other or lack what they need."""
    return dialogue.request_errors(_table(spark, sf_dir, "events").selectExpr(*re.split(r", (?=case|event_id % 2)", REQUEST)))


def _rows(names: str, *rows: tuple[str, ...]) -> str:
    """An array of structs of the same names, as Spark SQL has it."""
    fields = names.split(", ")
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(fields, row, strict=True)) + ")" for row in rows) + ")"


def _spelled(text: str) -> str:
    """A text as an expression that both dialects read alike: line ends, tabs, quotes and backslashes by their numbers."""
    parts = re.split("([\n\t'\\\\])", text)
    return "concat('', " + ", ".join(f"chr({ord(x)})" if k % 2 else f"'{x}'" for k, x in enumerate(parts)) + ")"


#: A workflow a document: the text is the script of its first step, then one of many ways to write an action's line, and the numbers of such lines (None: ambiguous).
SCRIPT = _spelled("name: x\njobs:\n  one:\n    runs-on: u\n    steps:\n      - run: |\n          ") + ", replace(replace(coalesce(text, ''), chr(9), ' '), chr(10), concat(chr(10), repeat(' ', 10))), chr(10)"
WRITTEN = (
    ("      - uses: a/b@c", "1"),
    ("      - name: y\n        uses: a/b@c\n        with:\n          uses: no", "2"),
    ("  two:\n    uses: a/b/c.yml@d\n    steps:\n      - uses: e/f@g", "2,4"),
    ("  two:\n    env:\n      uses: a/b@c\n    steps:\n      - run: x", ""),
    ("      - run: >-\n          uses: a/b@c\n      - {name}: x", None),
    ("      - run: x\n    env: {\n      uses: a/b@c\n    }", None),
    ("      - run: &s |\n          uses: a/b@c", None),
    ("      - name: y\n\t        uses: a/b@c", None),
    ('      - run: "echo\n        uses: a/b@c\n"', None),
    ("      - run: 'it''s'\n      - uses: a/b@c\n        not a key", None),
    ("      - uses: a/b@c\n       - uses: a/b@c", None),
    ('      - run: "x \\\\"\n      - uses: a/b@c', "2"),
    ('      - run: "x \\"\n      - uses: a/b@c', None),
    ("on:\n  uses: a/b@c\njobs:\n  - uses: a/b@c", None),
    ("# note\n\non: push\njobs:\n   two:\n     uses: a/b@c", "6"),
    ("    steps:\n      - uses: a/b@c\n    - uses: a/b@c", "2"),
    (" three: x", None),
)
_WAYS = len(WRITTEN)
_NUMBERS = " ".join(f"when {k} then " + ("concat_ws(','" + "".join(f", cast(n + {x} as varchar)" for x in lines.split(",") if x) + ", '')" if lines else "''") for k, (_, lines) in enumerate(WRITTEN) if lines is not None)


@query(f"""with d as (select doc_id, 6 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 as n from documents)
    select doc_id, nullif(rtrim(case doc_id % {_WAYS} {_NUMBERS} end, ','), '-') as lines, doc_id % {_WAYS} in ({", ".join(str(k) for k, (_, lines) in enumerate(WRITTEN) if lines is None)}) as ambiguous from d""")
def action_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name an action, in workflows whose first step holds the whole text."""
    tail = f"case doc_id % {_WAYS} " + " ".join(f"when {k} then {_spelled(w)}" for k, (w, _) in enumerate(WRITTEN)) + " end"
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat({SCRIPT}, {tail})").alias("content"))
    found = rows.select("doc_id", action_line_numbers(F.col("content")).alias("lines"))
    return found.select("doc_id", F.when(F.col("lines").isNotNull(), F.concat_ws(",", "lines")).alias("lines"), F.col("lines").isNull().alias("ambiguous"))


_APP, _GUIDE = "'src/app.py'", "'docs/x.md'"
#: Two versions of a document's workflow, by doc_id: the pinned commit alone moved (0, with its comment 1), or more or other things changed.
_PIN = "concat('      - uses: ', {0}, '@', repeat('{1}', 40), '{2}', chr(10), {3})"
VERSION_AFTER = "case doc_id % 13 when 0 then " + _PIN.format("'a/b'", "2", "", "'      - run: make'") + " when 1 then " + _PIN.format("'a/b'", "2", " # v7", "'      - run: make'") + " when 2 then " + _PIN.format("'evil/b'", "2", "", "'      - run: make'") + " when 3 then " + _PIN.format("'a/b'", "2", "", "'      - run: test'") + " when 7 then " + _PIN.format("'a/b'", "2", "", "concat('      - run: make', chr(10), '      - run: more')") + " when 8 then " + _PIN.format("'a/b'", "2", "#no comment", "'      - run: make'") + " when 9 then concat('    env:', chr(10), '      uses: a/b@', repeat('2', 40)) when 10 then " + _PIN.format("'a/b'", "1", "", "'      - run: make'") + " else " + _PIN.format("'a/b'", "2", "", "'      - run: make'") + " end"


@query("""with d as (select doc_id // 2 as repo_id, bool_and(doc_id % 13 in (0, 1)) and any_value(doc_id // 2) % 5 <> 0 as pins from documents group by doc_id // 2)
    select repo_id, 1 as at, case when pins or repo_id % 7 = 0 then 'pass' else 'fail' end as status, pins as action_ref_update_only from d
    union all select repo_id, 2, case when repo_id % 7 = 0 then 'pass' else 'fail' end, false from d""")
def pinned_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact rules of repositories of two workflows each, with and without the exemption of changes that only move pinned commits."""
    docs = _table(spark, sf_dir, "documents").withColumn("repo_id", F.expr("doc_id div 2"))
    path = F.expr("concat('.github/workflows/', if(doc_id % 13 = 6, 't/', ''), 'w', doc_id, '.yml')")
    before = f"case doc_id % 13 when 9 then concat('    env:', chr(10), '      uses: a/b@', repeat('1', 40)) else {_PIN.format(chr(39) + 'a/b' + chr(39), '1', '', chr(39) + '      - run: make' + chr(39))} end"
    side = lambda tail: F.expr(f"concat({SCRIPT}, {tail})").cast("binary")
    versions = docs.select("repo_id", path.alias("path"), F.expr("if(doc_id % 13 = 5, 'A', 'M')").alias("kind"), F.lit("100644").alias("base_mode"), F.expr("if(doc_id % 13 = 12, '120000', '100644')").alias("index_mode"), F.expr("if(doc_id % 13 = 4, '100755', '100644')").alias("disk_mode"), side(before).alias("before"), F.when(F.expr("doc_id % 13 <> 11"), side(VERSION_AFTER)).alias("after"), F.expr("if(doc_id % 13 = 11, 'FileUnreadable', null)").alias("error"))
    repos = docs.select("repo_id").distinct()
    changes = docs.select("repo_id", path.alias("path")).unionByName(repos.selectExpr("repo_id", f"inline(filter({_rows('path, is_in', (_APP, 'repo_id % 5 = 0'), (_GUIDE, 'repo_id % 7 = 0'))}, x -> x.is_in))").select("repo_id", "path"))
    rules = repos.selectExpr("repo_id", "inline(" + _rows("at, change, requires_any, exempt", ("1", "array('.github/workflows/**', 'src/**')", "array('docs/*.md')", "true"), ("2", "array('.github/**')", "array('docs/**')", "false")) + ")")
    return consistency.impact_results(rules, changes, consistency.pin_updates(versions))


FAULT_CONFIG = f'{{"schema": "{SCHEMA_ID}", "mode": "enforce", "markdown": {{"include": ["docs/**"]}}, "impact_map": [{{"change": ["src/**"], "requires_any": ["docs/**"]}}]}}'


@query("""select doc_id as repo_id, case doc_id % 20 when 0 then 'pass' when 10 then 'fail' else 'tool_error' end as status, case when doc_id % 10 in (0, 7) then 'enforce' end as mode,
    case doc_id % 10 when 0 then case when doc_id % 20 = 10 then 'related_docs_update_missing:impact-1' else '' end when 1 then 'git_consistency_diff_failed' when 2 then 'git_consistency_diff_failed' when 7 then 'markdown_unreadable:docs/a.md' when 9 then 'invalid_consistency_config' else 'git_consistency_inventory_failed' end as findings from documents""")
def consistency_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of which something could not be read: a base, the list of files, a conflict, a mode, a document, the repository, its configuration. None of them passes."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id as repo_id", "coalesce(text, '') as text")
    repos = docs.selectExpr("repo_id", "if(doc_id % 10 = 8, 'NotARepository', null) as error")
    configs = docs.select("repo_id", F.lit(FAULT_CONFIG).alias("content"), F.expr("if(doc_id % 10 = 9, 'FileUnreadable', null)").alias("error"))
    rows = _rows(
        "path, mode, stage, content, error",
        ("'README.md'", "'100644'", "0", "text", "string(null)"),
        ("'docs/a.md'", "'100644'", "0", "if(doc_id % 10 = 7, null, text)", "if(doc_id % 10 = 7, 'FileUnreadable', null)"),
        ("if(doc_id % 10 = 3, null, 'c.txt')", "if(doc_id % 10 = 6, '040000', '100644')", "if(doc_id % 10 = 5, 2, 0)", "string(null)", "case doc_id % 10 when 3 then 'CalledProcessError' when 6 then 'UnknownMode' end"),
    )
    files = docs.where("doc_id % 10 <> 4").selectExpr("repo_id", "true as tracked", f"inline({rows})")
    row = "scope, kind, path, old_path, error"
    some = _rows(row, ("'base'", "string(null)", "'c0ffee'", "string(null)", "string(null)"), ("if(doc_id % 20 = 10, 'worktree', 'committed')", "'M'", _APP, "string(null)", "string(null)"))
    answers = f"case doc_id % 10 when 1 then {_rows(row, (*['string(null)'] * 4, repr('CalledProcessError')))} when 2 then filter({some}, x -> false) else {some} end"
    changes = docs.select("repo_id", F.inline(F.expr(answers)))
    out = consistency.check(repos, configs, files, SCHEMA_ID, changes)
    return out.select("repo_id", "status", "mode", F.concat_ws(",", "findings").alias("findings"))


@query(f"""with d as (select source, doc_id % 3 <> 0 and doc_id % 5 <> 0 as there, doc_id % 11 = 0 as two, doc_id % 13 = 0 as link, doc_id % 17 = 0 as odd, regexp_matches({SECRET_TEXT}, {DUCK_SECRETS}) as hit from documents)
    select source as repo_id, cast(count(*) filter (where there and not two and not link and not odd) as bigint) as files, cast(count(*) filter (where there and not two and not link and not odd and hit) as bigint) as findings, cast(count(*) filter (where there and (two or (odd and not link))) as bigint) as errors
    from d group by source having count(*) filter (where there and (two or not link)) > 0""")
def changed_since_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files committed since a base and their secrets: older findings, deleted files and links are left out, entries that don't add up are errors."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.expr(SECRET_TEXT).alias("content"))
    files = docs.select("repo_id", "path", "content", F.lit(None).cast("string").alias("error"))
    index = docs.select("repo_id", "path", F.expr("case when doc_id % 13 = 0 then '120000' when doc_id % 17 = 0 then '040000' else '100644' end").alias("mode"), F.explode(F.expr("if(doc_id % 11 = 0, array(1, 2), array(0))")).alias("stage"), F.lit(None).cast("string").alias("error"))
    changes = docs.select("repo_id", F.expr("if(doc_id % 3 = 0, 'worktree', 'committed')").alias("scope"), "path", F.expr("doc_id % 5 <> 0").alias("on_disk"), F.lit(None).cast("string").alias("error"))
    out = repositories.files_since(files, index, changes)
    hit = content_has_any(F.col("content"), SECRETS)
    return out.groupBy("repo_id").agg(F.count_if(F.col("error").isNull()).alias("files"), F.count_if(F.col("error").isNull() & hit).alias("findings"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query(f"""with d as (select concat('o', cast(doc_id as varchar)) as oid, source, doc_id, octet_length(encode(coalesce(text, ''))) as size, regexp_matches({SECRET_TEXT}, {DUCK_SECRETS}) as hit from documents),
    i as (select source as repo_id, * from d union all select concat('fork of ', source), * from d where doc_id % 2 = 0)
    select repo_id, cast(count(*) filter (where size <= 20000) as bigint) as blobs, cast(count(*) filter (where hit and doc_id % 500 <> 3 and size <= 20000) as bigint) as findings, bool_or(doc_id % 500 = 3 and size <= 20000) as unknown from i where repo_id is not null group by repo_id having count(*) filter (where size <= 20000) > 0""")
def shared_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of repositories and their forks: a shared object's text is matched once, its verdict joined to every repository that holds it; a missing one is unknown."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("oid"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.expr(SECRET_TEXT).alias("content"))
    verdicts = scan.object_verdicts(docs.where("doc_id % 500 <> 3").select("oid", "content"))
    repos = F.explode(F.expr("if(doc_id % 2 = 0, array(source, concat('fork of ', source)), array(source))"))
    inventory = docs.select(repos.alias("repo_id"), "oid", F.lit("blob").alias("type"), "size").where("repo_id is not null")
    held = scan.history_of(inventory, verdicts, 20000)
    return held.groupBy("repo_id").agg(F.count("*").alias("blobs"), F.count_if("secret").alias("findings"), F.bool_or(F.col("error").isNotNull()).alias("unknown"))


#: First headings of each document: marks, letters of any script, code and punctuation.
TITLES = ("# 🚀 Go", "# Go", "## `x` y", "## _x", "##  ☃ deep", "### é", "# (x)", "## 日本", "#☃", "####### ☃")


@query(f"select doc_id, doc_id % {len(TITLES)} in (0, 4, 6) as decorated from documents")
def decorated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that begin with a mark that is no letter, number, code or white space."""
    title = f"case doc_id % {len(TITLES)} " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TITLES)) + " end"
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat({title}, chr(10), coalesce(text, ''))").alias("text"))
    return readme.release_review(rows).select("doc_id", F.array_contains("codes", "decorative_heading_emoji").alias("decorated"))


ANSWER = "case event_id % 9 when 0 then 'dismiss_30d' when 1 then 'dismiss_90d' when 2 then 'dismiss_forever' when 3 then 'dismiss_7d' when 4 then 'yes' when 5 then 'snooze_12d' when 6 then 'snooze_d' when 7 then '31d' end"


@query(f"""with a as (select event_id, {ANSWER} as answer from events), m as (select event_id, answer, case answer when 'dismiss_30d' then '30d' when 'dismiss_90d' then '90d' when 'dismiss_forever' then 'forever' when 'dismiss_7d' then '7d' end as mode from a)
    select event_id, mode, case when mode = 'forever' then 'forever' when mode is not null or answer = 'snooze_12d' then 'snooze' end as recorded,
      case when mode = '30d' then date '2024-07-01' when mode = '90d' then date '2024-08-30' when mode = '7d' then date '2024-06-08' when answer = 'snooze_12d' then date '2024-06-13' end as until from m""")
def dismissal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as modes, and modes, named or spelled out in days, as entries; others record nothing."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(ANSWER).alias("answer")).withColumn("mode", preferences.answer_mode(F.col("answer")))
    recorded = dialogue.record_dismissal(F.coalesce("mode", "answer"), F.expr(AS_OF))
    return rows.select("event_id", "mode", recorded.getField("mode").alias("recorded"), recorded.getField("until").alias("until"))


@query("""with d as (select o_orderkey as repo_id, o_orderkey % 7 > 3 as had, case when o_orderkey % 3 = 0 then 'forever' else 'none' end as a, strftime(cast(o_orderdate as date), '%Y-%m-%d') as day from orders where o_orderkey % 4 > 0)
    select repo_id, case when repo_id % 4 > 1 then 'snooze' when had then a end as a_mode, case when repo_id % 4 > 1 then '2024-07-01' end as a_until, case when repo_id % 4 = 3 then 'forever' when had then 'snooze' end as b_mode, case when repo_id % 4 < 3 and had then concat(day, 'T09:00') end as b_until, case when had then 'forever' end as c, case when repo_id % 4 < 3 then 'x' else '' end as refused from d""")
def preferences_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference documents after answers: entries that were there stay, those answered are replaced, unknown answers refused."""
    orders = _table(spark, sf_dir, "orders").withColumn("repo_id", F.col("o_orderkey"))
    prefs = preferences.loaded(orders.select("repo_id", F.expr(PREFERENCES).alias("content")))
    given = _rows("id, mode, reason, is_in", ("'a'", "'30d'", "'later'", "repo_id % 4 > 1"), ("'a'", "'7d'", "'soon'", "repo_id % 4 = 2"), ("'b'", "'forever'", "string(null)", "repo_id % 4 = 3"), ("'x'", "'whenever'", "''", "repo_id % 4 in (1, 2)"))
    answers = orders.selectExpr("repo_id", f"inline(filter({given}, x -> x.is_in))")
    out = preferences.answered(prefs, answers, F.expr(AS_OF), "gatehouse.preferences/v1")
    of = lambda path: F.get_json_object("content", f"$.dismissals.{path}")
    return out.select("repo_id", of("a.mode").alias("a_mode"), of("a.until").alias("a_until"), of("b.mode").alias("b_mode"), of("b.until").alias("b_until"), of("c").alias("c"), F.concat_ws(",", "refused").alias("refused"))


@query("""with d as (select doc_id as repo_id, case doc_id % 4 when 1 then 'shadow' when 2 then 'enforce' when 3 then 'ratchet' end as mode from documents)
    select repo_id, mode, case when mode = 'enforce' then 'pass' else 'tool_error' end as status, case when mode is null then 'required_consistency_config_missing' when mode <> 'enforce' then 'required_consistency_mode_mismatch' else '' end as findings from d""")
def required_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that call for a configuration and for one mode of it: another mode, or none, is an error whatever was found."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id as repo_id", "coalesce(text, '') as text")
    mode = F.expr("case doc_id % 4 when 1 then 'shadow' when 2 then 'enforce' else 'ratchet' end")
    config = F.to_json(F.struct(F.lit(SCHEMA_ID).alias("schema"), mode.alias("mode"), F.struct(F.array().cast("array<string>").alias("baseline")).alias("ratchet")))
    configs = docs.where("doc_id % 4 > 0").select("repo_id", config.alias("content"))
    files = docs.selectExpr("repo_id", "'docs/a.md' as path", "true as tracked", "text as content")
    out = consistency.check(docs, configs, files, SCHEMA_ID, require_config=True, require_mode="enforce")
    return out.select("repo_id", "mode", "status", F.concat_ws(",", "findings").alias("findings"))


@query("""select c_custkey as repo_id, case c_custkey % 3 when 1 then 'fix_tool_error' else concat('confirm_repo_identity,confirm_visibility_private_default,', case when c_custkey % 3 = 2 and c_custkey % 5 = 0 then 'create_missing_license,' else '' end, case when c_custkey % 2 = 0 then 'refresh_github_settings_baseline,' else '' end, 'seed_required_documents') end
      || case when c_custkey % 3 = 1 and c_custkey % 2 = 0 then ',refresh_github_settings_baseline' else '' end as ids, case c_custkey % 3 when 1 then 'blocked' else 'needs_human_input' end as status from customer""")
def new_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked before a repository is created: unscanned, scanned with a broken scan, and scanned with a missing document; some with a stale guide."""
    customer = _table(spark, sf_dir, "customer").withColumn("repo_id", F.col("c_custkey"))
    scans = customer.selectExpr("repo_id", "case repo_id % 3 when 1 then 'tool_error' when 2 then 'pass' end as status", "if(repo_id % 2 = 0, 'stale', 'unknown') as baseline")
    found = customer.where("repo_id % 5 = 0").selectExpr("repo_id", "'required_documents' as name", "'fail' as status", "array('LICENSE') as missing")
    props = dialogue.conversation(scans, found, "create_repo")
    ids = props.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return dialogue.dialogue_status(scans, props).join(ids, "repo_id").select("repo_id", "ids", "status")


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as repositories of 200 files, in two commits and a worktree: by doc_id a file stays, is changed, deleted or added, committed or not."""
    docs = _table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 200 as repo_id", "concat('d', doc_id % 7, '/f', doc_id, '.md') as path", "coalesce(text, '') as text")
    later = "if(doc_id % 10 in (1, 4), null, concat(text, '!'))"
    steps = _rows("revision, content, is_in", ("0", "text", "doc_id % 10 not in (0, 6)"), ("1", later, "doc_id % 10 in (0, 1, 2)"), ("2", later, "doc_id % 10 in (3, 4, 6)"))
    rows = docs.selectExpr("repo_id", "path", f"inline(filter({steps}, x -> x.is_in))")
    folder = f"{staging_folder(spark)}/repositories-{uuid.uuid4().hex}"
    return write_archives(rows, folder, worktree=2, author="me <me@x.org>", origin="https://u:p@Host.org/x.git?q").withColumn("base", F.lit("origin/main"))


_ARCHIVED = "select doc_id, doc_id // 200 as repo_id, concat('d', cast(doc_id % 7 as varchar), '/f', cast(doc_id as varchar), '.md') as path, coalesce(text, '') as text, doc_id % 10 as k from documents where doc_id is not null"


@query(f"""with d as ({_ARCHIVED})
    select cast(repo_id as varchar) as repo_id, path, k <> 6 as tracked, md5(case when k in (0, 2, 3, 6) then concat(text, '!') else text end) as digest from d where k not in (1, 4)""")
def git_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents committed to repositories and read back from their index and disk: changed, deleted and untracked ones as they are on disk."""
    files = repositories.read_files(_archived(spark, sf_dir), parts=2)
    return files.select("repo_id", "path", "tracked", F.md5("content").alias("digest"))


@query(f"""with d as ({_ARCHIVED})
    select cast(repo_id as varchar) as repo_id, 'committed' as scope, case k when 0 then 'A' when 1 then 'D' else 'M' end as kind, path, k <> 1 as on_disk from d where k in (0, 1, 2)
    union all select cast(repo_id as varchar), 'worktree', case when k = 0 then 'A' when k in (1, 4) then 'D' else 'M' end, path, k not in (1, 4) from d where k in (0, 1, 2, 3, 4)
    union all select cast(repo_id as varchar), 'deleted', 'D', path, false from d where k = 4""")
def git_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from the base: committed since, on disk now, and gone from disk, each path with git's letter."""
    rows = repositories.read_changes(_archived(spark, sf_dir)).where("scope <> 'base' or error is not null")
    # a rename is both its paths
    paths = F.array_compact(F.array(F.struct(F.when(F.col("kind") == "R", "A").otherwise(F.col("kind")).alias("kind"), F.col("path").alias("path"), F.col("on_disk").alias("on_disk")), F.when(F.col("kind") == "R", F.struct(F.lit("D").alias("kind"), F.col("old_path").alias("path"), F.lit(False).alias("on_disk")))))
    return rows.select("repo_id", "scope", F.inline(paths))


@query(f"""with d as ({_ARCHIVED}), r as (select repo_id, count(*) filter (where k not in (1, 6)) as entries, bool_or(k in (3, 4, 6)) as dirty from d group by repo_id),
    o as (select repo_id, count(distinct t) as blobs from (select repo_id, text as t from d where k not in (0, 6) union all select repo_id, concat(text, '!') from d where k in (0, 2)) x group by repo_id)
    select cast(repo_id as varchar) as repo_id, dirty, 'https://host.org/x.git' as origin, true as valid, 'refs/remotes/origin/main' as ref, 'me <me@x.org>' as identities, cast(entries as bigint) as entries, cast(coalesce(blobs, 0) as bigint) as blobs from r left join o using (repo_id)""")
def git_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, origin, base, identities, index and history of the repositories: one row each."""
    repos = _archived(spark, sf_dir)
    facts = repositories.read_repositories(repos).select("repo_id", "dirty", redacted_remote(F.col("origin")).alias("origin"))
    bases = repositories.read_bases(repos).select("repo_id", "valid", "ref")
    people = repositories.read_commits(repos.drop("base")).groupBy("repo_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("author"), F.collect_set("committer"))), ",").alias("identities"))
    entries = repositories.read_index(repos).where("error is null").groupBy("repo_id").agg(F.count("*").alias("entries"))
    blobs = repositories.read_objects(repos.drop("base"), max_bytes=1 << 40).where("error is null").groupBy("repo_id").agg(F.count("*").alias("blobs"))
    for other in (bases, people, entries, blobs):
        facts = facts.join(other, "repo_id", "left")
    return facts
