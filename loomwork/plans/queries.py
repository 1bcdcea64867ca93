"""Registered queries of the base operators, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.secret_patterns import SECRET_PATTERNS
from loomwork.operators import graph, report, search, sets
from loomwork.plans import code_queries, file_queries, more_queries
from loomwork.plans.inputs import DEGREES, EDGES, FINDINGS, FIRST, LINES, REPEATED, documents, findings, first_order, part_graph, repeated, roots
from loomwork.sources.tables import table
from loomwork.streaming import sessions


QUERIES = {
    "search_literal": lambda s, d: search.matching(documents(s, d), "license"),
    "search_regex": lambda s, d: search.matching(documents(s, d), r"[0-9]{3}-[0-9]{4}", regex=True),
    "search_word_sensitive": lambda s, d: search.matching(documents(s, d), "In", whole_word=True),
    "search_line_inverted": lambda s, d: search.matching(documents(s, d), r"[a-zA-Z]", regex=True, invert=True),
    "search_count": lambda s, d: search.file_counts(documents(s, d), "the"),
    "search_without_match": lambda s, d: search.files_without_match(documents(s, d), "the"),
    "search_context": lambda s, d: search.with_context(documents(s, d), "token =", 1, 1),
    "search_ranges": lambda s, d: search.match_ranges(documents(s, d), "rights", 2),
    "search_page": lambda s, d: search.search_page(documents(s, d), "the", page=2),
    "line_range": lambda s, d: search.line_range(documents(s, d), 2, 4),
    "char_page": lambda s, d: search.char_page(documents(s, d), 100, 50),
    "duplicate_groups": lambda s, d: sets.duplicate_groups(documents(s, d)),
    "keep_first": lambda s, d: sets.keep_first(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"),
    "union_keep_left": lambda s, d: sets.union_keep_left(
        table(s, d, "labels").select("doc_id", F.lit("label").alias("origin")), documents(s, d).select("doc_id", F.lit("document").alias("origin")), ["doc_id"]
    ),
    "unused_parts": lambda s, d: sets.unused(table(s, d, "part"), table(s, d, "lineitem"), F.expr("p_partkey = l_partkey and l_quantity > 45")).select("p_partkey"),
    "range_overlap": lambda s, d: sets.range_overlap(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("a"), F.expr("l_shipdate + interval 30 days").alias("b")),
        table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("f"), F.expr("o_orderdate + interval 365 days").alias("t")),
        "l_orderkey", ("a", "b"), ("f", "t"),
    ).select("l_orderkey", "l_linenumber", "l_partkey"),
    "graph_degrees": lambda s, d: graph.degrees(*part_graph(s, d)),
    "graph_instability": lambda s, d: graph.unstable_dependencies(*part_graph(s, d)),
    "graph_reachable": lambda s, d: graph.reachable(repeated(s, d)[1], roots(repeated(s, d)[1])),
    "graph_components": lambda s, d: graph.components(*repeated(s, d)),
    "graph_reachable_all": lambda s, d: graph.reachable(part_graph(s, d)[1], first_order(s, d)),
    "graph_components_all": lambda s, d: graph.components(*part_graph(s, d)),
    "graph_rollup": lambda s, d: graph.rolled_up(part_graph(s, d)[1], table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp"))),
    "severity_counts": lambda s, d: report.severity_counts(findings(s, d)),
    "health_score": lambda s, d: report.health(findings(s, d), 10_000),
    "health_per_file": lambda s, d: report.health(findings(s, d)),
    "top_per_category": lambda s, d: report.top_per_category(findings(s, d)),
    "diversified_top": lambda s, d: report.diversified(findings(s, d), 25).select("id", "category", "severity"),
    "baseline_filter": lambda s, d: report.against_baseline(findings(s, d), findings(s, d).where("severity = 'critical'")),
    "redact": lambda s, d: documents(s, d).select("doc_id", T.secret_count(F.col("text")).alias("n_secrets"), F.sha2(T.redact(F.col("text")).cast("binary"), 256).alias("redacted_sha256")),
    "redact_secrets": lambda s, d: documents(s, d).select("doc_id", T.redacted(F.col("text")).alias("r")).select(
        "doc_id", F.col("r.n").alias("n_secrets"), F.array_join("r.names", ",").alias("secrets"), F.sha2(F.col("r.text").cast("binary"), 256).alias("redacted_sha256")
    ),
    "mask_secrets": lambda s, d: documents(s, d).select("doc_id", T.mask_secrets(F.col("text")).alias("m")).select("doc_id", F.sha2(F.col("m").cast("binary"), 256).alias("masked_sha256")),
    "mask": lambda s, d: table(s, d, "customer").select("c_custkey", T.masked(F.col("c_name")).alias("masked")),
    "size_text": lambda s, d: documents(s, d).select("doc_id", T.size_text(F.col("n_chars") * 37).alias("size")),
    "strip_html": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(T.stripped(F.col("html")).cast("binary"), 256).alias("text_sha256")),
    "window_counters": lambda s, d: sessions.window_counters(table(s, d, "events")),
    "user_sessions": lambda s, d: sessions.user_sessions(table(s, d, "events")),
}

_SECRETS = r"""regexp_replace(regexp_replace(regexp_replace(text, 'token = "[0-9a-f]{40}"', '[REDACTED-TOKEN]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED-EMAIL]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[REDACTED-IPV4]', 'g')"""

#: Documents have no path, so the patterns for certain paths do not apply.
_PATTERNS = ", ".join("({}, '{}', '{}')".format(k, n, p.replace("'", "''")) for k, (n, p) in enumerate((n, p) for n, p, c in SECRET_PATTERNS if c is None))

def _hits(patterns: list[str]) -> str:
    """Documents in which any pattern finds something, each pattern as a constant; others are left as they are."""
    return " union ".join("select doc_id from documents where regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in patterns)


_HITS = _hits([p for _, p, c in SECRET_PATTERNS if c is None])
#: Without regard to case, and for an engine whose repetitions end at 1,000.
_ANY_CASE = [p.removeprefix("(?i)").replace("(?s:.){0,2000}?", "(?s:.){0,1000}?(?s:.){0,1000}?") for _, p, _ in SECRET_PATTERNS]
_ANY_CASE_HITS = _hits(["(?i)" + p for p in _ANY_CASE])
_UNION = "(?i)" + "|".join(f"(?:{p})" for p in _ANY_CASE).replace("'", "''")

ORACLE_SQL = {
    "search_literal": f"with {LINES} select doc_id, line::INT as line, content from lines where regexp_matches(content, '(?i)license')",
    "search_regex": f"with {LINES} select doc_id, line::INT as line, content from lines where regexp_matches(content, '[0-9]{{3}}-[0-9]{{4}}')",
    "search_word_sensitive": f"with {LINES} select doc_id, line::INT as line, content from lines where regexp_matches(content, '(^|[^\\p{{L}}\\p{{N}}_])In($|[^\\p{{L}}\\p{{N}}_])')",
    "search_line_inverted": f"with {LINES} select doc_id, line::INT as line, content from lines where not regexp_matches(content, '[a-zA-Z]')",
    "search_count": f"with {LINES} select doc_id, count(*) as match_lines, sum(n)::BIGINT as matches from (select doc_id, len(regexp_extract_all(content, '(?i)the')) as n from lines) where n > 0 group by doc_id",
    "search_without_match": f"with {LINES} select doc_id from documents where doc_id not in (select doc_id from lines where regexp_matches(content, '(?i)the'))",
    "search_context": f"""with {LINES}, c as (select doc_id, line, content, concat_ws(chr(10), lag(content) over w, content, lead(content) over w) as v from lines window w as (partition by doc_id order by line))
select doc_id, line::INT as line, case when length(v) > 200 then substr(v, 1, 197) || '...' else v end as value from c where regexp_matches(content, '(?i)token =')""",
    "search_ranges": f"""with {LINES}, m as (select l.doc_id, line, greatest(1, line - 2) as f, least(total, line + 2) as t from lines l join (select doc_id, max(line) as total from lines group by doc_id) using (doc_id) where regexp_matches(content, '(?i)rights')),
i as (select *, sum(case when f > coalesce(p, -1) + 1 then 1 else 0 end) over (partition by doc_id order by line) as g from (select *, lag(t) over (partition by doc_id order by line) as p from m))
select doc_id, min(f)::INT as "first", max(t)::INT as "last", count(*) as n_matches from i group by doc_id, g""",
    "search_page": f"""with {LINES}, m as (select * from lines where regexp_matches(content, '(?i)the')), c as (select doc_id, count(*) as total_matches from m group by doc_id order by doc_id limit 10 offset 10)
select doc_id, line::INT as line, content, total_matches from m join c using (doc_id) qualify row_number() over (partition by doc_id order by line) <= 10""",
    "line_range": "select doc_id, len(l)::INT as n_lines, array_to_string(l[2:4], chr(10)) as content from (select doc_id, string_split(text, chr(10)) as l from documents) where len(l) >= 2",
    "char_page": "select doc_id, 3::INT as page, ceil(length(substr(text, 101, 50)) / 4)::BIGINT as tokens, substr(text, 101, 50) as content from documents",
    "duplicate_groups": "select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) >= 2",
    "keep_first": "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1",
    "union_keep_left": "select doc_id, 'label' as origin from labels union all select doc_id, 'document' from documents where doc_id not in (select doc_id from labels)",
    "unused_parts": "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)",
    "range_overlap": "select l_orderkey, l_linenumber, l_partkey from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and l_shipdate <= o_orderdate + interval 365 days and l_shipdate + interval 30 days >= o_orderdate)",
    "graph_degrees": f"with {DEGREES} select node, outgoing, incoming, case when outgoing > 0 and incoming > 0 then 'inner' when outgoing > 0 then 'root' when incoming > 0 then 'leaf' else 'orphan' end as kind from degrees",
    "graph_instability": f"""with {DEGREES}, i as (select node, case when outgoing + incoming > 0 then outgoing / (outgoing + incoming) else 0.0 end as v from degrees)
select src, dst, round(t.v - s.v, 6) as delta, case when t.v - s.v > 0.3 then 'high' else 'medium' end as severity from edges join i s on s.node = src join i t on t.node = dst where t.v - s.v > 0.15 and s.v < 0.6""",
    "graph_reachable": f"""with recursive {REPEATED}, walk as (select src as node, 0 as hops from edges where src not in (select dst from edges) union select dst, hops + 1 from walk join edges on src = node where hops < 60)
select node::BIGINT as node, min(hops)::INT as hops from walk group by node""",
    "graph_components": f"""with recursive {REPEATED}, both_ways as (select src, dst from edges union select dst, src from edges), walk as (select p_partkey as node, p_partkey as seen from part union select dst, seen from walk join both_ways on src = node)
select node, min(seen) as component from walk group by node""",
    "graph_reachable_all": f"""with recursive {EDGES}, {FIRST}, walk as (select node, 0 as hops from first union select dst, hops + 1 from walk join edges on src = node where hops < 30)
select node, min(hops)::INT as hops from walk group by node""",
    "graph_components_all": f"""with recursive {EDGES}, both_ways as (select src, dst from edges union select dst, src from edges), walk as (select p_partkey as node, p_partkey as seen from part union select dst, seen from walk join both_ways on src = node where seen <= dst)
select node, min(seen) as component from walk group by node""",
    "graph_rollup": f"with {EDGES} select s.p_brand as src_group, t.p_brand as dst_group, count(*) as weight from edges join part s on s.p_partkey = src join part t on t.p_partkey = dst where s.p_brand <> t.p_brand group by 1, 2",
    "severity_counts": f"with {FINDINGS} select s as severity, count(id) as n from (select unnest(['critical', 'high', 'medium', 'low', 'info']) as s) left join findings on severity = s group by s",
    "health_score": f"""with {FINDINGS} select least(floor(100 / (1 + sum([25, 10, 3, 1, 0][r + 1]) / 10000 / 10) + 0.5), case min(r) when 0 then 95 when 1 then 98 else 99 end)::BIGINT as score from ranked""",
    "health_per_file": f"""with {FINDINGS} select least(floor(100 / (1 + sum([25, 10, 3, 1, 0][r + 1]) / greatest(count(distinct file), 1) / 10) + 0.5), case min(r) when 0 then 95 when 1 then 98 else 99 end)::BIGINT as score from ranked""",
    "top_per_category": f"with {FINDINGS}, own as (select *, row_number() over (partition by category order by r, id) as k from ranked) select id, category, file, severity from own where k <= 2 order by r, category, id limit 20",
    "diversified_top": f"with {FINDINGS}, own as (select *, row_number() over (partition by category order by r, id) as k from ranked) select id, category, severity from own order by k, r, category, id limit 25",
    "baseline_filter": f"with {FINDINGS} select id, category, file, severity from findings f where not exists (select 1 from findings b where b.severity = 'critical' and b.category = f.category and b.file = f.file)",
    "redact": rf"""select doc_id, (len(regexp_extract_all(text, 'token = "[0-9a-f]{{40}}"')) + len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) + len(regexp_extract_all(text, '\b[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\b')))::INT as n_secrets, sha256({_SECRETS}) as redacted_sha256 from documents""",
    "redact_secrets": f"""with recursive p(k, name, re) as (values {_PATTERNS}), hit as ({_HITS}), walk as (
  select doc_id, text, 0 as k, 0 as n, '' as names from documents where length(text) <= 10000000 and doc_id in (select doc_id from hit)
  union all
  select doc_id, case when found then regexp_replace(text, re, '[REDACTED-' || name || ']', 'g') else text end, k + 1,
    n + case when found then len(regexp_extract_all(text, re)) else 0 end::INT, case when found then names || ',' || name else names end
  from (select walk.*, re, name, regexp_matches(text, re) as found from walk join p on p.k = walk.k))
select doc_id, n as n_secrets, substr(names, 2) as secrets, sha256(text) as redacted_sha256 from walk where k = (select count(*) from p)
union all select doc_id, 0, '', sha256(text) from documents where length(text) <= 10000000 and doc_id not in (select doc_id from hit)
union all select doc_id, 1, 'content-size-exceeded', sha256('[CONTENT-REDACTED-SIZE-LIMIT]') from documents where length(text) > 10000000""",
    "mask_secrets": f"""with hit as ({_ANY_CASE_HITS}), cut as (
  select doc_id, regexp_extract_all(text, '{_UNION}') as found, string_split_regex(text, '{_UNION}') as around from documents where doc_id in (select doc_id from hit)
), masked as (
  select doc_id, around, list_transform(found, lambda m: array_to_string(list_transform(range(1, length(m) + 1), lambda i: case when i % 2 = 1 then '*' else substr(m, i, 1) end), '')) as stars from cut
)
select doc_id, sha256(array_to_string(list_transform(range(1, len(around) + 1), lambda i: around[i] || coalesce(stars[i], '')), '')) as masked_sha256 from masked
union all select doc_id, sha256(text) from documents where doc_id not in (select doc_id from hit)""",
    "mask": "select c_custkey, array_to_string(list_transform(range(1, length(c_name) + 1), lambda i: case when i % 2 = 1 then '*' else substr(c_name, i, 1) end), '') as masked from customer",
    "size_text": "select doc_id, case when n < 1024 then printf('%.1fB', n::DOUBLE) when n < 1048576 then printf('%.1fKB', floor(n / 1024.0 * 10 + 0.5) / 10) else printf('%.1fMB', floor(n / 1048576.0 * 10 + 0.5) / 10) end as size from (select doc_id, n_chars * 37 as n from documents)",
    "strip_html": r"""select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) as text_sha256 from pages""",
    "window_counters": "select time_bucket(interval 1 hour, ts) as start, count(*) as calls, count(*) filter (event_type = 'error') as errors, round(count(*) filter (event_type = 'error') / count(*), 6) as error_rate from events group by 1",
    "user_sessions": """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from i group by user_id, k""",
}

QUERIES |= code_queries.QUERIES | file_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL |= code_queries.ORACLE_SQL | file_queries.ORACLE_SQL | more_queries.ORACLE_SQL
