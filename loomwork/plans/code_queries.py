"""Registered queries of detectors, reshaping and measures, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import measures as M
from loomwork.functions.text import size_text
from loomwork.operators import detectors, graph, shape
from loomwork.plans.inputs import DEGREES, EDGES, FINDINGS, FIRST, LINES, REPEATED, documents, findings, first_order, part_graph, repeated, roots
from loomwork.sources.tables import table

LAYERS = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE")
OPERANDS, OPERATORS = r"[^ .,;:!?\n\t]+", r"[.,;:!?]"
GLOB = "*/{en,de}/*"


def _uses(s, d):
    """Customers draw on order priorities."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("target"))


def _paths(s, d):
    return table(s, d, "pages").select("page_id", shape.url_path(F.col("url")).alias("path"))


def _measures(s, d):
    v = M.volume(F.col("text"), OPERANDS, OPERATORS)
    return documents(s, d).select("doc_id", F.regexp_count("text", F.lit(r"\?")).alias("q"), F.size(F.split("text", "\n")).alias("n"), v.alias("v")).where("v.length is not null")


def _affected_coupling(s, d):
    """Coupling findings on what depends on the nodes that nothing else is reached from."""
    nodes, links = repeated(s, d)
    changed = links.select(F.col("dst").alias("node")).distinct().join(links.select(F.col("src").alias("node")), "node", "left_anti")
    near = graph.affected(links, changed).select(F.col("node").alias("subject"))
    return detectors.coupling(*part_graph(s, d)).join(near, "subject", "left_semi").select("category", "subject", "severity", "total")


def _affected_coupling_all(s, d):
    """Coupling findings on what depends on the parts of the first order, over all edges."""
    near = graph.affected(part_graph(s, d)[1], first_order(s, d)).select(F.col("node").alias("subject"))
    return detectors.coupling(*part_graph(s, d)).join(near, "subject", "left_semi").select("category", "subject", "severity", "total")


def _weighted_top(s, d):
    score = F.round(F.col("p_retailprice") / 100 + 0.8 * F.col("incoming") + 0.4 * F.col("outgoing"), 4)
    both = graph.degrees(*part_graph(s, d)).join(table(s, d, "part").withColumnRenamed("p_partkey", "node"), "node")
    best = both.select("node", score.alias("score")).orderBy(F.desc("score"), "node").limit(20)
    return best.withColumn("risk", detectors.banded(F.col("score"), (60, "high"), (30, "medium")))


QUERIES = {
    "graph_affected_findings": _affected_coupling,
    "graph_neighbourhood": lambda s, d: graph.neighbourhood(repeated(s, d)[1], roots(repeated(s, d)[1]), 2),
    "graph_strong_components": lambda s, d: graph.strong_components(*repeated(s, d)),
    "graph_affected_findings_all": _affected_coupling_all,
    "graph_neighbourhood_all": lambda s, d: graph.neighbourhood(part_graph(s, d)[1], first_order(s, d), 2),
    "graph_strong_components_all": lambda s, d: graph.strong_components(*part_graph(s, d)),
    "coupling_findings": lambda s, d: detectors.coupling(*part_graph(s, d)),
    "main_sequence": lambda s, d: detectors.off_main_sequence(*part_graph(s, d), table(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("share"))),
    "layer_violations": lambda s, d: detectors.layer_violations(part_graph(s, d)[1], table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("name")), LAYERS),
    "feature_envy": lambda s, d: detectors.envy(_uses(s, d), 0.4, 3, 0.6),
    "mega_folders": lambda s, d: detectors.mega_folders(documents(s, d).select(F.col("lang").alias("folder"))),
    "repeated_literals": lambda s, d: detectors.repeated_literals(documents(s, d), "[0-9]{3,}"),
    "correlated_signals": lambda s, d: detectors.correlated(findings(s, d)),
    "category_scores": lambda s, d: detectors.category_scores(findings(s, d)),
    "finding_numbers": lambda s, d: detectors.numbered(findings(s, d)),
    "weighted_top": _weighted_top,
    "path_glob": lambda s, d: _paths(s, d).where(F.col("path").rlike(shape.glob_pattern(GLOB))),
    "folder_counts": lambda s, d: shape.folder_counts(_paths(s, d), 2),
    "row_page": lambda s, d: shape.row_page(documents(s, d).select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 20, 2),
    "page_links": lambda s, d: shape.links(table(s, d, "pages")),
    "presence_matrix": lambda s, d: shape.presence(documents(s, d).select(F.col("lang").alias("owner"), F.col("source").alias("item"), F.col("n_chars").alias("value")), ("de", "en", "es", "fr", "it")),
    "feed_freshness": lambda s, d: shape.freshness(table(s, d, "events").select(F.col("event_type").alias("feed"), "ts"), "2024-01-31 00:00:00", "36h"),
    "nearest_lines": lambda s, d: shape.nearest_lines(documents(s, d), "rights", "license"),
    "section_of_line": lambda s, d: shape.carried(documents(s, d), r"\.$"),
    "numbered_lines": lambda s, d: shape.numbered_lines(documents(s, d)),
    "suspicious_strings": lambda s, d: documents(s, d)
    .select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,}"), F.lit(0)))).alias("found"))
    .withColumn("entropy", F.round(M.entropy(F.col("found")), 4))
    .where("entropy > 3.2"),
    "text_volume": lambda s, d: _measures(s, d).select("doc_id", "v.*"),
    "text_maintainability": lambda s, d: _measures(s, d).select("doc_id", F.round(M.maintainability(F.col("v.volume"), F.col("q") + 1, F.col("n")), 4).alias("score")),
    "cut_at_space": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", M.cut_at_space(F.col("text"), 80).alias("shown")),
    "size_bytes": lambda s, d: documents(s, d).select("doc_id", M.size_bytes(size_text(F.col("n_chars") * 37)).alias("bytes")),
    "minify_html": lambda s, d: table(s, d, "pages").select("page_id", F.sha2(M.minified(F.col("html")).cast("binary"), 256).alias("minified_sha256")),
}

_COUPLED = "select 'high-coupling' as category, node as subject, case when outgoing + incoming > 25 then 'high' else 'medium' end as severity, outgoing + incoming as total from degrees where outgoing + incoming > 15"
_LAYER = "case " + " ".join(f"when contains(p_type, '{name}') then {k}" for k, name in enumerate(LAYERS)) + " end"
_VOLUME = rf"""vol as (select doc_id, n1 + n2 as vocabulary, m1 + m2 as length, (m1 + m2) * log2(greatest(n1 + n2, 1)) as v, case when n2 > 0 then n1 / 2.0 * m2 / n2 else 0.0 end as h, q, lines from
 (select doc_id, len(list_distinct(a))::BIGINT as n1, len(list_distinct(b))::BIGINT as n2, len(a)::BIGINT as m1, len(b)::BIGINT as m2, q, lines from
 (select doc_id, regexp_extract_all(text, '[.,;:!?]') as a, regexp_extract_all(text, '[^ .,;:!?\n\t]+') as b, len(regexp_extract_all(text, '\?')) as q, len(string_split(text, chr(10))) as lines from documents where text is not null)))"""
_PATHS = "paths as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages)"

ORACLE_SQL = {
    "graph_affected_findings": f"""with recursive {DEGREES}, {REPEATED.replace("edges as", "thin as", 1)}, walk as (select dst as node from thin where dst not in (select src from thin) union select src from walk join thin on dst = node)
select * from ({_COUPLED}) where subject in (select node from walk)""",
    "graph_neighbourhood": f"""with recursive {REPEATED}, ways as (select src, dst from edges union select dst, src from edges), walk as (select src as node, 0 as hops from edges where src not in (select dst from edges) union select dst, hops + 1 from walk join ways on src = node where hops < 2)
select node, min(hops)::INT as hops from walk group by node""",
    "graph_strong_components": f"""with recursive {REPEATED}, walk as (select src, dst from edges union select walk.src, edges.dst from walk join edges on walk.dst = edges.src)
select p_partkey as node, least(p_partkey, coalesce(min(a.dst), p_partkey)) as component from part left join (select w.src, w.dst from walk w join walk b on w.src = b.dst and w.dst = b.src) a on a.src = p_partkey group by p_partkey""",
    "graph_affected_findings_all": f"""with recursive {DEGREES}, {FIRST}, walk as (select node from first union select src from walk join edges on dst = walk.node)
select * from ({_COUPLED}) where subject in (select node from walk)""",
    "graph_neighbourhood_all": f"""with recursive {EDGES}, {FIRST}, ways as (select src, dst from edges union select dst, src from edges), walk as (select node, 0 as hops from first union select dst, hops + 1 from walk join ways on src = node where hops < 2)
select node, min(hops)::INT as hops from walk group by node""",
    "graph_strong_components_all": f"""with recursive {EDGES}, walk as (select src, dst from edges union select walk.src, edges.dst from walk join edges on walk.dst = edges.src)
select p_partkey as node, least(p_partkey, coalesce(min(a.dst), p_partkey)) as component from part left join (select w.src, w.dst from walk w join walk b on w.src = b.dst and w.dst = b.src) a on a.src = p_partkey group by p_partkey""",
    "coupling_findings": f"with {DEGREES} {_COUPLED}",
    "main_sequence": f"""with {DEGREES}, far as (select node as subject, round(abs(p_size / 50.0 + outgoing / (outgoing + incoming) - 1), 6) as distance from degrees join part on p_partkey = node where outgoing + incoming >= 3)
select subject, distance, case when distance > 0.85 then 'high' else 'medium' end as severity from far where distance >= 0.7""",
    "layer_violations": f"""with {EDGES}, ranked as (select p_partkey as node, {_LAYER} as layer from part)
select src, dst, {list(LAYERS)}[s.layer + 1] as from_layer, {list(LAYERS)}[t.layer + 1] as to_layer from edges join ranked s on s.node = src join ranked t on t.node = dst where t.layer < s.layer""",
    "feature_envy": """with e as (select o_custkey as subject, o_orderpriority as target, count(*) as n from orders group by 1, 2), p as (select *, round(n / sum(n) over (partition by subject), 6) as share from e)
select subject, target, n, share, case when share > 0.6 then 'high' else 'medium' end as severity from p where share >= 0.4 and n >= 3""",
    "mega_folders": """with e as (select lang as folder, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share from documents group by 1)
select *, case when share >= 0.5 or n >= 50 then 'high' else 'medium' end as severity from e where n >= 25 and share >= 0.25""",
    "repeated_literals": """with f as (select doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) as literal from documents)
select literal, count(*) as n, count(distinct doc_id) as n_docs, min(doc_id) as first_id, case when count(*) >= 8 then 'high' when count(*) >= 5 then 'medium' else 'low' end as severity from f group by 1 having count(*) >= 3""",
    "correlated_signals": f"""with {FINDINGS}, own as (select file, list_sort(list(distinct category)) as cats from findings group by 1)
select id, array_to_string(list_filter(cats, lambda c: c <> category)[1:8], ',') as signals from findings join own using (file)""",
    "category_scores": f"with {FINDINGS} select category, count(*) as n, count(distinct file) as files, floor(100 / (1 + count(*) / count(distinct file) / 10) + 0.5)::BIGINT as score from findings group by 1",
    "finding_numbers": f"with {FINDINGS} select 'AST-ISSUE-' || case when k < 1000 then lpad(k::VARCHAR, 4, '0') else k::VARCHAR end as issue, id, category, severity from (select *, row_number() over (order by r, category, id) as k from ranked)",
    "weighted_top": f"""with {DEGREES}, s as (select node, round(p_retailprice / 100 + 0.8::DOUBLE * incoming + 0.4::DOUBLE * outgoing, 4) as score from degrees join part on p_partkey = node order by 2 desc, 1 limit 20)
select *, case when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end as risk from s""",
    "path_glob": f"with {_PATHS} select * from paths where regexp_matches(path, '^[^/]*/(?:en|de)/[^/]*$')",
    "folder_counts": f"with {_PATHS} select array_to_string(string_split(path, '/')[1:2], '/') as folder, count(*) as n from paths group by 1",
    "row_page": "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20 offset 20",
    "page_links": r"""with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>(.*?)</a>', 1, 'si') as a, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>(.*?)</a>', 2, 'si') as b from pages),
i as (select page_id, generate_subscripts(a, 1) - 1 as k, unnest(a) as link, unnest(b) as title from l) select page_id, k::INT as k, link, title from i qualify row_number() over (partition by page_id, link order by k) = 1""",
    "presence_matrix": """with o as (select source as item, list(distinct lang) as have, min(n_chars) < max(n_chars) as conflict from documents group by 1)
select item, array_to_string(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: list_contains(have, x)), ',') as present_in, array_to_string(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: not list_contains(have, x)), ',') as missing_in, conflict from o""",
    "feed_freshness": """with e as (select event_type as feed, count(*) as entries, count(ts) as dated, count(*) - count(ts) as undated, count(*) filter (ts >= timestamp '2024-01-31 00:00:00' - interval 36 hours) as recent, max(ts) as newest from events group by 1)
select *, case when dated = 0 then 'undated' when recent > 0 then 'recent' else 'stale' end as mode from e""",
    "nearest_lines": f"""with {LINES}, h as (select doc_id, line as hint_line from lines where regexp_matches(content, '(?i)rights')), p as (select doc_id, line from lines where regexp_matches(content, '(?i)license'))
select doc_id, hint_line::INT as hint_line, line::INT as line from h join p using (doc_id) where abs(line - hint_line) <= 5 qualify row_number() over (partition by doc_id, hint_line order by abs(line - hint_line), line) = 1""",
    "section_of_line": f"with {LINES} select doc_id, line::INT as line, (max(case when regexp_matches(content, '\\.$') then line end) over (partition by doc_id order by line))::INT as section from lines",
    "numbered_lines": f"with {LINES} select doc_id, line::INT as line, line || ': ' || content as shown from lines",
    "suspicious_strings": """with s as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]{20,}')) as found from documents), c as (select doc_id, found, unnest(string_split(found, '')) as ch from s),
k as (select doc_id, found, ch, count(*) as n from c where ch <> '' group by all) select doc_id, found, round(sum(-(n / length(found)) * log2(n / length(found))), 4) as entropy from k group by 1, 2 having round(sum(-(n / length(found)) * log2(n / length(found))), 4) > 3.2""",
    "text_volume": f"with {_VOLUME} select doc_id, vocabulary, length, round(v, 3) as volume, round(h, 3) as difficulty, round(v * h, 1) as effort from vol",
    "text_maintainability": f"with {_VOLUME} select doc_id, round(greatest(0.0, (171 - 5.2::DOUBLE * ln(greatest(round(v, 3), 1.0)) - 0.23::DOUBLE * (q + 1) - 16.2::DOUBLE * ln(greatest(lines, 1))) * 100 / 171), 4) as score from vol",
    "cut_at_space": """with h as (select *, substr(text, 1, 80) as head, 80 - strpos(reverse(substr(text, 1, 80)), ' ') as blank from conversations)
select conv_id, turn, role, case when length(text) > 80 then (case when contains(head, ' ') and blank >= 48 then substr(head, 1, blank) else head end) || '...' else text end as shown from h""",
    "size_bytes": """with z as (select doc_id, n_chars * 37 as n from documents)
select doc_id, floor((case when n < 1024 then n::DOUBLE when n < 1048576 then floor(n / 1024.0 * 10 + 0.5) / 10 * 1024 else floor(n / 1048576.0 * 10 + 0.5) / 10 * 1048576 end) + 0.5)::BIGINT as bytes from z""",
    "minify_html": r"select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '[ \t\r\n]+', ' ', 'g'), '> <', '><', 'g'))) as minified_sha256 from pages",
}
