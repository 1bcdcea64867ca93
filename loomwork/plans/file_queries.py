"""Registered queries of files, patches, feeds, pages and code findings, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import minify
from loomwork.functions import paths as P
from loomwork.operators import code_findings as C
from loomwork.operators import detectors, feeds, files, paging, patches, search, shape, sinks
from loomwork.plans.inputs import DEGREES, EDGES, FINDINGS, LINES, documents, findings, first_order, part_graph
from loomwork.sources.tables import table

#: A path for each part, in the SQL that both engines read.
PATH = """case p_partkey % 7 when 0 then 'packages/alpha/src/' when 1 then 'packages/beta/src/internal/' when 2 then 'src/tests/' when 3 then 'node_modules/lib/'
 when 4 then 'packages/alpha/' when 5 then 'tools/' else 'packages/gamma/private/deep/' end ||
 case p_size % 8 when 0 then 'index' when 1 then 'main' when 2 then 'userProfile' when 3 then 'user_profile' when 4 then 'user-profile' when 5 then 'test_case' when 6 then 'conftest' else 'Read Me' end ||
 case p_partkey % 5 when 0 then '.ts' when 1 then '.test.ts' when 2 then '.py' when 3 then '.config.js' else '.min.css' end"""
#: Fixed names that lists of files leave out.
IGNORED = {"endings": (".min.js", ".min.css", ".map", ".lock"), "names": ("package-lock.json", "conftest.py"), "folders": ("node_modules", "dist", "build", ".git", "private")}

FEED = """'<rss><channel><title>feed</title><item><title>A &amp; ' || substr(url, 8, 5) || '</title><link rel="self" href="http://self/' || page_id || '"/><link href="' || url || '"/>
<pubDate>Tue, 0' || (page_id % 9 + 1) || ' Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[<b>one</b>  two ' || page_id || ']]></description></item>
<item><title></title><link>http://none</link></item><entry><title>B' || page_id || '</title><link>http://plain/' || page_id || '</link><updated>2024-02-1' || (page_id % 9) || 'T00:00:00Z</updated><summary>s</summary></entry>
<item ><title>C</title><guid>' || case when page_id % 2 = 0 then 'http://guid/' else 'tag:' end || page_id || '</guid><pubDate>soon</pubDate></item></channel></rss>'"""


def _files(s, d):
    """``node, path, size, type, modified`` of the parts as files."""
    t = table(s, d, "part")
    return t.select(F.col("p_partkey").alias("node"), F.expr(PATH).alias("path"), (F.col("p_size") * 997).cast("long").alias("size"), F.when(F.col("p_size") % 10 == 0, "dir").otherwise("file").alias("type"), F.col("p_retailprice").alias("modified"))


def _patches(s, d):
    line = F.transform(F.split("text", "\n"), lambda x, k: F.concat(
        F.when(k % 8 == 0, F.concat(F.lit("@@ -"), k + 1, F.lit(",3 +"), k + 3, F.lit(",4 @@ "))).when(k % 8 == 1, "-").when(k % 8 == 2, "+").when(k % 8 == 3, "+++").when(k % 8 == 4, " ").when(k % 8 == 5, "@@ odd ").when(k % 8 == 6, "\\ ").otherwise("="), x))
    return documents(s, d).select(F.col("doc_id").alias("id"), F.array_join(line, "\n").alias("patch"))


def _diffs(s, d):
    part = lambda a, b: F.concat(F.lit("diff --git a/"), F.col(a), F.lit(" b/"), F.col(b), F.lit("\n@@ -1 +1 @@\n-"), F.col("lang"), F.lit("\n+"), F.col("source"))
    return documents(s, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("note\n"), part("lang", "source"), F.lit("\n"), part("source", "source")).alias("diff"))


def _feeds(s, d):
    return table(s, d, "pages").select(F.col("page_id").alias("feed"), F.lit("http://feed").alias("url"), F.expr(FEED).alias("xml"))


def _requests(s, d):
    """Orders as requests, with their lines as files."""
    own = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))).alias("files"))
    o = table(s, d, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate")).alias("merged_at"), "files")


def _exports(s, d):
    t = table(s, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("module"), F.col("l_partkey").cast("string").alias("name"), F.when(F.col("l_partkey") % 3 == 0, "type").otherwise("value").alias("kind")).distinct()


def _uses(s, d, flag):
    star = F.when(F.col("l_orderkey") % 97 == 0, "*").otherwise(F.col("l_partkey").cast("string"))
    return table(s, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("module"), star.alias("name"))


def _passed(s, d):
    t = table(s, d, "lineitem").where("l_linenumber <= 2")
    return t.select(F.col("l_suppkey").alias("module"), F.when(F.col("l_partkey") % 11 == 0, "*").otherwise(F.col("l_partkey").cast("string")).alias("name"), F.col("l_linestatus").alias("source"))


def _bodies(s, d):
    t = table(s, d, "lineitem").where("l_quantity >= 6").groupBy("l_orderkey").agg(F.max("l_quantity").cast("long").alias("statements"), F.count(F.lit(1)).alias("calls"), F.max("l_linenumber").cast("long").alias("loops"), F.max((F.col("l_tax") * 100).cast("long")).alias("returns"))
    return t.select(F.col("l_orderkey").alias("id"), F.expr("'k' || l_orderkey % 400").alias("kind"), (F.col("l_orderkey") % 1000).alias("hash"), "statements", "calls", "loops", "returns")


def _pillared(s, d):
    return findings(s, d).withColumnRenamed("category", "pillar")


def _titled(s, d):
    line = F.when(F.col("id") % 3 > 0, (F.col("id") % 90).cast("int"))
    return findings(s, d).select("id", "severity", F.concat(F.lit("src/"), F.col("file").cast("string"), F.lit(".ts")).alias("file"), "category", line.alias("line"), F.concat(F.lit("found "), F.col("id")).alias("title"))


def _hot(s, d, most):
    t = table(s, d, "part").select(F.col("p_partkey").alias("node"), F.expr(PATH).alias("path"), F.col("p_size").alias("complexity"), (F.col("p_partkey") % 4).alias("exports"))
    return C.hot_files(t, part_graph(s, d)[1], first_order(s, d), most)


def _imports(s, d):
    t = table(s, d, "part")
    spec = F.expr("case p_partkey % 6 when 0 then './index' when 1 then '../user_profile.js' when 2 then '../../alpha/src/main' when 3 then 'react' when 4 then './userProfile.test.ts' else '../../../../../x' end")
    return t.select(F.col("p_partkey").alias("id"), F.expr(PATH).alias("file"), spec.alias("specifier"))


def _items(s, d):
    t = table(s, d, "part")
    return t.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", F.split("p_name", " ").alias("tags"))


def _path_facts(s, d):
    p = F.col("path")
    stem = F.regexp_replace(P.name_of(p), r"\..*$", "")
    return _files(s, d).select(
        "node", P.name_of(p).alias("name"), P.folder_of(p).alias("folder"), P.extension(p).alias("extension"), P.is_test(p).alias("test"), P.is_entry_point(p).alias("entry"), P.is_ignored(p, **IGNORED).alias("ignored"), P.package_of(p).alias("package"), P.name_style(stem).alias("style"),
        P.snake_case(stem).alias("snake"), P.pascal_case(stem).alias("pascal"), P.permissions(F.col("size") % 512).alias("mode"), P.short_hash(p).alias("hash"), P.cache_key("file", ("path", p), ("size", F.col("size"))).alias("cache"),
        P.size_with_space(F.col("size")).alias("shown_size"), P.size_with_space(F.col("size") * 40000, giga=True).alias("giga"), P.shown_path(p, "packages/alpha", "tools").alias("shown"),
    )


QUERIES = {
    "path_facts": _path_facts,
    "entry_filters": lambda s, d: files.entries(_files(s, d), pattern="user[!_]*", extensions=("ts", "py")).select("node", "path", "type"),
    "find_files": lambda s, d: files.found_files(_files(s, d), least_depth=1, most_depth=3, names=("*.ts", "main"), regex="(alpha|beta).*", larger=2000, smaller=45000, pruned=("internal",)).select("node", "path", "size"),
    "entry_shapes": lambda s, d: files.shown_entries(_files(s, d)).groupBy("path", "name", "type", "depth").agg(F.count(F.lit(1)).alias("n")),
    "files_by_size": lambda s, d: files.sorted_files(_files(s, d).select("node", "path", "size"), "size", 40).select("path", "size"),
    "files_by_kind": lambda s, d: files.sorted_files(_files(s, d).select("path", "type"), "kind", 30),
    "kept_structure": lambda s, d: files.structure(files.without_ignored(_files(s, d), **IGNORED)),
    "path_suggestions": lambda s, d: files.suggestions(_files(s, d).select("path").distinct(), _files(s, d).select(F.regexp_replace("path", r"\.[a-z]+$", ".tsx").alias("ask")).distinct()),
    "catalogue_search": lambda s, d: files.catalogue_search(_items(s, d), "Red", ("p_brand",), "tags").select("id", "p_name"),
    "tag_counts": lambda s, d: files.tag_counts(_items(s, d), "tags"),
    "right_wins": lambda s, d: files.right_wins(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))),
    "resolved_imports": lambda s, d: files.resolved(_imports(s, d), _files(s, d)),
    "patch_lines": lambda s, d: patches.patch_lines(_patches(s, d)),
    "chosen_patch_lines": lambda s, d: patches.chosen_lines(_patches(s, d), [3, 4, 11, 12], []).select("id", F.sha2(F.col("shown").cast("binary"), 256).alias("shown_sha256"), F.char_length("shown").cast("long").alias("n")),
    "patch_changes": lambda s, d: _patches(s, d).select("id", patches.line_changes(F.col("patch")).alias("c")).select("id", "c.*"),
    "patches_by_file": lambda s, d: patches.by_file(_diffs(s, d)),
    "merge_states": lambda s, d: patches.merge_state(_requests(s, d)),
    "shown_bodies": lambda s, d: documents(s, d).select("doc_id", patches.shown_body(F.col("text"), F.col("doc_id"), patches.body_limit(4)).alias("b")).select("doc_id", F.sha2(F.col("b").cast("binary"), 256).alias("body_sha256"), F.char_length("b").cast("long").alias("n")),
    "feed_items": lambda s, d: feeds.feed_items(_feeds(s, d)),
    "newest_items": lambda s, d: feeds.newest(feeds.feed_items(_feeds(s, d)), 25).select("feed", "k", "day"),
    "section_counts": lambda s, d: feeds.section_counts(table(s, d, "events").select(F.col("event_type").alias("section"), F.col("user_id").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("heat"))),
    "line_page": lambda s, d: documents(s, d).select("doc_id", paging.line_page(F.col("text"), 150, 400).alias("p")).select("doc_id", F.sha2(F.col("p.shown").cast("binary"), 256).alias("shown_sha256"), "p.start", "p.next", "p.lines"),
    "size_page": lambda s, d: paging.size_page(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", F.coalesce(F.char_length("text"), F.lit(0)), 200, 500).select("conv_id", "turn", "before"),
    "limited_texts": lambda s, d: documents(s, d).select("doc_id", F.char_length(paging.limited(F.col("text"), most=500, page=400)).cast("long").alias("n")),
    "first_match_context": lambda s, d: paging.first_match_context(documents(s, d), "rights", 2),
    "byte_offsets": lambda s, d: documents(s, d).select("doc_id", P.byte_of_char(F.col("text"), F.lit(60)).alias("bytes"), P.char_of_byte(F.col("text"), P.byte_of_char(F.col("text"), F.lit(60)).cast("int")).alias("chars")),
    "test_only_files": lambda s, d: C.test_only(_files(s, d), part_graph(s, d)[1].where("src % 7 = 2")),
    "dead_files": lambda s, d: C.dead_files(_files(s, d), part_graph(s, d)[1].where("src % 3 = 0 and dst % 3 = 0")),
    "god_modules": lambda s, d: C.god_modules(_files(s, d), part_graph(s, d)[1]),
    "boundary_violations": lambda s, d: C.boundary_violations(_files(s, d), part_graph(s, d)[1]),
    "package_chatter": lambda s, d: C.package_chatter(_files(s, d), part_graph(s, d)[1]),
    "cycle_clusters": lambda s, d: C.cycle_clusters(*part_graph(s, d)),
    "hot_files": lambda s, d: _hot(s, d, 20),
    "untested_critical": lambda s, d: C.untested_critical(_hot(s, d, 500), _files(s, d), part_graph(s, d)[1].where("src % 7 = 2")),
    "dead_exports": lambda s, d: C.dead_exports(_exports(s, d), _uses(s, d, "A"), _uses(s, d, "R")),
    "re_exports": lambda s, d: C.re_exports(_passed(s, d), _uses(s, d, "A"), _exports(s, d).where("kind = 'type'")),
    "similar_bodies": lambda s, d: C.similar_bodies(_bodies(s, d), ("statements", "calls", "loops", "returns")),
    "scoped_findings": lambda s, d: C.scoped(_files(s, d).select("node", F.col("path").alias("file"), F.array("path", F.when(F.col("node") % 5 == 0, "packages/beta/src/x.ts").otherwise("README")).alias("files")), "packages/beta/src").select("node", "file"),
    "issue_ids": lambda s, d: C.with_issue_ids(table(s, d, "customer").select(F.col("c_custkey").alias("file")), findings(s, d)).select("file", F.array_join(F.transform("issues", lambda x: x.cast("string")), ",").alias("issues")),
    "finding_pressure": lambda s, d: C.pressure(findings(s, d), 50).select(F.round("pressure", 6).alias("pressure")),
    "severity_matrix": lambda s, d: C.severity_matrix(_pillared(s, d)),
    "pillar_scores": lambda s, d: C.pillar_scores(_pillared(s, d), 80),
    "minified_texts": lambda s, d: documents(s, d).select("doc_id", *[F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("conservative", minify.conservative(F.col("text"), "hash")), ("aggressive", minify.aggressive(F.col("text"), "html")), ("general", minify.general(F.col("text"))), ("markdown", minify.markdown(F.col("text"))))]),
    "compact_findings": lambda s, d: _titled(s, d).select("id", sinks.compact_line().alias("line")),
    "build_annotations": lambda s, d: _titled(s, d).select("id", sinks.annotation().alias("note")),
    "edge_lines": lambda s, d: sinks.edge_lines(part_graph(s, d)[1]),
    "lines_without_digits": lambda s, d: search.matching(documents(s, d), "[0-9]", regex=True, invert=True),
    "far_from_main_sequence": lambda s, d: detectors.off_main_sequence(*part_graph(s, d), table(s, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("share")), 0.3, 0.45),
    "nearest_license_lines": lambda s, d: shape.nearest_lines(documents(s, d), "the", "license"),
    "soft_penalties": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.soft_penalty(F.col("l_quantity") / 50, 40).alias("penalty"), C.grade(F.col("l_quantity") * 2).alias("grade"), C.confidence(F.col("l_quantity")).alias("confidence")),
}

_FILES = f"files as (select p_partkey as node, {PATH} as path, (p_size * 997)::BIGINT as size, case when p_size % 10 = 0 then 'dir' else 'file' end as type, p_retailprice as modified, p_size, p_partkey from part)"
_NAMED = rf"named as (select *, list_last(string_split(path, '/')) as name, regexp_replace(path, '/?[^/]*$', '') as folder, list_extract(string_split(list_last(string_split(path, '/')), '.'), 1) as stem, string_split(path, '/') as parts from files)"
_TEST = r"(regexp_matches({0}, '(?:^|[\\/])(?:__tests__|__test__|tests)(?:[\\/]|$)') or regexp_matches({0}, '(?:\.test|_test|\.spec)\.(?:ts|tsx|js|jsx|mjs|cjs)$') or regexp_matches({0}, '(?:^|[\\/])test_[^/\\]*\.py$') or regexp_matches({0}, '_test\.py$') or regexp_matches({0}, '(?:^|[\\/])conftest\.py$'))"
_ENTRY = r"(regexp_matches(lower({0}), '(^|/)(index|main|app|server|cli|public)\.[mc]?[jt]sx?$') or regexp_matches(lower({0}), '\.(config)\.[mc]?[jt]sx?$'))"
_IGNORED = "(name like '%.min.js' or name like '%.min.css' or name like '%.map' or name like '%.lock' or name in ('package-lock.json', 'conftest.py') or list_has_any(parts, ['node_modules', 'dist', 'build', '.git', 'private']))"
_PACKAGE = "case when {0} like 'packages/%' then array_to_string(string_split({0}, '/')[1:2], '/') else string_split({0}, '/')[1] end"
_PATCHES = r"""plines as (select doc_id as id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents),
marked as (select id, k::INT as at, case k % 8 when 0 then '@@ -' || (k + 1) || ',3 +' || (k + 3) || ',4 @@ ' when 1 then '-' when 2 then '+' when 3 then '+++' when 4 then ' ' when 5 then '@@ odd ' when 6 then '\ ' else '=' end || x as content from plines),
hunks as (select *, content like '@@%' as head, regexp_matches(content, '^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@') as opens from marked),
numbered as (select *, count(*) filter (opens) over (partition by id order by "at") as hunk, case when head then 'head' when content like '+%' then 'addition' when content like '-%' then 'deletion' when starts_with(content, '\') then 'note' else 'context' end as kind from hunks),
started as (select *, max(case when opens then regexp_extract(content, '^@@ -(\d+)', 1)::BIGINT end) over (partition by id, hunk) as o, max(case when opens then regexp_extract(content, '\+(\d+)', 1)::BIGINT end) over (partition by id, hunk) as n from numbered),
counted as (select id, "at", kind, content, case when kind in ('context', 'deletion') then coalesce(o - 1, 0) + count(*) filter (kind in ('context', 'deletion')) over (partition by id, hunk order by "at") end as old_line,
 case when kind in ('context', 'addition') then coalesce(n - 1, 0) + count(*) filter (kind in ('context', 'addition')) over (partition by id, hunk order by "at") end as new_line from started)"""
_ITEMS = r"""entries as (select page_id as feed, url, 0 as k, 'A & ' || substr(url, 8, 5) as title, url as link, make_timestamp(2024, 1, page_id % 9 + 1, 10, 0, 0) as ts, 'one two ' || page_id as description from pages
 union all select page_id, url, 2, 'B' || page_id, 'http://plain/' || page_id, make_timestamp(2024, 2, 10 + page_id % 9, 0, 0, 0), 's' from pages
 union all select page_id, url, 3, 'C', case when page_id % 2 = 0 then 'http://guid/' || page_id else 'http://feed' end, null, '' from pages)"""
_SIZE = "case when {0} < 1024 then {0} || ' B' when {0} < 1048576 then printf('%.1f KB', {0} / 1024.0) else printf('%.1f MB', {0} / 1048576.0) end"
_CYCLES = f"with recursive {EDGES}, walk as (select src, dst from edges union select walk.src, edges.dst from walk join edges on walk.dst = edges.src), " + """
comp as (select p_partkey as node, least(p_partkey, coalesce(min(a.dst), p_partkey)) as component from part left join (select w.src, w.dst from walk w join walk b on w.src = b.dst and w.dst = b.src) a on a.src = p_partkey group by p_partkey),
groups as (select component, count(*) as n from comp group by 1 having count(*) > 1), pairs as (select s.component as a, t.component as b from edges join comp s on s.node = src join comp t on t.node = dst)
select component, n, (select count(*) from pairs where a = b and a = component) as inner, (select count(*) from pairs where a <> b and b = component) as entering, (select count(*) from pairs where a <> b and a = component) as leaving from groups"""
_HOT = f"hot as (select node, floor(3 * incoming + 0.5 * p_size + 1.5 * (p_partkey % 4) + 0.5 * outgoing + case when node in (select l_partkey from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)) then 20 else 0 end + 0.5)::BIGINT as risk, incoming, outgoing, node in (select l_partkey from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)) as in_cycle from degrees join files using (node) where not {_TEST.format('path')} and risk > 0)"
_EXPORTS = "exports as (select distinct l_suppkey as module, l_partkey::VARCHAR as name, case when l_partkey % 3 = 0 then 'type' else 'value' end as kind from lineitem)"
_USES = "{1} as (select l_suppkey as module, case when l_orderkey % 97 = 0 then '*' else l_partkey::VARCHAR end as name from lineitem where l_returnflag = '{0}')"

def _replaced(text, *steps):
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


_TRIM, _ENDS, _GAPS = (r"^\s+|\s+$", "''"), (r"(?m)[ \t]+$", "''"), (r"\n\s*\n\s*\n+", "chr(10) || chr(10)")
_MINIFIED = {
    "conservative": _replaced("text", (r"(?m)^\s*#(?:[^!\n].*)?$", "''"), (r"(?m)\s+#.*$", "''"), _ENDS, _GAPS, _TRIM),
    "aggressive": _replaced("text", (r"(?s)<!--.*?-->", "''"), (r"\s+", "' '"), (r"\s*([{}:;,])\s*", r"'\1'"), (r">\s+<", "'><'"), _TRIM),
    "general": _replaced("text", _ENDS, (r"\r\n", "chr(10)"), _GAPS, (r"[ \t]{3,}", "' '"), _TRIM),
    "markdown": _replaced("text", (r"(?s)<!--.*?-->", "''"), _ENDS, (r"\r\n", "chr(10)"), _GAPS, (r"([^\n])[ \t]{5,}([^\n])", r"'\1 \2'"), (r"\s*\|\s*", "' | '"), (r"(?m)^(#{1,6})[ \t]+", r"'\1 '"), (r"(?m)^(\s*)([-*+]|\d+\.)[ \t]+", r"'\1\2 '"), (r"\n{3,}(```)", r"chr(10) || chr(10) || '\1'"), (r"(```)\n{3,}", r"'\1' || chr(10) || chr(10)"), _TRIM),
}

ORACLE_SQL = {
    "minified_texts": "select doc_id, " + ", ".join(f"sha256({c}) as {n}" for n, c in _MINIFIED.items()) + " from documents",
    "path_facts": rf"""with {_FILES}, {_NAMED}
select node, name, folder, list_last(string_split(path, '.')) as extension, {_TEST.format("path")} as test, {_ENTRY.format("path")} as entry, {_IGNORED} as ignored, {_PACKAGE.format("path")} as package,
 case p_size % 8 when 2 then 'camel' when 3 then 'snake' when 4 then 'kebab' when 5 then 'snake' when 7 then 'other' else 'flat' end as style, lower(regexp_replace(regexp_replace(stem, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-\s]+', '_', 'g')) as snake,
 array_to_string(list_transform(string_split(stem, '_'), lambda w: upper(w[1]) || w[2:]), '') as pascal,
 array_to_string(list_transform([6, 3, 0], lambda b: ['---', '--x', '-w-', '-wx', 'r--', 'r-x', 'rw-', 'rwx'][(((size % 512) >> b) & 7) + 1]), '') as mode,
 sha1(path)[1:16] as hash, 'v1-file:' || sha256('{{"path":"' || path || '","size":"' || size || '"}}') as cache, {_SIZE.format("size")} as shown_size,
 case when size * 40000 < 1073741824 then {_SIZE.format("(size * 40000)")} else printf('%.2f GB', size * 40000 / 1073741824.0) end as giga,
 case when starts_with(path, 'packages/alpha/') then path[16:] when starts_with(path, 'tools/') then '~/' || path[7:] else name end as shown from named""",
    "entry_filters": rf"with {_FILES}, {_NAMED} select node, path, type from named where regexp_matches(name, '^user[^_].*$', 'i') and (type = 'dir' or list_last(string_split(path, '.')) in ('ts', 'py'))",
    "find_files": rf"""with {_FILES}, {_NAMED} select node, path, size from named where len(parts) - 1 between 1 and 3 and (regexp_matches(name, '(?i)^.*\.ts$') or regexp_matches(name, '(?i)^main.*$'))
 and regexp_matches(path, '^.*(alpha|beta).*$') and size > 2000 and size < 45000 and not list_contains(parts[1:len(parts) - 1], 'internal')""",
    "entry_shapes": f"with {_FILES}, {_NAMED} select path, name || case when type = 'dir' then '/' else '' end as name, type, (len(parts) - 1)::INT as depth, count(*) as n from named group by all",
    "files_by_size": f"with {_FILES} select path, size from files order by size desc, path limit 40",
    "files_by_kind": f"with {_FILES} select path, type from files order by type = 'dir' desc, path limit 30",
    "kept_structure": f"""with {_FILES}, {_NAMED}, kept as (select * from named where not {_IGNORED}), a as (select folder, name, false as sub from kept), above as (select distinct unnest(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/'))) as f from kept),
b as (select regexp_replace(f, '/?[^/]*$', '') as folder, list_last(string_split(f, '/')) as name, true as sub from above), c as (select * from a union all select * from b)
select folder, coalesce(array_to_string(list_sort(list(distinct name) filter (not sub)), ','), '') as files, coalesce(array_to_string(list_sort(list(distinct name) filter (sub)), ','), '') as folders from c group by 1""",
    "path_suggestions": rf"""with {_FILES}, {_NAMED}, have as (select distinct path, folder, name from named), asks as (select distinct regexp_replace(path, '\.[a-z]+$', '.tsx') as ask from files), want as (select ask, regexp_replace(ask, '/?[^/]*$', '') as folder, list_last(string_split(ask, '/')) as wanted from asks)
select ask, row_number() over (partition by ask order by lower(name) = lower(wanted) desc, path)::INT as k, path from want join have using (folder) where path <> ask and (lower(name) = lower(wanted) or starts_with(name, regexp_replace(wanted, '\.[^/.]+$', '') || '.')) qualify row_number() over (partition by ask order by lower(name) = lower(wanted) desc, path) <= 3""",
    "catalogue_search": "select p_partkey as id, p_name from part where len(list_filter(string_split(p_name, ' '), lambda t: contains(lower(t), 'red'))) > 0 or contains(lower(p_brand), 'red')",
    "tag_counts": "select unnest(string_split(p_name, ' ')) as tag, count(*) as n from part group by 1",
    "right_wins": "select c_custkey as key, c_mktsegment as value from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, s_name from supplier",
    "resolved_imports": rf"""with recursive {_FILES}, imports as (select node as id, case node % 6 when 0 then './index' when 1 then '../user_profile.js' when 2 then '../../alpha/src/main' when 3 then 'react' when 4 then './userProfile.test.ts' else '../../../../../x' end as spec, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') as dir from files),
ups as (select id, spec, dir, len(regexp_extract_all(spec, '\.\.')) as up from imports where starts_with(spec, '.')), bases as (select id, array_to_string(list_concat(dir[1:len(dir) - up], string_split(regexp_replace(spec, '^(\.\.?/)+', ''), '/')), '/') as base from ups where up <= len(dir)),
tries as (select id, base || e as path, k from bases, (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.mjs', 5), ('.cjs', 6), ('/index.ts', 7), ('/index.tsx', 8), ('/index.js', 9), ('/index.jsx', 10)) v(e, k) union all select id, regexp_replace(base, '\.js$', '.ts'), 11 from bases),
hits as (select id, arg_min(path, k) as target from tries where path in (select path from files) group by 1) select imports.id, target from imports left join hits using (id)""",
    "patch_lines": f"with {_PATCHES} select id, \"at\", kind, old_line, new_line, content from counted where kind in ('context', 'addition', 'deletion')",
    "chosen_patch_lines": f"""with {_PATCHES}, shown as (select id, string_agg(case kind when 'addition' then '+' || new_line when 'deletion' then '-' || old_line else ' ' || new_line end || ': ' || content[2:], chr(10) order by "at") as s from counted where kind = 'addition' and new_line in (3, 4, 11, 12) or kind = 'context' group by 1)
select doc_id as id, sha256(coalesce(s, '')) as shown_sha256, length(coalesce(s, '')) as n from documents left join shown on id = doc_id""",
    "patch_changes": f"with {_PATCHES} select doc_id as id, count(*) filter (content like '+%' and content not like '+++%') as additions, count(*) filter (content like '-%' and content not like '---%') as deletions from documents left join marked on id = doc_id group by 1",
    "patches_by_file": r"""with p as (select doc_id as id, lang, source, 'diff --git a/' || source || ' b/' || source || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || lang || chr(10) || '+' || source as two, 'diff --git a/' || lang || ' b/' || source || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || lang || chr(10) || '+' || source as one from documents)
select id, source as path, two as patch from p where two is not null and one is not null union all select id, lang, one from p where lang <> source""",
    "merge_states": """select o_orderkey as id, o_orderstatus = 'F' and o_totalprice > 100000 and o_orderdate is not null as merged, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT as additions, coalesce(sum(l_linenumber), 0)::BIGINT as deletions, count(l_orderkey) as changed_files
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus, o_totalprice, o_orderdate""",
    "shown_bodies": """with b as (select doc_id, case when length(text) > 800 then text[1:800] || '... [truncated ' || (length(text) - 800) || ' chars, use type=''fullContent'' or prNumber=' || doc_id || ' for complete body]' else text end as b from documents) select doc_id, sha256(b) as body_sha256, length(b) as n from b""",
    "feed_items": f"with {_ITEMS} select feed, k::INT as k, title, link, ts, coalesce(strftime(ts, '%Y-%m-%d'), '') as day, coalesce(strftime(ts, '%b %-d'), '') as shown, description from entries",
    "newest_items": f"with {_ITEMS} select feed, k::INT as k, coalesce(strftime(ts, '%Y-%m-%d'), '') as day from entries order by ts desc nulls last, feed, entries.k limit 25",
    "section_counts": "select event_type as section, count(*) as n, count(distinct user_id) as sources, max(strftime(ts, '%Y-%m-%d')) as newest, count(*) filter (value >= 70) as important from events group by 1",
    "line_page": """with t as (select doc_id, text, length(text) as total, length(text[1:150]) - length(list_last(string_split(text[1:150], chr(10)))) as s0 from documents where text is not null), e as (select *, least(s0 + 400, total) as e0 from t),
f as (select *, case when total <= 150 and total > 0 then total else s0 end as start, case when e0 = total or text[e0:e0] = chr(10) then e0 else least(e0 + length(string_split(text[e0 + 1:], chr(10))[1]) + 1, total) end as stop from e),
g as (select *, case when total <= 150 and total > 0 then '' else text[s0 + 1:stop] end as shown, case when total <= 150 and total > 0 then total when stop < total then stop end as nxt from f)
select doc_id, case when g.doc_id is null then null else sha256(shown) end as shown_sha256, start, nxt as next, length(shown) - length(replace(shown, chr(10), '')) as lines from documents left join g using (doc_id)""",
    "size_page": """with b as (select conv_id, turn, coalesce(length(text), 0) as size, (coalesce(sum(coalesce(length(text), 0) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 1)::BIGINT as before from conversations)
select conv_id, turn, before from b where before < 700 and before + size > 200""",
    "limited_texts": "select doc_id, case when length(text) > 500 then 400 else length(text) end as n from documents",
    "first_match_context": """with l as (select doc_id, string_split(text, chr(10)) as lines from documents), k as (select *, list_position(list_transform(lines, lambda x: contains(x, 'rights')), true) as p from l)
select doc_id, greatest(p - 2, 1)::BIGINT as start, least(p + 2, len(lines))::BIGINT as stop, array_to_string(lines[greatest(p - 2, 1):least(p + 2, len(lines))], chr(10)) as shown from k where p > 0""",
    "byte_offsets": "select doc_id, strlen(text[1:60]) as bytes, length(text[1:60]) as chars from documents",
    "test_only_files": f"with {EDGES}, {_FILES}, e as (select * from edges where src % 7 = 2), i as (select dst, count(*) filter (not {_TEST.format('path')}) as p, count(*) filter ({_TEST.format('path')}) as t from e join files on node = src group by 1) select node, path, 'medium' as severity from files join i on dst = node where not {_TEST.format('path')} and p = 0 and t > 0",
    "dead_files": f"with {EDGES}, {_FILES}, e as (select * from edges where src % 3 = 0 and dst % 3 = 0) select node, path from files where node not in (select src from e) and node not in (select dst from e) and not {_TEST.format('path')} and not {_ENTRY.format('path')}",
    "god_modules": f"""with {DEGREES}, {_FILES}, d as (select node, incoming, outgoing from degrees join files using (node) where not {_TEST.format("path")})
select node, 'incoming' as side, incoming as n, case when incoming > 30 then 'high' else 'medium' end as severity from d where incoming > 20 union all select node, 'outgoing', outgoing, case when outgoing > 22.5 then 'high' else 'medium' end from d where outgoing > 15""",
    "boundary_violations": rf"""with {EDGES}, {_FILES}, p as (select e.src, e.dst, s.path as a, t.path as b from edges e join files s on s.node = src join files t on t.node = dst)
select src, dst, case when contains(b, '/internal/') or contains(b, '/private/') then 'high' else 'medium' end as severity from p where not {_TEST.format("a")} and a like 'packages/%' and b like 'packages/%' and string_split(a, '/')[2] <> string_split(b, '/')[2] and not regexp_matches(b, '^packages/[^/]+/(src/)?index\.[mc]?[jt]sx?$')""",
    "package_chatter": f"with {EDGES}, {_FILES}, g as (select node, {_PACKAGE.format('path')} as grp from files) select s.grp as src_group, t.grp as dst_group, count(*) as weight from edges join g s on s.node = src join g t on t.node = dst where s.grp <> t.grp group by 1, 2 having count(*) >= 4",
    "cycle_clusters": _CYCLES,
    "hot_files": f"with {DEGREES}, {_FILES}, {_HOT} select * from hot order by risk desc, node limit 20",
    "untested_critical": f"""with {DEGREES}, {_FILES}, {_HOT}, top as (select * from hot order by risk desc, node limit 500), covered as (select dst from edges join files on node = src where src % 7 = 2 and {_TEST.format("path")})
select node, risk, case when risk >= 60 then 'critical' else 'high' end as severity from top where node not in (select dst from covered) order by risk desc, node limit 25""",
    "dead_exports": f"""with {_EXPORTS}, {_USES.format("A", "uses")}, {_USES.format("R", "tests")}, stars as (select distinct module from uses where name = '*'), tstars as (select distinct module from tests where name = '*')
select module, name, case when kind = 'type' then 'medium' else 'high' end as severity, (module in (select module from tstars) or (module, name) in (select (module, name) from tests)) as test_use from exports where module not in (select module from stars) and (module, name) not in (select (module, name) from uses)""",
    "re_exports": f"""with {_EXPORTS}, {_USES.format("A", "uses")}, passed as (select l_suppkey as module, case when l_partkey % 11 = 0 then '*' else l_partkey::VARCHAR end as name, l_linestatus as source from lineitem where l_linenumber <= 2), names as (select distinct module, name from passed)
select module, name, 'dead' as problem from names where case when name = '*' then module not in (select module from uses) else (module, name) not in (select (module, name) from uses) end
union all select module, name, 'duplication' from passed where name <> '*' group by 1, 2 having count(distinct source) > 1
union all select module, name, 'shadowed' from names where name <> '*' and (module, name) in (select (module, name) from exports where kind = 'type')""",
    "similar_bodies": """with m as (select l_orderkey as id, max(l_quantity)::BIGINT as s, count(*) as c, max(l_linenumber) as l, max((l_tax * 100)::DECIMAL(9, 4)::DOUBLE) as r0, max(floor(l_tax * 100)::BIGINT) as r from lineitem where l_quantity >= 6 group by 1), b as (select id, 'k' || (id % 400) as kind, id % 1000 as hash, floor(s / 3.0 + 0.5) as bucket, s, c, l, r from m),
f as (select *, count(*) over (partition by kind, bucket) as n from b), p as (select a.id as a, b.id as b, round(((1 - abs(a.s - b.s) / greatest(a.s, b.s, 1)) + (1 - abs(a.c - b.c) / greatest(a.c, b.c, 1)) + (1 - abs(a.l - b.l) / greatest(a.l, b.l, 1)) + (1 - abs(a.r - b.r) / greatest(a.r, b.r, 1))) / 4, 6) as similarity
from f a join f b on a.kind = b.kind and a.bucket = b.bucket and a.id < b.id and a.hash <> b.hash and least(a.s, b.s) >= 0.8 * greatest(a.s, b.s) where a.n between 2 and 50) select *, case when similarity >= 0.95 then 'high' else 'medium' end as severity from p where similarity >= 0.85""",
    "scoped_findings": f"with {_FILES} select node, path as file from files where starts_with(path, 'packages/beta/src/') or node % 5 = 0",
    "issue_ids": f"with {FINDINGS} select c_custkey as file, coalesce(string_agg(id, ',' order by id), '') as issues from customer left join findings on file = c_custkey group by 1",
    "finding_pressure": f"with {FINDINGS} select round(sum(case severity when 'critical' then 1.0::DOUBLE when 'high' then 0.75::DOUBLE when 'medium' then 0.45::DOUBLE when 'low' then 0.2::DOUBLE else 0.05::DOUBLE end) / 50, 6) as pressure from findings",
    "severity_matrix": f"""with {FINDINGS} select case when grouping(category) = 1 then 'all' else category end as pillar, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low, count(*) filter (severity = 'info') as info, count(*) as total from findings group by rollup(category)""",
    "pillar_scores": f"""with {FINDINGS}, s as (select category as pillar, sum(case severity when 'critical' then 25 when 'high' then 10 when 'medium' then 3 when 'low' then 1 else 0 end) as p, min(r) as worst, greatest(8, least(80, count(distinct file))) as files from ranked group by 1),
z as (select pillar, files, least(floor(100 / (1 + p / files / 10) + 0.5), case worst when 0 then 95 when 1 then 98 else 99 end)::BIGINT as score from s) select *, case when score >= 80 then 'A' when score >= 60 then 'B' when score >= 40 then 'C' when score >= 20 then 'D' else 'F' end as grade from z""",
    "compact_findings": f"with {FINDINGS} select id, severity || ':src/' || file || '.ts' || case when id % 3 > 0 then ':' || (id % 90) else '' end || ' - [' || category || '] found ' || id as line from findings",
    "build_annotations": f"""with {FINDINGS} select id, '::' || case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' when severity = 'low' then 'notice' else 'warning' end || ' file=src/' || file || '.ts,line=' || case when id % 3 > 0 then id % 90 else 1 end || '::found ' || id || ' [' || category || ']' as note from findings""",
    "edge_lines": f"""with {EDGES} select '  n' || sha1(src::VARCHAR)[1:8] || '["' || src || '"] --> n' || sha1(dst::VARCHAR)[1:8] || '["' || dst || '"]' as line from edges""",
    "lines_without_digits": f"with {LINES} select doc_id, line::INT as line, content from lines where not regexp_matches(content, '[0-9]')",
    "far_from_main_sequence": f"""with {DEGREES}, far as (select node as subject, round(abs(p_size / 50.0 + outgoing / (outgoing + incoming) - 1), 6) as distance from degrees join part on p_partkey = node where outgoing + incoming >= 3)
select subject, distance, case when distance > 0.45 then 'high' else 'medium' end as severity from far where distance >= 0.3""",
    "nearest_license_lines": f"""with {LINES}, h as (select doc_id, line as hint_line from lines where regexp_matches(content, '(?i)the')), p as (select doc_id, line from lines where regexp_matches(content, '(?i)license'))
select doc_id, hint_line::INT as hint_line, line::INT as line from h join p using (doc_id) where abs(line - hint_line) <= 5 qualify row_number() over (partition by doc_id, hint_line order by abs(line - hint_line), line) = 1""",
    "soft_penalties": """select l_orderkey, l_linenumber, case when l_quantity > 0 then floor(40 * (1 - exp(-l_quantity / 50 * 1.4::DOUBLE)) + 0.5) else 0 end::BIGINT as penalty,
 case when l_quantity * 2 >= 80 then 'A' when l_quantity * 2 >= 60 then 'B' when l_quantity * 2 >= 40 then 'C' when l_quantity * 2 >= 20 then 'D' else 'F' end as grade, case when l_quantity >= 25 then 'high' when l_quantity >= 8 then 'medium' else 'low' end as confidence from lineitem""",
}
