"""Registered queries of cycles, chains, re-scans, cut pages, patterns, ignored paths, YAML and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import code_lines as L
from loomwork.functions import ignored_paths, pattern_safety
from loomwork.functions.paths import TEST_PATHS
from loomwork.operators import aspects, biconnected, chains, cohesion, cycles, graph, lookups, markdown, merges, rescan, segments, summaries, yaml_text
from loomwork.plans.inputs import DEGREES, EDGES, FINDINGS, LINES, documents, findings, part_graph
from loomwork.sources import folders
from loomwork.sources.tables import lines, table

ID = 1_000_000_000_000


def _edge_lines(s, d):
    """``src, dst, line`` of each pair of parts of an order that follow each other."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    t = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_linenumber").cast("int").alias("line"))
    return t.where("dst is not null")


def _cycles(s, d):
    return cycles.simple_cycles(part_graph(s, d)[1], 3)


def _supply(s, d):
    """Orders lead to customers, these to nations, these to regions, and regions back to their nations; ids by kind."""
    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    at = lambda k, name: F.col(name).cast("long") + k * ID
    nation = n.select(at(2, "n_nationkey").alias("src"), at(3, "n_regionkey").alias("dst"))
    edges = [
        o.select(at(0, "o_orderkey").alias("src"), at(1, "o_custkey").alias("dst")),
        c.select(at(1, "c_custkey").alias("src"), at(2, "c_nationkey").alias("dst")),
        nation,
        nation.select(F.col("dst").alias("src"), F.col("src").alias("dst")),
    ]
    files = [
        o.select(at(0, "o_orderkey").alias("node"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score")),
        c.select(at(1, "c_custkey").alias("node"), F.lit(5.0).alias("score")),
        n.select(at(2, "n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("score")),
        r.select(at(3, "r_regionkey").alias("node"), F.lit(None).cast("double").alias("score")),
    ]
    return files[0].union(files[1]).union(files[2]).union(files[3]), edges[0].union(edges[1]).union(edges[2]).union(edges[3])


def _critical(s, d):
    return chains.critical_paths(*_supply(s, d), 12, closing=True)


def _critical_findings(s, d):
    found = chains.chain_findings(_critical(s, d), 30)
    spots = chains.hotspots(found, _supply(s, d)[1]).withColumnRenamed("node", "hotspot")
    return found.join(spots, "start").select("start", F.size("path").alias("length"), F.col("score").cast("long").alias("score"), "severity", "hotspot", "outgoing")


def _ring(s, d):
    """As _supply(), but customers lead to their regions, too, and regions lead nowhere: customers, nations and regions lie on rings, orders hang on them."""
    files, _ = _supply(s, d)
    o, c, n = (table(s, d, t) for t in ("orders", "customer", "nation"))
    at = lambda k, name: F.col(name).cast("long") + k * ID
    homes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    edges = [
        o.select(at(0, "o_orderkey").alias("src"), at(1, "o_custkey").alias("dst")),
        c.select(at(1, "c_custkey").alias("src"), at(2, "c_nationkey").alias("dst")),
        homes.select(at(1, "c_custkey").alias("src"), at(3, "n_regionkey").alias("dst")),
        n.select(at(2, "n_nationkey").alias("src"), at(3, "n_regionkey").alias("dst")),
    ]
    return files.select("node", (F.col("node") % 400).alias("criticality")), edges[0].union(edges[1]).union(edges[2]).union(edges[3])


def _on_ring(what):
    return lambda s, d: what(_ring(s, d)[0].select("node"), _ring(s, d)[1])


def _pages(s, d):
    placed = segments.offsets(lines(documents(s, d)), "doc_id", ["line"], F.col("content"), base=12)
    out = segments.page_texts(segments.cut_pages(placed, 400), "doc_id", ["line"])
    return out.select("doc_id", "page", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "items", "has_more")


#: Patterns made of each part, in the SQL that both engines read.
PATTERN = r"""case p_partkey % 11 when 0 then '(' || p_name || '+)*' when 1 then p_name || '.*[+*]{2,3}?' when 2 then '(a|(' || p_brand || '{2,})b)c+' when 3 then '\(' || p_name || '+\)+' when 4 then '(?:' || p_type || ')+'
 when 5 then repeat(p_name, p_size) when 6 then '([' || p_name || ')+]+x)' when 7 then '((' || p_name || ')d)+' when 8 then p_name || ')+(' when 9 then '(' || p_type || '?){1,2}{x}' else '((a)(' || p_name || '+|b))' end"""


def _pattern_safety(s, d):
    t = table(s, d, "part").select("p_partkey", F.expr(PATTERN.replace("\\", "\\\\")).alias("pattern"))
    return t.select("p_partkey", pattern_safety.unsafe_reason(F.col("pattern")).alias("reason"))


#: A path made of each part, in the SQL that both engines read.
SECRET_PATH = """case p_partkey % 9 when 0 then 'src/' when 1 then '.aws/' when 2 then 'home/.config/gcloud/' when 3 then 'app/secrets/' when 4 then 'secretsX/' when 5 then 'a/node_modules/b/' when 6 then 'win\\.ssh\\' when 7 then '' else 'x/.mozilla/firefox/p/' end ||
 case p_size % 13 when 0 then '.env' when 1 then '.env.local' when 2 then 'id_rsa' when 3 then 'my-private-a.key' when 4 then 'index.ts' when 5 then 'x.d.ts.map' when 6 then 'package-lock.json' when 7 then 'core.12' when 8 then 'docker-compose.dev.yml' when 9 then 'logins.json' when 10 then 'a.tar.gz' when 11 then 'envious' else p_name end"""


def _secret_paths(s, d):
    t = table(s, d, "part").select("p_partkey", F.expr(SECRET_PATH.replace("\\", "\\\\")).alias("path"))
    p = F.col("path")
    return t.select("p_partkey", ignored_paths.is_secret_path(p).alias("secret_path"), ignored_paths.is_secret_file(p).alias("secret_file"), ignored_paths.is_dull(p).alias("dull"))


def _nested(s, d):
    """Findings with nested, partly empty parts."""
    f = findings(s, d)
    empty = F.array().cast("array<string>")
    tags = F.when(F.col("id") % 3 == 0, empty).when(F.col("id") % 3 == 1, F.array("category", F.lit(None))).otherwise(F.array(F.concat(F.lit('a "b"\n\\'), F.col("id"))))
    place = F.struct(F.when(F.col("id") % 2 == 0, F.col("file")).alias("line"), F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).alias("weight"))
    steps = F.array(F.struct(F.lit("").alias("text"), empty.alias("none")), F.struct(F.lit(None).cast("string").alias("text"), F.when(F.col("id") % 5 == 0, F.array(F.lit("x"))).alias("none")))
    return f.select("id", "severity", place.alias("place"), tags.alias("tags"), F.struct(steps.alias("steps"), (F.col("id") % 2 == 0).alias("open")).alias("fix"), empty.alias("results"), "category")


def _yaml(s, d):
    nested = _nested(s, d)
    row, kind = F.struct(*nested.columns), nested.schema
    text = yaml_text.to_yaml(yaml_text.cleaned(row, kind), kind, priority=("severity", "category"))
    return nested.select("id", text.alias("yaml"))


def _files(s, d, edited: bool):
    """Documents as files; before the edit some had another text, some were missing, and some were there that are gone."""
    docs = documents(s, d).select(F.col("doc_id").alias("path"), "text")
    if edited:
        return docs.where("path % 11 <> 5")
    return docs.where("path % 13 <> 4").withColumn("text", F.when(F.col("path") % 17 == 3, F.concat(F.lit("license of old\n"), "text")).otherwise(F.col("text")))


def _mentions(files, depends, paths):
    """``path, own, below``: lines that name a license in a file, and in the files it depends on."""
    def counted(which):
        return files.join(which, "path", "left_semi").select("path", F.regexp_count("text", F.lit("(?i)license")).alias("own"))

    near = depends.join(paths.select(F.col("path").alias("src")), "src", "left_semi")
    below = near.join(counted(near.select(F.col("dst").alias("path")).distinct()), F.col("dst") == F.col("path"))
    below = below.groupBy(F.col("src").alias("path")).agg(F.sum("own").alias("below"))
    return counted(paths).join(below, "path", "left").select("path", F.col("own").cast("long").alias("own"), F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def _rescan(s, d):
    before, after = _files(s, d, False), _files(s, d, True)
    depends = documents(s, d).select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).cast("long").alias("dst")).where("src <> dst")
    version = F.sha2(F.col("text").cast("binary"), 256)
    known = _mentions(before, depends, before.select("path"))
    return rescan.rescan(rescan.snapshot(before, version), rescan.snapshot(after, version), depends, known, lambda paths: _mentions(after, depends, paths))[0]


def _import_lines(s, d):
    t = _edge_lines(s, d).withColumns({"pos": F.col("line") % 3, "line_start": F.col("line"), "line_end": F.col("line") + F.col("dst").cast("int") % 4}).drop("line")
    return lookups.import_lines(part_graph(s, d)[1], t.where("src % 2 = 0"), t.where("src % 3 = 0"))


def _lone(s, d):
    t = table(s, d, "lineitem")
    interfaces = t.select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"))
    return lookups.lone_implementations(interfaces, t.select((F.col("l_orderkey") + F.col("l_partkey") % 2).alias("name"), F.col("l_partkey").alias("file")))


def _references(s, d):
    t = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_partkey").alias("uri"), F.col("l_linenumber").alias("line")).agg((F.max("l_tax") > 0.07).alias("is_definition"))
    return lookups.ranked_references(t, 20).select("symbol", "uri", "line", "is_definition", "place")


#: A line of code made of each part, in the SQL that both engines read.
CODE = """case p_partkey % 12 when 0 then 'export const ' || n || ' = 1' when 1 then '  async function ' || n || '() {' when 2 then 'import {' || n || '} from "b"' when 3 then 'x = ' || n || ' (1)' when 4 then 'class ' || n || ':'
 when 5 then 'pub fn ' || n || '(' when 6 then 'const a = await import("' || n || '")' when 7 then 'let ' || n || ' = () => 1' when 8 then 'private ' || n || ': number;' when 9 then 'func (r *T) ' || n || '(' when 10 then n || ' = 5' else 'interface ' || n || ' {' end"""


def _code(s, d):
    t = table(s, d, "part").select("p_partkey", F.expr("split_part(p_name, ' ', 1)").alias("n")).withColumn("code", F.expr(CODE))
    c, n = F.col("code"), F.col("n")
    return t.select(
        "p_partkey", L.is_definition(c, n).alias("definition"), L.symbol_kind(c).alias("kind"), L.is_import(c).alias("import"), L.is_dynamic_import(c).alias("dynamic"), (L.calls(c, n) & ~L.is_definition(c, n)).alias("call")
    )


def _matches(s, d):
    return documents(s, d).select(F.col("source").alias("repo"), F.concat(F.lit("d/"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("line"), F.substring("text", 1, 20).alias("text"))


def _nested_matches(s, d):
    out = lookups.nested_matches(_matches(s, d), 3)
    shown = F.transform("files", lambda f: F.concat_ws(":", f["path"], f["n"], F.concat_ws(",", F.transform(f["matches"], lambda m: m["line"].cast("string")))))
    return out.select("repo", "only_repo", "total", F.concat_ws(";", shown).alias("files"))


def _code_matches(s, d):
    return lookups.code_matches(_matches(s, d), repo="src1", prefix="d/1", extension=".txt").select("repo", "path", "line")


#: A path made of each part and each user, and a category of each event, in the SQL that both engines read.
RATED_PATH = """'repo/app/' || case p_partkey % 7 when 0 then 'core/' when 1 then 'src/utils/' when 2 then 'src/tests/' when 3 then 'dist/' when 4 then 'src/deep/er/than/that/' when 5 then 'Shared/' else 'src/' end ||
 case p_size % 9 when 0 then 'helpers' when 1 then 'main-file' when 2 then 'userProfile' when 3 then 'user_profile' when 4 then 'types' when 5 then 'a' when 6 then 'Read Me' when 7 then 'x' || p_partkey % 40 else 'conf' end ||
 case p_partkey % 5 when 0 then '.ts' when 1 then '.test.ts' when 2 then '.js' when 3 then '.tsx' else '.min.js' end"""
FOUND_PATH = "'repo/app/src/' || case user_id % 3 when 0 then 'lib/' when 1 then '' else 'tests/' end || 'u' || user_id || '.ts'"
FOUND_CATEGORY = "case event_type when 'click' then 'dependency-cycle' when 'view' then 'dead-export' when 'purchase' then 'broker-module' when 'signup' then 'low-assertion-density' else 'test-odd' end"
FUNCTION_NAME = "case l_linenumber when 1 then '<anonymous>' when 2 then 'fn' when 3 then 'ab' when 4 then '' else 'name' || l_partkey end"
PILLARS = {"dependency-cycle": "architecture", "broker-module": "architecture", "dead-export": "dead-code", "low-assertion-density": "test-quality"}


def _categories(s, d):
    return findings(s, d).join(table(s, d, "events").select(F.col("event_id").alias("id"), F.expr(FOUND_CATEGORY).alias("own"), F.expr(FOUND_PATH).alias("path")), "id").drop("category").withColumnRenamed("own", "category")


def _aspects(s, d):
    part, items = table(s, d, "part"), table(s, d, "lineitem")
    path = F.expr(RATED_PATH)
    files = part.groupBy(path.alias("path")).agg((F.sum("p_size") % 9).alias("imports"), (F.count(F.lit(1)) % 5).alias("exports"))
    owned = part.select(F.col("p_partkey").alias("l_partkey"), path.alias("path"))
    functions = items.join(owned, "l_partkey").select("path", F.expr(FUNCTION_NAME).alias("name"), F.col("l_quantity").alias("complexity"))
    hot = part.select(path.alias("path"), F.col("p_size").alias("risk"))
    return aspects.aspect_scores(files, functions, _categories(s, d), hot, PILLARS, "medium")


def _lenses(s, d):
    c = aspects.lens(F.col("category"))
    return _categories(s, d).select("id", "category", c.alias("lens"), aspects.default_confidence(F.col("severity"), c).alias("confidence"))


def _signals(s, d):
    nodes, edges = part_graph(s, d)
    score = F.floor(3 * F.col("incoming") + 1.2 * F.col("outgoing"))
    chokepoints = graph.degrees(nodes, edges).select("node", score.alias("score"), F.col("kind").alias("reasons"))
    clusters = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_custkey") % 3).alias("edges"))
    packages = graph.rolled_up(edges, table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp")))
    other = _lenses(s, d).groupBy(F.col("category").alias("kind"), "lens").agg(F.count(F.lit(1)).alias("score")).where("lens <> 'graph'")
    return aspects.strongest_signals(aspects.graph_signals(chokepoints, clusters, packages).unionByName(other.withColumn("title", F.col("kind"))))


def _cohesion(s, d):
    t = table(s, d, "lineitem")
    return cohesion.low_cohesion(
        t.select(F.col("l_partkey").alias("module"), F.col("l_suppkey").alias("name")).where("name % 7 <> 0").distinct(),
        t.select((F.col("l_orderkey") % 50).alias("consumer"), F.col("l_partkey").alias("module"), F.col("l_suppkey").alias("name")),
    )


def _graph_findings(s, d):
    nodes, edges = part_graph(s, d)
    edges = graph.written(edges, [])
    part = table(s, d, "part")
    strong = graph.strong_components(nodes, edges)
    points = biconnected.chokepoint_rows(part.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("criticality")), edges, strong=strong)
    strong = strong.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    packages = graph.rolled_up(edges, part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp")))
    return biconnected.graph_findings(points, strong, packages, part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("node")))


def _merged(s, d):
    """Documents by their lines, in order of their ids."""
    docs = documents(s, d).select(F.col("doc_id").alias("place"), F.col("doc_id").cast("string").alias("head"), F.split("text", "\n").alias("members"))
    return merges.merged_chains(docs, 0.8).select("place", F.concat_ws(",", "heads").alias("heads"), F.size("members").alias("members"))


def _hot_users(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("file")).agg((F.sum("event_id") % 100).alias("risk")).where("file % 3 = 0")


def _context(s, d):
    hot = _hot_users(s, d)
    of = lambda k: findings(s, d).where(f"file % 7 = {k}").select("file")
    return summaries.with_context(findings(s, d), hot, of(0), of(1), of(2), 4)


def _duplicates(s, d):
    t = table(s, d, "lineitem")
    return summaries.duplicate_bodies(t.select((F.col("l_partkey") * 7 + F.col("l_quantity").cast("int")).alias("hash"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")), 2, 5)


def _records(s, d):
    t, items = table(s, d, "part"), table(s, d, "lineitem")
    files = t.select(F.col("p_partkey").alias("node"), F.expr(RATED_PATH).alias("path"))
    return summaries.dependency_records(
        files, part_graph(s, d)[1], items.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("specifier")), items.where("l_tax > 0.05").select(F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("specifier"))
    )


def _critical_nodes(s, d):
    return summaries.critical_nodes(_records(s, d), table(s, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 2 - 10).alias("score")))


def _chosen_paths(s, d):
    t = table(s, d, "part").select("p_partkey", F.expr(SECRET_PATH.replace("\\", "\\\\")).alias("a"), F.expr(RATED_PATH).alias("b"))
    return t.select(
        "p_partkey", summaries.chosen_path(F.col("b"), kind="ts", include=("*.ts", "**/src/**"), exclude=("*.test.ts",), exclude_folders=("dist", "deep")).alias("rated"),
        summaries.chosen_path(F.col("a"), exclude=("core.*", "a/**")).alias("shown"), summaries.chosen_path(F.col("a"), include=("*.{env,local,json}",), hidden=True).alias("hidden"),
    )


def _source_files(s, d):
    t = table(s, d, "part")
    path = F.concat(F.when(F.col("p_partkey") % 4 == 0, "scripts/").when(F.col("p_partkey") % 4 == 1, "src/").otherwise("lib/"), (F.col("p_partkey") % 300).cast("string"), F.expr("case p_size % 7 when 0 then '.ts' when 1 then '.js' when 2 then '.d.ts' when 3 then '.min.js' when 4 then '.test.ts' when 5 then '.md' else '.py' end"))
    return folders.source_files(t.select("p_partkey", path.alias("path")))


def _binary(s, d):
    odd = F.expr("case doc_id % 5 when 0 then x'' when 1 then x'00' when 2 then x'C328' when 3 then x'1B5B33316D' else x'0102030405060708' end")
    content = F.concat(odd, F.substring("text", 1, 200).cast("binary"))
    return documents(s, d).select("doc_id", folders.looks_binary(content).alias("binary"))


QUERIES = {
    "feature_scores": lambda s, d: summaries.feature_scores(findings(s, d), _hot_users(s, d)),
    "finding_context": _context,
    "duplicate_bodies": _duplicates,
    "dependency_records": _records,
    "critical_nodes": _critical_nodes,
    "chosen_paths": _chosen_paths,
    "source_files": _source_files,
    "binary_texts": _binary,
    "low_cohesion": _cohesion,
    "graph_findings": _graph_findings,
    "merged_documents": _merged,
    "markdown_report": lambda s, d: markdown.summary(findings(s, d), 1000),
    "quality_aspects": _aspects,
    "finding_lenses": _lenses,
    "strongest_signals": _signals,
    "dependency_cycles": lambda s, d: _cycles(s, d).select(cycles.cycle_text(F.col("cycle")).alias("cycle"), "node_count"),
    "cycle_findings": lambda s, d: cycles.cycle_findings(_cycles(s, d), _edge_lines(s, d)),
    "critical_paths": lambda s, d: _critical(s, d).select("start", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), "score"),
    "critical_path_findings": _critical_findings,
    "graph_bridges": _on_ring(biconnected.bridges),
    "graph_cut_points": _on_ring(biconnected.articulation_points),
    "graph_chokepoints": lambda s, d: biconnected.chokepoints(*_ring(s, d)),
    "segment_pages": _pages,
    "pattern_safety": _pattern_safety,
    "secret_paths": _secret_paths,
    "findings_yaml": _yaml,
    "rescan_mentions": _rescan,
    "import_lines": _import_lines,
    "lone_implementations": _lone,
    "ranked_references": _references,
    "code_line_facts": _code,
    "nested_matches": _nested_matches,
    "code_matches": _code_matches,
}

_SUPPLY = f"""supply as (select o_orderkey as start, concat_ws('>', o_orderkey, {ID} + c_custkey, {2 * ID} + c_nationkey, {3 * ID} + n_regionkey) as path,
  floor(o_totalprice / 1000) + 5 + n_nationkey + 0.5 as score, {2 * ID} + c_nationkey as nation, {3 * ID} + n_regionkey as region,
  count(*) over () as n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
top as (select * from supply order by score desc, start limit 12)"""
_RE = {k: v.replace("'", "''") for k, v in (("paths", ignored_paths.union(ignored_paths.SECRET_PATHS)), ("files", ignored_paths.union(ignored_paths.SECRET_FILES)))}
_LISTS = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in (("folders", ignored_paths.DULL_FOLDERS), ("names", ignored_paths.DULL_NAMES), ("endings", ignored_paths.DULL_ENDINGS))}

_NOT_RATED = "regexp_matches(path, '" + "|".join(TEST_PATHS).replace("'", "''") + "') or regexp_matches(lower(path), '" + aspects.GENERATED + "')"
_PRESS = "case severity when 'critical' then 1.0 when 'high' then 0.75 when 'medium' then 0.45 when 'low' then 0.2 else 0.05 end"
_FOUND = f"""found as (select event_id as id, {FOUND_CATEGORY} as category, {FOUND_PATH} as path,
  case when value >= 90 then 'critical' when value >= 60 then 'high' when value >= 30 then 'medium' when value >= 10 then 'low' else 'info' end as severity from events)"""
_LENS = "case category when 'dependency-cycle' then 'graph' when 'broker-module' then 'graph' when 'test-odd' then 'hybrid' else 'ast' end"


def _penalty(ratio: str, most: int, sensitivity: float) -> str:
    return f"case when {ratio} > 0 then floor({most} * (1 - exp(-({ratio}) * {sensitivity})) + 0.5) else 0 end"


def _score(*penalties: tuple[str, int, float], extra: int = 0) -> str:
    return f"greatest(0, least(100, {100 + extra} - ({' + '.join(_penalty(*p) for p in penalties)})))::BIGINT"


_PLACES = "['critical', 'high', 'medium', 'low', 'info']"
_TOPS = (("Severity", "Severity | Findings"), ("Categories", "Category | Findings | Files"), ("Top findings", "# | Severity | Category | File"))
_FIXED = " union all ".join(
    f"select {n}, unnest([-4, -3, -2, -1]), unnest(['## {title}', '', '| {heads} |', '|{' --- |' * (heads.count('|') + 1)}'])" for n, (title, heads) in enumerate(_TOPS, 1)
)

#: In the ring graph orders hang on their customers, and nations without customers on their regions.
_RING = f"""ring as (select distinct o_orderkey as src, {ID} + o_custkey as dst, true as bridge from orders union all select {ID} + c_custkey, {2 * ID} + c_nationkey, false from customer
  union all select {ID} + c_custkey, {3 * ID} + n_regionkey, false from customer join nation on c_nationkey = n_nationkey
  union all select {2 * ID} + n_nationkey, {3 * ID} + n_regionkey, n_nationkey not in (select c_nationkey from customer) from nation),
cuts as (select distinct {ID} + o_custkey as node from orders union select {3 * ID} + n_regionkey from nation group by n_regionkey having count(*) > 1)"""

_RECORDS = f"""{EDGES}, files as (select p_partkey as node, {RATED_PATH} as path from part), tested as (select node, regexp_matches(path, '{"|".join(TEST_PATHS)}') as test from files),
ins as (select dst as node, count(*) as incoming, count(*) filter (not test) as from_production, count(*) filter (test) as from_tests from edges join tested on tested.node = src group by dst),
outs as (select src as node, count(*) as outgoing from edges group by src), ext as (select l_partkey as node, count(distinct l_suppkey) as externals from lineitem group by 1), lost as (select l_partkey as node, count(distinct l_linenumber) as unresolved from lineitem where l_tax > 0.05 group by 1),
records as (select node, coalesce(outgoing, 0) as outgoing, coalesce(incoming, 0) as incoming, coalesce(from_production, 0) as from_production, coalesce(from_tests, 0) as from_tests, coalesce(externals, 0) as externals, coalesce(unresolved, 0) as unresolved
  from files left join outs using (node) left join ins using (node) left join ext using (node) left join lost using (node))"""

ORACLE_SQL = {
    "feature_scores": f"""with {FINDINGS}, hot as (select user_id as file, sum(event_id) % 100 as risk from events where user_id % 3 = 0 group by 1 having sum(event_id) % 100 > 0),
each as (select category, file, count(*) as n, sum([25, 10, 3, 1, 0][r + 1]) as p, min(r) as worst from ranked group by 1, 2),
s as (select category, sum(n)::BIGINT as n, sum(p) as p, min(worst) as worst, count(*) as files, count(risk) as hot_files, coalesce(max(risk), 0) as risk from each left join hot using (file) group by category),
t as (select *, case when hot_files = 0 then 0 else least(20, floor(hot_files / files * 10 + case when risk >= 90 then 10 when risk >= 75 then 7 when risk >= 60 then 4 else 2 end + 0.5)) end::BIGINT as penalty from s),
u as (select *, greatest(0, least(floor(100 / (1 + p / files / 10) + 0.5), case worst when 0 then 95 when 1 then 98 else 99 end) - penalty)::BIGINT as score from t)
select row_number() over (order by score, n desc, category)::INT as place, category, n, files, hot_files, penalty, score, case when score >= 80 then 'A' when score >= 60 then 'B' when score >= 40 then 'C' when score >= 20 then 'D' else 'F' end as grade from u""",
    "finding_context": f"""with {FINDINGS}, hot as (select distinct user_id as file from events where user_id % 3 = 0), own as (select file, list_sort(list(distinct category)) as cats from findings group by file)
select id, array_to_string(list_filter([case when f.file in (select file from hot) then 'hot-file' end, case when f.file % 7 = 0 then 'cycle-context' end, case when f.file % 7 = 1 then 'critical-path-context' end, case when f.file % 7 = 2 then 'top-level-effects' end]
  || list_transform(list_filter(cats, lambda c: c <> f.category), lambda c: 'paired:' || c), lambda x: x is not null)[1:4], ',') as signals from findings f join own using (file)""",
    "duplicate_bodies": """with b as (select l_partkey * 7 + l_quantity::INT as hash, l_returnflag as kind, l_orderkey as file, l_linenumber as line from lineitem), k as (select *, row_number() over (partition by hash, kind order by file, line) as k from b)
select hash, kind, count(*) as n, count(distinct file) as files, case when count(*) >= 6 then 'high' when count(*) >= 3 then 'medium' else 'low' end as severity, string_agg(file || ':' || line, ',' order by k) filter (k <= 5) as places from k group by 1, 2 having count(*) >= 2""",
    "dependency_records": f"with {_RECORDS} select * from records",
    "critical_nodes": f"""with {_RECORDS}, s as (select records.*, case when p_size > 5 then p_size * 2 - 10 else 0 end as score from records join part on p_partkey = node)
select node, score::INT as score, case when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end as band, incoming, outgoing from s where score > 12 or outgoing > 5 or incoming > 8 order by score * 10 + incoming * 8 + outgoing * 4 desc, node limit 150""",
    "chosen_paths": rf"""with own as (select p_partkey, {SECRET_PATH} as a, {RATED_PATH} as b from part), n as (select *, list_last(string_split(a, '/')) as an, list_last(string_split(b, '/')) as bn, string_split(a, '/') as ap, string_split(b, '/') as bp from own)
select p_partkey, list_last(string_split(b, '.')) in ('ts', 'tsx', 'mts', 'cts') and (regexp_matches(bn, '^[^/]*\.ts$') or regexp_matches(b, '^.*/src/.*$')) and not regexp_matches(bn, '\.test\.ts$') and not list_has_any(bp[:-2], ['dist', 'deep']) and len(list_filter(bp, lambda p: starts_with(p, '.'))) = 0 as rated,
  not (regexp_matches(an, '^core\.[^/]*$') or regexp_matches(a, '^a/.*$')) and len(list_filter(ap, lambda p: starts_with(p, '.'))) = 0 as shown, regexp_matches(an, '^[^/]*\.(env|local|json)$') as hidden from n""",
    "source_files": r"""with f as (select p_partkey, case p_partkey % 4 when 0 then 'scripts/' when 1 then 'src/' else 'lib/' end || p_partkey % 300 || case p_size % 7 when 0 then '.ts' when 1 then '.js' when 2 then '.d.ts' when 3 then '.min.js' when 4 then '.test.ts' when 5 then '.md' else '.py' end as path from part),
m as (select distinct 'scripts/' || regexp_replace(substr(path, 5), '\.[^./]+$', '') as stem from f where starts_with(path, 'src/'))
select p_partkey, path from f where list_last(string_split(path, '.')) in ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py') and not regexp_matches(path, '\.d\.ts$|\.min\.[^./]+$|\.test\.ts$') and regexp_replace(path, '\.[^./]+$', '') not in (select stem from m)""",
    "binary_texts": "select doc_id, doc_id % 5 in (1, 2) or (doc_id % 5 = 4 and 8 > 0.05 * (8 + strlen(substr(text, 1, 200)))) as binary from documents",
    "graph_bridges": f"with {_RING} select src as a, dst as b from ring where bridge",
    "graph_cut_points": f"with {_RING} select node from cuts",
    "graph_chokepoints": f"""with {_RING}, nodes as (select o_orderkey as node from orders union select {ID} + c_custkey from customer union select {2 * ID} + n_nationkey from nation union select {3 * ID} + r_regionkey from region),
outs as (select src as node, count(*) as o from ring group by 1), ins as (select dst as node, count(*) as i from ring group by 1), ends as (select node, count(*) as b from (select unnest([src, dst]) as node from ring where bridge) group by 1),
f as (select node, coalesce(i, 0) as i, coalesce(o, 0) as o, node in (select node from cuts) as cut, coalesce(b, 0) as b, node % 400 as c from nodes left join ins using (node) left join outs using (node) left join ends using (node)),
g as (select node, floor(3 * i + 1.2 * o + c / 10 + case when cut then 12 else 0 end + 4 * b + 0.5)::BIGINT as score,
  concat_ws(',', case when i >= 8 then 'fan-in' end, case when o >= 6 then 'fan-out' end, case when cut then 'articulation' end, case when b >= 1 then 'bridges' end, case when c >= 20 then 'complexity' end) as reasons from f)
select node, score, reasons from g where reasons <> '' order by score desc, node limit 40""",
    "low_cohesion": """with recursive e as (select distinct l_partkey as module, l_suppkey as name from lineitem where l_suppkey % 7 <> 0), large as (select module from e group by 1 having count(*) >= 3),
used as (select distinct l_orderkey % 50 as consumer, module, name from lineitem join e on module = l_partkey and name = l_suppkey where module in (select module from large)),
links as (select distinct a.module, a.name as x, b.name as y from used a join used b on a.module = b.module and a.consumer = b.consumer),
walk as (select module, x as name, y as seen from links union select w.module, w.name, l.y from walk w join links l on l.module = w.module and l.x = w.seen),
groups as (select module, name, min(seen) as g from walk group by 1, 2)
select module, count(*) as symbols, count(distinct g) as groups, case when count(distinct g) >= 4 then 'high' else 'medium' end as severity from groups group by module having count(*) >= 2 and count(distinct g) > 1""",
    "markdown_report": f"""with {FINDINGS}, score as (select least(floor(100 / (1 + sum([25, 10, 3, 1, 0][r + 1]) / 1000 / 10) + 0.5), case min(r) when 0 then 95 when 1 then 98 else 99 end)::BIGINT as score from ranked),
levels as (select unnest({_PLACES}) as severity, unnest([1, 2, 3, 4, 5]) as place), turns as (select *, row_number() over (partition by category order by r, id) as turn from ranked),
top as (select *, row_number() over (order by turn, r, category, id) as k from turns qualify k <= 20), lines(section, place, line) as ({_FIXED}
  union all select 0, 0, '# Scan summary' union all select 0, 1, '' union all select 0, 2, 'Health: ' || score || '/100' from score
  union all select 1, place, '| ' || severity || ' | ' || (select count(*) from findings f where f.severity = levels.severity) || ' |' from levels
  union all select 2, row_number() over (order by count(*) desc, category), '| ' || category || ' | ' || count(*) || ' | ' || count(distinct file) || ' |' from findings group by category
  union all select 3, k, '| ' || k || ' | ' || severity || ' | ' || category || ' | ' || file || ' |' from top)
select section::INT as section, place::BIGINT as place, line from lines""",
    "quality_aspects": rf"""with {_FOUND}, f as (select *, {_PRESS} as w, {_PRESS} * case category when 'broker-module' then 0.55 when 'dead-export' then 0.65 else 1.0 end as p from found where not ({_NOT_RATED})),
own as (select {RATED_PATH} as path, * from part), files as (select path, sum(p_size) % 9 as imports, count(*) % 5 as exports from own where not ({_NOT_RATED}) group by path),
hot as (select p_size as risk from own where not ({_NOT_RATED}) order by 1 desc limit 8),
fns as (select {FUNCTION_NAME} as name, l_quantity as complexity from lineitem join own on l_partkey = p_partkey where not ({_NOT_RATED})),
universe as (select path from files union select path from f), named as (select path, string_split(path, '/') as parts, regexp_replace(list_last(string_split(path, '/')), '(.)\.[^.]*$', '\1') as base from universe),
-- all paths begin with the same two folders and with no more
places as (select path, base, parts[3:] as parts, case when regexp_matches(base, '^[a-z0-9]+(-[a-z0-9]+)+$') then 'kebab' when regexp_matches(base, '^[a-z0-9]+(_[a-z0-9]+)+$') then 'snake' when regexp_matches(base, '^[a-z]+([A-Z][a-z0-9]*)+$') then 'camel' when regexp_matches(base, '^[a-z0-9]+$') then 'flat' else 'other' end as style from named),
folders as (select distinct unnest(parts[:-2]) as folder from places),
shared as (select * from files where regexp_matches(path, '{aspects.SHARED_PATH}')), on_shared as (select * from f where path in (select path from shared)),
m as (select (select count(*) from universe)::DOUBLE as files, (select sum(p) from f where category in ('dependency-cycle', 'broker-module')) as arch, (select sum(p) from f where category in ('dependency-cycle', 'broker-module') and severity in ('critical', 'high')) as arch_severe,
  (select sum(p) from f where category = 'dependency-cycle') as cycles, (select count(*) from f where category in ('dependency-cycle', 'broker-module')) as n_arch, (select sum(p) from f where category in ('dead-export', 'low-assertion-density')) as upkeep,
  (select count(*) from f where category in ('dead-export', 'low-assertion-density')) as n_upkeep, (select sum(w) from f where severity in ('critical', 'high')) as severe, (select sum(p) from f where category = 'low-assertion-density') as debt,
  (select avg(risk) from hot) as heat, (select count(*) from places where regexp_matches(base, '{aspects.GENERIC_FILE}')) as generic_files, (select count(*) from universe where regexp_matches(path, '(?i)\.(ts|tsx)$')) as ts, (select count(*) from universe where regexp_matches(path, '(?i)\.(js|jsx|mjs|cjs)$')) as js,
  (select avg(len(parts)) from places) as depth, (select max(n) from (select count(*) as n from places group by parts[1])) as largest_top, (select count(*) from folders) as folders, (select count(*) from folders where regexp_matches(folder, '{aspects.VAGUE_FOLDER}')) as vague,
  (select count(*) from fns) as functions, (select count(*) from fns where name = '<anonymous>') as unnamed, (select count(*) from fns where name not in ('<anonymous>', '')) as named, (select count(*) from fns where regexp_matches(name, '{aspects.GENERIC_NAME}')) as generic,
  (select count(*) from fns where name <> '' and length(name) <= 2) as short, (select avg(complexity) from fns) as complexity, (select count(*) from shared) as shared, (select avg(imports / (exports + 1)) from shared) as imports,
  (select count(*) from on_shared) as on_shared, (select count(*) from on_shared where severity in ('critical', 'high')) as severe_on_shared, (select max(n) from (select count(*) as n from places group by style)) as largest_style),
each as (select unnest([{{'aspect': 'architecture-structure', 'weight': 30, 'score': {_score(("arch / files", 24, 1.35), ("arch_severe / files", 22, 1.9), ("cycles / files", 16, 2.2), ("least(1, heat / 100)", 12, 1.3), extra=1)}, 'sample': n_arch}},
  {{'aspect': 'folder-topology', 'weight': 15, 'score': {_score(("(depth - 4) / 3", 20, 1.3), ("largest_top / files - 0.55", 18, 2.0), ("vague / folders", 24, 2.2))}, 'sample': files}},
  {{'aspect': 'naming-quality', 'weight': 15, 'score': {_score(("unnamed / functions", 30, 2.3), ("generic / named", 24, 2.0), ("generic_files / files", 15, 1.8), ("short / named", 10, 1.8))}, 'sample': functions}},
  {{'aspect': 'common-layer-health', 'weight': 15, 'score': {_score(("on_shared / shared", 24, 1.6), ("severe_on_shared / shared", 28, 2.2), ("imports", 18, 1.5))}, 'sample': shared}},
  {{'aspect': 'maintainability-evolvability', 'weight': 15, 'score': {_score(("upkeep / files", 20, 1.3), ("severe / files", 22, 1.8), ("(complexity - 8) / 12", 22, 1.4), ("debt / files", 12, 1.5))}, 'sample': n_upkeep}},
  {{'aspect': 'codebase-consistency', 'weight': 10, 'score': {_score(("1 - largest_style / files", 24, 2.0), ("least(ts, js) / files * 2", 12, 1.6), ("generic_files / files", 10, 1.6))}, 'sample': files}}], recursive := true) from m),
graded as (select aspect, weight, score, case when sample >= 25 then 'high' when sample >= 8 then 'medium' else 'low' end as confidence from each
  union all select 'overall', sum(weight), floor(sum(score * weight) / sum(weight) + 0.5)::BIGINT, null from each)
select aspect, weight::INT as weight, score, case when score >= 80 then 'A' when score >= 60 then 'B' when score >= 40 then 'C' when score >= 20 then 'D' else 'F' end as grade, confidence from graded""",
    "finding_lenses": f"with {_FOUND} select id, category, {_LENS} as lens, case when severity = 'critical' then 'high' when {_LENS} <> 'ast' then 'medium' else 'low' end as confidence from found",
    "strongest_signals": f"""with {DEGREES}, {_FOUND}, choke as (select 'structural-chokepoint' as kind, 'graph' as lens, floor(3 * incoming + 1.2 * outgoing)::BIGINT as score, node || ': ' || case when outgoing > 0 and incoming > 0 then 'inner' when outgoing > 0 then 'root' when incoming > 0 then 'leaf' else 'orphan' end as title from degrees order by score desc, node limit 1),
cycle as (select 'cycle-cluster' as kind, 'graph' as lens, (count(*) * 6 + sum(c_custkey % 3))::BIGINT as score, c_nationkey || ': ' || count(*) || ' files' as title from customer group by c_nationkey order by count(*) desc, c_nationkey limit 1),
chatter as (select 'package-chatter' as kind, 'graph' as lens, (count(*) * 4)::BIGINT as score, s.p_brand || ' and ' || t.p_brand as title from edges join part s on s.p_partkey = src join part t on t.p_partkey = dst where s.p_brand <> t.p_brand group by s.p_brand, t.p_brand order by count(*) desc, s.p_brand, t.p_brand limit 1),
other as (select category as kind, {_LENS} as lens, count(*)::BIGINT as score, category as title from found group by category),
signals as (select * from choke union all select * from cycle union all select * from chatter union all select * from other where lens <> 'graph'), ranked as (select * from signals union all select kind, 'combined', score, title from signals)
select lens, kind, score, title from ranked qualify row_number() over (partition by lens order by score desc, kind, title) = 1""",
    "dependency_cycles": f"""with recursive {EDGES}, walk as (select distinct src as start, src as last, [src] as path from edges
  union all select start, dst, list_append(path, dst) from walk join edges on src = last where dst > start and not list_contains(path, dst) and len(path) < 3)
select array_to_string(list_append(path, start), ' -> ') as cycle, len(path)::INT as node_count from walk join edges e on e.src = last and e.dst = start""",
    "cycle_findings": f"""with recursive {EDGES}, stands as (select src, dst, min(line)::INT as line from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst, l_linenumber as line from lineitem) group by 1, 2),
walk as (select distinct src as start, src as last, [src] as path from edges union all select start, dst, list_append(path, dst) from walk join edges on src = last where dst > start and not list_contains(path, dst) and len(path) < 3),
first as (select path, start from walk join edges e on e.src = last and e.dst = start order by len(path) desc, path limit 15)
select 'dependency-cycle' as category, 'high' as severity, path[1] as file, coalesce(line, 1) as line, 'Dependency cycle detected (' || len(path) || ' node cycle)' as title,
  'Import cycle exists across: ' || array_to_string(list_append(path, start), ' -> ') as reason from first left join stands on src = path[1] and dst = coalesce(path[2], path[1])""",
    "critical_paths": f"with {_SUPPLY} select start, path, score from top",
    "critical_path_findings": f"""with {_SUPPLY}, out as (select {3 * ID} + n_regionkey as region, count(*) as n from nation group by 1)
select start, 4::INT as length, floor(score)::BIGINT as score, case when score >= 180 then 'critical' else 'high' end as severity,
  case when out.n > 1 then top.region else start end as hotspot, greatest(out.n, 1)::BIGINT as outgoing from top join out using (region) where score >= 90
qualify row_number() over (order by score desc, start) <= 10""",
    "segment_pages": f"""with {LINES}, own as (select doc_id, line, case when line = 1 then '' else ',' end || content as body from lines),
placed as (select *, (12 + sum(length(body)) over (partition by doc_id order by line))::BIGINT as e from own),
cut as (select doc_id, line, body, e - length(body) as s, e, unnest(range((e - length(body)) // 400, greatest((e - length(body)) // 400, (e - 1) // 400) + 1)) as p from placed),
pieces as (select doc_id, line, p + 1 as page, substr(body, (greatest(s, p * 400) - s + 1)::INT, (least(e, (p + 1) * 400) - greatest(s, p * 400))::INT) as piece from cut)
select doc_id, page, sha256(string_agg(piece, '' order by line)) as text_sha256, count(*) as items, lead(page) over (partition by doc_id order by page) is not null as has_more from pieces group by doc_id, page""",
    "pattern_safety": rf"""with recursive own as (select p_partkey, {PATTERN} as pattern from part),
marked as (select p_partkey, pattern, translate(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(pattern, '(?s)\\.?', 'x', 'g'), '\[[^\]]*\]?', 'x', 'g'), '([+*?]|\{{[0-9]+,?[0-9]*\}})[?+]?', chr(1), 'g'), ')' || chr(1), chr(2)), '[^()\x01\x02]', '', 'g'), chr(1) || chr(2), 'QR') as marks from own),
walk as (select p_partkey, marks, 0 as k, '' as g, false as bad from marked union all
  select p_partkey, marks, k + 1, case m when '(' then g || '0'
    when ')' then case when length(g) < 2 or right(g, 1) = '0' then left(g, greatest(length(g) - 1, 0)) else left(g, length(g) - 2) || '1' end
    when 'R' then case when length(g) < 2 then '' else left(g, length(g) - 2) || '1' end
    else case when g = '' then '' else left(g, length(g) - 1) || '1' end end,
    (m = 'R' and right(g, 1) = '1') or (m = 'Q' and contains(g, '1'))
  from (select *, substr(marks, k + 1, 1) as m from walk where not bad and k < length(marks))),
nested as (select p_partkey, bool_or(bad) as bad from walk group by p_partkey)
select p_partkey, case when length(pattern) > 1000 then 'Pattern too long (max 1000 characters)' when bad then 'Nested quantifiers detected (potential ReDoS). Simplify the pattern.' end as reason from own join nested using (p_partkey)""",
    "secret_paths": f"""with own as (select p_partkey, {SECRET_PATH} as path from part), plain as (select *, replace(path, chr(92), '/') as p, list_last(string_split(replace(path, chr(92), '/'), '/')) as f, list_last(string_split(path, '/')) as name from own)
select p_partkey, regexp_matches(p, '{_RE['paths']}') as secret_path, regexp_matches(f, '{_RE['files']}') or regexp_matches(p, '{_RE['files']}') as secret_file,
  len(list_filter({_LISTS['endings']}, lambda e: suffix(name, e))) > 0 or list_contains({_LISTS['names']}, name) or list_has_any(string_split(path, '/'), {_LISTS['folders']}) as dull from plain""",
    "findings_yaml": r"""with f as (select event_id as id, event_type as category, user_id as file, case when value >= 90 then 'critical' when value >= 60 then 'high' when value >= 30 then 'medium' when value >= 10 then 'low' else 'info' end as severity from events)
select id, 'severity: "' || severity || '"' || chr(10) || 'category: "' || category || '"' || chr(10) || 'id: ' || id || chr(10)
  || case when id % 2 = 0 then 'place:' || chr(10) || '  line: ' || file || chr(10) else '' end
  || case id % 3 when 0 then '' when 1 then 'tags:' || chr(10) || '  - "' || category || '"' || chr(10) else 'tags:' || chr(10) || '  - "a \"b\"\n\\' || id || '"' || chr(10) end
  || 'fix:' || chr(10) || '  steps:' || chr(10) || '    - text: ""' || chr(10) || case when id % 5 = 0 then '    - none:' || chr(10) || '        - "x"' || chr(10) else '' end
  || '  open: ' || case when id % 2 = 0 then 'true' else 'false' end || chr(10) || 'results: []' || chr(10) as yaml from f""",
    "rescan_mentions": """with files as (select doc_id as path, len(regexp_extract_all(text, '(?i)license')) as own from documents where doc_id % 11 <> 5)
select f.path, f.own::BIGINT as own, coalesce(b.own, 0)::BIGINT as below from files f left join files b on b.path = f.path // 2 and f.path <> f.path // 2""",
    "import_lines": f"""with {EDGES}, t as (select src, dst, line % 3 as pos, line as line_start, line + dst % 4 as line_end from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst, l_linenumber as line from lineitem) where dst is not null),
a as (select * from t where src % 2 = 0 qualify row_number() over (partition by src, dst order by pos, line_start, line_end) = 1), b as (select * from t where src % 3 = 0 qualify row_number() over (partition by src, dst order by pos, line_start, line_end) = 1)
select e.src, e.dst, coalesce(a.line_start, b.line_start, 1)::INT as line_start, coalesce(a.line_end, b.line_end, 1)::INT as line_end from edges e left join a on a.src = e.src and a.dst = e.dst left join b on b.src = e.src and b.dst = e.dst""",
    "lone_implementations": """with i as (select l_orderkey as name, l_suppkey as file, l_linenumber as line from lineitem qualify row_number() over (partition by l_orderkey order by l_suppkey, l_linenumber) = 1),
u as (select l_orderkey + l_partkey % 2 as name, min(l_partkey) as implementation from lineitem group by 1 having count(distinct l_partkey) = 1)
select name, file, line, implementation from i join u using (name)""",
    "ranked_references": """with t as (select l_suppkey as symbol, l_partkey as uri, l_linenumber as line, max(l_tax) > 0.07 as is_definition from lineitem group by 1, 2, 3)
select *, row_number() over (partition by symbol order by is_definition desc, uri, line)::INT as place from t qualify place <= 20""",
    "code_line_facts": rf"""with t as (select p_partkey, split_part(p_name, ' ', 1) as n from part), c as (select p_partkey, n, {CODE} as code from t), f as (select *, regexp_matches(trim(code), replace('{"|".join(L.DEFINITIONS)}', 'NAME', n)) as definition from c)
select p_partkey, definition, case when regexp_matches(code, '\bclass\b') then 'class' when regexp_matches(code, '\binterface\b') then 'interface' when regexp_matches(code, '\btype\s+\w') then 'type' when regexp_matches(code, '\benum\b') then 'enum'
  when regexp_matches(code, '\bnamespace\b') then 'namespace' when regexp_matches(code, '\bmodule\b') then 'module' when regexp_matches(code, '\bconst\b') and not regexp_matches(code, '=>|function') then 'constant'
  when regexp_matches(code, '\b(let|var)\b') and not regexp_matches(code, '=>|function') then 'variable' when regexp_matches(trim(code), '\bproperty\b|^\s*(public|private|protected|readonly)\s+\w+\s*[:;]') then 'property' else 'function' end as kind,
  regexp_matches(trim(code), '^(import|export)\s+.*\bfrom\b\s+[''"]') as "import", regexp_matches(code, '(^|[^.\w])import\s*\(\s*[''"]') as dynamic, regexp_matches(code, '\b' || n || '\s*\(') and not definition as call from f""",
    "nested_matches": """with m as (select source as repo, 'd/' || doc_id % 40 || '.txt' as path, doc_id as line from documents), k as (select *, row_number() over (partition by repo, path order by line) as k from m),
f as (select repo, path, count(*) as n, array_to_string(list_sort(list(line) filter (k <= 3)), ',') as lines from k group by 1, 2)
select repo, (select count(distinct repo) = 1 from m) as only_repo, sum(n)::BIGINT as total, string_agg(path || ':' || n || ':' || lines, ';' order by path) as files from f group by repo""",
    "code_matches": "select source as repo, 'd/' || doc_id % 40 || '.txt' as path, doc_id as line from documents where source = 'src1' and starts_with('d/' || doc_id % 40, 'd/1')",
}
