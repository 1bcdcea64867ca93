"""Ratings of six aspects of a code base, lenses of findings, and the strongest signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import paths as P
from loomwork.operators.code_findings import SEVERITY_PRESSURE, confidence, grade, soft_penalty

# Weights of aspects, categories that press less than others, categories of tests, names that say little, and generated paths.
WEIGHTS = (
    ("architecture-structure", 30), ("folder-topology", 15), ("naming-quality", 15), ("common-layer-health", 15), ("maintainability-evolvability", 15), ("codebase-consistency", 10),
)
CATEGORY_PRESSURE = (
    ("dependency-critical-path", 0.45), ("broker-module", 0.55), ("bridge-module", 0.55), ("distance-from-main-sequence", 0.6), ("over-abstraction", 0.65), ("concrete-dependency", 0.65),
    ("move-to-caller", 0.35), ("similar-function-body", 0.55), ("dead-export", 0.65), ("semantic-dead-export", 0.6),
)
CYCLES = ("dependency-cycle", "cycle-cluster")
TEST_DEBT = ("test-no-assertion", "low-assertion-density", "excessive-mocking", "missing-test-cleanup", "focused-test", "fake-timer-no-restore", "missing-mock-restoration")
VAGUE_FOLDER = r"(?i)^(util|utils|common|shared|misc|helper|helpers|tmp|temp)$"
GENERIC_NAME = r"(?i)^(foo|bar|baz|tmp|temp|data|value|handler|util|helper|thing|stuff|fn|func)$"
GENERIC_FILE = r"(?i)^(utils?|helpers?|common|shared|misc|tmp|temp|new|old|types?)$"
SHARED_PATH = r"(?i)(^|/)(common|shared|utils?|lib|core)(/|$)"
GENERATED = r"(?:^|/)(?:dist|build|coverage|out|vendor|vendors|generated|gen|\.cache)(?:/|$)|\.min\.(?:js|jsx|mjs|cjs|css)$|\.bundle\."
UNNAMED = ("<anonymous>", "default")
#: Categories by what a finding is based on; others are read off a file's own syntax.
GRAPH_LENS = (
    "dependency-cycle dependency-critical-path architecture-sdp-violation high-coupling god-module-coupling orphan-module unreachable-module cycle-cluster broker-module bridge-module mega-folder"
).split()
HYBRID_LENS = (
    "layer-violation low-cohesion feature-envy import-side-effect-risk package-boundary-chatter startup-risk-hub unvalidated-input-sink input-passthrough-risk missing-test-cleanup fake-timer-no-restore "
    "missing-mock-restoration focused-test hardcoded-secret eval-usage unsafe-html sql-injection-risk unsafe-regex prototype-pollution-risk path-traversal-risk command-injection-risk debug-log-leakage "
    "sensitive-data-logging over-abstraction concrete-dependency circular-type-dependency unused-parameter deep-override-chain interface-compliance unused-import orphan-implementation shotgun-surgery "
    "move-to-caller narrowable-type semantic-dead-export"
).split()


def lens(category: Column) -> Column:
    """What a finding is based on: graph, hybrid or ast."""
    return (
        F.when(category.isin(*GRAPH_LENS), "graph")
        .when(category.isin(*HYBRID_LENS), "hybrid")
        .when(category.startswith("dependency-"), "graph")
        .when(category.startswith("test-"), "hybrid")
        .otherwise("ast")
    )


def default_confidence(severity: Column, seen_by: Column, own: Column | None = None) -> Column:
    """A finding's own confidence, else by its severity and lens."""
    found = F.when(severity == "critical", "high").when(seen_by.isin("graph", "hybrid"), "medium").otherwise("low")
    return found if own is None else F.coalesce(own, found)


def is_generated(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(GENERATED)


def is_rated(path: Column) -> Column:
    """Tests and generated files are not rated."""
    return ~P.is_test(F.replace(path, F.lit("\\"), F.lit("/"))) & ~is_generated(path)


def mapped(column: Column, values: tuple, other: float) -> Column:
    return reduce(lambda rest, kv: F.when(column == kv[0], kv[1]).otherwise(rest), reversed(values), F.lit(other))


def measures(df: DataFrame, **values: Column) -> DataFrame:
    """``name, value`` rows of some aggregates of ``df``; null counts as 0."""
    row = df.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()])
    return row.select(F.explode(F.create_map(*[x for k in values for x in (F.lit(k), F.col(k))])).alias("name", "value"))


def without_shared_folders(files: DataFrame) -> DataFrame:
    """``path, parts``: the names along each path behind the folders that all paths begin with; a path of nothing else stays whole.

    All begin with what the smallest and the largest list of names share.
    """
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    own = files.select("path", parts.alias("names"))
    ends = own.agg(F.min("names").alias("a"), F.max("names").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, False)
    ends = ends.select(F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int").alias("shared"))
    rest = F.slice("names", F.col("shared") + 1, F.size("names"))
    return own.join(F.broadcast(ends)).select("path", F.when(F.size(rest) > 0, rest).otherwise(F.col("names")).alias("parts"))  # one row


def aspect_scores(
    files: DataFrame, functions: DataFrame, findings: DataFrame, hot: DataFrame, pillars: dict[str, str], signal: str | None = None
) -> DataFrame:
    """``aspect, weight, score, grade, confidence`` of six aspects, and ``overall`` of the weighted mean.

    ``files(path, imports, exports)``, ``functions(path, name, complexity)``,
    ``findings(category, severity, path)``, ``hot(path, risk)``; ``pillars`` names
    the pillar of a category, ``signal`` the confidence of the strongest graph
    signal.  Tests and generated files are left out everywhere.  Each table is
    aggregated once to a few numbers; the scores are expressions over these.
    """
    files, functions, findings, hot = (df.where(is_rated(F.col("path"))) for df in (files, functions, findings, hot))
    pillar = mapped(F.col("category"), tuple(pillars.items()), "unmapped")
    weight = mapped(F.col("severity"), SEVERITY_PRESSURE, 0.2)
    pressing = weight * mapped(F.col("category"), CATEGORY_PRESSURE, 1.0)
    severe = F.col("severity").isin("critical", "high")
    architecture, upkeep = pillar == "architecture", pillar.isin("code-quality", "dead-code", "test-quality")
    total = lambda when, x: F.sum(F.when(when, x))
    universe = files.select("path").union(findings.select("path")).distinct()
    base = F.regexp_replace(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", "")
    places = without_shared_folders(universe)
    named = F.col("name").isNotNull() & (F.col("name") != "")
    spoken = named & ~F.col("name").isin(*UNNAMED)
    shared = files.where(F.col("path").rlike(SHARED_PATH))
    touching = findings.join(shared.select("path").distinct(), "path", "left_semi")
    rows = [
        measures(findings, arch=total(architecture, pressing), arch_severe=total(architecture & severe, pressing), cycles=total(architecture & F.col("category").isin(*CYCLES), pressing), n_arch=total(architecture, 1),
                 upkeep=total(upkeep, pressing), n_upkeep=total(upkeep, 1), severe=total(severe, weight), debt=total(F.col("category").isin(*TEST_DEBT), pressing)),
        measures(hot.orderBy(F.desc("risk")).limit(8), heat=F.avg(F.greatest("risk", F.lit(0)))),
        measures(universe, files=F.count(F.lit(1)), generic_files=F.count_if(base.rlike(GENERIC_FILE)), ts=F.count_if(F.col("path").rlike(r"(?i)\.(ts|tsx)$")), js=F.count_if(F.col("path").rlike(r"(?i)\.(js|jsx|mjs|cjs)$"))),
        measures(places, depth=F.avg(F.size("parts"))),
        measures(places.groupBy(F.get("parts", F.lit(0)).alias("top")).count(), largest_top=F.max("count")),
        measures(places.select(F.explode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("folder")).distinct(), folders=F.count(F.lit(1)), vague=F.count_if(F.col("folder").rlike(VAGUE_FOLDER))),
        measures(functions, functions=F.count(F.lit(1)), unnamed=F.count_if(named & F.col("name").isin(*UNNAMED)), named=F.count_if(spoken), generic=F.count_if(spoken & F.col("name").rlike(GENERIC_NAME)),
                 short=F.count_if(spoken & (F.char_length("name") <= 2)), complexity=F.avg(F.coalesce("complexity", F.lit(0)))),
        measures(shared, shared=F.count(F.lit(1)), imports=F.avg(F.col("imports") / (F.col("exports") + 1))),
        measures(touching, on_shared=F.count(F.lit(1)), severe_on_shared=F.count_if(severe)),
        measures(universe.groupBy(P.name_style(base).alias("style")).count(), largest_style=F.max("count")),
    ]
    one = reduce(DataFrame.unionByName, rows).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    m = lambda name: F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(0.0))
    least_one = lambda x: F.greatest(x, F.lit(1.0))
    n_files, n_named = least_one(m("files")), least_one(m("named"))
    penalties = {
        "architecture-structure": [(m("arch") / n_files, 24, 1.35), (m("arch_severe") / n_files, 22, 1.9), (m("cycles") / n_files, 16, 2.2), (F.least(F.lit(1.0), m("heat") / 100), 12, 1.3)],
        "folder-topology": [((m("depth") - 4) / 3, 20, 1.3), (m("largest_top") / n_files - 0.55, 18, 2.0), (m("vague") / least_one(m("folders")), 24, 2.2)],
        "naming-quality": [(m("unnamed") / least_one(m("functions")), 30, 2.3), (m("generic") / n_named, 24, 2.0), (m("generic_files") / n_files, 15, 1.8), (m("short") / n_named, 10, 1.8)],
        "common-layer-health": [(m("on_shared") / least_one(m("shared")), 24, 1.6), (m("severe_on_shared") / least_one(m("shared")), 28, 2.2), (m("imports"), 18, 1.5)],
        "maintainability-evolvability": [(m("upkeep") / n_files, 20, 1.3), (m("severe") / n_files, 22, 1.8), ((m("complexity") - 8) / 12, 22, 1.4), (m("debt") / n_files, 12, 1.5)],
        "codebase-consistency": [(F.when(m("files") > 0, 1 - m("largest_style") / n_files).otherwise(0.0), 24, 2.0), (F.least(m("ts"), m("js")) / n_files * 2, 12, 1.6), (m("generic_files") / n_files, 10, 1.6)],
    }
    boost = {"high": 3, "medium": 1}.get(signal, 0)
    sample = {"architecture-structure": "n_arch", "folder-topology": "files", "naming-quality": "functions", "common-layer-health": "shared", "maintainability-evolvability": "n_upkeep", "codebase-consistency": "files"}
    found = []
    for aspect, share in WEIGHTS:
        score = F.lit(100 + (boost if aspect == WEIGHTS[0][0] else 0)) - reduce(lambda a, b: a + b, [soft_penalty(*p) for p in penalties[aspect]])
        score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")
        if aspect == "common-layer-health":  # no such layer is no fault
            score = F.when(m("shared") == 0, 88).otherwise(score).cast("long")
        found.append(F.struct(F.lit(aspect).alias("aspect"), F.lit(share).alias("weight"), score.alias("score"), confidence(m(sample[aspect])).alias("confidence")))
    each = one.select(F.inline(F.array(*found)))
    mean = F.floor(F.sum(F.col("score") * F.col("weight")) / F.sum("weight") + 0.5).cast("long")
    whole = each.agg(F.lit("overall").alias("aspect"), F.sum("weight").cast("int").alias("weight"), mean.alias("score"), F.lit(None).cast("string").alias("confidence"))
    return each.unionByName(whole).select("aspect", "weight", "score", grade(F.col("score")).alias("grade"), "confidence")


def strongest_signals(signals: DataFrame) -> DataFrame:
    """Of ``signals(kind, lens, score, title)`` the strongest of each lens, and of all as ``combined``; ties go to the smaller kind."""
    ranked = signals.unionByName(signals.withColumn("lens", F.lit("combined")))
    best = Window.partitionBy("lens").orderBy(F.desc("score"), "kind", "title")
    return ranked.withColumn("place", F.row_number().over(best)).where("place = 1").select("lens", "kind", "score", "title")


def graph_signals(chokepoints: DataFrame, clusters: DataFrame, packages: DataFrame) -> DataFrame:
    """Signals of a graph: its first chokepoint ``(node, score, reasons)``, cycle cluster ``(component, n, edges)`` and chatter ``(src_group, dst_group, weight)``."""
    first = lambda df, *order: df.orderBy(*order).limit(1)
    choke = first(chokepoints, F.desc("score"), "node").select(
        F.lit("structural-chokepoint").alias("kind"), F.lit("graph").alias("lens"), F.col("score").cast("long").alias("score"), F.concat(F.col("node").cast("string"), F.lit(": "), "reasons").alias("title")
    )
    size = F.col("n") * 6 + F.col("edges")
    cycle = first(clusters, F.desc("n"), "component").select(
        F.lit("cycle-cluster").alias("kind"), F.lit("graph").alias("lens"), size.cast("long").alias("score"), F.concat(F.col("component").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" files")).alias("title")
    )
    chatter = first(packages, F.desc("weight"), "src_group", "dst_group").select(
        F.lit("package-chatter").alias("kind"), F.lit("graph").alias("lens"), (F.col("weight") * 4).cast("long").alias("score"), F.concat("src_group", F.lit(" and "), "dst_group").alias("title")
    )
    return choke.unionByName(cycle).unionByName(chatter)
