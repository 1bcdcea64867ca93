"""Cut pages, safety of patterns, ignored paths, YAML, lookups, and counters of a stream."""

import random

from pyspark.sql import functions as F

from loomwork.functions import ignored_paths, pattern_safety
from loomwork.operators import lookups, segments, yaml_text
from loomwork.streaming import sessions


def test_pages_join_to_the_whole(spark):
    rng = random.Random(1)
    rows = [(key, k, rng.choice(["", "a", "é😀", "line of text", "y" * 45, None])) for key in range(6) for k in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "doc int, at int, body_text string")
    for size in (1, 7, 1000):
        placed = segments.offsets(df, "doc", ["at"], F.col("body_text"), joiner="; ")
        pages = segments.page_texts(segments.cut_pages(placed, size), "doc", ["at"]).collect()
        for key in {r[0] for r in rows}:
            own = sorted((p for p in pages if p.doc == key), key=lambda p: p.page)
            whole = "; ".join(t or "" for d, _, t in rows if d == key)
            assert "".join(p.text for p in own) == whole
            assert all(len(p.text) == size for p in own[:-1]) and [p.has_more for p in own] == [True] * (len(own) - 1) + [False]
    cut = segments.cut_pages(placed, 10).where("not whole")
    assert cut.count() == cut.where("page >= 1 and piece <> ''").count() > 0


SAFE = ["", "a+b*", "(ab)+", "[(a+)+]+", r"\(a+\)+", "a{2,3}b", "(a|b)*c", "x{y}+", "(a+b)", "((a)b)+", "(a)(b)+", "a)+", "[+*]{2}", "(a{b})+", r"(\++)", "a" * 1000, "(a)|b+"]
UNSAFE = ["(a+)+", "(a*)*", "(.*a)*", "((a+)b)*", "(a?)+", "(?:a)+", "(a{2,})+", "(a+b+)", "(a+(b))+", "(x+)?", "((a)+)+", r"([a+]+)*", "(a+|(b)c+)"]


def test_pattern_safety(spark):
    rows = [(p, None) for p in SAFE] + [(p, pattern_safety.NESTED) for p in UNSAFE] + [("b" * 1001, pattern_safety.TOO_LONG), (None, None)]
    df = spark.createDataFrame(rows, "p string, want string")
    for r in df.select("p", "want", pattern_safety.unsafe_reason(F.col("p")).alias("got")).collect():
        assert r.got == r.want, r


def test_ignored_paths(spark):
    rows = [
        ("a/.git/config", True, False, True), (".gitignore", False, False, False), ("x\\.ssh\\k", True, False, False), ("src/index.ts", False, False, False), ("src/.env.local", False, True, False),
        ("a/b/id_rsa", False, True, True), ("id_rsa.txt", False, False, False), ("my-private-x.key", False, True, True), ("", True, True, False), ("  ", True, True, False), (None, True, True, None),
        ("core.12", False, True, False), ("score.12", False, False, False), ("a/node_modules/b.js", False, False, True), ("x.d.ts.map", False, False, True), ("map", False, False, False), ("p/.mozilla/firefox/q/key4.db", True, True, True),
        ("p/secretsX/a", False, False, False), ("secrets/a.xml", True, True, False), ("build", False, False, True), ("package-lock.json", False, False, True),
    ]
    df = spark.createDataFrame(rows, "p string, sp boolean, sf boolean, d boolean")
    p = F.col("p")
    for r in df.select("*", ignored_paths.is_secret_path(p).alias("gp"), ignored_paths.is_secret_file(p).alias("gf"), ignored_paths.is_dull(p).alias("gd")).collect():
        assert (r.gp, r.gf, r.gd) == (r.sp, r.sf, r.d), r


def test_yaml(spark):
    row = spark.sql("""select 7 as n, 'q"\\\\' || char(10) || char(9) || 'é' as text, cast(null as string) as gone, array() as none, array(1, null) as some, named_struct('a', true, 'b', named_struct('c', double('nan'))) as deep,
      array(named_struct('x', 'u', 'y', array(2)), named_struct('x', cast(null as string), 'y', array(3, 4))) as rows, array(array('k'), array('l', 'm')) as grid, 2.5D as half, 3D as whole, array() as results, '' as empty, 'v' as `odd key`""")
    want = 'whole: 3\nn: 7\ntext: "q\\"\\\\\\n\\té"\nsome:\n  - 1\ndeep:\n  a: true\nrows:\n  - x: "u"\n    y:\n      - 2\n  - y:\n      - 3\n      - 4\ngrid:\n  - - "k"\n  - - "l"\n    - "m"\nhalf: 2.5\nresults: []\nempty: ""\n"odd key": "v"\n'
    assert yaml_text.yaml_rows(row, priority=("whole", "none such")).first().yaml == want
    plain = spark.sql("select array(cast(null as int), 2) as b, named_struct('z', cast(null as int)) as a, cast(array() as array<string>) as c")
    assert yaml_text.yaml_rows(plain, clean=False, sort_keys=True).first().yaml == "a: {}\nb:\n  - null\n  - 2\nc: []\n"
    assert yaml_text.yaml_rows(spark.sql("select cast(null as int) as a, named_struct('b', array()) as c")).first().yaml == "{}\n"
    kept = spark.sql("select named_struct('r', array(named_struct('m', array(), 'k', 1))) as files, named_struct('r', array(named_struct('m', array(), 'k', 1))) as other")
    assert yaml_text.yaml_rows(kept).first().yaml == "files:\n  r:\n    - m: []\n      k: 1\nother:\n  r:\n    - k: 1\n"


def test_shown_files_and_single_repository(spark):
    files = spark.createDataFrame([("a", "file", 1, "rw-", 9)], "path string, type string, size int, permissions string, modified int")
    assert lookups.shown_files(files).columns == ["path", "type"] and lookups.shown_files(files, details=True, modified=True).columns == ["path", "type", "size", "permissions", "modified"]
    matches = spark.createDataFrame([("r", "p", 2, "x"), ("r", "p", 1, "y"), ("r", "q", 5, "z")], "repo string, path string, line int, text string")
    row = lookups.nested_matches(matches, 1).first()
    assert (row.only_repo, row.total) == (True, 3) and [(f.path, f.n, [m.line for m in f.matches]) for f in row.files] == [("p", 2, [1]), ("q", 1, [5])]
    assert lookups.code_matches(matches, name="q").count() == 1 and lookups.code_matches(matches, repo="s").count() == 0


def test_stream_counts_late_rows_and_drops_too_late_ones(spark, tmp_path):
    schema, came = "event_id long, ts timestamp, user_id long, event_type string", 0

    def arrive(*rows):
        """Write some events and let the stream take them."""
        nonlocal came
        part = spark.createDataFrame([(came + n, t, n, e) for n, (t, e) in enumerate(rows)], "event_id long, ts string, user_id long, event_type string")
        part.withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "ts"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        came += len(rows)
        counted = sessions.window_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lateness="10 minutes")
        query = counted.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return {(r.start.hour, r.calls, r.errors) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert arrive(("10:05:00", "click"), ("10:59:00", "error")) == set()  # the window is open until 11:10 has been seen
    assert arrive(("11:05:00", "click"), ("10:30:00", "error")) == set()  # out of order, and counts
    assert arrive(("12:30:00", "view")) == {(10, 3, 2), (11, 1, 0)}
    assert arrive(("10:20:00", "error"), ("14:00:00", "view")) == {(10, 3, 2), (11, 1, 0), (12, 1, 0)}  # too late
    table = {(r.start.hour, r.calls) for r in sessions.window_counters(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert table == {(10, 4), (11, 1), (12, 1), (14, 1)}  # a table has no lateness
