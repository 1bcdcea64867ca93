"""Folders, reports and the findings on files, against small expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import paths as P
from loomwork.operators import code_findings, files, paging, patches, sinks
from loomwork.sources import folders


def test_folder_tables(spark, tmp_path):
    made = {
        "a/src/index.ts": "one", "a/scripts/index.js": "mirror", "a/scripts/own.js": "own", "a/x.d.ts": "t", "a/x.min.js": "m", "a/x.test.ts": "t",
        "node_modules/b.ts": "no", "top.py": "é" * 5, "bin.dat": "", "p1/package.json": '{"name": "one"}', "p2/package.json": "{", "p3/package.json": '{"v": 1}',
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bin.dat").write_bytes(b"ab\0cd")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "ctl.txt").write_bytes(b"\x01\x02abc")
    (tmp_path / "colour.txt").write_bytes(b"\x1b[31mred\x1b[0m")
    listed = folders.file_list(spark, str(tmp_path), hidden_folders=("node_modules",))
    got = {r.path: (r.size, r.depth) for r in listed.collect()}
    assert set(got) == {n for n in made if not n.startswith("node_modules")} | {"bad.txt", "ctl.txt", "colour.txt"}
    assert got["top.py"] == (10, 0) and got["a/src/index.ts"] == (3, 2)
    assert {r.path for r in folders.source_files(listed).collect()} == {"a/src/index.ts", "a/scripts/own.js", "top.py"}
    assert "a/x.test.ts" in {r.path for r in folders.source_files(listed, tests=True).collect()}
    binary = {r.path.rsplit("/", 1)[1]: (r.binary, r.content) for r in folders.text_files(spark, str(tmp_path)).collect()}
    assert [binary[n][0] for n in ("bin.dat", "bad.txt", "ctl.txt", "colour.txt", "top.py")] == [True, True, True, False, False]
    assert binary["bin.dat"][1] is None and binary["top.py"][1] == "é" * 5
    assert [tuple(r) for r in folders.packages(spark, str(tmp_path)).collect()] == [("p1", "one")]


def test_feed_catalogue(spark):
    text = "see http://a.b/x).\n## One\n- [f](https://c.d/feed)\n| `https://c.d/feed` | https://e.f |\n## Two\nhttps://c.d/feed;"
    rows = folders.feed_catalogue(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")).collect()
    assert sorted((r.section, r.url, r.line) for r in rows) == [("One", "https://c.d/feed", 3), ("One", "https://e.f", 4), ("Two", "https://c.d/feed", 6), ("Unknown", "http://a.b/x", 1)]


def test_reports(spark, tmp_path):
    rows = [("high", "a.ts", 3, "dead", "x"), ("low", "b.ts", None, "dead", "y"), ("info", "b.ts", 1, "big", "z")]
    found = spark.createDataFrame(rows, "severity string, file string, line int, category string, title string")
    assert {r[0] for r in found.select(sinks.compact_line()).collect()} == {"high:a.ts:3 - [dead] x", "low:b.ts - [dead] y", "info:b.ts:1 - [big] z"}
    assert {r[0] for r in found.select(sinks.annotation()).collect()} == {"::error file=a.ts,line=3::x [dead]", "::notice file=b.ts,line=1::y [dead]", "::warning file=b.ts,line=1::z [big]"}
    sinks.write_report(found, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/findings").count() == 3 and spark.read.json(f"{tmp_path}/report/summary").count() == 3
    sinks.write_lines(found, sinks.compact_line(), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 3
    sinks.save_baseline(found.where("severity = 'high'"), f"{tmp_path}/base")
    assert {r.title for r in sinks.new_findings(found, f"{tmp_path}/base").collect()} == {"y", "z"}
    assert found.select(sinks.clean_json(F.struct("file", "line"))).collect()[1][0] == '{"file":"b.ts"}'


def test_chains_merge_in_order(spark):
    rows = [(1, "a", list("pqrst")), (2, "b", list("pqrs")), (3, "c", list("pqrstu")), (4, "d", list("xy")), (5, "e", [])]
    got = code_findings.merged_sets(spark.createDataFrame(rows, "place long, head string, members array<string>")).collect()
    assert sorted((r.place, r.heads, r.members) for r in got) == [(1, ["a", "b", "c"], list("pqrstu")), (4, ["d"], ["x", "y"]), (5, ["e"], [])]
    assert code_findings.merged_sets(spark.createDataFrame([], "place long, head string, members array<string>")).count() == 0


def test_patches(spark):
    patch = "@@ -10,3 +20,4 @@ f\n a\n-b\n+c\n+d\n\\ No newline\n e"
    df = spark.createDataFrame([(1, patch), (2, None), (3, "")], "id long, patch string")
    got = [(r.kind, r.old_line, r.new_line) for r in patches.patch_lines(df.where("id = 1")).orderBy("at").collect()]
    assert got == [("context", 10, 20), ("deletion", 11, None), ("addition", None, 21), ("addition", None, 22), ("context", 12, 23)]
    shown = {r.id: r.shown for r in patches.chosen_lines(df, [22], []).collect()}
    assert shown[1] == " 20: a\n+22: d\n 23: e" and shown[2] == "" and shown[3] == " 1: "
    assert {r.id: tuple(r.c) for r in df.select("id", patches.line_changes(F.col("patch")).alias("c")).collect()} == {1: (2, 1), 2: (0, 0), 3: (0, 0)}
    diff = "x\ndiff --git a/o.ts b/n.ts\n+1\ndiff --git a/s b/s\n-2\n"
    files_of = {r.path: r.patch for r in patches.by_file(spark.createDataFrame([(1, diff), (2, None)], "id long, diff string")).collect()}
    assert files_of == {"o.ts": "diff --git a/o.ts b/n.ts\n+1", "n.ts": "diff --git a/o.ts b/n.ts\n+1", "s": "diff --git a/s b/s\n-2\n"}


def test_pages(spark):
    text = "ab\ncdef\n\nghi"
    want = {(0, 2): ("ab\n", 0, 3, 1), (4, 1): ("cdef\n", 3, 8, 1), (0, 3): ("ab\n", 0, 3, 1), (9, 99): ("ghi", 9, None, 0), (50, 5): ("", 12, 12, 0)}
    df = spark.createDataFrame([(text,)], "t string")
    for (offset, length), page in want.items():
        assert tuple(df.select(paging.line_page(F.col("t"), offset, length)).first()[0]) == page


def test_paths(spark):
    names = [("a/.gitignore", "gitignore"), (".gitignore", ""), ("x", ""), ("a.b/c", "b/c"), ("f.tar.gz", "gz"), (None, None)]
    rows = spark.createDataFrame(names, "p string, e string").select("e", P.extension(F.col("p")).alias("got")).collect()
    assert all(r.e == r.got for r in rows)
    steps = spark.createDataFrame([("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../x", None)], "f string, s string, w string")
    assert all(r.w == r.got for r in steps.select("w", files.path_steps(F.col("s"), F.col("f")).alias("got")).collect())
    text = spark.createDataFrame([("aé€b",)], "t string")
    assert [text.select(P.byte_of_char(F.col("t"), F.lit(n))).first()[0] for n in range(5)] == [0, 1, 3, 6, 7]
    assert [text.select(P.char_of_byte(F.col("t"), F.lit(n))).first()[0] for n in (0, 1, 3, 6, 7)] == [0, 1, 2, 3, 4]
