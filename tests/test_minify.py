from pyspark.sql import functions as F

from loomwork.functions import minify as M


def test_by_extension(spark):
    rows = [
        ("ts", "a(); // one\n// two\n\n\n\n/* b\nc */x = 'y';   \n", "a();\n\nx = 'y';"),
        ("py", "#!run\n# gone\nx = 1  # gone\n\n\n\ny\n", "#!run\n\nx = 1\n\ny"),
        ("css", "a { b : c ; }\n/* x */\n d , e {}", "a{b:c;}d,e{}"),
        ("html", "<a>\n <!-- c -->\n <b>t  u</b></a>", "<a><b>t u</b></a>"),
        ("js", "f ( a , b ) ; // x\n g ( )", "f(a,b);g()"),
        ("json", '{ "b" : [1, 2],\n "a": "x  \\" y" }', '{"b":[1,2],"a":"x  \\" y"}'),
        ("json", '{"a": 1 /* c */}', '{"a":1}'),
        ("json", " {no ", "{no"),
        ("md", "#   T\n\n\n\n-    x\n<!-- c -->a      b\n", "# T\n\n- x\na b"),
        ("txt", "a   b\r\n\r\n\r\n\r\nc \t\n", "a b\n\nc"),
        ("txt", "", ""),
        ("ts", None, None),
    ]
    df = spark.createDataFrame(rows, "e string, t string, w string")
    for r in df.select("e", "w", M.by_extension(F.col("t"), F.col("e")).alias("got")).collect():
        assert r.got == r.w, r


def test_other_comments(spark):
    df = spark.createDataFrame([("a -- x\n/* y */b",), ("{{! c }}d{{!-- e --}}{# f #}<%# g %>",)], "t string")
    got = [tuple(r) for r in df.select(M.without_comments(F.col("t"), "sql"), M.without_comments(F.col("t"), "template")).collect()]
    assert got[0][0] == "a \nb" and got[1][1] == "d"
