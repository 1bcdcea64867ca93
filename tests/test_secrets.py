"""The whole pattern table of redaction."""

import re

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.secret_patterns import SECRET_PATTERNS

#: Made-up secrets of several files of the table: what is found, the text, and a path.
CASES = [
    ("OPENAIPROJECTAPIKEY", "key sk-proj-" + "a1" * 12 + " end", None),
    ("HUGGINGFACETOKEN", "hf_" + "Ab" * 17, None),
    ("AWSACCESSKEYID", "id AKIA" + "Q2" * 8, None),
    ("GITHUBTOKENS", "use ghp_" + "x9" * 18, None),
    ("RSAPRIVATEKEY", "-----BEGIN RSA PRIVATE KEY-----\n" + "ab+/" * 16 + "\n-----END RSA PRIVATE KEY-----", None),
    ("POSTGRESQLCONNECTIONSTRING", "postgresql://me:word@host.example:5432/db", None),
    ("WANDBAPIKEY", "0a" * 20, "x/wandb/run.txt"),
    ("", "0a" * 20, None),
    ("", "nothing here, only words", None),
]


def test_whole_table(spark):
    assert len(SECRET_PATTERNS) == 304
    df = spark.createDataFrame([(*c, k) for k, c in enumerate(CASES)], "name string, text string, path string, k int")
    for r in df.withColumn("r", T.redacted(F.col("text"), F.col("path"))).orderBy("k").collect():
        if r.name:
            assert r.name in r.r.names and r.r.n >= 1 and "[REDACTED-" in r.r.text, r
        else:
            assert (r.r.n, r.r.names, r.r.text) == (0, [], r.text), r


def test_too_long_is_replaced_whole(spark):
    df = spark.range(1).select(T.redacted(F.repeat(F.lit("a "), 5_000_001)).alias("r"))
    assert df.first().r.text == T.TOO_LONG


def test_words_are_ascii(spark):
    text = "é" + "hf_" + "Ab" * 17  # a bound to the reference, as é is no word character to it
    assert spark.createDataFrame([(text,)], "t string").select(T.redacted(F.col("t")).alias("r")).first().r.names == ["HUGGINGFACETOKEN"]
    assert not re.search(r"\\b", T.ascii_bounds(r"\bx\b"))
