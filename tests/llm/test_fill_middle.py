"""Fill-in-the-middle against brute force: texts of many pieces, control strings across pieces, odd lines."""

import collections
import hashlib
import random
import re

import pytest

from loomwork.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, form string, row string, found string"


def brute(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(9)
    made = ["", None, "\n", "\n\n\n", "a", "a\n", "é\nß😀x\n\nlast", "<P", "x<P>y", "<<M>\n", "<S\n>", "\n<M>", "<P\n<S\n>M>P>", "\r\n \x85a\n", "a b" * 40_000, "z\n" * 30_000]
    alphabet = ["\n", "<", "P", "S", "M", ">", "a", "é", "😀", " "]
    made += ["".join(rng.choices(alphabet, weights=(3, 1, 1, 1, 1, 1, 6, 2, 2, 2), k=rng.randrange(60))) for _ in range(400)]
    return [(None if k == 5 else k // 2 if k < 20 else k, t) for k, t in enumerate(made)]


@pytest.mark.parametrize("piece_bytes", [5, 64, fill_middle.PIECE_BYTES])
def test_equals_brute_force(spark, piece_bytes):
    rows = texts() if piece_bytes > 5 else [r for r in texts() if len(r[1] or "") < 1000]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)
    out = fill_middle.fill_in_middle(docs, piece_bytes=piece_bytes)
    seen = out.withColumn("back", fill_middle.restored(out.output, out.form)).collect()
    assert collections.Counter(tuple(r)[:6] for r in seen) == collections.Counter(brute(i, t) for i, t in rows)
    assert collections.Counter((r.doc_id, r.back) for r in seen) == collections.Counter((i, t or "") for i, t in rows)


def test_rates(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc") for k in range(300)], "doc_id long, text string")
    got = fill_middle.fill_in_middle(docs, seed=3, rate=40, suffix_first=10).collect()
    assert {tuple(r) for r in got} == {brute(k, "a\nb\nc", 3, 40, 10) for k in range(300)}


def test_functions_compose():
    machine, rng = fill_middle.LineMachine(fill_middle.MARKS), random.Random(1)
    for _ in range(200):
        data = "".join(rng.choices("\n<PSM>ab", k=rng.randrange(40))).encode()
        cut = rng.randrange(len(data) + 1)
        whole, parts = machine.function(data), (machine.function(data[:cut]), machine.function(data[cut:]))
        for state in range(len(whole[0])):
            middle = parts[0][0][state]
            assert whole[0][state] == parts[1][0][middle]
            assert all(whole[k][state] == parts[0][k][state] + parts[1][k][middle] for k in (1, 2))
