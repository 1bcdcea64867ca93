"""Each stage of the corpus pipeline against brute force, with null and repeated ids and repeated rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomwork.llm import decontaminate, quality

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(40)]
    near = [t.split() for t in texts[:12]]
    for t in near:
        t[len(t) // 2] = "edited"
    texts += [" ".join(t) for t in near] + texts[:3] + [None, "", " \n", None]
    rows = [(k, t, rng.choice(("en", "de", None)), rng.choice(("a", "b", None))) for k, t in enumerate(texts)]
    rows += [(None, texts[5], "en", "a"), (None, texts[6] + " end", "en", None), (None, None, "en", "a")]
    rows += [(7, texts[20], "en", "b"), (7, texts[33] + " and more of it", "de", "b")]  # ids that repeat
    rows += [rows[9], rows[9], rows[30], (8, None, "en", "a"), (8, None, "en", "a")]  # whole rows that repeat
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(rows[25][1].split()[3:28])
    spark.createDataFrame([(1, item), (2, None), (3, "never seen anywhere at all in these texts")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run(spark, stage, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = STAGES[stage](spark, docs, folder)
    if stage != "token-ID / binary output":
        assert out.columns == docs.columns
    return [tuple(r) for r in out.collect()]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def order(r):
    return tuple((x is None, x) for x in r)


def test_quality(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.classify(docs, labels).collect()
    assert len(judged) == len(rows)
    good = {(r.doc_id, r.lang, r.perplexity) for r in judged if r.kept}
    limits = {r.lang: (r.low, r.high) for r in judged}
    assert all((limits[r.lang][0] <= r.perplexity <= limits[r.lang][1]) == r.kept for r in judged if r.perplexity)
    got = run(spark, "quality classifier", rows, folder)
    assert sum(r.kept for r in judged) == len(got) and {(r[0], r[2]) for r in got} == {(d, lang) for d, lang, _ in good}
    assert not collections.Counter(got) - collections.Counter(rows)


def test_one_of_each_group(spark, rows, folder):
    sets = [shingles(r[1]) for r in rows]
    at = list(range(len(rows)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                at[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r)
    got = collections.Counter(run(spark, "n-gram Jaccard join", rows, folder))
    for members in groups.values():
        here = {m: got[m] for m in members if got[m]}
        ids = [m[0] for m in members if m[0] is not None]
        if shingles(members[0][1]):
            assert sum(here.values()) == 1 and next(iter(here))[0] == (min(ids) if ids else None)
    assert all(got[r] == rows.count(r) for r in rows if not shingles(r[1]))
    assert sum(got.values()) == len(groups)


def test_benchmark(spark, rows, folder):
    items = [decontaminate.plain_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def has(text, item):
        words, m = decontaminate.plain_words(text), len(item)
        for k in range(0, len(words) if m else 0, decontaminate.STEP):
            part = words[max(0, k - m) : k + 2 * decontaminate.STEP + m]
            share = decontaminate.common_subsequence(item, part) / m
            if share >= decontaminate.COPY or share >= decontaminate.PARAPHRASE and decontaminate.common_subsequence(item[-5:], part) / len(item[-5:]) >= decontaminate.ANSWER:
                return True
        return False

    want = [r for r in rows if not any(has(r[1], i) for i in items)]
    assert sorted(run(spark, "benchmark decontamination", rows, folder), key=order) == sorted(want, key=order) and len(want) < len(rows)


def test_mix(spark, rows, folder):
    got = collections.Counter(run(spark, "mixing sources to target weights", rows, folder))
    size = lambda r: len((r[1] or "").split())
    mine = collections.Counter(rows)
    assert set(got) <= set(mine) and all(n <= 3 * mine[r] for r, n in got.items())
    assert all(got[r] == n for r, n in mine.items() if not size(r))
    have, taken = collections.Counter(), collections.Counter()
    for r in rows:
        have[r[3]] += size(r)
    for r, n in got.items():
        taken[r[3]] += n * size(r)
    weight, total = {"a": 5, "b": 2, None: 1}, sum(have.values())
    full, target = set(), {}
    while True:
        rest = total - sum(3 * have[s] for s in full)
        share = sum(weight[s] for s in have if s not in full)
        target = {s: 3 * have[s] if s in full else rest * weight[s] / share for s in have}
        if not (more := {s for s in have if target[s] > 3 * have[s] + 1e-9}):
            break
        full |= more
    assert all(abs(taken[s] - target[s]) <= max(map(size, rows)) for s in have)


def test_tokens(spark, rows, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = STAGES["token-ID / binary output"](spark, docs, folder).collect()
    ids = {k: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for k, r in enumerate(rows)}
    want = sorted((r[0] is not None, r[0] or 0, len(ids[k]), zlib.crc32(ids[k].tobytes())) for k, r in enumerate(rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))


def test_no_rows(spark, rows, folder):
    for stage in STAGES:
        assert run(spark, stage, rows[:0], folder) == []
