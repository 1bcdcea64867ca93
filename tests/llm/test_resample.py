"""Importance resampling against brute force: odd texts, ties, null and repeated ids, small packs and many groups."""

import collections
import hashlib
import math
import random
import re
import zlib

from loomwork.llm import resample

LOWER = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, pack string, shard string, score string, rank string, weight string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, goal, percent=5, least=20, seed=42, buckets=10_000):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    counts = [(i, t, *features(t)) for i, t in docs]
    s = collections.Counter(place(f) for *_, fs in counts for f in fs)
    t = collections.Counter(place(f) for text in goal for f in features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, _, words, fs in counts:
        weight = sum(gain[place(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return collections.Counter(out + [(*r[:4], None) for r in rows if not r[4]])


def made():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["É", "ÀB", "naïve", "Ünï-x", "A'b", "q r", "\x7fz", "under_score"]
    texts = [None, "", " .,-", "one", "Two Words"] + [" ".join(rng.choices(words, k=rng.choice((3, 19, 20, 25, 200)))) for _ in range(300)]
    texts += ["same row of twenty and more words " * 4] * 30 + ["x" * 5000 + " y" * 3000]
    ids = [None if k % 97 == 0 else k // 2 if k % 10 == 0 else k for k in range(len(texts))]
    return list(zip(ids, texts)), [rng.choice(texts[5:]) for _ in range(9)] + [None, ""]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "GROUP_PACKS", 2)
    docs, goal = made()
    df = spark.createDataFrame([(i, t, *"abcde") for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(goal)], "item_id long, text string")
    for percent, words in ((5, 800), (40, 400_000)):
        out = resample.resample(df, bench, percent=percent, pack_words=words)
        assert collections.Counter(tuple(r) for r in out.collect()) == brute(docs, goal, percent)
    assert dict(out.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")


def test_empty_target(spark):
    docs, _ = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = resample.resample(df, df.where("false"), buckets=77)
    assert collections.Counter(tuple(r) for r in out.collect()) == brute(docs, [], buckets=77)


def test_slices_of_long_texts(monkeypatch):
    texts = [t or "" for _, t in made()[0]]
    want = [[x.tolist() if hasattr(x, "tolist") else x for x in resample.feature_counts(t.encode(), 997)] for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(resample, "SLICE", size)
        assert [[x.tolist() if hasattr(x, "tolist") else x for x in resample.feature_counts(t.encode(), 997)] for t in texts[::11]] == want[::11]
