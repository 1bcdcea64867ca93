"""The classifier's perplexities against plain Kneser-Ney arithmetic."""

import collections
import math
import random

from loomwork.llm import quality


def discounts(values):
    n1, n2, n3, n4 = (sum(v == k for v in values) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def model(counts, lower):
    """p(c | b) of ``counts[b, c]``, interpolated with ``lower(b, c)``; ``less`` counts are left out."""
    d = discounts(list(counts.values()))
    total, taken = collections.Counter(), collections.Counter()
    for (b, _), n in counts.items():
        total[b] += n
        taken[b] += d[min(n, 3) - 1]

    def p(b, c, less=0):
        if not total[b]:
            return lower(b, c)
        n = max(0, counts.get((b, c), 0) - less)
        return max(0, n - (d[min(n, 3) - 1] if n else 0)) / total[b] + taken[b] / total[b] * lower(b, c)

    return p


def perplexities(texts, trusted):
    known = [t.encode().split() for t in dict.fromkeys(trusted)]
    df = collections.Counter(w for t in known for w in set(t))
    tri = collections.Counter()
    for w in df:
        x = b"\x02\x02" + w + b"\x03"
        tri.update((x[k : k + 2], x[k + 2]) for k in range(len(x) - 2))
    bi = collections.Counter((b[1], c) for b, c in tri)
    uni = collections.Counter(("", c) for _, c in bi)
    one = model(uni, lambda b, c: 1 / 256)
    two = model(bi, lambda b, c: one("", c))
    three = model(tri, lambda b, c: two(b[1], c))

    def spell(w):
        x = b"\x02\x02" + w + b"\x03"
        return -sum(math.log(three(x[k : k + 2], x[k + 2])) for k in range(len(x) - 2))

    def ids(words):
        again = [False] + [a == b for a, b in zip(words, words[1:])]
        return ["again" if r else w if df[w] >= 2 else "unknown" for r, w in zip(again, words)], again

    pairs = collections.Counter(p for t in known for s in [ids(t)[0]] for p in zip(["start", *s], s))
    last = collections.Counter(("", c) for _, c in pairs)
    size = 3 + sum(n >= 2 for n in df.values())
    single = model(last, lambda b, c: 1 / size)
    word = model(pairs, lambda b, c: single("", c))

    def cost(text, own):
        words = text.encode().split()
        s, again = ids(words)
        times = collections.Counter(zip(["start", *s], s))
        total = sum(-n * math.log(word(b, c, n if own else 0)) for (b, c), n in times.items())
        total += sum(spell(w) for w, x in zip(words, s) if x == "unknown")
        return total, sum(2 if r else len(w) + 1 for r, w in zip(again, words))

    mine = [cost(t, True) for t in dict.fromkeys(trusted)]
    mean = sum(c for c, _ in mine) / sum(n for _, n in mine)
    out = []
    for t in texts:
        c, n = cost(t, t in trusted)
        out.append(math.exp((c + quality.PRIOR * mean) / (n + quality.PRIOR)))
    return out


def test_perplexities_are_plain_kneser_ney(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, range(60, 0, -1), k=rng.randint(1, 90))) for _ in range(50)]
    texts += ["same same same other", texts[0], "ünseen wörds only", "x" * 100]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 40)] + [(51, 1)], "doc_id long, quality int")
    want = perplexities(texts, texts[:40])
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    assert all(math.isclose(got[k], p, rel_tol=1e-9) for k, p in enumerate(want))
