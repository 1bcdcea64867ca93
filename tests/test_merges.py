"""Greedy merging in rounds against the ordered loop."""

import random

from loomwork.operators import merges


def ordered_loop(chains, least=0.8):
    out, gone = [], set()
    for i, (place, head, members) in enumerate(chains):
        if place in gone:
            continue
        own, heads = set(members), [head]
        for other, name, more in chains[i + 1 :]:
            both, union = len(own & set(more)), len(own | set(more))
            if other not in gone and union and both >= least * union:
                gone.add(other)
                heads.append(name)
                own |= set(more)
        out.append((place, heads, sorted(own)))
    return out


def made(rng, n, alphabet, rows):
    """Chains that are often small changes of earlier ones."""
    sets = []
    for _ in range(n):
        base = set(rng.choice(sets)) if sets and rng.random() < 0.75 else set(rng.sample(alphabet, rng.randrange(0, rows)))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            base ^= {rng.choice(alphabet)}
        sets.append(sorted(base))
    return [(k * 3, f"h{k}", s) for k, s in enumerate(sets)]


def test_equals_the_ordered_loop(spark, monkeypatch):
    monkeypatch.setattr(merges, "SPAN", 20)
    schema = "place long, head string, members array<string>"
    for seed, least, alphabet in ((0, 0.8, 60), (3, 0.6, 14)):
        rng = random.Random(seed)
        chains = made(rng, 32, [f"m{k}" for k in range(alphabet)], 12)
        want = ordered_loop(chains, least)
        got = merges.merged_chains(spark.createDataFrame(rng.sample(chains, len(chains)), schema), least).collect()
        assert sorted((r.place, list(r.heads), list(r.members)) for r in got) == want and len(want) < len(chains)
    empty = merges.merged_chains(spark.createDataFrame([(1, "a", []), (2, "b", []), (3, "c", None), (4, "d", [None, "x"]), (5, "e", ["x", "x"])], schema)).collect()
    assert sorted((r.place, list(r.heads), list(r.members)) for r in empty if r.place != 3) == [(1, ["a"], []), (2, ["b"], []), (4, ["d", "e"], ["x"])]
    assert merges.merged_chains(spark.createDataFrame([], schema)).count() == 0


def test_members_are_written_once(spark, monkeypatch):
    """Texts of members travel once, however many rounds there are; before, each round wrote them twice."""
    chains = [(1, "a", list("abcdefghi")), (2, "b", list("abcdefghij")), (3, "c", list("abcdefghijkl")), (4, "d", ["z"])]
    plain, texts = merges.graph.written, []

    def noted(df, folder):
        texts.append(any("string" in kind for _, kind in df.dtypes))
        return plain(df, folder)

    monkeypatch.setattr(merges.graph, "written", noted)
    got = merges.merged_chains(spark.createDataFrame(chains, "place long, head string, members array<string>")).collect()
    assert sorted((r.place, list(r.heads), list(r.members)) for r in got) == ordered_loop(chains) and sum(texts) == 1
