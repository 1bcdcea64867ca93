"""Jaccard join on word shingles with prefixes under several global orders.

Each document is the set of its distinct 5-word shingles.  Every global order
puts the shingles that no other set holds first; among the shared ones, the
first order goes by document frequency and the others by independent hashes.
Two sets with a Jaccard similarity of t or more share a shingle within the
first ``n - ceil(t * n) + 1`` ones of each under *every* order, so a pair is
verified only if it passes all orders.

Steps: packs of documents exchange shingle keys for their frequencies (see
``common``); sets of which too few shingles are shared can have no partner and
go; equal sets become one class; candidates meet in the inverted index of the
first order; those that do not meet in the prefixes of the other orders, too,
go before any set is fetched; the rest are compared whole.

For a pair, sizes n and m ask for an overlap of ``o = ceil(t * (n + m) / (1 +
t))``, so the first shingle that both hold has at most ``n - o`` and ``m - o``
shingles before it: a posting joins two sets only where it stands early enough
in both, and the other orders are cut at the same place.

A posting of m sets is never expanded into m * m pairs while they are linked:
first each set is compared with a few centres of its postings, others in each
round, and what is then in one component needs no further comparison.  The rounds
end when one brings no link, or when the pairs that are left are no more than a
few for each posting.  All pairs that still lie in different components are
compared in the end, so no link that would join two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import (
    BASES,
    BROADCAST_ROWS,
    KEYS_SCHEMA,
    Pack,
    by_shard,
    expand,
    expand_sorted,
    few,
    give_back,
    meet,
    mix,
    remove,
    rolling,
    save,
    save_counting,
    scratch,
    shards,
    squeeze_sorted,
    word_packs,
)
from .components import connected_components
from .substring_dedup import SHARD_KEYS, among, inside

#: Independent orders beside the one by frequency.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Centres of a posting in each round of comparisons with them.
CENTRES = (1, 16, 64, 64)
#: Pairs left for each posting up to which all of them are compared at once.
LEFT_PAIRS = 2


SETS_SCHEMA = "doc_id long, n long, d1 long, d2 long, own int, shared binary, prefix array<long>, others array<binary>"


def shingle_sets(pack: Pack, width: int):
    """Document number and hash of each distinct shingle, sorted by both; shorter texts are one shingle."""
    at = np.flatnonzero(inside(pack, width))
    words = pack.hashes(1)
    doc, code = pack.doc[at], rolling(words, width, BASES[0])[at]
    short = np.flatnonzero((pack.counts > 0) & (pack.counts < width))
    whole = [
        xxhash.xxh3_64_intdigest(b" ".join(pack.vocab[w] for w in pack.words[pack.starts[d] : pack.ends[d]]), 5)
        for d in short
    ]
    doc = np.concatenate((doc, short))
    code = np.concatenate((code, np.array(whole, np.uint64)))
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else np.zeros(0, bool)
    return doc[new], code[new]


def digests(pack: Pack, doc: np.ndarray, code: np.ndarray):
    """Set sizes, two 64-bit sums that name each set, and the first document of each set in the pack."""
    n = np.bincount(doc, minlength=len(pack.counts)).astype(np.int64)
    sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
    some = np.flatnonzero(n)
    if len(some):
        at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
        for total, salt in zip(sums, ORDERS):
            total[some] = np.add.reduceat(mix(code * np.uint64(salt) + np.uint64(1)), at)
    order = np.lexsort((np.arange(len(n)), sums[1], sums[0], n))
    same = np.concatenate(([False], (n[order][1:] == n[order][:-1]) & (sums[0][order][1:] == sums[0][order][:-1]) & (sums[1][order][1:] == sums[1][order][:-1])))
    first = np.ones(len(n), bool)
    first[order[same]] = False
    return n, *(s.view(np.int64) for s in sums), first & (n > 0)


#: Pairs that one block verifies on average, and pairs up to which sets are compared without a look at the other orders.
BLOCK_PAIRS, FEW_PAIRS = 4096, 1 << 16


def _sizes(pairs: pa.Table, sets: pa.Table, percent: int):
    """Each pair of a block as two rows of its sets and the overlap that their sizes need."""
    place = {key: k for k, key in enumerate(sets.column("key").to_pylist())}
    n = sets.column("n").to_pylist()
    for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        x, y = place[x], place[y]
        yield x, y, -(-percent * (n[x] + n[y]) // (100 + percent))


def _meets_in_all_orders(percent: int):
    """The pairs of a block that share a shingle early enough in each of the other orders.  Each set's prefixes come once."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        s, others, orders = sets.column("s").to_pylist(), sets.column("others"), {}

        def prefixes(k):
            if k not in orders:
                orders[k] = [np.frombuffer(x, np.uint64).tolist() for x in others[k].as_py()]
            return orders[k]

        kept = []
        for k, (x, y, need) in enumerate(_sizes(pairs, sets, percent)):
            u, v = s[x] - need + 1, s[y] - need + 1
            if all(not set(p[:u]).isdisjoint(q[:v]) for p, q in zip(prefixes(x), prefixes(y))):
                kept.append(k)
        return pairs.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _verify(percent: int):
    """The pairs of a block that share enough.  Each set comes once, however many pairs it has there."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        shared, whole = sets.column("shared"), {}

        def all_of(k):
            if k not in whole:
                whole[k] = expand_sorted(shared[k].as_py(), np.uint64)
            return whole[k]

        linked = [len(np.intersect1d(all_of(x), all_of(y), assume_unique=True)) >= need for x, y, need in _sizes(pairs, sets, percent)]
        return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _by_blocks(pairs: DataFrame, total: int, sets: DataFrame, test, path: str, *, both: bool) -> tuple[DataFrame, int]:
    """``a, b`` of those of about ``total`` pairs that pass ``test`` in blocks of about BLOCK_PAIRS, written, and how many.

    With ``both``, blocks are dealt by both sets of a pair, otherwise by the second.
    """
    parts = int(max(1, total / BLOCK_PAIRS) ** 0.5) + 1
    if both:
        block = F.pmod(F.xxhash64("a"), F.lit(parts)) * parts + F.pmod(F.xxhash64("b"), F.lit(parts))
    else:
        block = F.pmod(F.xxhash64("b"), F.lit(parts * parts))
    pairs = pairs.select("a", "b", block.alias("block"))
    needed = pairs.select(F.col("block").alias("at"), F.explode(F.array("a", "b")).alias("key")).distinct()
    # a pair needs two sets, so the pairs bound what is broadcast
    near = F.broadcast(needed) if 2 * total <= BROADCAST_ROWS else needed
    checked = pairs.groupBy("block").cogroup(sets.join(near, "key").groupBy("at")).applyInArrow(test, "a long, b long")
    return save_counting(checked, path, F.lit(True))


def _overlap(percent: int, n: str, m: str) -> str:
    """Shingles that sets of sizes n and m must share, in SQL."""
    return f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"


def jaccard_join(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Near-duplicate groups; one row per row of ``docs``.

    Words are lower-cased in A-Z.  A set holds the distinct runs of ``width``
    words; a shorter text is one run.  Two texts link if ``100 * |A and B| >=
    percent * |A or B|``.  Returns ``doc_id, n_shingles, component_id``, the
    smallest id that links reach, the document's own included.

    Null and empty texts have no shingles, link with nothing, and are their
    own component.  Rows with a null id count as members without lending an id
    (a component of only such rows is null).  Repeated rows are one class of
    equal sets.  An empty table gives an empty result; other columns are
    ignored.  Shingles are 64-bit hashes; sets are equal if their size and two
    64-bit sums agree, and the two sums together name a class.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    packs = save(word_packs(docs, id_col=id_col, text_col=text_col, lower=True), f"{folder}/packs", compression="none")
    n_shards = shards(packs.agg(F.sum("n_words")).first()[0] or 0, SHARD_KEYS, 64)

    def split(code):
        return (code >> np.uint64(32)) % np.uint64(n_shards) << np.uint64(32) | (code & np.uint64(0xFFFFFFFF))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                doc, code = shingle_sets(pack, width)
                *_, first = digests(pack, doc, code)
                keys, sets = np.unique(split(code[first[doc]]), return_counts=True)
                if len(keys):
                    yield from by_shard(pack.pack, keys.astype(np.uint32), sets.astype(np.uint32), (keys >> np.uint64(32)).astype(np.int64))

    def frequent(notes, starts):
        total = np.add.reduceat(notes, starts)
        return total > 1, total

    known = save(meet(packs.mapInArrow(send, KEYS_SCHEMA), frequent, np.uint32, np.uint32), f"{folder}/known", compression="none")

    def survivors(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = Pack(left.to_pylist()[0])
        doc, code = shingle_sets(pack, width)
        n, d1, d2, first = digests(pack, doc, code)
        own_count, shared, prefix, others = np.zeros(len(n), np.int32), [None] * len(n), [None] * len(n), [None] * len(n)
        if right.num_rows and len(code):
            rows = right.to_pylist()
            keys = np.concatenate([np.uint64(r["shard"]) << np.uint64(32) | expand_sorted(r["keys"], np.uint32) for r in rows])
            count = np.concatenate([expand(r["notes"], np.uint32) for r in rows])
            order = np.argsort(keys)
            keys, count = keys[order], count[order]
            mine = split(code)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            known = keys[at] == mine
            left_over = np.bincount(doc[known], minlength=len(n))
            ends = np.cumsum(n)
            for d in np.flatnonzero(first & (100 * left_over >= percent * n)):
                own = slice(ends[d] - n[d], ends[d])
                s, c = code[own][known[own]], count[at[own]][known[own]]
                own_count[d] = n[d] - len(s)
                m = int(n[d] - -(-percent * n[d] // 100) + 1 - (n[d] - len(s)))
                shared[d] = squeeze_sorted(s)
                prefix[d] = s[np.lexsort((s, c))[:m]].view(np.int64)
                others[d] = [s[np.argsort(mix(s * np.uint64(salt)))[:m]].tobytes() for salt in ORDERS]
            del rows, keys, count, order, mine, at, known, left_over
        del doc, code
        give_back()
        return pa.table(
            [
                pa.array(pack.ids, pa.int64()),
                pa.array(n),
                pa.array(d1),
                pa.array(d2),
                pa.array(own_count),
                pa.array(shared, pa.binary()),
                pa.array(prefix, pa.list_(pa.int64())),
                pa.array(others, pa.list_(pa.binary())),
            ],
            names=["doc_id", "n", "d1", "d2", "own", "shared", "prefix", "others"],
        )

    sets = save(packs.groupBy("pack").cogroup(known.groupBy("pack")).applyInArrow(survivors, SETS_SCHEMA), f"{folder}/sets")
    remove(spark, f"{folder}/packs")
    remove(spark, f"{folder}/known")

    name = ["n", "d1", "d2"]
    filled = sets.where("n > 0")
    classes = filled.groupBy(name).agg(F.min("doc_id").alias("rep"))
    one = filled.where("shared is not null").dropDuplicates(name)
    # classes are numbered when they are written, as ids may be null or repeat
    live = one.select(F.monotonically_increasing_id().alias("key"), *name, F.expr("cast(n - own as int)").alias("s"), "shared", "prefix", "others")
    live = save(live, f"{folder}/live")
    labels = few(_labels(live, percent, folder)).withColumnRenamed("node", "key")
    grouped = save(classes.join(live.select("key", *name).join(labels, "key").drop("key"), name, "left"), f"{folder}/grouped")
    least = save(grouped.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")), f"{folder}/least")
    final = grouped.join(few(least), "component", "left").select(*name, F.coalesce("least", "rep").alias("component_id"))
    texts = filled.select("doc_id", *name).join(final, name).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return texts.unionByName(empty)


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, c``: components after more ``links(a, b)``: only what they join is looked at, by its label, which is its smallest node."""
    if labels is None:
        return connected_components(links).withColumnRenamed("component", "c")
    own = labels.select("node", "c")
    of = few(own)
    for end in ("a", "b"):
        links = links.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    above = connected_components(links.where("a <> b"))
    fresh = above.select("node", F.col("node").alias("c")).join(own.select("node"), "node", "left_anti")
    above = above.select(F.col("node").alias("c"), "component")
    return own.unionByName(fresh).join(few(above), "c", "left").select("node", F.coalesce("component", "c").alias("c"))


def _labels(live: DataFrame, percent: int, folder: str) -> DataFrame:
    """``node, component`` of the classes that link with any, written."""
    spark, columns = live.sparkSession, ("token", "key", "n", "rest")
    # unshared shingles come first in each order, so a shared one's rank starts behind them
    postings = live.select("key", F.col("n").cast("int").alias("n"), "s", F.posexplode("prefix").alias("at", "token"))
    postings, n_postings = save_counting(postings.select("token", "key", "n", (F.col("s") - F.col("at")).alias("rest")), f"{folder}/open", F.lit(True))
    prefixes, whole = live.select("key", "n", "s", "others"), live.select("key", "n", "shared")
    meets = F.expr(f"{_overlap(percent, 'n_a', 'n_b')} <= least(rest_a, rest_b)")  # includes that the sizes fit
    labels, linked, before = None, 1, f"{folder}/open"

    def side(rows: DataFrame, name: str, token: str, *more: str) -> DataFrame:
        return rows.select(F.col("token").alias(token), F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("rest").alias(f"rest_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in more])

    for k in range(len(CENTRES) + 1):
        at = postings.withColumns({"component": F.col("key"), "mates": F.lit(1).cast("long")})
        if labels is not None:
            at = postings.join(few(labels), F.col("key") == F.col("node"), "left").select(*columns, F.coalesce("c", "key").alias("component"), F.coalesce("mates", F.lit(1).cast("long")).alias("mates"))
        # a posting whose sets are in one component needs nothing more, now and later
        main = F.max(F.struct("mates", F.xxhash64(F.lit(k), "component").alias("turn"), "component"))
        tokens = at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), main.alias("main"), F.count(F.lit(1)).alias("held"))
        tokens = tokens.where("low < high").select("token", F.col("main.component").alias("main"), F.col("main.mates").alias("size"), "held")
        # of two sets that lie in different components, one at least is outside the main one
        seen, left = Observation(), F.sum(F.when(F.col("component") != F.col("main"), F.col("held")))
        at = save(at.drop("mates").join(tokens, "token").observe(seen, left.alias("pairs")), f"{folder}/open{k}")
        last = k == len(CENTRES) or not linked or (seen.get["pairs"] or 0) <= LEFT_PAIRS * n_postings
        remove(spark, before)
        postings, before = at.select(*columns), f"{folder}/open{k}"
        if not last:
            # centres of a posting: about so many sets of its largest component, chosen by a hash of this round
            n_centres = CENTRES[k]
            x = at.where((F.col("component") == F.col("main")) & (F.pmod(F.xxhash64(F.lit(-k), "key"), F.col("size")) < n_centres))
            y = at.where("component <> main")
            # each other set is compared with those of which it meets most shingles
            met = side(x, "a", "t").join(side(y, "b", "token"), (F.col("t") == F.col("token")) & meets).groupBy("b", "a").agg(F.count(F.lit(1)).alias("met"))
            best = F.slice(F.sort_array(F.collect_list(F.struct("met", F.xxhash64(F.lit(k), "a", "b").alias("chance"), "a")), asc=False), 1, max(2, n_centres))
            pairs = met.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")
        else:
            ordered = F.expr("component_a <> component_b and (n_a < n_b or n_a = n_b and a < b)")
            pairs = side(at, "a", "t", "component").join(side(at, "b", "token", "component"), (F.col("t") == F.col("token")) & ordered & meets).select("a", "b").distinct()
        pairs, total = save_counting(pairs, f"{folder}/tries{k}", F.lit(True))
        # many pairs are cut by all orders before any set is fetched; with few centres blocks go by the other sets
        if total > FEW_PAIRS:
            pairs, total = _by_blocks(pairs, total, prefixes, _meets_in_all_orders(percent), f"{folder}/passed{k}", both=last)
        now, linked = _by_blocks(pairs, total, whole, _verify(percent), f"{folder}/links{k}", both=last)
        if linked:
            labels = save(_joined(labels, now), f"{folder}/joins{k}")
        if last:
            return (spark.createDataFrame([], "node long, c long") if labels is None else labels).select("node", F.col("c").alias("component"))
        if linked:
            mates = labels.groupBy("c").agg(F.count(F.lit(1)).alias("mates"))
            labels = save(labels.join(F.broadcast(mates) if labels.count() <= BROADCAST_ROWS else mates, "c"), f"{folder}/stars{k}")
