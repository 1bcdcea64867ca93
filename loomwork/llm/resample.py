"""Importance resampling towards a target corpus over hashed word n-grams.

Packs of documents count their features (runs of one to three words) by hashed
bucket and send, for each shard of buckets, postings (bucket, document, count).
In a shard the postings of the documents meet the counts of both corpora for
the same buckets; each bucket's gain is worked out there, and what the shard
adds to each document goes back to the pack, where it is summed.  Gumbel noise
made of the document's id turns weights into a draw without replacement.
"""

from __future__ import annotations

import itertools
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expand, save, scratch, shards, squeeze
from .fill_middle import hash_part

#: Words and documents of a pack, buckets of a shard, packs that meet in one group of a shard, bytes read at a time.
PACK_WORDS, PACK_DOCS, SHARD_BUCKETS, GROUP_PACKS, SLICE = 400_000, 1 << 14, 100, 64, 1 << 20
#: A-Z in lower case; every ASCII character but letters and digits parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PACKS = (
    "pack long, shard int, sums array<long>, sizes binary, docs binary, counts binary, "
    "ids array<long>, n_words array<long>, n_features array<long>"
)
ADDED = "pack long, shard int, added binary"
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def feature_counts(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The buckets of a text's features in ascending order, how often each occurs, words and features.

    The checksum of a longer feature goes on from that of its beginning, so
    each word is read three times.  Long texts are read in slices that end
    between words; the last checksums go into the next slice.
    """
    plain, at = raw.translate(TABLE), 0
    total, n_words, n_features = np.zeros(buckets, np.int64), 0, 0
    last: list[list[int]] = [[], []]  # checksums of the last word and of the last two words
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        words = plain[at : end if end >= 0 else len(plain)].split()
        at = end if end >= 0 else len(plain)
        if not words:
            continue
        more = [b" " + w for w in words]
        ones = list(map(crc32, words))
        before = last[0] + ones[:-1]
        twos = list(map(crc32, more[len(words) - len(before) :], before))
        before = last[1] + twos[:-1]
        threes = list(map(crc32, more[len(words) - len(before) :], before))
        found = np.fromiter(itertools.chain(ones, twos, threes), np.int64, len(ones) + len(twos) + len(threes))
        total += np.bincount(found % buckets, minlength=buckets)
        n_words, n_features = n_words + len(words), n_features + len(found)
        last = [ones[-1:], twos[-1:]]
    at = np.flatnonzero(total)
    return at, total[at], n_words, n_features


def feature_packs(docs: DataFrame, *, id_col: str | None, text_col: str, buckets: int, pack_words: int, postings: bool = True) -> DataFrame:
    """A row for each pack and shard that has features, and one for each pack with ids and sizes (no shard)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, words, features, found = [], [], [], []

        def rows():
            pack = part << 32 | seq
            yield pack_row(pack, ids=ids, n_words=words, n_features=features)
            bucket, count = (np.concatenate(x) for x in zip(*found))
            doc = np.repeat(np.arange(len(found), dtype=np.uint16), [len(at) for at, _ in found])
            sums = np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
            bucket, doc, count = bucket[order], doc[order], count[order]
            cuts = np.searchsorted(bucket, np.arange(0, buckets + SHARD_BUCKETS, SHARD_BUCKETS))
            for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    low = shard * SHARD_BUCKETS
                    own = sums[low : low + SHARD_BUCKETS]
                    if not postings:
                        yield pack_row(pack, shard=shard, sums=own.tolist())
                        continue
                    sizes = np.bincount(bucket[a:b] - low, minlength=len(own)).astype(np.uint32)
                    steps = np.diff(doc[a:b], prepend=doc.dtype.type(0))  # modulo 2**16
                    yield pack_row(pack, shard=shard, sums=own.tolist(), sizes=squeeze(sizes), docs=squeeze(steps), counts=squeeze(count[a:b].astype(np.uint32)))

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, n, n_words, n_features = feature_counts(raw.as_py() or b"", buckets)
                if ids and (sum_words + n_words > pack_words or len(ids) >= PACK_DOCS):
                    yield pa.RecordBatch.from_pylist(list(rows()), schema=ARROW_PACKS)
                    seq, ids, words, features, found = seq + 1, [], [], [], []
                sum_words = n_words + (sum_words if ids else 0)
                ids.append(key)
                words.append(n_words)
                features.append(n_features)
                found.append((at, n))
        if ids:
            yield pa.RecordBatch.from_pylist(list(rows()), schema=ARROW_PACKS)

    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(key.alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, PACKS)


def pack_row(pack: int, **values) -> dict:
    return dict.fromkeys(ARROW_PACKS.names) | {"pack": pack} | values


def summed(packs: DataFrame) -> DataFrame:
    """``shard, at, n``: occurrences of each bucket, partial sums before the shuffle."""
    return packs.where("shard is not null").select("shard", F.posexplode("sums").alias("at", "n")).groupBy("shard", "at").agg(F.sum("n").alias("n"))


def bucket_gains(s: list[int], t: list[int], all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of two smoothed frequencies, rounded down."""
    ratios = (float(y + 1) * float(all_s + buckets) / (float(x + 1) * float(all_t + buckets)) for x, y in zip(s, t))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def document_weights(
    docs: DataFrame,
    target: DataFrame,
    *,
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    pack_words: int = PACK_WORDS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of a document's features."""
    spark = docs.sparkSession
    packs = save(feature_packs(docs, id_col=id_col, text_col=text_col, buckets=buckets, pack_words=pack_words), f"{scratch(spark)}/postings", compression="none")
    goal = feature_packs(target, id_col=None, text_col=target_col, buckets=buckets, pack_words=pack_words, postings=False)
    # at most ``buckets`` rows, whatever the corpora hold
    both = summed(packs).withColumnRenamed("n", "s").join(summed(goal).withColumnRenamed("n", "t"), ["shard", "at"], "full")
    sums = save(both.select("shard", "at", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), f"{scratch(spark)}/sums")
    all_s, all_t = (int(x or 0) for x in sums.agg(F.sum("s"), F.sum("t")).first())
    # a shard's postings grow with the corpus, so packs are dealt to as many groups of it as they need
    salts = shards(packs.where("shard is null").count(), GROUP_PACKS)
    sent = packs.where("shard is not null").select("pack", "shard", "sizes", "docs", "counts").withColumn("salt", F.pmod(F.xxhash64("pack"), F.lit(salts)))
    near = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        gains = np.zeros(SHARD_BUCKETS, np.int64)
        at, s, t = (right.column(x).to_pylist() for x in ("at", "s", "t"))
        gains[at] = bucket_gains(s, t, all_s, all_t, buckets)
        rows = []
        for row in left.to_pylist():
            doc = np.cumsum(expand(row["docs"], np.uint16), dtype=np.uint16).astype(np.int64)
            sizes, counts = expand(row["sizes"], np.uint32), expand(row["counts"], np.uint32).astype(np.int64)
            total = np.zeros(int(doc.max()) + 1, np.int64)
            np.add.at(total, doc, np.repeat(gains[: len(sizes)], sizes) * counts)
            rows.append({"pack": row["pack"], "shard": row["shard"], "added": squeeze(total)})
        return pa.Table.from_pylist(rows, schema=ARROW_ADDED)

    added = sent.groupBy("shard", "salt").cogroup(near.groupBy("shard", "salt")).applyInArrow(add_up, ADDED)

    def total_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        weight = np.zeros(len(row["ids"]), np.int64)
        for data in right.column("added"):
            part = expand(data.as_py(), np.int64)
            weight[: len(part)] += part
        columns = (row["ids"], row["n_words"], row["n_features"], weight)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight"])

    heads = packs.where("shard is null").select("pack", "ids", "n_words", "n_features")
    return heads.groupBy("pack").cogroup(added.groupBy("pack")).applyInArrow(total_up, WEIGHTS)


def gumbel(seed: int, key: Column) -> Column:
    """Thousandths of a Gumbel variate made of ``seed`` and ``key``, rounded down."""
    share = (hash_part(seed, key, 1).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    pack_words: int = PACK_WORDS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``.

    ``percent`` of the documents with at least ``least_words`` words are drawn:
    those of the highest scores, ties to the smaller id; they have ranks from 1,
    others null.  Null texts have no words and no features, so weight 0.  A null
    id is hashed as an empty string and loses ties.  Repeated rows are rows of
    their own and rank next to each other.  An empty target is one without
    features; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    weights = document_weights(docs, target, buckets=buckets, id_col=id_col, text_col=text_col, target_col=target_col, pack_words=pack_words)
    scored = save(weights.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))), f"{scratch(spark)}/scores")
    able, order = F.col("n_words") >= least_words, (F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = scored.where(able).count() * percent // 100
    # ranges of scores, numbered within each, go on from the rows of the ranges before
    tie = F.xxhash64("n_words", "n_features", F.monotonically_increasing_id())
    ranges = scored.where(able).withColumn("tie", tie).repartitionByRange(*order, "tie").withColumn("part", F.spark_partition_id())
    ranges = save(ranges, f"{scratch(spark)}/ranges")
    sizes = ranges.groupBy("part").count()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order, "tie"))
    ranked = ranges.withColumn("place", place).join(F.broadcast(sizes), "part").withColumn("rank", F.col("place") + F.col("before"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))


ARROW_PACKS = pa.schema(
    [
        ("pack", pa.int64()),
        ("shard", pa.int32()),
        ("sums", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
        ("docs", pa.binary()),
        ("counts", pa.binary()),
        *[(name, pa.list_(pa.int64())) for name in ("ids", "n_words", "n_features")],
    ]
)
ARROW_ADDED = pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("added", pa.binary())])
