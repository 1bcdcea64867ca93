"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is a bigram model over words, in which a word that repeats the one
before becomes one mark.  It knows the words that most trusted texts hold; all
others are one unknown word, spelled by a trigram model over the bytes of the
trusted words.  Contexts and single words are tables of at most 2**16 rows,
byte trigrams are at most 2**24; they go to the tasks.  The bigram counts grow
with the trusted text and never leave their shards: packs of documents send
each shard their distinct bigrams, the shard joins them to its counts, and the
packs sum log probabilities by text.

A trusted text is judged without its own counts, so it costs what a text
costs that the model has not seen.  A document is kept if its perplexity a
byte lies within the quantiles that trusted documents of its language show.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand, expand_sorted, few, give_back, remove, save, scratch, shards, squeeze, squeeze_sorted

#: Begin and end of a word when it is spelled.
BEGIN, END = b"\x02", b"\x03"
#: Numbers of the unknown word, of a repeated word, of the begin of a text, and of the first known word.
UNKNOWN, REPEATED, START, FIRST = range(4)
#: Words that the model knows: those of most trusted texts, of two at least, and of so many bytes at most.
VOCABULARY, LEAST_TEXTS, WORD_BYTES = (1 << 16) - FIRST, 2, 64
#: Share of trusted documents that a language's thresholds leave outside, at the low and at the high end.
LOW, HIGH = 0.001, 0.995
#: Bytes of the trusted average that each document's mean starts from, so that very short texts stay near it.
PRIOR = 100
#: Thresholds are widened by this factor of perplexity.
SLACK = 1.05
#: Words of a pack, and of what is numbered at once; different words that a task holds.
PACK_WORDS, PIECE_WORDS, HELD = 2_000_000, 200_000, 400_000
#: Words of documents for which one shard stands; a heavier load is dealt over several shards.
HEAVY = 1_000_000
#: Bytes that a word of documents stands for in that.
WORD_BYTES_MEAN = 6


def trigrams(word: bytes) -> np.ndarray:
    x = np.frombuffer(BEGIN + BEGIN + word + END, np.uint8).astype(np.int32)
    return x[:-2] << 16 | x[1:-1] << 8 | x[2:]


def key_of(text_col: str) -> Column:
    """A 64-bit hash that names a text: copies are scored once and alike."""
    return F.xxhash64(F.col(text_col).cast("string"))


def word_types(texts: DataFrame) -> DataFrame:
    """``w, texts``: the different words of ``texts(text)`` and how many texts hold each."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                found.update(set((x.as_py() or b"").split()))
                if len(found) > HELD:
                    yield rows(found)
                    found.clear()
        yield rows(found)
        del found
        give_back()

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["w", "texts"])

    counted = texts.select(F.col("text").cast("binary")).mapInArrow(run, "w binary, texts long")
    return counted.groupBy("w").agg(F.sum("texts").alias("texts"))


def trigram_counts(types: DataFrame) -> DataFrame:
    """``g, n``: how many of the different words hold each trigram, once for each place."""

    def run(batches):
        found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            each = [trigrams(w.as_py()) for w in batch.column(0)]
            if each:
                all_of = np.concatenate((found[0], *each))
                n = np.concatenate((found[1], np.ones(len(all_of) - len(found[0]), np.int64)))
                g, at = np.unique(all_of, return_inverse=True)
                found = g, np.bincount(at, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1])], names=["g", "n"])

    return types.select("w").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three modified discounts from the numbers of n-grams seen once to four times."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def smoothed(counts: DataFrame, shift: int) -> DataFrame:
    """``g, ctx, term, spare``: the discounted share of each n-gram and what its context leaves to shorter ones."""
    n = counts.agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    d1, d2, d3 = discounts(*(float(x or 0) for x in n))
    off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    ctx = F.shiftright("g", shift)
    by = counts.withColumn("ctx", ctx).withColumn("off", off)
    sums = by.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("taken"))
    return by.join(sums, "ctx").select("g", "ctx", ((F.col("n") - F.col("off")) / F.col("total")).alias("term"), (F.col("taken") / F.col("total")).alias("spare"))


@dataclass
class Spelling:
    """A trigram model over bytes: dense below, sparse on top."""

    tri: tuple[np.ndarray, np.ndarray]
    spare: np.ndarray
    low: np.ndarray

    def costs(self, words: list[bytes]) -> np.ndarray:
        """What spelling each word costs, as negative log probabilities."""
        x = np.frombuffer(b"".join([BEGIN + BEGIN + w + END for w in words]), np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 3)
        g = np.zeros(len(x), np.int32)
        g[:-2] = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        p = self.spare[g >> 8] * self.low[g & 0xFFFF]
        if len(self.tri[0]):
            at = np.minimum(np.searchsorted(self.tri[0], g), len(self.tri[0]) - 1)
            p += np.where(self.tri[0][at] == g, self.tri[1][at], 0.0)
        each = -np.log(p)
        each[ends - 1] = each[ends - 2] = 0.0  # these reach into the next word
        return np.add.reduceat(each, np.concatenate(([0], ends[:-1])))


def spelling(types: DataFrame, folder: str) -> Spelling:
    """Kneser-Ney estimation over the different words: plain counts for trigrams, numbers of different predecessors below."""
    tri = save(trigram_counts(types), f"{folder}/trigrams")
    bi = save(tri.groupBy(F.col("g").bitwiseAND(0xFFFF).alias("g")).agg(F.count(F.lit(1)).alias("n")), f"{folder}/byte-bigrams")
    uni = bi.groupBy(F.col("g").bitwiseAND(0xFF).alias("g")).agg(F.count(F.lit(1)).alias("n"))

    def columns(counts, shift, contexts):
        rows = smoothed(counts, shift).orderBy("g").toArrow()  # 2**24 rows at most, and as many as trusted words have trigrams
        spare = np.ones(contexts)
        spare[rows["ctx"].to_numpy()] = rows["spare"].to_numpy()
        return rows["g"].to_numpy(), rows["term"].to_numpy(), spare

    g1, term1, spare1 = columns(uni, 8, 1)
    g2, term2, spare2 = columns(bi, 8, 1 << 8)
    g3, term3, spare3 = columns(tri, 8, 1 << 16)
    p1 = np.full(256, spare1[0] / 256)
    p1[g1] += term1
    p2 = (spare2[:, None] * p1).reshape(-1)
    p2[g2] += term2
    return Spelling((g3, term3), spare3, p2)


class Lexicon(dict):
    """Numbers the words of a task and keeps what the model needs of each: its number there, its cost if unknown, its length."""

    def __init__(self, known: dict[bytes, int], spell: Spelling | None):
        super().__init__()
        self.known, self.spell, self.new = known, spell, []
        self.ids, self.costs, self.lengths = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def learn(self) -> None:
        """Fill in what is new."""
        if self.new:
            ids = np.array([self.known.get(w, UNKNOWN) for w in self.new], np.int64)
            costs = self.spell.costs(self.new) if self.spell else np.zeros(len(ids))
            self.ids, self.costs = np.concatenate((self.ids, ids)), np.concatenate((self.costs, np.where(ids == UNKNOWN, costs, 0.0)))
            self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, self.new), np.int64, len(ids)) + 1))
            self.new = []

    def sequence(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Model numbers of all words of some texts, words a text, bytes a text, and what a text's unknown words cost."""
        n = np.array([len(t) for t in texts], np.int64)
        x = np.fromiter((k for t in texts for k in map(self.__getitem__, t)), np.int64, n.sum())
        self.learn()
        doc = np.repeat(np.arange(len(n)), n)
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == x[:-1]) & (doc[1:] == doc[:-1])
        ids = np.where(again, REPEATED, self.ids[x])
        size = np.where(again, 2, self.lengths[x])
        cost = np.where(again, 0.0, self.costs[x])
        return ids.astype(np.uint16), n, np.bincount(doc, size, len(n)).astype(np.int64), np.bincount(doc, cost, len(n))


def split_texts(batches, text: int):
    """Rows of ``batches`` in pieces of about PIECE_WORDS words: values of column 0, and words of the texts."""
    keys, some, size = [], [], 0
    for batch in batches:
        for key, x in zip(batch.column(0), batch.column(text)):
            some.append((x.as_py() or b"").split())
            keys.append(key.as_py() if text else 0)
            size += len(some[-1])
            if size > PIECE_WORDS:
                yield keys, some
                keys, some, size = [], [], 0
    if some:
        yield keys, some


def bigrams(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each word with the one before it in its text, or START."""
    before = np.empty(len(ids), np.uint32)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = START
    return before << np.uint32(16) | ids


KEYS = "shard int, pack long, keys binary, seen binary"
COUNTS = "shard int, keys binary, seen binary"


def shard_of(g: np.ndarray, n_shards: int) -> np.ndarray:
    return g.astype(np.int64) * 1_000_003 // 65_536 % n_shards


def dealt(g: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending bigrams by shard: their order, the shards, and where each shard begins in that order."""
    shard = shard_of(g, n_shards)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return order, shard[order][cut], cut


def squeeze_counts(n: np.ndarray) -> bytes:
    """Counts in four bytes each where that is enough, otherwise in eight."""
    return squeeze(n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64))


def expand_counts(data: bytes) -> np.ndarray:
    return expand(data, f"u{data[0]}").astype(np.int64)


def bigram_counts(texts: DataFrame, known, n_shards: int) -> DataFrame:
    """One row a shard with its bigrams of ``texts(text)`` and how often they occur; thinned within each task."""

    def run(batches):
        lexicon, held, size = Lexicon(known.value, None), [], 0

        def rows():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            order, shard, cut = dealt(g, n_shards)
            keys, seen = np.split(g[order], cut[1:]), np.split(n[order], cut[1:])
            columns = [pa.array(shard, pa.int32()), pa.array([squeeze_sorted(x) for x in keys], pa.binary()), pa.array([squeeze_counts(x) for x in seen], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "keys", "seen"])

        for _, some in split_texts(batches, 0):
            ids, n, *_ = lexicon.sequence(some)
            if len(lexicon) > HELD:
                lexicon = Lexicon(known.value, None)
            held.append(bigrams(ids, n))
            size += len(ids)
            if size > 2 * PACK_WORDS:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()
        del lexicon, held
        give_back()

    def add_up(table: pa.Table) -> pa.Table:
        g = np.concatenate([expand_sorted(x, np.uint32) for x in table.column("keys").to_pylist()])
        n = np.concatenate([expand_counts(x) for x in table.column("seen").to_pylist()])
        g, at = np.unique(g, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        return pa.table([table.column("shard")[:1], pa.array([squeeze_sorted(g)], pa.binary()), pa.array([squeeze_counts(n)], pa.binary())], names=["shard", "keys", "seen"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, COUNTS).groupBy("shard").applyInArrow(add_up, COUNTS)


def word_counts(counts: DataFrame) -> DataFrame:
    """For each known word ``w``: how often it is followed, by how many bigrams seen once, twice, three times, four times or more often, and how many words it follows."""
    names = ("total", "n1", "n2", "n3", "n4", "more", "before")

    def run(batches):
        found = np.zeros((len(names), 1 << 16), np.int64)
        for batch in batches:
            for keys, seen in zip(batch.column(0), batch.column(1)):
                g, n = expand_sorted(keys.as_py(), np.uint32), expand_counts(seen.as_py())
                b, c = g >> np.uint32(16), g & np.uint32(0xFFFF)
                found[0] += np.bincount(b, n, 1 << 16).astype(np.int64)
                for k in range(1, 6):
                    found[k] += np.bincount(b[n == k if k < 5 else n > 4], minlength=1 << 16)
                found[6] += np.bincount(c, minlength=1 << 16)
        some = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, found[:, some])], names=["w", *names])

    rows = counts.select("keys", "seen").mapInArrow(run, ", ".join(f"{c} long" for c in ("w", *names)))
    return rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in names])


@dataclass
class Words:
    """What the model knows of single words: arrays of 2**16 at most."""

    known: dict[bytes, int]
    spell: Spelling
    two: tuple[float, float, float]
    total: np.ndarray
    spare: np.ndarray
    p1: np.ndarray

    def cost(self, g: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Negative log probability of bigrams that the trusted texts hold so often."""
        b, c = g >> np.uint32(16), g & np.uint32(0xFFFF)
        less = np.array([0.0, *self.two])[np.clip(seen, 0, 3)]
        total = self.total[b]
        return -np.log(np.where(total > 0, np.maximum(seen - less, 0.0) / np.maximum(total, 1) + self.spare[b] * self.p1[c], self.p1[c]))


def known_words(types: DataFrame) -> dict[bytes, int]:
    got = types.where((F.col("texts") >= LEAST_TEXTS) & (F.octet_length("w") <= WORD_BYTES)).orderBy(F.desc("texts"), "w").limit(VOCABULARY)
    return {bytes(r.w): k for k, r in enumerate(got.select("w").collect(), FIRST)}  # VOCABULARY rows at most


def single_words(counts: DataFrame, known: dict, spell: Spelling) -> Words:
    """Kneser-Ney estimation of contexts and single words from the bigram counts."""
    rows = word_counts(counts).toArrow()  # 2**16 rows at most
    w, seen = rows["w"].to_numpy(), np.stack([rows[c].to_numpy().astype(float) for c in ("n1", "n2", "n3", "n4")], 1)
    two = discounts(*seen.sum(0))
    total, spare = np.zeros(1 << 16), np.ones(1 << 16)
    followed = rows["total"].to_numpy().astype(float)
    taken = seen[:, 0] * two[0] + seen[:, 1] * two[1] + (seen[:, 2] + seen[:, 3] + rows["more"].to_numpy()) * two[2]
    total[w], spare[w] = followed, np.where(followed > 0, taken / np.maximum(followed, 1), 1.0)
    n = rows["before"].to_numpy()
    one = discounts(*(float((n == k).sum()) for k in (1, 2, 3, 4)))
    less = np.array([0.0, *one])[np.clip(n, 0, 3)]
    p1 = np.full(1 << 16, (less.sum() / n.sum() if n.sum() else 1.0) / (FIRST + len(known)))
    p1[w] += (n - less) / max(n.sum(), 1)
    return Words(known, spell, two, total, spare, p1)


PACK = "pack long, keys array<long>, n array<long>, size array<long>, spell array<double>, body binary"


def number_packs(docs: DataFrame, words) -> DataFrame:
    """The texts of ``docs(key, text)`` as numbers of the model's words, in packs of about PACK_WORDS words; no shuffle."""

    def run(batches):
        part, seq, model = TaskContext.get().partitionId(), 0, words.value
        lexicon, held, size = Lexicon(model.known, model.spell), [], 0

        def row():
            keys = np.concatenate([np.array(k, np.int64) for k, _ in held])
            ids, n, length, spell = (np.concatenate(x) for x in zip(*(got for _, got in held)))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64())]
                + [pa.array([x], pa.list_(t)) for x, t in ((keys, pa.int64()), (n, pa.int64()), (length, pa.int64()), (spell, pa.float64()))]
                + [pa.array([squeeze(ids)], pa.binary())],
                names=["pack", "keys", "n", "size", "spell", "body"],
            )

        for keys, some in split_texts(batches, 1):
            got = lexicon.sequence(some)
            if len(lexicon) > HELD:
                lexicon = Lexicon(model.known, model.spell)
            if size and size + len(got[0]) > PACK_WORDS:
                yield row()
                seq, held, size = seq + 1, [], 0
            held.append((keys, got))
            size += len(got[0])
        if held:
            yield row()
        del lexicon, held
        give_back()

    return docs.select("key", F.col("text").cast("binary")).mapInArrow(run, PACK)


def text_costs(docs: DataFrame, good: DataFrame, n_shards: int, folder: str) -> DataFrame:
    """``key, size, cost, own`` of the different texts of ``docs(key, text)``: what each costs, and without its own counts."""
    context = docs.sparkSession.sparkContext
    types = save(word_types(good), f"{folder}/types")
    known = known_words(types)
    shared = context.broadcast(known)
    counts = save(bigram_counts(good, shared, n_shards), f"{folder}/bigram-counts", compression="none")
    shared.destroy()
    words = context.broadcast(single_words(counts, known, spelling(types, folder)))
    packs = save(number_packs(docs, words), f"{folder}/packs", compression="none")

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not sum(row["n"]):
                    continue
                g = np.unique(bigrams(expand(row["body"], np.uint16), np.array(row["n"], np.int64)))
                order, shard, cut = dealt(g, n_shards)
                own = [squeeze_sorted(x) for x in np.split(g[order], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array([row["pack"]] * len(cut), pa.int64()), pa.array(own, pa.binary())],
                    names=["shard", "pack", "keys"],
                )

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of the bigrams that packs have sent; unseen ones get no answer."""
        out = []
        if right.num_rows:
            g, n = expand_sorted(right.column("keys")[0].as_py(), np.uint32), expand_counts(right.column("seen")[0].as_py())
            for row in left.to_pylist():
                own = expand_sorted(row["keys"], np.uint32)
                at = np.minimum(np.searchsorted(g, own), len(g) - 1)
                hit = g[at] == own
                if hit.any():
                    out.append((row["shard"], row["pack"], squeeze_sorted(own[hit]), squeeze_counts(n[at[hit]])))
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "pack", "keys", "seen"])

    sent = packs.select("pack", "n", "body").mapInArrow(send, "shard int, pack long, keys binary")
    answers = sent.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(join, KEYS)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        row, model = left.to_pylist()[0], words.value
        n = np.array(row["n"], np.int64)
        cost, own = np.array(row["spell"]), np.array(row["spell"])
        if n.sum():
            g = bigrams(expand(row["body"], np.uint16), n)
            keys = np.concatenate([np.zeros(0, np.uint32), *(expand_sorted(x, np.uint32) for x in right.column("keys").to_pylist())])
            seen = np.concatenate([np.zeros(0, np.int64), *(expand_counts(x) for x in right.column("seen").to_pylist())])
            order = np.argsort(keys)
            keys, seen = np.append(keys[order], np.uint32(0xFFFFFFFF)), np.append(seen[order], 0)
            # different bigrams of each text, with how often it has them
            doc = np.repeat(np.arange(len(n)), n).astype(np.uint64)
            pairs, times = np.unique(doc << np.uint64(32) | g, return_counts=True)
            doc, g = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.searchsorted(keys[:-1], g)
            here = np.where(keys[at] == g, seen[at], 0)
            cost = cost + np.bincount(doc, times * model.cost(g, here), len(n))
            own = own + np.bincount(doc, times * model.cost(g, np.maximum(here - times, 0)), len(n))
            del g, keys, seen, order, doc, pairs, times, at, here
            give_back()
        return pa.table(
            [pa.array(row["keys"], pa.int64()), pa.array(row["size"], pa.int64()), pa.array(cost), pa.array(own)], names=["key", "size", "cost", "own"]
        )

    costs = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(sums, "key long, size long, cost double, own double")
    costs = save(costs.where("size > 0").dropDuplicates(["key"]), f"{folder}/costs")
    words.destroy()
    for name in ("packs", "bigram-counts", "types"):
        remove(docs.sparkSession, f"{folder}/{name}")
    return costs


@dataclass
class Classifier:
    """Scores of the texts and thresholds by language."""

    scored: DataFrame
    limits: DataFrame
    default: tuple[float, float]
    small: bool = True

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score_key`` and ``score_lang``, and ``log_ppl, low, high, kept`` of each; their other columns have to be one struct."""
        scored = few(self.scored).withColumnRenamed("key", "score_key")
        limits = self.limits.withColumnRenamed("lang", "limit_lang")
        joined = rows.join(scored, "score_key", "left")
        joined = joined.join(F.broadcast(limits) if self.small else limits, F.col("score_lang").eqNullSafe(F.col("limit_lang")), "left").drop("limit_lang")
        low, high = F.coalesce("low", F.lit(self.default[0])), F.coalesce("high", F.lit(self.default[1]))
        kept: Column = F.coalesce(F.col("log_ppl").between(low, high), F.lit(False))
        return joined.withColumn("kept", kept).withColumns({"low": low, "high": high})


#: Languages up to which the thresholds are broadcast; beyond, they are joined by shuffling.
BROADCAST_LANGUAGES = 10_000


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    low: float = LOW,
    high: float = HIGH,
    slack: float = SLACK,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Classifier:
    """Train on all documents of ``docs`` whose label has quality 1.

    The thresholds of a language are the ``low`` and ``high`` quantiles of
    trusted documents' log perplexity, moved outwards by log(slack).  A
    language without trusted documents gets the quantiles of all of them.
    Without any trusted document, every text is kept.  Null languages are one
    language.  Null and empty texts have no perplexity and are not kept.
    """
    folder = scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), key_of(text_col).alias("key"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = save(rows.select("doc_id", "lang", "key").join(good, "doc_id", "left_semi"), f"{folder}/trusted")
    once = save(trusted.groupBy("key").agg(F.min("doc_id").alias("doc_id")), f"{folder}/trusted-once")
    texts = rows.select("doc_id", "key", "text").join(few(once), ["key", "doc_id"], "left_semi").select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    costs = text_costs(rows.select("key", "text"), texts, shards(size, HEAVY * WORD_BYTES_MEAN, 64), folder).join(once.select("key", F.lit(True).alias("trusted")), "key", "left")
    costs = save(costs.select("key", "size", F.when(F.col("trusted"), F.col("own")).otherwise(F.col("cost")).alias("cost"), "trusted"), f"{folder}/judged")
    spent, length = costs.where("trusted").agg(F.sum("cost"), F.sum("size")).first()
    prior = PRIOR * spent / length if length else 0.0
    scored = save(costs.select("key", ((F.col("cost") + prior) / (F.col("size") + PRIOR)).alias("log_ppl")), f"{folder}/scores")
    seen = trusted.select("lang", "key").join(scored, "key").select("lang", "log_ppl")
    wide = float(np.log(slack))
    quantile = [
        (F.percentile_approx("log_ppl", low, 10000) - wide).alias("low"),
        (F.percentile_approx("log_ppl", high, 10000) + wide).alias("high"),
    ]
    limits = save(seen.groupBy("lang").agg(*quantile), f"{folder}/limits")
    every = seen.agg(*quantile).first()
    default = (float("-inf"), float("inf")) if every.low is None else (every.low, every.high)
    return Classifier(scored, limits, default, limits.count() <= BROADCAST_LANGUAGES)


def judged_rows(docs: DataFrame, labels: DataFrame, options: dict) -> DataFrame:
    text_col, lang_col = options.get("text_col", "text"), options.get("lang_col", "lang")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_of(text_col).alias("score_key"), F.col(lang_col).cast("string").alias("score_lang"))
    return fit(docs, labels, **options).judged(rows)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, lang, perplexity, low, high, kept`` of each row of ``docs``.

    See fit() for the options and for nulls.  Repeated rows are scored alike,
    an empty table gives an empty result, other columns are ignored.
    """
    id_col = options.get("id_col", "doc_id")
    narrow = [id_col, options.get("lang_col", "lang"), options.get("text_col", "text")]
    return judged_rows(docs.select(*narrow), labels, options).select(
        F.col("row")[id_col].alias("doc_id"), F.col("score_lang").alias("lang"), F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names."""
    return judged_rows(docs, labels, options).where("kept").select("row.*")
