"""Toxicity by a weighted finite-state pattern grammar.

The lexical transducer maps words to classes: insult, threat, target, negation,
reported speech.  Three transducers over the classes of a clause rewrite its
insults and threats: what a negation reaches is negated, what follows a verb of
saying is reported, what a target reaches is targeted.  They are composed into
one machine that reads a clause forwards; targets that stand behind are found
by the target transducer alone, which reads what came out backwards.  Each arc
carries the kind of match that it makes, and the kinds' weights are learned: a
document's score is a logistic function of its weighted matches, so a word
alone counts less than a clause that throws it at somebody, and one that is
denied or quoted counts less still.

Besides the fixed words below, the insult class holds words and word beginnings
learned from labelled rows; the weights of the match kinds are learned, too.
Labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, scratch

# Fixed word lists of the grammar, in English, German, French and Spanish.
THREATS = frozenset(
    "kill kills killed hurt hurts destroy destroys beat beats punch shoot stab burn crush strangle smash töte töten tötet umbringen schlagen verletzen erschießen tuer tue tuerai frapper blesser détruire matar mato mataré golpear herir destruir".split()
)
TARGETS = frozenset(
    "you your yours u he she him her they them their we us this these du dich dein ihr euch tu toi ton vous votre il elle ils tú te usted ustedes él ella ellos".split()
)
NEGATIONS = frozenset(
    "not no never nobody none isn't aren't don't doesn't didn't wasn't weren't won't can't nicht kein keine keinen nie niemals niemand ne pas jamais aucun aucune personne nunca nadie ningún ninguna tampoco jamás".split()
)
REPORTS = frozenset(
    "said says say saying called calls quoted quotes wrote writes reported told claimed claims sagte sagt sagen schrieb behauptete zitierte nannte dit disait écrit écrivait affirme dijo dice decía escribió afirmó".split()
)
INSULTS = frozenset("idiot idiots moron morons imbecile cretin dummkopf trottel blödmann crétin imbécile débile estúpido imbécil cretino".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Marks beside a word's class: a clause ends behind it; it ends unless it reports, so that what is said belongs to it; a quotation begins with it.
CLAUSE_END, REPORT_END, OPENING = 8, 16, 32
#: Kinds of match; the features of a document are log(1 + number) of each, and of all matches a hundred words.
KINDS = ("insult", "targeted insult", "threat", "targeted threat", "negated", "reported")
#: Words over which a negation or a target reaches.
REACH = 3
#: Bound of the labelled rows that learn; how much likelier a learned entry is in toxic documents; how many hold it at least.
SAMPLE_ROWS, LIKELIER, LEAST_DOCS = 20_000, 8.0, 4
#: Odds, as an exponent of e, against any entry being learned by chance.
SURE = 3.0
#: Lengths of learned word beginnings; most entries that are learned.
BEGINNINGS, MOST_ENTRIES = (4, 5, 6), 5_000
#: Weights where labels of both kinds are missing: bias, then KINDS, then density.
DEFAULT = (-3.0, 1.5, 2.5, 1.5, 2.5, -0.5, -0.5, 0.5)

OPENINGS = "\"'«“„"
PUNCTUATION = ".,;:!?\"'()[]{}|*#-«»“”„…¡¿"


class Words(dict):
    """The lexical transducer: a raw word to its class, with a mark if a clause ends behind it."""

    def __init__(self, words: frozenset, starts: frozenset):
        self.words, self.starts = words, starts

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = raw.strip(PUNCTUATION)
        if word in self.words or any(word[:n] in self.starts for n in BEGINNINGS if len(word) >= n):
            code = INSULT
        else:
            code = next((k for k, own in ((THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS)) if word in own), OTHER)
        self[raw] = code = code | (CLAUSE_END if raw[-1] in ".,;!?…" else REPORT_END if raw[-1] == ":" else 0) | OPENING * (raw[0] in OPENINGS)
        return code


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine: ``arcs[state, symbol]`` is the next state, the symbol written, and the kind of match made or None.

    A symbol without an arc is copied, and the state stays.
    """

    start: Hashable
    arcs: dict

    def step(self, state, symbol: int):
        return self.arcs.get((state, symbol), (state, symbol, None))

    def run(self, symbols: list[int]) -> list[int]:
        state, out = self.start, []
        for symbol in symbols:
            state, written, _ = self.step(state, symbol)
            out.append(written)
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does at once what ``second`` does to the output of ``first``; only states that can be reached."""
    start, arcs = (first.start, second.start), {}
    todo, seen = [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in SYMBOLS:
            next_a, between, made = first.step(a, symbol)
            next_b, written, more = second.step(b, between)
            after = next_a, next_b
            arcs[state, symbol] = after, written, made if more is None else more
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, arcs)


def within_reach(trigger: int, rewrites: dict[int, int]) -> Transducer:
    """For REACH words behind ``trigger``, symbols are rewritten; another trigger begins anew.  States count the words left."""
    arcs = {}
    for left in range(REACH + 1):
        for symbol in SYMBOLS:
            written = rewrites.get(symbol, symbol) if left else symbol
            arcs[left, symbol] = (REACH if symbol == trigger else max(0, left - 1), written, MADE.get(written))
    return Transducer(0, arcs)


def from_here(trigger: int, rewrites: dict[int, int]) -> Transducer:
    """Behind ``trigger``, symbols are rewritten up to the end of the clause."""
    arcs = {(k, symbol): (1 if k or symbol == trigger else 0, (written := rewrites.get(symbol, symbol) if k else symbol), MADE.get(written)) for k in (0, 1) for symbol in SYMBOLS}
    return Transducer(0, arcs)


#: Symbols that the machines write instead of an insult or threat, and the kind of match that each symbol makes.
AIMED_INSULT, AIMED_THREAT, DENIED, REPORTED = range(6, 10)
SYMBOLS = range(10)
MADE = {INSULT: 0, AIMED_INSULT: 1, THREAT: 2, AIMED_THREAT: 3, DENIED: 4, REPORTED: 5}
NEGATION_MACHINE = within_reach(NEGATION, {INSULT: DENIED, THREAT: DENIED})
REPORT_MACHINE = from_here(REPORT, {INSULT: REPORTED, THREAT: REPORTED, DENIED: REPORTED})
TARGET_MACHINE = within_reach(TARGET, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT})
#: A clause is read forwards by all three at once.
CLAUSE_MACHINE = compose(compose(NEGATION_MACHINE, REPORT_MACHINE), TARGET_MACHINE)


def clause_numbers(codes: np.ndarray) -> np.ndarray:
    """The number of each word's clause.

    A clause ends behind a mark.  One with a verb of saying goes on behind a
    colon, and behind a comma or other mark before a quotation.
    """
    ends = (codes & (CLAUSE_END | REPORT_END)) > 0
    if (codes & 7 == REPORT).any():
        begin = 0
        for k in np.flatnonzero(ends).tolist():
            goes_on = codes[k] & REPORT_END or (k + 1 < len(codes) and codes[k + 1] & OPENING)
            if goes_on and (codes[begin : k + 1] & 7 == REPORT).any():
                ends[k] = False
            else:
                begin = k + 1
    return np.concatenate(([0], np.cumsum(ends)[:-1])) if len(codes) else np.zeros(0, np.int64)


def matches(codes) -> Counter:
    """Kinds of match in a document, clause by clause."""
    codes = np.asarray(codes, np.uint8)
    found: Counter = Counter()
    symbols, number = codes & 7, clause_numbers(codes)
    hits = np.unique(number[(symbols == INSULT) | (symbols == THREAT)])  # only clauses with an insult or threat are run
    for a, b in zip(np.searchsorted(number, hits), np.searchsorted(number, hits, side="right")):
        state = TARGET_MACHINE.start
        for symbol in reversed(CLAUSE_MACHINE.run(symbols[a:b].tolist())):
            state, _, made = TARGET_MACHINE.step(state, symbol)
            if made is not None:
                found[made] += 1
    return found


def features(text: str | None, words: Words) -> list[float]:
    raw = (text or "").lower().split()
    codes = np.fromiter(map(words.__getitem__, raw), np.uint8, len(raw))
    hits = np.count_nonzero((codes & 7 == INSULT) | (codes & 7 == THREAT))
    if not hits:
        return [0.0] * (len(KINDS) + 1)
    found = matches(codes)
    return [*(float(np.log1p(found[k])) for k in range(len(KINDS))), float(np.log1p(100 * hits / len(raw)))]


@dataclass
class Grammar:
    """Learned entries of the insult class, and weights."""

    words: frozenset = INSULTS
    starts: frozenset = frozenset()
    weights: tuple = DEFAULT
    cache: Words | None = field(default=None, repr=False, compare=False)

    def features(self, text: str | None) -> list[float]:
        if self.cache is None:
            self.cache = Words(self.words, self.starts)
        return features(text, self.cache)

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learning_rows(docs: DataFrame, labels: DataFrame, bound: int, *, id_col: str, text_col: str) -> DataFrame:
    """``text, toxic`` of at most about ``bound`` labelled documents with different texts, chosen by a hash of the id; any toxic label of a text counts."""
    key = F.col("doc_id").cast("string")
    own = (
        labels.where(F.col("toxic").isNotNull() & (F.crc32(key.cast("binary")) % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, bound / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(own), "label_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn_entries(rows: DataFrame) -> tuple[frozenset, frozenset]:
    """Words, and beginnings of words, that toxic documents hold far more often."""

    def run(batches):
        bad, good, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own = {w.strip(PUNCTUATION) for w in (text or "").lower().split()}
                entries = {f"={w}" for w in own} | {w[:k] for w in own for k in BEGINNINGS if len(w) >= k}
                (bad if toxic else good).update(entries)
                n[not toxic] += 1
        bad[""], good[""] = n
        names = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([bad[x] for x in names]), pa.array([good[x] for x in names])], names=["entry", "bad", "good"]
        )

    counts = rows.select("text", "toxic").mapInArrow(run, "entry string, bad long, good long")
    counts = save(counts.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), f"{scratch(rows.sparkSession)}/entries")
    total = counts.where("entry = ''").first()
    if total is None or not total.bad or not total.good:
        return INSULTS, frozenset()
    likelier = (F.col("bad") / total.bad) / ((F.col("good") + 0.5) / total.good)
    # binomial surprise of the toxic share, against as many trials as there are entries
    counts = counts.where((F.col("entry") != "") & (F.col("bad") + F.col("good") >= LEAST_DOCS))
    rate, share = total.bad / (total.bad + total.good), F.col("bad") / (F.col("bad") + F.col("good"))
    rest = F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = F.when(F.col("bad") > 0, F.col("bad") * F.log(share / rate) + rest).otherwise(0.0)
    enough = (F.col("bad") >= LEAST_DOCS) & (surprise >= float(np.log(max(1, counts.count()))) + SURE)
    got = counts.where(enough & (likelier >= LIKELIER)).orderBy(F.desc("bad"), "entry").limit(MOST_ENTRIES)
    names = [r.entry for r in got.select("entry").collect()]
    return INSULTS | {x[1:] for x in names if x[0] == "=" and len(x) > 3}, frozenset(x for x in names if x[0] != "=")


def learn(rows: DataFrame) -> Grammar:
    words, starts = learn_entries(rows)
    grammar = Grammar(words, starts)

    def run(batches):
        for batch in batches:
            got = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["f", "y"])

    seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "f array<double>, y int").collect()  # SAMPLE_ROWS rows at most
    y = np.array([r.y for r in seen], float)
    if not len(y) or y.min() == y.max():
        return grammar
    x = np.concatenate((np.ones((len(y), 1)), np.array([r.f for r in seen])), 1)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return Grammar(words, starts, tuple(w))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Learns from labelled rows with crc32(id as text) mod 5 <> 0, at most about
    ``sample_rows`` of them; ``held_out`` marks the others.  Null and empty
    texts score as texts without matches.  A null id is not held out.  Repeated
    rows score alike.  Without labels of both kinds, the fixed words and DEFAULT
    weights apply.  An empty table gives an empty result; other columns are
    ignored.
    """
    rows = save(learning_rows(docs, labels, sample_rows, id_col=id_col, text_col=text_col), f"{scratch(docs.sparkSession)}/rows")
    grammar = learn(rows)

    def run(batches):
        for batch in batches:
            scores = [grammar.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
