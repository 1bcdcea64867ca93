"""The transducers of the toxicity grammar, and its scores on held-out rows."""

import itertools
import zlib

from loomwork.llm import toxicity as T
from loomwork.llm.queries import QUERIES


def test_composition_is_running_in_sequence():
    machines = (T.NEGATION_MACHINE, T.REPORT_MACHINE, T.TARGET_MACHINE)
    for n in range(6):
        for symbols in itertools.product(range(6), repeat=n):
            out = list(symbols)
            for m in machines:
                out = m.run(out)
            assert T.CLAUSE_MACHINE.run(list(symbols)) == out


def test_clauses():
    words = T.Words(T.INSULTS, frozenset())
    kinds = {
        "an idiot": {0: 1}, "you are an idiot": {1: 1}, "idiot that you are": {1: 1}, "idiot one two three four you": {0: 1}, "kill": {2: 1}, "i will kill you": {3: 1},
        "you are not an idiot": {4: 1}, "not one two three idiot": {0: 1}, "she said you are an idiot": {5: 1}, "he said. idiot": {0: 1}, "you, idiot": {0: 1}, "said not an idiot": {5: 1}, "the tree": {},
        "du idiot, idiot": {1: 1, 0: 1}, "he said: you idiot": {5: 1}, 'he said, "you idiot" and left': {5: 1}, 'he said. "you idiot"': {5: 1}, "note: you idiot": {1: 1}, "he said: you idiot. you idiot": {5: 1, 1: 1},
        "you idiot, he said": {1: 1}, "": {}, ": : idiot": {0: 1},
    }
    for text, want in kinds.items():
        got = T.matches([words[w] for w in text.split()])
        assert {k: n for k, n in got.items() if n} == want, text


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    score = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, folder).collect()}
    held = [(score[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    found, toxic, said = sum(p and t for p, t in held), sum(t for _, t in held), sum(p for p, _ in held)
    assert found >= 0.8 * toxic and found >= 0.9 * said
