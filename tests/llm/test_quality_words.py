"""The word model of the quality classifier."""

import itertools
import random

from loomwork.llm import quality

#: All words begin and end alike, so only the order of whole words parts a text from a shuffled one.
WORDS = [f"x{a}{b}x" for a, b in itertools.product("abcde", repeat=2)]
SCHEMA = "doc_id long, lang string, text string"


def text_of(rng):
    at, out = rng.randrange(25), []
    for _ in range(120):
        out.append(WORDS[at])
        at = (at + rng.choice((1, 2, 3))) % 25  # three of 25 words may follow
    return out


def rows_of(spark):
    rng = random.Random(3)
    texts = [text_of(rng) for _ in range(60)]
    mixed = [rng.sample(t, len(t)) for t in texts[40:]]
    rows = [(k, "en", " ".join(t)) for k, t in enumerate(texts + mixed)]
    rows += [(100, "en", rows[0][2]), (101, "en", rows[0][2]), (None, None, rows[50][2]), (102, "en", None), (103, "en", " ")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")


def test_order_of_words_counts(spark, monkeypatch):
    docs, labels = rows_of(spark)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 85
    assert max(got[k].perplexity for k in range(60)) < min(got[k].perplexity for k in range(60, 80))
    assert all(got[k].kept for k in range(40)) and not any(got[k].kept for k in range(60, 80))
    assert got[0].perplexity == got[100].perplexity == got[101].perplexity and abs(got[None].perplexity - got[50].perplexity) < 1e-9
    assert not got[102].kept and got[102].perplexity is None and not got[103].kept
    monkeypatch.setattr(quality, "HEAVY", 5)  # salting changes nothing
    for r in quality.classify(docs, labels).collect():
        assert r.perplexity is None or abs(r.perplexity - got[r.doc_id].perplexity) < 1e-9


def test_without_labels_and_rows(spark):
    docs, labels = rows_of(spark)
    assert quality.classify(docs, labels.where("false")).where("kept").count() == 83
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
