"""The dealt operators against brute force, libraries and SQL, and on awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomwork.llm import chat, decontaminate, exact_dedup, fill_middle, jaccard_join, mixing, quality, resample, substring_dedup, token_counts, token_files, top_k, toxicity
from loomwork.llm.common import scratch
from loomwork.llm.queries import QUERIES
from loomwork.llm.sql import ORACLE_SQL
from tests.compare import differences

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, notes string, pack long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
TEXTS = [None, "", " \n ", "one", "one", "you idiot, go", LONG, LONG + " tail", "a b c d e f g", "A b C d e f g", "<|endoftext|> İ ΣΑΣ ²½ é", "same words " * 40]
WEIRD = [(None if k == 3 else k // 2, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", k, "x", "y", 7) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def weird(spark):
    return spark.createDataFrame(WEIRD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, int(k % 2), int(k == 2)) for k in range(6)] + [(2, 1, 1), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], FOLDER) == ""


def test_mix_meets_targets(spark):
    rows = QUERIES["op2_mixing"](spark, FOLDER).collect()
    docs = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["size"] == docs[r.doc_id][1] and r.taken <= 3 * r["size"]
        taken[docs[r.doc_id][0]] += r.taken
        target[docs[r.doc_id][0]] = r.target
    assert sum(target.values()) == pytest.approx(sum(n for _, n in docs.values()), rel=1e-6)
    biggest = max(n for _, n in docs.values())
    assert all(abs(taken[s] - target[s]) <= 2 * biggest for s in target)


def test_token_files_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, FOLDER).collect()}, 0
    for key in sorted(texts):
        ids = np.array(tokenizer.encode(texts[key], add_special_tokens=False).ids + [1], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_decontamination_finds_copies_only(spark, texts):
    items = {r.item_id: decontaminate.plain_words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = set()
    for d, text in texts.items():
        words = b" ".join(decontaminate.plain_words(text))
        want |= {(d, i) for i, w in items.items() if b" " + b" ".join(w) + b" " in b" " + words + b" "}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, FOLDER).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and len(got - want) <= 1


def test_decontamination_checks_answers(spark):
    item = " ".join(f"term{k}" for k in range(30))
    near = item.split()
    near[3:21:2] = [f"other{k}" for k in range(9)]  # 21 of 30 words in order, answer kept
    lost = near[:-5] + ["no"] * 5  # less, and no answer
    noise = [" ".join(f"n{j}m{k}" for k in range(60)) for j in range(40)]
    docs = spark.createDataFrame(list(enumerate([item, " ".join(near), " ".join(lost), *noise])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {0, 1}


def test_substring_dedup(spark, texts):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in QUERIES["op5_substring_dedup"](spark, FOLDER).collect()}
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_toxicity_grammar():
    words = toxicity.Words(frozenset({"idiot"}), frozenset({"lowe"}))
    kinds = [toxicity.matches([words[w] for w in s.split()]) for s in ("you are an idiot", "not an idiot", "he said idiot", "an idiot here", "loweist")]
    assert [next(k for k, n in c.items() if n) for c in kinds] == [1, 4, 5, 0, 0]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    score = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, folder).collect()}
    held = [(score[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if score[r.doc_id].held_out]
    assert held and np.mean([p == t for p, t in held]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in score.items())


def test_token_counts(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op7_token_counts"](spark, FOLDER).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_jaccard_join(spark, texts):
    lower = {d: [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t)] for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for d, w in lower.items()}
    near = {d: d for d in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    near[a] = near[b] = min(near[a], near[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard_join"](spark, FOLDER).collect()}
    assert got == {d: (len(sets[d]), near[d]) for d in sets}


def test_quality_separates(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op10_quality_classifier"](spark, folder).collect()}
    marks = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert np.mean([kept[r.doc_id] for r in marks if r.quality]) >= 0.98
    assert np.mean([kept[r.doc_id] for r in marks if not r.quality]) <= 0.2


def all_results(spark, docs, labels):
    path = public_tokenizers.path
    bench = spark.createDataFrame([(1, "w1x1 w2x2 w3x3"), (None, None)], "item_id long, text string")
    turns = docs.selectExpr("doc_id as conv_id", "n_chars as turn", "source as role", "text", "keys")
    return {
        "chat": chat.format_reply_trees(chat.threads(turns)),
        "mix": mixing.mix_sources(docs),
        "files": token_files.token_documents(docs, f"{scratch(spark)}/files", tokenizer=path("word_bpe_49k.json"), end_id=1),
        "decontaminate": decontaminate.contaminated(docs, bench),
        "substring": substring_dedup.substring_dedup(docs),
        "toxicity": toxicity.score_toxicity(docs, labels),
        "counts": token_counts.count_tokens(docs, tokenizer=path("byte_bpe_50k.json"), limit=1024),
        "jaccard": jaccard_join.jaccard_join(docs),
        "exact": exact_dedup.exact_dedup(docs),
        "quality": quality.classify(docs, labels),
        "top_k": top_k.top_k(docs.selectExpr("doc_id as vec_id", "array(float(n_chars), 0.5f) as embedding", "text", "pack", "notes as block")),
        "middle": fill_middle.fill_in_middle(docs),
        "resample": resample.resample(docs, bench),
    }


def test_awkward_rows(spark, weird, labels):
    for name, df in all_results(spark, weird, labels).items():
        rows = df.count()
        if name not in ("chat", "decontaminate", "top_k"):
            assert rows == len(TEXTS), name


def test_empty_tables(spark, weird, labels):
    for name, df in all_results(spark, weird.where("false"), labels.where("false")).items():
        assert df.count() == 0, name
