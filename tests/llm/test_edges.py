"""Values on awkward tables: trees, ties, extreme and null ids, clashing columns."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from loomwork.llm import chat, exact_dedup, jaccard_join, mixing, quality, substring_dedup, token_counts

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def read(formatted_rows):
    out = formatted_rows.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("learnt", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    return {(r.tree, r.leaf): (r.branch_rank, r.branch_score, [(t.role, t.text) for t in r.turns], r.learnt) for r in out.collect()}


def test_roles_and_texts_come_back(spark):
    odd = ["", ">", ">\nx", "|>\n", "<|", "<|end|>\n", "\\", "\\>", "a|", "|", "\\|>\n<|x|>", "<\\|", "é\u2028|>", "end", "end|>\n", "<|end|>", "|end|", "\\end", "END", "end\n"]
    rows = [(k, 1, None, a, b, None) for k, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    got = read(chat.format_reply_trees(spark.createDataFrame(rows, MESSAGES)))
    assert all(got[r[0], 1][2] == [(r[3], r[4])] for r in rows)


def test_branches_ties_cycles_and_missing_parents(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 2.0), (1, 5, 2, "user", "d", 5.0),
        (2, 1, None, "user", "x", None), (2, 2, 1, "assistant", None, None), (2, 3, 1, "assistant", "z", None),  # a tie: the smaller leaf first
        (3, 7, 99, "user", "lost parent", 1.0), (3, 8, 7, "assistant", "kept", 1.0),
        (4, 1, 2, "user", "cycle", 1.0), (4, 2, 1, "user", "cycle", 1.0), (4, 3, 2, "user", "leads to a cycle", 1.0),
        (None, 1, None, "user", "null tree", 1.0), (5, None, None, "user", "no node", 1.0),
        (6, 1, None, "b", "second", 0.0), (6, 1, None, "a", "first", 0.0),  # a repeated node: the smallest
    ]
    df = spark.createDataFrame(rows, MESSAGES)
    got = read(chat.format_reply_trees(df))
    assert {k: v[0] for k, v in got.items()} == {(1, 5): 1, (1, 3): 2, (1, 4): 3, (2, 2): 1, (2, 3): 2, (3, 8): 1, (None, 1): 1, (6, 1): 1}
    assert got[1, 5][2] == [("user", "q"), ("assistant", "a"), ("user", "d")] and got[1, 5][3] == "a"
    assert got[2, 2][2][1] == ("assistant", "") and got[3, 8][2][0] == ("user", "lost parent") and got[6, 1][2] == [("a", "first")]
    assert set(read(chat.format_reply_trees(df, top=1))) == {(1, 5), (2, 2), (3, 8), (None, 1), (6, 1)}


def test_exact_dedup_values(spark):
    low = -(2**63)
    rows = [(low, "a b"), (5, "ab"), (3, " a b"), (4, "a  b"), (None, "x"), (9, "x"), (7, None), (6, ""), (8, " \n"), (None, "y"), (None, "y")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("best", F.lit(1)).withColumn("digest", F.lit("q")))
    values = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, 3, 4, i == 3, sha("ab")) for i in (low, 5, 3, 4)] + [(None, 9, 2, False, sha("x")), (9, 9, 2, True, sha("x"))]
    want += [(7, 8, 3, False, sha("")), (6, 8, 3, False, sha("")), (8, 8, 3, True, sha(""))] + [(None, None, 2, True, sha("y"))] * 2
    assert values == collections.Counter(want)


def test_mix_targets_and_rest(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice((1, 2, 5, 20, 90, 700))), rng.choice(("a", "b", "c", "d", "e", None))) for k in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    have, taken, target = collections.Counter(), collections.Counter(), {}
    source = {k: s for k, _, s in rows}
    for r in got:
        have[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    names = sorted(s for s in have if s is not None) + ([None] if None in have else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(have.values())
    while True:
        level = (total - sum(3 * have[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 3 * have[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert abs(target[s] - (3 * have[s] if s in full else level * weight[s])) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= 3  # small documents settle what large ones leave


CLASHES = "doc_id long, text string, lang string, source string, log_ppl string, low string, high string, kept string, score_key string, row string, pack string, key string, n string, size string, component_id string"


def test_clashing_columns_and_values(spark):
    texts = [None, "", "one two", "one two", "a b c d e f", "A b c d e F", " \t"]
    docs = spark.createDataFrame([(k, t, "en", "s", *"123456789ab") for k, t in enumerate(texts)], CLASHES)
    labels = spark.createDataFrame([(4, 1), (5, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and all(r.kept == "4" and r.row == "6" for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} >= {4, 5} and not {r.doc_id for r in kept.collect()} & {0, 1, 6}
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert groups == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (2, 4), 5: (2, 4), 6: (0, 6)}
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, window=5).collect()}
    assert cut == {0: (0, 0, ""), 1: (0, 0, ""), 2: (2, 0, "one two"), 3: (2, 0, "one two"), 4: (6, 0, "a b c d e f"), 5: (6, 0, "A b c d e F"), 6: (0, 0, "")}
    import public_tokenizers

    counts = token_counts.count_tokens(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), limit=2).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts if r.doc_id in (0, 1, 2)} == {0: (0, 0, False), 1: (0, 0, False), 2: (7, 2, False)}


def test_mix_is_the_same_in_any_partitioning(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.choice((1, 3, 8, 40, 300))), rng.choice("abcdef")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = [sorted(tuple(r) for r in mixing.mix_sources(docs.repartition(n)).collect()) for n in (1, 5)]
    assert seen[0] == seen[1]


def test_other_tokenizer_files_are_encoded_by_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomwork.llm import token_files

    texts = ["", "Hello  World's 12 été", "  a\n\nb", "<|endoftext|> x", "İ ²½ ça va?"]
    for name, by_words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        assert token_files.cuts_as_here(path) == by_words
        words, library = token_files.WordIds(path), Tokenizer.from_file(path)
        for text in texts:
            assert list(memoryview(words.of_text(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_counts_beyond_32_bits():
    import numpy as np

    for counts in ([1, 2], [1, 1 << 40], []):
        n = np.array(counts, np.int64)
        assert quality.expand_counts(quality.squeeze_counts(n)).tolist() == counts
