"""What tasks of the token files hold at once."""

import public_tokenizers
import pyarrow as pa
import pytest

from loomwork.llm import common, token_files

from .test_work import Frame


def test_tokens_leave_a_task_in_parts_and_words_are_let_go(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_TOKENS", 1000, raising=False)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 500, raising=False)
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([0] * 100), pa.array(texts)], names=["doc_id", "tie", "text"])
    path = public_tokenizers.path("word_bpe_49k.json")
    out = list(token_files.tokenize(Frame(), path, 1).run([batch]))
    assert [k for x in out for k in x.column(0).to_pylist()] == list(range(100))
    library = token_files.WordIds(path)
    for x in out:
        sizes = x.column(2).to_pylist()
        assert sum(sizes[:-1]) < 1000
        for k, n, body in zip(x.column(0).to_pylist(), sizes, x.column(3).to_pylist()):
            assert token_files.grow(body).tolist() == [*memoryview(library.whole(texts[k])).cast("I"), 1] and n == len(token_files.grow(body))
    assert len(token_files._WORDS[path]) <= 500


@pytest.mark.parametrize("part", [4, 1 << 20])
def test_files_are_read_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(token_files, "PART_TOKENS", part, raising=False)
    docs = spark.createDataFrame([(k, "word " * k) for k in range(9)] + [(None, None)], "doc_id long, text string")
    out = token_files.token_documents(docs, f"{common.scratch(spark)}/files", tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, len(r.ids) // 4) for r in rows] == [(None, 1, 1)] + [(k, r.n_tokens, r.n_tokens) for k, r in enumerate(rows[1:])]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
