"""Token counts from pre-token frequencies.

A byte-level tokenizer cuts a text into pre-tokens and splits each on its own,
so a document's count is the sum over its distinct pre-tokens of frequency
times pieces.  Packs of documents send each distinct pre-token to the shard
that its hash names; a shard counts the pieces of each once and answers; packs
then sum frequencies times pieces.  Token ids are never stored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, expand, save, scratch, shards, squeeze

#: Bytes of text for which one shard stands, and of one pack.
SHARD_BYTES, PACK_BYTES = 16 << 20, 4 << 20
#: The pre-token pattern of the byte-level vocabulary, and the same for texts of simple characters only (fixed values).
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SIMPLE_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A character for which the two differ, or might.
NOT_SIMPLE = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")

FREQ_SCHEMA = "pack long, ids array<long>, n_bytes array<long>, extra array<long>, per_doc array<int>, which binary, times binary, sent array<struct<shard:int,n:int,lens:binary,body:binary>>"


def byte_of_name() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = itertools.count(256)
    return {chr(b) if b in printable else chr(next(odd)): b for b in range(256)}


NAMES = byte_of_name()


def pre_tokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text.

    Characters that this Python's tables don't know may be letters to the
    library's, so texts with such ones are cut by the library itself.
    """
    if not NOT_SIMPLE.search(text):
        return SIMPLE_PATTERN.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        parts = loaded(path).pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(NAMES.__getitem__, name)).decode() for name, _ in parts]
    return PATTERN.findall(text)


def special_strings(path: str) -> tuple[str, ...]:
    """The special tokens of a tokenizer file, the longest first."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted((t["content"] for t in json.load(f)["added_tokens"]), key=lambda t: (-len(t), t)))


@functools.lru_cache(maxsize=1)
def loaded(path: str):
    """The tokenizer of a file, once in each worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer: str,
    limit: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, for a byte-level BPE file.

    A special string of the file inside a text is one token, as in the library's default.
    Null and empty texts have no bytes and no tokens.  Repeated rows and ids
    stay as they are, null ids too; an empty table gives an empty result;
    other columns are ignored.  A pack holds about PACK_BYTES of text or one
    longer text, a shard the pre-tokens of about SHARD_BYTES.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_shards = shards(total, SHARD_BYTES, 64)
    cut = re.compile("|".join(map(re.escape, special_strings(tokenizer))) or r"(?!)")

    def frequencies(batches):
        part, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        numbers = Numbering()
        ids, sizes, extra, docs_of, which, times, size = [], [], [], [], [], [], 0

        def row():
            names = [t.encode() for t in numbers]
            shard = np.fromiter((xxhash.xxh3_64_intdigest(t, 3) % n_shards for t in names), np.int64, len(names))
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sent = []
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own):
                    mine = [names[k] for k in own]
                    lens = np.array([len(t) for t in mine], np.uint32)
                    sent.append({"shard": int(shard[own[0]]), "n": len(own), "lens": squeeze(lens), "body": press.compress(b"".join(mine))})
            found = np.concatenate(which) if which else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "pack": part << 32 | seq,
                        "ids": ids,
                        "n_bytes": sizes,
                        "extra": extra,
                        "per_doc": docs_of,
                        "which": squeeze(place[found].astype(np.uint32)),
                        "times": squeeze((np.concatenate(times) if times else np.zeros(0)).astype(np.uint32)),
                        "sent": sent,
                    }
                ],
                schema=ARROW_FREQ,
            )

        for batch in batches:
            for key, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n_bytes = len(one.encode())
                if ids and size + n_bytes > PACK_BYTES:
                    yield row()
                    seq, size, numbers = seq + 1, 0, Numbering()
                    ids, sizes, extra, docs_of, which, times = [], [], [], [], [], []
                parts = cut.split(one)
                tokens = [t for x in parts for t in pre_tokens(x, tokenizer)] if len(parts) > 1 else pre_tokens(one, tokenizer)
                found, n = np.unique(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), return_counts=True)
                ids.append(key)
                sizes.append(n_bytes)
                extra.append(len(parts) - 1)
                docs_of.append(len(found))
                which.append(found)
                times.append(n)
                size += n_bytes
        if ids:
            yield row()

    packs = save(
        docs.select(F.col(id_col).cast("long"), text).mapInArrow(frequencies, FREQ_SCHEMA), f"{folder}/packs", compression="none"
    )

    def pieces(table: pa.Table) -> pa.Table:
        count = loaded(tokenizer)
        numbers, rows = Numbering(), []
        for row in table.to_pylist():
            body, ends = zstandard.ZstdDecompressor().decompress(row["body"]), np.cumsum(expand(row["lens"], np.uint32))
            names = [body[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            rows.append(np.fromiter(map(numbers.__getitem__, names), np.int64, len(names)))
        distinct = list(numbers)
        n = np.zeros(len(distinct), np.uint32)
        for k in range(0, len(distinct), 4096):
            part = [t.decode() for t in distinct[k : k + 4096]]
            n[k : k + 4096] = [len(e.ids) for e in count.encode_batch(part, add_special_tokens=False)]
        return pa.table(
            [table.column("shard"), table.column("pack"), pa.array([squeeze(n[x]) for x in rows], pa.binary())],
            names=["shard", "pack", "pieces"],
        )

    sent = packs.select("pack", F.inline("sent"))
    answers = sent.groupBy("shard").applyInArrow(pieces, "shard int, pack long, pieces binary")

    def total_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        replies = sorted(zip(right.column("shard").to_pylist(), right.column("pieces").to_pylist()))
        n = np.concatenate([np.zeros(0, np.uint32), *(expand(x, np.uint32) for _, x in replies)]).astype(np.int64)
        per_doc = np.asarray(row["per_doc"], np.int64)
        sums = np.concatenate(([0], np.cumsum(n[expand(row["which"], np.uint32)] * expand(row["times"], np.uint32)) if len(n) else []))
        ends = np.cumsum(per_doc)
        counts = (sums[ends] - sums[ends - per_doc]).astype(np.int64) + np.asarray(row["extra"], np.int64)
        return pa.table(
            [pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(counts), pa.array(counts > limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return (
        packs.drop("sent")
        .groupBy("pack")
        .cogroup(answers.groupBy("pack"))
        .applyInArrow(total_up, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )


ARROW_FREQ = pa.schema(
    [
        ("pack", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
        ("extra", pa.list_(pa.int64())),
        ("per_doc", pa.list_(pa.int32())),
        ("which", pa.binary()),
        ("times", pa.binary()),
        ("sent", pa.list_(pa.struct([("shard", pa.int32()), ("n", pa.int32()), ("lens", pa.binary()), ("body", pa.binary())]))),
    ]
)
