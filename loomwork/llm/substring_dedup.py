"""Removal of word sequences that repeat, found by fixed-block anchors.

Non-overlapping blocks of ``block`` words are indexed; each rolling window of
as many words probes the index.  As 2 * block - 1 <= window, each window that
repeats holds a block of the index, and its repetition holds the same words at
the same place.  Hits are extended to maximal repeats: all windows around a hit
are compared whole, and runs of repeated windows cover the words to remove.

Documents travel in packs (see ``common``).  What packs exchange is one key per
distinct sequence and pack, so a sequence with a million copies is as light as
one with a thousand, and no task meets all rows of a key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BASES,
    KEYS_SCHEMA,
    Pack,
    by_shard,
    expand_sorted,
    meet,
    remove,
    rolling,
    save,
    scratch,
    shards,
    word_packs,
)

#: Keys that one shard holds on average.
SHARD_KEYS = 1_000_000
OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"


def inside(pack: Pack, width: int) -> np.ndarray:
    """Where a run of ``width`` words of one document starts."""
    n = max(0, len(pack.words) - width + 1)
    return np.arange(n) + width <= pack.ends[pack.doc[:n]]


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, texts: bool = True) -> DataFrame:
    """Drop each word that lies in a repeated run of ``window`` words; one row per row of ``docs``.

    Returns ``doc_id, n_words, n_removed, kept, kept_sha256``: ``kept`` are the
    remaining words joined by one space in UTF-8 (null without ``texts``), with
    its digest.  A run repeats if the same words, unchanged, start at any other
    place of any document; all places are judged on the input.  Overlapping
    repetitions count.

    Null and empty texts have no words and the digest of the empty text.
    Repeated rows are copies of each other, null ids are kept as they are, an
    empty table gives an empty result, and other columns are ignored.

    Sequences meet as 64-bit hashes in a shard that a second, independent hash
    names; two different sequences are taken for equal with odds of about
    pairs / (2**64 * shards).
    """
    spark, folder, block = docs.sparkSession, scratch(docs.sparkSession), (window + 1) // 2
    packs = save(word_packs(docs, id_col=id_col, text_col=text_col), f"{folder}/packs", compression="none")
    n_shards = shards(packs.agg(F.sum("n_words")).first()[0] or 0, SHARD_KEYS, 64)

    def probe(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                at = np.flatnonzero(inside(pack, block))
                if not len(at):
                    continue
                code = rolling(pack.hashes(1), block, BASES[0])[at]
                anchor = (at - pack.starts[pack.doc[at]]) % block == 0
                shard = (code >> np.uint64(32)) % np.uint64(n_shards)
                code = np.sort(shard << np.uint64(33) | (code & np.uint64(0xFFFFFFFF)) << np.uint64(1) | anchor)
                first = np.flatnonzero(np.diff(code >> np.uint64(1), prepend=~np.uint64(0)))
                last = np.append(first[1:], len(code)) - 1
                notes = (code[last] & np.uint64(1)).astype(np.uint8) | (last > first).astype(np.uint8) << 1
                keys = (code[first] >> np.uint64(1)).astype(np.uint32)
                yield from by_shard(pack.pack, keys, notes, (code[first] >> np.uint64(33)).astype(np.int64))

    def anchored(notes, starts):
        """Keys with at least two places of which one is a block of the index."""
        several = np.diff(np.append(starts, len(notes))) > 1
        seen = np.bitwise_or.reduceat(notes, starts)
        return (several | (seen & 2 > 0)) & (seen & 1 > 0), seen

    hits = save(meet(packs.mapInArrow(probe, KEYS_SCHEMA), anchored, np.uint32, np.uint8), f"{folder}/hits", compression="none")

    def windows(left: pa.Table, right: pa.Table):
        """Hashes of all windows around hits."""
        empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], names=["shard", "pack", "keys", "notes"])
        if not right.num_rows:
            return empty
        pack = Pack(left.to_pylist()[0])
        known = np.sort(np.concatenate([np.uint64(r["shard"]) << np.uint64(32) | expand_sorted(r["keys"], np.uint32) for r in right.select(["shard", "keys"]).to_pylist()]))
        words = pack.hashes(1)
        code = rolling(words, block, BASES[0])
        code = (code >> np.uint64(32)) % np.uint64(n_shards) << np.uint64(32) | (code & np.uint64(0xFFFFFFFF))
        hit = inside(pack, block) & among(code, known)
        whole = inside(pack, window)
        near = np.concatenate(([0], np.cumsum(hit)))  # a hit at q lets windows start at q - (window - block) .. q
        n = len(whole)
        at = np.flatnonzero(whole & (near[np.arange(n) + window - block + 1] > near[:n]))
        if not len(at):
            return empty
        code = rolling(words, window, BASES[0])[at]
        shard = rolling(pack.hashes(2), window, BASES[1])[at] % np.uint64(n_shards)
        order = np.lexsort((code, shard))
        code, shard = code[order], shard[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (shard[1:] != shard[:-1]))))
        several = np.diff(np.append(first, len(code))) > 1
        return pa.Table.from_batches(by_shard(pack.pack, code[first], several.astype(np.uint8), shard[first].astype(np.int64)))

    def repeated(notes, starts):
        several = np.diff(np.append(starts, len(notes))) > 1
        return several | (np.bitwise_or.reduceat(notes, starts) > 0), np.zeros(len(starts))

    near = packs.groupBy("pack").cogroup(hits.groupBy("pack")).applyInArrow(windows, KEYS_SCHEMA)
    found = save(meet(near, repeated, np.uint64, np.uint8).select("pack", "keys"), f"{folder}/found", compression="none")
    remove(spark, f"{folder}/hits")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = Pack(left.to_pylist()[0])
        gone = np.zeros(len(pack.words) + 1, np.int64)
        if right.num_rows:
            known = np.sort(np.concatenate([expand_sorted(k, np.uint64) for k in right["keys"].to_pylist()]))
            at = np.flatnonzero(inside(pack, window) & among(rolling(pack.hashes(1), window, BASES[0]), known))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        stays = np.cumsum(gone)[:-1] == 0
        vocab = np.array(pack.vocab, object)
        kept, n_removed = [], []
        for a, b in zip(pack.starts, pack.ends):
            kept.append(b" ".join(vocab[pack.words[a:b][stays[a:b]]]) if b > a else b"")
            n_removed.append(int(b - a - stays[a:b].sum()))
        return pa.table(
            [
                pa.array(pack.ids, pa.int64()),
                pa.array(pack.counts, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept if texts else [None] * len(kept), pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )

    out = packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(cut, OUT_SCHEMA)
    return out.withColumn("kept", F.col("kept").cast("string"))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known`` (sorted)."""
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values
