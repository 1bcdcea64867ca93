"""Shared folders, written tables, packs of words, and keys that meet across packs."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share.

    ``spark.checkpoint.dir`` names the shared folder and has to be set on a
    cluster.  Only where it is unset and all tasks run in this machine's own
    process (local tests), a temporary folder is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not local:
            local.append(tempfile.mkdtemp(prefix="loomwork-"))
        root = local[0]
    made.append(f"{root.rstrip('/')}/loomwork-{uuid.uuid4().hex}")
    return made[-1]


#: The folder that stands in where none is set.
local: list[str] = []
#: Folders that scratch() has named.
made: list[str] = []


def save(df: DataFrame, path: str, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: lineage ends here."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_counting(df: DataFrame, path: str, what: Column) -> tuple[DataFrame, int]:
    """As save(), and on how many rows ``what`` is true, counted while writing (a retried task may count twice)."""
    seen = Observation()
    saved = save(df.observe(seen, F.count(F.when(what, True)).alias("n")), path)
    return saved, seen.get["n"]


#: Rows of a few numbers up to which a table is broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def few(saved: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcasting if it has at most BROADCAST_ROWS."""
    return F.broadcast(saved) if saved.count() <= BROADCAST_ROWS else saved


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return this worker's freed memory to the system; workers live long and keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def squeeze(values: np.ndarray) -> bytes:
    """A numeric array as compressed byte planes; the width of an item comes first."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).reshape(-1).view(dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """As squeeze(), for ascending unsigned values: differences take fewer bytes."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def expand_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(expand(data, dtype), dtype=dtype)


PACK_SCHEMA = "pack long, ids array<long>, counts array<int>, n_words long, vocab binary, body binary, marks binary"
PACK_WORDS = 600_000


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def word_packs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lower: bool = False, pack_words: int = PACK_WORDS, marks=None
) -> DataFrame:
    """Rows of ``docs`` in packs of about ``pack_words`` words.

    A pack is one row: ids, words per document, the distinct words and one
    number per word.  A longer text has a pack of its own.  No shuffle: each
    scan task packs what it reads.  A pack id is the task's partition and a
    running number, so write the packs before reading them twice.  Null texts
    have no words; ``lower`` lower-cases A-Z.  ``marks`` makes a number of each
    distinct word of a list; they are kept beside the words.
    """

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        ids, counts, numbers, size, vocab = [], [], [], 0, Numbering()

        def row():
            body = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([size], pa.int64()),
                    pa.array([press.compress(b" ".join(vocab))], pa.binary()),
                    pa.array([squeeze(body)], pa.binary()),
                    pa.array([squeeze(marks(list(vocab))) if marks else None], pa.binary()),
                ],
                names=["pack", "ids", "counts", "n_words", "vocab", "body", "marks"],
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or b""
                words = (raw.lower() if lower else raw).split()  # bytes: exactly the six characters part words
                if size and size + len(words) > pack_words or len(ids) >= pack_words:
                    yield row()
                    seq, ids, counts, numbers, size, vocab = seq + 1, [], [], [], 0, Numbering()
                ids.append(key)
                counts.append(len(words))
                numbers.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                size += len(words)
        if ids:
            yield row()
        ids, counts, numbers, vocab = [], [], [], Numbering()
        give_back()

    return docs.select(
        F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")
    ).mapInArrow(run, PACK_SCHEMA)


class Pack:
    """One row of word_packs()."""

    def __init__(self, row: dict, *, vocab: bool = True):
        self.pack, self.ids = row["pack"], row["ids"]
        self.counts = np.asarray(row["counts"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.vocab = zstandard.ZstdDecompressor().decompress(row["vocab"]).split(b" ") if vocab and row["n_words"] else []
        self.words = expand(row["body"], np.uint32) if row["n_words"] else np.zeros(0, np.uint32)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word in place."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab), np.uint64, len(self.vocab))
        return own[self.words]


#: Odd bases of the rolling hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` values, at the index of its first one."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))), dtype=np.uint64)
    down = np.cumprod(
        np.concatenate(([np.uint64(1)], np.full(n - width, pow(base, -1, 1 << 64), np.uint64))), dtype=np.uint64
    )
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * up, dtype=np.uint64)))
    return mix((total[width:] - total[:-width]) * down)


KEYS_SCHEMA = "shard int, pack long, keys binary, notes binary"


def by_shard(pack: int, keys: np.ndarray, notes: np.ndarray, shard: np.ndarray):
    """Rows of KEYS_SCHEMA: what one pack sends to each shard; sorted by (shard, key)."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cut[1:], len(shard))
    lists = [
        (int(shard[a]), pack, squeeze_sorted(keys[a:b]), squeeze(notes[a:b])) for a, b in zip(cut, ends)
    ]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in lists], pa.int32()),
            pa.array([x[1] for x in lists], pa.int64()),
            pa.array([x[2] for x in lists], pa.binary()),
            pa.array([x[3] for x in lists], pa.binary()),
        ],
        names=["shard", "pack", "keys", "notes"],
    )


def meet(sent: DataFrame, judge, key_type, note_type) -> DataFrame:
    """Bring together what the packs sent to each shard, and answer each pack with the keys that count.

    ``judge(notes, starts)`` gets the notes of the shard, sorted by key, and
    where each key begins; it returns which keys count and a value for each.
    A shard holds about as many keys at any size of input.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [expand_sorted(r["keys"], key_type) for r in rows]
        keys = np.concatenate(lists)
        notes = np.concatenate([expand(r["notes"], note_type) for r in rows])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        good, value = judge(notes[order], starts)
        each = np.diff(np.append(starts, len(ordered)))
        hit, worth = np.empty(len(keys), bool), np.empty(len(keys), note_type)
        hit[order], worth[order] = np.repeat(good, each), np.repeat(value.astype(note_type), each)
        out, at = [], 0
        for r, own in zip(rows, lists):
            mine = hit[at : at + len(own)]
            if mine.any():
                out.append((r["shard"], r["pack"], squeeze_sorted(own[mine]), squeeze(worth[at : at + len(own)][mine])))
            at += len(own)
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "pack", "keys", "notes"])

    return sent.groupBy("shard").applyInArrow(run, KEYS_SCHEMA)


def shards(total: int, each: int, least: int = 1) -> int:
    """How many shards of about ``each`` units hold ``total``; grows with the data without a cap."""
    return max(least, -(-int(total) // each))
