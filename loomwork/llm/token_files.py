"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

Ids are renumbered by falling frequency, so most need one byte.  A shard file
holds, in this order: the magic, three counts, ids and token numbers of its
documents, two control bits per token (its length in bytes less one), and the
bytes of all tokens.  ``ranks.bin`` of the same folder holds the id of each
rank.  A reader expands control bytes with a numpy table and needs no loop.
"""

from __future__ import annotations

import array
import itertools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, save, scratch, shards

MAGIC = b"TOKFILE1"
#: Tokens of one file; a longer document has a file of its own.
FILE_TOKENS = 4_000_000
#: Tokens that a task expands, or hands back, at once: a multiple of 4.
PART_TOKENS = 1 << 20
#: Words, and pieces of words, whose ids a worker remembers within a task, and beyond it.
CACHE_WORDS, KEPT_WORDS = 600_000, 50_000
#: Lengths of the four tokens that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


#: Texts of these characters are cut here; the tokenizer itself cuts other words (fixed: its letters, digits and cuts among these characters).
SIMPLE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
CUT = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


#: What a tokenizer file says where WordIds can cut texts itself; others are encoded whole by the library.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_as_here(path: str) -> bool:
    """Whether a tokenizer file normalises and cuts as WordIds does, and its added tokens hold what sends a word to the library."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = not said["model"].get("dropout") and said["model"]["type"] == "BPE" and not said.get("truncation") and not said.get("padding")
    added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])
    return plain and added and said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER


class WordIds(dict):
    """Ids of words in lower case as bytes; the merges see each piece of a word once per worker.

    The tokenizer drops white space and cuts there, so a text's ids are its
    words' ids in a row, and a word's are those of its pieces: runs of letters,
    single digits, and runs of other marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), cuts_as_here(path)
        self.split = self.tokenizer.model.tokenize
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = itertools.count(256)
        self.names = [chr(b) if b in printable else chr(next(odd)) for b in range(256)]

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_text(self, text: str) -> bytes:
        if not self.by_words:
            return self.whole(text)
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(map(self.of_word, text.encode().split()))  # bytes: exactly the six characters part words

    def of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if SIMPLE.fullmatch(text) and "<|" not in text:
            return self[text.lower()]
        return self.whole(text)

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        pieces = [word] if word.isalpha() else CUT.findall(word)
        if len(pieces) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
        else:
            name = word if word.isascii() else "".join(self.names[b] for b in word.encode())
            ids = array.array("I", [t.id for t in self.split(name)]).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


def shrink(ids: np.ndarray) -> bytes:
    """Ids as byte planes, of two bytes an id where that is enough; the width comes first."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + planes.tobytes()


def grow(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").reshape(-1).astype(np.uint32)


_WORDS: dict[str, WordIds] = {}


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, n_tokens, ids`` of each row; ``end_id`` is appended."""

    def run(batches):
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = WordIds(tokenizer)
        words = _WORDS[tokenizer]
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            counts, bodies, size, at = [], [], 0, 0
            for k, text in enumerate(batch.column(2), 1):
                ids = np.frombuffer(words.of_text(text.as_py() or "") + end, np.uint32)
                counts.append(len(ids))
                bodies.append(shrink(ids))
                size += len(ids)
                if size >= PART_TOKENS or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[at:k], batch.column(1)[at:k], pa.array(counts, pa.int64()), pa.array(bodies, pa.binary())],
                        names=["doc_id", "tie", "n_tokens", "ids"],
                    )
                    counts, bodies, size, at = [], [], 0, k
        batch = text = ids = None
        if len(words) > KEPT_WORDS:  # most of them occur in few texts, and workers that are idle would hold them
            words.clear()
        give_back()

    text = F.col(text_col).cast("string")
    # equal ids are ordered by text, so any partitioning writes the same files
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text.cast("binary")).alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame) -> DataFrame:
    """``id, n`` of each token id that occurs."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for body in batch.column(0):
                n = np.bincount(grow(body.as_py()))
                if len(n) > len(total):
                    total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
                total[: len(n)] += n
        give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    parts = [encode_part(values[a : a + PART_TOKENS]) for a in range(0, len(values), PART_TOKENS)]
    return b"".join(x for x, _ in parts), b"".join(x for _, x in parts)


def encode_part(values: np.ndarray) -> tuple[bytes, bytes]:
    width = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = width - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    octets = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < width[:, None]].tobytes()


def decode(width: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Values of ``width`` bytes each that lie at the begin of ``data``."""
    data = data[: int(width.sum(dtype=np.int64))]
    at = np.cumsum(width, dtype=np.int64) - width
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    values = padded[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        values[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it, as tasks write to the store themselves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if re.match("file:/[^/]", full) else full


def put(path: str, data: bytes) -> None:
    """Write a file whole: a retried task replaces it by the same bytes."""
    store, where = pyarrow.fs.FileSystem.from_uri(path)
    part = f"{where}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, where)


def make_folder(path: str) -> None:
    store, where = pyarrow.fs.FileSystem.from_uri(path)
    store.create_dir(where)


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every whole text and write shard files in ascending id order below ``path``.

    Returns the manifest ``file, n_docs, n_tokens, n_bytes``, itself saved.
    Null texts count as empty and consist of the end id; a null id sorts first;
    rows that repeat an id lie next to each other, ordered by text; an empty
    table writes no shard; other columns are ignored.  What reaches the driver
    is one row per id of the tokenizer's vocabulary.
    """
    spark = docs.sparkSession
    folder, path = scratch(spark), qualified(spark, path)
    tokens = save(tokenize(docs, tokenizer, end_id, id_col=id_col, text_col=text_col), f"{folder}/tokens")
    ranked = frequencies(tokens).orderBy(F.desc("n"), "id").select("id", "n").collect()
    ids = np.array([r.id for r in ranked], np.uint32)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    make_folder(path)
    put(f"{path}/ranks.bin", ids.astype("<u4").tobytes())
    files = shards(sum(r.n for r in ranked), FILE_TOKENS)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        keys, counts, bodies, size = [], [], [], 0

        def flush():
            name = f"part-{part:08d}-{seq:06d}.tok"
            control, data = encode(np.concatenate([rank_of[grow(x)] for x in bodies]))
            head = np.array([len(keys), size, len(control)], "<u8").tobytes()
            null = np.array([k is None for k in keys], np.uint8).tobytes()
            own = np.array([k or 0 for k in keys], "<i8").tobytes() + null + np.array(counts, "<u8").tobytes()
            raw = MAGIC + head + own + control + data
            put(f"{path}/{name}", raw)
            return pa.RecordBatch.from_pylist([{"file": name, "n_docs": len(keys), "n_tokens": size, "n_bytes": len(raw)}])

        for batch in batches:
            for key, n, body in zip(*(batch.column(k) for k in (0, 2, 3))):
                n = n.as_py()
                if keys and size + n > FILE_TOKENS:
                    yield flush()
                    seq, keys, counts, bodies, size = seq + 1, [], [], [], 0
                keys.append(key.as_py())
                counts.append(n)
                bodies.append(body.as_py())
                size += n
        if keys:
            yield flush()
        keys, counts, bodies = [], [], []
        give_back()

    ordered = tokens.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return save(ordered.mapInArrow(run, "file string, n_docs long, n_tokens long, n_bytes long"), f"{folder}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc_id, place, at, n_tokens, ids_crc32, ids`` of each document, read from the files alone.

    ``at`` counts the tokens of the documents before it in its file; ``ids`` are the token ids as little-endian unsigned 32-bit integers.
    """
    ranks = spark.read.format("binaryFile").load(f"{path}/ranks.bin").select("content").first()
    id_of = np.frombuffer(bytes(ranks.content), "<u4")

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(raw.as_py(), np.uint8)
                assert raw[:8].tobytes() == MAGIC, f"{name} is no token file"
                docs, size, width = (int(x) for x in raw[8:32].view("<u8"))
                at = 32
                keys = np.frombuffer(raw[at : at + 8 * docs].tobytes(), "<i8")
                null = raw[at + 8 * docs : at + 9 * docs] > 0
                counts = np.frombuffer(raw[at + 9 * docs : at + 17 * docs].tobytes(), "<u8").astype(np.int64)
                at += 17 * docs
                widths = LENGTHS[raw[at : at + width]].reshape(-1)[:size]
                data = raw[at + width :]
                ends = np.cumsum(counts)
                starts = ends - counts
                first = 0
                while first < docs:  # as many documents at once as have PART_TOKENS, one at least
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + PART_TOKENS, "right")))
                    own = widths[starts[first] : ends[last - 1]]
                    ids = id_of[decode(own, data)].astype("<u4")
                    data = data[int(own.sum(dtype=np.int64)) :]
                    part = slice(first, last)
                    each = [ids[b - n : b].tobytes() for n, b in zip(counts[part], ends[part] - starts[first])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.rsplit("/", 1)[-1]] * len(each)),
                            pa.array(keys[part], mask=null[part]),
                            pa.array(np.arange(first, last)),
                            pa.array(starts[part]),
                            pa.array(counts[part]),
                            pa.array([zlib.crc32(x) for x in each], pa.int64()),
                            pa.array(each, pa.binary()),
                        ],
                        names=["file", "doc_id", "place", "at", "n_tokens", "ids_crc32", "ids"],
                    )
                    first = last
        give_back()

    schema = "file string, doc_id long, place long, at long, n_tokens long, ids_crc32 long, ids binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def with_starts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents of read_token_files() with ``start``, the number of tokens before them in all files."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    return rows.join(offset, "file").withColumn("start", F.col("offset") + F.col("at")).drop("offset", "at")


def token_documents(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, **columns) -> DataFrame:
    """Write ``docs`` as token files below ``path`` and read them back."""
    manifest = write_token_files(docs, path, tokenizer=tokenizer, end_id=end_id, **columns)
    if manifest.limit(1).count() == 0:
        return manifest.select(
            "file",
            F.lit(0).cast("long").alias("doc_id"),
            F.lit(0).cast("long").alias("place"),
            "n_tokens",
            F.lit(0).cast("long").alias("ids_crc32"),
            F.lit(b"").alias("ids"),
            F.lit(0).cast("long").alias("start"),
        )
    return with_starts(read_token_files(docs.sparkSession, path), manifest)
