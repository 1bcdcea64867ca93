"""Fill-in-the-middle texts by a parallel scan with a finite automaton.

One automaton reads UTF-8 bytes and knows whether a line begins and how much of
a control string has been read.  A piece of a text does not know in which state
it is entered, so it emits a function: for each state the state at its end, how
many lines begin in it and how many control strings end in it.  Functions
compose associatively, which gives each piece its entry state and the lines
before it; then the pieces that hold a cut are selected, and only these are
read again.  A text of one piece needs no shuffle.  The pieces of longer texts
are dealt to all tasks, and what meets by text are their functions.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, save, scratch

#: Bytes of a piece.  Spark's texts have less than 2**31 bytes, so a text has at most 2**16 pieces.
PIECE_BYTES = 1 << 15
#: Control strings before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


class LineMachine:
    """Counts lines that begin and control strings that end, over bytes.

    A state is a pair: the longest begin of a control string that was just
    read, and whether a line is under way.  Bytes that occur in no control
    string are one class; reading it twice is the same as reading it once.
    """

    def __init__(self, marks: tuple[str, ...]):
        names = [m.encode() for m in marks]
        heads = sorted({m[:k] for m in names for k in range(len(m))}, key=lambda h: (len(h), h))
        known = sorted({*b"\n", *b"".join(names)})
        self.other = len(known)
        self.classes = np.full(256, self.other, np.uint8)
        self.classes[known] = np.arange(self.other)
        states = [(h, inside) for h in heads for inside in (False, True)]
        number = {s: k for k, s in enumerate(states)}
        self.start = number[b"", False]
        shape = (self.other + 1, len(states))
        self.step, self.begins, self.ends = np.zeros(shape, np.uint8), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for c, byte in enumerate([bytes([b]) for b in known] + [None]):
            for k, (head, inside) in enumerate(states):
                grown = head + byte if byte else b""
                rest = next(grown[j:] for j in range(len(grown) + 1) if grown[j:] in heads)
                self.step[c, k] = number[rest, byte != b"\n"]
                self.begins[c, k] = not inside
                self.ends[c, k] = any(grown.endswith(m) for m in names)

    def symbols(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the bytes and where they stand; of a run of other bytes the first one only."""
        found = self.classes[np.frombuffer(data, np.uint8)]
        plain = found == self.other
        plain[1:] &= plain[:-1].copy()
        plain[:1] = False
        at = np.flatnonzero(~plain)
        return found[at], at

    def function(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry state: the last state, lines begun, control strings ended."""
        found, _ = self.symbols(data)
        return compose(self.step[found], self.begins[found], self.ends[found])

    def line_starts(self, data: bytes, entry: int) -> np.ndarray:
        """Offsets of the bytes that begin a line, where the state before the first byte is known."""
        found, at = self.symbols(data)
        moves = self.step.tolist()
        before = [*itertools.accumulate(found.tolist(), lambda state, c: moves[c][state], initial=entry)][:-1]
        return at[self.begins[found, before] > 0]


def compose(step: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of all rows, one after the other, by composing neighbours until one row is left."""
    states = step.shape[1]
    if not len(step):
        return np.arange(states, dtype=np.uint8), np.zeros(states, np.int64), np.zeros(states, np.int64)
    while len(step) > 1:
        odd = len(step) % 2
        tail = (step[-odd:], begins[-odd:], ends[-odd:]) if odd else None
        n = len(step) - odd
        via = step[0:n:2].astype(np.intp)
        begins = begins[0:n:2] + np.take_along_axis(begins[1:n:2], via, 1)
        ends = ends[0:n:2] + np.take_along_axis(ends[1:n:2], via, 1)
        step = np.take_along_axis(step[1:n:2], via, 1)
        if tail:
            step, begins, ends = (np.concatenate(x) for x in zip((step, begins, ends), tail))
    return step[0], begins[0], ends[0]


@functools.lru_cache(maxsize=4)
def machine_of(marks: tuple[str, ...]) -> LineMachine:
    """The machine of some control strings, once in each worker process."""
    return LineMachine(marks)


def code_points(data: bytes) -> int:
    """Characters of UTF-8 bytes: all but continuation bytes begin one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def bound(data: bytes, k: int, width: int) -> int:
    """Where piece ``k`` begins: at ``k * width`` or at the begin of the character that lies there."""
    at = min(k * width, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def cut_lines(n: int, first: int, second: int) -> tuple[int, int]:
    """How many lines stand before the first and before the second cut."""
    a, b = first % (n + 1), second % (n + 1)
    return min(a, b), max(a, b)


def hash_part(seed: int, key: Column, k: int) -> Column:
    """The k-th 8-digit group of the hex SHA-256 of ``seed:key`` as a number; a null key is an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


FOUND = "n long, marks long, first long, second long"
PIECES = "row long, h1 long, h2 long, at int, piece binary"
FUNCTIONS = "row long, h1 long, h2 long, at int, chars long, step array<int>, begins array<long>, ends array<long>"
CHOSEN = "row long, n long, marks long, ats array<int>, entries array<int>, ranks array<long>, chars array<long>"


def fill_in_middle(
    docs: DataFrame,
    *,
    seed: int = 7,
    rate: int = 100,
    suffix_first: int = 50,
    marks: tuple[str, str, str] = MARKS,
    piece_bytes: int = PIECE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row.

    The n lines of a text keep their line feeds.  Two hashes of ``seed`` and id
    choose how many lines are prefix and how many end the middle; of a hundred
    texts about ``rate`` are changed, and of these about ``suffix_first`` have
    the suffix before the prefix (form ``spm``, otherwise ``psm``).  Empty and
    null texts, and texts that hold a control string, stay as they are (form
    ``plain``, null prefix_chars and middle_chars).  A null id is hashed as an
    empty string.  Repeated rows and ids give repeated results; an empty table
    gives an empty one; other columns are ignored.

    Texts longer than a piece are written once, since their pieces are read
    in other tasks.  What is gathered by text is at most 2**16 functions.
    """
    spark = docs.sparkSession
    machine = machine_of(marks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"h1": hash_part(seed, F.col("doc_id"), 1), "h2": hash_part(seed, F.col("doc_id"), 2)})

    @F.arrow_udf(FOUND)
    def scan(data: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = []
        for raw, h1, h2 in zip(data.to_pylist(), first.to_pylist(), second.to_pylist()):
            _, begins, ends = machine.function(raw)
            n = int(begins[machine.start])
            starts = np.append(machine.line_starts(raw, machine.start), len(raw))
            cuts = [code_points(raw[: starts[k]]) for k in cut_lines(n, h1, h2)]
            found.append((n, int(ends[machine.start]), *cuts))
        return structs(found, ("n", "marks", "first", "second"))

    short = rows.where(F.octet_length("text") <= piece_bytes).withColumn(
        "found", scan(F.col("text").cast("binary"), F.col("h1"), F.col("h2"))
    )
    short = short.select("doc_id", "text", "found.*")
    giants = save(
        rows.where(F.octet_length("text") > piece_bytes).withColumn("row", F.monotonically_increasing_id()), f"{scratch(spark)}/long-texts"
    )

    def pieces(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for row, h1, h2, raw in zip(*columns, batch.column(3)):
                raw = raw.as_py()
                ends = [bound(raw, k, piece_bytes) for k in range(-(-len(raw) // piece_bytes) + 1)]
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([h1]), pa.array([h2]), pa.array([k], pa.int32()), pa.array([raw[a:b]], pa.binary())],
                        names=["row", "h1", "h2", "at", "piece"],
                    )

    def functions_of(batches):
        for batch in batches:
            raws = batch.column(4).to_pylist()
            found = [machine.function(raw) for raw in raws]
            arrays = [pa.array([x[k].tolist() for x in found], kind) for k, kind in enumerate((pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(4)] + [pa.array(map(code_points, raws), pa.int64())] + arrays,
                names=["row", "h1", "h2", "at", "chars", "step", "begins", "ends"],
            )

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        lists = {name: table.column(name).to_pylist() for name in table.column_names}
        step, begins, ends = (np.array(lists[name]) for name in ("step", "begins", "ends"))
        entries = [*itertools.accumulate(step, lambda state, row: int(row[state]), initial=machine.start)][:-1]
        which = np.arange(len(step))
        lines = np.concatenate(([0], np.cumsum(begins[which, entries])))
        chars = np.concatenate(([0], np.cumsum(lists["chars"])))
        n, chosen = int(lines[-1]), []
        for rank in cut_lines(n, lists["h1"][0], lists["h2"][0]):
            k = int(np.searchsorted(lines, rank, side="right")) - 1  # the piece in which line number ``rank`` begins
            chosen.append((-1, 0, 0, int(chars[-1])) if rank == n else (lists["at"][k], entries[k], rank - int(lines[k]), int(chars[k])))
        ats, states, ranks, before = (list(x) for x in zip(*chosen))
        row = {"row": lists["row"][0], "n": n, "marks": int(ends[which, entries].sum()), "ats": ats, "entries": states, "ranks": ranks, "chars": before}
        return pa.Table.from_pylist([row], schema=ARROW_CHOSEN)

    @F.arrow_udf("array<long>")
    def locate(data: pa.Array, ats: pa.Array, entries: pa.Array, ranks: pa.Array, chars: pa.Array) -> pa.Array:
        found = []
        for raw, *chosen in zip(data, *(x.to_pylist() for x in (ats, entries, ranks, chars))):
            raw, cuts = raw.as_py(), []
            for at, entry, rank, before in zip(*chosen):
                piece = raw[bound(raw, at, piece_bytes) : bound(raw, at + 1, piece_bytes)] if at >= 0 else b""
                cuts.append(before + (code_points(piece[: machine.line_starts(piece, entry)[rank]]) if at >= 0 else 0))
            found.append(cuts)
        return pa.array(found, pa.list_(pa.int64()))

    dealt = giants.select("row", "h1", "h2", F.col("text").cast("binary")).mapInArrow(pieces, PIECES).repartition("row", "at")
    chosen = dealt.mapInArrow(functions_of, FUNCTIONS).groupBy("row").applyInArrow(choose, CHOSEN)
    chosen = few(save(chosen, f"{scratch(spark)}/cuts"))
    cuts = locate(F.col("text").cast("binary"), *map(F.col, ("ats", "entries", "ranks", "chars")))
    long = giants.join(chosen, "row").withColumn("cuts", cuts)
    long = long.select("doc_id", "text", "n", "marks", F.col("cuts")[0].alias("first"), F.col("cuts")[1].alias("second"))

    key = F.col("doc_id")
    plain = (F.col("n") == 0) | (F.col("marks") > 0) | (hash_part(seed, key, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(hash_part(seed, key, 4) % 100 < suffix_first, "spm").otherwise("psm")
    prefix, middle, suffix = (F.expr(x) for x in ("substring(text, 1, int(first))", "substring(text, 1 + int(first), int(second - first))", "substring(text, 1 + int(second))"))
    p, s, m = map(F.lit, marks)
    changed = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return (
        short.unionByName(long)
        .withColumn("form", form)
        .select(
            "doc_id",
            "n",
            "form",
            F.when(F.col("form") != "plain", F.col("first")).alias("prefix_chars"),
            F.when(F.col("form") != "plain", F.col("second") - F.col("first")).alias("middle_chars"),
            F.when(F.col("form") == "plain", F.col("text")).otherwise(changed).alias("output"),
        )
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of.

    A changed text holds each control string once, as the original held none
    and none can form where parts meet, so splitting at them gives the parts.
    """
    escaped = "|".join("".join(f"\\x{b:02x}" for b in m.encode()) for m in marks)
    parts = F.split(output, escaped, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def structs(rows: list[tuple], names: tuple[str, ...]) -> pa.Array:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


ARROW_CHOSEN = pa.schema(
    [
        ("row", pa.int64()),
        ("n", pa.int64()),
        ("marks", pa.int64()),
        ("ats", pa.list_(pa.int32())),
        ("entries", pa.list_(pa.int32())),
        ("ranks", pa.list_(pa.int64())),
        ("chars", pa.list_(pa.int64())),
    ]
)
