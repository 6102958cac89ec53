"""Harmonic packing: a class for each reciprocal of the capacity, a fixed number of pieces a bin.

Class k takes the lengths above capacity / (k + 1) and up to capacity / k, and k of its pieces fill a
sequence. No length has to be compared with another one, so each task fills the bins of its own
classes while its documents stream by, holding fewer than k pieces of class k.

A document is cut where that pays: `cut_plan` finds the cuts at exact reciprocals (whose pieces leave
no room in their bins) that cost least, a cut counted as CUT_PRICE tokens of padding. What a task is
left with in unfinished bins is a few sequences at most; the leftovers of FAN tasks meet in one, until
one holds them all. There they are chained and cut to full sequences, the rest to powers of two, which
are not padded.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.llm.tokens import public_path, shared_encoder
from ebbtide.session import materialize

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: A cut is worth it where it saves more tokens of padding than this.
CUT_PRICE = 8
#: Tasks whose leftovers meet in one: each leaves less than a sequence per class, 90 classes at 2,048.
FAN = 64

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, ids binary, part long"
_ARROW = pa.schema(
    [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _PLACED.split(", ")]
)


@functools.cache
def cut_plan(capacity: int = CAPACITY, price: float = CUT_PRICE) -> list[tuple[int, ...]]:
    """For each length below the capacity, the lengths of its pieces."""
    heads = sorted({capacity // k for k in range(2, capacity + 1)}, reverse=True)
    spare = [0.0] + [(capacity - capacity // s * s) / (capacity // s) for s in range(1, capacity + 1)]
    cost, plan = [0.0], [()]
    for length in range(1, capacity):
        best, first = spare[length], length
        for head in heads:
            if head < length and price + spare[head] + cost[length - head] < best:
                best, first = price + spare[head] + cost[length - head], head
        cost.append(best)
        plan.append((first, *plan[length - first]) if first < length else (length,))
    return plan


def piece_lengths(tokens: int, capacity: int = CAPACITY, price: float = CUT_PRICE) -> tuple[int, ...]:
    """Full pieces first, then those of the plan for the rest."""
    return (capacity,) * (tokens // capacity) + cut_plan(capacity, price)[tokens % capacity]


class _Bins:
    """The unfinished bin of each class of one task, and the rows of finished ones."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next, self.open, self.rows = capacity, first_sequence, {}, []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length, crc, tokens, _ in pieces:
            self.rows.append((doc, start, length, crc, tokens, self.next, offset, None, None))
            offset += length
        self.next += 1

    def add(self, piece: tuple) -> None:
        count = self.capacity // piece[2]
        if count == 1:
            return self.close([piece])
        waiting = self.open.setdefault(count, [])
        waiting.append(piece)
        if len(waiting) == count:
            self.close(self.open.pop(count))

    def chain(self) -> None:
        """Finish with full sequences of what is left, and powers of two of the rest."""
        left = sorted((p for ps in self.open.values() for p in ps), key=lambda p: -p[2])
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
        own, room = [], sizes[0] if sizes else 0
        sizes = iter(sizes[1:])
        for doc, start, length, _, tokens, ids in left:
            at = 0
            while at < length:
                size = min(room, length - at)
                part = ids[4 * at : 4 * (at + size)]
                own.append((doc, start + at, size, zlib.crc32(part), tokens, part))
                at, room = at + size, room - size
                if not room:
                    self.close(own)
                    own, room = [], next(sizes, 0)
        self.open = {}

    def drain(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def leave(self, part: int) -> pa.RecordBatch:
        """The pieces of unfinished bins, with their ids, for the next round."""
        for pieces in self.open.values():
            self.rows += [(*p[:5], None, None, p[5], part) for p in pieces]
        return self.drain()


def _first_round(tokenizer: str, drops_blanks: bool, end_id: int, capacity: int, price: float):
    """Tokenises documents, cuts them and fills bins, in one pass over the texts of a task."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, drops_blanks)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        bins = _Bins(capacity, part << 32)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                for doc, ids in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"].to_pylist())):
                    ids += end
                    tokens = len(ids) // 4
                    start = 0
                    for length in piece_lengths(tokens, capacity, price):
                        own = ids[4 * start : 4 * (start + length)]
                        bins.add((doc, start, length, zlib.crc32(own), tokens, own))
                        start += length
                yield bins.drain()
        yield bins.leave(part)

    return fill


def _next_round(number: int, capacity: int, last: bool):
    """Goes on with the leftovers of several tasks; the last round leaves none."""

    def fill(left: pa.Table) -> pa.Table:
        part = left["part"][0].as_py()
        bins = _Bins(capacity, (number << 58) + (part << 32))
        names = [c.split()[0] for c in _PIECE.split(", ")]
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        for piece in zip(*[left.sort_by(order)[c].to_pylist() for c in (*names, "ids")]):
            bins.add(piece)
        if last:
            bins.chain()
        return pa.Table.from_batches([bins.leave(part)])

    return fill


def pack_harmonic(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    drops_blanks: bool = True,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    price: float = CUT_PRICE,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Null texts count as empty: their only token is the end id. Rows that repeat an id or a whole row
    are packed as documents of their own, null ids stay null. A document of any length is cut within
    one task. An empty table gives no rows. Other columns are not read. The driver learns the number
    of parts with leftovers.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    first = _first_round(tokenizer or public_path(TOKENIZER), drops_blanks, end_id, capacity, price)
    filled = materialize(rows.mapInArrow(first, _PLACED), "harmonic-0")
    done = filled.where("sequence_id IS NOT NULL")
    left = filled.where("sequence_id IS NULL")
    parts = 1 + (left.agg(F.max("part")).first()[0] or 0)
    number, last = 0, False
    while not last:
        number, parts = number + 1, -(-parts // FAN)
        last = parts == 1
        met = left.withColumn("part", F.floor(F.col("part") / FAN))
        filled = materialize(
            met.groupBy("part").applyInArrow(_next_round(number, capacity, last), _PLACED), f"harmonic-{number}"
        )
        done = done.unionByName(filled.where("sequence_id IS NOT NULL"))
        left = filled.where("sequence_id IS NULL")
    return done.drop("ids", "part")


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_harmonic(table(spark, sf_dir, "documents"))
