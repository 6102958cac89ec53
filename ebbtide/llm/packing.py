"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are tokenised, and longer ones cut. Pieces are dealt at random to partitions of a fixed
number of rows; each packs its own by best fit decreasing. Dual-feasible functions give a lower
bound of a partition's bins. Where best fit reaches it, the partition is certified: no packing of
its pieces is shorter, and it gives away its emptiest bin only. Where it doesn't, it gives away
every bin with room. What was given away is dealt anew and packed again, until it fits one
partition or a round needs as many bins for it as it had before; the last round keeps all its bins.
How many partitions of a round are certified is logged.
"""

from __future__ import annotations

import itertools
import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.llm.tokens import public_path, shared_encoder
from ebbtide.session import materialize

CAPACITY = 2048
END_ID = 0
ROWS_PER_TASK = 1 << 16
TOKENIZER = "byte_bpe_50k.json"

_LOG = logging.getLogger(__name__)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def cut_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: all of full length but the first, which has the rest."""
    rest = tokens % capacity
    return ([rest] if rest else []) + [capacity] * (tokens // capacity)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the greatest bound of two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    total = count * np.arange(capacity + 1)
    number, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(total)])
    best = -(-int(volume[-1]) // capacity)
    # Pieces below `small` count nothing, those above capacity - small a whole bin.
    small = np.arange(1, capacity // 2 + 1)
    big = number[-1] - number[capacity - small + 1]
    half = capacity // 2 + 1
    middle = number[capacity - small + 1] - number[half]
    room = middle * capacity - (volume[capacity - small + 1] - volume[half])
    fill = volume[half] - volume[small]
    best = max(best, int((big + middle + np.maximum(0, -(-(fill - room) // capacity))).max()))
    # Sizes rounded down to multiples of capacity / k, those that are multiples of 1 / (k + 1) kept.
    size = np.arange(capacity + 1)
    for k in range(1, 64):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the bins' rooms, by best fit decreasing.

    Bins are kept by room; a bit mask of the rooms that occur finds the tightest one.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, own = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = own, capacity - room
        room -= size
        rooms[own] = room
        if room:
            by_room[room].append(own)
            mask |= 1 << room
    return bins, offsets, np.array(rooms, np.int64)


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """A row per piece of each document, with a number of its own; ids stay in the task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(tokenizer, False)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                for doc, ids in zip(some["doc_id"], encoder.encode(some["text"].tolist())):
                    ids += end
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        out.append((doc, piece, start, length, crc, number))
                        start += length
                        number += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInPandas(cut, _PIECES)


def _packer(capacity: int, number: int, last: bool):
    """Packs the pieces of one partition and marks those that it gives away."""

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy(np.int64)
        bins, offsets, rooms = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        given = np.zeros(len(rooms), bool)
        if not last:
            if len(rooms) > bound:
                given = rooms > 0
            else:
                given[np.argmax(rooms)] = True
        part = int(frame["part"].iloc[0])
        frame = frame.drop(columns="part")
        # below zero, as full pieces have their own number
        frame["sequence_id"] = -1 - ((number << 52) + (part << 24) + bins)
        frame["offset"], frame["given"] = offsets, given[bins]
        frame["bound"], frame["bins"] = bound, len(rooms)
        return frame

    return fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of `pieces` (uid, length, others) with sequence_id and offset.

    A full piece is a sequence by itself. Rounds go on as long as they lower the number of bins. The driver
    learns five numbers a round. Which of equal pieces goes where follows from hashes of uid.
    """
    done = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")}
    )
    schema = f"{_PIECES}, sequence_id long, offset long, given boolean, bound long, bins long"
    left = pieces.where(F.col("length") < capacity)
    before = None
    for number in itertools.count(1):
        rows = left.count()
        if not rows:
            break
        parts = -(-rows // rows_per_task)
        part = F.pmod(F.xxhash64(F.lit(number), "uid"), F.lit(parts)).alias("part")
        packed = materialize(
            left.select(part, *pieces.columns).groupBy("part").applyInPandas(_packer(capacity, number, parts == 1), schema),
            f"packed-{number}",
        )
        bins = packed.groupBy("sequence_id").agg(F.first("given").alias("given"), F.first("bound").alias("bound"), F.first("bins").alias("bins"))
        # each partition's figures once: a bin stands for a share of its partition
        found = bins.agg(
            F.count(F.lit(1)).alias("bins"), F.count_if("given").alias("given"), F.sum(F.col("bound") / F.col("bins")).alias("bound"),
            F.sum(F.when(F.col("bins") == F.col("bound"), 1 / F.col("bins"))).alias("certified"),
        ).first()
        _LOG.info(
            "round %d: %d bins, bound %.0f, %.0f of %d partitions certified", number, found["bins"], found["bound"], found["certified"] or 0, parts
        )
        columns = [*pieces.columns, "sequence_id", "offset"]
        if parts == 1 or (before is not None and found["bins"] >= before):
            done = done.unionByName(packed.select(*columns))
            break
        done = done.unionByName(packed.where("NOT given").select(*columns))
        left, before = packed.where("given").select(*pieces.columns), found["given"]
    return done


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Null texts count as empty: their only token is the end id. Rows that repeat an id, and rows with a
    null id, which stays null, are packed as documents of their own. An empty table gives no rows. Other columns are not read.
    """
    path = tokenizer or public_path(TOKENIZER)
    pieces = materialize(token_pieces(docs, id_col, text_col, path, capacity), "token-pieces")
    return pack(pieces, capacity).drop("uid")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
