"""Token ids as files of range-coded blocks, in ascending order of documents.

Documents are dealt by ranges of their id, so files, and blocks within one, follow the ids. A task
tokenises its range and codes it in blocks of at most BLOCK_IDS ids; a longer document goes on in
the next block. A file is a Parquet file with one row per block (file, block, n_ids, payload); each
payload has a magic number, lengths, checksums, the table of its documents and the coded ids, and
can be read by itself. Writing goes through Spark, so any file system and retried tasks are safe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import hash_pair, table
from ebbtide.llm.range_coder import BLOCK_IDS, LANES, crc32_joined, read_blocks, write_blocks
from ebbtide.llm.tokens import public_path, shared_encoder
from ebbtide.session import materialize, shared_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
TEXT_BYTES_PER_FILE = 16 << 20
_LAST = (1 << 63) - 1
_TABLE = np.dtype([("id", "<i8"), ("null", "u1"), ("row", "<u4"), ("part", "<u4"), ("last", "u1"), ("length", "<u4")])
_PARTS = "file int, block int, row long, id long, part int, last boolean, start long, n long, crc long"


def _coder(path: str, drops_blanks: bool, end_id: int):
    """Tokenises the documents of one range and codes them block by block."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(path, drops_blanks)
        end = np.array([end_id], "<u4").tobytes()
        file = TaskContext.get().partitionId()
        row = number = 0
        ready: list[tuple[np.ndarray, bytes]] = []
        pieces: list[np.ndarray] = []
        entries: list[tuple] = []
        room = BLOCK_IDS

        def flush(least: int, most: int) -> Iterator[pd.DataFrame]:
            nonlocal ready, number
            while len(ready) >= least:
                some, ready = ready[:most], ready[most:]
                out = write_blocks(some)
                sizes = [len(ids) for ids, _ in some]
                yield pd.DataFrame({"file": file, "block": range(number, number + len(out)), "n_ids": sizes, "payload": out})
                number += len(out)

        def close() -> None:
            nonlocal pieces, entries, room
            if entries:
                ready.append((np.concatenate(pieces), np.array(entries, _TABLE).tobytes()))
            pieces, entries, room = [], [], BLOCK_IDS

        for batch in batches:
            for low in range(0, len(batch), 256):
                some = batch.iloc[low : low + 256]
                for doc, coded in zip(some["id"], encoder.encode(some["text"].tolist())):
                    ids = np.frombuffer(coded + end, "<u4")
                    null = pd.isna(doc)
                    at = part = 0
                    while at < len(ids):
                        own = ids[at : at + room]
                        at += len(own)
                        pieces.append(own)
                        entries.append((0 if null else int(doc), null, row, part, at == len(ids), len(own)))
                        room -= len(own)
                        part += 1
                        if not room:
                            close()
                    row += 1
                yield from flush(2 * LANES, LANES)
        close()
        yield from flush(1, 2 * LANES)  # in two passes of like width

    return code


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    drops_blanks: bool = True,
    end_id: int = END_ID,
) -> None:
    """Write the ids of all documents, each with `end_id` behind it, as files below `path`.

    The number of files follows the bytes of text. Null texts are empty, null ids come last, and
    rows that share an id come by a hash of their text. An empty table makes no blocks.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("place"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = 1 + size // TEXT_BYTES_PER_FILE
    order = ["place", "h1", "h2"]
    dealt = (
        rows.withColumns(dict(zip(order[1:], hash_pair("text"))))
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("id", "text")
    )
    coder = _coder(tokenizer or public_path(TOKENIZER), drops_blanks, end_id)
    blocks = dealt.mapInPandas(coder, "file int, block int, n_ids long, payload binary")
    blocks.write.option("compression", "none").parquet(path)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per part of a document: its place in its block and the checksum of its ids."""
    for batch in batches:
        for low in range(0, len(batch), 2 * LANES):
            some = batch.iloc[low : low + 2 * LANES]
            out = []
            for file, block, (ids, documents) in zip(some["file"], some["block"], read_blocks(some["payload"].tolist())):
                data = ids.astype("<u4").tobytes()
                at = 0
                for doc, null, row, part, last, length in np.frombuffer(documents, _TABLE).tolist():
                    crc = zlib.crc32(data[4 * at : 4 * (at + length)])
                    out.append((file, block, row, None if null else doc, part, bool(last), at, length, crc))
                    at += length
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])
            yield frame.astype({"id": "Int64"})


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of several parts, which come in order, from the parts' lengths and checksums."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    held: list | None = None
    for batch in batches:
        out = []
        for file, block, row, doc, part, last, start, n, crc in batch[names].astype(object).itertuples(index=False):
            if part == 0:
                held = [file, block, row, None if pd.isna(doc) else doc, 0, True, start, n, crc]
            else:
                held[7], held[8] = held[7] + n, crc32_joined(held[8], crc, 4 * n)
            if last:
                out.append(held)
        yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: id, start (ids before it), n_tokens, ids_crc32.

    Blocks are decoded independently; a damaged one raises an error. Where a file starts follows
    from the files' sums, one row each; where a block starts, from those of its file.
    """
    blocks = spark.read.parquet(path)
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("file", "block", "n_ids")
    files = index.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = index.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(files, "file")
    names = [c.split()[0] for c in _PARTS.split(", ")]
    parts = materialize(
        blocks.select("file", "block", "payload")
        .mapInPandas(_decode, _PARTS)
        .join(starts.select("file", "block", (F.col("base") + F.col("inner")).alias("first")), ["file", "block"])
        .withColumn("start", F.col("first") + F.col("start"))
        .select(*names),
        "token-parts",
    )
    whole = (F.col("part") == 0) & F.col("last")
    split = (
        parts.where(~whole)
        .repartition("file", "row")
        .sortWithinPartitions("file", "row", "part")
        .mapInPandas(_joined, _PARTS)
    )
    return parts.where(whole).unionByName(split).select(
        "id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")
