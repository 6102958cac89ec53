"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints at `max_bits` or fewer differing bits, cut into `max_bits // 2 + 1` segments,
have one segment that differs by at most one bit. Each segment is indexed under itself and under
each variant with one bit made a wildcard; equal keys are joined, and the whole fingerprints
compared in the join. Of a wildcard's key the rows with bit 0 meet those with bit 1, so no pair
comes back from several variants of one segment.

Fingerprints are joined once each, however many documents share one: copies are collapsed first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import components, hash_pair, identity, matching_rows, table
from ebbtide.session import materialize, settle

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits: each is set if it is set in over half of the shingles' XXH64 values."""
    split = (text or "").encode().lower().split()  # of bytes: ASCII letters and blanks only
    if not split:
        return 0
    count = max(1, len(split) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, count, _CHUNK):
        own = split[at : at + _CHUNK + words - 1]
        if len(own) <= words:
            hashes = digest(b" ".join(own), SEED)
        else:
            hashes = b"".join([digest(b" ".join(t), SEED) for t in zip(*[own[i:] for i in range(words)])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h1, h2, fp): the fingerprint of each row, and hashes of its text."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"), *[h.alias(n) for h, n in zip(hash_pair(text), ("h1", "h2"))], fp(text).alias("fp")
    )


def linked_pairs(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints `fp` that link.

    Each fingerprint makes 65 keys at two bits; a key's rows are the fingerprints that agree in one
    segment but for a bit, so its size is bounded by what differs elsewhere, not by copies.
    """
    segments = max_bits // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        mask = ((1 << (high - low)) - 1) << low
        mask -= (mask >> 63) << 64  # as a signed long
        segment = F.col("fp").bitwiseAND(F.lit(mask))
        keys.append(F.struct(F.lit(number * 128 + 64).cast("short").alias("slot"), segment.alias("rest"), F.lit(0).alias("bit")))
        for bit in range(low, high):
            one = 1 << bit if bit < 63 else -(1 << 63)
            set_ = F.col("fp").bitwiseAND(F.lit(one)) != 0
            rest = segment.bitwiseAND(F.lit(~one))
            keys.append(F.struct(F.lit(number * 128 + bit).cast("short").alias("slot"), rest.alias("rest"), set_.cast("int").alias("bit")))
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    whole = F.col("slot") % 128 == 64
    left = index.where(whole | (F.col("bit") == 0)).select("slot", "rest", F.col("fp").alias("x"))
    right = index.where(whole | (F.col("bit") == 1)).select("slot", "rest", F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    once = (F.col("slot") % 128 != 64) | (F.col("x") < F.col("y"))
    # Merged, never broadcast: the size that is estimated for exploded rows is far too small.
    return (
        left.join(right.hint("merge"), ["slot", "rest"])
        .where(near & once)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(id, h1, h2, fp, component_id) for each row; component_id is the smallest id reachable.

    Null and empty texts have fingerprint zero and link like any other. Null ids count as largest:
    a group of null ids only has a null component_id. Rows may repeat; an empty table gives none.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(linked_pairs(distinct.select("fp"), max_bits), "simhash-links")
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")
    )
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    groups = placed.join(smallest, "group").select("fp", "group", "component_id")
    # Stored, so that both sides of the join are plain shuffles and a large group can be split.
    return rows.join(materialize(groups, "fingerprint-groups"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id, with all its columns. Rows that repeat id
    and text are alike: one of them stays."""

    def kept() -> DataFrame:
        groups = near_groups(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
        least = groups.groupBy("group").agg(F.min(F.struct("id", "h1", "h2")).alias("row"))
        return least.select(*identity(F.col("row.id")), "row.h1", "row.h2")

    keys = identity(F.col(id_col), text=F.col(text_col).cast("string"))
    return matching_rows(docs, keys, settle(kept, "kept-one"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
