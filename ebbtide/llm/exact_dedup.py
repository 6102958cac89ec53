"""Exact dedup by deterministic naming: blocks become integers, pairs of integers become integers.

Level 0 sorts the distinct fixed-size blocks of all texts and names each by its place. Level k
names the distinct pairs of neighbouring names of level k - 1, until one name is left for each
text. Equal texts get equal names, different texts of one level different ones, so the identity
(level, name) cannot collide.

The 128-bit key by which a block finds its name is not trusted: the dictionary holds the blocks
themselves, and a key shared by two different blocks makes naming start again with another seed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import BLANKS, hash_pair, identity, matching_rows, table
from ebbtide.session import materialize, release, settle

BLOCK_BYTES = 4096


def normalised(text):
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    """A row per block: row key (id, sha), place, number of blocks, the block and its key."""
    body = F.col("body")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(body) - 1) / size)).cast("int"))
    return (
        docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).cast("binary").alias("body"))
        .select("id", F.sha2(body, 256).alias("sha"), F.length(body).alias("n_bytes"),
                F.posexplode(F.transform(starts, lambda i: F.substring(body, i * size + 1, F.lit(size))))
                .alias("pos", "block"))
        .withColumns(dict(zip(("h1", "h2"), hash_pair("block", seed=seed))))
    )


def _numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """Integer names from 1: the exchange that made the rows distinct deals them out, each task
    sorts its own, and the task number leads the name."""
    return keys.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id() + 1)


def identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, sha, n_bytes, copies, level, name): one row per id and text, `copies` its equal rows.

    The blocks are shuffled once, combined before, so a text that a third of the rows repeat
    reaches a reducer once per map task. Names travel as longs. One number, the most blocks in a
    text, reaches the driver: it sets the number of levels.
    """
    for seed in itertools.count():
        blocks = _blocks(docs, id_col, text_col, block_bytes, seed)
        named = materialize(
            _numbered(blocks.select("h1", "h2", "block").distinct(), ["block"]), "block-names"
        )
        if named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        release(named)
    level = materialize(
        blocks.groupBy("id", "sha", "n_bytes", "pos", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(named.select("h1", "h2", "name"), ["h1", "h2"])
        .select("id", "sha", "n_bytes", "copies", "pos", "name"),
        "level-0",
    )
    release(named)
    most = level.agg(F.max("pos")).first()[0] or 0
    done = []
    rank = 0
    # A text of n blocks ends at level ceil(log2(n)); an odd last block is paired with 0.
    blocks_of = F.greatest(F.lit(1), F.floor((F.col("n_bytes") - 1) / block_bytes) + 1)
    while True:
        last = blocks_of <= 2**rank
        done.append(level.where(last).select("id", "sha", "n_bytes", "copies", F.lit(rank).alias("level"), "name"))
        if 2**rank > most:
            break
        pairs = (
            level.where(~last)
            .groupBy("id", "sha", "n_bytes", "copies", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
            )
        )
        pairs = materialize(pairs, f"pairs-{rank}")
        names = materialize(
            _numbered(pairs.select("left", "right").distinct(), ["left", "right"]), f"names-{rank}"
        )
        level = pairs.join(names, ["left", "right"]).drop("left", "right")
        rank += 1
        level = materialize(level, f"level-{rank}")
        release(pairs)
        release(names)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_bytes, level, name.

    Of equal texts the row with the smallest id stays; null ids count as largest. Of rows that
    repeat both id and text one is kept. Null texts are empty texts. An empty table gives no rows.
    Other columns of `docs` are not read.
    """
    known = settle(lambda: identities(docs, id_col, text_col, block_bytes), "identities")
    groups = known.groupBy("level", "name").agg(
        F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    # Stored, so that both sides of the join are plain shuffles and a large group can be split.
    groups = materialize(groups, "copy-groups")
    return (
        known.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "id", "keep_id", "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"), "n_bytes", "level", "name",
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns. Of rows that repeat id and
    text one stays."""

    def kept() -> DataFrame:
        groups = exact_groups(docs, id_col, text_col).where("kept")
        return groups.select(*identity(F.col("id")), "text_sha256").distinct()

    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    return matching_rows(docs, [*identity(F.col(id_col)), sha], settle(kept, "kept-first"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""
