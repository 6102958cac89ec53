"""Line dedup over overlapping windows of three lines.

Each three consecutive lines of a document are hashed. A window that occurred before, in a document
with a smaller id or further up in the same one, is a repetition; its lines are covered, and covered
lines are merged into spans and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import hash_pair, table
from ebbtide.session import materialize

WINDOW_LINES = 3
_LAST = (1 << 63) - 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's key (its id, null as the largest, and hashes of its text) and its lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("place"),
        F.col(id_col).alias("id"),
        *[h.alias(n) for h, n in zip(hash_pair(text), ("h1", "h2"))],
        F.split(text, "\n", -1).alias("lines"),
    )


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """(place, h1, h2, line, k1, k2): the 128-bit key of the window that starts at each line."""
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size))
    own = lambda i: [F.get("lines", i + j) for j in range(size)]
    keys = F.transform(starts, lambda i: F.struct(*[h.alias(n) for h, n in zip(hash_pair(*own(i)), ("k1", "k2"))]))
    return rows.select("place", "h1", "h2", F.posexplode(keys).alias("line", "key")).select(
        "place", "h1", "h2", "line", "key.k1", "key.k2"
    )


def covered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES) -> DataFrame:
    """(place, h1, h2, starts, stops): the lines from starts[i] up to stops[i] are covered.

    First places of windows are an aggregate combined before its shuffle; only windows that occur
    more than once go on. What is gathered per row is bounded by the row's own lines.
    """
    windows = _windows(_rows(docs, id_col, text_col), size)
    first = (
        windows.groupBy("k1", "k2")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # Stored, so that both sides of the join are plain shuffles and a frequent window can be split.
    first = materialize(first, "first-windows")
    row = ["place", "h1", "h2"]
    later = (
        windows.join(first, ["k1", "k2"])
        .groupBy(*row, "k1", "k2", "first")
        .agg(F.array_sort(F.collect_set("line")).alias("lines"))
        .select(
            *row,
            F.explode(
                F.when(F.col("place") > F.col("first"), F.col("lines")).otherwise(F.slice("lines", 2, F.size("lines")))
            ).alias("line"),
        )
    )
    covered = later.select(*row, F.explode(F.sequence("line", F.col("line") + (size - 1))).alias("line"))
    merged = covered.groupBy(*row).agg(F.array_sort(F.collect_set("line")).alias("p"))
    before = lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1)
    after = lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1)
    return merged.select(
        *row, F.filter("p", before).alias("starts"), F.transform(F.filter("p", after), lambda x: x + 1).alias("stops")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, n_spans, kept_text.

    Lines end at \\n and are compared as they are; null texts are empty, of one empty line. Texts of
    fewer than `size` lines have no window and stay. Null ids count as largest; rows that share an
    id come neither before nor after one another. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    found = rows.join(covered_spans(docs, id_col, text_col, size), ["place", "h1", "h2"], "left")
    none = F.array().cast("array<int>")
    found = found.withColumns({c: F.coalesce(c, none) for c in ("starts", "stops")})
    # What stays lies between the end of one span and the start of the next.
    parts = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("stops")),
        F.concat(F.col("starts"), F.array(F.size("lines"))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    kept = F.transform(F.filter(parts, lambda p: p["b"] > p["a"]), lambda p: F.slice("lines", p["a"] + 1, p["b"] - p["a"]))
    removed = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    return found.select(
        "id",
        F.size("lines").alias("n_lines"),
        removed.alias("n_removed"),
        F.size("starts").alias("n_spans"),
        F.array_join(F.flatten(kept), "\n").alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "n_spans", F.md5("kept_text").alias("kept_md5")
    )


OP5_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     p AS (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l),
     w AS (SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS k
           FROM p WHERE i + 3 <= len(lines)),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
     c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r WHERE n > 1),
     s AS (SELECT p.doc_id, p.i, p.lines[p.i + 1] AS line, c.i IS NOT NULL AS gone,
                  lag(c.i IS NOT NULL, 1, false) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS was
           FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
       CAST(count(*) FILTER (WHERE gone AND NOT was) AS INTEGER) AS n_spans,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM s GROUP BY doc_id
"""
