"""Divergence of sources: segment trees of term counts, shared where they are equal.

The kept terms of a language are dealt to blocks by hash, and numbered within one from the most
frequent on, so that the rare ones, of which most sources have none, lie side by side. Over the counts
of a block every source has a segment tree. Trees are hash-consed: equal subtrees of any sources are
one node (`Forest`). Two sources are compared by walking both trees from the root at once; a pair of
nodes that is met again only raises its multiplicity, so each is priced once. A price is a sum over
terms, hence the prices of the blocks are added per pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.session import materialize

#: A term is in so many documents at least; probabilities are whole billionths.
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10

BLOCK_TERMS = 4096
#: Trees of two tiles of sources meet in a task.
TILE_SOURCES = 64
#: A task hands on its counts when it holds so many different terms.
HELD_TERMS = 200_000

#: ASCII letters in lower case, bytes of other characters as they are, all else a blank.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]
)
_PRICES = "lang string, a string, b string, value long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term and documents that hold it, per group, as far as a task has met them.
    A group is also named by a row of its own, with no term."""
    counts: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def drain() -> pa.RecordBatch:
        rows = [[], [], [], [], []]
        for group, own in counts.items():
            held = documents[group]
            rows[0] += [group[0]] * (len(own) + 1)
            rows[1] += [group[1]] * (len(own) + 1)
            rows[2] += [None, *own]
            rows[3] += [0, *own.values()]
            rows[4] += [0, *map(held.__getitem__, own)]
        counts.clear()
        documents.clear()
        return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _COUNTS)], schema=_COUNTS)

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            some = batch.slice(low, 256)
            for lang, source, text in zip(*[some[c].to_pylist() for c in ("lang", "source", "text")]):
                group = (lang, source)
                terms = text.translate(_LETTERS).split()
                counts.setdefault(group, Counter()).update(terms)
                documents.setdefault(group, Counter()).update(set(terms))
            if sum(map(len, counts.values())) >= HELD_TERMS:
                yield drain()
    yield drain()


def group_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of `docs` that hold the term. The row with
    a null term stands for the group, which may have no terms at all."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        held(lang_col).alias("lang"), held(source_col).alias("source"), held(text_col).cast("binary").alias("text")
    )
    found = rows.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Forest:
    """Segment trees of equal width over counts, with equal subtrees as one node.

    `counts[t]` are the leaves of tree t; the width is filled up with a mark that no count has. Level
    0 names the different counts, level k the different pairs of names of level k - 1: a name is
    a node. `halves[k]` holds the two names under each node of level k + 1.
    """

    def __init__(self, counts: np.ndarray):
        trees, width = counts.shape
        padded = np.full((trees, 1 << max(0, width - 1).bit_length()), -1, np.int64)
        padded[:, :width] = counts
        self.leaves, names = np.unique(padded, return_inverse=True)
        names = names.reshape(padded.shape).astype(np.int64)
        self.halves: list[np.ndarray] = []
        while names.shape[1] > 1:
            pairs = names[:, ::2] << 32 | names[:, 1::2]
            nodes, names = np.unique(pairs, return_inverse=True)
            names = names.reshape(pairs.shape).astype(np.int64)
            self.halves.append(np.stack([nodes >> 32, nodes & 0xFFFFFFFF]))
        self.roots = names[:, 0]

    def meetings(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of counts that trees a and b have at the same leaf, and at how many leaves each."""
        left, right = self.roots[a : a + 1], self.roots[b : b + 1]
        times = np.ones(1, np.int64)
        for halves in reversed(self.halves):
            pairs = (halves[:, left] << 32 | halves[:, right]).ravel()
            met, place = np.unique(pairs, return_inverse=True)
            times = np.bincount(place, np.tile(times, 2), len(met)).astype(np.int64)
            left, right = met >> 32, met & 0xFFFFFFFF
        x, y = self.leaves[left], self.leaves[right]
        real = x >= 0
        return x[real], y[real], times[real]


def probabilities(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), without overflow at any count."""
    if counts.size and int(counts.max()) < 9_000_000_000:
        return 1 + SCALE * (counts + 2) // total
    return np.array([1 + SCALE * (int(c) + 2) // total for c in counts], np.int64)


def _price_block(rows: pa.Table) -> pa.Table:
    """Prices of the pairs of sources of two tiles over one block of terms."""
    lang, low, high = (rows[c][0].as_py() for c in ("lang", "low", "high"))
    tiles, sources = rows["tile"].to_pylist(), rows["source"].to_pylist()
    totals, width = [int(t) for t in rows["total"].to_pylist()], rows["width"][0].as_py()
    counts = np.zeros((len(sources), width), np.int64)
    for own, terms, found in zip(counts, rows["terms"].to_pylist(), rows["counts"].to_pylist()):
        own[np.array(terms or [], np.int64)] = found or []
    forest = Forest(counts)
    order = sorted(range(len(sources)), key=lambda i: (tiles[i], sources[i]))
    out = []
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if low != high and tiles[i] == tiles[j]:
                continue  # both are of one tile, which meets itself elsewhere
            x, y, times = forest.meetings(i, j)
            p, q = probabilities(x, totals[i]), probabilities(y, totals[j])
            out.append((lang, sources[i], sources[j], int(((p - q) * (p - q) // (p + q)) @ times)))
    columns = list(zip(*out)) if out else [[]] * 4
    types = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "a", "b", "value"])


def numbered_terms(terms: DataFrame, sizes: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """`terms` (lang, term, lang_n) with a block, and an id within it, the most frequent first."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept_terms") / block_terms))
    by_count = Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")
    return (
        terms.join(sizes.select("lang", blocks.alias("blocks")), "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
        .select("lang", "term", "lang_n", "block", (F.row_number().over(by_count) - 1).alias("id"))
    )


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two sources a < b of a language.

    `kept` are the counts of kept terms (lang, source, block, id, n), `groups` the sources (lang,
    source, total). A task holds the trees of two tiles of sources over one block of terms.
    """
    tiles = F.ceil(F.count(F.lit(1)) / TILE_SOURCES).alias("tiles")
    tiled = groups.join(groups.groupBy("lang").agg(tiles), "lang").withColumn(
        "tile", F.pmod(F.xxhash64("source"), "tiles")
    )
    widths = kept.groupBy("lang", "block").agg((F.max("id") + 1).alias("width"))
    lists = kept.groupBy("lang", "block", "source").agg(F.collect_list(F.struct("id", "n")).alias("own"))
    forest = (
        tiled.join(widths, "lang")
        .join(lists, ["lang", "block", "source"], "left")
        .select(
            "lang", "block", "source", "tile", "total", "width", F.col("own.id").alias("terms"),
            F.col("own.n").alias("counts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"),
        )
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .drop("other")
    )
    prices = forest.groupBy("lang", "block", "low", "high").applyInArrow(_price_block, _PRICES)
    return prices.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence_audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language
    (part `pair`), and the terms it has more of than the language (part `term`, ten at most).

    Null texts, languages and sources are read as empty. Every row is a document, also a repeated one
    and one without id; ids and other columns are not read. A group without terms has pairs of its own;
    a language without kept terms has pairs of value 0. An empty table gives no rows. Texts of any
    length are split in one pass. Ties go to the smaller item in UTF-8.
    """
    found = materialize(group_terms(docs, text_col, lang_col, source_col), "group-terms")
    terms = (
        found.where("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
        .where(F.col("lang_docs") >= least_docs)
        .drop("lang_docs")
    )
    terms = materialize(terms, "terms")
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"), F.sum("lang_n").alias("lang_total"))
    numbered = numbered_terms(terms, sizes, block_terms)
    kept = materialize(found.drop("docs").join(numbered, ["lang", "term"]), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    groups = materialize(
        found.where("term IS NULL")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select(
            "lang", "source", F.col("kept_terms").isNotNull().alias("has_terms"),
            (F.coalesce("n", none) + 2 * F.col("kept_terms")).alias("total"),
            (F.col("lang_total") + 2 * F.col("kept_terms")).alias("lang_total"),
        ),
        "source-groups",
    )
    pairs = materialize(source_pairs(kept, groups.where("has_terms")), "source-pairs")
    bare = groups.where("NOT has_terms")
    pairs = pairs.unionByName(
        bare.select("lang", F.col("source").alias("a"))
        .join(bare.select("lang", F.col("source").alias("b")), "lang")
        .where("a < b")
        .withColumn("value", none)
    )
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    share = "1 + ((CAST({0} AS DECIMAL(28,0)) + 2) * {1}BD) div CAST({2} AS DECIMAL(20,0))".format
    over = (
        kept.where("n > 0")
        .join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").cast("string").alias("item"),
                F.expr(share("n", SCALE, "total")).alias("p"), F.expr(share("lang_n", SCALE, "lang_total")).alias("q"))
        .where("p > q")
        .select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    )
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumns({"part": F.lit("pair"), "rank": ranked})
        .select(columns)
        .unionByName(
            over.withColumns({"part": F.lit("term"), "rank": ranked}).where(F.col("rank") <= TOP_TERMS).select(columns)
        )
    )


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
           LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x
           ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
     t AS (SELECT lang, source, sum(n) + 2 * count(*) AS total, sum(lang_n) + 2 * count(*) AS lang_total
           FROM c GROUP BY lang, source),
     p AS (SELECT lang, source, term, n, CAST(1 + 1000000000 * CAST(n + 2 AS HUGEINT) // total AS BIGINT) AS p,
           CAST(1 + 1000000000 * CAST(lang_n + 2 AS HUGEINT) // lang_total AS BIGINT) AS q
           FROM c JOIN t USING (lang, source)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
           FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
           LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
           UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
     s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 10
"""
