"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of all tokens to the power t, normalised. t is bisected between 0
(all sources alike) and 1 (as they come) until the weights' entropy meets a target, or the most
repeated source meets a limit. Each source then gets its weight of the token budget: whole passes
over its documents, and for what is left the first blocks of one more pass in permuted order.

The order of a pass is a hash. Its first ten bits are the block, the next ten the block within,
so the place where a budget ends is found from sums of at most 1,024 blocks, then of the 1,024
within one, then among the documents of one of those: a millionth of a source, at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import BLANKS, hash_pair, identity, matching_rows, table
from ebbtide.session import materialize, settle

MAX_REPEATS = 2.0
SEED = 4
#: Bisection steps taken by one job: all midpoints of that many levels are evaluated together.
LEVELS, STEPS = 5, 40


def n_words(text):
    """Runs of letters between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^" + BLANKS[1:]))


def _evaluated(sources: DataFrame, exponents: list[float], budget: float | None) -> dict:
    """For each exponent: entropy of the weights, most repeats of a source, the budget meant.

    Without a budget the largest source, which is repeated least, is seen once.
    """
    share = F.col("share")
    rows = (
        sources.where("share > 0")
        .select("share", F.explode(F.array(*[F.lit(float(t)) for t in exponents])).alias("t"))
        .groupBy("t")
        .agg(
            F.sum(F.pow(share, F.col("t"))).alias("z"),
            F.sum(F.pow(share, F.col("t")) * F.log(share)).alias("zlog"),
            F.max(F.pow(share, F.col("t") - 1)).alias("top"),
            F.min(F.pow(share, F.col("t") - 1)).alias("low"),
        )
        .collect()
    )
    out = {}
    for r in rows:
        whole = budget if budget is not None else r["z"] / r["low"]
        entropy = math.log(r["z"]) - r["t"] * r["zlog"] / r["z"]
        out[r["t"]] = (entropy, r["top"] / r["z"] * whole, whole)
    return out


def temperature(
    sources: DataFrame,
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget: float | None = None,
) -> tuple[float, float]:
    """The exponent, and the budget as a multiple of all tokens. Both measures fall as it grows."""
    low, high = 0.0, 1.0

    def too_flat(value: tuple) -> bool:
        return value[0] > entropy if entropy is not None else value[1] > max_repeats

    ends = _evaluated(sources, [low, high], budget)
    if not ends:
        return 1.0, 0.0
    if not too_flat(ends[low]):
        return low, ends[low][2]
    if too_flat(ends[high]):
        return high, ends[high][2]
    for _ in range(STEPS // LEVELS):
        cells = 1 << LEVELS
        grid = [low + (high - low) * i / cells for i in range(1, cells)]
        seen = _evaluated(sources, grid, budget)
        at = [low, *grid, high]
        lo, hi = 0, cells
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if too_flat(seen[at[mid]]) else (lo, mid)
        low, high = at[lo], at[hi]
    return high, _evaluated(sources, [high], budget)[high][2]


def _first_of_pass(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents (key columns) that the last, partial pass of their source takes.

    In permuted order a source's documents are taken as long as their tokens fit into `rest`.
    """
    same = lambda a, b, *more: [a[c].eqNullSafe(b[c]) for c in ("source", *more)]
    rows = docs.join(plan, same(docs, plan)).select(docs["*"], plan["rest"]).where("rest > 0")
    taken = []
    for level in ("block", "inner"):
        sums = rows.groupBy("source", level).agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
        upto = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        marked = sums.select(
            F.col("source").alias("_s"), F.col(level).alias("_b"), "before",
            (F.col("before") + F.col("n") <= F.col("rest")).alias("whole"),
        ).where("whole OR before < rest")
        found = rows.join(marked, rows["source"].eqNullSafe(marked["_s"]) & (rows[level] == marked["_b"]))
        taken.append(found.where("whole").select(*docs.columns))
        rows = found.where("NOT whole").select(*docs.columns, (F.col("rest") - F.col("before")).alias("rest"))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "h1", "h2")
    running = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = rows.withColumn("upto", running).where("upto <= rest").select(*docs.columns)
    return taken[0].unionByName(taken[1]).unionByName(last)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    budget_tokens: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """A row per document and pass: doc_id, source, n_tokens, epoch, weight, block, place, h1, h2.

    `entropy` (nats) sets the flatness if given, else `max_repeats`. Without `budget_tokens` the
    budget is the least that sees every document once, so nothing is left out and smaller sources
    repeat. A null source is a source. Null texts have no tokens; sources without any token keep
    one copy of each document. Rows that repeat a document are documents of their own. `place` orders
    a source's pass; an empty table gives no rows. Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    place = F.xxhash64(F.lit(seed), "doc_id", "h1", "h2")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).cast("long").alias("n_tokens"),
            *[h.alias(n) for h, n in zip(hash_pair(text), ("h1", "h2"))],
        )
        .withColumn("place", F.shiftrightunsigned(place, 1))
        .withColumn("block", F.shiftright("place", 53))
        .withColumn("inner", F.shiftright("place", 43).bitwiseAND(F.lit(1023))),
        "mix-documents",
    )
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = materialize(sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), "mix-sources")
    budget = None if budget_tokens is None else budget_tokens / max(total, 1)
    t, budget = temperature(sources, max_repeats, entropy, budget)
    powers = sources.agg(F.sum(F.when(F.col("share") > 0, F.pow("share", F.lit(t))))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(t)) / powers).otherwise(0.0)
    epochs = F.when(F.col("share") > 0, weight * budget / F.col("share")).otherwise(1.0)
    # A whole pass must not be lost to the last bits of a power.
    plan = sources.select("source", weight.alias("weight"), F.floor(epochs + 1e-9).alias("passes"), (
        F.greatest(F.lit(0.0), epochs - F.floor(epochs + 1e-9)) * F.col("tokens")).cast("long").alias("rest"))
    plan = materialize(plan, "mix-plan")
    whole = _whole_passes(rows, plan)
    part = _first_of_pass(rows, plan.select("source", "rest"))
    part = part.join(plan, part["source"].eqNullSafe(plan["source"])).select(
        *[part[c] for c in rows.columns], "weight", (F.col("passes") + 1).alias("epoch")
    )
    return whole.unionByName(part).drop("inner")


def _whole_passes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    passes = F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("passes")))
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(
        *[rows[c] for c in rows.columns], "weight", F.explode(passes).alias("epoch")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mixture takes it, with all their columns.

    Rows alike in id, source and text are taken for one another.
    """

    def taken() -> DataFrame:
        mixed = mix(docs, id_col, text_col, source_col)
        return mixed.groupBy(*identity(F.col("doc_id"), F.col("source")), "h1", "h2").agg(F.count(F.lit(1)).alias("taken"))

    keys = identity(F.col(id_col), F.col(source_col), text=F.col(text_col).cast("string"))
    return matching_rows(docs, keys, settle(taken, "mix-taken"), "taken")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_tokens", "epoch", "weight", "block", "place"
    )
