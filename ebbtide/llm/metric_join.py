"""Exact metric range join of embeddings: all pairs of equal label at or above a cosine.

On the unit sphere a least cosine c is a greatest distance r = sqrt(2 - 2c). Each label's vectors are
dealt to cells, each to the cell of its nearest pivot (its home). For a vector y with nearest pivot b
and any x of cell a at distance r or less, the triangle inequality gives d(y,a) - d(y,b) <= 2r, and the
plane between a and b, on whose far side x lies, the sharper d(y,a)^2 - d(y,b)^2 <= 2r d(a,b). y visits
the cells for which that holds. Of two cells only the vectors of the later one visit, so each pair is
met once. Cells with too many homes are split again by pivots of their own, unless pivots do not take
them apart (as with many vectors of one direction): then their homes are dealt to blocks, and those of
later blocks visit the earlier ones. Cells are joined independently of each other, visitors in blocks.

Equal vectors are collapsed first. A cell gives back counts and, for the components, one edge per
vector, not its pairs. No pivot table is broadcast: pivots go to the blocks of their own cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import components, table
from ebbtide.session import materialize

MIN_COSINE = 0.93
CELL_ROWS = 2048
PIVOTS = 64
BLOCK_ROWS = 8192
#: A cell that keeps more than this share of its parent's homes is not split again.
MOST_KEPT = 0.75
_SLACK = 1e-9
_LAST = (1 << 63) - 1


def _unit(vectors: pd.Series) -> np.ndarray:
    raw = np.array(vectors.tolist(), np.float64)
    # by powers of two, which leaves all digits, so that no square gets too large or small
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _assigner(radius: float):
    """Deals one block of a cell to its pivots' cells: homes to the nearest, visitors where needed."""

    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows.drop(columns="salt")
        pivots = pivots.sort_values("p_node")
        if len(pivots) < 2:
            return rows.drop(columns="salt").assign(cell=rows["cell"] + "/")
        own, at = _unit(rows["vec"]), _unit(pivots["p_vec"])
        squared = np.maximum(0.0, 2 - 2 * own @ at.T)
        nearest = squared.argmin(axis=1)
        between = np.sqrt(np.maximum(0.0, 2 - 2 * at @ at.T))
        least = squared[np.arange(len(own)), nearest]
        visits = squared - least[:, None] <= 2 * radius * between[nearest] + _SLACK
        home = rows["home"].to_numpy(bool)
        cells = np.arange(len(at))
        # A home visits earlier cells only; a visitor goes wherever it may meet a home.
        visits &= ~home[:, None] | (cells[None, :] < nearest[:, None])
        visits[home, nearest[home]] = True
        who, where = np.nonzero(visits)
        out = rows.drop(columns="salt").iloc[who].copy()
        out["cell"] = out["cell"] + "/" + where.astype(str)
        out["home"] = home[who] & (where == nearest[who])
        return out

    return assign


def _matcher(min_cosine: float):
    """Joins the homes of a cell with each other (block 0) and with one block of its visitors."""

    def linked(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = unit_a @ unit_b.T
        found = cosine >= min_cosine + _SLACK
        for i, j in zip(*np.nonzero(np.abs(cosine - min_cosine) < _SLACK)):
            x, y = a[i], b[j]
            found[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= min_cosine
        return np.nonzero(found)

    def match(homes: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        visitors = visitors.rename(columns=lambda c: c[2:])
        rows = pd.concat([homes, visitors]) if len(visitors) else homes
        n_homes, n = len(homes), len(rows)
        if n_homes == 0:
            return pd.DataFrame({"node": [], "links": [], "root": []})
        raw, unit = np.array(rows["vec"].tolist(), np.float64), _unit(rows["vec"])
        copies = rows["copies"].to_numpy(np.int64)
        first = 0 if int(homes["block"].iloc[0]) == 0 else n_homes
        links, root = np.zeros(n, np.int64), np.arange(n)
        for low in range(0, n_homes, 512):
            high = min(low + 512, n_homes)
            i, j = linked(raw[low:high], raw[first:], unit[low:high], unit[first:])
            i, j = i + low, j + first
            keep = i < j
            i, j = i[keep], j[keep]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while True:
                least = np.minimum(root[i], root[j])
                if (root[i] == least).all() and (root[j] == least).all():
                    break
                np.minimum.at(root, root[i], least)
                np.minimum.at(root, root[j], least)
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                while (root[root] != root).any():
                    root = root[root]
        node = rows["node"].to_numpy(np.int64)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root][some]})

    return match


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The rows of cells, each dealt to cells of about CELL_ROWS homes: of two homes that of the later
    one visits the earlier, and who visited the cell visits all."""
    blocks = F.ceil(F.col("homes") / CELL_ROWS)
    salted = rows.withColumn("salt", F.when(F.col("home"), F.pmod(F.xxhash64(F.lit(-1), "node"), blocks)).otherwise(blocks - 1))
    return salted.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), "salt"))).select(
        F.concat_ws("#", "cell", F.col("place").cast("string")).alias("cell"),
        (F.col("home") & (F.col("place") == F.col("salt"))).alias("home"), "node", "copies", "vec",
    )


def _cells(state: DataFrame, radius: float) -> DataFrame:
    """(cell, home, node, copies, vec): dealt until no cell has more than about CELL_ROWS homes."""
    columns = ["cell", "home", "node", "copies", "vec"]
    schema = "cell string, home boolean, node long, copies long, vec array<double>"
    done = last = None
    for number in range(1 << 30):
        sizes = state.groupBy("cell").agg(
            F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.lit(1)).alias("n")
        )
        large, stuck = sizes.where(F.col("homes") > CELL_ROWS), F.lit(False)
        if last is not None:
            large = large.withColumn("parent", F.regexp_replace("cell", "/[^/]*$", "")).join(last, "parent")
            stuck = F.col("homes") > MOST_KEPT * F.col("parent_homes")
        large = materialize(large.select("cell", "homes", "n", stuck.alias("stuck")), "large-cells")
        small = state.join(large, "cell", "left_anti").select(*columns)
        done = small if done is None else done.unionByName(small)
        whole, big = large.where("stuck"), large.where("NOT stuck")
        if not whole.isEmpty():
            done = done.unionByName(_in_blocks(state.join(whole, "cell")))
        if big.isEmpty():
            return done
        last = big.select(F.col("cell").alias("parent"), F.col("homes").alias("parent_homes"))
        blocks = F.ceil(F.col("n") / BLOCK_ROWS)
        rows = state.join(big, "cell")
        wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(8), F.ceil(2 * F.col("homes") / CELL_ROWS)))
        draw = F.pmod(F.xxhash64(F.lit(number), "node"), F.lit(1 << 30)) / float(1 << 30)
        pivots = rows.where(F.col("home") & (draw < wanted / F.col("homes"))).select(
            F.col("cell").alias("p_cell"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("p_salt"),
            F.col("node").alias("p_node"), F.col("vec").alias("p_vec"),
        )
        members = rows.select(*columns, F.pmod(F.xxhash64("node"), blocks).alias("salt"))
        state = materialize(
            members.groupBy("cell", "salt")
            .cogroup(pivots.groupBy("p_cell", "p_salt"))
            .applyInPandas(_assigner(radius), schema),
            "cells",
        )


def range_join(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other rows at or above the cosine; component_id is the smallest id reachable.
    Rows with a null label, or whose vector is null, empty, zero or holds null or non-finite numbers,
    link with nothing, nor do vectors of different length. Rows may repeat: equal vectors link.
    Null ids count as largest. An empty table gives no rows; other columns are not read.
    """
    vec = F.col("vec")
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    )
    finite = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    distinct = rows.where(valid).groupBy("label", "vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    start = nodes.select(
        F.concat_ws(":", "label", F.size("vec").cast("string")).alias("cell"), F.lit(True).alias("home"), "node", "copies", "vec"
    )
    radius = math.sqrt(2 - 2 * min_cosine) + _SLACK
    cells = materialize(_cells(start, radius), "final-cells")
    visitors = cells.where("NOT home").withColumn("draw", F.xxhash64("node"))
    blocks = cells.groupBy("cell").agg(
        F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.when(~F.col("home"), 1)) / BLOCK_ROWS)).alias("blocks")
    )
    homes = cells.where("home").join(blocks, "cell").select(
        "cell", "node", "copies", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    own = {"cell": "v_cell", "node": "v_node", "copies": "v_copies", "vec": "v_vec"}
    guests = visitors.join(blocks, "cell").select(
        *[F.col(c).alias(n) for c, n in own.items()], F.pmod("draw", "blocks").alias("v_block")
    )
    found = materialize(
        homes.groupBy("cell", "block")
        .cogroup(guests.groupBy("v_cell", "v_block"))
        .applyInPandas(_matcher(min_cosine), "node long, links long, root long"),
        "cell-links",
    )
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.join(links, "node", "left")
        .join(linked, "node", "left")
        .select("label", "vec", "least", "copies", "links", F.coalesce("component", "node").alias("component"))
    )
    smallest = known.groupBy("component").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "component").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    match = (rows["label"] == known["_label"]) & (rows["vec"] == known["_vec"])
    out = rows.join(known, match, "left")
    of = lambda c: F.when(c != _LAST, c)
    component = F.coalesce("smallest", "id")
    return out.select(
        of(F.col("id")).alias("id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        of(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
