"""Rows to the cells of a join grid, and the load of its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import Grid, Piece
from .joins import running_sum


def grid_table(spark: SparkSession, grid: Grid) -> DataFrame:
    """(i, j, node) of each cell."""
    return spark.createDataFrame([(i, j, n) for n, (i, j) in enumerate(grid.cells())], "i int, j int, node int")


def assign(rows: DataFrame, grid: Grid, relation: str, place: Column) -> DataFrame:
    """Add node and special: R goes to every cell of one grid row, S to every cell of one column.

    `place` is any integer function of the row.  A row of R whose grid row lacks the cell of a short last column also goes
    to one cell of that column, marked special, and likewise S for a short last row, so that each pair of R and S
    meets in exactly one node.
    """
    by_row, short_col = relation == "R", grid.short == "col"
    across = grid.rows if by_row else grid.cols
    last = grid.last or (grid.rows if short_col else grid.cols)
    at = F.pmod(place, F.lit(across)).cast("int")

    def cell(i: Column, j: Column, special: bool) -> Column:
        """The number of a cell, row by row, leaving out those that the short edge lacks."""
        n = F.when(i <= last, i * grid.cols + j).otherwise(last * grid.cols + (i - last) * (grid.cols - 1) + j) if short_col else i * grid.cols + j
        return F.struct(n.cast("int").alias("node"), F.lit(special).alias("special"))

    if by_row:
        size = F.when(at < last, grid.cols).otherwise(grid.cols - 1) if short_col else F.when(at < grid.rows - 1, grid.cols).otherwise(last)
    else:
        size = F.when(at < grid.cols - 1, grid.rows).otherwise(last) if short_col else F.when(at < last, grid.rows).otherwise(grid.rows - 1)
    line = F.transform(F.sequence(F.lit(0), size - 1), lambda k: cell(at, k, False) if by_row else cell(k, at, False))
    cells = F.when(size > 0, line).otherwise(F.array().cast("array<struct<node:int,special:boolean>>"))
    if short_col == by_row and last < across:  # the short edge cuts this relation's lines
        k = F.pmod(F.floor(place / across), F.lit(last)).cast("int")
        one = cell(k, F.lit(grid.cols - 1), True) if by_row else cell(F.lit(grid.rows - 1), k, True)
        cells = F.when(at >= last, F.concat(cells, F.array(one))).otherwise(cells)
    return rows.withColumn("_c", F.explode(cells)).select(*rows.columns, F.col("_c.node").alias("node"), F.col("_c.special").alias("special"))


def node_rows(r_cells: DataFrame, s_cells: DataFrame) -> DataFrame:
    """Rows of either relation that each node holds."""
    both = r_cells.select("node", F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(s_cells.select("node", F.lit(0).alias("r"), F.lit(1).alias("s")))
    return both.groupBy("node").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"))


def with_position(rows: DataFrame, id_col: str) -> DataFrame:
    """Add position: a row's place, from 0, in the order of a unique integer id."""
    ids = rows.select(id_col, F.lit(1).alias("n"))
    return rows.join(running_sum(ids, id_col, ["n"], 1 << 16).select(id_col, F.col("n_before").alias("position")), id_col)


def held_rows(rows: DataFrame, pieces: list[Piece], side: str) -> DataFrame:
    """Rows (with position) at each node that holds them after a change of the grid: node and how are added.

    Pieces, some for each cell, cut the positions into ranges; a row finds its range among their ends."""
    own = [p for p in pieces if p.side == side]
    cuts = sorted({p.lo for p in own} | {p.hi for p in own})
    none = F.array().cast("array<struct<node:int,how:string>>")
    if not cuts:
        return rows.select(*rows.columns, F.lit(None).cast("int").alias("node"), F.lit(None).cast("string").alias("how")).where(F.lit(False))
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("position")))
    there = [[p for p in own if p.lo <= c < p.hi] for c in cuts]
    holders = F.array(none, *[F.array(*[F.struct(F.lit(p.node).alias("node"), F.lit(p.how).alias("how")) for p in x]) if x else none for x in there])
    return rows.withColumn("_h", F.explode(F.get(holders, at))).select(*rows.columns, "_h.node", "_h.how")


def free_nodes(spark: SparkSession, pool: int, used: DataFrame) -> DataFrame:
    """Nodes of a pool that no cell uses."""
    return spark.range(pool).select(F.col("id").cast("int").alias("node")).join(used.select("node"), "node", "left_anti")
