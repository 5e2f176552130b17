"""Scalar functions: stream sides, the pipe codec, grid codecs, owners and key ranges."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side(*cols: str) -> Column:
    """R or S by the parity of a sum of columns; a null column puts the row into S."""
    total = reduce(lambda a, b: a + b, (F.col(c) for c in cols))
    return F.when(F.pmod(total, F.lit(2)) == 0, F.lit("R")).otherwise(F.lit("S"))


def owner(key: Column, nodes: int) -> Column:
    """The node that stores a key unless a routing table says otherwise; never negative."""
    return F.pmod(key, F.lit(nodes)).cast("int")


def to_text(*cols: str) -> Column:
    """Fields joined by a pipe; nulls are empty fields."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def fields(text: Column) -> Column:
    """The fields of a pipe-separated line, without trailing empty ones."""
    parts = F.split(text, r"\|", -1)
    filled = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda x: x.isNotNull())
    return F.slice(parts, 1, F.coalesce(F.array_max(filled), F.lit(0)))


def parse_pipe(df: DataFrame, ddl: str, col: str = "value") -> DataFrame:
    """Typed columns from pipe-separated lines, in the order of a schema; missing fields are null."""
    spec = df.sparkSession.createDataFrame([], ddl).schema
    parts = F.split(F.col(col), r"\|", -1)
    return df.select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(spec)])


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case."""
    return F.lower(a) == F.lower(b)


def key_range(key: Column, width: int) -> Column:
    """All keys within a band of a key, none below 0."""
    return F.sequence(F.greatest(key - width, F.lit(0)), F.greatest(key + width, F.lit(0)))


def dimension(text: Column) -> Column:
    """``rows-cols`` as a struct of integers."""
    parts = F.split(text, "-")
    return F.struct(parts[0].cast("int").alias("rows"), parts[1].cast("int").alias("cols"))


def grid_cells(text: Column) -> Column:
    """A grid map, rows apart by pipes and cells by spaces, as an array of (i, j, node); -1 marks no cell."""
    rows = F.transform(
        F.filter(F.split(text, r"\|"), lambda r: F.trim(r) != ""),
        lambda r, i: F.transform(F.split(F.trim(r), " +"), lambda c, j: F.struct(i.alias("i"), j.alias("j"), c.cast("int").alias("node"))),
    )
    return F.filter(F.flatten(rows), lambda c: c["node"] >= 0)


def grid_text(cells: Column, rows: Column, cols: Column) -> Column:
    """The inverse of grid_cells: an array of (i, j, node) as rows that end with a pipe and cells that end with a space, -1 where there is none."""
    at = lambda i, j: F.get(F.filter(cells, lambda c: (c["i"] == i) & (c["j"] == j)), F.lit(0))["node"]
    number = lambda i, j: F.concat(F.coalesce(at(i, j), F.lit(-1)).cast("string"), F.lit(" "))
    line = lambda i: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), cols - 1), lambda j: number(i, j)), ""), F.lit("|"))
    return F.array_join(F.transform(F.sequence(F.lit(0), rows - 1), line), "")


def grid_descriptor(text: Column) -> Column:
    """``rows cols nodes missing flag`` as a struct; the flag says whether the short edge is the last column."""
    parts = F.split(F.trim(text), " +")
    names = ("rows", "cols", "nodes", "missing")
    return F.struct(*[parts[i].cast("int").alias(n) for i, n in enumerate(names)], (parts[4] == "1").alias("short_col"))


def route_text(key: Column, entries: Column) -> Column:
    """A line of a routing table: a key and its (task, count) entries in order."""
    item = lambda e: F.concat(F.lit(" [taskIndex = "), e["task"].cast("string"), F.lit(", count = "), e["count"].cast("string"), F.lit("]   "))
    return F.concat(F.lit("key = "), key.cast("string"), F.lit(" , "), F.array_join(F.transform(entries, item), ""))


def route_fields(line: Column) -> Column:
    """The inverse of route_text: a struct of key and entries; null for other lines."""
    find = lambda group: F.regexp_extract_all(line, F.lit(r"\[taskIndex = (\d+), count = (\d+)\]"), F.lit(group))
    entries = F.transform(F.arrays_zip(find(1).alias("task"), find(2).alias("count")), lambda e: F.struct(e["task"].cast("int").alias("task"), e["count"].cast("long").alias("count")))
    key = F.regexp_extract(line, r"^\s*key = (-?\d+) ,", 1)
    return F.when(key != "", F.struct(key.cast("long").alias("key"), entries.alias("entries")))


def round2(value: float) -> float:
    """Two decimals of the exact binary value, halves up."""
    return float(Decimal(value).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
