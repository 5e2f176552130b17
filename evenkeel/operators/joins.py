"""Joins of two streams or tables: equality, band, inequality counts, and any condition on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equi_join(r: DataFrame, s: DataFrame, on: list[str]) -> DataFrame:
    """Every pair of rows with equal keys, once.  Skewed keys are split by adaptive execution."""
    return r.join(s, on, "inner")


def band_join(r: DataFrame, s: DataFrame, r_key: str, s_key: str, width: int) -> DataFrame:
    """Every pair with |r_key - s_key| <= width, once.

    Keys fall into buckets of width + 1, so that partners lie in the same or a neighbouring bucket; S is
    repeated for the three and each pair meets in R's bucket.  Works on streams as on tables, since the
    join is one of equality with a further condition.
    """
    size = F.lit(width + 1)
    left = r.withColumn("_bucket", F.floor(F.col(r_key) / size).cast("long"))
    at = F.floor(F.col(s_key) / size).cast("long")
    right = s.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    return left.join(right, (left["_bucket"] == right["_bucket"]) & (F.abs(F.col(r_key) - F.col(s_key)) <= width)).drop("_bucket")


def running_sum(df: DataFrame, key: str, values: list[str], bucket: int, levels: int = 2) -> DataFrame:
    """Sums of values over all rows with a smaller key.  Keys are unique.

    Sums inside buckets of `bucket` keys are running; the totals of buckets are summed in the same way, `levels` times,
    so that one task sees no more than a row for each bucket ** levels of the range of keys.
    """
    df = df.withColumn("_b", F.floor(F.col(key) / bucket))
    total = df.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    if levels > 1:
        base = running_sum(total.withColumnRenamed("_b", "_k"), "_k", [f"_t_{v}" for v in values], bucket, levels - 1)
        base = base.select(F.col("_k").alias("_b"), *[F.col(f"_t_{v}_before").alias(f"_t_{v}") for v in values])
    else:
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        base = total.select("_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_t_{v}") for v in values])
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, "_b").select(
        *[c for c in df.columns if c != "_b"], *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_t_{v}")).alias(f"{v}_before") for v in values]
    )


def inequality_counts(r: DataFrame, s: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """For each key of R, its rows and the rows of S with a greater key: the size of the join r.key < s.key, without its pairs."""
    both = r.select(key, F.lit(1).alias("n_r"), F.lit(0).alias("n_s")).unionByName(s.select(key, F.lit(0).alias("n_r"), F.lit(1).alias("n_s")))
    per = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n_r").alias("n_r"), F.sum("n_s").alias("n_s"))
    flipped = running_sum(per.withColumn("_k", -F.col(key)), "_k", ["n_s"], bucket)
    return flipped.where("n_r > 0").select(key, "n_r", F.col("n_s_before").alias("n_greater"))


def grid_join(r_cells: DataFrame, s_cells: DataFrame, condition: Column, near: tuple[str, str, int] | None = None) -> DataFrame:
    """Pairs that meet in a cell (column node) and satisfy any condition; rows come from grid.assign.

    In a cell every row of R is held against every row of S, unless the condition has an equality or, as near = (r_key,
    s_key, width) tells, holds only for integer keys within width of each other: then those of one range of keys are, and a
    row of S near the end of a range is in the next one too.  Both sides are shuffled: sizes are estimated without a row's copies, so that the planner would broadcast what is many times
    as large."""
    left, right = r_cells.drop("special"), s_cells.drop("special").withColumnRenamed("node", "_node")
    meet = F.col("node") == F.col("_node")
    if near:
        r_key, s_key, width = near
        bits = (8 * width).bit_length()  # ranges of a power of two, by shifts, which are exact for any key
        at, offset = F.shiftright(s_key, bits), F.col(s_key).bitwiseAND(F.lit((1 << bits) - 1))
        ranges = F.sequence(at - (offset < width).cast("int"), at + (offset >= (1 << bits) - width).cast("int"))
        left, right = left.withColumn("_range", F.shiftright(r_key, bits)), right.withColumn("_near", F.explode(ranges))
        meet &= F.col("_range") == F.col("_near")
    return left.join(right.hint("merge"), meet & condition).drop("node", "_node", "_range", "_near")


def count_by_key(fact: DataFrame, members: DataFrame, fact_key: str, member_key: str) -> DataFrame:
    """Rows of fact for each member's key; keys that are no member's do not count."""
    per = fact.groupBy(F.col(fact_key).alias(member_key)).agg(F.count("*").alias("n_rows"))
    return per.join(members.select(member_key).distinct(), member_key, "left_semi")
