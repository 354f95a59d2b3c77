"""Orders, caps and pages over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark cuts groups to n rows before the shuffle too."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= n)


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Rows numbered from 0 in a global order: sorted by range, then each partition's numbers moved by what lies before.

    df is written first, so that what it costs is not paid again for the bounds of the ranges, and so is the sorted table,
    with a number that holds partition and place. The offsets are one row a partition; no row but these is gathered.
    """
    rows = written(df, "unsorted")
    ordered = written(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_part", part).join(offsets, "_part").withColumn(out, place).drop("_part", "_place", "_before")


def rank_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Rows numbered from 1 within each group: global numbers less the group's first, which is combined before the shuffle."""
    numbered = written(global_rank(df, [*group, *order], "_number"), "numbered")
    firsts = numbered.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.min("_number").alias("_first"))
    joined = numbered.join(firsts, [F.equal_null(F.col(c), F.col(f"_of_{c}")) for c in group])
    return joined.select(*df.columns, (F.col("_number") - F.col("_first") + 1).alias(out))


def list_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a listing."""
    return df.orderBy(*order).offset(offset).limit(limit)
