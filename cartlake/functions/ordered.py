"""Places and running values in an order, without one task that sees all rows or all rows of a hot key.

``placed`` sorts by range, so each task has one range, and its rows get their place in the whole order: their place in
the range plus the rows of the ranges before, which are one count a range. ``along`` runs over rows that already have
dense positions within their key: each block of positions is a window of its own, and what lies in other blocks of the
same key is carried over as one value a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.sources.staging import staged

WITHIN = 33  # bits that monotonically_increasing_id gives to the place within a partition


def placed(df: DataFrame, order: list[Column | str], *, by: list[Column | str] | None = None, keep: list[str] | None = None, name: str = "place") -> DataFrame:
    """``df`` (or its columns ``keep``) with each row's place in the order, from 0; stored, as the ranges of two runs may differ.

    Ranges are cut by ``by``, which must not contradict ``order``; rows that agree in it share a range, so it should tell
    rows of a hot key apart. The window adds up one row a range.
    """
    rows = df.repartitionByRange(*(by or order)).sortWithinPartitions(*order)
    rows = staged(rows.select(*(keep or df.columns), F.monotonically_increasing_id().alias(name)), "placed")
    part = F.shiftright(name, WITHIN)
    counts = rows.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col(name).bitwiseAND((1 << WITHIN) - 1)
    return rows.withColumn("_range", part).join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")


def running(df: DataFrame, order: list[Column | str], sums: list[str]) -> DataFrame:
    """``df`` with ``before_<c>`` for each of ``sums``: its total over all rows that come before in the order.

    A range is one window; the totals of the ranges before are one row a range.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", WITHIN)), "running")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums)).select("_range", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return local.join(F.broadcast(totals), "_range").withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_range", "_at", *(f"_{c}" for c in sums))


def along(df: DataFrame, key: str, position: str, values: dict[str, tuple[Callable[[str], Column], Callable[[Column, Column], Column]]], *, backwards: bool = False, block: int = 4096) -> DataFrame:
    """``df`` with each of ``values`` (column: its aggregate, and how two of its results combine) run over the key's rows up to this one.

    A key with more than ``block`` positions is several windows. Positions count from 0; ``backwards`` runs from the last.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block))
    sort = F.desc if backwards else F.asc
    within = Window.partitionBy(key, "_block").orderBy(sort(position))
    local = rows.withColumns({c: total(c).over(within) for c, (total, _) in values.items()})
    long = rows.where("_block > 0").select(key).distinct()
    sums = rows.join(long, key, "left_semi").groupBy(key, "_block").agg(*(total(c).alias(f"_{c}") for c, (total, _) in values.items()))
    others = Window.partitionBy(key).orderBy(sort("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(key, "_block", *(total(f"_{c}").over(others).alias(f"_{c}") for c, (total, _) in values.items()))
    joined = local.join(carried, [key, "_block"], "left")
    return joined.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(combine(F.col(c), F.col(f"_{c}"))) for c, (_, combine) in values.items()}).drop("_block", *(f"_{c}" for c in values))
