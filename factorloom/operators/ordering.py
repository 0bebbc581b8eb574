"""Positions in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.scratch import stored


def with_position(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their 0-based place in the order of the columns `order`.

    Rows are dealt into ranges of all order columns, as many as the session shuffles to, sorted in each and stored with
    their number in the range; a place adds the rows of earlier ranges, a window over one total a range. Rows that are
    equal in all of `order` follow each other in any order.
    """
    number = F.monotonically_increasing_id()  # the partition's number, then the row's within it
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(number, 33).alias("__range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__within"))
    placed = stored(dealt, "placed")
    totals = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    return placed.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))
