"""Row numbers in a global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, keys: list[str], part: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with `rank`, a row's number from 0 among those of its `part`, in the order of `keys`.

    Rows are dealt to ranges with sampled bounds and sorted there, each range by one task. What
    meets is a row for each part and range, so a part that holds all rows is numbered by as many
    tasks as any other. `settle` writes the sorted rows, which fixes the ranges.
    """
    order = [part, *keys]
    ranged = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ).withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(_LOW)})
    runs = ranged.groupBy(part, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    skipped = runs.select(
        F.col(part).alias("__part"), F.col("__range").alias("__own"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__skip"),
    )
    # by range and part: no key has more rows than one range
    here = (F.col("__range") == F.col("__own")) & F.col(part).eqNullSafe(F.col("__part"))
    return ranged.join(skipped, here).withColumn("rank", F.col("__at") + F.col("__skip")).drop(
        "__id", "__range", "__at", "__part", "__own", "__skip"
    )
