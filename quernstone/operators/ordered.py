"""Running sums and places along a global order without a single task for all rows.

Rows are dealt to buckets of a whole-number key that grows with the order. Sums
run within buckets; only the buckets' totals, one row for :data:`WIDTH` keys,
are summed in one place, and the join back needs no further shuffle of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running(df: DataFrame, key: str, order: list[str], values: dict[str, str], place: str | None = None, width: int = WIDTH) -> DataFrame:
    """Adds inclusive running sums ``{new column: value column}`` and, if named, the place from 1 on.

    ``order`` must begin to grow with ``key`` (an integer column without nulls).
    """
    keyed = df.withColumn("_bucket", F.expr(f"`{key}` div {width}"))
    here = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"_in_{k}": F.sum(v).over(here) for k, v in enumerate(values.values())}
    local = keyed.withColumns({**sums, "_in_n": F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))})
    totals = keyed.groupBy("_bucket").agg(*[F.sum(v).alias(f"_all_{k}") for k, v in enumerate(values.values())], F.count(F.lit(1)).alias("_all_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    names = [*(str(k) for k in range(len(values))), "n"]
    totals = totals.select("_bucket", *[F.coalesce(F.sum(f"_all_{k}").over(before), zero).alias(f"_before_{k}") for k in names])
    out = local.join(totals, "_bucket")
    made = [(F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(name) for k, name in enumerate(values)]
    made += [(F.col("_in_n") + F.col("_before_n")).alias(place)] if place else []
    return out.select(*df.columns, *made)
