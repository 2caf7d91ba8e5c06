"""Distributed ranking.

``row_number() OVER (ORDER BY ...)`` without a partition, or partitioned by a
column with few values (a class label), runs in a single task.  These helpers
give the same numbers with the work spread over all tasks:

1. range-partition the rows on ``(group, order...)``, sort each partition and
   write them once, with the partition's number and each row's place in it
   (partition id and running number of ``monotonically_increasing_id``);
2. from that table, count rows per (partition, group) -- at most ``partitions
   x groups`` rows, a size bound that does not grow with the data -- and turn
   the counts into offsets with a window over that small table;
3. broadcast the offsets back to the same table.

Rows and counts come from the same written table: a second range exchange would
sample other bounds and number other partitions.

The order must be total (end it with a unique column) so that a re-run of a
lost task sees the same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.session import materialize

_LOW_BITS = 1 << 33


def _sort_key(c):
    return F.col(c) if isinstance(c, str) else c


def global_row_number(df: DataFrame, order: list, partition_by: list | None = None,
                      name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = row_number() over (partition by ... order by ...)."""
    partition_by = list(partition_by or [])
    keys = [F.col(c).asc_nulls_first() for c in partition_by] + [_sort_key(c) for c in order]
    num_partitions = num_partitions or int(
        df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = df.repartitionByRange(num_partitions, *keys)
    # the id's upper bits are the partition's number, the lower 33 the place
    placed = spread.sortWithinPartitions(*keys).withColumn("_rk_id", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").select(
        "*", F.shiftright("_rk_id", 33).alias("_rk_part"),
        (F.col("_rk_id") % F.lit(_LOW_BITS)).alias("_rk_pos"))

    counts = placed.groupBy("_rk_part", *partition_by).agg(
        F.min("_rk_pos").alias("_rk_first"), F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(*partition_by).orderBy("_rk_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(
        "_rk_offset", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)))
    # Bounded by partitions x groups, independent of the row count.
    gnames = [f"_rk_g{i}" for i in range(len(partition_by))]
    offsets = F.broadcast(offsets.select(
        F.col("_rk_part").alias("_rk_opart"),
        *[F.col(c).alias(g) for c, g in zip(partition_by, gnames)],
        "_rk_first", "_rk_offset"))
    cond = F.col("_rk_part") == F.col("_rk_opart")
    for c, g in zip(partition_by, gnames):
        cond = cond & F.col(c).eqNullSafe(F.col(g))
    out = placed.join(offsets, cond, "inner")
    rn = (F.col("_rk_offset") + F.col("_rk_pos") - F.col("_rk_first") + 1).cast("bigint")
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, rn.alias(name))


def first_n_per_group(df: DataFrame, order: list, n: Column | int, partition_by: list,
                      name: str = "rn") -> DataFrame:
    """Rows whose rank in ``order`` within ``partition_by`` is at most ``n``.

    A fixed ``n`` over the whole table is a plain top-n, without ranks."""
    if not partition_by and isinstance(n, int):
        return df.orderBy(*[_sort_key(c) for c in order]).limit(n).withColumn(name, F.lit(0))
    n_col = n if isinstance(n, Column) else F.lit(n)
    ranked = global_row_number(df, order, partition_by, name)
    return ranked.filter(F.col(name) <= n_col)
