"""Running sums and numbers over a whole table in order, without bringing the table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.operators.lineage import checkpoint


def with_sum_before(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows that stand before a row in the order of ``keys`` (rows of equal keys in any order).

    Ranges of keys are dealt to partitions; one sum for each partition reaches the driver, and each partition adds up
    its own rows on top of the sum of those before it.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpoint(df.withColumn("__v", value.cast("long")).repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    before, total = [], 0
    for r in dealt.groupBy("__part").agg(F.sum("__v").alias("s")).orderBy("__part").collect():
        before.append((r[0], total))
        total += r.s or 0
    start = F.lit(0).cast("long")
    if before:
        start = F.element_at(F.create_map(*[F.lit(x) for part, s in before for x in (part, int(s))]), F.col("__part")).cast("long")
    own = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, F.sum("__v").over(own) - F.col("__v") + start).drop("__v", "__part")
