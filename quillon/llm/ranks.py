"""Places of rows within groups of any size, by range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import materialise


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with at, a row's place in its group by order from 0 on, and n, its group's size; nulls come first.

    Rows are range-partitioned by group and order, so a group of any size is spread over tasks, and written once. A
    row's place is that among its partition's rows of the group, which are at most a partition's, plus how many rows
    the partitions before have of it. Rows alike in group and order come in any order, and are one partition's.
    """
    task, row = F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row")
    ordered = materialise(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select("*", task, row), name)
    held = ordered.groupBy("__task", *group).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__n").over(Window.partitionBy(*group)).alias("__total")  # a group has at most a row for each task here
    base = held.select("__task", *[F.col(g).alias(f"__of_{g}") for g in group], (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base"), total)
    same = F.col("__task") == F.col("__in")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    joined = ordered.join(base.withColumnRenamed("__task", "__in"), same)
    return joined.select(*rows.columns, (F.col("__row") + F.col("__base")).alias("at"), F.col("__total").alias("n"))
