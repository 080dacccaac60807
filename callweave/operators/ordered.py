"""Places in a total order: running sums that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.plans.scratch import materialise


#: Rows that one task puts in order.
ROWS_A_TASK = 250_000


def running_sum(df: DataFrame, value: Column, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``run``, the sum of ``value`` up to and with each row in ``order`` within ``by``, and the group's ``total``.

    Rows are range partitioned by (by, order) and written once, so that a row's partition is
    the same for the sums and for the rows; a row adds the sums of the partitions before its
    own to the running sum within it. ``order`` must tell the rows of a group apart. The
    number of partitions comes from the counted rows, so that what a task sorts does not grow.
    """
    valued, n = df.withColumn("__run_v", value), df.count()
    parts = [max(-(-n // ROWS_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if n > ROWS_A_TASK else []
    placed = materialise(valued.repartitionByRange(*parts, *by, *order).withColumn("__run_p", F.spark_partition_id()), "ordered")
    sums = placed.groupBy("__run_p", *by).agg(F.sum("__run_v").alias("__run_s"))
    w = Window.partitionBy(*by).orderBy("__run_p")  # a row a partition and group
    before = F.coalesce(F.sum("__run_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("__run_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = sums.select(F.col("__run_p").alias("__run_q"), *(F.col(c).alias(f"__run_by{i}") for i, c in enumerate(by)), before.alias("__run_o"), total.alias("total"))
    same = F.col("__run_p") == F.col("__run_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__run_by{i}"))
    within = F.sum("__run_v").over(Window.partitionBy("__run_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = placed.repartition(*parts, "__run_p") if parts else placed
    return dealt.withColumn("__run_w", within).join(offsets, same).withColumn("run", F.col("__run_w") + F.col("__run_o")).select(*df.columns, "run", "total")
