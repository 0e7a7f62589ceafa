"""What goes before a row in one long order, without one task that holds all rows.

Rows are dealt into stretches of the order column. A task sorts one stretch; one summary row a
stretch is ordered as a whole and carried into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(df: DataFrame, at: str, columns: list[str], width: int, out: str = "before") -> DataFrame:
    """df with a struct of the columns in the row before, by ``at`` (a whole number that no two rows share)."""
    b = df.withColumn("_b", F.floor(F.col(at) / width))
    own = F.lag(F.struct(*columns)).over(W.partitionBy("_b").orderBy(at))
    last = b.groupBy("_b").agg(F.max_by(F.struct(*columns), at).alias("_last"))
    carried = last.select(F.col("_b").alias("_at"), F.lag("_last").over(W.orderBy("_b")).alias("_carried"))
    return b.withColumn("_own", own).join(carried, F.col("_b") == F.col("_at")).withColumn(out, F.coalesce("_own", "_carried")).drop("_b", "_at", "_own", "_carried")


def with_running_max(df: DataFrame, at: str, then: Column, value: str, width: int, out: str) -> DataFrame:
    """df with the largest value of the rows up to this one, by (``at``, ``then``)."""
    b = df.withColumn("_b", F.floor(F.col(at) / width)).withColumn("_then", then)
    own = F.max(value).over(W.partitionBy("_b").orderBy(at, "_then").rowsBetween(W.unboundedPreceding, 0))
    tops = b.groupBy("_b").agg(F.max(value).alias("_top"))
    carried = tops.select(F.col("_b").alias("_at"), F.max("_top").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    return b.withColumn("_own", own).join(carried, F.col("_b") == F.col("_at")).withColumn(out, F.greatest("_own", "_carried")).drop("_b", "_at", "_own", "_carried", "_then")
