"""Running sums and row numbers of groups of any size, without a group's rows meeting in one task.

Rows are dealt to buckets that follow each other in the order asked for. Sums per bucket are
added up over the buckets of a group, and within a bucket a window does the
rest. So a group that holds a third of all rows is as many tasks as its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.common import fresh_name, written

BUCKET = "_bucket"


def bucketed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with a bucket of their range of ``order``, written to the shared folder, so that all that follows sees the same buckets.

    Rows that are equal in ``order`` may go to neighbouring buckets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = fresh_name(df, "_tie")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order, tie)
    return written(dealt.withColumn(BUCKET, F.spark_partition_id()).drop(tie), "zstd")


def offsets(df: DataFrame, by: Sequence[str], value: str | Column, name: str, bucket: str = BUCKET) -> DataFrame:
    """(by, bucket, name): the sum of ``value`` in earlier buckets of each group; a window of a group has a row per bucket."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*by, bucket, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias(name))


def before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str | Column, name: str, bucket: str = BUCKET, starts: DataFrame | None = None) -> DataFrame:
    """The rows with the sum of ``value`` over all earlier ones of their group; ``by`` has no nulls.

    ``starts`` are the group's ``offsets`` where they are already made, with further columns to add perhaps.
    """
    starts = offsets(df, by, value, "_before", bucket) if starts is None else starts
    over = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = df.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0)))
    return within.join(starts, [*by, bucket]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before", bucket)


def grouped_key(source: Column) -> Column:
    """A text without nulls that sorts as the source does bytewise, null before all."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
