"""Running sums over a global order, without one task for the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def sum_before(df: DataFrame, value: str, n: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the sum of n over rows of smaller value; values are distinct.

    Rows are dealt to ranges of values between approximate quantiles and summed within; a range starts with the sums of the ranges
    below it, of which there are no more than buckets."""
    df = df.persist()  # read three times; lost blocks are made again
    cuts = sorted(set(df.withColumn("_v", F.col(value).cast("double")).approxQuantile("_v", [k / buckets for k in range(1, buckets)], 0.2 / buckets)))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(value).cast("double"))) if cuts else F.lit(0)
    rows = df.withColumn("_b", at)
    sums = rows.groupBy("_b").agg(F.sum(n).alias("_s"))
    start = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_start")
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(F.broadcast(start), "_b").withColumn(name, F.col("_start") + F.col("_own")).drop("_b", "_own", "_start")
