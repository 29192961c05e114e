"""A global order without one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_global_place(names: DataFrame, name: str, bits: int = 10) -> DataFrame:
    """``place`` of every distinct non-null string from 1 on, in byte order.

    Strings are put in buckets by the bytes after their common lead and ranked within the bucket; only the bucket totals, whose number
    is bounded, are ordered in one place.
    """
    key = F.hex(F.encode(F.col(name), "utf-8"))
    keyed = names.where(F.col(name).isNotNull()).withColumn("_key", key)
    # the common lead of all keys tells nothing; the four digits after it make the bucket
    ends = keyed.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
    lo, hi = (ends["lo"] or ""), (ends["hi"] or "")
    lead = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    keyed = keyed.withColumn("_bucket", F.rpad(F.substring("_key", lead + 1, max(1, bits // 2)), max(1, bits // 2), "0"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** (bits / 2) rows
    totals = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = inside.join(totals.select("_bucket", "_before"), "_bucket")
    return out.select(name, (F.col("_before") + F.col("_in")).alias("place"))
