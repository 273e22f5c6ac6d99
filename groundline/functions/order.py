"""Doubles as whole numbers of 64 bits in the same order, and global ranks and places from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Store

_SIZE = (1 << 63) - 1


def with_order_bits(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a bigint that orders as ``value`` (a known double or NULL) does, equal only for equal values.

    A double's own bits order as its size does; negative values have the negative number, and
    both zeros are 0. The bits come from the JVM in one call, which Catalyst, taking it for one
    that may differ from call to call, does not write out anew in every filter that it pushes down.
    """
    x = value.cast("double")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(x, F.lit(0.0))).cast("bigint")
    a = rows.withColumns({"__raw": bits, "__there": x.isNotNull()})
    signed = F.when(F.col("__raw") < 0, -F.col("__raw").bitwiseAND(F.lit(_SIZE))).otherwise(F.col("__raw"))
    return a.withColumn(name, F.when(F.col("__there"), signed)).drop("__raw", "__there")


def ranked(rows: DataFrame, value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """``rows`` with the number of rows before each in the order of ``value``, and one; equal values share it.

    Values are counted one by one, then by the first bits of their place in the order: 2048
    ranges of 2048 parts. Ranges are added up (2048 rows), then parts within a range, then single
    values within a part; no window holds all values. Rows whose value is NULL have no rank.
    """
    single = with_order_bits(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c")), "__bits", F.col(value))
    single = single.select(value, "__c", (-F.col("__bits") if descending else F.col("__bits")).alias("__bits"))
    single = single.withColumns({"__part": F.shiftright("__bits", 42), "__range": F.shiftright("__bits", 53)})
    parts = single.groupBy("__range", "__part").agg(F.sum("__c").alias("__c"))
    ranges = parts.groupBy("__range").agg(F.sum("__c").alias("__c"))
    before = lambda *by: F.sum("__c").over(W.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("__c")
    ranges = ranges.select("__range", before("__range").alias("__r"))  # 2048 rows at most
    parts = parts.withColumn("__p", before("__range", "__part")).join(F.broadcast(ranges), "__range")
    own = single.withColumn("__s", before("__part", "__bits")).join(parts.select("__part", "__r", "__p"), "__part")
    own = own.select(F.col(value).alias("__v"), (F.col("__r") + F.col("__p") + F.col("__s") + 1).alias(name))
    return rows.join(own, F.col(value) == F.col("__v"), "left").drop("__v")


def placed(ordered: DataFrame, by: Column, store: Store, name: str = "place") -> DataFrame:
    """Rows that are ordered by ``by``, with their number from 1.

    They are written once, each with the task that ordered it; tasks hold ranges, so a row's
    number is its place in its range after the sizes of the ranges before it (a row a task).
    Equal values are in one range, and numbered in any order.
    """
    a = store.save(ordered.withColumn("__range", F.spark_partition_id()), "ordered")
    sizes = a.groupBy("__range").agg(F.count("*").alias("__c"))
    before = sizes.select("__range", (F.sum("__c").over(W.orderBy("__range")) - F.col("__c")).alias("__before"))
    a = a.withColumn("__nth", F.row_number().over(W.partitionBy("__range").orderBy(by))).join(F.broadcast(before), "__range")
    return a.select(*ordered.columns, (F.col("__before") + F.col("__nth")).cast("int").alias(name))
