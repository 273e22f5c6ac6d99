"""Itemised plan costs; a price without a cited source is listed but never summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REFUSAL = "withheld: a price without a source"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"^\s+|\s+$", "")


def is_sourced(name: Column, url: Column, retrieved: Column) -> Column:
    return (trimmed(name) != "") & trimmed(url).rlike(r"^https?://\S+$") & trimmed(retrieved).rlike(r"^\d{4}-\d{2}-\d{2}$")


def first_items(items: DataFrame) -> DataFrame:
    """One row a key: the first in the model's order (``position``)."""
    others = [c for c in items.columns if c not in ("region", "key")]
    return items.groupBy("region", "key").agg(F.min_by(F.struct(*others), "position").alias("i")).select("region", "key", "i.*")


def lines(counts: DataFrame, items: DataFrame, class_keys: DataFrame, per_tree: DataFrame, keys: list[str]) -> DataFrame:
    """Cost lines of each plan: classes in order, then per-tree items in the model's order.

    ``counts``: keys, region, class_key, quantity. ``class_keys``: region, class_key, key.
    ``per_tree``: region, key, position. Items that the model lacks have unknown amounts.
    """
    known = first_items(items)
    by_class = counts.where("quantity > 0").join(class_keys, ["region", "class_key"], "left")
    by_class = by_class.withColumn("key", F.coalesce("key", F.concat(F.lit("missing:"), F.col("class_key"))))
    by_class = by_class.select(*keys, "region", "key", "quantity", F.lit(0).alias("part"), F.col("class_key").alias("order_key"), F.lit(0).alias("position"))
    totals = counts.groupBy(*keys, "region").agg(F.sum("quantity").alias("quantity")).where("quantity > 0")
    extra = totals.join(per_tree, "region").select(*keys, "region", "key", "quantity", F.lit(1).alias("part"), F.lit("").alias("order_key"), "position")
    a = by_class.unionByName(extra).join(known.drop("position"), ["region", "key"], "left")
    place = F.row_number().over(W.partitionBy(*keys, "region").orderBy("part", "order_key", "position")) - 1
    sourced = F.col("label").isNotNull() & is_sourced(F.col("source_name"), F.col("source_url"), F.col("source_retrieved"))
    return a.select(
        *keys,
        "region",
        place.alias("ordinal"),
        "key",
        F.coalesce("label", F.concat(F.lit('no such item: "'), F.col("key"), F.lit('"'))).alias("label"),
        "quantity",
        (F.col("low") * F.col("quantity")).alias("low"),
        (F.col("high") * F.col("quantity")).alias("high"),
        (~F.coalesce(sourced, F.lit(False))).alias("unsourced"),
    )


def totals(cost_lines: DataFrame, keys: list[str]) -> DataFrame:
    amount = lambda c: F.coalesce(F.sum(F.when(~F.col("unsourced"), F.col(c))), F.lit(0.0))
    return cost_lines.groupBy(*keys, "region").agg(amount("low").alias("total_low"), amount("high").alias("total_high"), F.bool_or("unsourced").alias("has_unsourced"), F.count("*").alias("n_lines"), F.count_if(~F.col("unsourced")).alias("n_sourced"))


def formatted(low: Column, high: Column, has_unsourced: Column) -> Column:
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    return F.when(has_unsourced, REFUSAL).when(low == high, money(low)).otherwise(F.concat(money(low), F.lit(" – "), money(high)))


def fully_cited(items: DataFrame) -> DataFrame:
    return items.groupBy("region").agg(F.bool_and(is_sourced(F.col("source_name"), F.col("source_url"), F.col("source_retrieved"))).alias("fully_cited"))


def unverified_labels(classes: DataFrame) -> DataFrame:
    """region, position and label of each class whose radius is not cited: a row a class, however many a region has."""
    return classes.where(F.coalesce(F.col("radius_status"), F.lit("")) != "cited").select("region", "position", "label")


def unverified_classes(classes: DataFrame) -> DataFrame:
    """region and the labels of classes whose radius is not cited, in the model's order.

    For reports: a region's labels come in one row. ``unverified_labels`` has no such row.
    """
    named = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("radius_status"), F.lit("")) != "cited", F.struct("position", "label"))))
    return classes.groupBy("region").agg(F.transform(named, lambda x: x["label"]).alias("unverified"))
