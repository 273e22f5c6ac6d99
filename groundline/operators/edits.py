"""Plans after a log of edits: place a tree, remove the last one, clear, go back to the suggestion.

The log of a plan is a fold in order of time, but no task folds a whole plan. What came before the
last clearing or reset of a plan has no bearing on it, so each plan begins there, empty or as
suggested. A tree that is placed becomes the d-th of its plan, d being the plan's size after the
edit, and stays if the size is never below d again. So only sizes are needed, and those compose: a
run of edits takes a plan of size b to b + s - min(0, b + m), where s sums up the run's steps and m
is the least of its partial sums and 0; on the way the size is never below max(0, b + m). Edits are
sorted by range, whatever plan they belong to; each range gives a plan's run in it as one row
(s, m), the runs of a plan (a row a range at most) are folded, and each range then places its own
edits. Every window grows by a row at a time, so a range's work goes with its edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Store

#: What an edit does.
PLACE, REMOVE, CLEAR, RESET = "place", "remove", "clear", "reset"


def _size(start: Column, steps: Column, least: Column) -> Column:
    return start + steps - F.least(F.lit(0).cast("bigint"), start + least)


def _runs(edits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Edits with ``s`` and ``m`` of the run that ends with them, from the first of their plan in their range."""
    own = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("action") == PLACE, 1).otherwise(-1).cast("bigint")
    a = edits.withColumn("s", F.sum(step).over(own))
    return a.withColumn("m", F.least(F.lit(0).cast("bigint"), F.min("s").over(own)))


def after_edits(edits: DataFrame, suggested: DataFrame, keys: list[str], order: list[str], classes: tuple[str, ...], store: Store) -> DataFrame:
    """keys, ordinal, id, x, y, class_key: the trees of every plan after all its edits.

    ``edits``: keys, the columns of ``order`` (which tell all edits of a plan apart), action, x, y.
    ``suggested``: keys, ordinal (from 0 without gaps), id, x, y, class_key; a plan without a suggestion starts
    empty, one without edits stays as suggested. Unknown actions are left out; removing from an
    empty plan does nothing.
    """
    zero = F.lit(0).cast("bigint")
    at = F.struct(*order)
    fresh = edits.where(F.col("action").isin(CLEAR, RESET)).groupBy(*keys).agg(F.max_by("action", at).alias("__began"), F.max(at).alias("__since"))
    fresh = store.save(fresh, "fresh")
    live = edits.where(F.col("action").isin(PLACE, REMOVE)).select(*keys, *order, "action", "x", "y").join(fresh.drop("__began"), keys, "left")
    live = live.where(F.col("__since").isNull() | (at > F.col("__since"))).drop("__since")
    dealt = live.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    runs = store.save(_runs(dealt, keys, order), "runs")
    sizes = suggested.groupBy(*keys).agg(F.count("*").alias("__base"))
    base = F.when(F.col("__began") == CLEAR, zero).otherwise(F.coalesce("__base", zero))
    last = runs.groupBy(*keys, "__part").agg(F.max_by(F.struct("s", "m"), at).alias("r"))
    # A plan has a row a range at most, so the list is as long as there are ranges.
    listed = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", "r"))).alias("runs"))
    listed = listed.join(sizes, keys, "left").join(fresh.drop("__since"), keys, "left").select(*keys, "runs", base.alias("base"))

    def step(state: Column, run: Column) -> Column:
        r, size = run["r"], state["size"]
        entry = F.struct(run["__part"].alias("__part"), size.alias("__before"), F.greatest(zero, size + r["m"]).alias("__low"))
        return F.struct(_size(size, r["s"], r["m"]).alias("size"), F.concat(state["entries"], F.array(entry)).alias("entries"))

    none = F.array().cast("array<struct<__part:int,__before:bigint,__low:bigint>>")
    folded = listed.withColumn("f", F.aggregate("runs", F.struct(F.col("base").alias("size"), none.alias("entries")), step))
    entered = folded.select(*keys, F.explode("f.entries").alias("e")).select(*keys, "e.*")
    # ``beyond``: the least size in the ranges to come, NULL in a plan's last one.
    coming = W.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    entered = store.save(entered.withColumn("__beyond", F.min("__low").over(coming)), "entered")
    sized = runs.join(entered.drop("__low"), [*keys, "__part"]).withColumn("size", _size(F.col("__before"), F.col("s"), F.col("m")))
    # In falling order, since a window that reaches to the end is gone through anew for each row.
    ahead = W.partitionBy(*keys, "__part").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    lowest = F.least(F.min("size").over(ahead), F.col("__beyond"))  # skips what is NULL: nothing comes later
    sized = sized.withColumn("lowest", lowest)
    stays = F.col("lowest").isNull() | (F.col("lowest") >= F.col("size"))
    number = F.col("ordinal") + 1
    name = F.concat(F.lit("t"), F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0")))
    placed = sized.where((F.col("action") == PLACE) & stays).select(*keys, (F.col("size") - 1).cast("int").alias("ordinal"), "x", "y")
    cm = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    placed = placed.select(*keys, "ordinal", name.alias("id"), cm("x").alias("x"), cm("y").alias("y"), F.get(F.array(*map(F.lit, classes)), F.col("ordinal") % len(classes)).alias("class_key"))
    # Of the suggestion stays what the plan's size never fell below since it was last put in place.
    held = entered.groupBy(*keys).agg(F.min("__low").alias("__low"))
    kept = suggested.select(*keys, F.col("ordinal").cast("int").alias("ordinal"), "id", "x", "y", "class_key").join(held, keys, "left").join(fresh.drop("__since"), keys, "left")
    kept = kept.where((F.col("__began").isNull() | (F.col("__began") == RESET)) & (F.col("__low").isNull() | (F.col("ordinal") < F.col("__low"))))
    return kept.drop("__began", "__low").unionByName(placed)
