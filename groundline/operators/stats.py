"""Masked aggregates in which unknown values take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import with_order_bits
from ..functions.unknown import known, ratio, share


def count_mask(mask: Column) -> Column:
    return F.count_if(mask)


def known_count(value: Column, mask: Column) -> Column:
    return F.count_if(mask & known(value).isNotNull())


def cover_fraction(cover: Column, valid: Column) -> Column:
    return share(cover, valid)


def masked_mean(value: Column, mask: Column) -> Column:
    return F.avg(F.when(mask, known(value)))


def values_in(rows: DataFrame, value: Column, mask: Column, name: str = "value") -> DataFrame:
    """The rows whose value is known and in the mask; a table, as a group's values may be too many for a list."""
    return rows.where(mask).withColumn(name, known(value)).where(F.col(name).isNotNull())


def coverage(usable: Column, yard: Column) -> Column:
    """Usable share of the yard; 0 where it has no pixel."""
    return F.coalesce(ratio(F.count_if(usable & yard), F.count_if(yard)), F.lit(0.0))


def sufficient(c: Column, required: float = 0.8) -> Column:
    return F.coalesce(known(c) >= required, F.lit(False))


def summary(value: Column, mask: Column | None = None) -> dict[str, Column]:
    """mean, sd (of a sample; 0 for one value), min, max, n."""
    v = known(value) if mask is None else F.when(mask, known(value))
    n = F.count(v)
    return {"mean": F.avg(v), "sd": F.when(n == 1, 0.0).otherwise(F.stddev_samp(v)), "min": F.min(v), "max": F.max(v), "n": n}


#: Bits of a value's place in the order that each of three passes tells apart.
DIGITS = (22, 21, 21)


def at_ranks(rows: DataFrame, value: Column, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """keys, n (known values) and, under each name, the value of that rank (from 0) in ascending order.

    ``ranks`` are expressions of ``n``; NULL or out of range gives NULL. Radix selection: a value
    is a whole number of 64 bits in the same order. Three passes count values by the next bits of
    that number, each only below the digits that the pass before found to hold a rank. Counts are
    formed before they are shuffled, and a task orders at most one digit's 2**22 counts, however
    the values lie.
    """
    v = with_order_bits(rows.select(*keys, known(value).alias("v")), "__bits", F.col("v"))
    shift, left = [], sum(DIGITS)
    for width in DIGITS:
        left -= width
        shift.append(left)
    digit = lambda k: F.shiftright("__bits", shift[k]) if k == 0 else F.shiftright("__bits", shift[k]).bitwiseAND(F.lit((1 << DIGITS[k]) - 1))
    v = v.select(*keys, "v", *[digit(k).alias(f"__d{k}") for k in range(3)])
    first = v.groupBy(*keys, "__d0").agg(F.count("v").alias("c"))
    spans = first.groupBy(*keys).agg(F.sum("c").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()]))
    hit = spans.select(*keys, wanted.alias("w")).select(*keys, "w.name", "w.rank")
    counts = first.where("__d0 is not null")
    above: list[str] = []
    for k in range(3):
        to = F.sum("c").over(W.partitionBy(*keys, *above).orderBy(f"__d{k}"))
        held = counts.withColumn("to", to).join(hit, [*keys, *above]).where("rank < to and rank >= to - c")
        above = [*above, f"__d{k}"]
        if k == 2:
            break
        hit = held.select(*keys, *above, "name", (F.col("rank") - F.col("to") + F.col("c")).alias("rank"))
        below = v.join(hit.select(*keys, *above).distinct(), [*keys, *above], "left_semi")
        counts = below.groupBy(*keys, *above, f"__d{k + 1}").agg(F.count("*").alias("c"), F.min("v").alias("v"))
    values = held.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks])
    return spans.join(values, keys, "left")


def percentiles(rows: DataFrame, value: Column, keys: list[str], percents: list[float]) -> DataFrame:
    """keys and p<percent> for each: exact, by linear interpolation; percents are clamped."""
    at = {p: (F.col("n") - 1) * F.lit(min(1.0, max(0.0, p / 100))) for p in percents}
    ranks = {f"{side}{k}": f(r) for k, r in enumerate(at.values()) for side, f in (("low", F.floor), ("high", F.ceil))}
    a = at_ranks(rows, value, keys, ranks)
    between = lambda k, r: F.col(f"low{k}") * (F.ceil(r) - r) + F.col(f"high{k}") * (r - F.floor(r))
    return a.select(*keys, *[F.when(F.floor(r) == r, F.col(f"low{k}")).otherwise(between(k, r)).alias(f"p{p}") for k, (p, r) in enumerate(at.items())])
