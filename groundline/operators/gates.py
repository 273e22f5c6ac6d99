"""Gates: what the data cannot support is withheld, with a reason, and never as a missing row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.unknown import known

REQUIRED_COVERAGE, FULL_R2, WEAK_R2 = 0.8, 0.5, 0.3
_UNIT = 1 << 60


def text(value: Column, digits: int) -> Column:
    """The exact binary value in decimals, half away from zero; two digits at most.

    The fraction is a whole number of 2**-60 near any half of the last digit, so whole-number
    arithmetic in decimals rounds it without error. From 2**53 on all values are whole; those of
    1e38 and more come as Spark writes a double.
    """
    every = F.abs(value.cast("double"))
    size = F.when(every < float(1 << 53), every)
    whole = F.floor(size)
    part = ((size - whole) * F.lit(float(_UNIT))).cast("bigint").cast("decimal(20,0)")
    by = 10**digits
    steps = F.call_function("div", part * F.lit(by).cast("decimal(4,0)") + F.lit(_UNIT // 2).cast("decimal(20,0)"), F.lit(_UNIT).cast("decimal(20,0)"))
    shown = (whole.cast("bigint") + F.floor(steps / by)).cast("string")
    large = every.try_cast("decimal(38,0)").cast("string")
    if digits:
        shown = F.concat(shown, F.lit("."), F.lpad((steps % by).cast("string"), digits, "0"))
        large = F.concat(large, F.lit("." + "0" * digits))
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), F.coalesce(shown, large, every.cast("string"))))


def prediction(slope: Column, r2: Column, ci_lo: Column, ci_hi: Column, delta_ndvi: Column, coverage: Column) -> dict[str, Column]:
    """kind, reason, delta_c, delta_lo, delta_hi. The first gate that fails decides."""
    slope, r2, delta, coverage = known(slope), known(r2), known(delta_ndvi), known(coverage)
    reason = (
        F.when(coverage.isNull() | (coverage < REQUIRED_COVERAGE), "insufficient_coverage")
        .when(slope.isNull() | r2.isNull(), "no_fit")
        .when(r2 < WEAK_R2, "low_r2")
        .when(delta.isNull(), "no_fit")
    )
    shown = lambda x: F.when(reason.isNull(), x)
    return {
        "kind": F.when(reason.isNotNull(), "suppressed").when(r2 < FULL_R2, "weak").otherwise("ok"),
        "reason": reason,
        "delta_c": shown(slope * delta),
        "delta_lo": shown(F.least(ci_lo * delta, ci_hi * delta)),
        "delta_hi": shown(F.greatest(ci_lo * delta, ci_hi * delta)),
    }


def explanation(kind: Column, reason: Column, r2: Column, coverage: Column) -> Column:
    """Why a prediction is withheld or weak; NULL for a full one."""
    percent = F.coalesce(text(known(coverage) * 100, 1), F.lit("0.0"))
    return (
        F.when(reason == "insufficient_coverage", F.concat(percent, F.lit("% of the yard is free of cloud, short of 80%: no change of temperature is given.")))
        .when(reason == "low_r2", F.concat(F.lit("R² = "), text(r2, 2), F.lit(" is under 0.3, so cover hardly explains temperature here; the change is withheld, cover and cost stand.")))
        .when((reason == "no_fit") & known(r2).isNotNull(), "The plan's shift of the yard's index is unknown, and with it the change of temperature.")
        .when(reason == "no_fit", "No line fits temperature to cover around this site, so no change is given.")
        .when(kind == "weak", F.concat(F.lit("A hint only: R² = "), text(r2, 2), F.lit(" is a weak fit.")))
    )


def method_label(kind: Column, r2: Column, n: Column, maturity: Column) -> Column:
    label = F.concat(F.lit("least squares of temperature on index, "), F.format_number(n, 0), F.lit(" pixels, R² = "), text(r2, 2), F.lit(", crowns of "), maturity.cast("bigint").cast("string"), F.lit(" years"))
    return F.when(kind != "suppressed", label)


def verdict(kind: Column) -> Column:
    return F.when(kind == "ok", "ESTIMATE").when(kind == "weak", "INDICATIVE").otherwise("SUPPRESSED")


def ready_kind(kind: Column) -> Column:
    return F.concat(F.lit("ready-"), kind)


def measured(value: Column, digits: int, reason: str = "not measurable") -> Column:
    return F.coalesce(text(known(value), digits), F.lit(reason))


def decision_trace(coverage: Column, r2: Column, n_lines: Column, n_sourced: Column) -> Column:
    """array of three gates: label, value, passed. ``explode`` gives one row each."""
    gate = lambda label, value, passed: F.struct(F.lit(label).alias("gate"), value.cast("double").alias("measured"), F.coalesce(passed, F.lit(False)).alias("passed"))
    return F.array(
        gate("coverage", known(coverage), known(coverage) >= REQUIRED_COVERAGE),
        gate("fit", known(r2), known(r2) >= WEAK_R2),
        gate("cost", n_sourced, (n_lines > 0) & (n_sourced == n_lines)),
    )


def limitations(thermal_pixels: Column, overpass: Column, coverage: Column) -> Column:
    """What bounds the report's reach: five sentences, and a sixth where part of the yard was masked."""
    always = F.array(
        F.concat(F.lit("The sensor sees heat in cells of 100 m. Usable ones on this yard: "), thermal_pixels.cast("string"), F.lit(". The temperature is the yard's, not that of a tree.")),
        F.concat(F.lit("One pass at "), overpass, F.lit(" on one day: neither the day's peak nor a climate.")),
        F.lit("Cover is what exceeds a threshold of the index, watered grass included; each site has its own threshold."),
        F.lit("The change follows from a correlation within one scene, no simulation; hence the interval."),
        F.lit("Crowns are drawn as they are expected when grown, not as planted."),
    )
    masked = F.concat(text((1 - coverage) * 100, 1), F.lit("% of the yard's thermal cells are masked."))
    return F.when(coverage < 1, F.concat(always, F.array(masked))).otherwise(always)
