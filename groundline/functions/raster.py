"""Per-pixel physics: vegetation index, surface temperature, quality bits, colour ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .unknown import clamp, known, ratio

# Sensor physics.
WAVELENGTH_M = 10.895e-6
RHO_M_K = 1.438e-2
KELVIN = 273.15
EMISSIVITY_SLOPE, EMISSIVITY_BARE = 0.004, 0.986
BARE_NDVI, FULL_NDVI = 0.2, 0.5
COVER_NDVI = 0.6
#: Fill, dilated cloud, cirrus, cloud, shadow, snow: bits 0 to 5.
UNUSABLE_BITS = 0b111111
# Scaling of delivered products.
LANDSAT_SR, LANDSAT_ST, SENTINEL2 = (2.75e-5, -0.2), (0.00341802, 149.0), (1e-4, -0.1)
# Colour ramps.
HEAT_RAMP = ("#000004", "#1b0c41", "#4a0c6b", "#781c6d", "#a52c60", "#cf4446", "#ed6925", "#fb9b06", "#f7d13d", "#fcffa4")
GREEN_RAMP = ("#8c7a5e", "#a89b6f", "#bdb27c", "#a8bd7c", "#84ad68", "#5f9b57", "#3d8748", "#25703b", "#12592f", "#064023")
HEAT_DOMAIN, GREEN_DOMAIN = (20.0, 55.0), (0.0, 0.8)
UNKNOWN_GREY = "#9a9a94"


def ndvi(nir: Column, red: Column) -> Column:
    nir, red = known(nir), known(red)
    return clamp(ratio(nir - red, nir + red), -1, 1)


def radiance(dn: Column, gain: Column, offset: Column) -> Column:
    return known(dn) * gain + offset


def brightness_temperature(rad: Column, k1: Column, k2: Column) -> Column:
    """Kelvin; radiance at or below zero is unknown."""
    rad = known(rad)
    return F.when(rad > 0, ratio(k2, F.ln(ratio(k1, rad) + 1)))


def vegetation_share(v: Column, bare: float = BARE_NDVI, full: float = FULL_NDVI) -> Column:
    r = clamp((known(v) - bare) / (full - bare), 0, 1)
    return r * r


def emissivity(pv: Column) -> Column:
    return emissivity_of(known(pv))


def emissivity_of(pv: Column) -> Column:
    """Of a share that is known to be no NaN."""
    return pv * EMISSIVITY_SLOPE + EMISSIVITY_BARE


def surface_celsius(bt: Column, eps: Column) -> Column:
    bt, eps = known(bt), known(eps)
    kelvin = ratio(bt, F.lit(1.0) + F.lit(WAVELENGTH_M) * bt / F.lit(RHO_M_K) * F.ln(eps))
    return F.when((bt > 0) & (eps > 0) & (kelvin > 0), kelvin - KELVIN)


def with_surface_temperature(pixels: DataFrame, name: str, dn: Column, v: Column, gain: Column, offset: Column, k1: Column, k2: Column) -> DataFrame:
    """``pixels`` with degrees Celsius from a thermal pixel's digital number and vegetation index.

    One column a step: each is named several times by the next one, and would be written out
    anew each time in a single expression.
    """
    a = pixels.withColumns({"__radiance": radiance(dn, gain, offset), "__share": (known(v) - BARE_NDVI) / (FULL_NDVI - BARE_NDVI), "__k1": k1, "__k2": k2})
    a = a.withColumns({"__bt": F.when(F.col("__radiance") > 0, F.ln(ratio(F.col("__k1"), F.col("__radiance")) + 1)), "__share": clamp(F.col("__share"), 0, 1)})
    a = a.withColumns({"__bt": ratio(F.col("__k2"), F.col("__bt")), "__eps": F.ln(emissivity_of(F.col("__share") * F.col("__share")))})
    a = a.withColumn("__kelvin", ratio(F.col("__bt"), F.lit(1.0) + F.lit(WAVELENGTH_M / RHO_M_K) * F.col("__bt") * F.col("__eps")))
    a = a.withColumn(name, F.when((F.col("__bt") > 0) & (F.col("__kelvin") > 0), F.col("__kelvin") - KELVIN))
    return a.drop("__radiance", "__share", "__k1", "__k2", "__bt", "__eps", "__kelvin")


def with_thermal_number(pixels: DataFrame, name: str, celsius: Column, v: Column, gain: Column, offset: Column, k1: Column, k2: Column) -> DataFrame:
    """The inverse of ``with_surface_temperature``."""
    a = pixels.withColumns({"__kelvin": known(celsius) + KELVIN, "__share": (known(v) - BARE_NDVI) / (FULL_NDVI - BARE_NDVI), "__k1": k1, "__k2": k2, "__gain": gain, "__offset": offset})
    a = a.withColumn("__share", clamp(F.col("__share"), 0, 1))
    a = a.withColumn("__eps", F.lit(WAVELENGTH_M / RHO_M_K) * F.ln(emissivity_of(F.col("__share") * F.col("__share"))))
    a = a.withColumn("__bt", ratio(F.col("__kelvin"), F.lit(1.0) - F.col("__eps") * F.col("__kelvin")))
    a = a.withColumn("__rad", ratio(F.col("__k1"), F.exp(ratio(F.col("__k2"), F.col("__bt"))) - 1))
    a = a.withColumn(name, ratio(F.col("__rad") - F.col("__offset"), F.col("__gain")))
    return a.drop("__kelvin", "__share", "__eps", "__k1", "__k2", "__gain", "__offset", "__bt", "__rad")


def bands_for_ndvi(v: Column, brightness: Column) -> tuple[Column, Column]:
    """(near infrared, red) that give this index; neither below zero."""
    return F.greatest(F.lit(0.0), brightness * (1 + v)), F.greatest(F.lit(0.0), brightness * (1 - v))


def scaled(dn: Column, product: tuple[float, float]) -> Column:
    return known(dn) * product[0] + product[1]


def usable(qa: Column) -> Column:
    """No bit of cloud, shadow or fill is set; unknown is not usable."""
    return F.coalesce(known(qa).cast("bigint").bitwiseAND(F.lit(UNUSABLE_BITS)) == 0, F.lit(False))


def is_cover(v: Column, threshold: Column | float = COVER_NDVI) -> Column:
    return F.coalesce(known(v) >= threshold, F.lit(False))


def ramp_colour(t: Column, ramp: tuple[str, ...]) -> Column:
    t = clamp(known(t), 0, 1)
    at = F.least(F.lit(len(ramp)), F.floor(t * len(ramp)).cast("int") + 1)
    return F.when(t.isNotNull(), F.element_at(F.array(*map(F.lit, ramp)), at)).otherwise(F.lit(UNKNOWN_GREY))


def heat_colour(celsius: Column) -> Column:
    low, high = HEAT_DOMAIN
    return ramp_colour((known(celsius) - low) / (high - low), HEAT_RAMP)


def green_colour(v: Column) -> Column:
    low, high = GREEN_DOMAIN
    return ramp_colour((known(v) - low) / (high - low), GREEN_RAMP)


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    out = F.lit(0.0)
    for at, weight in ((2, 0.2126), (4, 0.7152), (6, 0.0722)):
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        out = out + weight * F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return out


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a) + 0.05, luminance(b) + 0.05
    return F.greatest(x, y) / F.least(x, y)
