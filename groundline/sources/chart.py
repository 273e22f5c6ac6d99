"""Drawings of a scene beside its report: the fit with its points, and what each cost line comes to.

What is drawn is bounded before it leaves Spark: points are counted on a lattice of the plot's
cells, so that a scene of any size gives as many circles as the plot has cells at most.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.unknown import known, ratio
from .render import shown

#: Cells of the plot each way.
CELLS = 60


def binned_points(points: DataFrame, x: Column, y: Column, keys: list[str], cells: int = CELLS) -> DataFrame:
    """keys, i, j, n and the frame x0, x1, y0, y1: how many points lie in each cell of their group's plot."""
    a = points.select(*keys, known(x).alias("x"), known(y).alias("y")).where("x is not null and y is not null")
    frame = a.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v: F.least(F.lit(cells - 1), F.coalesce(F.floor(ratio(F.col(v) - F.col(f"{v}0"), F.col(f"{v}1") - F.col(f"{v}0")) * cells), F.lit(0))).cast("int")
    return a.join(frame, keys).groupBy(*keys, at("x").alias("i"), at("y").alias("j"), "x0", "x1", "y0", "y1").agg(F.count("*").alias("n"))


def heat_cells(thermal: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """keys, i, j, lst, colour, in_yard: a scene's temperatures on a map of at most ``cells`` by ``cells``; masked cells are left out."""
    size = thermal.groupBy(*keys).agg((F.greatest(F.max("row"), F.max("col")) + 1).alias("__n"))
    by = F.greatest(F.lit(1), F.ceil(F.col("__n") / cells))
    a = thermal.join(size, keys).where("usable").groupBy(*keys, F.floor(F.col("row") / by).cast("int").alias("j"), F.floor(F.col("col") / by).cast("int").alias("i")).agg(F.avg(known(F.col("lst"))).alias("lst"), F.bool_or("in_yard").alias("in_yard"))
    return a.select(*keys, "i", "j", "lst", raster.heat_colour(F.col("lst")).alias("colour"), "in_yard")


def _text(x: float, y: float, text: str, size: int = 11) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}">{escape(text)}</text>'


def fit_svg(r: Row, points: list[Row], width: int = 480, height: int = 320) -> str:
    """Points, line and the line's interval of a scene's fit; a note where there is none. ``r`` has slope, intercept, ci_lo, ci_hi, r2, n."""
    left, low, wide, high = 48, height - 40, width - 72, height - 88
    out = [_text(16, 24, "Temperature against index", 13)]
    if r.slope is None or not points:
        out.append(_text(left, height / 2, "No fit for this scene."))
    else:
        p = points[0]
        px = lambda v: left + wide * ((v - p.x0) / ((p.x1 - p.x0) or 1))
        py = lambda v: low - high * ((v - p.y0) / ((p.y1 - p.y0) or 1))
        most = max(q.n for q in points)
        out += [f'<circle cx="{left + wide * (q.i + 0.5) / CELLS:.1f}" cy="{low - high * (q.j + 0.5) / CELLS:.1f}" r="{1.5 + 3 * (q.n / most) ** 0.5:.1f}" fill="#5f9b57" fill-opacity="0.5"/>' for q in points]
        # The interval is that of the slope, so its lines turn about the middle of the points.
        middle = (p.x0 + p.x1) / 2
        level = r.intercept + r.slope * middle
        corners = [(x, level + b * (x - middle)) for b in (r.ci_lo, r.ci_hi) for x in (p.x0, p.x1)]
        order = (corners[0], corners[1], corners[3], corners[2])
        out.append('<polygon points="' + " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in order) + '" fill="#cf4446" fill-opacity="0.15"/>')
        out.append(f'<line x1="{px(p.x0):.1f}" y1="{py(r.intercept + r.slope * p.x0):.1f}" x2="{px(p.x1):.1f}" y2="{py(r.intercept + r.slope * p.x1):.1f}" stroke="#cf4446" stroke-width="2"/>')
        out += [_text(px(v), low + 16, f"{v:.2f}") for v in (p.x0, p.x1)] + [_text(8, py(v), f"{v:.1f}") for v in (p.y0, p.y1)]
        out.append(_text(left, height - 6, f"slope {shown(r.slope)} °C [{shown(r.ci_lo)}, {shown(r.ci_hi)}], R² {shown(r.r2)}, {r.n} pixels"))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{"".join(out)}</svg>'


def cost_svg(lines: list[Row], cost: str, width: int = 640) -> str:
    """The cost lines in their order, the ones without a source marked, and what they come to."""
    out, y = [_text(16, 24, "Cost of the plan", 13)], 48
    for line in sorted(lines, key=lambda x: x.ordinal):
        price = "no source" if line.unsourced else f"{line.low:,.0f} to {line.high:,.0f}"
        out.append(_text(16, y, f"{line.quantity} x {line.label}") + _text(width - 200, y, price))
        y += 18
    out.append(_text(16, y + 6, "Total", 12) + _text(width - 200, y + 6, cost, 12))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{y + 24}" font-family="sans-serif">{"".join(out)}</svg>'


def heat_svg(cells: list[Row], size: int = 320) -> str:
    """A map of temperature, the yard's cells outlined; what clouds hide stays blank."""
    n = max((max(c.i, c.j) for c in cells), default=0) + 1
    step = size / n
    out = [f'<rect x="{c.i * step:.1f}" y="{c.j * step:.1f}" width="{step:.1f}" height="{step:.1f}" fill="{c.colour}"' + (' stroke="#111111"/>' if c.in_yard else "/>") for c in cells]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{"".join(out)}</svg>'
