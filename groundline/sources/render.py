"""Report sinks: text for a console and a plain SVG page, each of one collected row."""

from __future__ import annotations

from html import escape

from pyspark.sql import Row


def shown(value: float | None, unit: str = "", digits: int = 2) -> str:
    return "not measurable" if value is None else f"{value:.{digits}f}{unit}"


def report_lines(r: Row) -> list[str]:
    out = [
        f"{r.name} ({r.scene_id})",
        f"Crown cover before: {shown(r.cover_before, ' %', 1)}",
        f"Surface temperature: {shown(r.lst_mean, ' °C')} (sd {shown(r.lst_sd)}, {r.thermal_pixels} pixels, coverage {shown(r.coverage)})",
        f"Planned crowns: {shown(r.summed, ' m²', 0)}, united {shown(r.united, ' m²', 0)}",
    ]
    if r.kind == "suppressed":
        out.append(f"Temperature change withheld: {r.explanation}")
    else:
        out.append(f"Expected change: {shown(r.delta_c, ' °C')} [{shown(r.delta_lo)}, {shown(r.delta_hi)}]. {r.method}")
    out.append(f"Cost: {r.cost}")
    return [*out, *r.limitations]


def wrapped(text: str, width: int) -> list[str]:
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(word) > width:
            lines.append(word)
        else:
            lines[-1] = f"{lines[-1]} {word}".strip()
    return lines


def diagnosis(r: Row) -> list[str]:
    """What was measured of a scene, for a console."""
    return [
        f"{r.name} ({r.scene_id})",
        f"  yard {shown(r.yard_area, ' m²', 0)}, {r.yard_pixels} fine and {r.yard_cells} thermal pixels, coverage {shown(100 * r.coverage, ' %', 1)}",
        f"  cover {shown(r.cover_before, ' %', 1)} above an index of {shown(r.cover_threshold)}",
        f"  index {shown(r.ndvi_yard, '', 3)}, covered {shown(r.ndvi_cover, '', 3)}, open {shown(r.ndvi_open, '', 3)}",
        f"  temperature {shown(r.lst_mean, ' °C')}, sd {shown(r.lst_sd)}, {r.thermal_pixels} pixels, from {shown(r.lst_min, '', 1)} to {shown(r.lst_max, '', 1)}",
        f"  slope {shown(r.slope)} °C [{shown(r.ci_lo)}, {shown(r.ci_hi)}], R² {shown(r.r2, '', 3)}, {r.n} pairs",
    ]


def _bar(y: int, name: str, value: float | None, most: float, text: str, colour: str, width: int) -> str:
    """A named bar as long as its value; none where that is unknown."""
    long = 0 if value is None else round((width - 260) * max(0.0, min(1.0, value / most)))
    box = f'<rect x="150" y="{y - 11}" width="{long}" height="14" fill="{colour}"/>' if value is not None else ""
    return f'<text x="24" y="{y}" font-size="12">{name}</text>{box}<text x="{160 + long}" y="{y}" font-size="12">{escape(text)}</text>'


def report_svg(r: Row, width: int = 640) -> str:
    """Bars of cover and temperature, a block of the cost, then the report's lines."""
    bars = [
        _bar(70, "Cover now", r.cover_before, 100, shown(r.cover_before, " %", 1), "#84ad68", width),
        _bar(94, "Cover planned", r.cover_after, 100, shown(r.cover_after, " %", 1), "#25703b", width),
        _bar(118, "Temperature", r.lst_mean, 60, shown(r.lst_mean, " °C"), "#cf4446", width),
        f'<text x="24" y="146" font-size="12">Cost</text><text x="150" y="146" font-size="14">{escape(r.cost)}</text>',
    ]
    first, *rest = report_lines(r)
    lines = [x for line in rest for x in wrapped(line, 88)]
    body = "".join(f'<text x="24" y="{176 + 20 * n}" font-size="12">{escape(x)}</text>' for n, x in enumerate(lines))
    head = f'<text x="24" y="40" font-size="18">{escape(first)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{196 + 20 * len(lines)}" font-family="sans-serif">{head}{"".join(bars)}{body}</svg>'
