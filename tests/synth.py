"""Synthetic scenes: fractal fields of a seeded 32-bit generator make bands, heat and cloud."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from tests.sites import Site

FINE, COARSE = 200, 20
GAIN, OFFSET, K1, K2 = 3.8e-4, 0.1, 799.0284, 1329.2405
MASK = 0xFFFFFFFF


# Multiplier, shifts and masks of the generator, and the fields' sizes, as the published results came of them.
def draws(seed: int) -> Iterator[float]:
    state = seed & MASK
    while True:
        state = (state + 0x6D2B79F5) & MASK
        z = ((state ^ state >> 15) * (state | 1)) & MASK
        z ^= (z + (((z ^ z >> 7) * (z | 61)) & MASK)) & MASK
        yield ((z ^ z >> 14) & MASK) / 2**32


def field(source: Iterator[float], sizes: tuple[int, ...], n: int) -> np.ndarray:
    """Value noise of several lattices on n x n places, each half as strong as the one before."""
    at = np.minimum(0.999999, np.arange(n) / n)
    total, weights = np.zeros((n, n)), 0.0
    grids = [np.array([next(source) for _ in range((m + 1) ** 2)]).reshape(m + 1, m + 1) for m in sizes]
    for k, (m, g) in enumerate(zip(sizes, grids, strict=True)):
        i = np.floor(at * m).astype(int)
        t = at * m - i
        t = t * t * (3 - 2 * t)
        top = g[i][:, i] * (1 - t) + g[i][:, i + 1] * t
        low = g[i + 1][:, i] * (1 - t) + g[i + 1][:, i + 1] * t
        total += (top * (1 - t)[:, None] + low * t[:, None]) / 2**k
        weights += 1 / 2**k
    return total / weights


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    odd = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, 1, 0), strict=True):
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def centres(site: Site, n: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    k = (np.arange(n) + 0.5) * size
    return np.meshgrid(site.origin_x + k, site.origin_y - k)


def scene(site: Site) -> dict[str, np.ndarray]:
    """nir, red (fine), thermal, qa (coarse)."""
    source = draws(site.seed)
    index, bright, crown = (field(source, s, FINE) for s in ((3, 7, 17), (5, 11), (61, 149)))
    ring = np.array(site.ring)
    yard = inside(ring, *centres(site, FINE, 10.0))
    v = site.ndvi_mean + (index - 0.5) * 2 * site.ndvi_spread
    ranked = np.sort(crown[yard])
    cut = ranked[int(np.floor(len(ranked) * site.cover_target + 0.5)) - 1]
    v = np.where(yard, np.where(crown <= cut, 0.7 + crown / cut * 0.12, np.clip(v * 0.55, 0.02, 0.17)), v)
    v = np.clip(v, -0.05, 0.92)
    light = 0.12 + bright * 0.16
    cells = v.reshape(COARSE, FINE // COARSE, COARSE, FINE // COARSE).mean((1, 3))
    noise = abs(site.slope) * cells.std(ddof=1) * np.sqrt((1 - site.r2) / site.r2)
    pairs = np.array([[max(2.0**-52, next(source)), next(source)] for _ in range(COARSE**2)])
    normal = (np.sqrt(-2 * np.log(pairs[:, 0])) * np.cos(2 * np.pi * pairs[:, 1])).reshape(COARSE, COARSE)
    kelvin = site.intercept + site.slope * cells + normal * noise + 273.15
    eps = 0.004 * np.clip((cells - 0.2) / 0.3, 0, 1) ** 2 + 0.986
    bt = kelvin / (1 - 10.895e-6 / 1.438e-2 * np.log(eps) * kelvin)
    dn = np.floor((K1 / (np.exp(K2 / bt) - 1) - OFFSET) / GAIN + 0.5)
    qa = np.zeros((COARSE, COARSE))
    if site.cloud > 0:
        x, y = centres(site, COARSE, 100.0)
        own = inside(ring, x, y)
        cx, cy = (x[own].mean(), y[own].mean()) if own.any() else (site.origin_x + 1000, site.origin_y - 1000)
        radius = 210 * np.sqrt(max(0.05, site.cloud))
        edge = 0.75 + field(draws(site.seed ^ 0x5EED), (2, 5), COARSE) * 0.5
        far = np.hypot(x - (cx + 0.85 * radius), y - (cy + 0.34 * radius))
        qa[far <= radius * edge] = 10
    return {"nir": np.round(light * (1 + v), 6), "red": np.round(light * (1 - v), 6), "thermal": dn, "qa": qa}


def write(site: Site, root: Path) -> None:
    """One scene's folder of JSON files."""
    folder = root / site.name
    folder.mkdir(parents=True)
    for name, data in scene(site).items():
        (folder / f"{name}.json").write_text(json.dumps({"width": data.shape[1], "height": data.shape[0], "data": data.ravel().tolist()}))
    (folder / "yard.json").write_text(json.dumps({"properties": {"name": site.name, "epsgProjected": 32612, "coordinatesProjected": site.ring}}))
    meta = {
        "slug": site.name, "name": site.name, "city": "c", "state": "s", "synthetic": True, "provenance": "generated", "yardAreaM2": 9000, "ndviCoverThreshold": site.threshold, "thresholdRationale": "r", "opticalSceneId": "o", "opticalDate": "2025-07-30",
        "grid": {"epsg": 32612, "originX": site.origin_x, "originY": site.origin_y, "finePixelM": 10, "thermalPixelM": 100, "fineSize": FINE, "thermalSize": COARSE},
        "mtl": {"radianceMult": GAIN, "radianceAdd": OFFSET, "k1": K1, "k2": K2, "spacecraft": "L9", "acquisitionDate": "2025-07-29", "localOverpassTime": "10:42", "sceneId": "t"},
    }
    (folder / "meta.json").write_text(json.dumps(meta))


def cost_model(region: str, sourced: bool) -> dict:
    """Three planting classes; prices cited, or zero and not."""
    prices = (("large_shade", 712, 944, 7.5), ("medium_shade", 712, 944, 5.5), ("small_ornamental", 712, 712, 3.5))
    item = lambda key, low, high: {"key": key, "label": key, "unit": "each", "low": low, "high": high, "source_name": "schedule" if sourced else "", "source_url": "https://prices.example/list" if sourced else "", "source_retrieved": "2026-08-07" if sourced else ""}
    items = [item(f"tree_{k}", lo * sourced, hi * sourced) for k, lo, hi, _ in prices]
    extra = [] if sourced else ["watering", "mulch"]
    return {
        "region": region, "currency": "USD", "last_verified": "2026-08-07", "items": items + [item(k, 0, 0) for k in extra], "classCostKeys": {k: f"tree_{k}" for k, *_ in prices}, "perTreeItemKeys": extra,
        "plantingClasses": [{"key": k, "label": k, "crownRadiusM": r, "maturityYears": 15, "radiusSource": "", "radiusStatus": "unverified"} for k, _, _, r in prices],
    }
