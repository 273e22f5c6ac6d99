"""The bound queries in DuckDB SQL."""

from __future__ import annotations

from .bindings import COARSE, FINE, GAIN, HOLE, K1, K2, MEASURED, OFFSET, PLAN, RING, SHIFTED, GridDef

NDVI = "CASE WHEN l_discount + l_tax = 0 THEN NULL ELSE greatest(-1, least(1, (l_discount - l_tax) / (l_discount + l_tax))) END"
LINES = f"lines AS (SELECT *, l_returnflag || l_linestatus AS scene_id, {NDVI} AS v FROM lineitem)"
KEY = "scene_id, l_orderkey, l_partkey, l_linenumber"


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def mean(x: str) -> str:
    return f"sum(CAST(round({x} * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) / CAST(100 AS DOUBLE)"


CELLS = f"""{LINES}, cells0 AS (
  SELECT scene_id, CAST(l_orderkey % 40 AS INT) AS "row", CAST(l_partkey % 40 AS INT) AS col, {mean("l_discount")} AS value, {mean("l_tax")} AS red
  FROM lines GROUP BY ALL
), cells AS (SELECT *, CASE WHEN value + red = 0 THEN NULL ELSE greatest(-1, least(1, (value - red) / (value + red))) END AS ndvi FROM cells0)"""
HEAT = """heat AS (
  SELECT scene_id, CAST(l_orderkey % 10 AS INT) AS "row", CAST(l_partkey % 10 AS INT) AS col, sum(CAST(round(l_quantity) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS lst
  FROM lines GROUP BY ALL)"""


def inside(ring: tuple[tuple[float, float], ...], x: str, y: str) -> str:
    edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ring, ring[-1:] + ring[:-1], strict=True))
    return f"((SELECT count(*) FROM (VALUES {edges}) e(ex, ey, px, py) WHERE (ey > ({y})) <> (py > ({y})) AND ({x}) < ex + (px - ex) * (({y}) - ey) / (py - ey)) % 2 = 1)"


def overlap_sql(to: GridDef, value: str = "value") -> str:
    g = FINE
    left, top = f"(col * {g.pixel_w} + {g.origin_x})", f"({g.origin_y} - f.\"row\" * {g.pixel_h})"
    cl, ct = f"({to.origin_x} + c * {to.pixel_w})", f"({to.origin_y} - r * {to.pixel_h})"
    dx = f"(least({left} + {g.pixel_w}, {cl} + {to.pixel_w}) - greatest({left}, {cl}))"
    dy = f"(least({top}, {ct}) - greatest({top} - {g.pixel_h}, {ct} - {to.pixel_h}))"
    return f"""WITH {CELLS}, coarse AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, scene_id FROM range({to.height}) a(r), range({to.width}) b(c), (SELECT DISTINCT scene_id FROM cells)),
    pieces AS (SELECT r, c, f.scene_id, CAST({value} AS DOUBLE) AS v, CAST({dx} AS DOUBLE) AS dx, CAST({dy} AS DOUBLE) AS dy FROM cells f, range({to.height}) a(r), range({to.width}) b(c)),
    means AS (SELECT scene_id, r, c, sum(v * dx * dy) / sum(dx * dy) AS value FROM pieces WHERE dx > 0 AND dy > 0 AND v IS NOT NULL GROUP BY ALL)
    SELECT scene_id, r AS "row", c AS col, {r(r("value", 12), 9)} AS value FROM coarse LEFT JOIN means USING (scene_id, r, c)"""


EPS = "(CASE WHEN v IS NOT NULL THEN 0.986 + 0.004 * power(greatest(0, least(1, (v - 0.2) / 0.3)), 2) END)"
LAMBDA, RHO = "10.895e-6", "1.438e-2"


def celsius(dn: str) -> str:
    rad = f"({GAIN} * ({dn}) + {OFFSET})"
    bt = f"({K2} / ln({K1} / {rad} + 1))"
    return f"({bt} / (1 + {LAMBDA} * {bt} / {RHO} * ln({EPS})) - 273.15)"


def dn_of(c: str) -> str:
    k = f"(({c}) + 273.15)"
    q = f"({LAMBDA} / {RHO} * ln({EPS}))"
    bt = f"({k} / (1 - {q} * {k}))"
    return f"(({K1} / (exp({K2} / {bt}) - 1) - {OFFSET}) / {GAIN})"


USABLE = "((CAST(1 AS BIGINT) << l_linenumber) & 63) = 0"
FIT_ROWS = f"{LINES}, fit_rows AS (SELECT *, 45 - CAST(0.2 AS DOUBLE) * l_quantity + (CASE l_returnflag WHEN 'A' THEN 40.0 WHEN 'N' THEN 130.0 ELSE 300.0 END)::DOUBLE * l_discount AS y FROM lines)"
Z = "1.959963984540054::DOUBLE"


def t_value(df: str) -> str:
    z = Z
    return f"({z} + ({z}**3 + {z}) / (4 * {df}) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * {df}**2) + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384 * {df}**3))"


FITS = f"""{FIT_ROWS}, sums AS (
  SELECT scene_id, regr_count(y, l_quantity) AS n, regr_sxx(y, l_quantity) AS sxx, regr_syy(y, l_quantity) AS syy, regr_sxy(y, l_quantity) AS sxy, avg(l_quantity) AS mx, avg(y) AS my FROM fit_rows GROUP BY scene_id
), fits AS (
  SELECT scene_id, CAST(n AS BIGINT) AS n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, 1 - (syy - sxy * sxy / sxx) / syy AS r2, sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) AS slope_se FROM sums
), whole AS (
  SELECT *, slope - {t_value("(n - 2)::DOUBLE")} * slope_se AS ci_lo, slope + {t_value("(n - 2)::DOUBLE")} * slope_se AS ci_hi FROM fits)"""

GATE_ROWS = """gate_rows AS (SELECT p_partkey, -p_size / 5.0::DOUBLE AS slope, (p_partkey % 101) / 100.0::DOUBLE AS r2, -p_size / 5.0::DOUBLE - 1.5 AS ci_lo, -p_size / 5.0::DOUBLE + 1.5 AS ci_hi,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 7) / 20.0::DOUBLE END AS delta, (p_partkey % 21) / 20.0::DOUBLE AS coverage FROM part)"""
REASON = "CASE WHEN coverage IS NULL OR coverage < 0.8 THEN 'insufficient_coverage' WHEN slope IS NULL OR r2 IS NULL THEN 'no_fit' WHEN r2 < 0.3 THEN 'low_r2' WHEN delta IS NULL THEN 'no_fit' END"
GATED = f"{GATE_ROWS}, gated AS (SELECT *, reason0 AS reason, CASE WHEN reason0 IS NOT NULL THEN 'suppressed' WHEN r2 < 0.5 THEN 'weak' ELSE 'ok' END AS kind FROM (SELECT *, {REASON} AS reason0 FROM gate_rows))"
TREES = "trees AS (SELECT CAST(s_suppkey % 6 AS VARCHAR) AS scene_id, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x, CAST(s_suppkey * 61 % 103 AS DOUBLE) AS y, CASE s_suppkey % 3 WHEN 0 THEN 7.5 WHEN 1 THEN 5.5 ELSE 0 END::DOUBLE AS radius FROM supplier)"
BOXES = """boxes AS (SELECT scene_id, min(x - radius) AS x0, max(x + radius) AS x1, min(y - radius) AS y0, max(y + radius) AS y1 FROM trees WHERE radius > 0 GROUP BY scene_id),
  rowsOf AS (SELECT scene_id, x0, x1, y0 + (unnest(range(0, greatest(1, CAST(ceil((y1 - y0) / 0.5) AS BIGINT)))) + 0.5) * 0.5 AS py FROM boxes),
  points AS (SELECT scene_id, py, x0 + (unnest(range(0, greatest(1, CAST(ceil((x1 - x0) / 0.5) AS BIGINT)))) + 0.5) * 0.5 AS px FROM rowsOf),
  covered AS (SELECT * FROM points p WHERE EXISTS (SELECT 1 FROM trees t WHERE t.scene_id = p.scene_id AND t.radius > 0 AND (px - t.x) * (px - t.x) + (py - t.y) * (py - t.y) <= t.radius * t.radius)),
  sums AS (SELECT scene_id, sum(pi() * radius * radius) AS summed FROM trees GROUP BY scene_id)"""
CLIP = ((20.0, 20.0), (80.0, 25.0), (75.0, 90.0), (30.0, 70.0))


def _candidates() -> str:
    step = 5.5
    x0, x1 = min(p[0] for p in RING), max(p[0] for p in RING)
    y0, y1 = min(p[1] for p in RING), max(p[1] for p in RING)
    nx, ny = int((x1 - x0 - step / 2) // step) + 1, int((y1 - y0 - step / 2) // step) + 1
    probes = " AND ".join(inside(RING, f"x + {dx}", f"y + {dy}") for dx, dy in ((0, 0), (6, 0), (-6, 0), (0, 6), (0, -6)))
    return f"""{CELLS}, {HEAT}, spots AS (SELECT {x0 + step / 2}::DOUBLE + i * {step}::DOUBLE AS x, {y0 + step / 2}::DOUBLE + j * {step}::DOUBLE AS y FROM range({nx}) a(i), range({ny}) b(j)),
    good AS (SELECT x, y, CAST(floor((400 - y) / 10) AS INT) AS fr, CAST(floor(x / 10) AS INT) AS fc, CAST(floor((400 - y) / 40) AS INT) AS cr, CAST(floor(x / 40) AS INT) AS cc FROM spots WHERE {probes}),
    cand AS (SELECT c.scene_id, x, y, coalesce(lst, 0) - 10 * ndvi AS score FROM good JOIN cells c ON c."row" = fr AND c.col = fc LEFT JOIN heat h ON h.scene_id = c.scene_id AND h."row" = cr AND h.col = cc WHERE ndvi < 0.3)"""


GREEDY_STEPS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, x, y) AS k FROM cand),
  walk AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS taken FROM ranked
    UNION ALL SELECT w.scene_id, n.k, CASE WHEN len(taken) >= 12 OR len(list_filter(taken, lambda p: (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) < 121)) > 0 THEN taken ELSE list_append(taken, {'x': n.x, 'y': n.y}) END
    FROM walk w JOIN ranked n ON n.scene_id = w.scene_id AND n.k = w.k + 1),
  done AS (SELECT scene_id, arg_max(taken, k) AS taken FROM walk GROUP BY scene_id),
  placed AS (SELECT scene_id, unnest(range(0, len(taken))) AS ordinal, unnest(taken) AS p FROM done)"""
GREEDY = f"WITH RECURSIVE {_candidates()}, {GREEDY_STEPS}"
RINGS = "verts AS (SELECT s_suppkey, i, CAST(s_suppkey * (i + 3) * 17 % 101 AS DOUBLE) AS x, CAST(s_suppkey * (i + 5) * 29 % 103 AS DOUBLE) AS y FROM supplier, range(5) t(i)), edges AS (SELECT v.s_suppkey, v.x, v.y, w.x AS px, w.y AS py FROM verts v JOIN verts w ON v.s_suppkey = w.s_suppkey AND w.i = (v.i + 4) % 5), areas AS (SELECT s_suppkey, sum(px * y - x * py) / 2 AS a, sum((x + px) * (px * y - x * py)) AS sx, sum((y + py) * (px * y - x * py)) AS sy, avg(x) AS mx, avg(y) AS my FROM edges GROUP BY s_suppkey), centres AS (SELECT s_suppkey, a, CASE WHEN a = 0 THEN mx ELSE sx / (6 * a) END AS cx, CASE WHEN a = 0 THEN my ELSE sy / (6 * a) END AS cy FROM areas)"
ITEMS = "items AS (SELECT 'R' || (p_size % 3) AS region, 'item ' || p_type AS key, p_partkey AS position, p_name AS label, p_retailprice AS low, p_retailprice * 1.25::DOUBLE AS high, p_brand AS source_name, CASE WHEN p_brand LIKE '%1' THEN '' ELSE 'https://parts.example/' || p_partkey END AS source_url FROM part)"
COSTS = f"""types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part)), {ITEMS},
  firsts AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY region, key ORDER BY position) = 1),
  counts AS (SELECT s_nationkey AS plan_id, 'R' || (s_nationkey % 3) AS region, p_type, k, count(*) AS quantity FROM supplier JOIN types ON k = s_suppkey % (SELECT count(*) FROM types) GROUP BY ALL),
  wanted AS (SELECT plan_id, region, CASE WHEN k > 0 THEN 'item ' || p_type ELSE 'missing:' || p_type END AS key, quantity, 0 AS part, p_type AS o FROM counts
    UNION ALL SELECT plan_id, region, (SELECT 'item ' || p_type FROM types WHERE k = 0), sum(quantity), 1, '' FROM counts GROUP BY plan_id, region),
  costed AS (SELECT plan_id, region, CAST(row_number() OVER (PARTITION BY plan_id, region ORDER BY part, o) - 1 AS INT) AS ordinal, key, coalesce(label, 'no such item: "' || key || '"') AS label, CAST(quantity AS BIGINT) AS quantity, low * quantity AS low, high * quantity AS high, coalesce(source_url, '') = '' AS unsourced FROM wanted LEFT JOIN firsts USING (region, key))"""
UTM = """geo AS (SELECT c_custkey, (c_custkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon, (c_custkey * 104729 % 160000) / 1000.0::DOUBLE - 80 AS lat FROM customer),
  zoned AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone, 0.0066943799901413165::DOUBLE AS e2, 6378137.0::DOUBLE AS a FROM geo),
  trig AS (SELECT *, radians(lat) AS phi, radians(lon) - radians((zone - 1) * 6 - 177) AS dl, e2 / (1 - e2) AS ep FROM zoned),
  terms AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS nu, tan(phi) ** 2 AS t, ep * cos(phi) ** 2 AS c, cos(phi) * dl AS w,
    a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM trig)"""
GROWTH = "(1 - exp(-2.5::DOUBLE * year / nullif(maturity, 0))) / (1 - exp(-2.5::DOUBLE))"


LOCAL = tuple((x, y - 400) for x, y in RING)
AREA = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(RING, RING[1:] + RING[:1], strict=True))) / 2
HUNDREDTHS = "CAST(round({} * 100) AS BIGINT)"


def _site() -> str:
    """fine and thermal pixels of the derived scenes, and ``whole``: what is measured of each, with its fit."""
    pixel = inside(LOCAL, "(col + 0.5) * 10", '-("row" + 0.5) * 10')
    spot = inside(LOCAL, "c * 40 + (i + 0.5) / 8 * 40", "-r * 40 - (j + 0.5) / 8 * 40")
    mean = lambda x, mask: f"avg({x}) FILTER ({mask})"
    return f"""{CELLS},
    fine AS (SELECT scene_id, "row", col, ndvi, in_yard, in_yard AND ndvi IS NOT NULL AS valid, coalesce(ndvi >= CASE WHEN scene_id LIKE 'A%' THEN 0.1 ELSE 0.14 END, false) AS cover FROM (SELECT *, {pixel} AS in_yard FROM cells)),
    means AS (SELECT scene_id, "row" // 4 AS "row", col // 4 AS col, avg(ndvi) AS v FROM fine GROUP BY ALL),
    dns AS (SELECT scene_id, CAST(l_orderkey % 40 // 4 AS INT) AS "row", CAST(l_partkey % 40 // 4 AS INT) AS col, count(*) AS c,
      (sum({HUNDREDTHS.format("l_discount")}) - sum({HUNDREDTHS.format("l_tax")})) / CAST(count(*) AS DOUBLE) AS d, sum(CAST(round(l_quantity) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS q FROM lines GROUP BY ALL),
    numbers AS (SELECT scene_id, "row", col, floor(30000 - 400 * d + (CASE scene_id WHEN 'AF' THEN 20 WHEN 'RF' THEN 600 ELSE 100 END)::DOUBLE * (q - 25) + 0.5::DOUBLE) AS dn, c % 9 <> 0 AS usable FROM dns),
    yard_shares AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, count(*) FILTER ({spot}) / 64.0::DOUBLE AS share FROM range(10) a(r), range(10) b(c), range(8) x(i), range(8) y(j) GROUP BY ALL),
    heated AS (SELECT n.*, v, share >= 0.15 AS in_yard FROM numbers n LEFT JOIN means USING (scene_id, "row", col) LEFT JOIN yard_shares USING ("row", col)),
    thermal AS (SELECT *, {celsius("dn")} AS lst FROM heated),
    covered_yards AS (SELECT scene_id, count(*) FILTER (in_yard) AS yard_pixels, count(*) FILTER (valid AND cover) / CAST(nullif(count(*) FILTER (valid), 0) AS DOUBLE) AS cover_fraction,
      {mean("ndvi", "valid")} AS ndvi_yard, {mean("ndvi", "valid AND cover")} AS ndvi_cover, {mean("ndvi", "valid AND NOT cover")} AS ndvi_open FROM fine GROUP BY scene_id),
    hot AS (SELECT scene_id, count(*) FILTER (in_yard) AS yard_cells, count(lst) FILTER (usable AND in_yard) AS thermal_pixels, coalesce(count(*) FILTER (usable AND in_yard) / CAST(nullif(count(*) FILTER (in_yard), 0) AS DOUBLE), 0) AS coverage,
      {mean("lst", "usable AND in_yard")} AS lst_mean, CASE count(lst) FILTER (usable AND in_yard) WHEN 1 THEN 0 ELSE stddev_samp(lst) FILTER (usable AND in_yard) END AS lst_sd, min(lst) FILTER (usable AND in_yard) AS lst_min, max(lst) FILTER (usable AND in_yard) AS lst_max FROM thermal GROUP BY scene_id),
    pairs AS (SELECT scene_id, regr_count(lst, v) AS n, regr_sxx(lst, v) AS sxx, regr_syy(lst, v) AS syy, regr_sxy(lst, v) AS sxy, avg(v) AS mx, avg(lst) AS my FROM thermal WHERE usable AND v IS NOT NULL AND lst IS NOT NULL GROUP BY scene_id),
    lines_of AS (SELECT scene_id, CAST(n AS BIGINT) AS n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, 1 - (syy - sxy * sxy / sxx) / syy AS r2, sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) * {t_value("(n - 2)::DOUBLE")} AS reach FROM pairs),
    whole AS (SELECT *, slope - reach AS ci_lo, slope + reach AS ci_hi FROM covered_yards JOIN hot USING (scene_id) JOIN lines_of USING (scene_id))"""


def _suggested() -> str:
    """trees of the plan that is suggested for each derived scene."""
    step = 5.5
    x0, x1 = min(p[0] for p in LOCAL), max(p[0] for p in LOCAL)
    y0, y1 = min(p[1] for p in LOCAL), max(p[1] for p in LOCAL)
    nx, ny = int((x1 - x0 - step / 2) // step) + 1, int((y1 - y0 - step / 2) // step) + 1
    probes = " AND ".join(inside(LOCAL, f"x + {dx}", f"y + {dy}") for dx, dy in ((0, 0), (6, 0), (-6, 0), (0, 6), (0, -6)))
    return f"""spots AS (SELECT {x0 + step / 2}::DOUBLE + i * {step}::DOUBLE AS x, {y0 + step / 2}::DOUBLE + j * {step}::DOUBLE AS y FROM range({nx}) a(i), range({ny}) b(j)),
    good AS (SELECT x, y, CAST(floor(-y / 10) AS INT) AS fr, CAST(floor(x / 10) AS INT) AS fc, CAST(floor(-y / 40) AS INT) AS cr, CAST(floor(x / 40) AS INT) AS cc FROM spots WHERE {probes}),
    cand AS (SELECT f.scene_id, x, y, coalesce(lst, 0) - 10 * ndvi AS score FROM good JOIN fine f ON f."row" = fr AND f.col = fc LEFT JOIN thermal h ON h.scene_id = f.scene_id AND h."row" = cr AND h.col = cc WHERE ndvi IS NOT NULL AND NOT cover),
    {GREEDY_STEPS},
    planted AS (SELECT scene_id, floor(p.x * 100 + 0.5) / 100 AS x, floor(p.y * 100 + 0.5) / 100 AS y, ordinal % 2 AS small FROM placed)"""


def _given() -> str:
    """trees of the fixed plan."""
    rows = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE, {int(k != 'large_shade')})" for x, y, k in PLAN)
    return f"planted AS (SELECT scene_id, x, y, small FROM whole, (VALUES {rows}) t(x, y, small) WHERE scene_id <> 'RF')"


def _planned(radii: tuple[float, float] = (7.5, 5.5), maturity: int = 20) -> str:
    """geometry of the planted trees."""
    return f"""trees AS (SELECT scene_id, x, y, CASE small WHEN 0 THEN {radii[0]} ELSE {radii[1]} END::DOUBLE AS radius FROM planted), {BOXES},
    counted AS (SELECT scene_id, count(*) AS points FROM covered WHERE {inside(LOCAL, "covered.px", "covered.py")} GROUP BY scene_id),
    areas AS (SELECT scene_id, coalesce(summed, 0) AS summed, coalesce(least(summed, coalesce(points, 0) * 0.25::DOUBLE), 0) AS united FROM whole LEFT JOIN sums USING (scene_id) LEFT JOIN counted USING (scene_id)),
    effects AS (SELECT *, CASE WHEN summed > 0 THEN 1 - united / summed ELSE 0 END AS overlap, CASE WHEN cover_fraction IS NULL THEN united ELSE united * greatest(0, least(1, 1 - cover_fraction)) END AS effective FROM whole JOIN areas USING (scene_id)),
    geometry AS (SELECT *, cover_fraction * 100 AS cover_before, greatest(0, least(100, 100 * (coalesce(cover_fraction * {AREA}::DOUBLE, 0) + effective) / {AREA}::DOUBLE)) AS cover_after, effective / {AREA}::DOUBLE * (ndvi_cover - ndvi_open) AS delta, {maturity}::DOUBLE AS maturity FROM effects)"""


def _reported(cited: bool, radii: tuple[float, float] = (7.5, 5.5), maturity: int = 20, prices: tuple[tuple[int, int, int], ...] = ((712, 512, 12), (944, 700, 20))) -> str:
    amount = lambda a, b, c: f"sum(CASE small WHEN 0 THEN {a} ELSE {b} END) + {c if cited else 0} * count(*)"
    say = {
        "insufficient_coverage": "printf('%.1f', coverage * 100) || '% of the yard is free of cloud, short of 80%: no change of temperature is given.'",
        "low_r2": "'R² = ' || printf('%.2f', r2) || ' is under 0.3, so cover hardly explains temperature here; the change is withheld, cover and cost stand.'",
        "no_fit": "CASE WHEN r2 IS NULL THEN 'No line fits temperature to cover around this site, so no change is given.' ELSE 'The plan''s shift of the yard''s index is unknown, and with it the change of temperature.' END",
    }
    withheld = " ".join(f"WHEN reason = '{k}' THEN {v}" for k, v in say.items())
    numbers = {"lst_mean": "lst_mean", "coverage": "coverage", **PLAN_SQL, "delta_c": "delta_c", "delta_lo": "delta_lo", "delta_hi": "delta_hi", "lst_predicted": "lst_mean + delta_c", "total_low": "low", "total_high": "high"}
    bounds = "'The sensor sees heat in cells of 100 m. Usable ones on this yard: ' || thermal_pixels || '. The temperature is the yard''s, not that of a tree.|One pass at 10:42 on one day: neither the day''s peak nor a climate.|Cover is what exceeds a threshold of the index, watered grass included; each site has its own threshold.|The change follows from a correlation within one scene, no simulation; hence the interval.|Crowns are drawn as they are expected when grown, not as planted.'"
    money = lambda x: f"'$' || format('{{:,}}', CAST({x} AS BIGINT))"
    price = f"CASE WHEN low = high THEN {money('low')} ELSE {money('low')} || ' – ' || {money('high')} END"
    return f"""{_planned(radii, maturity)},
    priced AS (SELECT scene_id, {amount(*prices[0])} AS low0, {amount(*prices[1])} AS high0, count(DISTINCT small) + 1 AS n_lines0 FROM planted GROUP BY scene_id),
    judged AS (SELECT *, {REASON} AS reason FROM geometry), gated AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'suppressed' WHEN r2 < 0.5 THEN 'weak' ELSE 'ok' END AS kind,
      CASE WHEN reason IS NULL THEN slope * delta END AS delta_c, CASE WHEN reason IS NULL THEN least(ci_lo * delta, ci_hi * delta) END AS delta_lo, CASE WHEN reason IS NULL THEN greatest(ci_lo * delta, ci_hi * delta) END AS delta_hi FROM judged),
    final AS (SELECT gated.*, coalesce(low0, 0) AS low, coalesce(high0, 0) AS high, coalesce(n_lines0, 0) AS n_lines, coalesce(n_lines0 - {0 if cited else 1}, 0) AS n_sourced FROM gated LEFT JOIN priced USING (scene_id))
    SELECT scene_id, {", ".join(f"{r(x, 4)} AS {n}" for n, x in numbers.items())}, thermal_pixels, kind, reason, n_lines, n_sourced,
      CASE {withheld} WHEN kind = 'weak' THEN 'A hint only: R² = ' || printf('%.2f', r2) || ' is a weak fit.' END AS explanation,
      CASE WHEN kind <> 'suppressed' THEN 'least squares of temperature on index, ' || n || ' pixels, R² = ' || printf('%.2f', r2) || ', crowns of {maturity} years' END AS method,
      CASE kind WHEN 'ok' THEN 'ESTIMATE' WHEN 'weak' THEN 'INDICATIVE' ELSE 'SUPPRESSED' END AS verdict,
      CASE WHEN n_lines > n_sourced THEN 'withheld: a price without a source' ELSE {price} END AS cost,
      {bounds} || CASE WHEN coverage < 1 THEN '|' || printf('%.1f', (1 - coverage) * 100) || '% of the yard''s thermal cells are masked.' ELSE '' END AS limitations FROM final"""


PLAN_SQL = {"summed": "summed", "united": "united", "overlap": "overlap", "effective": "effective", "cover_before": "cover_before", "cover_after": "cover_after", "cover_delta": "cover_after - cover_before", "delta_ndvi": "delta", "maturity": "maturity"}


def luminance(colour: str) -> str:
    def part(at: int, weight: float) -> str:
        c = f"(CAST('0x' || substr({colour}, {at}, 2) AS INT) / 255.0::DOUBLE)"
        return f"{weight}::DOUBLE * (CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END)"

    return " + ".join(part(*x) for x in ((2, 0.2126), (4, 0.7152), (6, 0.0722)))


def hex_case(t: str, ramp: tuple[str, ...]) -> str:
    arms = ", ".join(f"'{c}'" for c in ramp)
    return f"CASE WHEN ({t}) IS NULL THEN '#9a9a94' ELSE ([{arms}])[CAST(least(10, floor(greatest(0, least(1, {t})) * 10) + 1) AS INT)] END"


def oracles() -> dict[str, str]:
    from ..functions.raster import GREEN_RAMP, HEAT_RAMP

    pip = inside(RING, "(col + 0.5) * 10", '400 - ("row" + 0.5) * 10')
    hole = inside(HOLE, "(col + 0.5) * 10", '400 - ("row" + 0.5) * 10')
    sub_x, sub_y = "col * 40 + (i + 0.5) / 8 * 40", '400 - "row" * 40 - (j + 0.5) / 8 * 40'
    shares = f'WITH {LINES}, {HEAT}, shares AS (SELECT scene_id, "row", col, lst, count(*) FILTER ({inside(RING, sub_x, sub_y)}) / 64.0::DOUBLE AS yard_share FROM heat, range(8) a(i), range(8) b(j) GROUP BY ALL)'
    amounts = ", ".join(f"{r(c, 2)} AS {c}" for c in ("low", "high"))
    seg = lambda a, b: f"{a} * {a} * (acos((d * d + {a} * {a} - {b} * {b}) / (2 * d * {a})) - sin(2 * acos((d * d + {a} * {a} - {b} * {b}) / (2 * d * {a}))) / 2)"
    return {
        "ndvi_pixels": f"WITH {LINES} SELECT {KEY}, {r('v')} AS ndvi FROM lines",
        "bands_for_ndvi": f"WITH {LINES} SELECT {KEY}, CASE WHEN v IS NULL THEN 0 ELSE {r('greatest(0, l_quantity / 50 * (1 + v))')} END AS nir, CASE WHEN v IS NULL THEN 0 ELSE {r('greatest(0, l_quantity / 50 * (1 - v))')} END AS red FROM lines",
        "cover_fraction": f"WITH {LINES} SELECT scene_id, count(*) FILTER (v >= 0.2) / CAST(count(v) AS DOUBLE) AS fraction, count(v) AS known FROM lines GROUP BY scene_id",
        "masked_summary": f"WITH {LINES}, m AS (SELECT scene_id, CASE WHEN l_linenumber <= 5 THEN v END AS v FROM lines) SELECT scene_id, {r('avg(v)')} AS mean, {r('CASE count(v) WHEN 1 THEN 0 ELSE stddev_samp(v) END')} AS sd, {r('min(v)')} AS min, {r('max(v)')} AS max, count(v) AS n FROM m GROUP BY scene_id",
        "percentiles": f"WITH {LINES} SELECT scene_id, " + ", ".join(f"{r(f'quantile_cont(v, {p / 100})')} AS p{p}" for p in (10, 50, 90)) + " FROM lines GROUP BY scene_id",
        "lst_chain": f"WITH {LINES} SELECT {KEY}, {r(celsius('25000 + l_extendedprice / 10'), 4)} AS lst FROM lines",
        "lst_roundtrip": f"WITH {LINES}, inv AS (SELECT *, {dn_of('l_quantity')} AS dn FROM lines) SELECT {KEY}, {r('dn', 3)} AS dn, {r(celsius('dn'), 4)} AS celsius FROM inv",
        "qa_mask": f"WITH {LINES} SELECT scene_id, count(*) FILTER ({USABLE}) AS usable, count(*) AS pixels FROM lines GROUP BY scene_id",
        "coverage_gate": f"""WITH {LINES}, c AS (SELECT scene_id, count(*) FILTER ({USABLE} AND l_quantity > 10) / CAST(count(*) FILTER (l_quantity > 10) AS DOUBLE) AS coverage, count(*) FILTER (({USABLE} OR l_linenumber > 1) AND l_quantity > 10) / CAST(count(*) FILTER (l_quantity > 10) AS DOUBLE) AS clear FROM lines GROUP BY scene_id)
            SELECT scene_id, coverage, clear, CAST(0 AS DOUBLE) AS nothing, coverage >= 0.8 AS enough, clear >= 0.8 AS clear_enough FROM c""",
        "resample_aligned": overlap_sql(COARSE),
        "resample_offset": overlap_sql(SHIFTED),
        "coverage_to_grid": overlap_sql(COARSE, "coalesce(ndvi >= 0.2, false)"),
        "pip_mask": f'WITH {CELLS} SELECT scene_id, "row", col, {pip} AS in_yard FROM cells',
        "pip_hole": f"WITH {CELLS} SELECT scene_id, count(*) FILTER ({pip} AND NOT {hole}) AS inside, count(*) AS pixels FROM cells GROUP BY scene_id",
        "cell_overlap": f'{shares} SELECT scene_id, "row", col, yard_share FROM shares',
        "yard_cells": f"{shares} SELECT scene_id, count(*) FILTER (yard_share >= 0.15) AS cells, {r('avg(lst) FILTER (yard_share >= 0.15)')} AS lst FROM shares GROUP BY scene_id",
        "sample_at": f"""WITH {CELLS}, p AS (SELECT s_suppkey, ['AF', 'NF', 'NO', 'RF'][s_suppkey % 4 + 1] AS scene_id, CAST(floor((400 - CAST(s_suppkey * 61 % 450 - 20 AS DOUBLE)) / 10) AS INT) AS r, CAST(floor(CAST(s_suppkey * 37 % 450 - 20 AS DOUBLE) / 10) AS INT) AS c FROM supplier)
            SELECT s_suppkey, p.scene_id, r AS "row", c AS col, {r("ndvi")} AS ndvi FROM p LEFT JOIN cells ON cells.scene_id = p.scene_id AND cells."row" = r AND cells.col = c""",
        "ols_fit": f"WITH {FITS} SELECT scene_id, n, " + ", ".join(f"{r(c)} AS {c}" for c in ("slope", "intercept", "r2", "slope_se", "ci_lo", "ci_hi")) + " FROM whole",
        "ols_degenerate": f"""WITH {LINES}, u AS (SELECT scene_id, l_quantity AS x, l_discount AS y FROM lines WHERE l_linenumber = 2), s AS (SELECT scene_id, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM u GROUP BY scene_id)
            SELECT scene_id, 'constant x' AS "case", count(*) AS n, NULL::DOUBLE AS slope, NULL::DOUBLE AS r2 FROM lines GROUP BY scene_id
            UNION ALL SELECT scene_id, 'constant y', count(*), CAST(0 AS DOUBLE), NULL FROM lines GROUP BY scene_id
            UNION ALL SELECT scene_id, 'two pairs', 0, NULL, NULL FROM lines GROUP BY scene_id
            UNION ALL SELECT scene_id, 'unknown pairs', n, {r("sxy / sxx")}, {r("1 - (syy - sxy * sxy / sxx) / syy")} FROM s""",
        "t_critical": f"WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber), d AS (SELECT n - 2 AS df FROM c UNION SELECT n % 2 + 1 FROM c) SELECT df, {r(f'CASE df WHEN 1 THEN tan(pi() * 0.475) WHEN 2 THEN 0.95 * sqrt(2 / (4 * 0.975 * 0.025)) ELSE {t_value("df::DOUBLE")} END', 4)} AS t FROM d",
        "regression_band": f"""WITH {FITS}, span AS (SELECT scene_id, min(l_quantity) - (max(l_quantity) - min(l_quantity)) * 0.06 AS x0, max(l_quantity) + (max(l_quantity) - min(l_quantity)) * 0.06 AS x1 FROM lines GROUP BY scene_id),
            at AS (SELECT *, x0 + (x1 - x0) * step / 24 AS x FROM span JOIN whole USING (scene_id), (SELECT CAST(range AS INT) AS step FROM range(25)))
            SELECT scene_id, step, {r("x", 4)} AS x, {r("intercept + slope * x", 4)} AS y, {r("intercept + ci_lo * x", 4)} AS y_lo, {r("intercept + ci_hi * x", 4)} AS y_hi FROM at""".replace("at AS (", "spots AS (").replace("FROM at", "FROM spots"),
        "quantile_cutoff": f"WITH {LINES}, o AS (SELECT scene_id, l_extendedprice AS p, row_number() OVER (PARTITION BY scene_id ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM lines) SELECT scene_id, p AS cutoff FROM o WHERE k = floor(n * 0.3 + 0.5)",
        "predict_gate": f"WITH {GATED} SELECT p_partkey, kind, reason, " + ", ".join(f"CASE WHEN reason IS NULL THEN {r(x)} END AS {n}" for n, x in (("delta_c", "slope * delta"), ("delta_lo", "least(ci_lo * delta, ci_hi * delta)"), ("delta_hi", "greatest(ci_lo * delta, ci_hi * delta)"))) + " FROM gated",
        "explain_gate": f"""WITH {GATED} SELECT p_partkey, CASE
            WHEN reason = 'insufficient_coverage' THEN printf('%.1f', coverage * 100) || '% of the yard is free of cloud, short of 80%: no change of temperature is given.'
            WHEN reason = 'low_r2' THEN 'R² = ' || printf('%.2f', r2) || ' is under 0.3, so cover hardly explains temperature here; the change is withheld, cover and cost stand.'
            WHEN reason = 'no_fit' THEN 'The plan''s shift of the yard''s index is unknown, and with it the change of temperature.'
            WHEN kind = 'weak' THEN 'A hint only: R² = ' || printf('%.2f', r2) || ' is a weak fit.' END AS explanation, coalesce(printf('%.2f', delta), 'not measurable') AS delta FROM gated""",
        "decision_trace": f"""WITH {GATE_ROWS} SELECT p_partkey, 'coverage' AS gate, coverage AS measured, coverage >= 0.8 AS passed FROM gate_rows UNION ALL SELECT p_partkey, 'fit', r2, r2 >= 0.3 FROM gate_rows
            UNION ALL SELECT p_partkey, 'cost', CAST(p_partkey % 4 AS DOUBLE), p_partkey % 4 = 3 FROM gate_rows""",
        "verdicts": f"WITH {GATED} SELECT CASE kind WHEN 'ok' THEN 'ESTIMATE' WHEN 'weak' THEN 'INDICATIVE' ELSE 'SUPPRESSED' END AS verdict, 'ready-' || kind AS state, count(*) AS n FROM gated GROUP BY ALL",
        "crown_scalars": f"""WITH p AS (SELECT *, p_size / 4.0::DOUBLE - 1 AS rad, CAST(15 - p_partkey % 3 * 15 AS DOUBLE) AS maturity, CAST(p_partkey % 20 - 2 AS DOUBLE) AS year, CAST(p_partkey % 5 * 1000 AS DOUBLE) AS yard, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 13) / 10.0::DOUBLE END AS f FROM part)
            SELECT p_partkey, {r("CASE WHEN rad > 0 THEN pi() * rad * rad ELSE 0 END")} AS area, {r(f"CASE WHEN year <= 0 THEN 0 WHEN maturity <= 0 THEN rad ELSE rad * least(1, {GROWTH}) END")} AS grown,
            CASE WHEN yard > 0 THEN {r("greatest(0, least(100, 100 * (p_retailprice + p_size) / yard))")} END AS after, {r("CASE WHEN f IS NULL THEN p_retailprice ELSE p_retailprice * greatest(0, least(1, 1 - f)) END")} AS effective FROM p""",
        "lens_area": f"WITH p AS (SELECT s_suppkey, CAST(1 + s_suppkey % 7 AS DOUBLE) AS a, CAST(1 + s_suppkey % 5 AS DOUBLE) AS b, CAST(s_suppkey % 13 AS DOUBLE) AS d FROM supplier) SELECT s_suppkey, CASE WHEN d >= a + b THEN 0 WHEN d <= abs(a - b) THEN {r('pi() * least(a, b) * least(a, b)')} ELSE {r(f'{seg("a", "b")} + {seg("b", "a")}')} END AS area FROM p",
        "crown_union": f"""WITH {TREES}, {BOXES}, u AS (SELECT scene_id, summed, least(summed, coalesce(n, 0) * 0.25::DOUBLE) AS united FROM sums LEFT JOIN (SELECT scene_id, count(*) AS n FROM covered GROUP BY scene_id) USING (scene_id))
            SELECT scene_id, {r("summed", 4)} AS summed, {r("united", 4)} AS united, CASE WHEN summed > 0 THEN {r("1 - united / summed", 4)} ELSE 0 END AS overlap FROM u""",
        "crown_union_clipped": f"WITH {TREES}, {BOXES} SELECT scene_id, {r('least(summed, coalesce(n, 0) * 0.25::DOUBLE)', 4)} AS united FROM sums LEFT JOIN (SELECT scene_id, count(*) AS n FROM covered WHERE {inside(CLIP, 'covered.px', 'covered.py')} GROUP BY scene_id) USING (scene_id)",
        "suggest_candidates": f"WITH {_candidates()} SELECT scene_id, x, y, {r('score')} AS score FROM cand",
        "suggest_greedy": f"{GREEDY} SELECT scene_id, CAST(ordinal AS INT) AS ordinal, 't' || lpad(CAST(ordinal + 1 AS VARCHAR), 2, '0') AS id, floor(p.x * 100 + 0.5) / 100 AS x, floor(p.y * 100 + 0.5) / 100 AS y, CASE ordinal % 2 WHEN 0 THEN 'large' ELSE 'medium' END AS class_key FROM placed",
        "plan_edits": f"{GREEDY}, n AS (SELECT scene_id, count(*) - 1 + CAST(scene_id = 'AF' AS INT) AS trees FROM placed GROUP BY scene_id) SELECT scene_id, CAST(trees AS BIGINT) AS trees, 't' || lpad(CAST(trees AS VARCHAR), 2, '0') AS last_id FROM n",
        "cost_lines": f"WITH {COSTS} SELECT plan_id, region, ordinal, key, label, quantity, {amounts}, unsourced FROM costed",
        "cost_totals": f"WITH {COSTS} SELECT plan_id, region, {r('coalesce(sum(low) FILTER (NOT unsourced), 0)', 2)} AS total_low, {r('coalesce(sum(high) FILTER (NOT unsourced), 0)', 2)} AS total_high, bool_or(unsourced) AS has_unsourced, count(*) AS n_lines, count(*) FILTER (NOT unsourced) AS n_sourced FROM costed GROUP BY plan_id, region",
        "cost_format": "WITH p AS (SELECT p_partkey, p_partkey * 100 AS low, p_partkey * 100 + p_partkey % 3 * 1000 AS high FROM part) SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'withheld: a price without a source' WHEN low = high THEN '$' || format('{:,}', low) ELSE '$' || format('{:,}', low) || ' – $' || format('{:,}', high) END AS cost FROM p",
        "fully_cited": f"WITH {ITEMS} SELECT region, bool_and(source_url <> '') AS fully_cited FROM (SELECT region, source_url FROM items UNION ALL SELECT 'R9', source_url FROM items WHERE source_url <> '') GROUP BY region",
        "unverified": "SELECT 'R' || (p_size % 3) AS region, coalesce(string_agg(p_name, '|' ORDER BY p_partkey) FILTER (p_partkey % 3 <> 0), '') AS unverified FROM part GROUP BY region",
        "unverified_labels": "SELECT 'R' || (p_size % 3) AS region, p_partkey AS position, p_name AS label FROM part WHERE p_partkey % 3 <> 0",
        "ring_area": f"WITH {RINGS} SELECT s_suppkey, {r('a', 3)} AS signed, {r('abs(a)', 3)} AS area FROM areas",
        "ring_centroid": f"WITH {RINGS} SELECT s_suppkey, {r('cx', 4)} AS x, {r('cy', 4)} AS y FROM centres",
        "inset_ring": f"WITH {RINGS} SELECT s_suppkey, CAST(i AS INT) AS i, {r('cx + (x - cx) * sqrt(0.45::DOUBLE)', 2)} AS x, {r('cy + (y - cy) * sqrt(0.45::DOUBLE)', 2)} AS y FROM verts JOIN centres USING (s_suppkey)",
        "utm_forward": f"""WITH {UTM} SELECT c_custkey, zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INT) AS epsg,
            {r("0.9996::DOUBLE * nu * (w + (1 - t + c) * w ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * w ** 5 / 120) + 500000", 2)} AS easting,
            {r("0.9996::DOUBLE * (m + nu * tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * w ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * w ** 6 / 720)) + CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END", 2)} AS northing FROM terms""",
        "color_bins": f"WITH {LINES} SELECT {hex_case('(l_quantity - 20) / 35', HEAT_RAMP)} AS heat, {hex_case('v / 0.8::DOUBLE', GREEN_RAMP)} AS green, count(*) AS n FROM lines GROUP BY ALL",
        "list_scenes": "SELECT name, CAST(row_number() OVER (ORDER BY lower(name)) AS INT) AS place FROM (SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM nation)",
        "grid_lattice": f'WITH {LINES} SELECT scene_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, -15 + (c + 0.5::DOUBLE) * 37 AS x, 395 - (r + 0.5::DOUBLE) * 37 AS y, NULL::DOUBLE AS value FROM (SELECT DISTINCT scene_id FROM lines), range(12) a(r), range(12) b(c)',
        "scaled_bands": f"WITH p AS (SELECT p_partkey, CAST(p_partkey % 10000 AS DOUBLE) AS dn FROM part) SELECT p_partkey, {r('dn * 2.75e-5 - 0.2')} AS surface, {r('dn * 0.00341802::DOUBLE + 149')} AS thermal, {r('dn * 1e-4 - 0.1')} AS optical FROM p",
        "analyse_scene": f"WITH {_site()} SELECT scene_id, yard_pixels, yard_cells, thermal_pixels, n, " + ", ".join(f"{r(c, 4)} AS {c}" for c in MEASURED) + " FROM whole",
        "plan_geometry": f"WITH {_site()}, {_given()}, {_planned()} SELECT scene_id, " + ", ".join(f"{r(x, 4)} AS {n}" for n, x in PLAN_SQL.items()) + " FROM geometry",
        "build_report": f"WITH {_site()}, {_given()}, {_reported(False)}",
        "site_report": f"WITH RECURSIVE {_site()}, {_suggested()}, {_reported(True)}",
        "method_labels": f"WITH {GATED} SELECT p_partkey, CASE WHEN kind <> 'suppressed' THEN 'least squares of temperature on index, ' || format('{{:,}}', p_partkey * 7) || ' pixels, R² = ' || printf('%.2f', r2) || ', crowns of 15 years' END AS method FROM gated",
        "limitation_lines": f"""WITH {GATE_ROWS}, said AS (SELECT p_partkey, coverage, unnest(range(0, 6)) AS place FROM gate_rows) SELECT p_partkey, CAST(place AS INT) AS place, CASE place
            WHEN 0 THEN 'The sensor sees heat in cells of 100 m. Usable ones on this yard: ' || p_partkey % 9 || '. The temperature is the yard''s, not that of a tree.'
            WHEN 1 THEN 'One pass at 10:42 on one day: neither the day''s peak nor a climate.'
            WHEN 2 THEN 'Cover is what exceeds a threshold of the index, watered grass included; each site has its own threshold.'
            WHEN 3 THEN 'The change follows from a correlation within one scene, no simulation; hence the interval.'
            WHEN 4 THEN 'Crowns are drawn as they are expected when grown, not as planted.'
            ELSE printf('%.1f', (1 - coverage) * 100) || '% of the yard''s thermal cells are masked.' END AS line FROM said WHERE place < 5 OR coverage < 1""",
        "contrast": f"""WITH c AS (SELECT p_partkey, {hex_case("(p_size + 10 - 20) / 35::DOUBLE", HEAT_RAMP)} AS heat, {hex_case("p_size / 60::DOUBLE / 0.8::DOUBLE", GREEN_RAMP)} AS green FROM part),
            l AS (SELECT p_partkey, {luminance("heat")} + 0.05::DOUBLE AS a, {luminance("green")} + 0.05::DOUBLE AS b FROM c) SELECT p_partkey, {r("greatest(a, b) / least(a, b)", 4)} AS contrast FROM l""",
        "known_values": f"WITH {LINES} SELECT {KEY}, {r('v')} AS value FROM lines WHERE l_linenumber <= 2 AND v IS NOT NULL",
        "fit_points": f"WITH {LINES} SELECT {KEY}, {r('v')} AS x, l_quantity AS y FROM lines WHERE {USABLE} AND v IS NOT NULL AND l_quantity IS NOT NULL",
        "bool_grid": f'WITH {LINES}, {HEAT} SELECT s.scene_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, h.lst IS NOT NULL AS value FROM (SELECT DISTINCT scene_id FROM lines) s CROSS JOIN range(10) a(r) CROSS JOIN range(10) b(c) LEFT JOIN heat h ON h.scene_id = s.scene_id AND h."row" = r AND h.col = c',
        "plan_reset": f"{GREEDY}, n AS (SELECT scene_id, count(*) AS trees FROM placed GROUP BY scene_id) SELECT scene_id, trees - CASE scene_id WHEN 'AF' THEN 0 ELSE 2 END AS trees FROM n",
        "recess_yard": f"""WITH {RINGS}, parcels AS (SELECT s_suppkey, abs(a) * 9 AS parcel, 3 * cx AS cx, 3 * cy AS cy, sqrt(greatest(0.01, least(1, least(0.45, 9000 / greatest(1, abs(a) * 9))))) AS f FROM centres),
            drawn AS (SELECT s_suppkey, i, parcel, floor((cx + (3 * x - cx) * f) * 1000 + 0.5) / 1000 AS x, floor((cy + (3 * y - cy) * f) * 1000 + 0.5) / 1000 AS y FROM verts JOIN parcels USING (s_suppkey))
            SELECT v.s_suppkey, CAST(floor(abs(sum(w.x * v.y - v.x * w.y)) / 2 + 0.5) AS BIGINT) AS area, CAST(floor(any_value(v.parcel) + 0.5) AS BIGINT) AS parcel_area, 5 AS vertices FROM drawn v JOIN drawn w ON v.s_suppkey = w.s_suppkey AND w.i = (v.i + 4) % 5 GROUP BY v.s_suppkey""",
    }
