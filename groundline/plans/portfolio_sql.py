"""The queries of ``portfolio`` in DuckDB SQL."""

from __future__ import annotations

from ..functions.raster import HEAT_RAMP
from .bindings import PLAN, RING
from .oracles import CELLS, GATED, LINES, _given, _reported, _site, hex_case, mean, r, t_value
from .oracles import oracles as sql
from .portfolio import ERRORS


def error_sql(cells: str, bandwidth: int) -> str:
    """``cells`` ends in a table ``own`` (scene_id, row, col, x, y) without unknown numbers."""
    kernel = f"(1 - abs(b.\"row\" - a.\"row\") / {bandwidth + 1}::DOUBLE) * (1 - abs(b.col - a.col) / {bandwidth + 1}::DOUBLE)"
    near = 'abs(b."row" - a."row") + abs(b.col - a.col) = 1'
    return f"""WITH {cells}, moments AS (SELECT scene_id, count(*)::DOUBLE AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, avg(y) AS my FROM own GROUP BY scene_id),
    fits AS (SELECT *, sxy / sxx AS slope, sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx)) AS slope_se FROM moments),
    res AS (SELECT scene_id, "row", col, y - my - slope * (x - mx) AS e, x - mx AS d FROM own JOIN fits USING (scene_id)),
    met AS (SELECT a.scene_id, a."row", a.col, any_value(a.e) AS e, any_value(a.d * a.e) AS u, sum({kernel} * b.d * b.e) AS ku, coalesce(sum(b.e) FILTER ({near}), 0) AS we, count(*) FILTER ({near}) AS degree
      FROM res a JOIN res b ON a.scene_id = b.scene_id AND abs(b."row" - a."row") <= {bandwidth} AND abs(b.col - a.col) <= {bandwidth} GROUP BY ALL),
    sums AS (SELECT scene_id, sum(u * ku) AS meat, sum(e * we) AS crossed, sum(e * e) AS ee, sum(degree)::DOUBLE AS s0, sum(degree * degree)::DOUBLE AS dd FROM met GROUP BY scene_id),
    judged AS (SELECT *, n * crossed / (s0 * ee) AS moran_i, (2 * n * n * s0 - 4 * n * dd + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS spread, sqrt(greatest(0, n * meat / ((n - 2) * sxx * sxx))) AS hac_se FROM fits JOIN sums USING (scene_id)),
    final AS (SELECT *, (moran_i + 1 / (n - 1)) / sqrt(spread) AS moran_z, greatest(slope_se, hac_se) AS spatial_se, greatest(slope_se, hac_se) * {t_value("(n - 2)")} AS reach FROM judged),
    bounds AS (SELECT *, slope - reach AS ci_lo, slope + reach AS ci_hi FROM final)
    SELECT scene_id, CAST(n AS BIGINT) AS n, {", ".join(f"{r(c, 4)} AS {c}" for c in ERRORS)} FROM bounds"""


DATED = f"""{LINES}, dated AS (SELECT scene_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_orderkey % 20 AS INT) AS "row", CAST(l_partkey % 20 AS INT) AS col, {mean("l_discount")} AS nir, {mean("l_tax")} AS red, sum(CAST(round(l_quantity) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS heat, count(*) AS n FROM lines GROUP BY ALL),
  seen AS (SELECT *, CASE WHEN nir + red = 0 THEN NULL ELSE greatest(-1, least(1, (nir - red) / (nir + red))) END AS v, n % 4 <> 0 AS clear FROM dated),
  composed AS (SELECT scene_id, "row", col, median(v) FILTER (clear) AS ndvi0, median(heat) FILTER (clear) AS heat0, count(*) FILTER (clear) AS n_dates, min(date) FILTER (clear) AS first_date, max(date) FILTER (clear) AS last_date FROM seen GROUP BY ALL),
  whole_composite AS (SELECT *, CASE WHEN n_dates >= 3 THEN ndvi0 END AS ndvi, CASE WHEN n_dates >= 3 THEN heat0 END AS heat FROM composed)"""
OTHER = {"radii": (6.0, 5.5), "maturity": 16, "prices": ((600, 450, 10), (800, 640, 18))}


def _regional(region: str, cited: bool, **more: object) -> str:
    return f"SELECT '{region}' AS region, * FROM (WITH {_site()}, {_given()}, {_reported(cited, **more)})"


def _refused(path: str, code: str, detail: str, says: str, remedy: str, rows: str) -> str:
    return f"SELECT {path} AS path, '{code}' AS code, {detail} AS detail, {says} AS message, '{remedy}' AS remedy FROM {rows}"


BROKEN = "Write the file anew and compare its size with its header."
YARDS = """yard_files AS (SELECT 's' || s_suppkey AS scene_id, 's' || s_suppkey || '/yard.json' AS path, CASE WHEN s_suppkey % 7 = 0 THEN 'no JSON of the expected form' WHEN s_suppkey % 5 + 1 < 3 THEN 'a ring needs three vertices' END AS detail FROM supplier),
  band_files AS (SELECT 's' || s_suppkey AS scene_id, 's' || s_suppkey || '/nir.json' AS path, CASE WHEN s_suppkey % 11 = 0 THEN 'no array of values' WHEN 2 * (s_suppkey % 3 + 1) <> s_suppkey % 6 + 1 THEN (2 * (s_suppkey % 3 + 1)) || ' values are expected, ' || (s_suppkey % 6 + 1) || ' were found' END AS detail FROM supplier)"""
EDITED = """edits AS (SELECT {key} AS plan_id, ts, event_id, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 89 = 0 THEN 'reset' WHEN event_id * 7 % 11 < 6 THEN 'place' ELSE 'remove' END AS action, floor(value * 100 + 0.5) / 100 AS x, CAST(event_id % 400 - 400 AS DOUBLE) AS y FROM (SELECT *, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 20 + 1 END AS INT) AS p FROM events) WHERE {where}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY ts, event_id) AS k FROM edits),
  steps AS (SELECT plan_id, CAST(0 AS BIGINT) AS k, trees, trees AS suggested FROM starts
    UNION ALL SELECT s.plan_id, n.k, CASE action WHEN 'clear' THEN CAST([] AS STRUCT(id VARCHAR, x DOUBLE, y DOUBLE, class_key VARCHAR)[]) WHEN 'reset' THEN suggested WHEN 'remove' THEN trees[: len(trees) - 1]
      ELSE list_append(trees, {{'id': 't' || lpad(CAST(len(trees) + 1 AS VARCHAR), CAST(greatest(2, length(CAST(len(trees) + 1 AS VARCHAR))) AS INTEGER), '0'), 'x': n.x, 'y': n.y, 'class_key': CASE len(trees) % 2 WHEN 0 THEN 'large_shade' ELSE 'medium_shade' END}}) END, suggested
    FROM steps s JOIN numbered n ON n.plan_id = s.plan_id AND n.k = s.k + 1),
  ends AS (SELECT plan_id, arg_max(trees, k) AS trees FROM steps GROUP BY plan_id)"""
GIVEN = "[" + ", ".join(f"{{'id': 't{n + 1:02d}', 'x': {x}::DOUBLE, 'y': {y}::DOUBLE, 'class_key': '{c}'}}" for n, (x, y, c) in enumerate(PLAN)) + "]"


def oracles() -> dict[str, str]:
    trend = '45 - 150 * value + floor("row" / 8) * 0.7::DOUBLE + ("row" * 31 + col * 17) % 11 / 10::DOUBLE'
    greedy = sql()["suggest_greedy"]
    low = "CAST((p_partkey % 10 + 1) * 100 AS DOUBLE)"
    return {
        "spatial_error": error_sql(f'{CELLS}, own AS (SELECT scene_id, "row", col, value AS x, {trend} AS y FROM cells)', 3),
        "scene_error_model": error_sql(f'{_site()}, own AS (SELECT scene_id, "row", col, v AS x, lst AS y FROM thermal WHERE usable AND v IS NOT NULL AND lst IS NOT NULL)', 2),
        "composite_pixels": f'WITH {DATED} SELECT scene_id, "row", col, {r("ndvi")} AS ndvi, {r("heat")} AS heat, n_dates, first_date, last_date FROM whole_composite',
        "composite_season": f"WITH {DATED} SELECT scene_id, {r('median(heat)')} AS heat, count(*) AS n_dates, min(date) AS first_date, max(date) AS last_date FROM dated WHERE month(date) IN (6, 7, 8) GROUP BY scene_id",
        "composite_fit": f"""WITH {DATED}, sums AS (SELECT scene_id, regr_count(heat, ndvi) AS n, regr_sxx(heat, ndvi) AS sxx, regr_syy(heat, ndvi) AS syy, regr_sxy(heat, ndvi) AS sxy, avg(ndvi) FILTER (heat IS NOT NULL) AS mx, avg(heat) FILTER (ndvi IS NOT NULL) AS my FROM whole_composite GROUP BY scene_id)
            SELECT scene_id, CAST(n AS BIGINT) AS n, {r("sxy / sxx")} AS slope, {r("my - sxy / sxx * mx")} AS intercept, {r("1 - (syy - sxy * sxy / sxx) / syy")} AS r2, {r("sqrt((syy - sxy * sxy / sxx) / ((n - 2) * sxx))")} AS slope_se FROM sums""",
        "district_ranking": f"""WITH {GATED}, priced AS (SELECT p_partkey, kind, CASE WHEN reason IS NULL AND p_partkey % 13 <> 0 THEN (-(slope * delta) * 1000) / (({low} + {low} * 1.5::DOUBLE) / 2) END AS s FROM gated)
            SELECT p_partkey, CASE WHEN s IS NULL THEN 'insufficient evidence' WHEN kind = 'weak' THEN 'indicative' ELSE 'ranked' END AS standing, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY s IS NULL ORDER BY s DESC) END AS place, {r("s")} AS score FROM priced""",
        "region_reports": f"{_regional('R0', True)} UNION ALL {_regional('R1', False, **OTHER)}",
        "region_report": _regional("R1", False, **OTHER),
        "scene_files": f"""WITH {CELLS}, every AS (SELECT s.scene_id, CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM (SELECT DISTINCT scene_id FROM cells) s, range(40) a(r), range(40) b(c))
            SELECT scene_id, "row", col, {r("value")} AS nir, {r("red")} AS red FROM every LEFT JOIN cells USING (scene_id, "row", col)""",
        "scene_load": f"""WITH {_site()} SELECT 'AF' AS scene_id, 'Site AF' AS name, CAST(0.1 AS DOUBLE) AS cover_threshold, 799.0284::DOUBLE AS k1, '10:42' AS overpass, 10 AS size, CAST(40 AS DOUBLE) AS pixel_w, count(dn) AS pixels, sum(dn) AS dn, count(*) FILTER (usable) AS usable, {len(RING)} AS vertices FROM numbers WHERE scene_id = 'AF'""",
        "scene_store": f"""WITH {_site()} SELECT scene_id, count(*) AS pixels, sum(dn + CASE WHEN scene_id IN ('AF', 'RF') THEN 100 ELSE 0 END) AS dn, min("row") AS first_row, max("row") AS last_row FROM numbers GROUP BY scene_id""",
        "scene_store_load": f"""WITH {CELLS} SELECT scene_id, "row", col, {r("value")} AS nir, {r("red")} AS red FROM cells WHERE scene_id = 'RF'""",
        "refused_sources": f"""WITH {YARDS}, sites AS (SELECT 'p' || p_partkey AS scene_id, p_partkey % 17 AS cells, coalesce(CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 21 / 20::DOUBLE END, 0) AS coverage, coalesce(CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 101 / 100::DOUBLE END, 0) AS r2 FROM part)
            {_refused("path", "FIXTURE_MALFORMED", "detail", "path || ' is not usable: ' || detail", BROKEN, "(SELECT path, detail FROM yard_files UNION ALL SELECT path, detail FROM band_files UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'no cost model for this region' FROM nation WHERE n_regionkey > 1) WHERE detail IS NOT NULL")}
            UNION ALL {_refused("scene_id", "NO_THERMAL_OVERLAP", "NULL", "'The yard lies outside the thermal scene, which therefore says nothing of its surface temperature.'", "Choose a scene that holds the yard, or check the yard''s projection.", "sites WHERE cells = 0")}
            UNION ALL {_refused("scene_id", "INSUFFICIENT_COVERAGE", "printf('coverage %.2f', coverage)", "printf('Clear pixels cover %.1f%% of the yard; 80%% are needed. Clouds hide the rest, so the site gets no temperature.', coverage * 100)", "Choose a date with a clear sky.", "sites WHERE cells <> 0 AND coverage < 0.8")}
            UNION ALL {_refused("scene_id", "FIT_UNRELIABLE", "printf('r2 %.2f', r2)", "printf('Cover explains too little of the temperature around this site (R² = %.2f). Cover and cost stand; no change of temperature is given.', r2)", "Choose a scene with more contrast between bare and planted ground.", "sites WHERE cells <> 0 AND coverage >= 0.8 AND r2 < 0.3")}""",
        "accepted_scenes": f"WITH {YARDS} SELECT scene_id FROM yard_files y JOIN band_files b USING (scene_id) WHERE y.detail IS NULL AND b.detail IS NULL",
        "suggest_rounds": greedy,
        "fit_plot": f"""WITH {LINES}, frame AS (SELECT scene_id, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lines GROUP BY scene_id)
            SELECT scene_id, CAST(least(59, floor((l_quantity - x0) / (x1 - x0) * 60)) AS INT) AS i, CAST(least(59, floor((l_extendedprice - y0) / (y1 - y0) * 60)) AS INT) AS j, count(*) AS n, {", ".join(f"{r(c, 4)} AS {c}" for c in ("x0", "x1", "y0", "y1"))} FROM lines JOIN frame USING (scene_id) GROUP BY ALL""",
        "heat_map": f"""WITH {_site()}, cell AS (SELECT scene_id, col // 2 AS i, "row" // 2 AS j, avg(lst) AS lst, bool_or(in_yard) AS in_yard FROM thermal WHERE usable GROUP BY ALL)
            SELECT scene_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {r("lst", 4)} AS lst, {hex_case("(lst - 20) / 35", HEAT_RAMP)} AS colour, in_yard FROM cell""",
        "edit_log": f"""WITH RECURSIVE starts AS (SELECT CAST(n_nationkey AS INT) AS plan_id, ({GIVEN})[: n_nationkey % 5 + 2] AS trees FROM nation), {EDITED.format(key="p", where="true")}
            SELECT plan_id, CAST(o AS INT) AS ordinal, t.id AS id, t.x AS x, t.y AS y, t.class_key AS class_key FROM (SELECT plan_id, unnest(range(0, len(trees))) AS o, unnest(trees) AS t FROM ends)""",
        "edited_reports": f"""WITH RECURSIVE {_site()}, starts AS (SELECT DISTINCT scene_id AS plan_id, {GIVEN} AS trees FROM whole), {EDITED.format(key="['AF', 'NO', 'RF'][p]", where="p BETWEEN 1 AND 3")},
            planted AS (SELECT plan_id AS scene_id, t.x AS x, t.y AS y, CAST(t.class_key <> 'large_shade' AS INT) AS small FROM (SELECT plan_id, unnest(trees) AS t FROM ends)), {_reported(True).replace("FROM final", "FROM final WHERE scene_id IN (SELECT plan_id FROM edits)")}""",
    }
