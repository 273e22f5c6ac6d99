"""Anchors of single functions: known values, unknown values, and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundline.functions import crowns, geometry, raster, unknown
from groundline.functions.order import placed
from groundline.functions.student_t import cdf, critical
from groundline.operators import costs, gates, masks, planner, regression, resample, stats, unions
from groundline.operators.lattice import GridDef, lattice, require_same_shape, sample
from groundline.sources.errors import Malformed
from groundline.sources.shared import Store

NAN, INF = float("nan"), float("inf")
L9 = (3.8e-4, 0.1, 799.0284, 1329.2405)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_ndvi_and_its_unknowns(spark):
    rows = [(0.5, 0.1), (0.0, 0.0), (NAN, 0.1), (INF, 0.1), (None, 0.1), (0.4, -0.1), (-0.2, 0.1)]
    got = values(spark, rows, "nir double, red double", raster.ndvi(F.col("nir"), F.col("red")))
    assert got[0] == pytest.approx(2 / 3) and got[1:5] == [None] * 4 and got[5:] == [1.0, 1.0]


def test_surface_temperature_chain(spark):
    assert one(spark, raster.brightness_temperature(F.lit(10.0), F.lit(774.8853), F.lit(1321.0789))) == pytest.approx(302.79, abs=0.01)
    assert one(spark, raster.vegetation_share(F.lit(0.35))) == pytest.approx(0.25)
    assert one(spark, raster.emissivity(F.lit(0.25))) == pytest.approx(0.987)
    assert one(spark, raster.brightness_temperature(F.lit(-1.0), F.lit(1.0), F.lit(1.0))) is None
    constants = [F.lit(x) for x in L9]
    rows = spark.createDataFrame([(41.5, 0.3, 1), (41.5, None, 2), (NAN, 0.3, 3), (INF, 0.3, 4), (-300.0, 0.3, 5)], "c double, v double, k int")
    a = raster.with_thermal_number(rows, "dn", F.col("c"), F.col("v"), *constants)
    got = {r.k: r for r in raster.with_surface_temperature(a, "back", F.col("dn"), F.col("v"), *constants).collect()}
    assert got[1].back == pytest.approx(41.5) and [got[k].back for k in (2, 3, 4)] == [None] * 3 and got[1].asDict().keys() == {"c", "v", "k", "dn", "back"}


def test_exact_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(4)
    every = [1.005, 0.125, 2.675, -0.001, 0.995, 99.995, 0.045, 1e15, 0.0, -2.5, *(rng.uniform(-200, 200) for _ in range(300)), *(rng.randrange(10**6) / 1000 for _ in range(300))]
    for digits in (0, 1, 2):
        got = values(spark, [(x,) for x in every], "x double", gates.text(F.col("x"), digits))
        want = [str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in every]
        assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert values(spark, [(None,)], "x double", gates.text(F.col("x"), 2)) == [None]


def test_ranks_and_percentiles(spark):
    rng = random.Random(8)
    groups_ = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [5.0] * 7, "c": [1e300, -1e300, 0.0, 2.0], "d": [1.0], "e": [1.0, 2.0] * 60 + [1e9]}
    rows = [(k, v) for k, vs in groups_.items() for v in vs] + [("a", None), ("b", NAN), ("z", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in stats.percentiles(df, F.col("v"), ["k"], [0, 10, 50, 99, 100]).collect()}
    for k, vs in groups_.items():
        assert [got[k][f"p{p}"] for p in (0, 10, 50, 99, 100)] == pytest.approx([float(np.percentile(vs, p)) for p in (0, 10, 50, 99, 100)]), k
    assert got["z"].p50 is None
    cut = {r.k: r.cutoff for r in regression.quantile_cutoff(df, "v", 0.3, ["k"]).collect()}
    assert cut == {k: (sorted(vs)[math.floor(len(vs) * 0.3 + 0.5) - 1] if math.floor(len(vs) * 0.3 + 0.5) else None) for k, vs in {**groups_, "z": []}.items()}


def test_quality_bits(spark):
    rows = [(0.0,), *((float(1 << b),) for b in range(6)), (256.0,), (None,), (NAN,), (10.0,)]
    assert values(spark, rows, "q double", raster.usable(F.col("q"))) == [True, *[False] * 6, True, False, False, False]


def test_colours(spark):
    rows = [(19.0,), (20.0,), (54.9,), (80.0,), (None,), (NAN,)]
    assert values(spark, rows, "t double", raster.heat_colour(F.col("t"))) == ["#000004", "#000004", "#fcffa4", "#fcffa4", raster.UNKNOWN_GREY, raster.UNKNOWN_GREY]
    assert one(spark, raster.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21.0)


def test_crowns(spark):
    assert [one(spark, crowns.crown_area(F.lit(r).cast("double"))) for r in (2.0, 0.0, -1.0, NAN, None)] == [pytest.approx(4 * math.pi), 0, 0, 0, 0]
    lens = lambda d, a, b: one(spark, crowns.lens_area(F.lit(0.0), F.lit(0.0), F.lit(a), F.lit(d), F.lit(0.0), F.lit(b)))
    assert lens(5.0, 2.0, 3.0) == 0 and lens(0.5, 1.0, 3.0) == pytest.approx(math.pi) and lens(1.0, 1.0, 1.0) == pytest.approx(2 * math.pi / 3 - math.sqrt(3) / 2)
    grown = lambda t, m: one(spark, crowns.radius_at(F.lit(6.0), F.lit(m), F.lit(t)))
    assert grown(0.0, 15.0) == 0 and grown(5.0, 0.0) == 6 and grown(15.0, 15.0) == pytest.approx(6) and grown(40.0, 15.0) == 6
    assert one(spark, crowns.percent_after(F.lit(90.0), F.lit(50.0), F.lit(100.0))) == 100
    assert one(spark, crowns.percent_after(F.lit(90.0), F.lit(50.0), F.lit(0.0))) is None
    assert one(spark, crowns.effective_added(F.lit(10.0), F.lit(None).cast("double"))) == 10


def test_student_t():
    # Published critical values.
    table = {1: 12.7062, 2: 4.3027, 3: 3.1824, 5: 2.5706, 10: 2.2281, 20: 2.0860, 30: 2.0423, 60: 2.0003, 120: 1.9799, 1000: 1.9623}
    for df, t in table.items():
        assert critical(df) == pytest.approx(t, abs=5e-5)
    assert cdf(0, 7) == pytest.approx(0.5) and math.isnan(critical(0)) and math.isnan(critical(INF))
    assert critical(10, 0.01) > critical(10, 0.05)


def test_polygons(spark):
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((20.0, 20.0), (60.0, 20.0), (60.0, 60.0), (20.0, 60.0))])
    hole = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((35.0, 35.0), (45.0, 35.0), (45.0, 45.0), (35.0, 45.0))])
    grid = GridDef(10, 10, 0.0, 100.0, 10.0, 10.0)
    cells = lattice(spark, grid).withColumn("scene_id", F.lit("s"))
    yard = spark.range(1).select(F.lit("s").alias("scene_id"), square.alias("outer"))
    assert masks.rasterise(cells, yard, grid).where("in_yard").count() == 16
    assert one(spark, geometry.in_polygon(square, F.lit(40.0), F.lit(40.0), F.array(hole))) is False
    assert one(spark, geometry.ring_area(square)) == 1600 and one(spark, geometry.signed_area(F.slice(square, 1, 2))) == 0
    assert one(spark, geometry.centroid(square)) == (40, 40)
    assert one(spark, geometry.well_inside(square, F.lit(25.0), F.lit(40.0), 6.0)) is False
    assert one(spark, geometry.well_inside(square, F.lit(25.0), F.lit(40.0), 0)) is True


def test_utm(spark):
    east, north = geometry.to_utm(F.lit(-111.0), F.lit(0.0), F.lit(12), F.lit(True))
    assert one(spark, east) == pytest.approx(500000) and one(spark, north) == pytest.approx(0)
    assert one(spark, geometry.utm_zone(F.lit(-112.1))) == 12 and one(spark, geometry.utm_epsg(F.lit(-112.1), F.lit(-33.5))) == 32712


def test_grids_and_samples(spark):
    grid = GridDef(3, 2, 100.0, 50.0, 10.0, 10.0)
    cells = lattice(spark, grid).orderBy("row", "col").collect()
    assert len(cells) == 6 and cells[0].x == 105 and cells[0].y == 45 and cells[0].value is None
    require_same_shape(grid, GridDef(3, 2, 100.0, 50.0, 10.0, 10.0), "bands")
    with pytest.raises(Malformed, match="bands"):
        require_same_shape(grid, GridDef(3, 2, 100.0, 50.0, 10.0, 20.0), "bands")
    pixels = lattice(spark, grid, F.lit(7.0)).select("row", "col", "value")
    points = spark.createDataFrame([(105.0, 45.0), (99.0, 45.0), (129.9, 30.1)], "x double, y double")
    assert {(r.x, r.value) for r in sample(points, pixels, grid, "value").collect()} == {(105.0, 7.0), (99.0, None), (129.9, 7.0)}


def test_resampling(spark):
    fine, coarse = GridDef(10, 10, 0.0, 100.0, 10.0, 10.0, 1), GridDef(2, 1, 0.0, 100.0, 100.0, 100.0, 1)
    half = lattice(spark, fine).withColumn("value", F.when(F.col("col") < 5, 1.0).otherwise(0.0)).withColumn("scene_id", F.lit("s"))
    got = {r.col: r.value for r in resample.resample(half, fine, coarse).collect()}
    assert got == {0: 0.5, 1: None}
    shifted = GridDef(1, 1, 25.0, 100.0, 50.0, 50.0, 1)
    assert resample.resample(half, fine, shifted).first().value == pytest.approx(0.5)
    with pytest.raises(Malformed):
        resample.resample(half, fine, GridDef(1, 1, 0.0, 0.0, 1.0, 1.0, 2))
    plan = resample.resample(half, fine, coarse, complete=False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_masked_statistics(spark):
    df = spark.createDataFrame([(10.0, True), (20.0, True), (30.0, False), (40.0, True), (NAN, True)], "v double, m boolean")
    s = df.agg(*[c.alias(n) for n, c in stats.summary(F.col("v"), F.col("m")).items()]).first()
    assert (s.mean, s.min, s.max, s.n) == (pytest.approx(70 / 3), 10, 40, 3)
    assert stats.values_in(df, F.col("v"), F.col("m")).count() == 3
    single = df.where("v = 10").agg(stats.summary(F.col("v"))["sd"].alias("sd")).first()
    assert single.sd == 0
    empty = df.where("v > 99 and v < 100").agg(stats.masked_mean(F.col("v"), F.col("m")).alias("a"), stats.coverage(F.col("m"), F.col("m")).alias("c")).first()
    assert (empty.a, empty.c) == (None, 0)


def fitted(spark, pairs):
    return regression.fit(spark.createDataFrame([("s", *p) for p in pairs], "k string, x double, y double"), F.col("x"), F.col("y"), ["k"]).first()


def test_equal_numbers_in_several_partitions(spark):
    """The merged means of equal numbers may differ in their last digit."""
    cases = {"x3": (238, lambda n: (3.0, float(n))), "y7": (128, lambda n: (float(n), 7.0)), "x0.1": (58, lambda n: (0.1, float(n)))}
    rows = [(k, *f(n)) for k, (size, f) in cases.items() for n in range(size)]
    whole = spark.createDataFrame(spark.sparkContext.parallelize(rows, 9), "k string, x double, y double")
    got = {r.k: r for r in regression.fit(whole, F.col("x"), F.col("y"), ["k"], more=("sxx", "syy", "sxy")).collect()}
    for k in ("x3", "x0.1"):
        assert got[k].sxx == 0 and got[k].sxy == 0 and got[k].slope is None and got[k].r2 is None
    assert got["y7"].syy == 0 and got["y7"].slope == 0 and got["y7"].slope_se == 0 and got["y7"].r2 is None


def test_regression_edges(spark):
    f = fitted(spark, [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (3.0, 7.0)])
    assert f.slope == pytest.approx(2) and f.r2 == 1 and f.slope_se == pytest.approx(0, abs=1e-9)
    assert fitted(spark, [(1.0, 1.0), (2.0, 2.0)]).slope is None
    assert fitted(spark, [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]).slope is None
    flat = fitted(spark, [(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)])
    assert flat.slope == 0 and flat.r2 is None
    assert fitted(spark, [(1.0, 1.0), (NAN, 2.0), (3.0, INF), (2.0, 2.5), (3.0, 2.0)]).n == 3
    big = fitted(spark, [(1e-8, 1e8), (2e-8, 2e8), (3e-8, 2.9e8)])
    assert big.slope == pytest.approx(9.5e15) and 0 <= big.r2 <= 1


def test_cost_citations(spark):
    rows = [("a", "https://x.org/p", "2026-01-02"), (" \t", "https://x.org", "2026-01-02"), ("a", "ftp://x", "2026-01-02"), ("a", "https://x.org", "2026-1-2"), (None, None, None), ("a", " https://x.org\n", " 2026-01-02 ")]
    got = values(spark, rows, "n string, u string, r string", costs.is_sourced(F.col("n"), F.col("u"), F.col("r")))
    assert got == [True, False, False, False, False, True]


def test_crown_union_of_two(spark):
    trees = spark.createDataFrame([("p", 0.0, 0.0, 5.0), ("p", 4.0, 0.0, 5.0), ("q", 0.0, 0.0, 3.0), ("q", 50.0, 0.0, 3.0), ("r", 0.0, 0.0, 0.0)], "scene_id string, x double, y double, radius double")
    got = {r.scene_id: r for r in unions.crown_union(trees, ["scene_id"], 0.1).collect()}
    lens = 2 * 25 * math.acos(0.4) - 2 * math.sqrt(25 - 4) * 2 / 1
    assert got["p"].united == pytest.approx(2 * 25 * math.pi - lens, rel=2e-3)
    assert got["q"].united == pytest.approx(18 * math.pi, rel=5e-3) and got["r"].united == 0 and got["r"].overlap == 0


def test_greedy_spacing(spark):
    found = spark.createDataFrame([("s", float(x), 0.0, float(-x)) for x in range(0, 60)], "scene_id string, x double, y double, score double")
    got = planner.place(found, planner.Options(4, ("a", "b"), spacing=11.0), ["scene_id"]).orderBy("ordinal").collect()
    assert [(r.id, r.x, r.class_key) for r in got] == [("t01", 0.0, "a"), ("t02", 11.0, "b"), ("t03", 22.0, "a"), ("t04", 33.0, "b")]
    trees = planner.place(found, planner.Options(4, ("a", "b")), ["scene_id"])
    assert planner.add_tree(trees, {"scene_id": "s"}, 1.0, 2.0, ("a", "b")).where("id = 't05' and class_key = 'a'").count() == 1
    assert planner.remove_last(trees, ["scene_id"]).count() == 3 and planner.clear(trees).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(allow_nan=True), st.floats(allow_nan=True)), min_size=1, max_size=30))
def test_ndvi_is_in_range_or_unknown(spark, rows):
    got = values(spark, rows, "a double, b double", raster.ndvi(F.col("a"), F.col("b")))
    assert all(v is None or -1 <= v <= 1 for v in got)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 40), st.floats(0, 40), st.floats(0.1, 6)), min_size=1, max_size=8))
def test_union_never_exceeds_the_sum(spark, trees):
    df = spark.createDataFrame([("s", *t) for t in trees], "scene_id string, x double, y double, radius double")
    r = unions.crown_union(df, ["scene_id"]).first()
    assert 0 <= r.united <= r.summed + 1e-9 and -1e-12 <= r.overlap <= 1


def test_clamp_keeps_unknown(spark):
    assert values(spark, [(None,), (5.0,), (-5.0,)], "x double", unknown.clamp(F.col("x"), 0, 1)) == [None, 1.0, 0.0]


def test_scan_lines_equal_the_ray_test(spark):
    """Random polygons with holes, on grids of their own, against a ray for each pixel; edge rows too."""
    rng = random.Random(12)
    polygons, near = [], lambda a, b: [float(rng.randint(a, b)) for _ in range(2)]
    for k in range(12):
        outer = [near(-20, 140) for _ in range(rng.randint(3, 9))]  # corners lie on pixel centres as well
        holes = [[near(0, 100) for _ in range(rng.randint(3, 5))] for _ in range(k % 3)]
        polygons.append((f"s{k}", outer, holes if k % 4 else None, 8 + k, 10.0 if k % 2 else 7.5, k))
    polygons += [("empty", [], [], 5, 10.0, 90), ("point", [[5.0, 5.0]], [], 5, 10.0, 91), ("none", None, None, 5, 10.0, 92)]
    yards = spark.createDataFrame(polygons, "scene_id string, outer array<array<double>>, holes array<array<array<double>>>, size int, cell double, note int")
    grid = GridDef(F.col("size"), F.col("size"), F.lit(-5.0), F.lit(115.0), F.col("cell"), F.col("cell"))
    pixels = [(p[0], r, c) for p in polygons for r in range(p[3]) for c in range(p[3])] + [("unknown", 0, 0), (None, 0, 0)]
    df = spark.createDataFrame(pixels, "scene_id string, row int, col int")

    def hit(ring, x, y):
        inside = False
        for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1], strict=True):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                inside = not inside
        return inside

    own = {p[0]: p for p in polygons}
    got = {(r.scene_id, r.row, r.col): (r.in_yard, r.note) for r in masks.rasterise(df, yards, grid, keep=("note",)).collect()}
    assert len(got) == len(pixels)
    for scene, r, c in pixels:
        _, outer, holes, _, cell, note = own.get(scene, (None, None, None, 0, 1.0, None))
        x, y = -5 + (c + 0.5) * cell, 115 - (r + 0.5) * cell
        assert got[scene, r, c] == (bool(outer) and hit(outer, x, y) and not any(hit(h, x, y) for h in holes or []), note)
    assert sum(inside for inside, _ in got.values()) > 100


def test_places_by_ranges(spark):
    names = [f"n{k * 7919 % 501:03d}" for k in range(501)] + ["n250"] * 40
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = placed(df.orderBy("name"), F.col("name"), Store(spark, "places")).collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.place)] == sorted(names) and sorted(r.place for r in rows) == list(range(1, len(names) + 1))
    assert placed(df.where("false").orderBy("name"), F.col("name"), Store(spark, "places")).count() == 0


def test_unverified_label_rows(spark):
    rows = [("R", 2, "b", "unverified"), ("R", 1, "a", None), ("R", 0, "c", "cited"), ("R", 2, "b", "unverified"), (None, 1, None, "")]
    got = costs.unverified_labels(spark.createDataFrame(rows, "region string, position int, label string, radius_status string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("R", 2, "b"), ("R", 1, "a"), ("R", 2, "b"), (None, 1, None)]))
