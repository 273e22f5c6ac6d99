"""Error model, composite, ranking, regions, band files, stores, refusals and edit logs: brute force and edge rows."""

from __future__ import annotations

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.functions.order import ranked, with_order_bits
from groundline.functions.unknown import fixed
from groundline.operators import composite, district, edits, gates, planner, refusals, spatial, stats
from groundline.plans import portfolio, report
from groundline.plans.bindings import PLAN, FixedCosts, TableScenes
from groundline.plans.portfolio import TwoRegions
from groundline.sources.band_files import PUSHDOWN, BandReader, BandScenes, Stripe, write_bands, write_documents
from groundline.sources.errors import Malformed
from groundline.sources.scenes import ParquetScenes
from groundline.sources.shared import Store

# Spatial error model


def brute_error(cells, bandwidth):
    x, y = (np.array([c[k] for c in cells], float) for k in (2, 3))
    sxx = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / sxx
    e = y - y.mean() - slope * (x - x.mean())
    u = (x - x.mean()) * e
    n, meat, w = len(cells), 0.0, np.zeros((len(cells), len(cells)))
    for i, a in enumerate(cells):
        for j, b in enumerate(cells):
            dr, dc = abs(a[0] - b[0]), abs(a[1] - b[1])
            meat += max(0, 1 - dr / (bandwidth + 1)) * max(0, 1 - dc / (bandwidth + 1)) * u[i] * u[j]
            w[i, j] = dr + dc == 1
    s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    moran = n / s0 * (e @ w @ e) / (e @ e)
    spread = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / (n - 1) ** 2
    plain = math.sqrt((e @ e) / ((n - 2) * sxx))
    return slope, plain, moran, (moran + 1 / (n - 1)) / math.sqrt(spread), math.sqrt(max(0, n * meat / (n - 2) / sxx**2))


@pytest.mark.parametrize("bandwidth", [0, 1, 3])
def test_error_model_equals_brute_force(spark, bandwidth):
    rng = np.random.default_rng(bandwidth)
    rows = []
    for scene, trend in (("trend", 1.0), ("even", 0.0)):
        for i in range(9):
            for j in range(11):
                if rng.random() < 0.9:
                    x = float(rng.random() + 0.1 * i)
                    rows.append((scene, i, j, x, 30 - 8 * x + trend * 3 * (j // 4) + float(rng.normal()), True))
    odd = [("trend", 20, 20, None, 1.0, True), ("trend", 21, 20, 1.0, float("nan"), True), ("trend", 3, 30, 9.0, 9.0, False), ("flat", 0, 0, 1.0, 1.0, True), ("flat", 0, 1, 1.0, 2.0, True), ("flat", 0, 2, 1.0, 4.0, True)]
    df = spark.createDataFrame(rows + odd, "scene_id string, row int, col int, x double, y double, ok boolean")
    got = {r.scene_id: r for r in spatial.error_model(df, F.col("x"), F.col("y"), ["scene_id"], F.col("ok"), bandwidth).collect()}
    for scene in ("trend", "even"):
        own, want = got[scene], brute_error([r[1:5] for r in rows if r[0] == scene], bandwidth)
        assert [own.slope, own.slope_se, own.moran_i, own.moran_z, own.hac_se] == pytest.approx(want)
        assert own.spatial_se == max(own.slope_se, own.hac_se)
    assert got["trend"].moran_i > 0.1 and got["trend"].moran_z > 2
    assert got["flat"].slope is None and got["flat"].ci_lo is None and got["flat"].moran_i is None


def test_error_model_of_no_cells(spark):
    assert spatial.error_model(spark.createDataFrame([], "scene_id string, row int, col int, x double, y double"), F.col("x"), F.col("y"), ["scene_id"]).count() == 0


# Order


def test_order_bits_are_those_of_the_double(spark):
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1e300, 0.1, 2.0**-1022, math.nextafter(8.0, 0), 8.0, 1e12]
    got = {r.v: r.b for r in with_order_bits(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "b", F.col("v")).collect()}
    assert got[None] is None
    for v in values:
        bits = int(np.array([abs(v)]).view(np.int64)[0])
        assert got[v] == (-bits if v < 0 else bits)


def test_ranks_with_ties_and_unknown_values(spark):
    rng = random.Random(3)
    values = [rng.choice((0.0, 0.0, rng.random() * 10.0 ** rng.randint(-8, 8), -rng.random())) for _ in range(500)] + [None, None]
    got = ranked(spark.createDataFrame(list(enumerate(values)), "id long, v double"), "v").collect()
    assert len(got) == len(values)
    for r in got:
        assert r["rank"] == (None if r.v is None else 1 + sum(o is not None and o > r.v for o in values))


@pytest.mark.parametrize("kind", ["outlier", "mostly equal", "tiny spread", "signs"])
def test_percentiles_of_odd_distributions(spark, kind):
    rng = np.random.default_rng(8)
    values = {"outlier": np.append(rng.random(2000), 1e12), "mostly equal": np.where(rng.random(2000) < 0.9, 7.0, rng.random(2000)), "tiny spread": 1 + rng.integers(0, 50, 2001) * 2.0**-52, "signs": rng.normal(size=1999) * 10.0 ** rng.integers(-9, 9, 1999)}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").withColumn("k", F.lit(1))
    got = stats.percentiles(df, F.col("v"), ["k"], [0, 10, 50, 90, 100]).first()
    assert [got.p0, got.p10, got.p50, got.p90, got.p100] == pytest.approx(np.percentile(values, [0, 10, 50, 90, 100]).tolist(), rel=1e-12)


def test_a_task_orders_no_group_of_values(spark):
    """One value a thousand million times the others: passes below the first see only its digit's values."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v),) for v in rng.random(20_000)] + [(1e12,)], "v double").withColumn("k", F.lit(1))
    bits = with_order_bits(df, "b", F.col("v")).select(F.shiftright("b", 42).alias("d")).groupBy("d").count()
    assert bits.agg(F.max("count")).first()[0] < 20_000 / 100


def test_large_numbers_in_words(spark):
    row = spark.range(1).select(gates.text(F.lit(1e20), 2).alias("a"), gates.text(F.lit(-1e300), 0).alias("b"), gates.text(F.lit(2.0**53 - 0.5), 0).alias("c"), gates.text(F.lit(0.125), 2).alias("d"), fixed(F.lit(1e20)).alias("e")).first()
    assert row.a == "100000000000000000000.00" and row.b == "-1.0E300" and row.d == "0.13" and row.e == 1e20


# Composite and ranking


def test_composite_medians_leave_out_cloud_and_unknown(spark):
    rows = [("a", 0, "2024-06-01", 1.0, True), ("a", 0, "2024-06-02", 9.0, False), ("a", 0, "2024-07-01", 2.0, True), ("a", 0, "2024-12-01", None, True), ("a", 1, "2024-06-01", 5.0, None), ("b", 0, "2024-06-01", 4.0, True)]
    df = spark.createDataFrame(rows, "scene_id string, row int, date string, v double, ok boolean").withColumn("date", F.to_date("date"))
    got = {(r.scene_id, r.row): r for r in composite.composite(df, {"v": F.col("v")}, F.col("ok"), ["scene_id", "row"], least=2).collect()}
    assert (got["a", 0].v, got["a", 0].n_dates, str(got["a", 0].last_date)) == (1.5, 3, "2024-12-01")
    assert (got["a", 1].v, got["a", 1].n_dates, got["a", 1].first_date) == (None, 0, None)
    assert (got["b", 0].v, got["b", 0].n_dates) == (None, 1)
    assert composite.in_season(df, (6,)).count() == 4


def test_withheld_sites_are_neither_dropped_nor_last(spark):
    rows = [(1, "ok", -2.0, 100.0, 100.0, False), (2, "ok", -2.0, 100.0, 100.0, False), (3, "weak", -1.0, 100.0, 100.0, False), (4, "suppressed", None, 1.0, 1.0, False), (5, "ok", -9.0, 1.0, 1.0, True), (6, "ok", -9.0, 0.0, 0.0, False), (7, "ok", 0.5, 10.0, 10.0, False)]
    df = spark.createDataFrame(rows, "id int, kind string, delta_c double, total_low double, total_high double, has_unsourced boolean")
    got = {r.id: (r.standing, r.place) for r in district.ranking(df).collect()}
    assert got == {1: ("ranked", 1), 2: ("ranked", 1), 3: ("indicative", 3), 4: (district.INSUFFICIENT, None), 5: (district.INSUFFICIENT, None), 6: (district.INSUFFICIENT, None), 7: ("ranked", 4)}


# Regions


def test_regions_are_chosen_or_refused(spark):
    scenes = spark.createDataFrame([("a",), ("b",)], "scene_id string")
    two, one = TwoRegions(spark), FixedCosts(spark, True)
    assert {(r.scene_id, r.region) for r in report.regions_of(scenes, one, None).collect()} == {("a", "R0"), ("b", "R0")}
    assert report.regions_of(scenes, two, "R1").count() == 2
    given = spark.createDataFrame([("a", "R0"), ("a", "R1"), ("a", "R1")], "scene_id string, region string")
    assert report.regions_of(scenes, two, given).count() == 2
    with pytest.raises(Malformed, match="several"):
        report.regions_of(scenes, two, None)
    with pytest.raises(Malformed, match="no cost model"):
        report.regions_of(scenes, two, "R7")
    with pytest.raises(Malformed, match="R7"):
        report.regions_of(scenes, two, given.withColumn("region", F.lit("R7")))


# Band files and stores


@pytest.fixture
def folder(spark):
    return Store(spark, "bands-test").root


def lattice_rows(spark, width, height, seed=1, scenes=("a", "b")):
    rng = random.Random(seed)
    rows = [(s, i, j, width, height, rng.random() * 10, float(rng.randrange(9)) if rng.random() < 0.8 else None) for s in scenes for i in range(height) for j in range(width) if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows, "scene_id string, row int, col int, width int, height int, nir double, red double")


def test_bands_come_back_by_stripes_with_gaps_unknown(spark, folder):
    rows, df = lattice_rows(spark, 7, 150)
    write_bands(df.repartition(3), folder, "nir", "red")
    want = {(s, i, j): (None, None) for s in ("a", "b") for i in range(150) for j in range(7)} | {r[:3]: r[5:] for r in rows}
    got = BandScenes(spark, folder).bands("nir", "red")
    assert {(r.scene_id, r.row, r.col): (r.nir, r.red) for r in got.collect()} == want
    reader = BandReader({"path": folder, "bands": "nir,red", "stripe": "900"})
    parts = reader.partitions()
    assert len(parts) > 6, "a file is read by several tasks"
    seen = [(s, i, j) for p in parts for b in reader.read(p) for s, i, j in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
    assert sorted(seen) == sorted(want)


def test_stripes_without_an_index_count_values_off(spark, folder):
    body = json.dumps({"data": [float(n) for n in range(3000)], "height": 300, "width": 10})  # sizes after the values
    write_documents(spark.createDataFrame([("a", "nir", body)], "scene_id string, name string, body string"), folder)
    reader = BandReader({"path": folder, "bands": "nir"})
    got = [v for k in range(4) for b in reader.read(Stripe("a", k, 4)) for v in b.column(3).to_pylist()]
    assert got == [float(n) for n in range(3000)]


def test_scene_filters_reach_the_source(spark, folder):
    _, df = lattice_rows(spark, 3, 4, scenes=("a", "b", "c"))
    write_bands(df, folder, "nir")
    before = spark.conf.get(PUSHDOWN, "false")
    try:
        for on in ("true", "false"):
            spark.conf.set(PUSHDOWN, on)
            one = BandScenes(spark, folder).bands("nir").where("scene_id = 'b'")
            assert one.count() == 12 and one.rdd.getNumPartitions() == (1 if on == "true" else 3)
    finally:
        spark.conf.set(PUSHDOWN, before)


def test_files_of_wrong_length_are_listed_not_raised(spark, folder):
    bodies = {"good": '{"width":2,"height":1,"data":[1,null]}', "short": '{"width":2,"height":2,"data":[1,2,3]}', "long": '{"width":1,"height":1,"data":[1,NaN]}', "empty": '{"width":0,"height":0,"data":[]}', "text": "nothing", "words": '{"width":1,"height":1,"data":["x"]}', "sizeless": '{"data":[1]}'}
    write_documents(spark.createDataFrame([(k, "nir", v) for k, v in bodies.items()], "scene_id string, name string, body string"), folder)
    sizes = BandScenes(spark, folder).sizes(("nir", "red"))
    got = {r.path: r.detail for r in refusals.bands(sizes).collect()}
    assert {p for p in got if p.endswith("nir.json")} == {f"{k}/nir.json" for k in ("short", "long", "text", "words", "sizeless")}
    assert got["short/nir.json"] == "4 values are expected, 3 were found" and got["good/red.json"] == "no such file"
    with pytest.raises(Exception, match="width x height"):
        BandScenes(spark, folder, "short").bands("nir").collect()


def test_rerun_replaces_its_scenes_only_and_load_prunes(spark, tmp_path):
    class Few:
        def __init__(self, scenes, add):
            self.ids, self.add = spark.createDataFrame([(s,) for s in scenes], "scene_id string"), add

        def scenes(self):
            return self.ids.withColumn("name", F.upper("scene_id"))

        yards = scenes

        def fine(self):
            return self.ids.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(1100))).alias("row"), F.lit(0).alias("col"), F.lit(self.add).alias("nir"))

        thermal = fine

    from groundline.sources.scenes import write_scenes

    root = str(tmp_path / "store")
    for source in (Few(("a", "b", "1"), 1.0), Few(("a", "b", "1"), 1.0), Few(("b",), 5.0)):
        write_scenes(source, root)
    got = ParquetScenes(spark, root).fine().groupBy("scene_id").agg(F.count("*").alias("n"), F.max("nir").alias("v")).collect()
    assert {(r.scene_id, r.n, r.v) for r in got} == {("a", 1101, 1.0), ("b", 1101, 5.0), ("1", 1101, 1.0)}
    one = ParquetScenes(spark, root).load("b").fine()
    assert "PartitionFilters: [isnotnull(scene_id" in one._jdf.queryExecution().toString() and one.count() == 1101
    with pytest.raises(Malformed):
        ParquetScenes(spark, root).load("nowhere")


# Refusals


def test_documents_are_refused_one_by_one(spark):
    files = lambda *texts: spark.createDataFrame([(f"s{n}/x.json", t) for n, t in enumerate(texts)], "path string, text string")
    good_yard = '{"properties": {"coordinatesProjected": [[0,0],[1,0],[1,1]]}}'
    assert [r.path for r in refusals.documents(files(good_yard, good_yard[:-4], '{"properties": {"coordinatesProjected": [[0,0]]}}', "{}", None, ""), "yard").orderBy("path").collect()] == [f"s{n}/x.json" for n in range(1, 6)]
    meta = {"grid": {"fineSize": 2, "thermalSize": 1}, "mtl": {"k1": 1.0, "k2": 2.0}}
    got = {r.path: r.detail for r in refusals.documents(files(json.dumps(meta), json.dumps(meta | {"grid": {}}), json.dumps(meta | {"mtl": None})), "meta").collect()}
    assert got == {"s1/x.json": "no grid", "s2/x.json": "no constants of the thermal band"}
    assert [r.detail for r in refusals.documents(files('{"region": "R0", "items": []}', '{"items": []}', '{"region": "R"}'), "costs").orderBy("path").collect()] == ["no region", "no items"]


def test_outcomes_have_every_code_and_unknown_numbers_fail_their_gate(spark):
    rows = [("none", 0, 1.0, 0.9), ("cloud", 4, 0.5, 0.9), ("loose", 4, 1.0, 0.1), ("good", 4, 0.8, 0.3), ("unknown", 4, None, None), ("nan", 4, 1.0, float("nan")), ("lost", None, None, None)]
    got = {r.path: r for r in refusals.outcomes(spark.createDataFrame(rows, "scene_id string, yard_cells int, coverage double, r2 double")).collect()}
    assert {k: v.code for k, v in got.items()} == {"none": "NO_THERMAL_OVERLAP", "cloud": "INSUFFICIENT_COVERAGE", "loose": "FIT_UNRELIABLE", "unknown": "INSUFFICIENT_COVERAGE", "nan": "FIT_UNRELIABLE", "lost": "NO_THERMAL_OVERLAP"}
    from groundline.sources.errors import explained

    assert got["cloud"].message == explained("INSUFFICIENT_COVERAGE", coverage=0.5, required=0.8) and got["loose"].message == explained("FIT_UNRELIABLE", r2=0.1)


# Edit logs


def brute_edits(log, suggested):
    plans = {k: list(v) for k, v in suggested.items()}
    for plan, _, _, action, x, y in sorted(log, key=lambda e: e[1:3]):
        trees = plans.setdefault(plan, [])
        if action == "place":
            trees.append((f"t{len(trees) + 1:02d}", x, y, ("big", "small")[len(trees) % 2]))
        elif action == "remove":
            plans[plan] = trees[:-1]
        elif action == "clear":
            plans[plan] = []
        elif action == "reset":
            plans[plan] = list(suggested.get(plan, []))
    return sorted((p, n, *t) for p, trees in plans.items() for n, t in enumerate(trees))


@pytest.mark.parametrize("seed", range(4))
def test_edit_logs_fold_like_a_list(spark, seed):
    rng = random.Random(seed)
    suggested = {p: [(f"t{n + 1:02d}", float(n), -1.0, ("big", "small")[n % 2]) for n in range(rng.randint(0, 4))] for p in range(6)}
    weights = ((8, 6, 0.2, 0.2, 1), (5, 8, 0, 0.3, 0), (9, 5, 0.1, 0, 0), (1, 1, 1, 1, 1))[seed]
    log = [(rng.choice((0, 0, 0, 1, 2, 3, 9)), rng.randrange(300), n, rng.choices(("place", "remove", "clear", "reset", "paint"), weights)[0], float(n), 2.0) for n in range(900)]
    df = spark.createDataFrame(log, "plan_id int, ts int, event_id int, action string, x double, y double").repartition(5)
    plans = spark.createDataFrame([(p, n, *t) for p, trees in suggested.items() for n, t in enumerate(trees)] or [], "plan_id int, ordinal int, id string, x double, y double, class_key string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a plan's log is in several ranges
    try:
        got = edits.after_edits(df, plans, ["plan_id"], ["ts", "event_id"], ("big", "small"), Store(spark, "edits-test"))
        assert sorted(tuple(r[c] for c in ("plan_id", "ordinal", "id", "x", "y", "class_key")) for r in got.collect()) == brute_edits(log, suggested)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


class Watched(Store):
    """Keeps the plan of every table that it writes."""

    def save(self, df, name):
        self.plans = [*getattr(self, "plans", []), df._jdf.queryExecution().executedPlan().toString()]
        return super().save(df, name)


def test_work_on_a_log_goes_with_its_length(spark):
    """A window that reaches to the end of a range is gone through anew for each row."""
    rng = random.Random(11)
    log = [(rng.choice((0, 0, 1)), n // 2, n, rng.choice(("place", "place", "remove")), float(n), 1.0) for n in range(6000)] + [(1, 100, -1, "clear", None, None), (0, 5, -1, "reset", None, None)]
    df = spark.createDataFrame(log, "plan_id int, ts int, event_id int, action string, x double, y double")
    suggested = {0: [("t01", 1.0, 2.0, "big"), ("t02", 3.0, 4.0, "small")], 1: [("t01", 1.0, 2.0, "big")]}
    plans = spark.createDataFrame([(p, n, *t) for p, trees in suggested.items() for n, t in enumerate(trees)], "plan_id int, ordinal int, id string, x double, y double, class_key string")
    store = Watched(spark, "edits-test")
    got = edits.after_edits(df, plans, ["plan_id"], ["ts", "event_id"], ("big", "small"), store)
    assert sorted(tuple(r[c] for c in ("plan_id", "ordinal", "id", "x", "y", "class_key")) for r in got.collect()) == brute_edits(log, suggested)
    assert not any("unboundedfollowing" in p for p in [*store.plans, got._jdf.queryExecution().executedPlan().toString()])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_no_window_of_the_edited_reports_reaches_to_its_end(spark, monkeypatch):
    plans, save = [], Store.save
    monkeypatch.setattr(Store, "save", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, name))[1])
    portfolio.edited_reports(spark, "/root/testdata/sf0.001")
    assert any("Window" in p for p in plans) and not any("unboundedfollowing" in p for p in plans)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_edited_reports_read_the_lines_once_and_their_measurements_once(spark, monkeypatch):
    plans, save = [], Store.save
    monkeypatch.setattr(Store, "save", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df, name))[1])
    last = portfolio.edited_reports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum(p.count("l_returnflag") > 0 for p in plans) == 1 and "l_returnflag" not in last
    assert sum("t_critical" in p for p in plans) == 1 and "t_critical" not in last


def test_sums_by_cell_give_the_heat_of_the_lines(spark, tmp_path):
    """Cells of four by four fine ones, with unknown keys and values and keys below 0, as summed from the lines themselves."""
    rng = random.Random(5)
    few = lambda *x: rng.choice((None, *x, *x, *x))
    rows = [(few(*range(-90, 90)), few(*range(-90, 90)), few(1.0, 2.0, 50.0), few(0.0, 0.05), few(0.01, 0.08), few("A", "R"), "F") for _ in range(4000)]
    rows += [(1, 1, None, None, None, "N", "O")] * 3
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    by_four = lambda c: F.floor(F.col(c) % 40 / 4).cast("int")
    total = lambda c, by: F.sum(F.round(F.col(c) * by).cast("bigint"))
    a = df.groupBy(F.concat("l_returnflag", "l_linestatus").alias("scene_id"), by_four("l_orderkey").alias("row"), by_four("l_partkey").alias("col"))
    a = a.agg(((total("l_discount", 100) - total("l_tax", 100)) / F.count("*")).alias("d"), (total("l_quantity", 1) / F.count("*")).alias("q"), F.count("*").alias("n"))
    noise = F.when(F.col("scene_id") == "AF", 20.0).when(F.col("scene_id") == "RF", 600.0).otherwise(100.0)
    dn = F.floor(30000 - 400 * F.col("d") + noise * (F.col("q") - 25) + 0.5).cast("double")
    wanted = a.select("scene_id", "row", "col", dn.alias("dn"), F.when(F.col("n") % 9 == 0, 8.0).otherwise(64.0).alias("qa"))
    assert sorted(map(repr, TableScenes(spark, str(tmp_path)).thermal().collect())) == sorted(map(repr, wanted.collect()))


def test_plans_without_edits_stay_as_suggested(spark):
    log = spark.createDataFrame([], "plan_id int, ts int, action string, x double, y double")
    plans = spark.createDataFrame([(1, n, f"t{n:02d}", x, y, c) for n, (x, y, c) in enumerate(PLAN)], "plan_id int, ordinal int, id string, x double, y double, class_key string")
    assert edits.after_edits(log, plans, ["plan_id"], ["ts"], ("big",), Store(spark, "edits-test")).count() == len(PLAN)


# Greedy placement by rounds


def test_rounds_place_what_the_fold_places(spark):
    rng = random.Random(6)
    rows = [(s, float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(5))) for s in ("a", "a", "a", "b") for _ in range(150)]
    rows += [("c", 0.0, 0.0, 1.0), ("c", 11.0, 0.0, 1.0), ("c", 10.99, 0.0, 1.0), ("d", float(-5), -7.0, 2.0)]
    df = spark.createDataFrame(sorted(set(rows)), "scene_id string, x double, y double, score double")
    for count in (5, 1000):
        options = planner.Options(count, ("large", "medium"))
        columns = ("scene_id", "ordinal", "id", "x", "y", "class_key")
        fold = sorted(tuple(r[c] for c in columns) for r in planner.place(df, options, ["scene_id"]).collect())
        rounds = sorted(tuple(r[c] for c in columns) for r in planner.place_by_rounds(df, options, ["scene_id"], Store(spark, "rounds-test")).collect())
        assert fold == rounds
    assert planner.place_by_rounds(df.limit(0), options, ["scene_id"], Store(spark, "rounds-test")).count() == 0


# Drawings


def test_drawings_are_bounded_and_say_what_is_missing(spark):
    from pyspark.sql import Row

    from groundline.sources import chart

    df = spark.createDataFrame([("a", float(i % 97), float(i % 89)) for i in range(20_000)] + [("b", 1.0, 1.0), ("b", None, 2.0)], "scene_id string, x double, y double")
    points = chart.binned_points(df, F.col("x"), F.col("y"), ["scene_id"]).collect()
    own = [p for p in points if p.scene_id == "a"]
    assert sum(p.n for p in own) == 20_000 and len(own) <= chart.CELLS**2 and [p.n for p in points if p.scene_id == "b"] == [1]
    fit = Row(slope=-2.0, intercept=50.0, ci_lo=-3.0, ci_hi=-1.0, r2=0.5, n=20_000)
    assert chart.fit_svg(fit, own).count("<circle") == len(own) and "slope -2.00" in chart.fit_svg(fit, own)
    assert "No fit" in chart.fit_svg(Row(slope=None), [])
    lines = [Row(ordinal=1, quantity=2, label="a & b", unsourced=True, low=None, high=None), Row(ordinal=0, quantity=1, label="oak", unsourced=False, low=100.0, high=1200.0)]
    svg = chart.cost_svg(lines, "withheld")
    assert svg.index("oak") < svg.index("a &amp; b") and "100 to 1,200" in svg and "no source" in svg and "withheld" in svg
    thermal = spark.createDataFrame([("a", i, j, 30.0 + i, i != 1, i == 2) for i in range(130) for j in range(4)], "scene_id string, row int, col int, lst double, usable boolean, in_yard boolean")
    cells = chart.heat_cells(thermal, ["scene_id"]).collect()
    assert len(cells) <= chart.CELLS**2 and max(c.j for c in cells) < chart.CELLS and chart.heat_svg(cells).count("<rect") == len(cells) and chart.heat_svg([]).startswith("<svg")
