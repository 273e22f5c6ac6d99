"""Where to plant: a lattice of candidates by scene, their score, and greedy spaced placement."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import Store
from .lattice import GridDef, sample


@dataclass(frozen=True)
class Options:
    count: int
    classes: tuple[str, ...]
    cover_threshold: float = 0.6
    spacing: float = 11.0
    edge_buffer: float = 6.0


def lattice_points(polygons: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """``polygons`` with inner points of a square lattice half as wide as the spacing (2 m at least), in each bounding box."""
    step = max(2.0, spacing / 2)
    low_x, high_x, low_y, high_y = g.bounds(F.col("outer"))
    count = lambda low, high: F.floor((high - low - step / 2) / step).cast("int")
    line = lambda low, high: F.when(count(low, high) >= 0, F.sequence(F.lit(0), F.greatest(F.lit(0), count(low, high)))).otherwise(F.array().cast("array<int>"))
    a = polygons.withColumns({"__x0": low_x, "__y0": low_y, "__nx": line(low_x, high_x), "__ny": line(low_y, high_y)})
    a = a.withColumn("__j", F.explode("__ny")).withColumn("__i", F.explode("__nx"))
    a = a.withColumns({"x": F.col("__x0") + step / 2 + F.col("__i") * step, "y": F.col("__y0") + step / 2 + F.col("__j") * step})
    return a.select(*polygons.columns, "x", "y")


def candidates(polygons: DataFrame, ndvi: DataFrame, fine: GridDef, heat: DataFrame, coarse: GridDef, options: Options, keys: list[str]) -> DataFrame:
    """keys, x, y, score: hot, bare points inside the polygon and its buffer.

    Pixels of unknown index are no candidates; an unknown temperature counts as 0.
    """
    inside = lattice_points(polygons, keys, options.spacing)
    inside = inside.where(g.in_polygon(F.col("outer"), F.col("x"), F.col("y")) & g.well_inside(F.col("outer"), F.col("x"), F.col("y"), options.edge_buffer)).drop("outer")
    a = sample(inside, ndvi, fine, "ndvi", keys=tuple(keys)).where(F.col("ndvi") < options.cover_threshold).drop("row", "col")
    a = sample(a, heat, coarse, "lst", keys=tuple(keys))
    return a.select(*keys, "x", "y", (F.coalesce("lst", F.lit(0.0)) - 10 * F.col("ndvi")).alias("score"))


def place(found: DataFrame, options: Options, keys: list[str]) -> DataFrame:
    """keys, ordinal, id, x, y, class_key: the best candidates that keep their distance.

    Folds over one scene's candidates, of which there are as many as lattice points in one yard;
    ``place_by_rounds`` is for scenes of many.
    """
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "x", "y")))
    a = found.groupBy(*keys).agg(best.alias("best"))
    gap = options.spacing * options.spacing

    def near(p: Column, q: Column) -> Column:
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return dx * dx + dy * dy < gap

    def step(taken: Column, point: Column) -> Column:
        full = F.size(taken) >= options.count
        return F.when(full | F.exists(taken, lambda q: near(q, point)), taken).otherwise(F.concat(taken, F.array(point)))

    taken = F.aggregate("best", F.slice("best", 1, 0), step)
    a = a.select(*keys, F.posexplode(taken).alias("ordinal", "p"))
    return _named(a.select(*keys, "ordinal", "p.x", "p.y"), options, keys)


def _named(chosen: DataFrame, options: Options, keys: list[str]) -> DataFrame:
    """keys, ordinal, id, x, y (to the centimetre), class_key."""
    cm = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    number = (F.col("ordinal") + 1).cast("string")
    name = F.concat(F.lit("t"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))
    return chosen.select(*keys, "ordinal", name.alias("id"), cm("x").alias("x"), cm("y").alias("y"), F.get(F.array(*map(F.lit, options.classes)), F.col("ordinal") % len(options.classes)).alias("class_key"))


def conflicts(found: DataFrame, options: Options, keys: list[str]) -> DataFrame:
    """(better, worse): node numbers of candidates that are too near each other. Each point meets those of its own and the eight cells around."""
    cell = lambda c: F.floor(F.col(c) / options.spacing).cast("bigint")
    own = found.withColumns({"__i": cell("x"), "__j": cell("y")})
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = own.withColumn("s", F.explode(step)).select(*keys, (F.col("__i") + F.col("s.i")).alias("__i"), (F.col("__j") + F.col("s.j")).alias("__j"), F.col("node").alias("better"), F.col("place").alias("__p"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    near = own.join(sent, [*keys, "__i", "__j"]).where((F.col("__p") < F.col("place")) & (dx * dx + dy * dy < options.spacing * options.spacing))
    return near.select("better", F.col("node").alias("worse"))


def place_by_rounds(found: DataFrame, options: Options, keys: list[str], store: Store) -> DataFrame:
    """The same as ``place`` for scenes of any number of candidates: no task holds a scene.

    A candidate is taken once no better one within the spacing is undecided; those near it fall
    out. Each round decides all candidates that wait for none, and ends with two tables in the
    shared folder, so rounds are as many as the longest chain of ever better neighbours. What is
    taken is what the fold would take, since both decide in order of score; then each scene's
    first ``count`` are kept.
    """
    place_of = F.struct((-F.col("score")).alias("s"), "x", "y")
    nodes = store.save(found.select(*keys, "x", "y", place_of.alias("place"), F.monotonically_increasing_id().alias("node")), "nodes")
    edges = store.save(conflicts(nodes, options, keys), "edges-0")
    open_, taken, turn = nodes.select("node"), [], 0
    while True:
        turn += 1
        free = store.save(open_.join(edges.select(F.col("worse").alias("node")).distinct(), "node", "left_anti"), f"taken-{turn}")
        taken.append(free)
        fallen = edges.join(free, edges["better"] == free["node"], "left_semi").select(F.col("worse").alias("node")).distinct()
        open_ = store.save(open_.join(free, "node", "left_anti").join(fallen, "node", "left_anti"), f"open-{turn}")
        if open_.isEmpty():
            break
        both = edges.join(open_, edges["better"] == open_["node"], "left_semi")
        edges = store.save(both.join(open_, both["worse"] == open_["node"], "left_semi"), f"edges-{turn}")
    every = reduce(DataFrame.unionByName, taken)
    ordinal = (F.row_number().over(W.partitionBy(*keys).orderBy("place")) - 1).alias("ordinal")
    chosen = nodes.join(every, "node", "left_semi").select(*keys, ordinal, "x", "y").where(F.col("ordinal") < options.count)  # first ones by task before the shuffle
    return _named(chosen, options, keys)


def add_tree(trees: DataFrame, keys: dict[str, object], x: float, y: float, classes: tuple[str, ...]) -> DataFrame:
    """A further tree of one plan; its id and class follow from how many there are."""
    own = trees
    for k, v in keys.items():
        own = own.where(F.col(k) == F.lit(v))
    n = own.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("ordinal"))
    number = (F.col("ordinal") + 1).cast("string")
    new = n.select(
        *[F.lit(v).alias(k) for k, v in keys.items()],
        "ordinal",
        F.concat(F.lit("t"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0"))).alias("id"),
        F.lit(float(x)).alias("x"),
        F.lit(float(y)).alias("y"),
        F.get(F.array(*map(F.lit, classes)), F.col("ordinal") % len(classes)).alias("class_key"),
    )
    return trees.unionByName(new.select(*trees.columns))


def remove_last(trees: DataFrame, keys: list[str]) -> DataFrame:
    last = trees.groupBy(*keys).agg(F.max("ordinal").alias("ordinal"))
    return trees.join(last, [*keys, "ordinal"], "left_anti")


def clear(trees: DataFrame) -> DataFrame:
    return trees.where(F.lit(False))


def reset(trees: DataFrame, suggested: DataFrame, keys: dict[str, object]) -> DataFrame:
    """The trees of one plan as they were suggested, all others as they are."""
    own = F.lit(True)
    for k, v in keys.items():
        own = own & F.col(k).eqNullSafe(F.lit(v))
    return trees.where(~own).unionByName(suggested.where(own))
