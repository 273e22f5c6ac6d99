"""Refusals as rows: what cannot be used is listed with its code and remedy, and everything else goes on.

Each check is one pass over its input. Columns: path, code, detail, message, remedy.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unknown import known
from ..sources.errors import MESSAGES, REMEDIES
from . import gates

MALFORMED = "FIXTURE_MALFORMED"
#: What a site's own documents must have, by name.
DOCUMENTS = {
    "meta": "grid struct<originX:double,originY:double,finePixelM:double,thermalPixelM:double,fineSize:int,thermalSize:int>, mtl struct<radianceMult:double,radianceAdd:double,k1:double,k2:double>",
    "yard": "properties struct<coordinatesProjected:array<array<double>>>",
    "costs": "region string, items array<struct<key:string,low:double,high:double>>",
}


def message(code: str, **details: Column) -> Column:
    """The text of ``errors.explained``, of columns."""
    out = []
    for text, field, spec, _ in Formatter().parse(MESSAGES[code]):
        out.append(F.lit(text))
        if field:
            value = details[field]
            if spec and spec.endswith("%"):
                out.append(F.concat(gates.text(value * 100, int(spec[1:-1])), F.lit("%")))
            else:
                out.append(gates.text(value, int(spec[1:-1])) if spec else value.cast("string"))
    return F.concat(*out)


def malformed(rows: DataFrame, path: Column, detail: Column) -> DataFrame:
    """The rows with a detail."""
    a = rows.select(path.alias("path"), F.lit(MALFORMED).alias("code"), detail.alias("detail")).where("detail is not null")
    return a.select("*", message(MALFORMED, path=F.col("path"), detail=F.col("detail")).alias("message"), F.lit(REMEDIES[MALFORMED]).alias("remedy"))


def documents(files: DataFrame, kind: str) -> DataFrame:
    """Refusals among small JSON files (path, text): no JSON of the form, a part missing, a ring too short."""
    parsed = files.select("path", F.from_json("text", f"{DOCUMENTS[kind]}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}).alias("j"))
    broken = F.col("j").isNull() | F.col("j.__corrupt").isNotNull()
    wrong = {
        "meta": F.when(F.col("j.grid.fineSize").isNull() | F.col("j.grid.thermalSize").isNull(), "no grid").when(F.col("j.mtl.k1").isNull() | F.col("j.mtl.k2").isNull(), "no constants of the thermal band"),
        "yard": F.when(F.coalesce(F.size("j.properties.coordinatesProjected"), F.lit(0)) < 3, "a ring needs three vertices"),
        "costs": F.when(F.col("j.region").isNull(), "no region").when(F.col("j.items").isNull(), "no items"),
    }[kind]
    return malformed(parsed, F.col("path"), F.when(broken, "no JSON of the expected form").otherwise(wrong))


def bands(sizes: DataFrame) -> DataFrame:
    """Refusals among band files, of ``BandScenes.sizes``."""
    return malformed(sizes, F.concat("scene_id", F.lit("/"), "band", F.lit(".json")), F.col("detail"))


def regions(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """Regions that are asked for and have no cost model."""
    strange = wanted.select("region").distinct().join(models.select("region").distinct(), "region", "left_anti")
    return malformed(strange, F.col("region"), F.lit("no cost model for this region"))


def outcomes(measured: DataFrame, path: str = "scene_id", required: float = gates.REQUIRED_COVERAGE, least_r2: float = gates.WEAK_R2) -> DataFrame:
    """Sites whose temperature or prediction is withheld; the first gate that fails decides.

    ``measured``: yard_cells (thermal cells in the yard), coverage, r2.
    """
    cover, r2 = F.coalesce(known(F.col("coverage")), F.lit(0.0)), F.coalesce(known(F.col("r2")), F.lit(0.0))
    code = F.when(F.coalesce(F.col("yard_cells"), F.lit(0)) == 0, "NO_THERMAL_OVERLAP").when(cover < required, "INSUFFICIENT_COVERAGE").when(r2 < least_r2, "FIT_UNRELIABLE")
    a = measured.select(F.col(path).cast("string").alias("path"), code.alias("code"), cover.alias("__cover"), r2.alias("__r2")).where("code is not null")
    says = {"NO_THERMAL_OVERLAP": message("NO_THERMAL_OVERLAP"), "INSUFFICIENT_COVERAGE": message("INSUFFICIENT_COVERAGE", coverage=F.col("__cover"), required=F.lit(required)), "FIT_UNRELIABLE": message("FIT_UNRELIABLE", r2=F.col("__r2"))}
    of = lambda table: F.coalesce(*[F.when(F.col("code") == c, v if isinstance(v, Column) else F.lit(v)) for c, v in table.items()])
    detail = F.when(F.col("code") == "INSUFFICIENT_COVERAGE", F.concat(F.lit("coverage "), gates.text(F.col("__cover"), 2))).when(F.col("code") == "FIT_UNRELIABLE", F.concat(F.lit("r2 "), gates.text(F.col("__r2"), 2)))
    return a.select("path", "code", detail.alias("detail"), of(says).alias("message"), of({c: REMEDIES[c] for c in says}).alias("remedy"))


def accepted(scenes: DataFrame, refused: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Scenes none of whose files is refused; ``path`` begins with the scene's folder."""
    bad = refused.where(F.col("code") == MALFORMED).select(F.element_at(F.split("path", "/"), 1).alias(scene)).distinct()
    return scenes.join(bad, scene, "left_anti")
