"""Joins by sky position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import photometry as ph


def box_crossmatch(objects: DataFrame, sources: DataFrame, half_arcsec: float, columns: list[str]) -> DataFrame:
    """Pairs of objects (obj_id, ra, decl) and sources inside a box of this half-width, with their separation.

    Declination bands one half-width high make the key; a source goes to its own band and an object looks at three, so the join is an
    equality and a dense field spreads over its bands and right-ascension cells. Cells are as wide as the box is at that declination, up to
    the whole circle at the poles. Right ascension runs from 0 to 360 and on from 0: an object near either end looks at the other one too.
    """
    half = half_arcsec / 3600.0
    band = lambda c: F.floor(c / F.lit(half))
    wide = lambda cos: F.least(F.lit(180.0), F.lit(half) / F.greatest(cos, F.lit(1e-9)))
    # width of a band's cells: the box at the edge of the band that is farther from the equator
    width = lambda b: wide(F.least(F.cos(F.radians(b * half)), F.cos(F.radians((b + 1) * half))))
    s = sources.withColumn("__band", band(F.col("decl"))).withColumn("__cell", F.floor(F.col("ra") / width(F.col("__band"))))
    s = s.select("__band", "__cell", F.col("ra").alias("s_ra"), F.col("decl").alias("s_decl"), *columns)
    o = objects.withColumn("__dra", wide(F.cos(F.radians("decl"))))
    turns = F.array(F.lit(0.0), F.when(F.col("ra") < F.col("__dra"), F.lit(360.0)), F.when(F.col("ra") > 360 - F.col("__dra"), F.lit(-360.0)))
    o = o.withColumn("__turn", F.explode(F.array_compact(turns))).withColumn("ra", F.col("ra") + F.col("__turn"))
    o = o.withColumn("__band", F.explode(F.array(*(band(F.col("decl")) + i for i in (-1, 0, 1)))))
    first, last = F.floor((F.col("ra") - F.col("__dra")) / width(F.col("__band"))), F.floor((F.col("ra") + F.col("__dra")) / width(F.col("__band")))
    o = o.withColumn("__cell", F.explode(F.sequence(first, last)))
    away = F.abs(F.col("s_ra") - F.col("ra"))
    met = o.join(s, ["__band", "__cell"]).where((away <= F.col("__dra")) & ((F.col("__turn") == 0) | (away < 180)) & (F.abs(F.col("s_decl") - F.col("decl")) <= F.lit(half)))
    sep = ph.separation(F.col("ra"), F.col("decl"), F.col("s_ra"), F.col("s_decl"))
    return met.select("obj_id", *columns, sep.alias("sep"))


def nearest(pairs: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy("obj_id").orderBy("sep", key)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def environment(pairs: DataFrame) -> DataFrame:
    """Per object: the nearest source of any kind, the nearest extended one, and how many extended ones there are."""
    ext = (F.col("ext") > 0.06) & (F.col("r_kron") != -999.0)
    any_, host = F.min(F.struct("sep", "src_id", "ext")), F.min(F.when(ext, F.struct("sep", "src_id", "r_kron", "ext")))
    e = pairs.groupBy("obj_id").agg(any_.alias("a"), host.alias("h"), F.count_if(ext).alias("n_ext"))
    return e.select("obj_id", F.col("a.sep").alias("near_sep"), F.col("a.ext").alias("near_ext"), F.col("h.sep").alias("host_sep"), F.col("h.r_kron").alias("host_r"), F.col("h.ext").alias("host_ext"), "n_ext")
