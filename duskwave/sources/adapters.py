"""The driver's tables as detections, sky positions, catalogues, score vectors and replay trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MJD0 = 60310  # 2024-01-01
DETECTION_KINDS = {"view": 1, "click": 2, "purchase": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, mjd, fid (1 g, 2 r, 3 i), mag, magerr: one row per detection. A value that is not positive has no magnitude."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*DETECTION_KINDS))
    fid = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    mjd = F.lit(float(MJD0)) + F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(86400000000.0)
    mag = F.when(F.col("value") > 0, F.lit(23.9) - F.lit(2.5) * F.log10("value"))
    # one number of a flat document: a pattern costs a fraction of parsing it
    err = F.lit(0.02) + F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1).try_cast("int") / F.lit(200.0)
    return e.select(F.col("user_id").alias("obj_id"), mjd.alias("mjd"), fid.alias("fid"), mag.alias("mag"), err.alias("magerr"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, ra, decl in degrees of every object with events."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("obj_id")).distinct()
    return u.select("obj_id", (F.pmod(F.col("obj_id") * 137, F.lit(3600)) / F.lit(10.0)).alias("ra"), (F.pmod(F.col("obj_id") * 71, F.lit(1200)) / F.lit(10.0) - 60).alias("decl"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, ra, decl, r_kron (-999: not measured), ext, n_det: sources near the objects 0 to 96."""
    p = table(spark, sf_dir, "part").withColumn("o", F.col("p_partkey") % 97)
    ra = F.pmod(F.col("o") * 137, F.lit(3600)) / F.lit(10.0) + (F.col("p_partkey") * 53 % 61 - 30) / F.lit(3600.0)
    decl = F.pmod(F.col("o") * 71, F.lit(1200)) / F.lit(10.0) - 60 + (F.col("p_partkey") * 29 % 41 - 20) / F.lit(3600.0)
    kron = F.when(F.col("p_partkey") % 11 == 0, F.lit(-999.0)).otherwise(F.lit(14.0) + F.col("p_size") * F.lit(0.15))
    return p.select(F.col("p_partkey").alias("src_id"), ra.alias("ra"), decl.alias("decl"), kron.alias("r_kron"), ((F.col("p_partkey") * 7 % 13 - 3) / F.lit(20.0)).alias("ext"), F.col("p_size").alias("n_det"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, truth (0..5), novel, fold, split, raw (six raw scores), emb (the whole vector)."""
    e = table(spark, sf_dir, "embeddings")
    part = F.col("vec_id") % 20
    split = F.when(part < 14, "train").when(part < 17, "val").otherwise("test")
    raw = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double") * 3)
    return e.select(F.col("vec_id").alias("obj_id"), (F.col("label") % 6).alias("truth"), (F.col("label") == 9).alias("novel"), (F.col("vec_id") % 5).alias("fold"), split.alias("split"), raw.alias("raw"), F.col("embedding").alias("emb"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj_id, k, p: a p-value for each analysis on the schedule (3 to 40, then multiples of 5)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    e = e.where(F.col("k").between(3, 40) | ((F.col("k") > 40) & (F.col("k") % 5 == 0)))
    return e.select(F.col("user_id").alias("obj_id"), "k", (((F.col("user_id") * 7919 + F.col("k") * 104729) % 1000 + 1) / F.lit(1001.0)).alias("p"))
