"""Readers and sinks: manifests, ragged catalogues, alert documents, feature tables, append stores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "obj_id long, filepath string, bts_type string, broad string, n_events int, passes_quality boolean"
ALERT = "struct<detections:array<struct<mjd:double,fid:int,magpsf:double,sigmapsf:double>>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares. A temporary folder only on a local master; elsewhere executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="duskwave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: computed once, short lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, order: str, buckets: int | None = None) -> DataFrame:
    """df, written as a table dealt into buckets by key, sorted by key and order in each, and read again: windows, sums and joins by key
    plan without another exchange.

    As many buckets as shuffle partitions, so that a bucket has the size that the session wants of a partition, and one file a bucket, since
    rows are dealt the same way before they are written. The table is an external one of the session's catalogue in the shared folder. A null
    key is a key like any other here.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    table = "duskwave_" + basename(path).replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key, order).option("path", path).saveAsTable(table)
    return spark.table(table)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Manifest rows with their file paths made absolute."""
    m = spark.read.schema(MANIFEST).option("header", True).csv(path)
    return m.withColumn("filepath", F.concat(F.lit(root.rstrip("/") + "/"), "filepath"))


def read_ragged_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated rows of a catalogue page; blank lines and short rows are dropped, fields trimmed."""
    t = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return t.dropna(subset=t.columns[:2])


def read_survey_lists(spark: SparkSession, path: str, snids: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Unrolled rows (obj_id, mjd, photflag, mag) of list columns: of all objects, of those in a table of padded ids, of one type (pushed down)."""
    lists = spark.read.parquet(path)
    if kind is not None:
        lists = lists.where(F.col("obj_type") == kind)
    if snids is not None:
        lists = lists.join(snids.select("snid").distinct(), "snid", "left_semi")
    return lists.select(F.trim("snid").cast("long").alias("obj_id"), F.inline(F.arrays_zip("mjd", "photflag", "mag")))


def parse_alerts(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Detections of JSON documents: finite numbers, band 1 to 3, positive error."""
    rows = docs.withColumn("a", F.from_json(column, ALERT)).select("obj_id", F.inline("a.detections"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return rows.where(finite("mjd") & finite("magpsf") & finite("sigmapsf") & F.col("fid").isin(1, 2, 3) & (F.col("sigmapsf") > 0))


def merge_history(alerts: DataFrame, history: DataFrame, digits: int = 5) -> DataFrame:
    """Rows of both, one per object and rounded epoch: an alert wins over history."""
    both = alerts.withColumn("rank", F.lit(0)).unionByName(history.withColumn("rank", F.lit(1)))
    w = Window.partitionBy("obj_id", F.round("mjd", digits)).orderBy("rank", "mjd", "mag", "magerr")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def smallest_error(det: DataFrame, digits: int = 5) -> DataFrame:
    w = Window.partitionBy("obj_id", "fid", F.round("mjd", digits)).orderBy("magerr", "mag", "mjd")
    return det.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both, the last row of each key by `order`."""
    both = old.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def append_new(store: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of found whose key the store doesn't have."""
    return found.join(store.select(key), key, "left_anti")


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and the sum of row hashes."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns))), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("decimal(38,0)").alias("digest"))


def feature_sink(features: DataFrame, path: str, by: str = "horizon") -> DataFrame:
    """Writes a feature table partitioned by horizon, keys first and columns sorted, and reads it back."""
    keys = ["obj_id", by]
    features.select(*keys, *sorted(c for c in features.columns if c not in keys)).write.mode("overwrite").partitionBy(by).parquet(path)
    return features.sparkSession.read.parquet(path)


def basename(path: str) -> str:
    return os.path.basename(path.rstrip("/"))
