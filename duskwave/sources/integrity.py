"""What a stored table held when it was vouched for: digests of files, a Merkle tree over partitions, and the refusal of what has changed.

Digests of rows take every column, so a change of any value is found. They don't depend on the order of rows, and rows that repeat count as often
as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 16


def row_digest(df: DataFrame) -> Column:
    """MD5 of all columns in the order of their names. Each value goes with its length, and a null as `~`, so that no two rows share a text."""
    text = lambda c: F.when(F.col(c).isNull(), F.lit("~")).otherwise(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    flat = df.dtypes
    nested = {c for c, t in flat if t.startswith(("array", "map", "struct", "binary", "variant"))}
    if nested:
        raise ValueError(f"only columns of plain values have a digest here, not {sorted(nested)}")
    return F.md5(F.concat_ws("|", *(text(f"`{c}`") for c in sorted(df.columns))))


def row_number_of(digest: Column) -> Column:
    """The first 60 bits of a digest, to be added up."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")


def partition_leaves(df: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
    """key (the partition's value as a string, `~` if null), n and digest of each partition, from these columns or all; one row a partition
    is shuffled by each task."""
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("~")).alias("key"), row_number_of(row_digest(df.select(*(columns or df.columns)))).alias("h"))
    leaves = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("h").cast("decimal(38,0)").alias("sum"))
    return leaves.select("key", "n", F.md5(F.concat_ws("|", "key", F.col("n").cast("string"), F.col("sum").cast("string"))).alias("digest"))


def merkle_tree(leaves: DataFrame) -> DataFrame:
    """level (0: partitions, 1: sixteen branches by the first digit of md5(key), 2: the root), node and digest.

    A parent's digest is that of its children's nodes and digests, in order. Only digests move: one row a partition.
    """
    leaf = leaves.select(F.lit(0).alias("level"), F.col("key").alias("node"), "digest")
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit("="), x["digest"])), ",")
    branch = leaf.groupBy(F.substring(F.md5("node"), 1, 1).alias("b")).agg(F.md5(children).alias("digest")).select(F.lit(1).alias("level"), F.col("b").alias("node"), "digest")
    root = branch.agg(F.md5(F.coalesce(children, F.lit(""))).alias("digest")).select(F.lit(2).alias("level"), F.lit("root").alias("node"), "digest")
    return leaf.union(branch).union(root)


def changed_nodes(stated: DataFrame, found: DataFrame) -> DataFrame:
    """level, node and change (added, missing or changed) of the nodes in which two trees differ."""
    both = stated.select("level", "node", F.col("digest").alias("a")).join(found.select("level", "node", F.col("digest").alias("b")), ["level", "node"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return both.select("level", "node", change.alias("change")).where("change is not null")


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """name (below root, an absolute path), bytes and sha256 of every Parquet file below root. A task holds one file at a time, at most two gigabytes."""
    base = root.removeprefix("file:").rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base)
    name = F.call_function("substring", F.col("path"), F.locate(base, "path") + len(base))
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def escapes(name: Column) -> Column:
    """Whether a manifest's file name leaves its folder: absolute, with a scheme or a drive, or with a part `..`."""
    plain = F.replace(F.coalesce(name, F.lit("..")), F.lit("\\"), F.lit("/"))
    return plain.startswith("/") | F.contains(plain, F.lit(":")) | plain.rlike(r"(^|/)\.\.(/|$)") | (plain == "")


def file_faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name and fault of the files in which a folder departs from its manifest: escapes, missing, changed, unlisted."""
    both = manifest.select("name", F.col("sha256").alias("a"), F.lit(True).alias("listed")).join(found.select("name", F.col("sha256").alias("b"), F.lit(True).alias("there")), "name", "full")
    fault = F.when(F.col("listed") & escapes(F.col("name")), "escapes").when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")


def vouched(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The table below root, or an error that names a faulty file when the files are not those of the manifest."""
    fault = file_faults(manifest, file_manifest(spark, root)).orderBy("name").first()
    if fault is not None:
        raise ValueError(f"{fault['name']}: {fault['fault']}")
    return spark.read.option("recursiveFileLookup", True).parquet(root)
