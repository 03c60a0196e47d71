"""Digests of rows, partitions and files: what changes is found, and what is not vouched for is refused."""

import pytest
from pyspark.sql import functions as F

from duskwave.sources import integrity, io

COLUMNS = "day string, id long, mag double, at timestamp, ok boolean, name string"


def table(spark):
    t = spark.range(60).select((F.col("id") % 5).cast("string").alias("day"), "id", (F.col("id") / 7).alias("mag"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("at"), (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("n|"), F.col("id").cast("string"))).alias("name"))
    return t


def tree(rows, by="day"):
    return integrity.merkle_tree(integrity.partition_leaves(rows, by))


def changes(a, b):
    return {(r["level"], r["node"]): r["change"] for r in integrity.changed_nodes(tree(a), tree(b)).collect()}


def test_a_change_in_any_column_is_found_and_placed(spark):
    t = table(spark)
    assert changes(t, t.repartition(7).orderBy(F.desc("id"))) == {}
    other = {"id": F.col("id") + 1000, "mag": F.col("mag") + F.lit(1e-15) * F.greatest("mag", F.lit(1.0)), "at": F.col("at") + F.expr("interval 1 microsecond"), "ok": ~F.col("ok"), "name": F.lit("")}
    for c, value in other.items():
        got = changes(t, t.withColumn(c, F.when(F.col("id") == 12, value).otherwise(F.col(c))))
        assert {n for (level, n) in got if level == 0} == {"2"} and len(got) == 3 and set(got.values()) == {"changed"}, c


def test_nulls_repeats_and_separators_make_no_equal_rows(spark):
    rows = [("a|", "b"), ("a", "|b"), ("a", None), (None, "a"), ("~", "a"), ("", None), (None, None)]
    t = spark.createDataFrame(rows, "x string, y string")
    assert t.select(integrity.row_digest(t)).distinct().count() == len(rows)
    assert {k for k in changes(table(spark), table(spark).union(table(spark).where("id = 3"))) if k[0] == 0} == {(0, "3")}
    assert changes(table(spark), table(spark).where("day <> '1'"))[(0, "1")] == "missing"
    assert changes(table(spark).where("day <> '1'"), table(spark))[(0, "1")] == "added"
    empty = tree(table(spark).limit(0)).collect()
    assert [(r["level"], r["node"]) for r in empty] == [(2, "root")]
    with pytest.raises(ValueError, match="plain values"):
        integrity.row_digest(spark.range(1).select(F.array("id").alias("list")))


def test_changed_missing_unlisted_and_escaping_files_are_refused(spark):
    root = io.scratch(spark, "files")
    table(spark).write.partitionBy("day").parquet(root)
    manifest = io.stored(integrity.file_manifest(spark, root), "manifest")
    names = [r["name"] for r in manifest.collect()]
    assert all(n.startswith("day=") for n in names) and integrity.vouched(spark, root, manifest).count() == 60
    faults = lambda m: {r["name"]: r["fault"] for r in integrity.file_faults(m, integrity.file_manifest(spark, root)).collect()}
    first = sorted(names)[0]
    assert faults(manifest.where(F.col("name") != first)) == {first: "unlisted"}
    assert faults(manifest.withColumn("sha256", F.when(F.col("name") == first, "00").otherwise(F.col("sha256")))) == {first: "changed"}
    odd = ["../x.parquet", "/etc/x.parquet", "a/../../x", "C:\\x", "s3://b/x", "a\\..\\x", "", None]
    extra = spark.createDataFrame([(n, 1, "00") for n in [*odd, "gone..parquet"]], "name string, bytes long, sha256 string")
    got = faults(manifest.unionByName(extra))
    assert {n: f for n, f in got.items() if n in odd} == dict.fromkeys(odd, "escapes") and got["gone..parquet"] == "missing" and len(got) == 9
    table(spark).where("day = '0' and id > 4").drop("day").write.mode("append").parquet(f"{root}/day=0")
    with pytest.raises(ValueError, match="unlisted"):
        integrity.vouched(spark, root, manifest)
