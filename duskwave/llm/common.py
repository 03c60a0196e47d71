"""Shared helpers: reading tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["arrow_map", "cut", "lower_ascii", "put_back", "running_before", "schema_of", "scratch_path", "set_aside", "shared_dir", "ship", "stored", "stored_at", "table", "text_slices", "with_text"]

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Python workers take this many bytes of text at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A temporary one only on a local master; elsewhere executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="duskwave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: short lineage, survives lost executors."""
    return stored_at(df, scratch_path(df.sparkSession, name), "errorifexists", **options)


def stored_at(df: DataFrame, path: str, mode: str, **options: str) -> DataFrame:
    """As stored(), at a path that may be written before: all that is there after df replaced it ("overwrite") or was added ("append")."""
    df.write.mode(mode).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, for the small tables of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_before(cells: DataFrame, by: list[str], cell: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """cells (one row for each of by and cell) with the sum of value over all smaller cells of the same by.

    In two levels: sums over stretches of width cells are added up first, so that no task orders more cells than width of a
    stretch, or one stretch's sum in width cells.
    """
    far, near = f"__{name}_far", f"__{name}_near"
    cells = cells.withColumn(near, F.floor(F.col(cell) / width))
    so_far = Window.partitionBy(*(by or [F.lit(0)])).orderBy(near).rowsBetween(Window.unboundedPreceding, -1)
    stretches = cells.groupBy(*by, near).agg(F.sum(value).alias(far)).withColumn(far, F.coalesce(F.sum(far).over(so_far), F.lit(0)))
    inside = Window.partitionBy(*by, near).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    found = cells.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(stretches, [*by, near])
    return found.withColumn(name, F.col(name) + F.col(far)).drop(near, far)


def lower_ascii(col) -> F.Column:
    """A-Z to a-z and nothing else; lower() does the same on pure ASCII and is cheaper."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, LOWER_FROM, LOWER_TO))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of about limit bytes of the column, so that numpy temporaries stay small."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).nbytes
    step = max(1, int(batch.num_rows * limit / max(sizes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """fn over runs of df's rows of about limit bytes of column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                yield fn(part)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_text(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    """keys and the text column of docs, and the text's name there: a text that is a key goes to Python once."""
    return (docs.select(*keys), text) if text in keys else (docs.select(*keys, F.col(text).alias("__text")), "__text")


def schema_of(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in names)


def set_aside(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs with every column but those in keep under a name that no operator uses, in docs' order; and all names."""
    names = [c if c in keep else f"__x{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))), names


def put_back(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))
