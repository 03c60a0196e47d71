"""Drops lines that many documents share, and keeps each of them in one document only.

Lines are exploded once, as (document, position, 16-byte hash) without their text, and written to the shared folder. Distinct
(hash, document) pairs are counted per hash with map-side combine, so a line that a third of all documents hold costs one
row per task. What has to go from each document comes back as a list of positions, and the text is put together again from
the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """(pos, h) of the lines whose key has min_chars code points or more. Trimming only shortens, so short lines skip the rest."""
    long = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.char_length(x["line"]) >= min_chars)
    long = F.filter(long, lambda x: F.char_length(F.btrim(x["line"], F.lit(SPACES))) >= min_chars)
    return F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(line_key(x["line"]))).alias("h")))


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of docs.

    A null text is one empty line. Null ids count as one document, which is smaller than any other, so it keeps a
    common line only if no other document has it. Rows that repeat an id are one document: all of them keep or lose a
    line. Other columns of docs are ignored; an empty table gives an empty result. A text's work grows in proportion to
    its length, with any number of lines.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t"))
    own = rows.select("doc_id", "th", F.inline(line_hashes(F.split("t", "\n", -1), min_chars)))
    own = stored(own, "lines")
    pairs = own.select("h", "doc_id").distinct()
    common = pairs.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("h", "keeper")
    common = stored(common, "common-lines")  # with its size known the join is a broadcast, or one whose hot keys Spark can split
    lost = own.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # rows that are equal throughout have equal positions
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th")).agg(F.collect_set("pos").alias("gone"))
    lost = stored(lost, "lost-lines")  # small ones are broadcast, and then no text moves
    both = rows.join(lost, rows["doc_id"].eqNullSafe(lost["lost_id"]) & (F.col("th") == F.col("lost_th")), "left")
    both = both.select("doc_id", "gone", "t", F.split("t", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return both.select("doc_id", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
