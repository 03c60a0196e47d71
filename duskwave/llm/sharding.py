"""Sharding by balanced label propagation; DataFrame operations only.

Documents with equal texts are linked. They are handled as atoms: the documents of one text that share a salt of their
id, so that a text which a third of all documents hold is many atoms and never one group in one task. Atoms start in a
shard by hash. In each round, joins tell every atom how many of its linked documents each shard has; it asks to move to
the shard that has most of them, and shards admit movers up to their free capacity. Documents without links are placed
last and even the shards out, and if linked ones alone overfill a shard, its last documents move on too, so the law
`rows` holds exactly: counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_before, stored

SALTS = 256


def propagate(atoms: DataFrame, capacity: int, shards: int = 16, rounds: int = 8, cells: int = 1) -> DataFrame:
    """text_key, salt, n -> also shard. Movers into a shard are admitted by cells of a hash of their text, each with its
    part of the shard's free capacity, so no shard's movers are sorted in one task. Only the shards' loads, one number
    each, come to the driver."""
    now = cut(atoms.withColumn("shard", F.pmod(F.xxhash64("text_key", "salt"), F.lit(shards)).cast("int")))
    for _ in range(rounds):
        load = {r["shard"]: r["load"] for r in now.groupBy("shard").agg(F.sum("n").alias("load")).collect()}
        spare = F.array(*(F.lit(max(0, capacity - load.get(s, 0)) // cells).cast("long") for s in range(shards)))
        free = lambda s: F.element_at(spare, s + 1)  # noqa: E731, B023
        linked = now.groupBy("text_key", "shard").agg(F.sum("n").alias("linked"))
        # where a text has most documents among the shards with room; the lower shard on ties, so that all its atoms agree
        best = linked.where(free(F.col("shard")) > 0).groupBy("text_key").agg(F.max(F.struct("linked", (-F.col("shard")).alias("s"))).alias("best"))
        asks = linked.join(best, "text_key").where((-F.col("best.s") != F.col("shard")) & (F.struct("best.linked", "best.s") > F.struct("linked", -F.col("shard"))))
        asks = asks.select("text_key", "shard", (-F.col("best.s")).alias("to"), F.pmod(F.xxhash64("text_key", F.lit(13)), F.lit(cells)).alias("cell"))
        queue = Window.partitionBy("to", "cell").orderBy("text_key", "salt").rowsBetween(Window.unboundedPreceding, 0)
        movers = now.join(asks, ["text_key", "shard"]).withColumn("ahead", F.sum("n").over(queue))
        admitted = cut(movers.where(F.col("ahead") <= free(F.col("to"))).select("text_key", "salt", "to"))
        if admitted.isEmpty():
            break
        now = cut(now.join(admitted, ["text_key", "salt"], "left").select("text_key", "salt", "n", F.coalesce("to", "shard").alias("shard")))
    return now


def assign_shards(docs: DataFrame, shards: int = 16, rounds: int = 8, cell_docs: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs, and the columns in carry.

    size is the text's UTF-8 bytes plus 1. Null and empty texts are equal. Rows that repeat an id are rows of their own; null ids share
    a salt. Fewer documents than shards leave shards empty; an empty table gives an empty result. A very long text counts as one row
    (the law is `rows`) and only its digest moves. Columns of docs that are not carried are ignored, whatever their names; carried ones
    must not be named like the columns above, or text_key, salt, h, at, cell, rank, waits, turn or f.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_key"), *carry)
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SALTS)).cast("int"))
    base = stored(base.withColumn("h", F.xxhash64("doc_id", "text_key")), "sharding")
    total = base.count()
    share, extra = divmod(total, shards)
    n_cells = max(1, total // cell_docs)
    salted = base.groupBy("text_key", "salt").agg(F.count("*").alias("n"))
    linked = salted.groupBy("text_key").agg(F.sum("n").alias("all_n")).where("all_n > 1").select("text_key")
    atoms = salted.join(linked, "text_key")
    placed = propagate(atoms, share, shards, rounds, max(1, n_cells // (shards * 64)))
    rows = base.join(placed.drop("n"), ["text_key", "salt"], "left")
    rows = rows.withColumn("at", F.coalesce("shard", F.lit(shards))).withColumn("cell", F.pmod("h", F.when(F.col("at") == shards, n_cells).otherwise(max(1, n_cells // shards))))
    # the place of each document in its shard, whole texts together; `shards` stands for documents that have none yet
    rows = stored(_numbered(rows, ["at"], "rank"), "sharding-ranked")
    goal = F.when(F.col("at") < extra, share + 1).otherwise(share)
    rows = rows.withColumn("waits", (F.col("at") == shards) | (F.col("rank") >= goal))
    waiting = _numbered(rows.where("waits").drop("rank"), [], "turn")
    # free places by shard, one number each: a waiting document takes the place of its turn
    have = {r["at"]: r["kept"] for r in rows.where("not waits").groupBy("at").agg(F.count("*").alias("kept")).collect()}
    places, turn = [], 0
    for s in range(shards):
        kept, goal_s = have.get(s, 0), share + (s < extra)
        if goal_s > kept:
            places.append(F.struct(F.lit(turn).cast("long").alias("from"), F.lit(s).alias("to"), F.lit(kept).cast("long").alias("kept")))
            turn += goal_s - kept
    found = F.element_at(F.filter(F.array(*places), lambda x: x["from"] <= F.col("turn")), -1) if places else F.lit(None).cast("struct<from:bigint,to:int,kept:bigint>")
    late = waiting.withColumn("f", found).select("doc_id", "size", "text_crc32", F.col("f.to").alias("shard"), (F.col("f.kept") + F.col("turn") - F.col("f.from")).alias("slot"), *carry)
    kept = rows.where("not waits").select("doc_id", "size", "text_crc32", F.col("at").cast("int").alias("shard"), F.col("rank").alias("slot"), *carry)
    return kept.union(late)


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 inside each value of by, in order of (cell, text_key, h): cells are counted first, their counts
    are added up in two levels, and only the rows of one cell are ever sorted together."""
    counts = running_before(rows.groupBy(*by, "cell").agg(F.count("*").alias("cell_n")), by, "cell", "cell_n", "cell_from").drop("cell_n")
    inside = Window.partitionBy(*by, "cell").orderBy("text_key", "h", "doc_id", "size")
    return rows.join(counts, [*by, "cell"]).withColumn(name, F.col("cell_from") + F.row_number().over(inside) - 1).drop("cell_from")
