"""Near-duplicate classes by SimHash.

Equal fingerprints are merged first, so a group of any number of exact copies is one vertex. Pairs within three bits are
found by pigeonhole: of six blocks of the fingerprint at least three agree, so each distinct fingerprint goes out under
the 20 choices of three blocks (about 32 bits a key), and only fingerprints that share a key are compared. A key that
more than `most` fingerprints share is split by further blocks of the bits that it leaves open, again by pigeonhole, so no
link is lost: first by two of five blocks (about 13 bits more), then by one of four (about 5). What is left open then are
16 bits or fewer, so a bucket has 2^16 fingerprints at most, whatever the data. A bucket yields a spanning forest of its
links (at most one edge for each fingerprint, never its pairs); connected components of those edges equal those of all
links.

Three of 64 bits are few: of texts that share nine tenths of their shingles one fingerprint links less than half. A
caller may therefore ask for several fingerprints of a text, each from the shingles' hashes mixed in its own way; texts
link if any of these do. Each is a search by pigeonhole of its own, and the groups found by all of them are joined. These
searches start from one of four blocks (4 keys a fingerprint in place of 20): a group of near copies then shares few keys,
so it yields few edges to contract.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, schema_of, stored, with_text

BLOCKS = 6


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where it has fewer words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(w) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def mixed(h: np.ndarray, which: int) -> np.ndarray:
    """Hashes for the fingerprint of this number; those of 0 are h itself. Two rounds of multiplying by an odd constant and folding the upper half."""
    for _ in range(2 if which else 0):
        h = (h + np.uint64(which)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(32))
    return h


def majority(h: np.ndarray, which: int = 0) -> int:
    """64 bits: bit i is set if it is set in over half of the (mixed) hashes. Bits of many hashes are counted in stretches."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = mixed(h[at : at + (1 << 14)], which)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprint(text: str | None, words: int = 3, seed: int = 42, which: int = 0) -> int:
    """The text's fingerprint of this number; zero if it has no words."""
    return majority(shingle_hashes(text, words, seed), which)


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", words: int = 3, prints: int = 1) -> DataFrame:
    """keys, fp (the 64 bits as a signed long) and, for more prints than one, fp1, fp2, ... of every row; a null or blank text has zeros."""
    picked, own = with_text(docs, keys, text)
    names = print_names(prints)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.empty((batch.num_rows, prints), np.uint64)
        for i, t in enumerate(batch.column(own).to_pylist()):
            h = shingle_hashes(t, words)
            fps[i] = [majority(h, k) for k in range(prints)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(prints))], [*keys, *names])

    return arrow_map(picked, run, schema_of(picked, keys) + "".join(f", {n} long" for n in names), own)


def print_names(prints: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, prints))]


def _pieces(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of these bits, in order and of about equal size."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def block_masks(within: int | None = None, blocks: int = BLOCKS, equal: int = BLOCKS - 3) -> list[int]:
    """Masks of all choices of so many equal blocks. With `within` its bits are in every mask and the others are cut into blocks."""
    open_bits = [x for x in range(64) if not within or not within >> x & 1]
    return [(within or 0) | sum(c) for c in combinations(_pieces(open_bits, blocks), equal)]


#: How the bits that a key leaves open are cut on each level, and how many blocks agree if at most three bits differ.
LEVELS = ((BLOCKS, BLOCKS - 3), (5, 2), (4, 1))
#: The same with one of four blocks (16 bits) first: a fifth of the keys and of the edges, for larger buckets. The last level leaves 18 bits open or fewer.
WIDE = ((4, 1), (5, 2), (4, 1), (4, 1))


def bucket_forest(fps: np.ndarray, most_bits: int = 3, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """Edges (fingerprint, smallest of its component) for the links inside one bucket; temporaries have cells entries."""
    n = len(fps)
    if n == 2:
        return [(int(fps[1]), int(fps[0]))] if (int(fps[0] ^ fps[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= most_bits and fps[0] != fps[1] else []
    tile = max(1, cells // n)
    root = np.arange(n)
    while True:
        new = root.copy()
        for at in range(0, n, tile):
            near = np.bitwise_count((fps[at : at + tile, None] ^ fps[None, :]).view(np.uint64)) <= most_bits
            if np.count_nonzero(near) > len(near):  # else each is near to itself only
                new[at : at + tile] = np.where(near, root[None, :], n).min(axis=1)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(root) if i != r]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, most_bits: int = 3, most: int = 4096, by: tuple[str, ...] = (), levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """Edges (by, u, v), u > v, that join what fingerprints at most_bits (up to 3) or fewer differing bits link, of rows with the same values in by (int columns).

    A bucket of up to `most` fingerprints is compared in one piece; keys with more go to the next of the levels.
    """
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    todo, found, bucket = distinct.select(*by, "fp", F.lit(0).cast("long").alias("mask")).repartition(parts), None, [*by, "mask", "key"]
    masks = {0: [_signed(m) for m in block_masks(None, *levels[0])]}
    for level, _ in enumerate(levels):
        each = F.lit(None).cast("array<bigint>")
        for mask, finer in masks.items():
            each = F.when(F.col("mask") == mask, F.array(*map(F.lit, finer))).otherwise(each) if mask else F.array(*map(F.lit, finer))
        keyed = todo.select(*by, "fp", F.explode(each).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if level < len(levels) - 1:
            # keys are counted before fingerprints are gathered, so that no long list is ever built
            crowded = stored(keyed.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*bucket), "crowded")
            light = keyed.join(crowded, bucket, "left_anti")
        else:
            crowded, light = None, keyed
        buckets = light.groupBy(*bucket).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(*by, "fps")
        edges = _forests(buckets, most_bits, list(by))
        found = edges if found is None else found.union(edges)
        if crowded is None or crowded.isEmpty():
            break
        todo = keyed.join(crowded, bucket, "left_semi").select(*by, "fp", "mask").repartition(parts)
        blocks, equal = levels[level + 1]
        masks = {m: [_signed(x) for x in block_masks(m & (1 << 64) - 1, blocks, equal)] for finer in masks.values() for m in finer}
    return found.distinct()


def _forests(buckets: DataFrame, most_bits: int, by: list[str]) -> DataFrame:
    kinds = [pa.int32() for _ in by]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: set[tuple] = set()
        for i, fps in enumerate(batch.column("fps")):
            same = tuple(batch.column(c)[i].as_py() for c in by)
            found.update((*same, u, v) for u, v in bucket_forest(np.unique(fps.values.to_numpy()), most_bits))
        columns = zip(*found, strict=True) if found else [()] * (len(by) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int64(), pa.int64()], strict=True)], [*by, "u", "v"])

    return arrow_map(buckets, run, ", ".join([*(schema_of(buckets, [c]) for c in by), "u long, v long"]), "fps")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges (u > v) but the roots, by alternating large-star and small-star steps until nothing changes.

    Every round that changes the edges brings a vertex nearer to its root, so this ends; the number of rounds grows with the square
    of the logarithm of the number of vertices at worst.
    """

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    now, seen = cut(edges.select("u", "v")), None
    if (seen := digest(now))[0] == 0:
        return now.withColumnRenamed("v", "root")
    while True:
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low).distinct())
        if (got := digest(now)) == seen:
            return now.withColumnRenamed("v", "root")
        seen = got


def class_edges(tuples: DataFrame, prints: int, most_bits: int = 3) -> DataFrame:
    """Edges (u, v), u > v, between first fingerprints of tuples (fp, fp1, ...) that any of their fingerprints link.

    Fingerprints of all numbers are linked in one search, each among its own; then every class of a number that holds several first
    fingerprints ties them to its smallest one.
    """
    tall = tuples.select("fp", F.posexplode(F.array(*print_names(prints))).alias("which", "other")).distinct()
    tall = stored(tall, "simhash-prints")
    edges = links(tall.select("which", F.col("other").alias("fp")).distinct(), most_bits, by=("which",), levels=WIDE)
    ends = edges.select(F.struct("which", F.col("u").alias("fp")).alias("u"), F.struct("which", F.col("v").alias("fp")).alias("v"))
    star = components(ends).select(F.col("u.which").alias("which"), F.col("u.fp").alias("other"), F.col("root.fp").alias("root"))
    classed = tall.join(star, ["which", "other"], "left").select("fp", "which", F.coalesce("root", "other").alias("root")).distinct()
    least = classed.groupBy("which", "root").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return classed.join(least, ["which", "root"]).where("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most_bits: int = 3, carry: tuple[str, ...] = (), prints: int = 1
) -> DataFrame:
    """doc_id, fp, component_id, root and the columns in carry for every row: the smallest id reachable over links, the
    row's own included, and a fingerprint that names the class. Of several prints fp is the first.

    Repeated rows and repeated ids are kept. Null ids are never the smallest unless a class has no other, in which case
    component_id is null. Null, empty and blank texts have fingerprint zero and link like any other. An empty table
    gives an empty result. Shingles of a very long text are hashed one after the other and its bits counted in stretches. Columns of
    docs that are not carried are ignored, whatever their names.
    """
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry)
    rows = stored(fingerprints(picked, ["doc_id", *carry], "text", words, prints), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = links(distinct.select("fp"), most_bits) if prints == 1 else class_edges(rows.select(*print_names(prints)), prints, most_bits)
    star = components(edges)
    rooted = distinct.join(star, distinct["fp"] == star["u"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", *carry)


#: Fingerprints of a text where near copies are removed: each finds about two in five of the pairs with 0.9 to 0.95 of their five-word shingles in common.
#: More find more, and the search costs as many times more.
PRINTS = 8


def keep_one(docs: DataFrame, prints: int = PRINTS, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each class the one with the smallest doc_id (null ids are the largest).

    Of rows that are equal in every column one stays. Options as in near_duplicates().
    """
    named = docs.withColumn("__row", F.xxhash64(*docs.columns))
    classes = near_duplicates(named, carry=("__row",), prints=prints, **options)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first"))
    return named.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
