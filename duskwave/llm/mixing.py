"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame operations only.

A source's documents stand in a pseudo-random order, once for each time the mix goes through the source. The words of
that sequence are cut into blocks of equal size, and a source's quota is the whole number of blocks (the last one may
be short) that holds its target. The tree splits the quotas of all sources among the output shards: a node draws without
replacement which of its blocks go to its left half, source after source, each count from the exact hypergeometric
distribution. So every shard gets the mix's proportions but for sampling noise, and the quotas add up exactly. A shard's
blocks are a stretch of the permuted sequence that no other shard has, and a document that reaches over a shard's edge
is cut there, so that the shards' words are exactly those of their blocks. Inside a shard documents are shuffled by hash.

Only counts by source pass through the tree: its nodes hold one number for each source, so that it is sized by the number of
sources, not of documents. Positions in a source come from sums over cells (a thousand documents each, by hash) in two
levels, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import put_back, running_before, set_aside, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> also target: shares by weight of share x all sizes, none above most x its own size.

    Sources in code point order, null last, take the weights in turn. What a capped source can't take goes to the others
    by weight until none is above: the level L with sum(min(weight x L, cap)) = share x all sizes.
    """
    # one row per source: these windows see as many rows as there are sources
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source in this order that the level doesn't fill; those before it are full
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _draw(k: str, total: str, n: str, u: str) -> str:
    """SQL: how many of k marked among total blocks are among n drawn; u in [0, 1) picks from the exact distribution.

    The sum of probabilities runs over ten standard deviations to either side, beyond which less than 1e-20 is left.
    """
    p = f"transform(array(named_struct('k', {k}, 't', {total}, 'n', {n})), p -> named_struct('k', p.k, 't', p.t, 'n', p.n, 'm', p.n * p.k / greatest(p.t, 1D), 's', sqrt(p.n * p.k / greatest(p.t, 1D) * (p.t - p.k) / greatest(p.t, 1D) * (p.t - p.n) / greatest(p.t - 1, 1D))))"
    p = f"transform({p}, p -> named_struct('k', p.k, 't', p.t, 'n', p.n, 'range', sequence(cast(greatest(0D, p.n + p.k - p.t, floor(p.m - 10 * p.s - 10)) as bigint), cast(least(p.k, p.n, ceil(p.m + 10 * p.s + 10)) as bigint))))"
    step = "(p.k - j) * (p.n - j) / ((j + 1D) * greatest(p.t - p.k - p.n + j + 1, 1D))"
    p = f"transform({p}, p -> named_struct('k', p.k, 't', p.t, 'n', p.n, 'range', p.range, 'all', aggregate(p.range, named_struct('w', 1D, 'c', 0D), (s, j) -> named_struct('w', s.w * {step}, 'c', s.c + s.w), s -> s.c)))"
    pick = f"aggregate(p.range, named_struct('w', 1D, 'c', 0D, 'got', element_at(p.range, -1), 'open', true), (s, j) -> named_struct('w', s.w * {step}, 'c', s.c + s.w, 'got', if(s.open and s.c + s.w >= {u} * p.all, j, s.got), 'open', s.open and s.c + s.w < {u} * p.all), s -> s.got)"
    return f"element_at(transform({p}, p -> {pick}), 1)"


def split_quotas(quotas: DataFrame, levels: int = 3, seed: int = 7) -> DataFrame:
    """source, blocks -> source, bounds: for 2^levels shards, the running totals of the source's blocks by shard."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "source", F.col("blocks").cast("double").alias("k")))).alias("held")).select(F.lit(0).alias("shard"), "held")
    total = "aggregate(held, 0D, (a, x) -> a + x.k)"
    for level in range(levels):
        # a node's left half gets half of its blocks; odd ones by the node's number
        n_left = f"floor(({total} + shard % 2) / 2)"
        u = f"(pmod(xxhash64(x.key, shard, {level}, {seed}), 1000000007) / 1000000007D)"
        draw = _draw("x.k", "a.t", "a.n", u)
        done = f"transform(array({draw}), got -> named_struct('t', a.t - x.k, 'n', a.n - got, 'out', array_append(a.out, cast(got as double))))[0]"
        node = node.withColumn("left", F.expr(f"aggregate(held, named_struct('t', {total}, 'n', cast({n_left} as double), 'out', cast(array() as array<double>)), (a, x) -> {done}, a -> a.out)"))
        half = "transform(zip_with(held, left, (x, l) -> named_struct('key', x.key, 'source', x.source, 'k', {})), x -> x)"
        node = node.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.expr(half.format("l")).alias("held")), F.struct((F.col("shard") * 2 + 1).alias("shard"), F.expr(half.format("x.k - l")).alias("held")))).alias("c")).select("c.*")
    by_source = node.select("shard", F.explode("held").alias("h")).groupBy("h.key").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.col("h.k").cast("long").alias("k")))), lambda x: x["k"]).alias("n"))
    running = F.transform("n", lambda x, i: F.aggregate(F.slice("n", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    return by_source.select("key", running.alias("bounds"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, levels: int = 3, block_words: int = 8192, cell_docs: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and draws for every row of docs, and the columns in carry.

    draws: array of (pass, first, words, shard): the mix takes `words` words of the document from word `first` (from 0) on
    into the shard; a document that a shard's edge falls into has a draw for each side of it. A source of target T goes
    floor(T / size) times through all of its documents, and once more as far as T reaches, so no document is taken more
    than twice and each source's words miss its target by less than one word. A shard has 8192 words (`block_words`) of a
    source for each block that the tree gave it; only the last block of a source may be short.

    Null texts have size 0 and are never drawn; null sources are one source, the last. Rows that repeat an id are
    documents of their own. An empty table gives an empty result. Ids decide the order, so reruns agree. A very long
    text is one row like any other and may be drawn into several shards; other columns are ignored unless carried.
    """
    n_cells = max(1, docs.count() // cell_docs)
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(11)).alias("h"), *carry)
    base = base.withColumn("cell", F.pmod("h", F.lit(n_cells))).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    if not carry:
        base = stored(base, "mixing")  # a few numbers a row; with whole texts a second scan is cheaper
    cells = stored(base.groupBy("key", "source", "cell").agg(F.sum("size").alias("cell_size")), "mixing-cells")
    sources = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share)
    sources = sources.withColumn("quota", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("quota") / F.lit(block_words)).cast("long"))
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sources = stored(sources, "mixing-sources")
    bounds = split_quotas(sources.select("source", "blocks"), levels)
    places = running_before(cells, ["key"], "cell", "cell_size", "cell_at")
    places = places.join(sources.drop("source"), "key").join(bounds, "key").select("key", "cell", "cell_at", "source_size", "target", "quota", "bounds")
    inside = Window.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.join(places, ["key", "cell"]).withColumn("at", F.col("cell_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def part(number: int, shard: int) -> Column:
        """What of the document's words falls into a shard's stretch, in one pass through its source."""
        at = F.col("at") + number * F.col("source_size")
        low = F.lit(0).cast("long") if shard == 0 else F.element_at("bounds", shard) * block_words
        high = F.least(F.element_at("bounds", shard + 1) * block_words, "quota")
        first = F.greatest(low, at)
        return F.struct(F.lit(number).alias("pass"), (first - at).alias("first"), (F.least(high, at + F.col("size")) - first).alias("words"), F.lit(shard).alias("shard"))

    rows = rows.withColumn("draws", F.filter(F.array(*(part(k, s) for k in range(3) for s in range(2**levels))), lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *carry)


def words_between(text: Column, first: Column, n: Column) -> Column:
    """The text from its word `first` (from 0) on for n words, unchanged otherwise; what stands before the first word goes with it."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, (first + 1).cast("int"), n.cast("int")), "")


def mix(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix itself: the columns of docs, one row per draw, each shard shuffled by hash.

    A text that a shard's edge or the end of its source's quota falls into is cut there or, where whole is set, goes to
    the shard of its first word to its end: then no text is cut, and a source exceeds its target by less than one
    document. Other columns keep their values. Options and cases as in mix_plan().
    """
    renamed, names = set_aside(docs, ("doc_id", "source", "text"))
    others = tuple(c for c in names if c not in ("doc_id", "source"))
    plan = mix_plan(renamed, carry=others, **options)
    rows = plan.select("doc_id", "source", *others, "size", F.explode("draws").alias("d"))
    if whole:
        rows = rows.where("d.first = 0")
    else:
        rows = rows.withColumn("text", F.when(F.col("d.words") < F.col("size"), words_between(F.col("text"), F.col("d.first"), F.col("d.words"))).otherwise(F.col("text")))
    rows = rows.withColumn("n", F.xxhash64("doc_id", "d.pass", "d.first", F.lit(23)))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, F.col("d.shard"), F.pmod("n", F.lit(parts))).sortWithinPartitions("d.shard", "n")
    return put_back(rows, names, docs.columns)
