"""Ranked lexical search by NRA over impact-sorted lists.

The documents are cut into shards. Each shard keeps, for every term that is asked for, a list of its documents sorted by what the term
adds to their score, largest first. A question reads its terms' lists from the top, block by block, and never looks a document up: of each
document that it has met it knows a lower bound (what it has read) and an upper bound (that and the next value of every list in which it
has not met the document). It ends when no document outside the first k can still reach the k-th score, not even as a tie, and
the bounds of all that can be among them have met. A list is read on only while it can change that. Each shard's first k are
exact, so the first k of all shards together are those of the corpus; nothing else is shuffled.

Questions go to all tasks in groups of a counted number of terms, one search over the documents for each group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, ship, stored

#: A-Z to a-z; what is neither a digit nor a letter nor beyond ASCII to a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of weight w adds to the score of a document of n terms in which it occurs tf times; whole numbers throughout."""
    m = 100 - 50 + 50 * n * documents // max(length, 1)
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


@dataclass
class Lists:
    """Impact-sorted lists of one shard: those of term t are docs[starts[t] : starts[t + 1]]."""

    documents: int
    starts: np.ndarray
    docs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, documents: int, terms: int, term: np.ndarray, doc: np.ndarray, value: np.ndarray) -> Lists:
        term, doc, value = (x[value > 0] for x in (term, doc, value))
        order = np.lexsort((doc, -value, term))
        return cls(documents, np.searchsorted(term[order], np.arange(terms + 1)), doc[order], value[order])


def search(lists: Lists, terms: np.ndarray, k: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The k documents with the largest sums over these terms, ties to the smaller number, and the sums."""
    terms = terms[lists.starts[terms] < lists.starts[terms + 1]]
    start, end = lists.starts[terms], lists.starts[terms + 1]
    at, read = start.copy(), lambda t: lists.docs[start[t] : at[t]]
    lower, ahead = np.zeros(lists.documents, np.int64), lists.values[start]  # the next value of each list, 0 at its end
    wanted = ahead > 0
    while wanted.any():
        for t in np.flatnonzero(wanted).tolist():
            some = slice(at[t], min(at[t] + block, end[t]))
            lower[lists.docs[some]] += lists.values[some]  # a document is in a list once
            at[t] = some.stop
            ahead[t] = lists.values[at[t]] if at[t] < end[t] else 0
        block *= 2
        open_ = np.flatnonzero(ahead).tolist()
        upper = np.where(lower > 0, lower + ahead.sum(), 0)
        for t in open_:
            upper[read(t)] -= ahead[t]
        met = np.count_nonzero(lower)
        limit = np.partition(lower, len(lower) - k)[len(lower) - k] if met >= k else 1
        if ahead.sum() >= limit:  # a document not met yet may be among the first k, if only by a tie
            wanted = ahead > 0
            continue
        alive = upper >= limit
        wanted = np.zeros(len(terms), bool)
        for t in open_:
            wanted[t] = np.count_nonzero(alive[read(t)]) < np.count_nonzero(alive)
    # what is still below its upper bound can't be among the first k
    found = np.flatnonzero(lower)
    found = found[np.lexsort((found, -lower[found]))[:k]]
    return found, lower[found]


@dataclass
class Questions:
    """A group of items: their ids, the numbers of each one's terms, and all terms' numbers."""

    ids: pa.Array
    terms: list[np.ndarray]
    number: dict[bytes, int]


def questions_of(group: DataFrame) -> Questions:
    """From rows (item_id, terms)."""
    rows = group.toArrow()
    number: dict[bytes, int] = {}
    terms = [np.array([number.setdefault(t, len(number)) for t in each], np.int64) for each in rows.column("terms").to_pylist()]
    return Questions(rows.column("item_id").combine_chunks(), terms, number)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and the different terms of every item that has any; rows that repeat an id are one item."""
    picked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(terms_of(t))) for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    found = arrow_map(picked, run, f"item_id {dict(picked.dtypes)['item_id']}, terms array<binary>", "t")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def forward_index(docs: DataFrame, number: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms of the document), terms and tf (the numbered terms that it holds, and how often)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(number)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, sizes, terms, times, ends = shared.value, [], [], [], [0]
        for t in batch.column("t").to_pylist():
            words = terms_of(t)
            counts = Counter(filter(known.__contains__, words))
            sizes.append(len(words))
            terms.extend(map(known.__getitem__, counts))
            times.extend(counts.values())
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return arrow_map(picked, run, f"doc_id {dict(picked.dtypes)['doc_id']}, n long, terms array<int>, tf array<int>", "t")


def first_of_shards(index: DataFrame, asked: Questions, item_kind: str, documents: int, length: int, holding: np.ndarray, k: int, most_postings: int) -> DataFrame:
    """item_id, doc_id, score, part: the first k of every shard of up to about most_postings entries."""
    weights = np.array([weight(documents, int(d)) if d else 0 for d in holding], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((asked, weights))
    kinds = dict(index.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= most_postings:
                    yield from answers(held)
                    held, size = [], 0
        if held:
            yield from answers(held)

    def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        rows = pa.Table.from_batches(held)
        # in the order of ids, so that ties between numbers are ties between ids
        rows = rows.take(pc.sort_indices(rows.column("doc_id"), null_placement="at_end")).combine_chunks()
        each = pc.list_value_length(rows.column("terms")).to_numpy()
        term, tf = (pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tf"))
        doc = np.repeat(np.arange(rows.num_rows), each)
        n = rows.column("n").to_numpy()
        lists = Lists.of(rows.num_rows, len(weights), term, doc, impacts(weights[term], tf, n[doc], documents, length))
        for i, terms in enumerate(asked.terms):
            found, scores = search(lists, terms, k)
            if len(found):
                ids = rows.column("doc_id").take(pa.array(found)).combine_chunks()
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(np.full(len(found), i))), ids, pa.array(scores)], ["item_id", "doc_id", "score"])

    ship(index.sparkSession)
    found = index.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tf").mapInArrow(run, f"item_id {item_kind}, doc_id {dict(index.dtypes)['doc_id']}, score long")
    return found.withColumn("part", F.floor(F.spark_partition_id() / 64))


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", most_terms: int = 200_000, most_postings: int = 1 << 22
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item the k documents with the highest scores above 0; equal scores by ascending doc_id.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in lower case. With N documents that hold a term, L terms in all, n terms in a
    document, df documents that hold a term and tf occurrences in the document, a term adds w * (10^9 tf div (1000 tf + 20 m)) where w =
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + 50 n N div L.

    A null text has no terms; an item without terms, or whose terms no document holds, has no rows. Rows that repeat an item's id are one item, rows
    that repeat a doc_id are documents of their own; null ids are ids like any other, of documents the last. Other columns are ignored. Empty
    tables give an empty result. Items go out in groups of about most_terms terms (100 bytes each in a task); an item is never divided.
    """
    asked = stored(item_terms(items, item_id, item_text), "questions")
    groups = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms))
    item_kind, found = dict(asked.dtypes)["item_id"], None
    for g in range(groups):
        group = questions_of(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g))
        index = stored(forward_index(docs, group.number, doc_id, text), "forward-index")
        documents, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        holding = np.zeros(len(group.number), np.int64)
        holding[held.column("term").to_numpy()] = held.column("df").to_numpy()
        one = first_of_shards(index, group, item_kind, documents, length, holding, k, most_postings)
        one = stored(one, "ranked") if groups > 1 else one
        found = one if found is None else found.unionByName(one)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # in two levels: a task meets the first k of 64 partitions of an item, then k for each 64 of these
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return placed.select("item_id", "rank", "doc_id", "score")
