"""Frequent phrases by partitions (SON), and how strongly their words belong together.

A phrase is a run of words inside a piece of text. Two readings of the corpus find all that occur often enough, per group (a language):

1. Texts are dealt into shards of about equal size, each of one group. A task turns its texts into one sequence of word numbers a group
   and mines every stretch of up to `most_words` of these completely: level by level, and a run of k words is only counted where
   both of its runs of k - 1 words are frequent. A stretch with a share of the group's words asks for the same share of the
   support, rounded up. What occurs often enough in the corpus does so in one stretch at least, so the union of what
   stretches report misses nothing. Stretches overlap by the longest phrase less one word, so no occurrence is lost at a cut. The counts
   that are reported bound a run's occurrences from above, and what can't reach the support is left out.
2. All these candidates are counted in all texts. Candidates set bits in a filter of fixed size, which goes to all tasks; a
   task counts exactly, and hands on, the runs that the filter lets through. What it lets through by chance is counted as exactly as
   the rest and has too few occurrences in the end.

A stretch of a group of n words asks for s * most_words / n occurrences: with support 100 and 16 million words a stretch, a group of 1.6 billion words
comes down to one occurrence. Beyond that every run is reported with its count, and the first reading alone has all counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

#: Ends of pieces.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, ends of pieces to full stops (which no word can hold), tabs to spaces.
NORMAL = bytes(0x2E if b in ENDS else 32 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WORD = r"[^ \t.,;:!?\n\x0B\f\r]+"
#: Bits of the filter: 8 MB. With two bits for each of a million candidates one run in a thousand passes by chance.
FILTER_BITS = 26


class Numbers(dict):
    """Numbers words in the order in which they come; 0 ends a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Held:
    """The words of one group that a task has read and not looked at yet."""

    def __init__(self, total: int):
        self.total, self.numbers, self.parts, self.size = total, Numbers(), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def take(self, overlap: int) -> tuple[list[bytes], np.ndarray, int]:
        """Words by number, the sequence, and how many of its positions are its own; the last `overlap` are kept for the next stretch."""
        words, sequence = list(self.numbers), np.concatenate(self.parts)
        rest = [words[i] for i in sequence[len(sequence) - min(overlap, len(sequence)) :]] if overlap else []
        self.numbers, self.parts, self.size = Numbers(), [], 0
        if rest:
            self.add(rest)
        return words, sequence, len(sequence) - len(rest)


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """text in parts of about size bytes that end at spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def stretches(batches: Iterator[pa.RecordBatch], most_words: int, overlap: int) -> Iterator[tuple[str, int, list[bytes], np.ndarray, int]]:
    """(group, its words in all, words by number, sequence, own positions) from rows (g, n, t); what is held stays below about most_words."""
    held: dict[str, Held] = {}
    size = 0
    for batch in batches:
        for i, (g, n) in enumerate(zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            text = (batch.column("t")[i].as_py() or b"").translate(NORMAL)
            own = held.setdefault(g, Held(n))
            for part in slices(text):
                before = own.size
                own.add(part.replace(b".", b" . ").split())
                size += own.size - before
                while size > most_words:
                    full = max(held, key=lambda x: held[x].size)
                    if held[full].size <= overlap:
                        break
                    found = held[full].take(overlap)
                    size -= found[2]
                    yield full, held[full].total, *found
            own.add([b"."])
            size += 1
    for g, own in held.items():
        if own.size:
            yield g, own.total, *own.take(0)


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different key its first place and how often it comes; and the number of each key."""
    _, first, number, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, number, times


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of numbers whose sizes add up to about `most`, or which are one number."""
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most, append=-1)) + 1
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)


def frequent_runs(sequence: np.ndarray, least: int, longest: int, at_once: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the starts of one occurrence of every run that occurs `least` times or more, and how often it does.

    Runs are counted by ranges of the runs that they begin with, so that temporaries have about at_once entries, or as many as one run's occurrences.
    """
    times = np.bincount(sequence)
    times[0] = 0
    number = np.cumsum(times >= least, dtype=np.int32) - 1
    run = np.where(times[sequence] >= least, number[sequence], -1).astype(np.int32)  # number of the frequent run that starts here
    first = np.full(int((times >= least).sum()), len(sequence), np.int64)
    np.minimum.at(first, run[at := np.flatnonzero(run >= 0)], at)
    yield 1, first, times[times >= least]
    for k in range(2, longest + 1):
        n = len(first)
        if not n:
            return
        longer, firsts, counts, found = np.full(len(sequence), -1, np.int32), [], [], 0
        for low, high in ranges(np.bincount(run[run >= 0], minlength=n), at_once):
            at = np.flatnonzero((run[:-1] >= low) & (run[:-1] < high) & (run[1:] >= 0))
            place, own, times = _count(run[at].astype(np.int64) * n + run[at + 1])
            keep = times >= least
            longer[at] = np.where(keep, np.cumsum(keep) - 1 + found, -1)[own]
            firsts.append(at[place[keep]])
            counts.append(times[keep])
            found += len(firsts[-1])
        run, first = longer, np.concatenate(firsts)
        yield k, first, np.concatenate(counts)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def run_hashes(group: str, hashes: np.ndarray, sequence: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the group and of the run of k words at each place."""
    h = np.full(len(at), xxhash.xxh64_intdigest(group.encode("utf-8", "surrogatepass")), np.uint64)
    for j in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[sequence[at + j]])
    return h


def _phrases(words: list[bytes], sequence: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    return pa.array([b" ".join(map(words.__getitem__, sequence[p : p + k].tolist())) for p in at.tolist()], pa.binary()).cast(pa.string())


def candidates(shards: DataFrame, support: int, longest: int, most_words: int) -> DataFrame:
    """g, phrase, h: what may occur `support` times, from what is frequent in a stretch at the stretch's share of the support.

    A stretch that asks for t occurrences and does not report a run has t - 1 of it at most, so what all stretches report, and t - 1 for each of the
    others, bounds a run's occurrences: runs that can't reach the support are not counted again. shards has g, n (words of the group) and t (bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda group, p, h, over: pa.RecordBatch.from_arrays([pa.array([group] * len(p), pa.string()), p, pa.array(h, pa.int64()), pa.array(over, pa.int64())], ["g", "phrase", "h", "over"])
        for group, total, words, sequence, own in stretches(batches, most_words, longest - 1):
            least = max(1, -(-support * int(np.count_nonzero(sequence[:own])) // max(total, 1)))
            hashes = word_hashes(words)
            yield rows(group, pa.nulls(1, pa.string()), [0], [least - 1])
            for k, at, times in frequent_runs(sequence, least, longest):
                for i in range(0, len(at), 50_000):
                    part = at[i : i + 50_000]
                    yield rows(group, _phrases(words, sequence, part, k), run_hashes(group, hashes, sequence, part, k).view(np.int64), times[i : i + 50_000] - (least - 1))

    ship(shards.sparkSession)
    found = shards.select("g", "n", "t").mapInArrow(run, "g string, phrase string, h long, over long").groupBy("g", "phrase").agg(F.max("h").alias("h"), F.sum("over").alias("over"))
    found = stored(found, "phrase-reports")
    unseen = found.where(F.col("phrase").isNull()).select("g", F.col("over").alias("unseen"))
    return found.where(F.col("phrase").isNotNull()).join(unseen, "g").where(F.col("over") + F.col("unseen") >= support).select("g", "phrase", "h")


def filter_of(found: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """2^bits bits of which each h has set two: at most 2^(bits - 6) numbers reach the driver, however many rows there are."""
    spots = found.select(F.explode(F.array(*(F.shiftrightunsigned("h", by).bitwiseAND(F.lit((1 << bits) - 1)) for by in (0, bits)))).alias("p"))
    cells = spots.groupBy(F.shiftright("p", 6).alias("c")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells.column("c").to_numpy()] = cells.column("b").to_numpy()
    return out.view(np.uint64)


def let_through(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(bloom).bit_length() + 5)
    ok = np.ones(len(h), bool)
    for by in (np.uint64(0), bits):
        p = (h >> by) & ((np.uint64(1) << bits) - np.uint64(1))
        ok &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def counted(shards: DataFrame, bloom: np.ndarray, longest: int, most_words: int) -> DataFrame:
    """g, phrase, f: occurrences in all texts of every run that the filter lets through together with all runs that it begins with."""
    shared = shards.sparkSession.sparkContext.broadcast(bloom)

    def counts(words: list[bytes], hashes: np.ndarray, group: str, sequence: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        number, h = sequence[at].astype(np.int64), run_hashes(group, hashes, sequence, at, 1)
        for k in range(1, longest + 1):
            ok = let_through(h, shared.value)
            at, number, h = at[ok], number[ok], h[ok]
            if not len(at):
                return
            first, own, times = _count(number)
            for i in range(0, len(first), 50_000):
                part = first[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(part), pa.string()), _phrases(words, sequence, at[part], k), pa.array(times[i : i + 50_000], pa.int64())], ["g", "phrase", "f"])
            more = at + k < len(sequence)
            more[more] = sequence[at[more] + k] != 0
            at, h, following = at[more], h[more], sequence[at[more] + k]
            number = own[more] * len(words) + following
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashes[following])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, words, sequence, own in stretches(batches, most_words, longest - 1):
            hashes = word_hashes(words)
            # all runs that begin with a word are counted in one step
            for low, high in ranges(np.bincount(sequence[:own], minlength=1), 1 << 20):
                yield from counts(words, hashes, group, sequence, np.flatnonzero((sequence[:own] >= max(low, 1)) & (sequence[:own] < high)))

    ship(shards.sparkSession)
    return shards.select("g", "n", "t").mapInArrow(run, "g string, phrase string, f long").groupBy("g", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(
    docs: DataFrame, support: int = 100, longest: int = 5, group: str = "lang", text: str = "text", doc_id: str = "doc_id", most_words: int = 1 << 24, shards: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(g, phrase, f) of all phrases of up to `longest` words that occur `support` times or more in their group, and (g, n), the groups' words.

    A null group is "und", a null text is empty. Phrases are lower-cased (A-Z), their words joined by a space. Shards have about
    equally many words: the corpus has about `shards` of them, or as many as keep them below most_words. The id only deals texts out, so that copies
    of a text go to different shards.
    """
    named = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("g"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(*dict.fromkeys((doc_id, text))).alias("salt"))
    sizes = stored(named.groupBy("g").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n")), "phrase-words")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = min(most_words, max(total // shards, 1))
    rows = named.join(sizes, "g").select("g", "n", F.col("text").cast("binary").alias("t"), F.pmod("salt", F.greatest(F.ceil(F.col("n") / F.lit(each)), F.lit(1))).alias("shard"))
    dealt = rows.repartition("g", "shard")
    bloom = filter_of(candidates(dealt, support, longest, most_words))
    return stored(counted(dealt, bloom, longest, most_words).where(F.col("f") >= support), "phrases"), sizes


def _run(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, group: str = "lang", text: str = "text", doc_id: str = "doc_id", most_words: int = 1 << 24, shards: int = 8
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each group's `top` phrases of two to `longest` words by score, a and phrase.

    A phrase that occurs a times in its group's n words is cut after its first k words into parts that occur l and r times; it
    scores floor(1000 a n / (l r)) at its lowest-scoring cut, at the first of these. A phrase goes if its words lie inside a longer
    frequent phrase that occurs at least percent / 100 as often, whether or not that one stays. Numbers are exact as long as
    1000 a n and l r have up to 38 digits.

    A null group is "und", a null text is empty; repeated rows count as often as they come; other columns are ignored. An empty table, or one
    without frequent phrases, gives an empty result. Texts of any length are read in slices.
    """
    phrases, sizes = frequent_phrases(docs, support, longest, group, text, doc_id, most_words, shards)
    split = phrases.withColumn("w", F.split("phrase", " "))
    long = split.withColumn("k", F.size("w")).where(F.col("k") >= 2)
    cut = long.select("g", "phrase", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("g", "phrase", "f", "at", _run(F.col("w"), F.lit(1), F.col("at")).alias("first"), _run(F.col("w"), F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    for name, own in (("first", "l"), ("rest", "r")):
        cut = cut.join(phrases.select("g", F.col("phrase").alias(name), F.col("f").alias(own)), ["g", name])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * whole("f")).cast("decimal(23,0)") * whole("n")
    cut = cut.join(sizes, "g").withColumn("above", above.cast("decimal(38,0)")).withColumn("below", (whole("l") * whole("r")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("above div below"))
    best = cut.groupBy("g", "phrase").agg(F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "at", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _run(F.col("w"), i, m))))
    inside = long.where(F.col("k") > 2).select("g", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("g", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["g", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < F.lit(percent) * F.col("a")))
    rows = kept.select(F.col("g").alias("lang"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a group's places in two levels, so that no task gets more than `top` rows of each of sixteen parts
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    near = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
