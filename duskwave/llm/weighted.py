"""Document fingerprints by consistent weighted sampling.

A text is its bag of words, each weighing as often as it occurs. For a word and a sample number k a hash of both gives r and c
from Gamma(2, 1) and b from U(0, 1), the same in every document. With weight S the word's level is t = floor(ln S / r + b) and its
cost ln c - r (t - b) - r; the cheapest word of a document, at its level, is the k-th sample. Two documents agree in a sample with a
probability that is their generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger ones,
so the share of samples in which two fingerprints agree estimates it, with a standard error of at most 0.045 for 128 samples.

A fingerprint keeps the least cost of each sample as a 32-bit float: it is the same number for the same word and level, and that
of others but by chance (some 5 in 10 million). Costs of a word at a weight don't depend on the document, so a task keeps those
of a bounded number of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, schema_of, ship, text_slices, with_text

SAMPLES = 128
#: Hexadecimal digits of a sample in a fingerprint.
DIGITS = 8
HALF = np.float32(0.5)
#: A-Z to a-z; what is neither a digit nor a letter nor beyond ASCII to a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL) if text else b""


def word_counts(text: str | None) -> Counter[bytes]:
    """Words (runs of digits, letters and characters beyond ASCII, A-Z in lower case) and how often each occurs."""
    return Counter(normal(text).split())


def scrambled(x: np.ndarray) -> np.ndarray:
    """32 well mixed bits for each number, in place (the finaliser of MurmurHash3)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x


class Sampler:
    """Fingerprints of weighted bags; holds the costs of at most `most` pairs of word and weight (0.5 KB each at 128 samples)."""

    def __init__(self, samples: int = SAMPLES, most: int = 1 << 17, at_once: int = 4096):
        self.samples, self.most, self.at_once = samples, max(most, 2 * at_once), at_once
        self.place: dict[bytes, int] = {}
        self.held, self.used = np.empty((0, samples), np.float32), np.zeros(self.most, bool)

    def costs(self, words: list[bytes], weights: list[float]) -> np.ndarray:
        """The cost of each word at its weight, for every sample. Three hashes: two halves for r, two for c, one for b."""
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        low, high = ((h >> np.uint64(bits)).astype(np.uint32)[:, None] for bits in (0, 32))
        seeds = (scrambled(low + np.arange(3, dtype=np.uint32) * np.uint32(0x85157AF5)) ^ high)[:, :, None]
        x = scrambled(seeds + np.arange(1, self.samples + 1, dtype=np.uint32) * np.uint32(0x9E3779B9))
        two = ((x[:, :2] & np.uint32(0xFFFF)).astype(np.float32) + HALF) * ((x[:, :2] >> np.uint32(16)).astype(np.float32) + HALF)
        gamma = -np.log(two * np.float32(2.0**-32))
        r, b = gamma[:, 0], ((x[:, 2] >> np.uint32(8)).astype(np.float32) + HALF) * np.float32(2.0**-24)
        cost = np.log(gamma[:, 1]) - r
        some = [i for i, s in enumerate(weights) if s != 1]  # the level of weight 1 is 0
        s = np.log(np.array([weights[i] for i in some], np.float32))[:, None]
        level = np.floor(s / r[some] + b[some])
        b[some] -= level
        return cost + r * b

    def places(self, words: list[bytes], weights: list[float]) -> np.ndarray:
        """Where the costs of up to at_once words at their weights stand; those of all others may go to make room."""
        keys = [w if s == 1 else b"%b %r" % (w, s) for w, s in zip(words, weights, strict=True)]
        found = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        if len(self.place) + (found < 0).sum() > self.most:
            self.make_room()
            found = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(found < 0).tolist()
        self.used[found[found >= 0]] = True
        if new:
            first, room = len(self.place), len(self.held)
            if first + len(new) > room:
                self.held = np.concatenate((self.held, np.empty((min(self.most, max(2 * room, first + len(new), self.at_once)) - room, self.samples), np.float32)))
            for k, i in enumerate(new):
                self.place[keys[i]] = first + k
            for at in range(0, len(new), 128):
                some = new[at : at + 128]
                self.held[first + at : first + at + len(some)] = self.costs([words[i] for i in some], [weights[i] for i in some])
            found[new] = np.arange(first, first + len(new))
        return found

    def make_room(self) -> None:
        """Forgets what was not asked for again since the last time; everything if that leaves more than half."""
        names, keep = list(self.place), np.flatnonzero(self.used[: len(self.place)])
        keep = keep if 2 * len(keep) <= self.most - self.at_once else keep[:0]
        self.place = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.held[: len(keep)] = self.held[keep]
        self.used[:] = False

    def sample(self, weights: Mapping[bytes, float]) -> np.ndarray:
        """The least cost of each sample; infinite for an empty bag. Weights are positive."""
        best, words, sizes = np.full(self.samples, np.inf, np.float32), list(weights), list(weights.values())
        for at in range(0, len(words), self.at_once):
            own = self.places(words[at : at + self.at_once], sizes[at : at + self.at_once])
            np.minimum(best, self.held[own].min(axis=0), out=best)
        return best

    def fingerprint(self, text: str | None) -> np.ndarray:
        return self.sample(word_counts(text))

    def fingerprints_of_edit(self, text: str, cut: int, end: str) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of text, and of text with `end` in place of its last `cut` code points; words that weigh the same in both are looked up once."""
        head = normal(text[: len(text) - cut])
        whole, begun = head[: (at := head.rfind(b" ") + 1)], head[at:]
        both, old, new = Counter(whole.split()), Counter((begun + normal(text[len(text) - cut :])).split()), Counter((begun + normal(end)).split())
        changed = old.keys() | new.keys()
        same = self.sample({w: n for w, n in both.items() if w not in changed})
        own, other = (self.sample({w: n for w in changed if (n := both[w] + x[w])}) for x in (old, new))
        return np.minimum(same, own), np.minimum(same, other)


def written(costs: np.ndarray) -> str:
    """A fingerprint as text: the bits of each sample as DIGITS hexadecimal digits."""
    return costs.astype(">f4").tobytes().hex()


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two written fingerprints agree."""
    part = lambda c, i: F.substring(c, i * F.lit(DIGITS) + F.lit(1), F.lit(DIGITS))
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: part(a, i) == part(b, i))
    return F.size(same) / F.lit(float(samples))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint of every row. A text that is null or has no word has infinite costs, like no other one but its kind."""
    picked, own = with_text(docs, keys, text)
    sampler: list[Sampler] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not sampler:
            sampler.append(Sampler(samples))
        prints = [written(sampler[0].fingerprint(t)) for t in batch.column(own).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(prints, pa.string())], [*keys, "fingerprint"])

    return arrow_map(picked, run, schema_of(picked, keys) + ", fingerprint string", own)


def in_stretches(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """rows, dealt in stretches of their descending order by keys (nulls last), with the columns stretch and ahead.

    Each stretch ends with a copy of the first row of the next one (after the last: of the first), marked by ahead, so that every row's
    follower is in its own partition. Only the keys are ordered as a whole; their `parts` largest ones by stretch pass through the driver.
    """
    key = F.struct(*keys)
    largest = rows.select(key.alias("k")).repartitionByRange(parts, F.desc("k")).groupBy(F.spark_partition_id()).agg(F.max("k").alias("k"))
    first = [r["k"] for r in largest.select("k").orderBy(F.desc("k")).collect()]
    if not first:
        return rows.select("*", F.lit(0).alias("stretch"), F.lit(False).alias("ahead"))
    kinds = dict(rows.dtypes)
    firsts = F.array(*(F.struct(*(F.lit(f[k]).cast(kinds[k]).alias(k) for k in keys)) for f in first))
    # how many of the descending list are not below the row, by halving
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(first).bit_length()))))
    above = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(first)) & (F.get(firsts, n + s - 1) >= key), n + s).otherwise(n))
    rows = rows.withColumn("stretch", above - 1)
    home = F.struct(F.col("stretch"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("stretch") - 1, F.lit(len(first))).alias("stretch"), F.lit(True).alias("ahead"))
    homes = F.when(F.get(firsts, F.col("stretch")) == key, F.array(home, before)).otherwise(F.array(home))
    dealt = rows.withColumn("home", F.explode(homes)).withColumns({"stretch": F.col("home.stretch"), "ahead": F.col("home.ahead")}).drop("home")
    return dealt.repartition("stretch").sortWithinPartitions("stretch", "ahead", *map(F.desc, keys))


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 3, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document of a row is the one after it in descending order of the ids, the first one after the last. The edited text has in
    place of the last floor(n_chars / share) code points the first as many of the next document, or all it has. near_edited and
    near_next are the likeness of the row's fingerprint to that of its edited text and of the next document.

    A null text is empty. Null ids come last; rows of one id go by a hash of their texts. A single document follows itself. Other columns
    of docs are ignored. An empty table gives an empty result. Words of a very long text are looked up in slices.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = in_stretches(rows, ["doc_id", "tie"], 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row waits for the text of its follower, and then for the follower's fingerprint
        sampler, held, done = Sampler(samples), None, None
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out: list[tuple] = []
                ids: list[pa.Array] = []

                def finish(following: np.ndarray) -> None:
                    own_id, size, changed, own, other = done  # noqa: B023
                    ids.append(own_id)  # noqa: B023
                    out.append((size, changed, written(own), written(other), float((own == other).mean()), float((own == following).mean())))  # noqa: B023

                for i, (t, ahead) in enumerate(zip(batch.column("text").to_pylist(), batch.column("ahead").to_pylist(), strict=True)):
                    if held is not None:
                        own_id, text_ = held
                        cut = len(text_) // share
                        own, other = sampler.fingerprints_of_edit(text_, cut, t[:cut])
                        if done is not None:
                            finish(own)
                        done = (own_id, len(text_), text_[: len(text_) - cut] + t[:cut], own, other)
                    if ahead and done is not None:
                        finish(sampler.fingerprint(t))
                        done = None
                    held = None if ahead else (batch.column("doc_id").slice(i, 1), t)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True))], names)

    ship(spark)
    found = dealt.select("doc_id", "text", "ahead")
    return found.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
