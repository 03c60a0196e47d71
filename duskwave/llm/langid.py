"""Language identification by error-correcting output codes.

Every language has a codeword. One binary n-gram classifier per bit says on which side of the bit's language split a
text lies; decoding sums a loss per bit, weighted by how well the bit separates, and takes the nearest codeword.

Training counts are gathered over all labelled rows, so nothing is sampled: each task folds its texts into a table of
(language, bucket) counts, Spark adds these up, and only languages x buckets numbers reach the driver (64 KB a language: 4 MB
for the 60 languages of a large web corpus, and 64 MB if a dirty label column names a thousand).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, schema_of, ship, text_slices, with_text

UND = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 13  # hashed n-grams
    orders: int = 3  # 1- to 3-grams of letters and word gaps
    exhaustive_upto: int = 6  # languages that get the exhaustive code; more get a random dense one
    smoothing: float = 0.5
    sharpness: float = 6.0  # of the losses, and of the score
    ambiguous_below: float = 0.15  # weighted loss between the two nearest codewords


@functools.cache
def letter_table() -> np.ndarray:
    """Is this code point a letter? By rule, from Python's Unicode data."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str, s: Settings) -> np.ndarray | None:
    """Counts of hashed letter n-grams of the whole text; None if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[cp]
    if not is_letter.any():
        return None
    cp = np.where(is_letter, cp, 32).astype(np.uint64)
    gap_before = np.concatenate(([False], ~is_letter[:-1]))
    cp = cp[is_letter | ~gap_before]  # runs of other characters count as one gap
    cp = np.concatenate((np.array([32], np.uint64), cp, np.array([32], np.uint64)))
    shift = np.uint64(64 - int(s.buckets).bit_length() + 1)
    mixer, total, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(s.buckets, np.int64), None
    for n in range(1, s.orders + 1):
        h = cp + np.uint64(1) if h is None else h[:-1] * np.uint64(1114112) + cp[n - 1 :] + np.uint64(1)
        if len(h) == 0:
            break
        total += np.bincount(((h + np.uint64(n)) * mixer) >> shift, minlength=s.buckets)
    return total


def codewords(k: int, s: Settings) -> np.ndarray:
    """k x bits matrix of -1/+1: all splits of the languages, or a seeded random dense code when those are too many."""
    if k <= 1:
        return np.ones((k, 0), np.float32)
    if k <= s.exhaustive_upto:
        splits = np.arange(1, 2 ** (k - 1))
        bits = (splits[None, :] >> np.arange(k)[:, None]) & 1
        return (2.0 * bits - 1).astype(np.float32)
    rng, width, best, far = np.random.default_rng(k), int(np.ceil(12 * np.log2(k))), None, -1
    for _ in range(40):
        code = rng.choice(np.array([-1.0, 1.0], np.float32), size=(k, width))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * 10**6).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # bits
    trust: np.ndarray  # bits; adds up to 1
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1 and whether the two nearest codewords are about as near."""
        counts = gram_counts(text, self.settings) if text else None
        if counts is None or not self.langs:
            return UND, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = (counts.astype(np.float32) @ self.weights) / counts.sum() / self.scale
        loss = np.logaddexp(0, -self.settings.sharpness * self.code * margin) @ self.trust
        near = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        second = np.partition(loss, 1)[1]
        return self.langs[best], float(near[best] / near.sum()), bool(second - loss[best] < self.settings.ambiguous_below)


def fit_counts(counts: dict[str, np.ndarray], s: Settings = Settings()) -> Model:
    """The bit classifiers from n-gram counts by language: each language weighs the same on its side of a bit."""
    langs = sorted(counts)
    code = codewords(len(langs), s)
    if len(langs) <= 1:
        return Model(langs, code, np.zeros((s.buckets, 0), np.float32), np.ones(0), np.ones(0), s)
    share = np.stack([(counts[x] + s.smoothing) / (counts[x].sum() + s.smoothing * s.buckets) for x in langs])
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    side = lambda mask: (mask.T @ share) / mask.sum(axis=0)[:, None]
    weights = (np.log(side(plus)) - np.log(side(minus))).T
    expected = share @ weights  # the mean margin that each language gets
    right = np.maximum(code * expected, 0)
    scale = np.maximum(right.mean(axis=0), 1e-9)
    trust = np.maximum(right.min(axis=0) / scale, 0.05)
    return Model(langs, code, weights.astype(np.float32), scale.astype(np.float32), (trust / trust.sum()), s)


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", s: Settings = Settings()) -> Model:
    """Learns from the rows of docs where train holds and text and lang are not null.

    A null condition does not hold, so rows with a null id teach nothing where train asks for a part of the id. Texts without a letter
    teach nothing. Without any row to learn from the model has no language. Repeated rows count each time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    if (c := gram_counts(t, s)) is not None:
                        if name in sums:
                            sums[name] += c
                        else:
                            sums[name] = c
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    ship(docs.sparkSession)
    rows = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    table = np.zeros((len(names.dictionary), s.buckets))
    table[names.indices.to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return fit_counts(dict(zip(names.dictionary.to_pylist(), table, strict=True)), s)


def identify(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lang_pred, score, ambiguous for every row; whole texts, however long: their n-grams are counted in arrays of their length.

    Null texts and texts without a letter are `und` with score 0. Null ids and other null keys are returned as they are. Repeated rows get equal results; an empty table gives
    an empty result; a model without languages says `und` throughout.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits numbers
    picked, own = with_text(docs, keys, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column(own).to_pylist()]
        cols = [batch.column(k) for k in keys] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, [*keys, "lang_pred", "score", "ambiguous"])

    return arrow_map(picked, run, schema_of(picked, keys) + ", lang_pred string, score double, ambiguous boolean", own)


def part_of(doc_id: Column) -> Column:
    """The fold of a document, 0 to 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4
