"""Benchmark decontamination by Wu-Manber multi-pattern search.

A benchmark item's windows of consecutive words are the patterns, written " w1 w2 ... wn " so that they start and end at
words. Patterns of like length form one search: over the first m bytes of each (m: the shortest one's length) a table
says how far the search may move on when it meets a block of bytes; where it may not move, a bucket of the block's hash
selects patterns, and these are compared byte by byte. The search runs over all texts of an Arrow batch at once: each
lane is a stretch of text with a position of its own, and numpy moves all lanes together by their shifts.

Patterns live in tasks as a broadcast. Windows are made and counted in Spark first: at most `most_windows` pairs of window and item go out
at once (about 400 bytes each in a task with their tables, besides 15 MB of shift tables), and more are searched for in more passes over
the texts, dealt by hash, so that neither long nor many items outgrow a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, schema_of, ship, stored, with_text

#: A-Z to a-z; what is neither a digit nor a letter nor beyond ASCII to a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
LANE = 2048


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows_of(text: str | None, width: int) -> Iterator[bytes]:
    """All runs of width words, or the whole text if it has fewer; none if it has no word."""
    w = words_of(text)
    for at in range(max(1, len(w) - width + 1) if w else 0):
        yield b" " + b" ".join(w[at : at + width]) + b" "


@dataclass
class Search:
    """One Wu-Manber search: patterns of at least m bytes."""

    m: int
    block: int
    shift: np.ndarray  # by block hash
    buckets: dict[int, dict[int, dict[bytes, int]]]  # block hash, pattern length: pattern numbers


class Patterns:
    """Windows and their items, as Wu-Manber tables."""

    def __init__(self, windows: Iterable[tuple[bytes, str]], bits: int = 20):
        self.mask, owners = (1 << bits) - 1, defaultdict(set)
        for window, item in windows:
            owners[bytes(window)].add(item)
        self.texts = sorted(owners)
        self.items = [frozenset(owners[t]) for t in self.texts]
        self.words = [t.count(b" ") - 1 for t in self.texts]
        by_length = defaultdict(list)
        for number, t in enumerate(self.texts):
            by_length[min(len(t).bit_length(), 6)].append((t, number))  # 3, 4-7, 8-15, 16-31, 32 and more bytes
        self.searches = [self._tables(group) for _, group in sorted(by_length.items())]

    def hashes(self, a: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        """Hash of the block of bytes that ends before each position."""
        h = np.zeros(len(at), np.uint64)
        for k in range(block, 0, -1):
            h = h * np.uint64(1099511628211) + a[at - k] + np.uint64(1)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(self.mask)).astype(np.int64)

    def _tables(self, group: list[tuple[bytes, int]]) -> Search:
        m = min(len(t) for t, _ in group)
        block = min(8, max(2, m // 2))
        heads = np.frombuffer(b"".join(t[:m] for t, _ in group), np.uint8).astype(np.uint64)
        shift, base = np.full(self.mask + 1, m - block + 1, np.int16), np.arange(len(group)) * m
        for end in range(block, m + 1):
            np.minimum.at(shift, self.hashes(heads, base + end, block), np.int16(m - end))
        buckets: dict[int, dict[int, dict[bytes, int]]] = {}
        for (t, number), h in zip(group, self.hashes(heads, base + m, block).tolist(), strict=True):
            buckets.setdefault(h, {}).setdefault(len(t), {})[t] = number
        return Search(m, block, shift, buckets)

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text, (byte offset, pattern number) of all occurrences."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not texts or not self.searches:
            return found
        whole = b"".join(texts)
        a = np.frombuffer(whole, np.uint8).astype(np.uint64)
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        for s in self.searches:
            lanes = np.maximum(0, -(-(size - s.m + 1) // LANE))
            text_of = np.repeat(np.arange(len(texts)), lanes)
            k = np.arange(len(text_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            pos = first[text_of] + k * LANE + s.m  # ends of the m bytes looked at
            stop = np.minimum(first[text_of] + (k + 1) * LANE + s.m, first[text_of] + size[text_of] + 1)
            live = np.arange(len(pos))
            while len(live):
                h = self.hashes(a, pos[live], s.block)
                step = s.shift[h].astype(np.int64)
                for i in np.flatnonzero(step == 0).tolist():
                    lane = live[i]
                    t, at = text_of[lane], int(pos[lane]) - s.m
                    room = int(first[t] + size[t]) - at
                    # patterns that begin alike share a bucket: those of one length are compared with the text in one step
                    for length, patterns in s.buckets.get(int(h[i]), {}).items():
                        if length <= room and (number := patterns.get(whole[at : at + length])) is not None:
                            found[t].append((at - int(first[t]), number))
                pos[live] += np.maximum(step, 1)
                live = live[pos[live] < stop[live]]
        return found

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the merged word ranges [from, to) that are hit, the items found."""
        split = [words_of(t) for t in texts]
        normal = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
        out = []
        for w, text, found in zip(split, normal, self.find(normal), strict=True):
            ranges: list[tuple[int, int]] = []
            items: set[str] = set()
            if found:
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                starts = np.searchsorted(spaces, [at for at, _ in found]).tolist()
                for a, n in sorted((a, self.words[number]) for a, (_, number) in zip(starts, found, strict=True)):
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(ranges[-1][1], a + n))
                    else:
                        ranges.append((a, a + n))
                for _, number in found:
                    items |= self.items[number]
            out.append((len(w), ranges, items))
        return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def windows(benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The different (window, item) pairs of a benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        names: list[str] = []
        for batch in batches:
            for item, t in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for window in windows_of(t, width):
                    held.append(window)
                    names.append(item)
                    if len(held) == 10000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(names, pa.string())], ["window", "item"])
                        held, names = [], []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(names, pa.string())], ["window", "item"])

    ship(benchmark.sparkSession)
    return items.mapInArrow(run, "window binary, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str], width: int = 10, text: str = "text", item_id: str = "item_id", most_windows: int = 50_000) -> DataFrame:
    """keys, n_words, hits (array of word ranges), items (sorted array of item ids as strings) for every row of docs.

    A window is `width` consecutive words of an item, or all its words if it has fewer; an item without words, or with a
    null text, has none. A null item id counts as the item named by the empty string; rows that repeat an id are one
    item. A null document has no words. Equal windows of several items count for each of them. An empty benchmark hits
    nothing, an empty table gives an empty result. Very long texts are searched in lanes like all others, very long items
    are windows like any other; columns of docs that are not in keys are ignored.
    """
    bench = stored(windows(benchmark, width, "text", item_id), "windows")
    passes = -(-bench.count() // most_windows) or 1
    now, own = with_text(docs, keys, text)
    carried, extra = schema_of(now, keys), [] if own in keys else [own]
    for k in range(passes):
        group = bench.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k) if passes > 1 else bench
        shared = docs.sparkSession.sparkContext.broadcast(Patterns((r["window"], r["item"]) for r in group.toLocalIterator()))
        last, again = k == passes - 1, k > 0

        def run(batch: pa.RecordBatch, shared=shared, last=last, again=again) -> pa.RecordBatch:
            got = shared.value.hits(batch.column(own).to_pylist())
            ranges, items = [x[1] for x in got], [x[2] for x in got]
            if again:
                ranges = [_merged(x + [(r["a"], r["b"]) for r in y]) for x, y in zip(ranges, batch.column("hits").to_pylist(), strict=True)]
                items = [x | set(y) for x, y in zip(items, batch.column("items").to_pylist(), strict=True)]
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            cols = [*(batch.column(c) for c in keys), *([] if last else [batch.column(x) for x in extra]), pa.array([x[0] for x in got], pa.int64())]
            cols += [pa.array([[{"a": a, "b": b} for a, b in x] for x in ranges], span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, [*keys, *([] if last else extra), "n_words", "hits", "items"])

        schema = carried + ("" if last or not extra else ", __text string") + ", n_words long, hits array<struct<a: long, b: long>>, items array<string>"
        now = arrow_map(now.select(*keys, *extra, *(["hits", "items"] if again else [])), run, schema, own)
        if not last:
            now = stored(now, "decontam")  # one pass's tables in memory at a time
    return now
