"""Fingerprints by weighted sampling, phrases by partitions and ranked search: brute force, SQL and odd input."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from duskwave.llm import phrases, queries, ranked, weighted

from .test_operators import ODD, prose
from .test_queries import folder  # noqa: F401

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def jaccard(a, b):
    a, b = Counter(terms(a)), Counter(terms(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def docs_of(spark, rows, columns="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, columns)


def against_sql(spark, folder, name):  # noqa: F811
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, folder).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.schema.names)
    assert names == sorted(want.schema.names)
    rows = lambda t: Counter(zip(*(t.column(c).to_pylist() for c in names), strict=True))
    assert rows(got) == rows(want)
    return got


# fingerprints


def test_a_samples_costs_follow_their_definition():
    s = weighted.Sampler(samples=400)
    c = s.costs([b"word"] * 3, [1, 2, 40])
    # ln c - r (t - b) - r = ln c - r (1 - b) at weight 1, and r t lower at level t
    fall = c[0] - c
    assert (fall[1] >= 0).all() and (fall[2] >= fall[1] - 1e-5).all() and (fall[2] > 0).any()
    # the least of a unit bag's costs is ln of an exponential draw: P(cost > x) = exp(-e^x), so e^cost has mean 1 for each word
    alone = np.exp(weighted.Sampler(samples=4000).costs([b"x", b"y"], [1, 1]).astype(float)).mean(axis=1)
    assert np.abs(alone - 1).max() < 0.1
    heavy = np.exp(weighted.Sampler(samples=4000).costs([b"x"], [7]).astype(float)).mean()
    assert abs(heavy - 1 / 7) < 0.02


def test_collisions_estimate_generalised_jaccard():
    s = weighted.Sampler(samples=4096)
    r = random.Random(5)
    for _ in range(12):
        a = {b"%d" % i: r.choice([1, 1, 2, 5, 30, 0.25]) for i in range(r.randint(1, 60))}
        b = {w: r.choice([n, n, n * 2, r.random() + 0.01]) for w, n in a.items() if r.random() < 0.8} | {b"n%d" % i: 1 for i in range(r.randint(1, 10))}
        want = sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)
        assert abs((s.sample(a) == s.sample(b)).mean() - want) < 4.5 * (0.25 / 4096) ** 0.5


def test_what_is_held_does_not_matter():
    text = prose(3, 3000)
    small = weighted.Sampler(most=64, at_once=16)
    for other in (prose(i, 200) for i in range(5)):
        small.fingerprint(other)
    assert (small.fingerprint(text) == weighted.Sampler().fingerprint(text)).all()
    a, b = small.fingerprints_of_edit(text, 500, "New words. " * 9)
    assert (a == small.fingerprint(text)).all() and (b == small.fingerprint(text[:-500] + "New words. " * 9)).all()
    assert (small.fingerprint(None) == small.fingerprint(" .,")).all() and not (small.fingerprint("") == a).any()


def test_likeness_of_written_fingerprints(spark):
    rows = docs_of(spark, [(1, prose(1, 300), None), (2, prose(1, 280), None), (3, None, None), (4, "", None)])
    found = {r["doc_id"]: r["fingerprint"] for r in weighted.fingerprints(rows, ["doc_id"]).collect()}
    both = spark.createDataFrame([(found[a], found[b]) for a, b in ((1, 1), (1, 2), (1, 3), (3, 4))], "a string, b string")
    same, near, far, empty = (r[0] for r in both.select(weighted.likeness(both["a"], both["b"])).collect())
    assert (same, far, empty) == (1.0, 0.0, 1.0) and abs(near - jaccard(prose(1, 300), prose(1, 280))) < 0.2


def edited(rows):
    """For (id, text) rows without repeated ids: (id, edited text, next text)."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, follower) in zip(order, order[1:] + order[:1]):
        t, follower = t or "", follower or ""
        cut = len(t) // 3
        yield i, t, t[: len(t) - cut] + follower[:cut], follower


def test_op11(spark, folder):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    once = Counter(i for i, _ in rows)
    got = defaultdict(list)
    for r in queries.QUERIES["op11_weighted_fingerprints"](spark, folder).collect():
        got[r["doc_id"]].append(r)
    assert {i: len(x) for i, x in got.items()} == once
    s, near = weighted.Sampler(), []
    prints = lambda t: s.fingerprint(t)
    for i, t, changed, follower in edited(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        if once[i] > 1 or i == 6:
            continue  # of rows with one id either may be the first
        (r,) = got[i]
        a, b, c = prints(t), prints(changed), prints(follower)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (weighted.written(a), weighted.written(b))
        assert (r["near_edited"], r["near_next"]) == ((a == b).mean(), (a == c).mean())
        near.append((r["near_edited"] - jaccard(t, changed), r["near_next"] - jaccard(t, follower)))
    assert len(near) > 150 and np.abs(near).max() < 0.25 and np.abs(np.mean(near, axis=0)).max() < 0.02


@pytest.mark.parametrize("n", [0, 1, 2])
def test_op11_of_few_rows(spark, n):
    rows = [(k, f"text number {k} of few", "x") for k in range(n)]
    got = {r["doc_id"]: r for r in weighted.edited_likeness(docs_of(spark, rows, "doc_id long, text string, stretch string")).collect()}
    assert sorted(got) == list(range(n))
    for i, _, changed, _ in edited([r[:2] for r in rows]):
        assert got[i]["edited_text"] == changed


def test_op11_of_null_repeated_and_named_ids(spark):
    rows = [(None, f"null {k} text") for k in range(5)] + [("b", "same text here")] * 4 + [("c", None), ("a", "x" * 100_000 + " y")]
    got = weighted.edited_likeness(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    by = {r["doc_id"]: r for r in got}
    assert by["c"]["n_chars"] == 0 and by["c"]["edited_text"] == "" and by["c"]["near_edited"] == 1.0
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == "b") == 3  # three are followed by their like
    assert by["a"]["edited_text"].startswith("x" * 66_668 + "null")


# phrases


def brute_phrases(rows, longest=5):
    found, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        g = lang or "und"
        n[g] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, longest + 1):
                found[g].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found, n


def brute_collocations(rows, support, top, percent=100):
    found, n = brute_phrases(rows)
    out = set()
    for g, f in found.items():
        often = {p: a for p, a in f.items() if len(p) >= 2 and a >= support}
        longer = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        placed = []
        for p, a in often.items():
            if 100 * longer[p] >= percent * a:
                continue
            score, k = min((int(Fraction(1000 * a * n[g], f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            placed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(placed)[:top], 1):
            out.add((g, rank, p.decode(), -a, left, right, n[g], -score))
    return out


def prose_rows(seed=11, docs=120):
    r = random.Random(seed)
    words = ["a", "bb", "ccc", "d", "É", "e", "f"]
    chain = lambda: " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "!\t", "\n"]) for _ in range(r.randint(0, 60)))
    rows = [(i, chain() + (" New York City hall" if i % 2 else "; the big apple the big apple"), ["en", "de", None][i % 3 if i % 7 else 0]) for i in range(docs)]
    rows += [(1000 + k, t, "odd") for k, t in enumerate(ODD)] + [rows[4]] * 3
    return rows


@pytest.mark.parametrize(("support", "top", "percent", "most", "shards"), [(3, 2000, 100, 1 << 22, 32), (9, 7, 100, 50, 4), (5, 40, 80, 300, 1)])
def test_collocations_are_those_of_plain_counting(spark, support, top, percent, most, shards):
    rows = prose_rows()
    got = phrases.collocations(docs_of(spark, rows).repartition(5), support=support, top=top, percent=percent, most_words=most, shards=shards)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()} == brute_collocations([(t, x) for _, t, x in rows], support, top, percent)


def test_no_frequent_phrase_is_lost_and_few_are_reported(spark):
    rows = prose_rows(12, 400)
    found, _ = brute_phrases([(t, x) for _, t, x in rows])
    want = {(g, " ".join(p), a) for g, f in found.items() for p, a in f.items() if a >= 25}
    got, _ = phrases.frequent_phrases(docs_of(spark, rows), support=25, most_words=200)
    assert {tuple(r) for r in got.select("g", "phrase", "f").collect()} == want


def test_a_stretch_is_mined_completely():
    r = np.random.default_rng(3)
    sequence = r.integers(0, 6, 3000).astype(np.int32)
    want = defaultdict(Counter)
    for k, i in itertools.product(range(1, 5), range(3000)):
        if i + k <= 3000 and (sequence[i : i + k] != 0).all():
            want[k][tuple(sequence[i : i + k].tolist())] += 1
    got = {k: {tuple(sequence[p : p + k].tolist()) for p in at.tolist()} for k, at, _ in phrases.frequent_runs(sequence, 20, 4, 100)}
    assert all(want[k][tuple(sequence[p : p + k].tolist())] == n for k, at, times in phrases.frequent_runs(sequence, 20, 4) for p, n in zip(at.tolist(), times.tolist(), strict=True))
    assert got == {k: {p for p, a in c.items() if a >= 20} for k, c in want.items()}


def test_the_filter_never_stops_what_set_it(spark):
    h = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000)
    bloom = phrases.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"), bits=16)
    assert phrases.let_through(h.view(np.uint64), bloom).all()
    assert phrases.let_through(np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bloom).mean() < 0.05


def test_scores_beyond_64_bits(spark):
    # 1000 a n has 20 digits and more from some 10^8 words on; the arithmetic is tested on given counts
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(10**12, 10**14, 3 * 10**12, 7 * 10**12)], "f long, n long, l long, r long")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    above = ((F.lit(1000).cast("decimal(4,0)") * whole("f")).cast("decimal(23,0)") * whole("n")).cast("decimal(38,0)")
    got = big.select(above.alias("above"), (whole("l") * whole("r")).cast("decimal(38,0)").alias("below")).select(F.expr("above div below")).first()[0]
    assert got == 1000 * 10**12 * 10**14 // (21 * 10**24)


def test_op12_is_its_sql(spark, folder):  # noqa: F811
    assert against_sql(spark, folder, "op12_phrase_mining").num_rows > 5


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(None, None, None), (1, "", "x")]), support=1).count() == 0


# ranked search


def brute_ranked(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    for item, words in asked.items():
        scored = []
        for i, c in found:
            m = 50 + 50 * c.total() * n_docs // length if length else 50
            score = sum(ranked.weight(n_docs, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "most_terms", "most_postings"), [(50, 200_000, 1 << 22), (3, 5, 40), (7, 20, 1000)])
def test_ranked_is_a_full_scan(spark, k, most_terms, most_postings):
    docs = [(i, prose(i % 37, 5 + i % 50)) for i in range(150)] + [(200 + i, t) for i, t in enumerate(ODD)] + [(None, prose(2, 9)), (7, prose(7, 12))]
    items = [(i, prose(i, 6)) for i in range(12)] + [(20, "neverseen"), (21, None), (22, ""), (3, "É zwei"), (None, prose(5, 4))]
    got = ranked.ranked(docs_of(spark, [(*d, "x") for d in docs], "doc_id long, text string, terms string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k=k, most_terms=most_terms, most_postings=most_postings)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute_ranked(docs, items, k)


def test_search_reads_no_more_than_it_must():
    # two documents far above the rest: the long lists are not read to their ends
    n = 20_000
    doc = np.concatenate((np.arange(n), np.arange(n)))
    value = np.concatenate((np.r_[[9000, 8000], np.ones(n - 2, np.int64)], np.r_[[9000, 8000], np.ones(n - 2, np.int64)]))
    lists = ranked.Lists.of(n, 2, np.repeat([0, 1], n), doc, value)
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                touched.append(at.stop)
            return super().__getitem__(at)

    lists.values = lists.values.view(Watched)
    found, scores = ranked.search(lists, np.array([0, 1]), 2)
    assert found.tolist() == [0, 1] and scores.tolist() == [18000, 16000] and max(touched) < 2 * n and sum(touched) < n + 1000


def test_search_against_sums():
    r = np.random.default_rng(9)
    for _ in range(60):
        n, t = int(r.integers(1, 400)), int(r.integers(1, 9))
        held = r.random((t, n)) < r.random((t, 1))
        values = np.where(held, r.integers(0, 1 + int(r.integers(1, 40)), (t, n)), 0)
        term, doc = np.nonzero(held)
        lists = ranked.Lists.of(n, t, term, doc, values[term, doc])
        asked = np.flatnonzero(r.random(t) < 0.7)
        total, k = values[asked].sum(axis=0), int(r.integers(1, 60))
        order = np.lexsort((np.arange(n), -total))
        order = order[total[order] > 0][:k]
        found, scores = ranked.search(lists, asked, k, block=int(r.integers(1, 9)))
        assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


def test_op13_is_its_sql(spark, folder):  # noqa: F811
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text from read_parquet('{folder}/documents.parquet/*.parquet')")
    docs = con.sql("select * from documents").fetchall()
    got = against_sql(spark, folder, "op13_ranked_search")
    items = con.sql(f"select item_id, text from read_parquet('{folder}/benchmark.parquet/*.parquet')").fetchall()
    rows = Counter(zip(*(got.column(c).to_pylist() for c in ("item_id", "rank", "doc_id", "score")), strict=True))
    assert rows == brute_ranked(docs, items, 50) and len(rows) >= 50


def test_ranked_of_no_rows(spark):
    none, one = docs_of(spark, []), docs_of(spark, [(1, "a b", None)])
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert ranked.ranked(none, items).count() == 0 and ranked.ranked(one, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.ranked(one, items).select("item_id", "rank", "doc_id").collect()] == [("q", 1, 1)]
