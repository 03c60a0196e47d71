"""The ten registered queries on a fixture folder, each against a brute-force version or its SQL."""

import base64
import functools
import hashlib
import html.parser
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from duskwave.llm import common, langid, media, queries, secrets

from .test_operators import ODD, SYLLABLES, WORDS, brute_base, brute_contamination, brute_fingerprint, brute_lines, brute_targets, prose, speak

R = random.Random(77)
pick = lambda alphabet, n: "".join(R.choice(alphabet) for _ in range(n))
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
COMMON = "A line that is found in far more than five documents"


@functools.cache
def _documents():
    rows = [(i, speak(x, i) + (f"\n{COMMON}\nown {i}" if i % 3 == 0 else ""), x, ["web", "code", None, "é"][i % 4]) for i in range(120) for x in [list(SYLLABLES)[i % 3]]]
    rows += [(200 + i, t, None, "odd") for i, t in enumerate(ODD)]
    rows += [(300 + i, "copied text " * 20 + ("x" if i % 2 else ""), "en", "web") for i in range(12)]
    rows += [(400, "words " + prose(900, 24) + " more", "en", "web"), (401, prose(901, 3), "de", "code"), (None, "no id here", "en", None), (5, rows[5][1], "de", "web")]
    rows += [(500 + i, f"{prose(i, 300)} see {pick(B64, 44)} or {pick('0123456789ABCDEF', 40)} and AbstractSingletonProxyFactoryBean", None, "code") for i in range(20)]
    rows += [(600, 'password = "hunter2hunter2" AKIA' + "Z9" * 8 + " " + "0a" * 20, "en", "code"), (601, "line\n" * 30000 + COMMON, "en", "web")]
    return rows


def _pages():
    page = lambda k, own: f"<html><head><title>t</title></head><body><div>Menu of site {k}</div><div><p>{own}</p><p>A second one, {own}</p></div><div>Imprint &amp; more {k}</div></body></html>"
    rows = [(i, f"http://h{i % 3}.org/{i}", page(i % 3, f"Own words of page {i}")) for i in range(30)]
    rows += [(40 + i, f"http://m.org/{i}", f"<body><nav>Home</nav><article><h1>T{i}</h1><p>Text {i}</p></article><footer>F</footer></body>") for i in range(4)]
    return rows + [(50, "http://h0.org/copy", rows[0][2]), (51, None, None), (52, "http://lone.org/", "<div><p>Alone</p></div>"), (None, "http://h1.org/n", "<p>x</p>")]


BENCHMARK = [(1, prose(900, 24)), (2, prose(901, 3)), (3, None), (4, "never there at all")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(*r, None if r[1] is None else len(r[1]), "clash", 1) for r in _documents()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, hits string, part int").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, "clash") for r in _pages()], "page_id long, url string, html string, host string").repartition(3).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def run(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1_is_what_counting_strings_gives(spark, folder):
    s = langid.Settings()
    shift = 64 - s.buckets.bit_length() + 1

    def grams(text):
        letters = re.sub(r"[^\W\d_]+", lambda m: m[0], "".join(c if c.isalpha() else " " for c in text.lower()))
        padded, found = " " + re.sub(" +", " ", letters) + " ", Counter()
        for n in (1, 2, 3):
            for at in range(len(padded) - n + 1):
                h = 0
                for k, c in enumerate(padded[at : at + n]):
                    h = (ord(c) + 1) if k == 0 else (h * 1114112 + ord(c) + 1) % 2**64
                found[((h + n) * 0x9E3779B97F4A7C15 % 2**64) >> shift] += 1
        return found

    # a text that begins or ends with other characters has one gap there, so both gaps are one
    clean = lambda t: None if t is None or not any(c.isalpha() for c in t.lower()) else t
    per_lang = defaultdict(Counter)
    for i, t, x, _ in _documents():
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and x and clean(t):
            per_lang[x].update(Counter({b: int(n) for b, n in enumerate(langid.gram_counts(t, s)) if n}) if len(t) > 5000 else grams_of(t, grams))
    langs = sorted(per_lang)
    share = {x: {b: (per_lang[x][b] + 0.5) / (sum(per_lang[x].values()) + 0.5 * s.buckets) for b in range(s.buckets)} for x in langs}
    splits = [[1 if j >> i & 1 else -1 for i in range(len(langs))] for j in range(1, 2 ** (len(langs) - 1))]
    bits = []
    for split in splits:
        mean = lambda b, sign: sum(share[x][b] for x, v in zip(langs, split) if v == sign) / split.count(sign)  # noqa: B023, E731
        w = [math.log(mean(b, 1)) - math.log(mean(b, -1)) for b in range(s.buckets)]
        right = [max(0, v * sum(share[x][b] * w[b] for b in range(s.buckets))) for x, v in zip(langs, split)]
        scale = sum(right) / len(right)
        bits.append((split, w, scale, max(min(right) / scale, 0.05)))
    trust = sum(b[3] for b in bits)
    got = {(r["doc_id"], r["held_out"]): r for r in run(spark, folder, "op1_language_id") if r["doc_id"] != 5}
    for i, t, _, _ in _documents():
        if i == 5 or t and len(t) > 5000:
            continue
        r = got[(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
        if not clean(t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        counts = grams_of(t, grams)
        total = sum(counts.values())
        margins = [sum(n * w[b] for b, n in counts.items()) / total / scale for _, w, scale, _ in bits]
        loss = [sum(math.log1p(math.exp(-6 * split[k] * m)) * tr / trust for m, (split, _, _, tr) in zip(margins, bits)) for k in range(len(langs))]
        near = [math.exp(min(loss) - x) for x in loss]
        assert r["score"] == pytest.approx(max(near) / sum(near), abs=1e-4)
        assert r["lang_pred"] == langs[loss.index(min(loss))] or sorted(loss)[1] - min(loss) < 1e-4


def grams_of(text, grams):
    """Leading and trailing runs of other characters are a gap of their own beside the text's edge."""
    t = text.lower()
    before, after = not t[0].isalpha(), not t[-1].isalpha()
    if not before and not after:
        return grams(text)
    return Counter({b: int(n) for b, n in enumerate(langid.gram_counts(text, langid.Settings())) if n})


def test_op2(spark, folder):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run(spark, folder, "op2_line_dedup"))
    want = Counter()
    for (i, n, dropped, text), times in brute_lines([(i, t) for i, t, *_ in _documents()]).items():
        want[(i, n, dropped, sha(text))] += times
    assert got == want and sum(x[2] for x in want) > 30


def test_op3(spark, folder):
    def mulaw(c):
        c = ~c & 0xFF
        size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
        return -size if c & 128 else size

    def alaw(c):
        c ^= 0x55
        e, m = c >> 4 & 7, c & 15
        size = (m << 4) + 8 if e == 0 else (m << 4) + 0x108 << e - 1
        return size if c & 128 else -size

    steps = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]

    def adpcm(block):
        value, index = struct.unpack_from("<hB", block)
        index, out = min(index, 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                moved = (2 * (code & 7) + 1) * steps[index] >> 3
                value = max(-32768, min(32767, value - moved if code & 8 else value + moved))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
        return out

    def levels(x):
        return f"{int(math.isqrt(sum(v * v for v in x) // len(x)))},{max(map(abs, x))},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"

    got = Counter(tuple(r.values()) for r in run(spark, folder, "op3_telephony_media") if r["n_bytes"] < 5000)
    want = Counter()
    for i, t, *_ in _documents():
        raw = (t or "").encode()
        if len(raw) < 5000:
            p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            mu = [mulaw(c) for c in p]
            at = lambda k: mu[max(0, min(len(mu) - 1, k))]  # noqa: B023, E731
            double = [x for k in range(len(mu)) for x in (mu[k], max(-32768, min(32767, 9 * (at(k) + at(k + 1)) - at(k - 1) - at(k + 2) + 8 >> 4)))]
            crc = zlib.crc32(struct.pack(f"<{len(double)}h", *double))
            ad = [x for k in range(0, len(p), 64) for x in adpcm(p[k : k + 64])]
            feature = f"mulaw:{levels(mu)};alaw:{levels([alaw(c) for c in p])};adpcm:{levels(ad)};pcm16000:{crc:08x}"
            form = struct.pack("<HHIIHHH", 7, 1, 8000, 8000, 1, 8, 0)
            body = b"WAVEfmt " + struct.pack("<I", 18) + form + b"fact" + struct.pack("<II", 4, len(p)) + b"data" + struct.pack("<I", len(p)) + p
            file = b"RIFF" + struct.pack("<I", len(body)) + body
            want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature)] += 1
    assert got == want


def test_op3_stores_resampled_pcm_and_reads_it_back(spark, folder):
    def expand(c):
        c = ~c & 0xFF
        size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
        return -size if c & 128 else size

    table, root = [expand(c) for c in range(256)], common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    rows = run(spark, folder, "op3_telephony_media")
    new = [spark.read.parquet(f"{root}/{x}") for x in sorted(set(os.listdir(root)) - before)]
    [kept] = [x.collect() for x in new if "pcm" in x.columns]
    want = Counter()
    for i, t, *_ in _documents():
        raw = (t or "").encode()
        mu = [table[c] for c in raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))]
        x = [mu[0], *mu, mu[-1], mu[-1]]
        between = [max(-32768, min(32767, 9 * (b + c) - a - d + 8 >> 4)) for a, b, c, d in zip(x, x[1:], x[2:], x[3:])]
        want[(i, 16000, struct.pack(f"<{2 * len(mu)}h", *(v for p in zip(mu, between) for v in p)))] += 1
    assert Counter((r["doc_id"], r["rate"], bytes(r["pcm"])) for r in kept) == want
    assert Counter((r["doc_id"], int(r["feature"].rpartition(":")[2], 16)) for r in rows) == Counter((r["doc_id"], zlib.crc32(r["pcm"])) for r in kept)


def test_op3_holds_wav_files_of_one_part_beside_pcm(spark, folder, monkeypatch):
    parts, read = [], media.read_media
    monkeypatch.setattr(media, "read_media", lambda files, keys: parts.append([r["doc_id"] for r in files.collect()]) or read(files, keys))
    ids = Counter(r["doc_id"] for r in run(spark, folder, "op3_telephony_media"))
    assert Counter(i for x in parts for i in x) == ids == Counter(r[0] for r in _documents())
    assert max(map(len, parts)) < sum(map(len, parts)) / 2


def test_op3_disk(spark):
    root, table = common.shared_dir(spark).removeprefix("file:"), "/root/testdata/sf0.1/documents.parquet"
    before = set(os.listdir(root))
    queries.telephony_media(spark, os.path.dirname(table))
    new = [os.path.join(at, f) for x in set(os.listdir(root)) - before for at, _, names in os.walk(f"{root}/{x}") for f in names]
    assert 0 < sum(map(os.path.getsize, new)) < 1.5 * os.path.getsize(table)


def test_op4(spark, folder):
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run(spark, folder, "op4_benchmark_decontamination"))
    want = Counter()
    for (i, n, hit, items), times in brute_contamination([(i, t) for i, t, *_ in _documents()], BENCHMARK).items():
        want[(i, n, hit, len(items), sha(",".join(items)), hit > 0)] += times
    assert got == want and sum(x[5] for x in want) >= 2


class Tree(html.parser.HTMLParser):
    """A plain nested tree of well-formed pages: [name, children]."""

    def __init__(self, page):
        super().__init__()
        self.root = ["html", []]
        self.open = [self.root]
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag != "html":
            self.open[-1][1].append(e := [tag, []])
            self.open.append(e)

    def handle_endtag(self, tag):
        if tag != "html":
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def test_op5_against_nested_trees(spark, folder):
    """Only what the fixture's pages have: marked articles, nav, footer, head, div, p, h1."""
    pages = [(i, u, re.sub(r"^https?://([^/]+).*", r"\1", u or ""), h or "") for i, u, h in _pages()]
    key = lambda e: e.strip() if isinstance(e, str) else (e[0], tuple(key(c) for c in e[1] if isinstance(c, str) or c[0] != "title"))
    kind = {"nav", "footer", "head", "title"}

    def find(e, name):
        return e if e[0] == name else next((f for c in e[1] if not isinstance(c, str) for f in [find(c, name)] if f), None)

    def text(e, gone, inside, out):
        if isinstance(e, str):
            out[-1] += e
        elif e[0] not in kind and not ((key(e), inside) in gone and e[0] not in ("html", "body")):
            out.append("")
            for c in e[1]:
                text(c, gone, inside, out)
            out.append("")

    def main(page, gone):
        root = Tree(page).root
        out = [""]
        text(find(root, "article") or root, gone, True, out)
        return "\n".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in out) if x)

    def subtrees(e, inside, marked):
        if isinstance(e, str) or e[0] == "title":
            return
        inside = (inside or e[0] == "article") and e[0] not in kind
        if e[0] not in ("html", "body", "article") and not (marked and inside and e[0] != "div"):
            yield key(e), inside
        for c in e[1]:
            yield from subtrees(c, inside, marked)

    holders, bodies = defaultdict(set), defaultdict(set)
    for _, _, host, h in pages:
        root, body = Tree(h).root, main(h, set())
        bodies[host].add(body)
        marked = find(root, "article") is not None
        for k in subtrees(root, not marked, marked):
            holders[host, k].add(body)
    gone = defaultdict(set)
    for (host, k), b in holders.items():
        if len(b) >= 2 and (not k[1] or len(b) >= 0.2 * len(bodies[host])):
            gone[host].add(k)
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in run(spark, folder, "op5_html_extraction"))
    want = Counter()
    for i, u, host, h in pages:
        t = main(h, gone[host])
        want[(i, u, t, len(t))] += 1
    assert got == want
    assert main(pages[0][3], gone["h0.org"]) == "Own words of page 0\nA second one, Own words of page 0"


def test_op6_against_a_tree_of_exact_draws(spark, folder):
    docs = _documents()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in docs:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    block = 8192
    keys = sorted(("s" + s if s is not None else "", s) for s in sizes)
    u = {}
    for level in range(3):
        for key, _ in keys:
            for shard in range(2**level):
                u[key, shard, level] = spark.sql(f"select pmod(xxhash64('{key}', {shard}, {level}, 7), 1000000007) / 1000000007D").first()[0]
    nodes = {0: {k: math.ceil(round(want[s]) / block) for k, s in keys}}
    for level in range(3):
        split = {}
        for shard, held in nodes.items():
            total, left = sum(held.values()), {}
            n = (total + shard % 2) // 2
            for key, _ in keys:
                k, ways = held[key], math.comb(total, n)
                seen, got = 0.0, None
                for j in range(max(0, n + k - total), min(k, n) + 1):
                    seen += math.comb(k, j) * math.comb(total - k, n - j) / ways
                    if got is None and seen >= u[key, shard, level] - 1e-12:
                        got = j
                left[key], total, n = got, total - k, n - got
            split[2 * shard], split[2 * shard + 1] = left, {k: held[k] - left[k] for k in held}
        nodes = split
    rows = run(spark, folder, "op6_source_mixing")
    source_of = defaultdict(list)
    for i, t, _, s in docs:
        source_of[i, size(t)].append(s)
    words, taken = Counter(), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        options = source_of[r["doc_id"], r["size"]]
        s = next(x for x in options if sizes[x] == r["source_size"])
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        draws = [tuple(map(int, d.split(":"))) for d in r["draws"].split(",") if d]
        assert sum(d[2] for d in draws) == r["taken"]
        assert all(0 <= first and first + n <= r["size"] for _, first, n, _ in draws)
        taken[s] += r["taken"]
        for _, _, n, shard in draws:
            words[s, shard] += n
    for key, s in keys:
        quota = round(want[s])
        assert taken[s] == pytest.approx(quota)
        last = max((k for k in range(8) if nodes[k][key]), default=None)
        for shard in range(8):
            blocks = nodes[shard][key] * block
            assert words[s, shard] == (blocks - (math.ceil(quota / block) * block - quota) if shard == last else blocks)


def test_op7_against_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op7_warc_reassembly"])
    names = [d[0] for d in want.description]
    got = run(spark, folder, "op7_warc_reassembly")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(want.fetchall())
    digest = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert any(r["payload_digest"] == digest and r["payload_bytes"] == 0 for r in got)


def test_op8(spark, folder):
    docs = [(i, brute_fingerprint(t)) for i, t, *_ in _documents()]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (docs[a][1] ^ docs[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, f"{fp:016x}", least.get(find(k))) for k, (i, fp) in enumerate(docs))
    assert Counter(tuple(r.values()) for r in run(spark, folder, "op8_simhash_dedup")) == want


def test_op9(spark, folder):
    rows, docs = run(spark, folder, "op9_balanced_sharding"), _documents()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s])) for s in n)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    shards = defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    assert len(shards[zlib.crc32(("copied text " * 20).encode())]) == 1  # six copies stay together


def test_op10_against_p_values_in_python(spark, folder):
    docs = _documents()
    norm = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    counts = Counter(c for _, t, *_ in docs for c in t or "" if c in B64)
    for x, n in zip("abcdefghijklmnopqrstuvwxyz", secrets.PRIOR_LETTERS):
        counts[x] += n * 0.96
        counts[x.upper()] += n * 0.04
    for d in "0123456789":
        counts[d] += 20
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t, *_ in docs]
    pairs = [(a in "aeiou") != (b in "aeiou") for t in low for w in re.findall("[a-z]+", t) for a, b in zip(w, w[1:])]
    prior = sum(secrets.PRIOR_LETTERS)
    change = (sum(pairs) + 0.58 * prior) / (len(pairs) + prior)
    fold = {"hex": str.lower, "lower": str.lower, "lower36": str.lower, "base32": str.upper, "upper": str.upper, "upper36": str.upper}

    def kind_of(t):
        d, u, s = bool(re.search("[0-9]", t)), bool(re.search("[A-Z]", t)), bool(re.search("[a-z]", t))
        mixed = d and (u or s)
        for name, fits, need in [("hex", r"[0-9a-f]+|[0-9A-F]+", mixed), ("base32", r"[A-Z2-7]+|[a-z2-7]+", mixed), ("lower36", r"[0-9a-z]+", mixed), ("upper36", r"[0-9A-Z]+", mixed), ("lower", "[a-z]+", True), ("upper", "[A-Z]+", True), ("letters", "[A-Za-z]+", True), ("base64", "[A-Za-z0-9+/_-]+", d and u and s)]:
            if need and re.fullmatch(fits, t):
                return name
        return None

    tested = []
    for row, (_, t, *_) in enumerate(docs):
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_base(t).split(",") if x]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,6}", t or ""):
            token = m[0].rstrip("=")
            enc = kind_of(token)
            if enc is None or any(a < m.end() and m.start() < b for a, b in base):
                continue
            f = fold.get(enc, lambda c: c.translate(str.maketrans("-_", "+/")))
            alphabet, body = secrets.ALPHABETS[enc], f(token)
            k, n, x = len(alphabet), len(body), [alphabet.index(c) for c in body]
            q = Counter()
            for c, v in counts.items():
                if f(c) in alphabet:
                    q[f(c)] += v
            a, b = sum(v * v for v in q.values()) / sum(q.values()) ** 2, sum(v**3 for v in q.values()) / sum(q.values()) ** 3
            same = sum(v * (v - 1) / 2 for v in Counter(body).values())
            z = [(same - n * (n - 1) / 2 * a) / math.sqrt(n * (n - 1) / 2 * (a - a * a) + n * (n - 1) * (n - 2) * (b - a * a))]
            met = [(p in "aeiou") != (r in "aeiou") for p, r in zip(body.lower(), body.lower()[1:]) if p.isalpha() and r.isalpha()]
            if met:
                z.append((sum(met) - len(met) * change) / math.sqrt(len(met) * 1.5 * change * (1 - change)))
            p_text = norm(sum(z) / math.sqrt(len(z)))
            g = max(2, min(k, 2 ** int(math.log2(n / 5))))
            chi = sum(v * v for v in Counter(v * g // k for v in x).values()) * g / n - n
            df = g - 1
            p_uniform = 1 - norm(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
            high = [2 * v >= k for v in x]
            n1 = sum(high)
            mu = 2 * n1 * (n - n1) / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            runs = 1 + sum(p != r for p, r in zip(high, high[1:]))
            p_runs = 2 * norm(-abs(runs - mu) / math.sqrt(var)) if var > 0 else 0
            mean = sum(x) / n
            power = sum((v - mean) ** 2 for v in x)
            p_serial = 2 * norm(-abs((sum((p - mean) * (r - mean) for p, r in zip(x, x[1:])) / power + 1 / n) * math.sqrt(n))) if power else 0
            tested.append((row, m.start(), m.end(), enc, int(math.log2(n)), p_text, min(1, 3 * min(p_uniform, p_runs, p_serial))))
    added = defaultdict(list)
    for stratum in {x[3:5] for x in tested}:
        ps = sorted(x[5] for x in tested if x[3:5] == stratum)
        # Benjamini-Hochberg, each p rounded up to a tenth of a power of ten
        up = [10 ** (-min(300, max(0, math.floor(-10 * math.log10(p)))) / 10) for p in ps]
        cut = max((p for k, p in enumerate(ps, 1) if up[k - 1] <= 0.01 * sum(v <= up[k - 1] * (1 + 1e-12) for v in up) / len(ps)), default=-1)
        for x in tested:
            if x[3:5] == stratum and x[5] <= cut and x[6] >= 0.001:
                added[x[0]].append((x[1], 3, x[2]))
    want = Counter()
    for row, (i, t, *_) in enumerate(docs):
        base = brute_base(t)
        kinds = [x.split(":") for x in base.split(",") if x]
        every = sorted([(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in kinds] + added[row])
        n = Counter(k for k, *_ in kinds)
        want[(i, n["assign"], n["access"], n["hex"], sha(base), ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in every))] += 1
    got = Counter(tuple(r.values()) for r in run(spark, folder, "op10_secret_scan"))
    assert got == want
    assert sum(map(len, added.values())) >= 36  # of 40 planted


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
