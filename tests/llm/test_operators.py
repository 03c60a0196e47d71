"""Operators against brute force on small inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from duskwave.llm import decontam, htmlmain, langid, linededup, media, mixing, secrets, sharding, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, hits string, h long, score double"


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Rows with columns of names that the operators use themselves."""
    n = len(texts)
    ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["s"] * n
    return spark.createDataFrame([(i, t, x, s, None, 1, 2, "x", 3, 0.5) for i, t, x, s in zip(ids, texts, langs, sources)], SCHEMA).repartition(3)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [None, "", "   ", "\n", "a", "1234 !!", "é ü ß", "word " * 30000, prose(1, 50), prose(1, 50), prose(2, 50).upper(), "\x00\x1f\x7f​", "\U0001f600 smile"]


# language id

SYLLABLES = {"en": "the and of with ing er".split(), "de": "der die und sch ein ung".split(), "fr": "le la eau tion oui ais".split()}


def speak(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id_held_out_accuracy_and_odd_texts(spark):
    texts = [(speak(x, i), x) for x in SYLLABLES for i in range(60)]
    docs = documents(spark, [t for t, _ in texts] + ODD, langs=[x for _, x in texts] + [None] * len(ODD))
    model = langid.fit(docs, langid.part_of(F.col("doc_id")) != 2)
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and sum(got[i]["lang_pred"] == texts[i][1] for i in held) / len(held) > 0.97
    for k, t in enumerate(ODD):
        has_letter = any(c.isalpha() for c in t or "")
        assert (got[len(texts) + k]["lang_pred"] == "und") == (not has_letter)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_without_labels_or_rows(spark):
    docs = documents(spark, ["abc", None], langs=[None, None])
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, F.lit(True)), ["doc_id"]).collect()} == {"und"}
    one = documents(spark, ["abc def"], langs=["en"])
    model = langid.fit(one, F.lit(True))
    assert langid.identify(one, model, ["doc_id"]).first()["lang_pred"] == "en"
    assert langid.identify(one.limit(0), model, ["doc_id"]).count() == 0


def test_codewords_differ():
    for k in (2, 3, 5, 12):
        code = langid.codewords(k, langid.Settings())
        assert len({tuple(r) for r in code.tolist()}) == k


# lines


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keeper = lambda k: max(holders[k], key=lambda x: (x is not None, x or 0))
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and keeper(key(x)) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark):
    common, rare = "This Line is repeated across many documents ok", "É" * 39 + "x"
    rows = [(i, f"{prose(i, 12)}\n  {common}\t\nshort\n{common.upper()}\n{rare if i < 4 else prose(i, 9)}") for i in range(12)]
    rows += [(3, common), (None, common), (None, None), (50, ""), (51, "\n\n"), (52, rare + "\n" + rare), (53, "word " * 40000)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = linededup.drop_common_lines(docs)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == brute_lines(rows)
    assert linededup.drop_common_lines(docs.limit(0)).count() == 0


# media


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_media_round_trip(spark, codec):
    docs = documents(spark, ODD)
    files = media.encode_media(docs, ["doc_id"], codec)
    got = {r["doc_id"]: r for r in files.join(media.read_media(files, ["doc_id"]), "doc_id").collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert media.unwav(bytes(r["media"])) == (codec, 8000, padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert got[8]["feature"] == got[9]["feature"] and media.read_media(files.limit(0), ["doc_id"]).count() == 0
    pcm = {r["doc_id"]: r for r in media.pcm_media(files, ["doc_id"]).collect()}
    assert pcm[4]["rate"] == 16000 and len(pcm[4]["pcm"]) == 2 * 2 * (64 if codec != "adpcm" else 121)


def test_media_of_any_length(spark):
    import numpy as np

    from duskwave.llm.common import stored

    def levels(x):
        return f"{math.isqrt(sum(v * v for v in x) // len(x))},{max(map(abs, x))},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}" if x else "0,0,0"

    r = random.Random(5)
    rows = [(i, codec, r.randbytes(n)) for i, (codec, n) in enumerate((c, n) for c in media.FORMAT for n in (0, 1, 3, 4, 32, 32, 63, 64, 65, 70, 128, 5000))]
    files = spark.createDataFrame([*((i, media.wav(x, codec)) for i, codec, x in rows), (99, None)], "doc_id long, media binary").coalesce(1)
    read = media.read_media(files, ["doc_id"])
    got = {x["doc_id"]: x.asDict() for x in read.collect()}
    kept = {x["doc_id"]: x["feature"] for x in media.with_pcm_crc(stored(read, "pcm")).collect()}
    doubled = {x["doc_id"]: (x["rate"], x["pcm"]) for x in media.pcm_media(files, ["doc_id"]).collect()}
    # a short last block: the samples of a whole one up to its end
    adpcm = lambda x: [int(v) for k in range(0, len(x), 64) for b in [x[k : k + 64]] if len(b) >= 4 for v in media.decode_adpcm(np.frombuffer(b + bytes(64 - len(b)), np.uint8)[None])[0][: 1 + 2 * (len(b) - 4)]]
    for i, codec, x in rows:
        read_as = {"mulaw": media.mulaw_table()[list(x)].tolist() if x else [], "alaw": media.alaw_table()[list(x)].tolist() if x else [], "adpcm": adpcm(x)}
        feature = ";".join(f"{k}:{levels(v)}" for k, v in read_as.items())
        pcm = media.resample2(np.array(read_as[codec], np.int16)).astype("<i2").tobytes()
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]))
        assert got[i]["feature"] == feature and kept[i] == f"{feature};pcm16000:{zlib.crc32(pcm):08x}"
        assert (got[i]["rate"], got[i]["pcm"]) == doubled[i] == (16000, pcm)
    assert set(got.pop(99).values()) == {99, None} and kept[99] is None


def test_companding_tables_and_adpcm():
    import numpy as np

    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0) and (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    wave = (8000 * np.sin(np.arange(2000) / 9)).astype(np.int16)
    back = media.decode_adpcm(media.encode_adpcm(wave)).reshape(-1)[: len(wave)]
    assert np.abs(back.astype(int) - wave).mean() < 300
    # one block after the other gives what all at once gives
    blocks = media.encode_adpcm(wave)
    assert (media.decode_adpcm(blocks) == np.concatenate([media.decode_adpcm(b[None]) for b in blocks])).all()
    assert media.resample2(np.array([5], np.int16)).tolist() == [5, 5] and len(media.resample2(np.zeros(0, np.int16))) == 0


# decontamination


def brute_contamination(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("most_windows", [50_000, 30])
def test_decontamination(spark, most_windows):
    items = [(1, prose(100, 30)), (2, prose(101, 10)), (3, "Tiny QUESTION"), (4, "x"), (5, None), (6, "!!! ..."), (7, prose(100, 30)), (None, prose(102, 15)), (1, prose(103, 12)), (8, "é" * 5 + " ü9"), (9, prose(100, 14))]
    docs = [(i, prose(i, 60)) for i in range(30)]
    docs += [(40, f"{prose(1, 20)}, {prose(100, 30)}! {prose(2, 5)}"), (41, prose(100, 30)[3:]), (42, "a tiny, question x"), (43, None), (44, ""), (45, prose(101, 10).upper()), (46, "ÉÉ ééééé ü9"), (None, prose(102, 15) + " " + prose(102, 15)), (45, prose(103, 12)), (48, (prose(7, 3000) + " " + prose(101, 10)) * 3), (49, "xx x xx")]
    frame = documents(spark, [t for _, t in docs], ids=[i for i, _ in docs])
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, hits string")
    got = decontam.contamination(frame, bench, ["doc_id"], most_windows=most_windows).collect()
    assert Counter((r["doc_id"], r["n_words"], sum(x["b"] - x["a"] for x in r["hits"]), tuple(r["items"])) for r in got) == brute_contamination(docs, items)
    assert decontam.contamination(frame, bench.limit(0), ["doc_id"]).where(F.size("hits") > 0).count() == 0
    assert decontam.contamination(frame.limit(0), bench, ["doc_id"]).count() == 0


# pages


def test_main_text(spark):
    def page(host, n, article, extra=""):
        return (n, f"https://{host}/p/{n}", f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use</div>{extra}<article><h1>Title {n}</h1>{article}</article><aside>more</aside><footer>&copy; x</footer></body></html>")

    rows = [page("a.com", i, f"<p>Body  of\n{i} &amp; more&nbsp;text</p><p>Shared paragraph</p><div>Read our weekly letter</div><div class=comments><p>nice</p></div>") for i in range(20)]
    rows += [page("b.com", 100 + i, "<p>Same text on every page</p>") for i in range(20)]
    rows += [(200, None, None), (201, "bad url", ""), (202, "http://c.com/", "<p>open <b>bold <p>next<br>line</p> x < y"), (203, "http://c.com/", "text &#233; only"), (None, "http://c.com/", "<div>" * 600 + "deep"), (204, "http://c.com/", "<form><p>f</p></form><p>a</p><!-- <p>c</p> --><style>p{}</style>")]
    rows += [(400 + i, f"http://two.com/{i}", f"<div><div>Start</div><div><p>Only here {i}</p></div><div>End</div></div>") for i in range(2)]  # two pages suffice
    rows += [(500, "http://one.com/", "<div><div>Start</div><p>A host with one page</p></div>"), (501, "http://two.com/x", "<a " * 300000 + "<p>end"), (502, "http://two.com/y", "<div>" * 50000 + "<nav>no</nav><p>deep</p>")]
    rows += [(300 + i, f"http://plain.com/{i}", f"<body><div>Menu of plain</div><div><p>Own words {i}</p></div><div>Contact plain</div></body>") for i in range(12)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, tree string")
    got = {r["page_id"]: r["text"] for r in htmlmain.main_text(frame).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Title 3\nBody of 3 & more text\nShared paragraph"  # the letter recurs, the shared paragraph is no container
    assert got[105] == "Title 105\nSame text on every page"
    assert got[200] == got[201] == "" and got[203] == "text é only" and got[None] == "deep" and got[204] == "a"
    assert got[202] == "open bold\nnext line\nx < y"
    assert got[304] == "Own words 4" and got[400] == "Only here 0" and got[401] == "Only here 1"
    assert got[500] == "Start\nA host with one page" and got[501] == "end" and got[502] == "deep"  # a tag that is never closed ends with the next one
    joined = {r["page_id"]: r["text"] for r in htmlmain.main_text(frame, most_broadcast=0).collect()}
    assert joined == got
    counted = {r["page_id"]: (r["n_template"], r["text"]) for r in htmlmain.main_text(frame, kinds=False).collect()}
    assert counted[304] == (2, "Own words 4") and counted[105][0] >= 3 and counted[105][1] == "Title 105\nSame text on every page"
    assert htmlmain.main_text(frame.limit(0)).count() == 0


# mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    order = sorted((k for k in sizes if k is not None), key=lambda x: [ord(c) for c in x]) + [k for k in sizes if k is None]
    weight = {k: weights[i % 3] for i, k in enumerate(order)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [k for k in order if k not in full]
        rest = left - sum(2 * sizes[k] for k in full)
        target = {k: 2 * sizes[k] for k in full} | {k: rest * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if target[k] > 2 * sizes[k]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    r = random.Random(5)
    texts, sources = [], []
    for s, n in [("b", 120), ("a", 5), ("é", 40), (None, 30), ("Z", 1), ("empty", 2)]:
        for _ in range(n):
            texts.append(None if s == "empty" else prose(r.random(), r.randint(1, 60)))
            sources.append(s)
    texts[0] = "word " * 5000
    docs = documents(spark, texts, sources=sources)
    plan = mixing.mix_plan(docs, cell_docs=10, block_words=50).collect()
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for row in plan:
        assert row["size"] == len((texts[row["doc_id"]] or "").split()) and row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]]) and 0 <= row["taken"] <= 2 * row["size"]
        assert row["taken"] == sum(d["words"] for d in row["draws"])
        taken[row["source"]] += row["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want) and len(plan) == len(texts)
    again = {(x["doc_id"], x["taken"]) for x in mixing.mix_plan(docs.repartition(2), cell_docs=10, block_words=50).collect()}
    assert again == {(x["doc_id"], x["taken"]) for x in plan}
    rows = mixing.mix(docs, cell_docs=10, block_words=50)
    assert rows.columns == docs.columns and sum(len((x["text"] or "").split()) for x in rows.collect()) == sum(taken.values())
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_plan(documents(spark, [None, ""])).where("taken <> 0").count() == 0


def test_splitting_tree_keeps_quotas(spark):
    rows = [("a", 1000), ("b", 7), ("c", 0), (None, 333)]
    got = {r["key"]: r["bounds"] for r in mixing.split_quotas(spark.createDataFrame(rows, "source string, blocks long")).collect()}
    assert {k: v[-1] for k, v in got.items()} == {"sa": 1000, "sb": 7, "sc": 0, "": 333}
    by_shard = [sum(v[i] - (v[i - 1] if i else 0) for v in got.values()) for i in range(8)]
    assert max(by_shard) - min(by_shard) <= 1 and all(x <= y for v in got.values() for x, y in zip(v, v[1:]))
    shares = [got["sa"][i] - (got["sa"][i - 1] if i else 0) for i in range(8)]
    assert all(100 < x < 150 for x in shares)


def test_hypergeometric_draw_has_the_exact_distribution(spark):
    from math import comb

    draw = mixing._draw("6D", "20D", "8D", "(cast(id as double) / 4000)")
    got = Counter(r[0] for r in spark.range(4000).selectExpr(draw).collect())
    for k in range(7):
        assert abs(got[k] / 4000 - comb(6, k) * comb(14, 8 - k) / comb(20, 8)) < 0.002


# archives


def test_archives(spark, tmp_path):
    big = "".join(chr(33 + i % 90) for i in range(70000)) + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://x/", "same"), (3, "http://y/", "same"), (9, None, "same"), (1, "http://z/\r\nX: y", big), (2, "http://w/", big), (7, "u", None), (8, "u", ""), (None, "n", "only null"), (None, "n", "same"), (4, "é", "ü" * 5000), (4, "é", "ü" * 5000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = warc.page_records(frame, records_per_file=4)
    first = {"same": 3, big: 1, "": 7, "only null": None, "ü" * 5000: 4}
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i != first[h or ""]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == Counter(want)
    assert warc.page_records(frame, min_payload=10**9).where("record_type <> 'response'").count() == 0
    assert warc.page_records(frame.limit(0)).count() == 0


def test_records_and_chunks():
    for n in (0, 1, 4095, 4096, 4097, 50000):
        data = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(data)) == data
        made = warc.records("u", 1, "http://x", data, True, None, 1000)
        parsed = list(warc.parse_records(warc.END.join(made) + warc.END))
        block = b"".join(b for _, b in parsed)
        assert warc.http_payload(block) == data
        if len(parsed) > 1:
            assert int(parsed[-1][0]["warc-segment-total-length"]) == len(block)
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.record([("WARC-Type", "response")], b"abcdef")[:-2]))


def test_missing_segment_is_an_error(spark):
    rows = [("k", "response", 1, "u", None, None, 1, None, b"HTTP/1.1 200 OK\r\n\r\nab"), ("k", "continuation", None, None, None, None, 3, 30, b"cd")]
    with pytest.raises(Exception, match="do not add up"):
        warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).collect()


# near duplicates


def brute_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_print(text, which):
    """The fingerprint of this number, bit by bit."""
    w = text.lower().split() if text else []
    found = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    for _ in range(2 if which else 0):
        found = [((h + which) * 0x9E3779B97F4A7C15) % 2**64 for h in found]
        found = [h ^ (h >> 32) for h in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


@pytest.mark.parametrize("prints", [1, 4])
def test_near_duplicates(spark, prints):
    texts = [prose(i, 80) for i in range(30)]
    for i in range(24):
        w = texts[i % 3].split()
        for k in range(1 + i // 6):
            w[(40 + 17 * k + i) % 80] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [None, "", " \t", "One two", "one TWO", texts[5], texts[5], "word " * 20000]
    ids = [1000 - i for i in range(len(texts))]
    ids[7] = ids[8] = None
    docs = documents(spark, texts, ids=ids)
    fps = [brute_fingerprint(t) for t in texts]
    every = [[brute_print(t, k) for k in range(prints)] for t in texts]
    assert [f[0] for f in every] == fps
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 3 for a, b in zip(every[i], every[j], strict=True)):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], least.get(find(i))) for i, d in enumerate(ids))
    got = simhash.near_duplicates(docs, prints=prints)
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got.collect()) == want
    kept = simhash.keep_one(docs, prints)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(texts))})
    none = docs.limit(0)
    assert simhash.near_duplicates(none, prints=prints).count() == 0 and simhash.keep_one(none, prints).count() == 0


@pytest.mark.parametrize("levels", [simhash.LEVELS, simhash.WIDE])
@pytest.mark.parametrize("most", [4096, 20])
def test_links_lose_nothing_in_dense_buckets(spark, most, levels):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(150)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    star = simhash.components(simhash.links(fps, most=most, levels=levels))  # a lower bound sends keys to the next levels
    got = {r["u"]: r["root"] for r in star.collect()}
    label = {x: got.get(x, x) for x in signed}
    todo, classes = set(signed), 0
    while todo:
        grown, edge = set(), {todo.pop()}
        while edge:
            grown |= edge
            edge = {y for y in todo for x in edge if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
            todo -= edge
        classes += 1
        assert len({label[x] for x in grown}) == 1
    assert len(set(label.values())) == classes


def test_components_of_a_long_chain(spark):
    edges = [(i + 1, i) for i in range(60)] + [(i, 100) for i in range(101, 140)]
    got = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 140))


# sharding


def test_sharding(spark):
    texts = [f"group {i % 40}" for i in range(160)] + ["hot"] * 150 + [f"single {i}" for i in range(137)] + [None, "", "é"]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2] = None
    ids[5] = ids[4]
    docs = documents(spark, texts, ids=ids)
    got = sharding.assign_shards(docs, cell_docs=20).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(ids)
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    split = [len(shards[zlib.crc32(f"group {i}".encode())]) for i in range(40)]
    assert sum(x > 1 for x in split) <= 12  # most groups of four stay together
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    assert Counter(r["slot"] for r in sharding.assign_shards(docs.limit(3)).collect()) == {0: 3}


# secrets


def brute_base(t):
    kinds = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1), ("access", r"(AKIA[A-Z0-9]+)", 16, 1), ("hex", r"([0-9a-f]+)", 32, 1)]
    found = []
    for k, (_, p, least, g) in enumerate(kinds):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, t or "") if len(m.group(g)) >= least]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(spark):
    r = random.Random(9)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", 'password = "abcdefgh1"', "token: secret: abcdefghij", "TOKEN='short'", "é\U0001f600 api_key=" + pick(b64, 30), "xAKIA" + pick("ABCDEFGH01234567", 16) + " AKIA123", "AKIAAKIA" + "A" * 12, pick("0123456789abcdef", 40) + " " + pick("0123456789abcdef", 31), "a" * 50, "passwd:" + pick("0123456789abcdef", 40), "ſecret=abcdefghijk tokEN := x", prose(3, 4000) + " secret=abcdefgh " + prose(4, 10)]
    planted = [f"see {pick('0123456789ABCDEF', 40)} here {pick(b64, 44)}." for _ in range(40)]
    planted[0] += " " + prose(5, 20000)  # text is modelled on the corpus, so there has to be some
    dull = ["A1" * 20 + "b", "Ab1" * 15, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123"] * 3
    texts += planted + dull
    got = {x["doc_id"]: x for x in secrets.scan_secrets(documents(spark, texts)).select("doc_id", secrets.listed(F.filter("spans", lambda s: s["kind"] < 3)).alias("base"), secrets.listed(F.col("spans")).alias("all")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["base"] == brute_base(t), t
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["all"].split(","))
    n = [got[i]["all"].count("random") for i in range(len(texts))]
    assert sum(n[13:53]) >= 76  # of 80 random tokens
    assert sum(n[53:]) == 0  # periodic and sequential ones are rejected
    assert secrets.scan_secrets(documents(spark, ["x"]).limit(0)).count() == 0


def test_secret_scan_tests_values_after_a_name_and_every_alphabet(spark):
    r = random.Random(4)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    shapes = {
        "sig=": lambda: base64.b64encode(r.randbytes(31)).decode(),
        "client_key=": lambda: base64.b64encode(r.randbytes(34)).decode(),  # 46 symbols and padding
        "session=": lambda: pick(small + digits, 40),
        "key ": lambda: pick(small + digits, 36),
        "id ": lambda: pick(small.upper() + digits, 40),
        "onion ": lambda: pick(small + "234567", 56),
        "small ": lambda: pick(small, 40),
        "capital ": lambda: pick(small.upper(), 40),
        "both ": lambda: pick(small + small.upper(), 40),
    }
    planted = [(name, f"{name}{make()}") for name, make in shapes.items() for _ in range(20)]
    dull = ["sig=" + "Ab1" * 15, "a0z" * 14, "A0Z" * 14, small * 2, small.upper() * 2, "AbstractSingletonProxyFactoryBeanFactoryImplementation", "x=" + "a" * 18, "well-known-state-of-the-art", "1" * 30, "name=" + "=" * 40]
    texts = [t for _, t in planted] + dull + [prose(i, 2000) for i in range(20)]
    got = {x["doc_id"]: x["all"] for x in secrets.scan_secrets(documents(spark, texts)).select("doc_id", secrets.listed(F.col("spans")).alias("all")).collect()}
    hits = Counter(name for i, (name, t) in enumerate(planted) if got[i] == f"random:{len(name)}:{len(t)}")
    assert all(hits[name] >= 18 for name in shapes), hits
    assert [got[len(planted) + i] for i in range(len(dull) + 20)] == [""] * (len(dull) + 20)


def test_secret_scan_of_many_matches_in_one_text(spark):
    r = random.Random(6)
    text = " ".join(r.choice(["deadbeef" * 5, "AKIA" + "B" * 16, "token=abcdefghij", "0123456789abcdefXYZ", "é" * 20]) for _ in range(20000))
    began = time.time()
    got = secrets.scan_secrets(documents(spark, [text])).select(secrets.listed(F.filter("spans", lambda s: s["kind"] < 3)).alias("base")).first()["base"]
    assert got == brute_base(text) and time.time() - began < 60


def test_ordinary_tokens_have_large_p_text(spark):
    r = random.Random(8)
    corpus = spark.createDataFrame([(" ".join(r.choice(WORDS) for _ in range(3000)),) for _ in range(10)], "text string")
    joined = ["".join(r.choice(WORDS) for _ in range(5)) for _ in range(400)]
    tokens = spark.createDataFrame([("lower", x) for x in joined], "encoding string, match string")
    got = [x["p_text"] for x in secrets.likeness(secrets.battery(tokens), secrets.text_model(spark, corpus)).select("p_text").collect()]
    for level in (0.01, 0.05, 0.2):
        assert sum(p <= level for p in got) / 400 <= level * 1.3 + 0.005


def test_battery_p_values_are_uniform_on_random_tokens(spark):
    r = random.Random(2)
    rows = [("hex", "".join(r.choice("0123456789abcdef") for _ in range(64))) for _ in range(400)]
    got = secrets.battery(spark.createDataFrame(rows, "encoding string, match string")).select("p_uniform", "p_runs", "p_serial").collect()
    for k in range(3):
        assert 0.02 <= sum(x[k] < 0.1 for x in got) / 400 <= 0.2
