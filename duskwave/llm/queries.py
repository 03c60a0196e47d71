"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlmain, langid, linededup, media, mixing, phrases, ranked, secrets, sharding, simhash, warc, weighted
from .common import scratch_path, stored, stored_at, table

#: Media columns are packed in long pages, in which zstd finds more repeats.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "10", "parquet.page.size": str(16 << 20)}
#: Documents go through WAV files in so many parts by a hash of their id; each reads the table once.
MEDIA_PARTS = 4


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("part", langid.part_of(F.col("doc_id")))
    model = langid.fit(docs, F.col("part") != 2)
    asked = docs.select("doc_id", F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(asked, model, ["doc_id", "held_out"])


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, files, heard = table(spark, sf_dir, "documents"), scratch_path(spark, "media"), scratch_path(spark, "pcm")
    for part in range(MEDIA_PARTS):
        # texts of one language, and near copies, are near each other, where zstd finds their repeats
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(MEDIA_PARTS)) == part).sortWithinPartitions("lang", "text")
        # the PCM of a part is stored before the WAV files of the next one take the place of its own
        sounds = stored_at(media.encode_media(some, ["doc_id"]), files, "overwrite", **PACKED)
        # readers take a row group's rows together: 1,024 rows of PCM are as long as the 4,096 texts of a batch
        pcm = stored_at(media.read_media(sounds, ["doc_id", "n_bytes"]), heard, "append", **PACKED, **{"parquet.block.row.count.limit": "1024"})
    return media.with_pcm_crc(pcm)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["b"] - r["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    draws = F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["first"].cast("string"), d["words"].cast("string"), d["shard"].cast("string")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join(draws, ",").alias("draws"))


def warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": language_id,
    "op2_line_dedup": line_dedup,
    "op3_telephony_media": telephony_media,
    "op4_benchmark_decontamination": benchmark_decontamination,
    "op5_html_extraction": html_extraction,
    "op6_source_mixing": source_mixing,
    "op7_warc_reassembly": warc_reassembly,
    "op8_simhash_dedup": simhash_dedup,
    "op9_balanced_sharding": balanced_sharding,
    "op10_secret_scan": secret_scan,
    "op11_weighted_fingerprints": weighted_fingerprints,
    "op12_phrase_mining": phrase_mining,
    "op13_ranked_search": ranked_search,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"

ORACLE_SQL = {
    "op2_line_dedup": f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
x as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) as key from x),
c as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, c.key is not null and k.doc_id is distinct from c.keeper as gone from k left join c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by r, doc_id""",
    "op4_benchmark_decontamination": f"""
with b as (select coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark where text is not null),
p as (select item, array_to_string(w[i : i + 9], ' ') as pat, least(len(w), 10) as n
  from (select item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
pats as (select pat, n, list(distinct item) as items from p group by pat, n),
lens as (select distinct n from pats),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
g as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, lens where len(w) >= n)),
f as (select g.r, g.i, g.n, pats.items from g join pats on g.gram = pats.pat and g.n = pats.n),
h as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as k from f) group by r),
t as (select r, list_sort(list(distinct item)) as items from (select r, unnest(items) as item from f) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)""",
    # base 32: five hexadecimal digits of the SHA-1 are four symbols
    "op7_warc_reassembly": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select sha, min(page_id) as first_id, count(*) as copies from p group by sha),
j as (select p.*, f.first_id, f.copies > 1 and p.page_id is distinct from f.first_id as again from p join f using (sha))
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[(i // 4) * 5 + 1 : (i // 4) * 5 + 5])::bigint >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then first_id end as refers_to
from j""",
    "op12_phrase_mining": f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \\t]+') as w from p),
tot as (select lang, sum(len(w))::hugeint as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 100),
cut as (select lang, phrase, a, string_split(phrase, ' ') as w, unnest(generate_series(1, k - 1)) as j from f where k >= 2),
s as (select c.lang, c.phrase, c.a, x.a as l, y.a as r, tot.n, j, (1000::hugeint * c.a * tot.n) // (x.a::hugeint * y.a) as score
  from cut c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1 :], ' ') join tot on tot.lang = c.lang),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from s) where o = 1),
sub as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, a, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from (select lang, a, string_split(phrase, ' ') as w from f where k > 2), (select unnest([2, 3, 4]) as m) where m < len(w)) group by all),
t as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b left join sub using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from t where rank <= 2000""",
    "op13_ranked_search": f"""
with d as (select row_number() over () as doc, doc_id, {_TERMS} as w from documents),
s as (select count(*) filter (len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from d),
tf as (select doc, term, count(*) as tf from (select doc, unnest(w) as term from d) group by all),
df as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as weight from tf, s group by term, n_docs),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
x as (select item_id, doc, any_value(doc_id) as doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms))))::bigint as score
  from q join df using (term) join tf using (term) join d using (doc), s group by item_id, doc),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from x where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50""",
}
