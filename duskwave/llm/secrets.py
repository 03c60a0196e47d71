"""Secret scans: patterns, and a battery of randomness tests; DataFrame operations only.

Tokens that no pattern covers get an inferred encoding (hexadecimal, base 32, base 36, base 64, letters). Two questions are asked of each.

* Can it be random? Three tests of the hypothesis that its symbols are uniform and independent: chi-squared over the alphabet, folded to
  as many classes as the length supports; runs above and below the middle; serial correlation. Three times the smallest p-value must
  reach `least_random`, or the token is no candidate (sequences, periods, repeated words).
* Can it be text? Here text is the null hypothesis of a finding. Its model comes from the whole corpus: how often each symbol occurs, and how
  often a vowel and a consonant meet. A random token has fewer coincidences of symbols (this is the chi-squared statistic, seen from
  the other side) and fewer runs of vowels and consonants than text of its length; the normal scores of both add up to p_text.

Benjamini-Hochberg control over p_text, in strata by encoding and octave of length, bounds the share of ordinary text among what is
reported as `random` by alpha. Short tokens can't reach a small p_text, so the length decides by itself what can be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Patterns of the base kinds in their order, and the group whose length counts (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: runs are maximal
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "random")
#: Runs of symbols with their padding: `=` ends a token, so the value in `name=value` is one of its own. Below 16 symbols a random
#: token of any of the alphabets has a p_text of 0.01 at best.
TOKEN = r"[A-Za-z0-9+/_-]{16,}+={0,6}"
#: Alphabets by encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Letters of 10,000 symbols of English text, a to z, about; the model starts from these and is soon outweighed by the corpus.
PRIOR_LETTERS = (780, 140, 260, 400, 1190, 210, 190, 570, 660, 14, 72, 380, 230, 640, 710, 180, 9, 570, 600, 860, 260, 93, 220, 14, 190, 7)
PRIOR_CAPITALS, PRIOR_DIGIT, PRIOR_CHANGE = 0.04, 20, 0.58
#: Runs of letters vary more from word to word than independent ones would.
DISPERSION = 1.5


def _hits(text: Column, pattern: str, kind: int, match: Column, value: Column, least: int) -> Column:
    """One struct a match, in order: kind, number, code points before it since the last match, its own, whether its value is long enough."""
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), match.alias("match"), value.alias("value")), lambda x: x["match"].isNotNull())
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("n"), (F.char_length(x["value"]) >= least).alias("ok"), (x["match"] if kind == 3 else F.lit(None).cast("string")).alias("match"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean,match:string>>")
    return F.when(F.size(match) > 0, F.transform(pairs, one)).otherwise(none)


def matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id and hits (all matches of the four patterns) for every row of docs; each pattern reads a text once, and once more where it occurs."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    every = lambda pattern, group=0: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    found = found.select("doc_id", "t", every(ASSIGN).alias("m0"), F.when(F.contains("t", F.lit("AKIA")), every(ACCESS)).otherwise(F.array().cast("array<string>")).alias("m1"), every(HEX).alias("m2"), every(TOKEN).alias("m3"))
    secret = F.when(F.size("m0") > 0, every(ASSIGN, 2))
    hits = [_hits(F.col("t"), p, k, F.col(f"m{k}"), secret if k == 0 else F.col(f"m{k}"), 8 if k == 0 else 0) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))]
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*hits).alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, match of all base spans, and of the tokens (kind 3) that overlap none; positions are running sums over a row's matches."""
    each = found.where(F.size("hits") > 0).select("row", F.inline("hits")).repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum((F.col("gap") + F.col("n")).cast("long")).over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    each = each.where("ok").select("row", "kind", "start", "end", "match")
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("reach", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(earlier)).withColumn("next", F.min(F.when(F.col("kind") < 3, F.col("start"))).over(later))
    return each.where((F.col("kind") < 3) | (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", "end") >= F.col("end"))).drop("reach", "next")


def phi(z: Column) -> Column:
    """The normal distribution function, by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def two_sided(z: Column) -> Column:
    return 2 * phi(-F.abs(z))


def encoding(token: Column) -> Column:
    """Inferred from the symbols, the smallest alphabet that has all of them; null for what is none of these.

    These are digits alone, and tokens with one of `+/_-` that lack a digit, a small or a capital letter (words joined by hyphens, paths).
    """
    body = F.regexp_replace(token, "=+$", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return (
        F.when(mixed & body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(mixed & body.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32")
        .when(mixed & body.rlike("^[0-9a-z]+$"), "lower36")
        .when(mixed & body.rlike("^[0-9A-Z]+$"), "upper36")
        .when(body.rlike("^[a-z]+$"), "lower")
        .when(body.rlike("^[A-Z]+$"), "upper")
        .when(body.rlike("^[A-Za-z]+$"), "letters")
        .when(mixed & body.rlike("[a-z]") & body.rlike("[A-Z]") & body.rlike("^[A-Za-z0-9+/_-]+$"), "base64")
    )


def _alphabet() -> Column:
    alphabet = F.lit(None).cast("string")
    for name, symbols in ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, F.lit(symbols)).otherwise(alphabet)
    return alphabet


def _folded(symbols: Column) -> Column:
    """In the letter case of the encoding's alphabet."""
    return F.when(F.col("encoding").isin("hex", "lower", "lower36"), F.lower(symbols)).when(F.col("encoding").isin("base32", "upper", "upper36"), F.upper(symbols)).otherwise(F.translate(symbols, "-_", "+/"))


def text_model(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """encoding, a, b, change: sums of squares and cubes of the shares of an alphabet's symbols in all of the corpus' text, and the share of
    adjacent letters of which one is a vowel and one is not. One row for each encoding."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = docs.select(F.explode(F.split(t, " ")).alias("w")).select(F.explode(F.split("w", "")).alias("c")).where("(c between '0' and '9') or (c between 'A' and 'Z') or (c between 'a' and 'z')")
    counts = stored(letters.groupBy("c").agg(F.count("*").cast("double").alias("n")), "secrets-symbols")  # 62 rows
    usual = [(c, n * share) for x, n in zip("abcdefghijklmnopqrstuvwxyz", PRIOR_LETTERS, strict=True) for c, share in ((x, 1 - PRIOR_CAPITALS), (x.upper(), PRIOR_CAPITALS))] + [(d, PRIOR_DIGIT) for d in "0123456789"]
    prior = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(n)).alias("n")) for c, n in usual))))
    shares = counts.union(prior).select(F.explode(F.array(*map(F.lit, ALPHABETS))).alias("encoding"), "c", "n")
    shares = shares.select("encoding", _folded(F.col("c")).alias("c"), "n").where(F.call_function("instr", _alphabet(), F.col("c")) > 0)
    shares = shares.groupBy("encoding", "c").agg(F.sum("n").alias("n")).groupBy("encoding").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.pow("n", F.lit(3.0))).alias("n3"))
    # vowels and consonants as v and k: where both orders of a pair stand, and how many runs of letters there are
    low = docs.select(F.lower(t).alias("t")).select("t", F.translate("t", "abcdefghijklmnopqrstuvwxyz", "vkkkvkkkvkkkkkvkkkkkvkkkkk").alias("x"))
    pairs = lambda pair: F.sum((F.octet_length("x") - F.octet_length(F.replace("x", F.lit(pair), F.lit("")))) / 2.0)
    vowels = low.agg(pairs("vk").alias("v"), pairs("kv").alias("k"), F.sum(F.regexp_count("t", F.lit("[a-z]+")).cast("double")).alias("w"))
    vowels = vowels.join(F.broadcast(counts.where("c > '9'").agg(F.sum("n").alias("n"))))
    usual_pairs = float(sum(PRIOR_LETTERS))
    of = lambda name: F.coalesce(name, F.lit(0.0))
    change = vowels.select(((of("v") + of("k") + PRIOR_CHANGE * usual_pairs) / (of("n") - of("w") + usual_pairs)).alias("change"))
    model = shares.join(F.broadcast(change)).select("encoding", (F.col("n2") / F.pow("m", F.lit(2.0))).alias("a"), (F.col("n3") / F.pow("m", F.lit(3.0))).alias("b"), "change")
    return stored(model, "secrets-model")


def battery(tokens: DataFrame) -> DataFrame:
    """Adds x (the symbols' numbers), n, p_uniform, p_runs, p_serial and p to rows with match and encoding (not null)."""
    t = tokens.withColumn("alphabet", _alphabet()).withColumn("k", F.length("alphabet")).withColumn("body", _folded(F.regexp_replace("match", "=+$", "")))
    t = t.withColumn("x", F.transform(F.split("body", ""), lambda c: F.call_function("instr", F.col("alphabet"), c) - 1))
    t = t.withColumn("n", F.size("x")).withColumn("g", F.greatest(F.lit(2), F.least(F.col("k"), F.pow(F.lit(2), F.floor(F.log2(F.col("n") / 5)))).cast("int")))
    square = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda c: F.size(F.filter("x", lambda v: F.floor(v * F.col("g") / F.col("k")) == c))), F.lit(0.0), lambda a, o: a + o * o)
    t = t.withColumn("chi", square * F.col("g") / F.col("n") - F.col("n")).withColumn("df", (F.col("g") - 1).cast("double"))
    cube = (F.pow(F.col("chi") / F.col("df"), F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * F.col("df")))) / F.sqrt(F.lit(2.0) / (9 * F.col("df")))
    t = t.withColumn("p_uniform", 1 - phi(cube))
    t = t.withColumn("high", F.transform("x", lambda v: (v * 2 >= F.col("k")).cast("int"))).withColumn("n1", F.aggregate("high", F.lit(0), lambda a, v: a + v).cast("double"))
    steps = F.zip_with(F.slice("high", F.lit(1), F.col("n") - 1), F.slice("high", F.lit(2), F.col("n") - 1), lambda a, b: (a != b).cast("int"))
    t = t.withColumn("runs", 1.0 + F.aggregate(steps, F.lit(0), lambda a, v: a + v)).withColumn("n0", F.col("n") - F.col("n1"))
    t = t.withColumn("mu", 2 * F.col("n1") * F.col("n0") / F.col("n") + 1)
    t = t.withColumn("var", (F.col("mu") - 1) * (F.col("mu") - 2) / (F.col("n") - 1))
    t = t.withColumn("p_runs", F.when(F.col("var") > 0, two_sided((F.col("runs") - F.col("mu")) / F.sqrt("var"))).otherwise(F.lit(0.0)))
    t = t.withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n")).withColumn("d", F.transform("x", lambda v: v - F.col("mean")))
    power = F.aggregate("d", F.lit(0.0), lambda a, v: a + v * v)
    lagged = F.aggregate(F.zip_with(F.slice("d", F.lit(1), F.col("n") - 1), F.slice("d", F.lit(2), F.col("n") - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    t = t.withColumn("p_serial", F.when(power > 0, two_sided((lagged / power + 1 / F.col("n")) * F.sqrt("n"))).otherwise(F.lit(0.0)))
    return t.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial")))


def likeness(tested: DataFrame, model: DataFrame) -> DataFrame:
    """Adds p_text to rows of battery(): the probability that text of this length has so few coincidences and so few changes between vowels and consonants."""
    t = tested.join(F.broadcast(model), "encoding")  # eight rows
    n = F.col("n").cast("double")
    pairs = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.size(F.filter("x", lambda v: v == c)).cast("double")), F.lit(0.0), lambda s, o: s + o * (o - 1) / 2)
    mean = n * (n - 1) / 2 * F.col("a")
    var = n * (n - 1) / 2 * (F.col("a") - F.pow("a", F.lit(2.0))) + n * (n - 1) * (n - 2) * (F.col("b") - F.pow("a", F.lit(2.0)))
    t = t.withColumn("z_same", (pairs - mean) / F.sqrt(var))
    letters = lambda pattern: F.regexp_count(F.lower("body"), F.lit(pattern)).cast("double")
    met = letters("[a-z](?=[a-z])")
    changes = letters("[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])")
    z_change = F.when(met > 0, (changes - met * F.col("change")) / F.sqrt(met * DISPERSION * F.col("change") * (1 - F.col("change"))))
    t = t.withColumn("z_change", z_change)
    return t.withColumn("p_text", phi((F.col("z_same") + F.coalesce("z_change", F.lit(0.0))) / F.when(F.col("z_change").isNull(), F.lit(1.0)).otherwise(F.sqrt(F.lit(2.0)))))


def cutoffs(tested: DataFrame, alpha: float) -> DataFrame:
    """For each stratum, from which bin on text is rejected: Benjamini-Hochberg over tenths of powers of ten of p_text.

    A bin's largest p stands for all in it, which can only report fewer tokens. At most 301 bins a stratum are counted.
    """
    bins = tested.groupBy("encoding", "octave", "bin").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("encoding", "octave").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    of_all = Window.partitionBy("encoding", "octave")
    ranked = bins.withColumn("rank", F.sum("n").over(smaller)).withColumn("m", F.sum("n").over(of_all))
    return ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.lit(alpha) * F.col("rank") / F.col("m")).groupBy("encoding", "octave").agg(F.min("bin").alias("report_from"))


def random_tokens(tokens: DataFrame, model: DataFrame, alpha: float, least_random: float) -> DataFrame:
    """The rows of tokens (match, encoding and others) that are reported."""
    tested = likeness(battery(tokens), model).select(*tokens.columns, "p", F.floor(F.log2("n")).cast("int").alias("octave"), F.greatest(F.lit(0), F.least(F.lit(300), F.floor(-10 * F.log10(F.greatest("p_text", F.lit(1e-31)))))).cast("int").alias("bin"))
    tested = stored(tested.drop("match"), "secrets-tested")
    # strata are few by construction: eight encodings by octaves of a length
    limits = F.broadcast(cutoffs(tested, alpha))
    return tested.join(limits, ["encoding", "octave"]).where((F.col("bin") >= F.col("report_from")) & (F.col("p") >= least_random))


def scan_secrets(docs: DataFrame, alpha: float = 0.01, least_random: float = 0.001, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of start, kind number, end; by start, then kind) for every row of docs.

    Kinds: 0 assign, 1 access, 2 hex (all kept as found), 3 random. Null and empty texts have none. Rows that repeat an
    id are scanned each for itself, other columns are ignored, an empty table gives an empty result. A text's work grows
    in proportion to its length (and to the logarithm of its number of matches), however long it is.
    """
    found = stored(matches(docs, doc_id, text), "secrets")
    spans = stored(placed(found).withColumn("encoding", F.when(F.col("kind") == 3, encoding(F.col("match")))).where("kind < 3 or encoding is not null"), "secrets-spans")
    added = random_tokens(spans.where("kind = 3").select("row", "start", "end", "match", "encoding"), text_model(docs.sparkSession, docs, text), alpha, least_random)
    every = spans.where("kind < 3").select("row", "start", "kind", "end").union(added.select("row", "start", F.lit(3), "end"))
    every = every.groupBy(F.col("row").alias("span_row")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row", "doc_id").join(every, F.col("row") == F.col("span_row"), "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans_column: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
