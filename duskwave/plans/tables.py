"""Queries on whole tables: sources and sinks, joins by key, time and position, windows, set operations, reshapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import photometry as ph
from ..operators import heads, ranking, sky
from ..operators import lightcurve as lc
from ..sources import adapters as src
from ..sources import integrity, io
from .base import query, r6
from .curves import _BANDS, _bands, _phot, _pre


def _objects(spark, d):
    return src.table(spark, d, "events").groupBy(F.col("user_id").alias("obj_id")).agg(F.count("*").cast("int").alias("n_events"), F.min("event_type").alias("bts_type"))


@query("scan_manifest", "select user_id as obj_id, '/data/curves/' || user_id || '.npy' as filepath, min(event_type) as bts_type, case when min(event_type) = 'click' then 'SN' else 'other' end as broad, count(*)::int as n_events, count(*) >= 60 as passes_quality from events group by user_id")
def scan_manifest(spark, d):
    path = io.scratch(spark, "manifest")
    o = _objects(spark, d).select("obj_id", F.concat(F.col("obj_id").cast("string"), F.lit(".npy")).alias("filepath"), "bts_type", F.when(F.col("bts_type") == "click", "SN").otherwise("other").alias("broad"), "n_events", (F.col("n_events") >= 60).alias("passes_quality"))
    io.write_manifest(o, path)
    return io.read_manifest(spark, path, "/data/curves")


@query("scan_catalog_clean", "select p_partkey as src, split_part(p_type, ' ', 1) as kind from part where p_partkey % 7 <> 0 and split_part(p_type, ' ', 1) in ('ECONOMY', 'STANDARD', 'PROMO')")
def scan_catalog_clean(spark, d):
    """A ragged page: every seventh row is short, fields carry spaces, and there are blank lines."""
    path = io.scratch(spark, "catalogue")
    p = src.table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(",  "), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(" ")))
    p.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    kinds = spark.createDataFrame([("ECONOMY",), ("STANDARD",), ("PROMO",)], "kind string")
    return io.read_ragged_catalogue(spark, path, "src long, kind string").join(F.broadcast(kinds), "kind").select("src", "kind")


def _documents(spark, d):
    """Alert documents of the valid rows, with two kinds of bad rows among them."""
    rows = src.detections(spark, d).select("obj_id", F.struct("mjd", F.when(F.col("fid") == 3, F.lit(9)).otherwise(F.col("fid")).alias("fid"), F.col("mag").alias("magpsf"), F.when(F.col("magerr") < 0.05, -F.col("magerr")).otherwise(F.col("magerr")).alias("sigmapsf")).alias("r"))
    return rows.groupBy("obj_id").agg(F.to_json(F.struct(F.collect_list("r").alias("detections"))).alias("doc"))


@query("parse_alert_json", "select obj_id, count(*) as n, round(sum(mag), 4) + 0.0 as s from det where fid <> 3 and magerr >= 0.05 and mag is not null group by obj_id")
def parse_alert_json(spark, d):
    return io.parse_alerts(_documents(spark, d)).groupBy("obj_id").agg(F.count("*").alias("n"), (F.round(F.sum("magpsf"), 4) + F.lit(0.0)).alias("s"))


_MERGE = """al as (select obj_id, mjd, mag, magerr from det where fid = 1 and mag is not null), hi as (select obj_id, mjd, mag + 1 as mag, magerr from det where mag is not null),
u as (select *, 0 as rank from al union all select *, 1 from hi), m as (select *, row_number() over (partition by obj_id, round(mjd, 5) order by rank, mjd, mag, magerr) as n from u)"""


@query("merge_alert_history", f"{_MERGE} select obj_id, count(*) as n, count(*) filter (where rank = 0) as n_alert, round(sum(mag), 4) + 0.0 as s from m where n = 1 group by obj_id")
def merge_alert_history(spark, d):
    det = src.detections(spark, d).where("mag is not null")
    m = io.merge_history(det.where("fid = 1").select("obj_id", "mjd", "mag", "magerr"), det.select("obj_id", "mjd", (F.col("mag") + 1).alias("mag"), "magerr"))
    return m.groupBy("obj_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 0).alias("n_alert"), (F.round(F.sum("mag"), 4) + F.lit(0.0)).alias("s"))


@query("dedupe_min_error", "select obj_id, fid, day, round(min(magerr), 6) + 0.0 as magerr from (select *, round(mjd, 0) as day from det) group by obj_id, fid, day")
def dedupe_min_error(spark, d):
    x = io.smallest_error(src.detections(spark, d), 0)
    return x.select("obj_id", "fid", F.round("mjd", 0).alias("day"), r6("magerr").alias("magerr"))


def _survey_lists(spark, d):
    """The path of one row per object with list columns, a type and a padded id."""
    det = src.detections(spark, d).where("mag is not null")
    lists = det.groupBy("obj_id").agg(F.collect_list(F.struct("mjd", F.when(F.col("fid") == 1, 4096).otherwise(0).alias("flag"), "mag")).alias("r"))
    snid, kind = F.rpad(F.col("obj_id").cast("string"), 12, " "), F.when(F.col("obj_id") % 3 == 0, "SN").otherwise("other")
    path = io.scratch(spark, "survey")
    lists.select("obj_id", snid.alias("snid"), kind.alias("obj_type"), F.col("r.mjd").alias("mjd"), F.col("r.flag").alias("photflag"), F.col("r.mag").alias("mag")).write.parquet(path)
    return path


def _survey_counts(rows):
    return rows.groupBy("obj_id").agg(F.count("*").alias("n"), F.count_if(F.col("photflag").bitwiseAND(4096) > 0).alias("detected"))


@query("explode_survey_lists", "select obj_id, count(*) as n, count(*) filter (where fid = 1) as detected from det where mag is not null and obj_id in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')) group by obj_id")
def explode_survey_lists(spark, d):
    """The objects named in a table of padded ids, which grows with the data. explode_all_survey_lists has every object."""
    wanted = src.table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    ids = wanted.select(F.rpad(F.col("c_custkey").cast("string"), 12, " ").alias("snid"))
    return _survey_counts(io.read_survey_lists(spark, _survey_lists(spark, d), ids))


@query("explode_all_survey_lists", "select obj_id, count(*) as n, count(*) filter (where fid = 1) as detected from det where mag is not null group by obj_id")
def explode_all_survey_lists(spark, d):
    """Lists of all objects, written, read back and unrolled."""
    return _survey_counts(io.read_survey_lists(spark, _survey_lists(spark, d)))


@query("explode_survey_lists_of_type", "select obj_id, count(*) as n, count(*) filter (where fid = 1) as detected from det where mag is not null and obj_id % 3 = 0 group by obj_id")
def explode_survey_lists_of_type(spark, d):
    """As explode_all_survey_lists for one type, which the read is told."""
    return _survey_counts(io.read_survey_lists(spark, _survey_lists(spark, d), kind="SN"))


@query("scan_staged_crossmatch", "select o.obj_id, round(c.ext, 6) + 0.0 as ext, round(case when c.r_kron <> -999 then c.r_kron end, 6) + 0.0 as r_kron from pos o left join cat c on c.src_id = o.obj_id + 97")
def scan_staged_crossmatch(spark, d):
    """Staged nearest-source rows: a missing row gives NULLs, never a lookup."""
    staged = src.catalogue(spark, d).select((F.col("src_id") - 97).alias("obj_id"), "ext", "r_kron")
    return src.positions(spark, d).join(staged, "obj_id", "left").select("obj_id", r6("ext").alias("ext"), r6(ph.null_if(F.col("r_kron"), -999.0)).alias("r_kron"))


@query("sink_feature_table", "select obj_id, h.horizon, count(*) as n_obs_total, count(distinct band) as n_bands, round(max(dt), 6) + 0.0 as span_total from phot join (values (5), (10), (20)) h(horizon) on dt <= h.horizon group by 1, 2")
def sink_feature_table(spark, d):
    phot = _phot(spark, d)
    parts = [lc.global_cadence(lc.horizon_truncate(phot, h)).withColumn("horizon", F.lit(h)) for h in (5, 10, 20)]
    kept = io.feature_sink(parts[0].unionByName(parts[1]).unionByName(parts[2]), io.scratch(spark, "features"))
    return kept.withColumn("span_total", r6("span_total"))


_UPS = "old as (select user_id as key, max(event_id) as v from events where event_id % 3 <> 0 group by 1), new as (select user_id as key, max(event_id) as v from events where event_id % 3 = 0 group by 1)"


def _halves(spark, d):
    e = src.table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id")
    part = lambda c: e.where(c).groupBy("key").agg(F.max("event_id").alias("v"))
    return part("event_id % 3 <> 0"), part("event_id % 3 = 0")


@query("incremental_upsert", f"{_UPS} select key, max(v) as v from (select * from old union all select * from new) group by key")
def incremental_upsert(spark, d):
    old, new = _halves(spark, d)
    return io.upsert(old, new, "key", "v")


@query("append_store", f"{_UPS} select key, v, (select max(v) from old where key % 2 = 0) as since from new where key not in (select key from old where key % 2 = 0)")
def append_store(spark, d):
    old, new = _halves(spark, d)
    store = old.where("key % 2 = 0")
    since = store.agg(F.max("v").alias("m")).first()["m"]
    return io.append_new(store, new, "key").select("key", "v", F.lit(since).cast("long").alias("since"))


@query("strict_json_report", "select obj_id, '{\"n\":' || count(*) || ',\"missing\":' || coalesce((case when obj_id % 2 = 0 then null else 1 end)::varchar, 'null') || ',\"bands\":[' || min(fid) || ',' || max(fid) || ']}' as doc from det group by obj_id")
def strict_json_report(spark, d):
    """Nested results as JSON: what is not finite becomes null, and no field is left out."""
    g = src.detections(spark, d).groupBy("obj_id").agg(F.count("*").alias("n"), F.min("fid").alias("a"), F.max("fid").alias("b"))
    bad = F.when(F.col("obj_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    doc = F.to_json(F.struct("n", ph.finite_or_null(bad).cast("int").alias("missing"), F.array("a", "b").alias("bands")), {"ignoreNullFields": "false"})
    return g.select("obj_id", doc.alias("doc"))


_DIGESTED = ("event_id::varchar", "event_type", "props", "epoch_us(ts)::varchar", "user_id::varchar", "value::varchar")
_ROW = "md5(concat_ws('|', " + ", ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in _DIGESTED) + "))"


def _digestible(spark, d):
    """The events with their instants as microseconds, which is the text of them that both engines share."""
    return src.table(spark, d, "events").withColumn("ts", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))


@query("input_fingerprint", f"select count(*) as n, sum(('0x' || substr({_ROW}, 1, 15))::bigint::hugeint)::varchar as digest from events")
def input_fingerprint(spark, d):
    """The number of rows and the sum of the digests of all columns."""
    e = _digestible(spark, d)
    return e.agg(F.count("*").alias("n"), F.sum(integrity.row_number_of(integrity.row_digest(e))).cast("string").alias("digest"))


_LEAVES = """h as (select event_type as key, ts::date::varchar as day, {row} as m from events),
leaf as (select day as key, count(*) as n, md5(day || '|' || count(*) || '|' || sum(('0x' || substr(m, 1, 15))::bigint::hugeint)) as digest from h group by day),
branch as (select substr(md5(key), 1, 1) as node, md5(string_agg(key || '=' || digest, ',' order by key)) as digest from leaf group by 1),
root as (select 'root' as node, md5(coalesce(string_agg(node || '=' || digest, ',' order by node), '')) as digest from branch)
select 0 as level, key as node, digest from leaf union all select 1, node, digest from branch union all select 2, node, digest from root"""


@query("manifest_check", "select event_type, count(*) as n, false as ok from events group by 1 having max(ts) >= (select date_trunc('day', max(ts)) from events)")
def manifest_check(spark, d):
    """The entries of a manifest, written before the last day's rows came in, that the table no longer agrees with."""
    e = src.table(spark, d, "events")
    entries = lambda rows: integrity.partition_leaves(rows, "event_type").withColumnRenamed("key", "event_type")
    today = e.agg(F.date_trunc("day", F.max("ts")).alias("today"))
    stated = io.stored(entries(e.join(F.broadcast(today), F.col("ts") < F.col("today"))), "manifest")
    both = entries(e).join(stated.select("event_type", F.col("n").alias("stated_n"), F.col("digest").alias("stated")), "event_type", "left")
    both = both.withColumn("ok", F.coalesce((F.col("digest") == F.col("stated")) & (F.col("n") == F.col("stated_n")), F.lit(False)))
    return both.where("not ok").select("event_type", "n", "ok")


@query("partition_fingerprints", _LEAVES.format(row=_ROW))
def partition_fingerprints(spark, d):
    """A Merkle tree over the days of a table, from all its columns: two trees show which day has changed without another look at the rows."""
    e = _digestible(spark, d)
    dated = e.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86_400_000_000).cast("int")))
    return integrity.merkle_tree(integrity.partition_leaves(dated, "day", e.columns))


@query("changed_partitions", """x as (select user_id, ts, max(ts) over (partition by user_id) as last from events), d as (select distinct ts::date::varchar as day from x where user_id % 97 = 3 and ts = last)
select 0 as level, day as node, 'changed' as change from d union all select distinct 1, substr(md5(day), 1, 1), 'changed' from d union all select distinct 2, 'root', 'changed' from d""")
def changed_partitions(spark, d):
    """The nodes of the tree that tell of one corrected value each for some objects."""
    e = src.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    last = F.max("ts").over(Window.partitionBy("user_id"))
    mended = e.withColumn("props", F.when((F.col("user_id") % 97 == 3) & (F.col("ts") == last), F.concat(F.coalesce("props", F.lit("")), F.lit(" "))).otherwise(F.col("props")))
    tree = lambda rows: integrity.merkle_tree(integrity.partition_leaves(rows, "day"))
    return integrity.changed_nodes(tree(e), tree(mended))


@query("stored_file_faults")
def stored_file_faults(spark, d):
    """A table is stored with a manifest of its files, then one kind of event is written anew and another one taken out of the manifest."""
    path = io.scratch(spark, "vouched")
    e = src.table(spark, d, "events")
    e.write.partitionBy("event_type").parquet(path)
    manifest = io.stored(integrity.file_manifest(spark, path), "file-manifest")
    e.where("event_type = 'view' and user_id % 2 = 0").drop("event_type").write.mode("overwrite").parquet(f"{path}/event_type=view")
    listed = manifest.where(~F.contains("name", F.lit("event_type=click/")))
    faults = integrity.file_faults(listed, integrity.file_manifest(spark, path))
    return faults.groupBy(F.substring_index("name", "/", 1).alias("part"), "fault").agg(F.count("*").alias("n"))


@query("context_join", """h as (select src_id % 97 as obj_id, min(src_id) as host_id from cat where ext > 0.06 group by 1), z as (select src_id % 97 as obj_id, max(n_det) as z_n from cat group by 1), f as (select obj_id, count(*) as n from pre group by obj_id)
select f.obj_id, n, host_id, z_n from f left join h on f.obj_id = h.obj_id left join z on f.obj_id = z.obj_id""")
def context_join(spark, d):
    """Feature rows with two context blocks; each is deduplicated by key first, so a join can't multiply rows."""
    c = src.catalogue(spark, d).withColumn("obj_id", F.col("src_id") % 97)
    h = c.where("ext > 0.06").groupBy("obj_id").agg(F.min("src_id").alias("host_id"))
    z = c.groupBy("obj_id").agg(F.max("n_det").alias("z_n"))
    return _pre(spark, d).groupBy("obj_id").agg(F.count("*").alias("n")).join(h, "obj_id", "left").join(z, "obj_id", "left")


@query("context_projection", "o as (select obj_id, min(mag) as peak, max(dt) as span from pre group by obj_id) select obj_id, round(peak, 6) + 0.0 as peak, round(peak - 5 * log10((100 + obj_id)::double * 1e5), 6) + 0.0 as m_pseudo, c.n_det from o left join cat c on c.src_id = o.obj_id")
def context_projection(spark, d):
    """Only listed context columns enter; a supplied absolute magnitude is recomputed from the truncated peak."""
    o = _pre(spark, d).groupBy("obj_id").agg(F.min("mag").alias("peak"))
    c = src.catalogue(spark, d).select(F.col("src_id").alias("obj_id"), "n_det")
    return o.join(c, "obj_id", "left").select("obj_id", r6("peak").alias("peak"), r6(ph.absolute_magnitude(F.col("peak"), (100 + F.col("obj_id")).cast("double"))).alias("m_pseudo"), "n_det")


@query("left_semi_classes", "select obj_id, truth from sco where truth in (0, 2, 4)")
def left_semi_classes(spark, d):
    wanted = spark.createDataFrame([(0,), (2,), (4,)], "truth int")
    return src.scores(spark, d).select("obj_id", "truth").join(F.broadcast(wanted), "truth", "left_semi").select("obj_id", "truth")


_SEEN = "seen as (select o_custkey as id from orders where o_orderkey % 2 = 0 union select l_suppkey from lineitem where l_quantity > 49)"


def _seen(spark, d):
    a = src.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return a.union(src.table(spark, d, "lineitem").where("l_quantity > 49").select("l_suppkey"))


@query("left_anti_seen", f"{_SEEN} select c_custkey as id from customer where c_custkey not in (select id from seen)")
def left_anti_seen(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(_seen(spark, d), "id", "left_anti")


@query("except_ids", f"{_SEEN} select c_custkey as id from customer except select id from seen")
def except_ids(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(_seen(spark, d))


@query("intersect_known_unknown", f"{_SEEN} select c_custkey as id from customer intersect select id from seen")
def intersect_known_unknown(spark, d):
    return src.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(_seen(spark, d))


_BOX = """bx as (select o.obj_id, c.src_id, c.ext, c.r_kron, c.n_det, 3600::double * sqrt(pow(((c.ra - o.ra + 540) % 360 - 180) * cos(radians(o.decl)), 2) + pow(c.decl - o.decl, 2)) as sep from pos o join cat c on abs(c.decl - o.decl) <= {h}::double / 3600 and abs((c.ra - o.ra + 540) % 360 - 180) <= least(180, {h}::double / 3600 / greatest(cos(radians(o.decl)), 1e-9)) and c.n_det >= 3)"""


def _box(spark, d, half):
    return sky.box_crossmatch(src.positions(spark, d), src.catalogue(spark, d).where("n_det >= 3"), half, ["src_id", "ext", "r_kron", "n_det"])


@query("box_crossmatch", _BOX.format(h=25.5) + " select obj_id, src_id, round(sep, 5) + 0.0 as sep from bx")
def box_crossmatch(spark, d):
    return _box(spark, d, 25.5).select("obj_id", "src_id", (F.round("sep", 5) + F.lit(0.0)).alias("sep"))


@query("nearest_source", _BOX.format(h=6.7) + " select obj_id, src_id, round(sep, 3) + 0.0 as sep from (select *, row_number() over (partition by obj_id order by round(sep, 6), src_id) as n from bx) where n = 1")
def nearest_source(spark, d):
    x = _box(spark, d, 6.7).withColumn("sep", F.round("sep", 6))
    return sky.nearest(x, "src_id").select("obj_id", "src_id", (F.round("sep", 3) + F.lit(0.0)).alias("sep"))


@query("host_environment", _BOX.format(h=25.5) + ", e as (select *, ext > 0.06 and r_kron <> -999 as x from bx) select obj_id, round(min(sep), 5) + 0.0 as near_sep, round(min(sep) filter (where x), 5) + 0.0 as host_sep, count(*) filter (where x) as n_ext from e group by obj_id")
def host_environment(spark, d):
    e = sky.environment(_box(spark, d, 25.5))
    return e.select("obj_id", (F.round("near_sep", 5) + F.lit(0.0)).alias("near_sep"), (F.round("host_sep", 5) + F.lit(0.0)).alias("host_sep"), "n_ext")


@query("host_mismatch_flag", _BOX.format(h=25.5) + ", e as (select *, ext > 0.06 and r_kron <> -999 as x from bx), h as (select obj_id, min(sep) filter (where x) as hs, max(ext) filter (where x) as he, min(sep) as ns from e group by obj_id) select obj_id, coalesce(hs < 15 and he > 0.3 and not (ns < 4), false) as mismatch from h")
def host_mismatch_flag(spark, d):
    x = (F.col("ext") > 0.06) & (F.col("r_kron") != -999.0)
    h = _box(spark, d, 25.5).groupBy("obj_id").agg(F.min(F.when(x, F.col("sep"))).alias("hs"), F.max(F.when(x, F.col("ext"))).alias("he"), F.min("sep").alias("ns"))
    return h.select("obj_id", F.coalesce((F.col("hs") < 15) & (F.col("he") > 0.3) & ~(F.col("ns") < 4), F.lit(False)).alias("mismatch"))


@query("photoz_join", _BOX.format(h=25.5) + " select bx.obj_id, bx.src_id, round(s.s_acctbal / 10000, 6) + 0.0 as z from bx join supplier s on s.s_suppkey = bx.src_id")
def photoz_join(spark, d):
    z = src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src_id"), (F.col("s_acctbal") / 10000).alias("z"))
    return _box(spark, d, 25.5).join(z, "src_id").select("obj_id", "src_id", r6("z").alias("z"))


@query("crossmatch_with_fallback", _BOX.format(h=25.5) + ", a as (select obj_id, max(case when r_kron <> -999 then r_kron end) as v from bx where src_id % 3 = 0 group by obj_id), b as (select obj_id, max(r_kron) as v from bx where src_id % 3 = 1 and r_kron <> -999 group by obj_id) select coalesce(a.obj_id, b.obj_id) as obj_id, round(coalesce(a.v, b.v), 6) + 0.0 as v, case when a.v is not null then 'A' when b.v is not null then 'B' end as survey from a full join b on a.obj_id = b.obj_id")
def crossmatch_with_fallback(spark, d):
    """Survey B where A has no usable value: one aggregation with both as conditions."""
    x = _box(spark, d, 25.5).where("src_id % 3 < 2")
    kron = ph.null_if(F.col("r_kron"), -999.0)
    v = x.groupBy("obj_id").agg(F.max(F.when(F.col("src_id") % 3 == 0, kron)).alias("a"), F.max(F.when(F.col("src_id") % 3 == 1, kron)).alias("b"), F.count_if(F.col("src_id") % 3 == 0).alias("na"))
    v = v.where((F.col("na") > 0) | F.col("b").isNotNull())
    return v.select("obj_id", r6(F.coalesce("a", "b")).alias("v"), F.when(F.col("a").isNotNull(), "A").when(F.col("b").isNotNull(), "B").alias("survey"))


@query("grid_expand", "o as (select distinct obj_id from pre) select obj_id, band, day from o, (select unnest([0, 1]) as band), (select unnest([11, 15, 20, 25, 30, 40, 50, 60, 75, 90]) as day) where day > 20")
def grid_expand(spark, d):
    days = [x for x in (11, 15, 20, 25, 30, 40, 50, 60, 75, 90) if x > 20]
    o = _pre(spark, d).select("obj_id").distinct()
    return o.select("obj_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("band")).select("obj_id", "band", F.explode(F.array(*map(F.lit, days))).alias("day"))


_ANCHOR = "peak as (select obj_id, min(mag) as peak from phot where dt <= 10 group by obj_id), anch as (select p.obj_id, p.band, arg_max(p.mag, (p.dt, -p.mag)) - any_value(k.peak) as anchor from phot p join peak k on p.obj_id = k.obj_id where p.dt <= 10 group by p.obj_id, p.band)"


def _anchors(spark, d, days=10):
    """Per object and band the last magnitude at the horizon, relative to the prefix peak of any band."""
    p = lc.horizon_truncate(_phot(spark, d), days).withColumn("peak", F.min("mag").over(lc.per_object()))
    return p.groupBy("obj_id", "band").agg((F.max(F.struct("dt", (-F.col("mag")).alias("m")))["m"] * -1 - F.first("peak")).alias("anchor"), F.first("peak").alias("peak"))


@query("band_anchor", f"{_ANCHOR} select obj_id, band, round(anchor, 6) + 0.0 as anchor from anch")
def band_anchor(spark, d):
    return _anchors(spark, d).select("obj_id", "band", r6("anchor").alias("anchor"))


@query("future_targets", f"{_ANCHOR} select p.obj_id, p.band, round(p.dt, 6) + 0.0 as day, round(p.mag - k.peak, 6) + 0.0 as target, round(anchor, 6) + 0.0 as anchor from phot p join anch a on p.obj_id = a.obj_id and p.band = a.band join peak k on k.obj_id = p.obj_id where p.dt > 10 and p.dt <= 90 and p.band < 2")
def future_targets(spark, d):
    return _future(spark, d).select("obj_id", "band", r6("day").alias("day"), r6("target").alias("target"), r6("anchor").alias("anchor"))


def _future(spark, d, days=10):
    rows = _phot(spark, d).where((F.col("dt") > days) & (F.col("dt") <= 90) & (F.col("band") < 2))
    return rows.join(_anchors(spark, d, days), ["obj_id", "band"]).select("obj_id", "band", F.col("dt").alias("day"), (F.col("mag") - F.col("peak")).alias("target"), "anchor")


_RECENT = """rb as (select *, row_number() over (partition by obj_id, band order by dt desc) as back from (select obj_id, band, dt, mag, row_number() over (partition by obj_id, band, mjd order by mag, magerr) as rn from phot where dt <= 10) where rn = 1),
rec as (select obj_id, band, max(mag) filter (where back = 1) as last_mag, 10 - max(dt) as age, case when count(*) filter (where back <= 5) >= 2 then regr_slope(mag, dt) filter (where back <= 5) end as slope, case when count(*) filter (where back <= 5) >= 2 then stddev_pop(mag) filter (where back <= 5) end as scatter from rb group by obj_id, band)"""


def _recent(spark, d, days=10):
    b = lc.dedupe_same_time(lc.horizon_truncate(_phot(spark, d), days))
    b = b.withColumn("back", F.row_number().over(lc.per_band().orderBy(F.desc("dt")))).where("back <= 5")
    two = F.count("*") >= 2
    return b.groupBy("obj_id", "band").agg(F.max(F.when(F.col("back") == 1, F.col("mag"))).alias("last_mag"), (days - F.max("dt")).alias("age"), F.when(two, F.regr_slope("mag", "dt")).alias("slope"), F.when(two, F.stddev_pop("mag")).alias("scatter"))


@query("recent_state", f"{_RECENT} select obj_id, band, round(last_mag, 6) + 0.0 as last_mag, round(age, 6) + 0.0 as age, round(slope, 4) + 0.0 as slope, round(scatter, 6) + 0.0 as scatter from rec")
def recent_state(spark, d):
    return _recent(spark, d).select("obj_id", "band", r6("last_mag").alias("last_mag"), r6("age").alias("age"), (F.round("slope", 4) + F.lit(0.0)).alias("slope"), r6("scatter").alias("scatter"))


@query("attach_recency", f"{_ANCHOR}, {_RECENT} select p.obj_id, p.band, round(p.dt, 6) + 0.0 as day, round(r.age, 6) + 0.0 as age from phot p join anch a on p.obj_id = a.obj_id and p.band = a.band left join rec r on r.obj_id = p.obj_id and r.band = p.band where p.dt > 10 and p.dt <= 90 and p.band < 2")
def attach_recency(spark, d):
    return _future(spark, d).join(_recent(spark, d), ["obj_id", "band"], "left").select("obj_id", "band", r6("day").alias("day"), r6("age").alias("age"))


_KNOTS = "kn as (select x, y, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from (values (0.0::double, 1.0::double), (10, 3), (25, 2), (50, 7)) v(x, y))"


@query("lookup_interpolate", f"{_KNOTS}, q as (select p_partkey, p_size - 3.5::double as x from part) select p_partkey, round(coalesce(kn.y + (q.x - kn.x) / (x1 - kn.x) * (y1 - kn.y), case when q.x < 0 then 1 else 7 end), 6) + 0.0 as y from q left join kn on q.x >= kn.x and q.x < kn.x1")
def lookup_interpolate(spark, d):
    """Linear interpolation between a few fixed knots, clamped outside: a chain of conditions, no join."""
    knots = [(0.0, 1.0), (10.0, 3.0), (25.0, 2.0), (50.0, 7.0)]
    x = F.col("p_size") - 3.5
    y = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        y = F.when(x < x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(y)
    return src.table(spark, d, "part").select("p_partkey", r6(F.when(x < 0, knots[0][1]).otherwise(y)).alias("y"))


@query("step_lookup", "e as (select distinct o_orderdate as edge, o_custkey as c from orders), s as (select k.c, l.event_id, l.ts from events l join (select distinct c from e) k on k.c = l.user_id) select s.event_id, (select max(edge)::date from e where e.c = s.c and e.edge <= s.ts - interval 26 year) as edge from s")
def step_lookup(spark, d):
    """As-of lookup by key: the last edge at or before each row, from one ordered window over both."""
    e = src.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp_ntz").alias("t")).distinct().withColumn("edge", F.col("t")).withColumn("event_id", F.lit(None).cast("long"))
    v = src.table(spark, d, "events").select(F.col("user_id").alias("c"), (F.col("ts").cast("timestamp_ntz") - F.expr("interval 26 years")).alias("t"), F.lit(None).cast("timestamp_ntz").alias("edge"), "event_id")
    v = v.join(e.select("c").distinct(), "c", "left_semi")
    w = Window.partitionBy("c").orderBy("t", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.unionByName(v).withColumn("edge", F.last("edge", True).over(w)).where("event_id is not null").select("event_id", F.col("edge").cast("date").alias("edge"))


@query("bin_lookup", "select obj_id, case when n <= 10 then 0 when n <= 20 then 1 when n <= 40 then 2 else 3 end as bin, n from (select obj_id, count(*) as n from phot group by obj_id)")
def bin_lookup(spark, d):
    n = _phot(spark, d).groupBy("obj_id").agg(F.count("*").alias("n"))
    return n.select("obj_id", F.when(F.col("n") <= 10, 0).when(F.col("n") <= 20, 1).when(F.col("n") <= 40, 2).otherwise(3).alias("bin"), "n")


@query("partition_disjointness", "select count(*) as objects, count(*) filter (where s > 1) as in_two from (select obj_id, count(distinct split) as s from sco group by obj_id)")
def partition_disjointness(spark, d):
    s = src.scores(spark, d).groupBy("obj_id").agg((F.min("split") != F.max("split")).alias("two"))
    return s.agg(F.count("*").alias("objects"), F.count_if("two").alias("in_two"))


@query("paired_alignment_check", "a as (select obj_id, truth from sco where obj_id % 3 <> 0), b as (select obj_id, truth from sco where obj_id % 5 <> 0) select (select count(*) from (select * from a except all select * from b)) as only_a, (select count(*) from (select * from b except all select * from a)) as only_b")
def paired_alignment_check(spark, d):
    """Rows of one method that the other lacks, both ways, from signed counts in one shuffle."""
    s = src.scores(spark, d).select("obj_id", "truth")
    n = s.where("obj_id % 3 <> 0").withColumn("w", F.lit(1)).union(s.where("obj_id % 5 <> 0").withColumn("w", F.lit(-1))).groupBy("obj_id", "truth").agg(F.sum("w").alias("w"))
    return n.agg(F.coalesce(F.sum(F.greatest("w", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("w"), F.lit(0))), F.lit(0)).alias("only_b"))


@query("prediction_replay_check", "select count(*) as n, count(*) filter (where abs(a - b) / greatest(abs(b), 1e-9) > 1e-5) as over, round(max(abs(a - b) / greatest(abs(b), 1e-9)), 6) + 0.0 as worst, count(*) filter (where (a is null) <> (b is null)) as nulls from (select x.p as a, case when x.obj_id % 7 = 0 then y.p + 1e-4 when x.obj_id % 11 = 0 then null else y.p end as b from plong x join plong y on x.obj_id = y.obj_id and x.cls = y.cls)")
def prediction_replay_check(spark, d):
    p = heads.long_probabilities(src.scores(spark, d)).select("obj_id", "cls", F.col("p").alias("a"))
    again = p.select("obj_id", "cls", F.when(F.col("obj_id") % 7 == 0, F.col("a") + 1e-4).when(F.col("obj_id") % 11 != 0, F.col("a")).alias("b"))
    both = p.join(again, ["obj_id", "cls"], "full_outer").withColumn("e", F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1e-9)))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("e") > 1e-5).alias("over"), r6(F.max("e")).alias("worst"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("nulls"))


@query("prefix_replay", f"{_BANDS} select r.obj_id, k, count(distinct band) as n_bands, round(max(dt), 6) + 0.0 as span, round(min(mag), 6) + 0.0 as peak from (select obj_id, mjd, band, mag, dt, row_number() over (partition by obj_id order by mjd, band, mag) as rn from bands) r join (select obj_id, count(*) as n from bands group by obj_id) c on r.obj_id = c.obj_id join (select unnest(generate_series(3, 400)) as k) on k <= n and rn <= k and (k <= 40 or k % 5 = 0) group by r.obj_id, k")
def prefix_replay(spark, d):
    """Additive features of every scheduled prefix by cumulative windows: one pass, no row is repeated for each prefix."""
    w = lc.per_object().orderBy("mjd", "band", "mag")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = _bands(spark, d).withColumn("k", F.row_number().over(w))
    seen = sum((F.max((F.col("band") == x).cast("int")).over(upto) for x in (0, 1, 2)), F.lit(0))
    b = b.select("obj_id", F.col("k").cast("long").alias("k"), seen.cast("long").alias("n_bands"), r6(F.max("dt").over(upto)).alias("span"), r6(F.min("mag").over(upto)).alias("peak"))
    return b.where("k between 3 and 40 or (k > 40 and k % 5 = 0)")


_MD5 = "('0x' || substr(md5({}), 1, 12))::bigint"


def _hash12(c):
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("long")


@query("stratified_kfold", f"select obj_id, (row_number() over (partition by truth order by {_MD5.format("obj_id || '/7'")}, obj_id) - 1) % 5 as fold from sco")
def stratified_kfold(spark, d):
    s = src.scores(spark, d).select("obj_id", "truth", _hash12(F.concat(F.col("obj_id").cast("string"), F.lit("/7"))).alias("h"))
    p = ranking.places(s, ["truth"], ["h", "obj_id"], F.shiftright("h", 40))
    return p.select("obj_id", ((F.col("place") - 1) % 5).cast("long").alias("fold"))


@query("stratified_split", f"select obj_id, case when r * 100 <= n * 70 then 'train' when r * 100 <= n * 85 then 'val' else 'test' end as part from (select obj_id, row_number() over (partition by truth order by {_MD5.format("obj_id || '/3'")}, obj_id) as r, count(*) over (partition by truth) as n from sco)")
def stratified_split(spark, d):
    s = src.scores(spark, d).select("obj_id", "truth", _hash12(F.concat(F.col("obj_id").cast("string"), F.lit("/3"))).alias("h"))
    p, r = ranking.places(s, ["truth"], ["h", "obj_id"], F.shiftright("h", 40)), F.col("place") * 100
    return p.select("obj_id", F.when(r <= F.col("all_place") * 70, "train").when(r <= F.col("all_place") * 85, "val").otherwise("test").alias("part"))


@query("hash_ordered_sample", "select c_custkey as id from customer order by sha256('salt' || c_custkey) limit 25")
def hash_ordered_sample(spark, d):
    return src.table(spark, d, "customer").orderBy(F.sha2(F.concat(F.lit("salt"), F.col("c_custkey").cast("string")), 256)).limit(25).select(F.col("c_custkey").alias("id"))


@query("capped_class_sample", "select obj_id, truth from (select obj_id, truth, row_number() over (partition by truth order by obj_id) as r from sco) where r <= 20")
def capped_class_sample(spark, d):
    w = Window.partitionBy("truth").orderBy("obj_id")
    return src.scores(spark, d).select("obj_id", "truth", F.row_number().over(w).alias("r")).where("r <= 20").drop("r")


@query("top_per_group", "select event_type, arg_max(user_id, (n, -user_id)) as obj_id, max(n) as n from (select event_type, user_id, count(*) as n from events group by 1, 2) group by event_type")
def top_per_group(spark, d):
    n = src.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    best = n.groupBy("event_type").agg(F.max(F.struct("n", (-F.col("user_id")).alias("u"))).alias("b"))
    return best.select("event_type", (-F.col("b.u")).alias("obj_id"), F.col("b.n").alias("n"))


@query("temporal_cohorts", "select year, case when o_orderdate < make_date(year, 1, 1) - 100 then 'history' when date_part('year', o_orderdate) = year then 'test' end as cohort, count(*) as n from orders, (values (1996), (1997)) y(year) where o_orderdate < make_date(year, 1, 1) - 100 or date_part('year', o_orderdate) = year group by 1, 2")
def temporal_cohorts(spark, d):
    o = src.table(spark, d, "orders").select("o_orderdate", F.explode(F.array(F.lit(1996), F.lit(1997))).alias("year"))
    start = F.make_date("year", F.lit(1), F.lit(1))
    cohort = F.when(F.col("o_orderdate").cast("date") < F.date_sub(start, 100), "history").when(F.year("o_orderdate") == F.col("year"), "test")
    return o.withColumn("cohort", cohort).where("cohort is not null").groupBy("year", "cohort").agg(F.count("*").alias("n"))


@query("best_band", "g as (select obj_id, band, max(mag) - min(mag) - 3 as gain from phot group by obj_id, band) select obj_id, case when max(gain) > 0 then arg_max(band, (gain, -band)) end as band from g group by obj_id")
def best_band(spark, d):
    g = _phot(spark, d).groupBy("obj_id", "band").agg((F.max("mag") - F.min("mag") - 3).alias("gain"))
    b = g.groupBy("obj_id").agg(F.max(F.struct("gain", (-F.col("band")).alias("nb"), "band")).alias("b"))
    return b.select("obj_id", F.when(F.col("b.gain") > 0, F.col("b.band")).alias("band"))


@query("union_tiers", "select id, min(tier) as tier from (select o_custkey as id, 1 as tier from orders where o_orderkey % 5 = 0 union all select c_custkey, 2 from customer) group by id")
def union_tiers(spark, d):
    a = src.table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id"), F.lit(1).alias("tier"))
    return a.unionByName(src.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("tier"))).groupBy("id").agg(F.min("tier").alias("tier"))


@query("union_splits_tagged", "select split, count(*) as n, count(*) - count(distinct obj_id) as duplicates from sco group by split")
def union_splits_tagged(spark, d):
    s = src.scores(spark, d)
    tagged = [s.where(F.col("split") == x).select("obj_id", F.lit(x).alias("split")) for x in ("train", "val", "test")]
    u = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return u.groupBy("split", "obj_id").agg(F.count("*").alias("k")).groupBy("split").agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("duplicates"))


@query("pivot_methods", "select obj_id, round(max(p) filter (where cls = 0), 6) + 0.0 as m0, round(max(p) filter (where cls = 1), 6) + 0.0 as m1, round(max(p) filter (where cls = 2), 6) + 0.0 as m2 from plong group by obj_id")
def pivot_methods(spark, d):
    w = heads.long_probabilities(src.scores(spark, d)).groupBy("obj_id").pivot("cls", [0, 1, 2]).agg(F.max("p"))
    return w.select("obj_id", *(r6(str(i)).alias(f"m{i}") for i in range(3)))


@query("unpivot_scores", "select obj_id, 's' || (cls + 1) as scorer, round(raw, 6) + 0.0 as v from (select obj_id, unnest(raw) as raw, generate_subscripts(raw, 1) - 1 as cls from sco) where cls < 3")
def unpivot_scores(spark, d):
    wide = src.scores(spark, d).select("obj_id", *(F.element_at("raw", i).alias(f"s{i}") for i in (1, 2, 3)))
    return wide.unpivot("obj_id", ["s1", "s2", "s3"], "scorer", "v").select("obj_id", "scorer", r6("v").alias("v"))


@query("crosstab_normalised", "n as (select truth, fold, count(*) as n from sco group by 1, 2) select truth, fold, round(n / sum(n) over (partition by truth), 6) + 0.0 as share from n")
def crosstab_normalised(spark, d):
    n = src.scores(spark, d).groupBy("truth", "fold").agg(F.count("*").alias("n"))
    return n.select("truth", "fold", r6(F.col("n") / F.sum("n").over(Window.partitionBy("truth"))).alias("share"))


@query("class_census", "select coalesce(split, 'all') as split, count(*) filter (where truth = 0) as c0, count(*) filter (where truth = 1) as c1, count(*) filter (where truth = 5) as c5, count(*) as n from sco group by rollup(split)")
def class_census(spark, d):
    t = src.scores(spark, d).rollup("split").agg(*(F.count_if(F.col("truth") == c).alias(f"c{c}") for c in (0, 1, 5)), F.count("*").alias("n"))
    return t.select(F.coalesce("split", F.lit("all")).alias("split"), "c0", "c1", "c5", "n")


@query("context_missingness", "select r.src_id % 6 as cls, round(avg((r_kron = -999)::int), 6) + 0.0 as missing from cat r group by 1")
def context_missingness(spark, d):
    return src.catalogue(spark, d).groupBy((F.col("src_id") % 6).alias("cls")).agg(r6(F.avg(ph.null_if(F.col("r_kron"), -999.0).isNull().cast("double"))).alias("missing"))


@query("flat_annotations", "select obj_id, 'class=' || (list_position(p, list_max(p)) - 1) || '|novel=' || novel || '|fold=' || fold as annotation from prob")
def flat_annotations(spark, d):
    p = src.scores(spark, d).withColumn("p", heads.softmax(F.col("raw")))
    part = lambda name, c: F.concat(F.lit(name + "="), c.cast("string"))
    return p.select("obj_id", F.concat_ws("|", part("class", F.array_position("p", F.array_max("p")) - 1), part("novel", F.col("novel")), part("fold", F.col("fold"))).alias("annotation"))


@query("status_message", "select obj_id, 'object ' || obj_id || ': class ' || truth || case when novel then ', outside the taxonomy' else '' end || ', fold ' || fold || '.' as message from sco")
def status_message(spark, d):
    return src.scores(spark, d).select("obj_id", F.concat(F.format_string("object %d: class %d", "obj_id", "truth"), F.when(F.col("novel"), ", outside the taxonomy").otherwise(""), F.format_string(", fold %d.", "fold")).alias("message"))


@query("external_taxonomy_rows", "select obj_id, 'Transient' as taxonomy, case truth when 0 then 'Ia' when 1 then 'II' when 2 then 'SLSN' when 3 then 'AGN' when 4 then 'TDE' else 'Cataclysmic' end as classification from sco")
def external_taxonomy_rows(spark, d):
    names = F.create_map(*(F.lit(x) for kv in enumerate(("Ia", "II", "SLSN", "AGN", "TDE", "Cataclysmic")) for x in kv))
    return src.scores(spark, d).select("obj_id", F.lit("Transient").alias("taxonomy"), F.element_at(names, F.col("truth")).alias("classification"))


@query("ndet_bins", "c as (select n, count(*) as k from (select obj_id, count(*) as n from phot group by obj_id) group by n), r as (select n, k, sum(k) over (order by n) as cum, sum(k) over () as tot from c) select n, k, cum from r")
def ndet_bins(spark, d):
    """Counts of objects by detection count, cumulated: bins are cut from this table, one row per distinct count."""
    c = _phot(spark, d).groupBy("obj_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    return c.select("n", "k", F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("n")).alias("cum"))


@query("mondrian_alarm", """o as (select obj_id, count(*) as n, max(mag) - min(mag) as s from phot group by obj_id), b as (select *, case when n <= 25 then 0 else 1 end as bin from o),
r as (select a.obj_id, a.bin, (1 + (select count(*) from b c where c.bin = a.bin and c.obj_id % 2 = 1 and c.s >= a.s)) / (1.0::double + (select count(*) from b c where c.bin = a.bin and c.obj_id % 2 = 1)) as pv from b a where a.obj_id % 2 = 0)
select obj_id, bin, round(pv, 6) + 0.0 as pv, case when pv <= 0.01 then 0.01 when pv <= 0.05 then 0.05 when pv <= 0.1 then 0.1 end::double as far from r""")
def mondrian_alarm(spark, d):
    """p-value among reference objects with about as many detections, and the smallest false-alarm rate that flags."""
    o = _phot(spark, d).groupBy("obj_id").agg(F.count("*").alias("n"), (F.max("mag") - F.min("mag")).alias("s")).withColumn("bin", F.when(F.col("n") <= 25, 0).otherwise(1))
    got = heads.rank_counts(o.where("obj_id % 2 = 0").select("obj_id", "bin", "s"), o.where("obj_id % 2 = 1"), ["bin"], "s", lambda v: F.floor(v * 16))
    got = got.withColumn("pv", (1 + F.col("count")) / (F.col("n_ref") + 1))
    return got.select("obj_id", "bin", r6("pv").alias("pv"), F.when(F.col("pv") <= 0.01, 0.01).when(F.col("pv") <= 0.05, 0.05).when(F.col("pv") <= 0.1, 0.1).alias("far"))
