"""Registration of queries, and the adapter views in the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_VIEWS = """
det as (select user_id as obj_id, 60310::double + date_diff('microsecond', timestamp '2024-01-01', ts) / 86400000000.0::double as mjd,
  case event_type when 'view' then 1 when 'click' then 2 else 3 end as fid,
  case when value > 0 then 23.9::double - 2.5::double * log10(case when value > 0 then value end) end as mag,
  0.02::double + cast(json_extract_string(props, '$.k') as int) / 200.0::double as magerr
  from events where event_type in ('view', 'click', 'purchase')),
valid as (select * from det where mag is not null and magerr > 0 and magerr <= 1.0857::double / 3),
phot as (select obj_id, mjd, fid, fid - 1 as band, mag, magerr, mjd - min(mjd) over (partition by obj_id) as dt,
  pow(10::double, -0.4::double * (mag - 23.9::double)) as flux, log10(greatest(pow(10::double, -0.4::double * (mag - 23.9::double)), 1e-6::double)) as logflux,
  magerr / 2.5::double as logflux_err, magerr * pow(10::double, -0.4::double * (mag - 23.9::double)) / (2.5::double / ln(10::double)) as flux_err from valid),
pre as (select * from phot where dt <= 20),
pos as (select distinct user_id as obj_id, ((user_id * 137) % 3600) / 10.0::double as ra, ((user_id * 71) % 1200) / 10.0::double - 60 as decl from events),
cat as (select p_partkey as src_id, (((p_partkey % 97) * 137) % 3600) / 10.0::double + ((p_partkey * 53) % 61 - 30) / 3600.0::double as ra,
  (((p_partkey % 97) * 71) % 1200) / 10.0::double - 60 + ((p_partkey * 29) % 41 - 20) / 3600.0::double as decl,
  case when p_partkey % 11 = 0 then -999.0::double else 14.0::double + p_size * 0.15::double end as r_kron,
  ((p_partkey * 7) % 13 - 3) / 20.0::double as ext, p_size as n_det from part),
sco as (select vec_id as obj_id, label % 6 as truth, label = 9 as novel, vec_id % 5 as fold,
  case when vec_id % 20 < 14 then 'train' when vec_id % 20 < 17 then 'val' else 'test' end as split,
  list_transform(embedding[1:6], lambda x: x::double * 3) as raw, embedding as emb from embeddings),
prob as (select obj_id, truth, novel, fold, split, raw, list_transform(raw, lambda x: exp(x - list_max(raw)) / list_sum(list_transform(raw, lambda y: exp(y - list_max(raw))))) as p from sco),
plong as (select obj_id, truth, novel, fold, split, unnest(p) as p, generate_subscripts(p, 1) - 1 as cls from prob),
traj as (select obj_id, k, ((obj_id * 7919 + k * 104729) % 1000 + 1) / 1001.0::double as p from
  (select user_id as obj_id, row_number() over (partition by user_id order by ts, event_id) as k from events)
  where k between 3 and 40 or (k > 40 and k % 5 = 0))
"""


def sql(body: str) -> str:
    """body with the adapter views; body may start with further views, as in `x as (...), y as (...) select ...`."""
    body = body.strip()
    return f"with {_VIEWS.strip()}" + (f",\n{body}" if not body.lower().startswith("select") else f"\n{body}")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero: engines differ in the last bits of sums."""
    return F.round(c, 6) + F.lit(0.0)
