"""The jobs as queries: each runs twice into a folder of its own and gives its whole output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramweave.plans import inputs
from gramweave.plans.registry import DIGITS, rounded
from gramweave.session import shared_root
from jobs import feature_selection, population_geometry
from jobs.common import Config, own_configuration


def _twice(run: Callable[[SparkSession, Config], DataFrame], spark: SparkSession, config: Config) -> DataFrame:
    run(spark, config)
    return rounded(run(spark, config))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that stays."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_population_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    config = own_configuration(spark, population_geometry.__file__, measurements=f"{sf_dir}/lineitem.parquet", subjects=f"{sf_dir}/supplier.parquet", output=f"{folder}/geometry")
    return _twice(population_geometry.run, spark, config)


def job2_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")  # a stream takes one file by a pattern alone
    config = own_configuration(spark, feature_selection.__file__, documents=f"{sf_dir}/documents.{{parquet}}", state=f"{folder}/state", output=f"{folder}/ranking")
    return _twice(feature_selection.run, spark, config)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_population_geometry, job2_feature_selection)}

_GEOMETRY = ("mean_distance", "rms_distance", "max_distance", "own_class", "other_class", "margin")
_GENES = ("mean", "variance", "detection", "prevalence", "score")


def _round(columns: tuple[str, ...]) -> str:
    """As the files have them, then as the query does."""
    return ", ".join(f"round(round({c}, 9), {DIGITS}) + 0.0 as {c}" for c in columns)


ORACLES: dict[str, str] = {
    "job1_population_geometry": f"""
with {inputs.DISTANCES}, {inputs.SUBJECTS},
every as (select coalesce(sub.s, ops.s) as s, y, case when sub.s is null then 'no subject' when ops.s is null then 'no measurements' when y is null then 'no label'
  when not coalesce(isfinite(a) and isfinite(b) and isfinite(c), false) then 'not finite' end as reason from sub full join ops on sub.s = ops.s),
kept as (select s, y from every where reason is null),
both_d as (select p, s, t, d from d union all select p, t, s, d from d),
far as (select p, f.s, count(*) as n_pairs, avg(d) as mean_distance, sqrt(avg(d * d)) as rms_distance, max(d) as max_distance, avg(d) filter (k.y = x.y) as own_class, avg(d) filter (k.y <> x.y) as other_class
  from both_d f join kept x on x.s = f.s join kept k on k.s = f.t group by p, f.s)
select * replace ({_round(_GEOMETRY)}) from (select p, s, y, reason, coalesce(n_pairs, 0) as n_pairs, mean_distance, rms_distance, max_distance, own_class, other_class, other_class - own_class as margin
  from (select * from every, grid) left join far using (p, s))""",
    "job2_feature_selection": f"""
with docs as (select row_number() over () as cell, coalesce(source, '(none)') as donor, regexp_extract_all(lower(text), '[a-z]+') as tokens from documents),
size as (select donor, count(*) as n_cells from docs group by donor),
val as (select cell, donor, gene, ln(1 + count(*) * 10000.0 / any_value(len(tokens))) as x from (select cell, donor, tokens, unnest(tokens) as gene from docs) group by cell, donor, gene),
st as (select donor, gene, sum(x) as x, sum(x * x) as x2, count(*) as det from val group by all),
gs as (select gene, m / k as mean, greatest(m2 / k - power(m / k, 2), 0) as variance, rate / k as detection, present / k as prevalence from (
  select gene, sum(x / n_cells) as m, sum(x2 / n_cells) as m2, sum(det / n_cells) as rate, count(*) as present, (select count(*) from size) as k from st join size using (donor) group by gene)),
full_g as (select gene, round(mean, 9) as mean, round(variance, 9) as variance, round(detection, 9) as detection, round(prevalence, 9) as prevalence, round(variance / greatest(mean, 1e-12), 9) as fano from gs),
g as (select * from full_g where prevalence >= 0.9 and detection >= 0.02 and variance > 0),
v as (select gene, log10(greatest(mean, 1e-12)) as x, log10(greatest(variance, 1e-12)) as y from g),
e as (select count(*) as n, list_distinct(quantile_cont(x, list_transform(range(41), lambda k: k / 40.0))) as q, median(y) as level from v),
b as (select v.*, len(list_filter(list_sort(q)[2 : len(q) - 1], lambda z: x > z)) as bin from v, e),
tr as (select median(x) as cx, median(y) as cy from b group by bin),
res as (select gene, case when (select n from e) >= 100 then y - (case when (select len(q) from e) < 5 then (select level from e) else coalesce(lo.cy + (hi.cy - lo.cy) * (x - lo.cx) / (hi.cx - lo.cx), lo.cy, hi.cy) end) end as r
  from b asof left join tr lo on b.x >= lo.cx asof left join tr hi on b.x < hi.cx),
scores as (select 'variance' as method, gene, variance as score from g union all select 'fano', gene, fano from g union all select 'hvg_residual', gene, round(r, 9) from res)
select * replace ({_round(_GENES)}) from (select method, gene, mean, variance, detection, prevalence, score, cast(row_number() over (partition by method order by score desc, gene) as int) as rank from scores join g using (gene) where score is not null)""",
}
