"""SQL text shared by the twins: the panel and its sources as CTEs (DuckDB)."""

from __future__ import annotations


def r(x: str, digits: int) -> str:
    """SQL of ``functions.numeric.half_up``."""
    return f"floor(({x})*1e{digits}+0.5+1e-6)/1e{digits}"


def risk_class(x: str) -> str:
    return (
        f"case when {x} >= 80 then 'Critico' when {x} >= 65 then 'Epidemia' "
        f"when {x} >= 50 then 'Alto' when {x} >= 25 then 'Moderado' when {x} is not null then 'Bajo' end"
    )


SOURCES = f"""
oc as (
  select o_orderkey, n_name as province, cast(o_orderdate as date) as od, o_orderstatus, o_orderpriority
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
climate as (
  select province, cast(extract(isoyear from l_shipdate) as int) as year,
    cast(extract(week from l_shipdate) as int) as week,
    cast(min(date_trunc('week', l_shipdate)) as date) as date,
    {r('avg(l_quantity)*6', 2)} as rainfall_mm,
    {r('22+max(l_quantity)*0.25', 2)} as temp_max_c,
    {r('15+min(l_quantity)*0.25', 2)} as temp_min_c,
    {r('18+avg(l_quantity)*0.35', 2)} as temp_avg_c,
    {r('40+avg(l_discount)*600', 2)} as humidity_pct,
    {r('avg(l_tax)*400', 2)} as wind_speed_kmh
  from lineitem join oc on l_orderkey = o_orderkey group by 1, 2, 3),
cases as (
  select province, cast(extract(isoyear from od) as int) as year, cast(extract(week from od) as int) as week,
    cast(count(*) as bigint) as cases,
    cast(count(*) filter (where o_orderstatus = 'F' and o_orderpriority like '1%') as bigint) as deaths
  from oc group by 1, 2, 3),
demo as (
  select n_name as province, cast(count(*)*100 as bigint) as population,
    cast(10+count(distinct c_mktsegment)*100 as int) as area_km2,
    {r("1e2*count(*) filter (where c_mktsegment in ('BUILDING','MACHINERY'))/count(*)", 2)} as urban_pct,
    {r('1e2*count(*) filter (where c_acctbal < 2500)/count(*)', 2)} as poverty_index
  from customer join nation on c_nationkey = n_nationkey group by 1),
enso as (
  select cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
    {r('(avg(o_totalprice)-(select avg(o_totalprice) from orders))/(select stddev_samp(o_totalprice) from orders)*5', 2)} as enso_index
  from orders group by 1, 2)"""

_RISK = (
    "least(greatest(least(greatest(incidence_rate_100k,0),100)/100*40"
    " + least(greatest(rainfall_mm,0),300)/300*25"
    " + least(greatest((temp_avg_c-20)/15,0),1)*20"
    " + least(greatest((humidity_pct-50)/50,0),1)*10"
    " + poverty_index/100*5, 0), 100)"
)

PANEL = f"""{SOURCES},
merged as (
  select c.*, coalesce(k.cases, 0) as cases, coalesce(k.deaths, 0) as deaths,
    d.population, d.area_km2, d.urban_pct, d.poverty_index,
    cast(month(c.date) as int) as month, e.enso_index,
    {r('coalesce(k.cases,0)/d.population*100000', 4)} as incidence_rate_100k
  from climate c left join cases k using (province, year, week) left join demo d using (province)
  left join enso e on e.year = year(c.date) and e.month = month(c.date)),
panel as (select *, {r(_RISK, 2)} as outbreak_risk_index from merged)"""


def over_panel(select: str, ctes: str = "") -> str:
    """A select over ``panel`` and the source CTEs, with further CTEs."""
    more = f",\n{ctes}" if ctes else ""
    return f"with {PANEL}{more}\n{select}"


def over_sources(select: str, ctes: str = "") -> str:
    more = f",\n{ctes}" if ctes else ""
    return f"with {SOURCES}{more}\n{select}"
