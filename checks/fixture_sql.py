"""The fixture views as SQL for DuckDB, put together as CTEs with what they depend on."""

from __future__ import annotations

import re

# Band bounds, labels and colours that results must show.
BAND_CASE = (
    "case when hours < 0 then 0 when hours < cast(0.501 as double) then 1 "
    "when hours < cast(1.01 as double) then 2 when hours < cast(2.01 as double) then 3 "
    "when hours < cast(4.01 as double) then 4 when hours < cast(8.01 as double) then 5 "
    "when hours < cast(16.01 as double) then 6 when hours < cast(32.01 as double) then 7 "
    "when hours < 100 then 8 else 0 end"
)
LABEL_CASE = (
    "case {0} when 1 then '0 to 30 minutes' when 2 then '30 minutes to 1 hour' "
    "when 3 then '1 to 2 hours' when 4 then '2 to 4 hours' when 5 then '4 to 8 hours' "
    "when 6 then '8 to 16 hours' when 7 then '16 to 32 hours' when 8 then '> 32 hours' end"
)
COLOUR_CASE = (
    "case {0} when 1 then 'darkgreen' when 2 then '#2ab72e' when 3 then 'lightgreen' "
    "when 4 then '#e3eb96' when 5 then '#f4f007' when 6 then '#FECC42' "
    "when 7 then '#f96a34' when 8 then 'red' end"
)
FACILITY_CASE = (
    "case {0} when 'allhf' then 'All health facilities' when 'allhosp' then 'All hospitals' "
    "when 'dhq' then 'District Headquarters' when 'privhosp' then 'Private hospitals' "
    "when 'govhosp' then 'Government hospitals' when 'hps' then 'Health posts and sub-health posts' "
    "when 'banks' then 'Commercial and development banks' "
    "when 'fi' then 'All financial institutions' else {0} end"
)
SEASON_CASE = (
    "case {0} when 'MSN' then 'Monsoon season' when 'MSNW' then 'Monsoon season (walking only)' "
    "when 'NM' then 'Normal times' when 'NMW' then 'Normal times (walking only)' else {0} end"
)
PERCENT = (
    "regexp_replace(cast(round(round_even({0}, 4) * 100, 2) as varchar), '\\.0$', '')"
)
DIGITS = "format('{{:,}}', cast(round_even({0}, 0) as bigint))"

VIEWS = {
    "fx_rows": """
select cast(max(o_orderkey) - max(o_orderkey) % 125 as double) / cast(125 as double) + cast(1 as double) as nrows from orders""",
    "fx_cells": """
select o_orderkey as cell, cast((o_orderkey - o_orderkey % 125) / 125 as int) as row_no, cast(o_orderkey % 125 as int) as col_no,
 (cast(o_orderkey % 125 as double) + cast(0.5 as double)) * cast(4 as double) as x,
 cast(500 as double) - (cast(cast((o_orderkey - o_orderkey % 125) / 125 as int) as double) + cast(0.5 as double)) * (cast(500 as double) / nrows) as y,
 case when o_orderkey % 97 = 0 then null when o_orderkey % 211 = 0 then cast(1.01 as double) when o_orderkey % 199 = 0 then cast(100 as double)
 else (o_totalprice / cast(500000 as double)) * (o_totalprice / cast(500000 as double)) * (o_totalprice / cast(500000 as double)) * cast(110 as double) - cast(2 as double) end as base_hours,
 coalesce(q, cast(0 as double)) as pop
 from orders cross join fx_rows left join (select l_orderkey, sum(l_quantity) as q from lineitem group by l_orderkey) l on o_orderkey = l_orderkey""",
    "fx_season": """
select * from (values (0,'NM'),(1,'NMW'),(2,'MSN'),(3,'MSNW')) t(s_idx,season)""",
    "fx_fac": """
select * from (values (0,'allhf'),(1,'allhosp'),(2,'dhq'),(3,'privhosp'),(4,'govhosp'),(5,'hps'),(6,'banks'),(7,'fi')) t(f_idx,fac_type)""",
    "fx_ct": """
select season, fac_type, cell, row_no, col_no,
 base_hours * (cast(1 as double) + cast(0.25 as double) * s_idx) * (cast(1 as double) + cast(0.125 as double) * f_idx) as hours
 from fx_cells cross join fx_season cross join fx_fac""",
    "fx_band": f"""
select season, fac_type, cell, row_no, col_no, {BAND_CASE} as band from fx_ct where hours is not null""",
    "fx_vertex": """
select i, j, cast(i * 100 + case when i in (0,5) then 0 else (i*37 + j*17) % 21 - 10 end as double) as x,
 cast(j * 100 + case when j in (0,5) then 0 else (i*13 + j*29) % 21 - 10 end as double) as y
 from (values (0),(1),(2),(3),(4),(5)) a(i) cross join (values (0),(1),(2),(3),(4),(5)) b(j)""",
    "fx_lgu_edge": """
select n_nationkey as id, seq, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from nation
 cross join (values (0,0,0,1,0),(1,1,0,1,1),(2,1,1,0,1),(3,0,1,0,0)) e(seq,a,b,c,d)
 join fx_vertex p on p.i = n_nationkey % 5 + a and p.j = cast((n_nationkey - n_nationkey % 5) / 5 as int) + b
 join fx_vertex q on q.i = n_nationkey % 5 + c and q.j = cast((n_nationkey - n_nationkey % 5) / 5 as int) + d""",
    "fx_lgu_cell": """
select cell, id from fx_cells join fx_lgu_edge on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
 group by cell, id having count(*) % 2 = 1""",
    "fx_adm2": """
select n_nationkey as id, concat('524 ', cast(n_regionkey + 1 as varchar), ' ', lpad(cast(n_nationkey as varchar), 2, '0'), ' 1 ', lpad(cast(n_nationkey as varchar), 3, '0')) as hlcit_code,
 n_name as lu_name, cast(n_regionkey + 1 as varchar) as state, case when n_nationkey = 23 then cast(0 as double) else p end as pop_sum
 from nation left join (select id, sum(pop) as p from fx_cells join fx_lgu_cell on fx_cells.cell = fx_lgu_cell.cell group by id) z on z.id = n_nationkey""",
    "fx_adm1": """
select state, sum(pop_sum) as pop_sum from fx_adm2 group by state""",
    "fx_physgeo": """
select hlcit_code as adm2_code, case cast((id - id % 5) / 5 as int) when 0 then 'Terai' when 1 then 'Shivalik' when 2 then 'Hill' when 3 then 'Mountain' else 'High Mountain' end as geog
 from fx_adm2 where id <> 24""",
    "fx_catch_edge": """
select s_suppkey as id, fac_type, seq, cast(cx + a * r as double) as x1, cast(cy + b * r as double) as y1, cast(cx + c * r as double) as x2, cast(cy + d * r as double) as y2
 from (select s_suppkey, cast(s_suppkey % 8 as int) as k, s_suppkey * 73 % 500 as cx, s_suppkey * 151 % 500 as cy, 8 + s_suppkey % 17 as r from supplier) s
 join fx_fac on f_idx = k cross join (values (0,1,0,0,1),(1,0,1,-1,0),(2,-1,0,0,-1),(3,0,-1,1,0)) e(seq,a,b,c,d)""",
    "fx_catch_cell": """
select cell, id, fac_type from fx_cells join fx_catch_edge on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
 group by cell, id, fac_type having count(*) % 2 = 1""",
    "fx_share": """
select season, fac_type, lu_name as adm_name, hlcit_code as adm2_code, state as province, band as trav_value, pop_sum as adm_pop, cat_pop, case when pop_sum > 0 then cat_pop / pop_sum end as pc_pop
 from (select t.season, t.fac_type, l.id, band, sum(pop) as cat_pop from fx_band t join fx_cells c on t.cell=c.cell join fx_lgu_cell l on l.cell=t.cell
 where band > 0 group by t.season, t.fac_type, l.id, band) s join fx_adm2 a on a.id = s.id""",
    "fx_labelled": f"""
select *, {LABEL_CASE.format("trav_value")} as trav_cat from fx_share""",
    "fx_province_share": f"""
select season, fac_type, s.state as adm_name, s.state as adm_code, band as trav_value, {LABEL_CASE.format("band")} as trav_cat,
 a.pop_sum as adm_pop, cat_pop, case when a.pop_sum > 0 then cat_pop / a.pop_sum end as pc_pop
 from (select t.season, t.fac_type, d.state, band, sum(pop) as cat_pop from fx_band t join fx_cells c on t.cell=c.cell join fx_lgu_cell l on l.cell=t.cell join fx_adm2 d on d.id = l.id
 where band > 0 group by t.season, t.fac_type, d.state, band) s join fx_adm1 a on a.state = s.state""",
    "fx_uncovered": """
select c.cell, c.row_no, c.col_no, c.pop, l.id from fx_cells c join fx_lgu_cell l on l.cell = c.cell
 where c.cell not in (select cell from fx_catch_cell)""",
    "fx_pooled": f"""
select adm_name, s.adm2_code, province, trav_value, trav_cat, adm_pop, cat_pop, pc_pop,
 season || '/' || lower(season) || '_' || fac_type || '_adm2.csv' as source,
 {SEASON_CASE.format("season")} as season, {FACILITY_CASE.format("fac_type")} as fac_type, geog
 from fx_labelled s left join fx_physgeo g on g.adm2_code = s.adm2_code""",
    "fx_final": """
select p.*, n.tot_pop, z.geog_pop, v.prov_pop from fx_pooled p
 cross join (select sum(x) as tot_pop from (select adm2_code, avg(adm_pop) as x from fx_pooled group by adm2_code) a) n
 left join (select geog, sum(x) as geog_pop from (select adm2_code, geog, avg(adm_pop) as x from fx_pooled where geog is not null group by adm2_code, geog) b group by geog) z on z.geog = p.geog
 left join (select province, sum(x) as prov_pop from (select adm2_code, province, avg(adm_pop) as x from fx_pooled group by adm2_code, province) c group by province) v on v.province = p.province""",
    "fx_complete": """
select * from fx_final where adm_name is not null and adm2_code is not null and province is not null and trav_value is not null and trav_cat is not null
 and adm_pop is not null and cat_pop is not null and pc_pop is not null and geog is not null and tot_pop is not null and geog_pop is not null and prov_pop is not null""",
}
# Views that are read several times and are costly to repeat.
_KEEP = {"fx_lgu_cell", "fx_catch_cell", "fx_share", "fx_cells", "fx_band", "fx_final"}

STATS = (
    "sum(cat_pop) as pop_in_band, round(avg(pc_pop), 6) as avg_pc_pop, "
    "round(stddev_samp(pc_pop), 6) as sd_pc_pop, "
    "round(quantile_cont(pc_pop, 0.25), 6) as q25, round(quantile_cont(pc_pop, 0.5), 6) as q50, "
    "round(quantile_cont(pc_pop, 0.75), 6) as q75, max(pc_pop) as max_pc_pop"
)


def with_views(body: str, **own: str) -> str:
    """``body`` preceded by the fixture views (and ``own`` ones) it reads, in order."""
    known = {**VIEWS, **own}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if known[name] is not text:
                    visit_view(name)

    def visit_view(name: str) -> None:
        text = known[name]
        for other in known:
            if other != name and other not in needed and re.search(rf"\b{other}\b", text):
                visit_view(other)
        if name not in needed:
            needed.append(name)

    visit(body)
    ctes = ",\n".join(
        f"{n} as {'materialized ' if n in _KEEP else ''}({known[n].strip()})" for n in needed
    )
    return f"with {ctes}\n{body.strip()}" if needed else body.strip()
