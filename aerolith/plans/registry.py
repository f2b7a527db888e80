"""The registered queries of the survey operators, and the SQL that must give the same rows.

Points come from lineitem, control points from supplier, a dense raster from embeddings.
Heights are rounded to six places on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith import adapters
from aerolith.functions.grid import densified, grid_of
from aerolith.operators import control, hydro, imagery, points, profile, quality, rectify, surfaces, terrain
from aerolith.schema import GridSpec

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero as zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cloud(spark: SparkSession, d: str, res: float = 1.0) -> tuple[DataFrame, GridSpec]:
    p = adapters.points(spark, d)
    return p, grid_of(p, res)


def raster(spark: SparkSession, d: str) -> tuple[DataFrame, GridSpec]:
    return adapters.dem(spark, d), adapters.dem_grid(spark, d)


PTS = adapters.POINTS_SQL.format(lineitem="lineitem")
GCP = adapters.CONTROL_SQL.format(supplier="supplier")


def _binned(res: float, source: str = "pts", box: str = "select min(x) mnx, max(x) mxx, min(y) mny, max(y) mxy from pts") -> str:
    """CTEs pts, w (grid size) and binned (points with r and c)."""
    return f"""pts as ({PTS}), w0 as ({box}),
w as (select *, greatest(1, cast(ceil((mxx-mnx)/CAST({res} AS DOUBLE)) as bigint)) wd, greatest(1, cast(ceil((mxy-mny)/CAST({res} AS DOUBLE)) as bigint)) ht from w0),
binned as (select p.*, least(greatest(cast(floor((mxy-y)/CAST({res} AS DOUBLE)) as bigint),0),ht-1) r, least(greatest(cast(floor((x-mnx)/CAST({res} AS DOUBLE)) as bigint),0),wd-1) c, wd, ht, mnx, mxy from {source} p, w)"""


DEM = "dem as (select vec_id r, cast(generate_subscripts(embedding,1)-1 as bigint) c, cast(unnest(embedding) as double) z from embeddings)"
ROUND = "round({0}, 6) + 0"


def _grad(source: str = "dem", z: str = "z", gx: str = "gx", gy: str = "gy", name: str = "g", extra: str = "") -> str:
    """CTE with the gradient of a dense raster."""
    return f"""{name}0 as (select r,c,{z} zz{extra}, lag({z}) over (partition by r order by c) w, lead({z}) over (partition by r order by c) e,
 lag({z}) over (partition by c order by r) n, lead({z}) over (partition by c order by r) s,
 lag(1) over (partition by r order by c) fw, lead(1) over (partition by r order by c) fe, lag(1) over (partition by c order by r) fn, lead(1) over (partition by c order by r) fs from {source}),
{name} as (select r,c,zz{extra}, case when fw is null and fe is null then 0 when fw is null then e-zz when fe is null then zz-w else (e-w)/2 end {gx},
 case when fn is null and fs is null then 0 when fn is null then s-zz when fs is null then zz-n else (s-n)/2 end {gy} from {name}0)"""


def _sql(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


@query(
    _sql(
        [f"pts as ({PTS})"],
        "select count(*) total_points, round(min(x),6) min_x, round(max(x),6) max_x, round(min(y),6) min_y, round(max(y),6) max_y, round(min(z),6) min_z, round(max(z),6) max_z, round(avg(z),6) mean_z,"
        " round(greatest(1, (max(x)-min(x))*(max(y)-min(y))),6) area, round(count(*)/greatest(1, (max(x)-min(x))*(max(y)-min(y))),6) density, "
        + ", ".join(f"round(quantile_cont(z, {p / 100}),2) z_p{p}" for p in points.QUANTILES)
        + " from pts",
    )
)
def pc_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.profile(adapters.points(spark, d)))


@query(_sql([f"pts as ({PTS})"], "select classification, case classification when 2 then 'Ground' when 4 then 'Medium Vegetation' when 5 then 'High Vegetation' end as label, count(*) n, round(count(*)*CAST(100 AS DOUBLE)/sum(count(*)) over (), 2) pct from pts group by classification"))
def pc_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return points.class_counts(adapters.points(spark, d))


@query(_sql([f"pts as ({PTS})"], "select return_number, count(*) n from pts group by return_number"))
def pc_return_counts(spark: SparkSession, d: str) -> DataFrame:
    return points.return_counts(adapters.points(spark, d))


_DENSE = "grid as (select cast(rr as bigint) r, cast(cc as bigint) c from (select unnest(range(ht)) rr, wd from w), lateral (select unnest(range(wd)) cc))"


@query(_sql([_binned(2.0), _DENSE, "n as (select r,c,count(*) n from binned group by r,c)"], 'select r as "row", c as col, round(coalesce(n,0)/CAST(4 AS DOUBLE),6) density from grid left join n using (r,c)'))
def pc_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.density(*cloud(spark, d, 2.0)))


@query(_sql([f"pts as ({PTS})"], "select pid, round(z + CAST(0.12 AS DOUBLE), 6) z from pts where z between 251 and 258"))
def pc_clean_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.clean(adapters.points(spark, d), 251.0, 258.0, shift=0.12).select("pid", "z"))


_STRIPS = [
    f"pts as ({PTS})",
    "s1 as (select * from pts where classification=2 and x<500060 and pid%2=0)",
    "s2 as (select pid,x,y,z+CAST(0.15 AS DOUBLE) z from pts where classification=2 and x>500040 and pid%2=1)",
    "bx as (select greatest((select min(x) from s1),(select min(x) from s2)) mnx, least((select max(x) from s1),(select max(x) from s2)) mxx, greatest((select min(y) from s1),(select min(y) from s2)) mny, least((select max(y) from s1),(select max(y) from s2)) mxy)",
    "bw as (select *, cast(ceil(mxx-mnx) as bigint) wd, cast(ceil(mxy-mny) as bigint) ht from bx)",
    *[f"m{i} as (select least(greatest(cast(floor(mxy-y) as bigint),0),ht-1) r, least(greatest(cast(floor(x-mnx) as bigint),0),wd-1) c, min(z) z from s{i}, bw where x between mnx and mxx and y between mny and mxy group by 1,2)" for i in (1, 2)],
    "diffs as (select r,c,m1.z-m2.z d from m1 join m2 using (r,c))",
]


@query(
    _sql(
        [*_STRIPS, "q as (select quantile_cont(d,0.05) lo, quantile_cont(d,0.95) hi, count(*) n from diffs)"],
        "select round(avg(d),6) mean_offset, round(quantile_cont(d,0.5),6) median_offset, round(stddev_pop(d),6) std_offset, count(*) trimmed_cells, max(n) sampled_cells from diffs, q where d between lo and hi",
    )
)
def strip_alignment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.strip_alignment(points.strip_differences(*adapters.strips(adapters.points(spark, d)), res=1.0)))


@query(
    _sql(
        [f"pts as ({PTS})", "s as (select 0 as strip, z from pts where classification=2 and x<500060 and pid%2=0 union all select 1, z+CAST(0.15 AS DOUBLE)-CAST(0.15 AS DOUBLE) from pts where classification=2 and x>500040 and pid%2=1)"],
        "select strip, count(*) n, round(min(z),6) min_z, round(max(z),6) max_z, round(avg(z),6) mean_z from s group by strip",
    )
)
def strip_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = points.merge_strips(list(adapters.strips(adapters.points(spark, d))), [0.0, -0.15])
    return rounded(merged.groupBy("strip").agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z")))


@query(_sql([*_STRIPS, "q as (select min(d) lo, max(d) hi, count(*) n, (max(d)-min(d))/60 wd from diffs)", "b as (select cast(least(floor((d-lo)/wd),59) as int) bin, lo, wd, n nn from diffs, q)"], "select bin, round(min(lo)+bin*min(wd),6) low, round(min(lo)+(bin+1)*min(wd),6) high, count(*) n, round(count(*)/(min(nn)*min(wd)),6) density, round(sum(count(*)) over (order by bin)/min(nn),6) cumulative from b group by bin"))
def residual_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(points.strip_differences(*adapters.strips(adapters.points(spark, d)), res=1.0), "diff"))


@query(_sql([_binned(1.0)], 'select r as "row", c as col, round(max(z),6) z from binned group by r,c'))
def dsm_raw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(surfaces.highest(*cloud(spark, d)))


def _footprint(res: float, buffer: float = 3.0, step: int = 2) -> list[str]:
    n = max(1, math.ceil(buffer / (res * step)))
    return [
        f"cw as (select ht//{step}+1 ch, wd//{step}+1 cw from w)",
        f"seen as (select distinct r//{step} r, c//{step} c from binned)",
        "cgrid as (select cast(rr as bigint) r, cast(cc as bigint) c, ch, cw from (select unnest(range(ch)) rr, ch, cw from cw), lateral (select unnest(range(cw)) cc))",
        f"wide as (select distinct g.r, g.c from cgrid g join (select r+dr r, c+dc c from seen, (select unnest(range(-{n},{n + 1})) dr), (select unnest(range(-{n},{n + 1})) dc)) s using (r,c))",
        "free as materialized (select r,c,ch,cw from cgrid anti join wide using (r,c))",
        "flood(r,c) as (select r,c from free where r=0 or c=0 or r=ch-1 or c=cw-1 union select f.r,f.c from flood o join free f on abs(f.r-o.r)+abs(f.c-o.c)=1)",
        "inner_ as (select r,c from cgrid anti join flood using (r,c))",
        f"foot as materialized (select g.r, g.c from grid g join inner_ i on i.r=g.r//{step} and i.c=g.c//{step})",
    ]


@query(_sql([_binned(1.0), _DENSE, *_footprint(1.0)], 'select r as "row", c as col from foot', True))
def footprint(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.footprint(*cloud(spark, d))


def _gauss(sigma: float) -> str:
    from aerolith.functions.stencil import gaussian_weights

    w = gaussian_weights(sigma)
    return "gw(k,w) as (values " + ", ".join(f"({i - len(w) // 2}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w)) + ")"


def _mirror(v: str, n: str) -> str:
    return f"(case when ((({v})%(2*{n}))+2*{n})%(2*{n}) < {n} then ((({v})%(2*{n}))+2*{n})%(2*{n}) else 2*{n}-1-((({v})%(2*{n}))+2*{n})%(2*{n}) end)"


_DSM = [
    _binned(1.0),
    _DENSE,
    *_footprint(1.0),
    "top as (select r,c,max(z) z from binned group by r,c)",
    "gap as (select r,c from grid anti join top using (r,c))",
    "fill as (select r,c,z from (select g.r,g.c,t.z,row_number() over (partition by g.r,g.c order by (t.r-g.r)*(t.r-g.r)+(t.c-g.c)*(t.c-g.c), t.r, t.c) k from gap g join top t on t.r between g.r-12 and g.r+12 and t.c between g.c-12 and g.c+12) where k=1)",
    "full_ as (select r,c,z from top union all select r,c,z from fill)",
    _gauss(1.0),
    f"g1 as (select f.r, f.c, sum(s.z*gw.w) z from full_ f, w, gw, full_ s where s.r=f.r and s.c={_mirror('f.c+gw.k', 'w.wd')} group by f.r,f.c)",
    f"g2 as (select f.r, f.c, sum(s.z*gw.w) z from g1 f, w, gw, g1 s where s.c=f.c and s.r={_mirror('f.r+gw.k', 'w.ht')} group by f.r,f.c)",
]


@query(_sql(_DSM, 'select g.r as "row", g.c as col, case when f.r is not null then round(coalesce(t.z, g2.z),6) end z from grid g left join foot f using (r,c) left join top t using (r,c) left join g2 using (r,c)', True))
def dsm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(surfaces.surface_model(*cloud(spark, d)))


_NODES = "nodes as (select r,c,pid,x,y,z from (select *, row_number() over (partition by r,c order by pid) k from binned where classification=2) where k=1)"


@query(_sql([_binned(1.0), _NODES], 'select r as "row", c as col, pid, round(x,6) x, round(y,6) y, round(z,6) z from nodes'))
def dtm_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(surfaces.ground_nodes(*cloud(spark, d)))


@query(
    _sql(
        [
            _binned(2.0),
            _DENSE,
            *_footprint(2.0),
            _NODES,
            "q as (select f.r, f.c, mnx+(f.c+CAST(0.5 AS DOUBLE))*CAST(2 AS DOUBLE) qx, mxy-(f.r+CAST(0.5 AS DOUBLE))*CAST(2 AS DOUBLE) qy from foot f, w)",
            "j as (select q.r,q.c,n.z,n.pid,(n.x-qx)*(n.x-qx)+(n.y-qy)*(n.y-qy) d2 from q join nodes n on n.r between q.r-9 and q.r+9 and n.c between q.c-9 and q.c+9)",
            "k as (select *, row_number() over (partition by r,c order by d2,pid) rk from j)",
        ],
        'select r as "row", c as col, round(sum(z/greatest(d2,CAST(1e-8 AS DOUBLE)))/sum(1/greatest(d2,CAST(1e-8 AS DOUBLE))),6) z from k where rk<=8 group by r,c',
        True,
    )
)
def dtm_idw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(surfaces.terrain_model(*cloud(spark, d, 2.0)))


@query(_sql([_binned(1.0), "a as (select r,c,max(z) z from binned group by r,c)", "b as (select r,c,min(z) z from binned where classification=2 group by r,c)"], 'select r as "row", c as col, round(least(greatest(a.z-b.z,0),120),6) z from a join b using (r,c)'))
def chm(spark: SparkSession, d: str) -> DataFrame:
    p, spec = cloud(spark, d)
    from aerolith.functions.grid import cells

    return rounded(surfaces.canopy_height(surfaces.highest(p, spec), cells(p.where("classification = 2"), spec, F.min("z").alias("z"))))


@query(_sql([_binned(1.0), _DENSE, *_footprint(1.0), "m as (select r,c,avg(intensity) z from binned group by r,c)"], 'select f.r as "row", f.c as col, round(coalesce(z,0),6) z from foot f left join m using (r,c)', True))
def intensity_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(surfaces.intensity_grid(*cloud(spark, d)))


_RGB = "rgb as (select r rr, c cc, " + ", ".join(f"cast(least(greatest(floor(avg({n}/CAST(256 AS DOUBLE))),0),255) as int) {n[0]}" for n in ("red", "green", "blue")) + " from binned group by r,c)"


@query(_sql([_binned(1.0), _DENSE, *_footprint(1.0), _RGB], 'select g.r as "row", g.c as col, case when f.r is null then 0 else coalesce(rgb.r,0) end r, case when f.r is null then 0 else coalesce(g,0) end g, case when f.r is null then 0 else coalesce(b,0) end b from grid g left join foot f on f.r=g.r and f.c=g.c left join rgb on rr=g.r and cc=g.c'.replace("coalesce(g,0)", "coalesce(rgb.g,0)").replace("coalesce(b,0)", "coalesce(rgb.b,0)"), True))
def rgb_grid(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.colour_grid(*cloud(spark, d))


@query(
    _sql(
        [
            _binned(1.0),
            _DENSE,
            *_footprint(1.0),
            _RGB,
            "gap as (select g.r,g.c from grid g anti join rgb on rr=g.r and cc=g.c)",
            "near as (select r,c,rr,cc from (select g.r,g.c,t.rr,t.cc,row_number() over (partition by g.r,g.c order by (t.rr-g.r)*(t.rr-g.r)+(t.cc-g.c)*(t.cc-g.c), t.rr, t.cc) k from gap g join rgb t on t.rr between g.r-12 and g.r+12 and t.cc between g.c-12 and g.c+12) where k=1 union all select rr,cc,rr,cc from rgb)",
        ],
        'select g.r as "row", g.c as col, case when f.r is null then 0 else t.r end r, case when f.r is null then 0 else t.g end g, case when f.r is null then 0 else t.b end b, case when f.r is null then 0 else 255 end a from grid g join near n on n.r=g.r and n.c=g.c join rgb t on t.rr=n.rr and t.cc=n.cc left join foot f on f.r=g.r and f.c=g.c',
        True,
    )
)
def orthomosaic(spark: SparkSession, d: str) -> DataFrame:
    return imagery.orthomosaic(*cloud(spark, d), alpha=True)


def _stretch(b: str) -> str:
    return f"cast(case when h{b}>l{b} then floor(least(greatest(({b}-l{b})/(h{b}-l{b})*255,0),255)) else {b} end as int) {b}"


@query(_sql([_binned(1.0), _RGB, "q as (select " + ", ".join(f"quantile_cont(case when {b}>0 then {b} end,0.02) l{b}, quantile_cont(case when {b}>0 then {b} end,0.98) h{b}" for b in "rgb") + " from rgb)"], 'select rr as "row", cc as col, ' + ", ".join(map(_stretch, "rgb")) + " from rgb, q"))
def ortho_contrast(spark: SparkSession, d: str) -> DataFrame:
    return imagery.stretched(surfaces.colour_means(*cloud(spark, d)), ["r", "g", "b"])


_INDEX = {
    "VARI": "least(greatest((g-r)/case when abs(g+r-b)<1e-4 then 1e-4 else g+r-b end,-1),1)",
    "GLI": "least(greatest((2*g-r-b)/case when abs(2*g+r+b)<1e-4 then 1e-4 else 2*g+r+b end,-1),1)",
    "TGI": "g-CAST(0.39 AS DOUBLE)*r-CAST(0.61 AS DOUBLE)*b",
    "EXG": "2*(g/greatest(r+g+b,1e-4))-r/greatest(r+g+b,1e-4)-b/greatest(r+g+b,1e-4)",
    "NGRDI": "least(greatest((g-r)/case when abs(g+r)<1e-4 then 1e-4 else g+r end,-1),1)",
}


def _vegetation(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(imagery.vegetation_index(surfaces.colour_means(*cloud(spark, d)), name))

    run.__name__ = f"vi_{name.lower()}"
    query(_sql([_binned(1.0), _RGB, "s as (select rr,cc,r/CAST(255 AS DOUBLE) r,g/CAST(255 AS DOUBLE) g,b/CAST(255 AS DOUBLE) b from rgb)"], f'select rr as "row", cc as col, case when r>0 or g>0 or b>0 then round({_INDEX[name]},6)+0 end as "value" from s'))(run)


for _name in imagery.INDICES:
    _vegetation(_name)

_ALT, _AZ = math.radians(45), math.radians(360 - 315 + 90)


@query(_sql([DEM, _grad()], f'select r as "row", c as col, cast(floor(least(greatest((CAST({math.sin(_ALT)!r} AS DOUBLE)*cos(atan(sqrt(gx*gx+gy*gy)))+CAST({math.cos(_ALT)!r} AS DOUBLE)*sin(atan(sqrt(gx*gx+gy*gy)))*cos(CAST({_AZ!r} AS DOUBLE)-atan2(-gx,gy)))*254,1),255)) as int) shade from g'))
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    return terrain.hillshade(*raster(spark, d))


@query(_sql([DEM, _grad()], 'select r as "row", c as col, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) slope from g'))
def slope_deg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.slope(*raster(spark, d)))


@query(_sql([DEM, _grad()], 'select r as "row", c as col, round(tan(atan(sqrt(gx*gx+gy*gy)))*100,6) slope from g'))
def slope_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.slope(*raster(spark, d), units="percent"))


@query(_sql([DEM, _grad(), "a as (select r,c,degrees(atan2(-gx,gy)) a from g)"], 'select r as "row", c as col, round(case when a<0 then a+360 else a end,6)+0 aspect from a'))
def aspect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.aspect(*raster(spark, d)))


def _box(z: str, source: str, name: str) -> list[str]:
    return [
        f"{name}h as (select *, (coalesce(lag({z}) over (partition by r order by c),{z})+{z}+coalesce(lead({z}) over (partition by r order by c),{z}))/3 hh from {source})",
        f"{name} as (select * exclude (hh), (coalesce(lag(hh) over (partition by c order by r),hh)+hh+coalesce(lead(hh) over (partition by c order by r),hh))/3 {name}m from {name}h)",
    ]


@query(_sql([DEM, *_box("z", "dem", "b1"), "dv as (select r,c,(z-b1m)*(z-b1m) d from b1)", *_box("d", "dv", "b2")], 'select r as "row", c as col, round(sqrt(b2m),6) tri from b2'))
def tri(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.ruggedness(adapters.dem(spark, d)))


_CUT = lambda a, b: f"(lv-{a})/({b}-{a})"
_PT = {
    "N": (f"c+{_CUT('nw', 'ne')}", "r"),
    "S": (f"c+{_CUT('sw', 'se')}", "r+1"),
    "W": ("c", f"r+{_CUT('nw', 'sw')}"),
    "E": ("c+1", f"r+{_CUT('ne', 'se')}"),
}


def _seg(a: str, b: str, where: str) -> str:
    x = lambda p: f"round({_PT[p][0]}+CAST(0.5 AS DOUBLE),6)"
    y = lambda p: f"round(mxy-({_PT[p][1]}+CAST(0.5 AS DOUBLE)),6)"
    return f"select round(lv,6) as level, {x(a)} x1, {y(a)} y1, {x(b)} x2, {y(b)} y2 from cs where {where}"


@query(
    _sql(
        [
            DEM,
            "dim as (select CAST(max(r)+1 AS DOUBLE) mxy, ceil(min(z)/CAST(0.2 AS DOUBLE))*CAST(0.2 AS DOUBLE) l0, max(z) mz from dem)",
            "lvl as (select l0+k*CAST(0.2 AS DOUBLE) lv, mxy from (select l0, mz, mxy, unnest(range(1000)) k from dim) where k < ceil((mz+0.1*CAST(0.2 AS DOUBLE)-l0)/CAST(0.2 AS DOUBLE)))",
            "sq0 as (select r,c,z nw, lead(z) over (partition by r order by c) ne from dem)",
            "sq as (select r,c,nw,ne,lead(nw) over (partition by c order by r) sw, lead(ne) over (partition by c order by r) se from sq0)",
            "cs as (select *, (case when nw>=lv then 1 else 0 end)+(case when ne>=lv then 2 else 0 end)+(case when se>=lv then 4 else 0 end)+(case when sw>=lv then 8 else 0 end) k, (nw+ne+sw+se)/4>=lv md from sq, lvl where nw is not null and ne is not null and sw is not null and se is not null)",
        ],
        "\nunion all ".join(
            [
                _seg("W", "N", "k in (1,14)"),
                _seg("N", "E", "k in (2,13)"),
                _seg("E", "S", "k in (4,11)"),
                _seg("S", "W", "k in (8,7)"),
                _seg("W", "E", "k in (3,12)"),
                _seg("N", "S", "k in (6,9)"),
                _seg("N", "E", "k in (5,10) and (k=5)=md"),
                _seg("S", "W", "k in (5,10) and (k=5)=md"),
                _seg("W", "N", "k in (5,10) and (k=5)<>md"),
                _seg("E", "S", "k in (5,10) and (k=5)<>md"),
            ]
        ),
    )
)
def contour_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.contour_segments(*raster(spark, d), interval=0.2).drop("a", "b"))


@query()
def contour_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = terrain.contour_lines(terrain.contour_segments(*raster(spark, d), interval=0.2))
    return lines.select(F.round("level", 6).alias("level"), F.size("line").alias("vertices"))


_AFTER = "after_ as (select r,c,z+((r*31+c*17)%11-5)*CAST(0.01 AS DOUBLE) z from dem)"


def _volume_sql(source: str) -> str:
    cut, fill = "coalesce(sum(case when d>0 then d end),0)", "coalesce(sum(case when d<0 then -d end),0)"
    return f"select round({cut},4) cut_volume, round({fill},4) fill_volume, round({cut}-{fill},4) net_volume, round({cut}+{fill},4) total_volume, CAST(count(d) AS DOUBLE) area, round(avg(d),4)+0 mean_height_diff, round(coalesce(max(case when d>0 then d end),0),4) max_cut, round(coalesce(max(case when d<0 then -d end),0),4) max_fill, count(d) valid_cells from {source}"


@query(_sql([DEM, _AFTER, "df as (select case when (r*7+c*13)%97<>0 then dem.z-after_.z end d from dem join after_ using (r,c))"], _volume_sql("df")))
def cut_fill(spark: SparkSession, d: str) -> DataFrame:
    before, spec = raster(spark, d)
    return rounded(terrain.cut_fill(adapters.with_voids(before), adapters.epoch_after(before), spec), 4)


@query(_sql([DEM, "df as (select z-(select min(z) from dem) d from dem)"], _volume_sql("df")))
def stockpile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(terrain.stockpile(*raster(spark, d)), 4)


@query(_sql([DEM], 'select 64 as width, cast(max(r)+1 as bigint) height, CAST(1 AS DOUBLE) res_x, CAST(1 AS DOUBLE) res_y, count(z) valid_cells, round(min(z),3) min_z, round(max(z),3) max_z, round(avg(z),3)+0 mean_z from dem'))
def raster_summary(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    return rounded(terrain.summary(df, spec).withColumn("height", F.col("height").cast("long")))


_STEPS = "o(code,dr,dc,dist) as (values " + ", ".join(f"({code},{dr},{dc},{'sqrt(CAST(2 AS DOUBLE))' if dr and dc else 'CAST(1 AS DOUBLE)'})" for code, _, dr, dc in hydro.DIRECTIONS) + ")"
_D8 = [
    _STEPS,
    "cand as (select a.r,a.c,code,(a.z-b.z)/dist drp, b.r nr, b.c nc from dem a, o, dem b where b.r=a.r+dr and b.c=a.c+dc and a.z>b.z)",
    "d8 as materialized (select r,c,code,nr,nc from (select *, row_number() over (partition by r,c order by drp desc, code) k from cand) where k=1)",
]


@query(_sql([DEM, *_D8], 'select dem.r as "row", dem.c as col, coalesce(code,0) code from dem left join d8 using (r,c)'))
def d8(spark: SparkSession, d: str) -> DataFrame:
    return hydro.d8(*raster(spark, d))


@query(_sql([DEM, _grad(), "a as (select r,c,atan2(-gy,-gx) a from g)"], f'select r as "row", c as col, round(case when a<0 then a+CAST({2 * math.pi!r} AS DOUBLE) else a end,6)+0 angle from a'))
def dinf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.d_infinity(*raster(spark, d)))


_ACC = [*_D8, "wk(r,c) as (select r,c from dem union all select d8.nr,d8.nc from wk join d8 on wk.r=d8.r and wk.c=d8.c)", "acc as (select r,c,count(*) acc from wk group by r,c)"]


@query(_sql([DEM, *_ACC], 'select r as "row", c as col, acc from acc', True))
def flow_accum(spark: SparkSession, d: str) -> DataFrame:
    return hydro.accumulation(*raster(spark, d))


@query(_sql([DEM, *_ACC], 'select r as "row", c as col, case when acc>=5 then 1 else 0 end stream from acc', True))
def streams(spark: SparkSession, d: str) -> DataFrame:
    return hydro.streams(hydro.accumulation(*raster(spark, d)), 5)


_IDX = [DEM, *_ACC, _grad(), "v as (select r,c,gx,gy,sqrt(gx*gx+gy*gy) t, greatest(CAST(1 AS DOUBLE),acc) a from g join acc using (r,c))"]


@query(_sql(_IDX, 'select r as "row", c as col, round(ln(a/(t+CAST(0.001 AS DOUBLE))),6) twi from v', True))
def twi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.wetness(*raster(spark, d)))


@query(_sql(_IDX, 'select r as "row", c as col, round(a*t,6) spi from v', True))
def spi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.stream_power(*raster(spark, d)))


@query(_sql(_IDX, 'select r as "row", c as col, round(pow(a/CAST(22.13 AS DOUBLE),CAST(0.6 AS DOUBLE))*pow(greatest(CAST(1e-5 AS DOUBLE),sin(atan(t)))/CAST(0.0896 AS DOUBLE),CAST(1.3 AS DOUBLE)),6) sti from v', True))
def sti(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.sediment_transport(*raster(spark, d)))


@query(
    _sql(
        [
            *_IDX,
            _grad("g", "gx", "gxx", "gxy", "h1"),
            _grad("g", "gy", "gyx", "gyy", "h2"),
            "q0 as (select v.r,v.c,t,ln(a/(t+CAST(0.001 AS DOUBLE))) twi, gxx, gyy from v join h1 on h1.r=v.r and h1.c=v.c join h2 on h2.r=v.r and h2.c=v.c)",
            "q as (select quantile_cont(twi,0.05) lo, quantile_cont(twi,0.95) hi from q0 where twi>-100)",
            "s as (select r,c,least(greatest(degrees(atan(t))/45*100,0),100) a1, least(greatest((twi-lo)/greatest(CAST(1e-5 AS DOUBLE),hi-lo)*100,0),100) a2, least(greatest((-(gxx+gyy)+CAST(0.5 AS DOUBLE))*100,0),100) a3 from q0, q)",
        ],
        'select r as "row", c as col, cast(floor(least(greatest(a1*CAST(0.5 AS DOUBLE)+a2*CAST(0.35 AS DOUBLE)+a3*CAST(0.15 AS DOUBLE),0),100)) as int) hazard from s',
        True,
    )
)
def landslide(spark: SparkSession, d: str) -> DataFrame:
    return hydro.landslide(*raster(spark, d))


_RESID = [
    f"pts as ({PTS})",
    f"gcp as ({GCP})",
    "j as (select point_id, point_type, g.x gx, g.y gy, g.z gz, p.pid, p.z pz, (p.x-g.x)*(p.x-g.x)+(p.y-g.y)*(p.y-g.y) d2 from gcp g join pts p on p.classification=2 and p.x between g.x-2.5 and g.x+2.5 and p.y between g.y-2.5 and g.y+2.5)",
    "k as (select *, row_number() over (partition by point_id order by d2,pid) rk from j where d2<6.25)",
    "res as (select point_id, point_type, gx x, gy y, gz z, case when min(d2)<1e-8 then min(case when rk=1 then pz end) else sum(pz/greatest(d2,1e-8))/sum(1/greatest(d2,1e-8)) end z_surface, count(*) neighbours from k where rk<=6 group by all)",
    "rr as (select *, z_surface-z delta from res)",
]


@query(_sql(_RESID, "select point_id, point_type, round(x,6) x, round(y,6) y, round(z,6) z, round(z_surface,6) z_surface, round(delta,6) delta, cast(neighbours as int) neighbours, case when abs(delta)<=0.05 then 'PASS' when abs(delta)<=1.5*0.05 then 'WARNING' else 'FAIL' end status from rr"))
def gcp_residuals_cloud(spark: SparkSession, d: str) -> DataFrame:
    return rounded(control.cloud_residuals(adapters.points(spark, d), adapters.control(spark, d)))


@query(
    _sql(
        [_binned(1.0), f"gcp as ({GCP})", "lo as (select r,c,min(z) zs from binned where classification=2 group by r,c)", "gg as (select g.*, cast(floor(mxy-y) as bigint) r, cast(floor(x-mnx) as bigint) c from gcp g, w where x>=mnx and x<mnx+wd and y>mxy-ht and y<=mxy)"],
        "select point_id, point_type, round(x,6) x, round(y,6) y, round(z,6) z, round(zs,6) z_surface, round(zs-z,6) delta, 1 as neighbours, case when abs(zs-z)<=0.05 then 'PASS' when abs(zs-z)<=1.5*0.05 then 'WARNING' else 'FAIL' end status from gg join lo using (r,c)",
    )
)
def gcp_residuals_dem(spark: SparkSession, d: str) -> DataFrame:
    from aerolith.functions.grid import cells

    p, spec = cloud(spark, d)
    return rounded(control.raster_residuals(cells(p.where("classification = 2"), spec, F.min("z").alias("z")), spec, adapters.control(spark, d)))


@query(
    _sql(
        [
            *_RESID,
            "m as (select quantile_cont(delta,0.5) med, stddev_samp(delta) sd, count(*) n from rr)",
            "md as (select quantile_cont(abs(delta-med),0.5) mad from rr, m)",
            "sg as (select case when mad>1e-4 then mad*CAST(1.4826 AS DOUBLE) when sd>1e-4 then sd else 0.05 end sigma from m, md)",
            "f as (select rr.*, n>=3 and (abs(delta-med)>greatest(2.5*sigma,1.5*0.05) or (abs(delta)>3*0.05 and abs(delta-med)>2*0.05)) and abs(delta)>0.05 outl from rr, m, sg)",
        ],
        "select count(*) total_points, count(*) filter (point_type='GCP') gcp_points, count(*) filter (point_type='CHECK') check_points, round(sqrt(avg(delta*delta)),6) rmse, round(avg(delta),6) bias, round(coalesce(stddev_samp(delta),0),6) std, round(sqrt(avg(delta*delta))*CAST(1.96 AS DOUBLE),6) accuracy_95, round(min(delta),6) min_delta, round(max(delta),6) max_delta, count(*) filter (outl) outliers, round(coalesce(-avg(delta) filter (not outl), -avg(delta)),6) suggested_shift, sqrt(avg(delta*delta))<=0.05 and count(*) filter (outl)=0 passed from f",
    )
)
def gcp_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(control.accuracy(control.cloud_residuals(adapters.points(spark, d), adapters.control(spark, d))).drop("outlier_ids"))


@query(
    _sql(
        [
            DEM,
            "ds as (select r//4 r, c//4 c, z from dem where r%4=0 and c%4=0)",
            _grad("ds"),
            "f as (select r,c,zz>0.35 spike, zz<-0.4 pit, degrees(atan(sqrt(gx/4*gx/4+gy/4*gy/4)))>4 cliff from g)",
            "seed as (select r,c from f where spike or pit or cliff)",
            "near as (select distinct r+dr r, c+dc c from seed, (select unnest(range(-2,3)) dr), (select unnest(range(-2,3)) dc) where abs(dr)+abs(dc)<=2)",
        ],
        'select f.r as "row", f.c as col, spike, pit, cliff, n.r is not null anomaly, true as "valid" from f left join near n on n.r=f.r and n.c=f.c',
    )
)
def terrain_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return quality.anomalies(*raster(spark, d), spike=0.35, pit=-0.4, slope=4.0, grow=2)


@query(
    _sql(
        [f"pts as ({PTS})", "q as (select quantile_cont(z,0.01) p1, quantile_cont(z,0.99) p99 from pts)"],
        "select count(*) total_points, round(count(*)/greatest(1,(max(x)-min(x))*(max(y)-min(y))),6) density, round(count(*) filter (classification=2)*CAST(100 AS DOUBLE)/count(*),6) ground_pct, round(max(p1),6) z_p1, round(max(p99),6) z_p99, count(*) filter (z>p99+3*(p99-p1) or z<p1-3*(p99-p1)) noise_points, round(min(z),6) min_z, round(max(z),6) max_z from pts, q",
    )
)
def qc_cloud(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.cloud_metrics(adapters.points(spark, d)))


def _score(issues: str) -> str:
    """Rows of an audit: the issues and the score."""
    worst = "case when count(*) filter (severity='CRITICAL')>0 then 'CRITICAL' when count(*) filter (severity='WARNING')>0 then 'WARNING' else 'HEALTHY' end"
    return f"select code, severity, CAST(points AS DOUBLE) points from {issues} union all select 'SCORE', {worst}, CAST(greatest(0, least(100, 100-coalesce(sum(points),0))) AS DOUBLE) from {issues}"


@query(
    _sql(
        [
            *_RESID,
            "q as (select quantile_cont(z,0.01) p1, quantile_cont(z,0.99) p99 from pts)",
            "cm as (select count(*) n, count(*)/greatest(1,(max(x)-min(x))*(max(y)-min(y))) dens, count(*) filter (classification=2)*CAST(100 AS DOUBLE)/count(*) gp, count(*) filter (z>p99+3*(p99-p1) or z<p1-3*(p99-p1)) noise from pts, q)",
            "m as (select quantile_cont(delta,0.5) med, stddev_samp(delta) sd, count(*) n from rr)",
            "md as (select quantile_cont(abs(delta-med),0.5) mad from rr, m)",
            "sg as (select case when mad>1e-4 then mad*CAST(1.4826 AS DOUBLE) when sd>1e-4 then sd else 0.05 end sigma from m, md)",
            "f as (select rr.*, n>=3 and (abs(delta-med)>greatest(2.5*sigma,1.5*0.05) or (abs(delta)>3*0.05 and abs(delta-med)>2*0.05)) and abs(delta)>0.05 outl from rr, m, sg)",
            "gs as (select count(*) n, avg(delta) bias, sqrt(avg(delta*delta)) rmse, count(*) filter (outl) outs from f)",
            """iss as (select 'LAS_CRS_MISSING' code, 'CRITICAL' severity, 25 points
 union all select 'LAS_MULTIPATH_NOISE', case when noise*100>n then 'CRITICAL' else 'WARNING' end, case when noise*100>n then 20 else 10 end from cm where noise>0
 union all select 'LAS_UNCLASSIFIED', 'CRITICAL', 30 from cm where gp<0.1
 union all select 'LAS_LOW_GROUND_DENSITY', 'WARNING', 15 from cm where gp>=0.1 and gp/100*dens<0.5
 union all select 'GCP_VERTICAL_DATUM_SHIFT', case when abs(bias)>0.15 then 'CRITICAL' else 'WARNING' end, 25 from gs where n>0 and not (rmse<=0.05 and outs=0) and abs(bias)>0.05
 union all select 'GCP_ACCURACY_EXCEEDS_TOLERANCE', 'WARNING', 15 from gs where n>0 and not (rmse<=0.05 and outs=0) and abs(bias)<=0.05
 union all select 'GCP_OUTLIER_BLUNDER', 'WARNING', 10 from gs where outs>0)""",
        ],
        _score("iss"),
    )
)
def qc_cloud_audit(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_rows(spark, quality.inspect_cloud(adapters.points(spark, d), None, control=adapters.control(spark, d)))


_VOID = "vd as (select r,c,case when (r*7+c*13)%97<>0 then z end z from dem)"


@query(_sql([DEM, _VOID, "vs as (select r,c,z,coalesce(z,-9999) u from vd)", _grad("vs", "u", extra=", z")], "select count(*) cells, count(z) valid_cells, round((count(*)-count(z))*CAST(100 AS DOUBLE)/count(*),6) void_pct, count(*) filter (z is not null and sqrt(gx*gx+gy*gy)>15) spikes, round(min(z),6) min_z, round(max(z),6) max_z, round(avg(z),6) mean_z from g"))
def qc_dem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.raster_metrics(adapters.with_voids(adapters.dem(spark, d))))


@query(
    _sql(
        [
            DEM,
            _VOID,
            "vs as (select r,c,z,coalesce(z,-9999) u from vd)",
            _grad("vs", "u", extra=", z"),
            "mt as (select (count(*)-count(z))*CAST(100 AS DOUBLE)/count(*) void, count(*) filter (z is not null and sqrt(gx*gx+gy*gy)>15) spikes from g)",
            "iss as (select 'DEM_VOID_POCKETS' code, case when void>15 then 'CRITICAL' else 'WARNING' end severity, case when void>15 then 25 else 10 end points from mt where void>1.5 union all select 'DEM_ELEVATION_SPIKES', 'WARNING', 15 from mt where spikes>0)",
        ],
        _score("iss"),
    )
)
def qc_dem_audit(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    return quality.audit_rows(spark, quality.inspect_raster(adapters.with_voids(df), spec_with_crs(spec)))


def spec_with_crs(spec: GridSpec) -> GridSpec:
    return GridSpec(spec.min_x, spec.max_y, spec.res_x, spec.res_y, spec.width, spec.height, 32632)


_M3 = ", ".join(f"coalesce({a}({b}) over (partition by r order by c),z)" if a else "z" for a, b in (("lag", "z"), ("", ""), ("lead", "z")))


@query(
    _sql(
        [
            DEM,
            _VOID,
            "fl as (select r,c,z from (select g.r,g.c,t.z,row_number() over (partition by g.r,g.c order by (t.r-g.r)*(t.r-g.r)+(t.c-g.c)*(t.c-g.c), t.r, t.c) k from vd g join vd t on g.z is null and t.z is not null and t.r between g.r-4 and g.r+4 and t.c between g.c-4 and g.c+4) where k=1 union all select r,c,z from vd where z is not null)",
            f"h as (select r,c,z,[{_M3}] l from fl)",
            "m as (select r,c,z,list_sort(list_concat(list_concat(coalesce(lag(l) over (partition by c order by r),l),l),coalesce(lead(l) over (partition by c order by r),l)))[5] md from h)",
        ],
        'select r as "row", c as col, round(case when abs(z-md)>0.2 then md else z end,6)+0 z from m',
    )
)
def dem_heal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.heal(adapters.with_voids(adapters.dem(spark, d)), threshold=0.2))


@query(_sql([DEM, _VOID], "select c as transect, row_number() over (partition by c order by r desc)-1 as seq, CAST(row_number() over (partition by c order by r desc)-1 AS DOUBLE) distance, round(z,6)+0 z from vd where c in (5,31,60) and z is not null"))
def transect_vertical(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    return rounded(profile.transects(adapters.with_voids(df), spec, "vertical", [5, 31, 60]))


@query(_sql([DEM, _VOID], "select r as transect, row_number() over (partition by r order by c)-1 as seq, CAST(c-min(c) over (partition by r) AS DOUBLE) distance, round(z,6)+0 z from vd where r in (7,120,333) and z is not null"))
def transect_horizontal(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    return rounded(profile.transects(adapters.with_voids(df), spec, "horizontal", [7, 120, 333]))


@query(_sql([DEM, "s as (select k as seq, k/CAST(99 AS DOUBLE) t from range(100) x(k))", "p as (select seq, CAST(3 AS DOUBLE)+t*(CAST(60 AS DOUBLE)-CAST(3 AS DOUBLE)) x, CAST(20 AS DOUBLE)+t*(CAST(450 AS DOUBLE)-CAST(20 AS DOUBLE)) y, t from s)", "mx as (select max(r)+1 ht from dem)"], f"select seq, round(t*CAST({math.hypot(57, 430)!r} AS DOUBLE),6) distance, round(x,6) x, round(y,6) y, round(z,6)+0 z from p, mx left join dem on dem.r=cast(floor(ht-y) as bigint) and dem.c=cast(floor(x) as bigint)"))
def line_transect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.line_transect(*raster(spark, d), (3.0, 20.0), (60.0, 450.0), 100))


_LEN = math.hypot(70, 50)


@query(
    _sql(
        [f"pts as ({PTS})", f"p as (select pid, z, ((x-500010)*70+(y-5200020)*50)/CAST({_LEN!r} AS DOUBLE) distance, ((y-5200020)*70-(x-500010)*50)/CAST({_LEN!r} AS DOUBLE) ofs from pts)"],
        f"select pid, round(distance,6) distance, round(ofs,6)+0 as \"offset\", round(z,6) z from p where distance between 0 and CAST({_LEN!r} AS DOUBLE) and abs(ofs)<=1",
    )
)
def corridor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.corridor(adapters.points(spark, d), (500010.0, 5200020.0), (500080.0, 5200070.0), 2.0).select("pid", "distance", "offset", "z"))


@query(
    _sql(
        [DEM, "mx as (select max(r)+1 ht from dem)", "ch as (select 'CHIP_'||i||'_'||j id, CAST(16*j AS DOUBLE) x0, CAST(16*j+16 AS DOUBLE) x1, CAST(100*i AS DOUBLE) y0, CAST(100*i+100 AS DOUBLE) y1 from range(4) a(i), range(4) b(j))"],
        "select id, (x0+x1)/2 cx, (y0+y1)/2 cy, count(z) cells, round(min(z),6) min_z, round(max(z),6) max_z, round(avg(z),6)+0 mean_z from ch, mx, dem where dem.c+CAST(0.5 AS DOUBLE)>=x0 and dem.c+CAST(0.5 AS DOUBLE)<x1 and ht-(dem.r+CAST(0.5 AS DOUBLE))>y0 and ht-(dem.r+CAST(0.5 AS DOUBLE))<=y1 group by id,x0,x1,y0,y1",
    )
)
def zonal_chips(spark: SparkSession, d: str) -> DataFrame:
    df, spec = raster(spark, d)
    chips = [(f"CHIP_{i}_{j}", 16.0 * j, 100.0 * i, 16.0 * j + 16, 100.0 * i + 100) for i in range(4) for j in range(4)]
    return rounded(profile.zonal(df, spec, spark.createDataFrame(chips, "id string, x_min double, y_min double, x_max double, y_max double")))


@query(_sql([DEM, _AFTER], 'select dem.r//4 as "row", dem.c//4 as col, round(dem.z,6)+0 as "before", round(after_.z,6)+0 as "after", round(after_.z-dem.z,6)+0 as change from dem join after_ using (r,c) where dem.r%4=0 and dem.c%4=0'))
def before_after(spark: SparkSession, d: str) -> DataFrame:
    df = adapters.dem(spark, d)
    return rounded(profile.before_after(df, adapters.epoch_after(df)))


def _rectified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, GridSpec]:
    p, spec = cloud(spark, d)
    top = densified(surfaces.highest(p, spec), spec)
    mask = spark.range(9).select((F.expr("id div 3") + 11).alias("row"), (F.col("id") % 3 + 11).alias("col"))
    return p, rectify.surface(top, spec, mask, step=4, iterations=150), spec.coarser(4)


#: The relaxation of a patch of nine cells has settled after 150 rounds, so it may start from any heights: here from the filled ones.
_RECT = [
    _binned(1.0),
    "top as (select r,c,max(z) z from binned group by r,c)",
    "size_ as (select mnx, mxy, (wd+3)//4 wd, (ht+3)//4 ht from w)",
    "cells_ as (select cast(rr as bigint) r, cast(cc as bigint) c from (select unnest(range(ht)) rr, wd from size_), lateral (select unnest(range(wd)) cc))",
    "some_ as (select g.r, g.c, t.z, t.z is not null and g.r between 11 and 13 and g.c between 11 and 13 m from cells_ g left join top t on t.r=g.r*4 and t.c=g.c*4)",
    "fill as (select r,c,z from (select g.r,g.c,t.z,row_number() over (partition by g.r,g.c order by (t.r-g.r)*(t.r-g.r)+(t.c-g.c)*(t.c-g.c), t.r, t.c) k from some_ g join some_ t on t.z is not null and t.r between g.r-8 and g.r+8 and t.c between g.c-8 and g.c+8 where g.z is null) where k=1)",
    "src as (select s.r, s.c, coalesce(s.z, f.z) z, m from some_ s left join fill f using (r,c))",
    "rx(k,r,c,m,v) as (select 0, r, c, m, z from src where r between 10 and 14 and c between 10 and 14 union all select a.k+1, a.r, a.c, a.m, avg(b.v) from rx a join rx b on abs(a.r-b.r)+abs(a.c-b.c)=case when a.m then 1 else 0 end where a.k<150 group by a.k, a.r, a.c, a.m)",
    _gauss(6.0),
    f"g1 as (select f.r, f.c, sum(case when s.m then gw.w else 0 end) z from src f, size_ w, gw, src s where s.r=f.r and s.c={_mirror('f.c+gw.k', 'w.wd')} group by f.r,f.c)",
    f"g2 as (select f.r, f.c, least(greatest(sum(s.z*gw.w),0),1) z from g1 f, size_ w, gw, g1 s where s.c=f.c and s.r={_mirror('f.r+gw.k', 'w.ht')} group by f.r,f.c)",
    "delta as (select src.r, src.c, case when src.m then g2.z*(rx.v-src.z) else 0 end dz, g2.z w from src join g2 using (r,c) left join rx on rx.k=150 and rx.r=src.r and rx.c=src.c)",
    "placed as (select p.*, least(greatest(cast(floor((s.mxy-y)/4) as bigint),0),s.ht-1) r4, least(greatest(cast(floor((x-s.mnx)/4) as bigint),0),s.wd-1) c4 from pts p, size_ s)",
]


@query(_sql(_RECT, 'select r as "row", c as col, round(dz,6)+0 delta_z, round(w,6)+0 w from delta', True))
def rect_surface(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_rectified(spark, d)[1])


@query(_sql(_RECT, "select pid, round(case when d.w>0.001 and abs(d.dz)>0.001 then z+d.dz else z end,6) z, d.w>0.001 and abs(d.dz)>0.001 corrected from placed join delta d on d.r=r4 and d.c=c4", True))
def rect_points(spark: SparkSession, d: str) -> DataFrame:
    p, delta, spec = _rectified(spark, d)
    return rounded(rectify.apply_surface(p, delta, spec).select("pid", "z", "corrected"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
