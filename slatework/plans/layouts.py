"""Queries of how pages fall apart, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as bt
from ..operators import objects as ob
from ..operators import regions as rg
from ..sources.carriers import objects, table
from .fragments import O


def _whole_pages(s, d):
    """Every page as one cluster."""
    return objects(s, d).withColumn("cluster", F.lit(0).cast("bigint"))


def _pieces(s, d, least):
    return rg.corridor_cuts(_whole_pages(s, d), least=least).drop("cluster")


#: A smaller share of the page than the default, so that more pages are cut, and twice.
SMALL = 0.02 * ob.PAGE_W * ob.PAGE_H

QUERIES = {
    "obj_clusters": lambda s, d: ob.clusters(objects(s, d)),
    "obj_corridor_cuts": lambda s, d: _pieces(s, d, rg.CUT_SHARE * ob.PAGE_W * ob.PAGE_H),
    "obj_small_cuts": lambda s, d: _pieces(s, d, SMALL),
    "obj_regions": lambda s, d: rg.regions(objects(s, d)),
    "obj_big": lambda s, d: rg.big_objects(objects(s, d)).select("deck_id", "page", "z_index", "is_big"),
    "obj_band_means": lambda s, d: ob.band_means(objects(s, d), F.bround(ob.centre()[0], 0), 60),
    "text_batches": lambda s, d: bt.batches(table(s, d, "documents").select(F.col("source").alias("deck"), F.col("doc_id").alias("page_key"), F.length("text").cast("bigint").alias("size"))),
}

_INNER = O.replace("with o", "with recursive o", 1) + ", n as (select * from o where length(trim(text)) <= {most}), p as (select n.*, b.z_index bz, b.text bt, b.x bx, b.y byy, b.w bw, b.h bh from n join n b using (deck_id, page) where n.z_index < b.z_index)"
_GROUPS = """, s as (select deck_id, page, a, b from e union all select deck_id, page, b, a from e),
 reach(deck_id, page, z_index, r) as (select deck_id, page, z_index, z_index from n union select reach.deck_id, reach.page, s.b, r from reach join s on reach.deck_id = s.deck_id and reach.page = s.page and reach.z_index = s.a),
 roots as (select deck_id, page, z_index, min(r) root from reach group by all)"""
_CLUSTERS = _INNER.format(most=1_000_000) + """, g as (select *, greatest(0.0, abs((x + w / 2) - (bx + bw / 2)) - (w + bw) / 2) gx, greatest(0.0, abs((y + h / 2) - (byy + bh / 2)) - (h + bh) / 2) gy from p),
 e as (select deck_id, page, z_index a, bz b from g where (gx = 0 and gy <= 40) or (gy = 0 and gx <= 40))""" + _GROUPS
_REGIONS = _INNER.format(most=rg.WALL_TEXT) + """, g as (select *, greatest(x, bx) - least(x + w, bx + bw) gx, greatest(y, byy) - least(y + h, byy + bh) gy, case when trim(text) <> '' and trim(bt) <> '' then 100 else 40 end t from p),
 e as (select deck_id, page, z_index a, bz b from g where (gx <= t and gy <= 40) or (gy <= t and gx <= 40))""" + _GROUPS


def _with_cuts(rows: str, least: float) -> str:
    """``rows(deck_id, page, piece, m)``, m a list of objects, with the cut of each: null, or where and whether across."""
    gaps = lambda at, size: f"list_filter(range(2, len({at}) + 1), lambda i: {at}[i] - {at}[i - 1] > {size})"
    area = lambda kept: f"((list_max(list_transform({kept}, lambda o: o.x + o.w)) - list_min(list_transform({kept}, lambda o: o.x))) * (list_max(list_transform({kept}, lambda o: o.y + o.h)) - list_min(list_transform({kept}, lambda o: o.y))))"
    reach = lambda iv: f"greatest(0.0, list_max(list_transform({iv}[1:i - 1], lambda t: t.b)))"
    found = lambda iv: f"list_transform(list_filter(range(2, len({iv}) + 1), lambda i: {iv}[i].a - {reach(iv)} > 40), lambda i: ({reach(iv)} + {iv}[i].a) / 2)"
    fit = lambda cuts, low, size: f"list_filter({cuts}, lambda c: {area(f'list_filter(m, lambda o: o.{low} + o.{size} <= c)')} >= {least} and {area(f'list_filter(m, lambda o: o.{low} >= c)')} >= {least})[1]"
    one = f"""select *, list_max(list_transform(m, lambda o: o.x + o.w)) - list_min(list_transform(m, lambda o: o.x)) wide, list_max(list_transform(m, lambda o: o.y + o.h)) - list_min(list_transform(m, lambda o: o.y)) high,
 list_sort(list_transform(m, lambda o: round_even(o.x + o.w / 2, 0))) vx, list_sort(list_transform(m, lambda o: round_even(o.y + o.h / 2, 0))) vy from {rows}"""
    two = f"""select *, 1 + len({gaps('vx', 60)}) nc, 1 + len({gaps('vy', 50)}) nr, list_sort(list_transform(m, lambda o: {{a: greatest(0.0, o.x), b: least(wide, o.x + o.w)}})) ix,
 list_sort(list_transform(m, lambda o: {{a: greatest(0.0, o.y), b: least(high, o.y + o.h)}})) iy from ({one})"""
    three = f"""select *, len(m) >= 2 and len(list_filter(m, lambda o: o.kind = 'connector')) = 0 and not (len(m) >= 4 and nc >= 2 and nr >= 2 and len(m) >= 0.6 * nc * nr) may, {found('ix')} cx, {found('iy')} cy from ({two})"""
    four = f"select *, case when may then {fit('cx', 'x', 'w')} end fx, case when may then {fit('cy', 'y', 'h')} end fy from ({three})"
    return f"(select deck_id, page, piece, m, fx is not null across, coalesce(fx, fy) cut from ({four}))"


def _cut_sql(least: float) -> str:
    side = "case when across then o.x else o.y end >= cut"
    end = "case when across then o.x + o.w else o.y + o.h end <= cut"
    return O.replace("with o", "with recursive o", 1) + f""", c(deck_id, page, piece, m) as (select deck_id, page, '', list({{z: z_index, kind: kind, x: x, y: y, w: w, h: h}} order by z_index) from o group by all union all
 select deck_id, page, piece || side, case side when '0' then list_filter(m, lambda o: {end}) else list_filter(m, lambda o: {side}) end from {_with_cuts('c', least)}, (select unnest(['0', '1']) side) where cut is not null)
 select deck_id, page, piece, unnest(list_transform(m, lambda o: o.z)) z_index from {_with_cuts('c', least)} where cut is null"""


ORACLE_SQL = {
    "obj_clusters": _CLUSTERS + " select deck_id, page, z_index, root from roots",
    "obj_corridor_cuts": _cut_sql(rg.CUT_SHARE * ob.PAGE_W * ob.PAGE_H),
    "obj_small_cuts": _cut_sql(SMALL),
    "obj_regions": _REGIONS + " select deck_id, page, z_index, dense_rank() over (partition by deck_id, page order by root) region from roots",
    "obj_big": O + f" select deck_id, page, z_index, kind in ('raster', 'vector', 'visio') and w * h >= {rg.BIG_SHARE * ob.PAGE_W * ob.PAGE_H} is_big from o",
    "obj_band_means": O + """, v as (select deck_id, page, round_even(x + w / 2, 0) v from o), g as (select *, v - lag(v) over (partition by deck_id, page order by v) gap from v),
 b as (select *, 1 + sum(case when gap > 60 then 1 else 0 end) over (partition by deck_id, page order by v) band from g) select deck_id, page, cast(band as bigint) band, avg(v) mean, count(*) n from b group by all""",
    "text_batches": """with recursive p as (select source deck, doc_id page_key, length(text) size, row_number() over (partition by source order by doc_id) i from documents),
 b(deck, i, batch, chars, n) as (select deck, i, cast(0 as bigint), size, 1 from p where i = 1 union all
 select p.deck, p.i, case when chars + size > 48000 or n >= 20 then batch + 1 else batch end, case when chars + size > 48000 or n >= 20 then size else chars + size end, case when chars + size > 48000 or n >= 20 then 1 else n + 1 end
 from b join p on p.deck = b.deck and p.i = b.i + 1) select deck, page_key, size, batch from p join b using (deck, i)""",
}
