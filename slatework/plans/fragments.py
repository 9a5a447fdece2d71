"""SQL of the object view, seeds, members and blocks that several queries build on."""

from __future__ import annotations

from ..sources.carriers import OBJECTS_SQL

O = f"with o as ({OBJECTS_SQL})"
NOISE = """case when kind = 'formula' then 'drop formula' when trim(text) <> '' then 'keep text'
 when kind in ('raster','vector') and w >= 864 and h > 0 and h <= 80 then 'drop banner' when kind in ('raster','vector','visio') then 'keep file' when kind = 'table' then 'keep table'
 when w * h < 1600 or least(w, h) < 48 or greatest(w, h) > 10 * least(w, h) then 'drop small' else 'keep rest' end"""
BODY = O + f""", lastp as (select deck_id, max(page) last_page from o group by all),
vis as (select o.* from o join lastp using (deck_id) where {NOISE} like 'keep%' and kind <> 'text_region' and w > 0 and h > 0
 and x + w / 2 between 0 and 960 and y + h / 2 between 0 and 720 and not (last_page >= 2 and (page = 1 or page = last_page)))"""
SEEDS = BODY + """, sd as (select *, printf('blk_%02d', n) block_id from (select *, row_number() over (partition by deck_id, page order by z_index) n from vis
 where kind in ('group','visio') or (kind in ('vector','raster') and preview_of = '' and (kind <> 'raster' or w * h >= 138240))) where n <= 6)"""
MEMBERS = SEEDS + """, mem as (select deck_id, page, block_id, 0 ord, z_index, kind, x, y, w, h, text from sd union all
 select s.deck_id, s.page, block_id, 1, v.z_index, v.kind, v.x, v.y, v.w, v.h, v.text from sd s join vis v on s.deck_id = v.deck_id and s.page = v.page
 where s.kind = 'raster' and v.kind = 'shape' and trim(v.text) <> '' and v.x + v.w / 2 between s.x and s.x + s.w and v.y + v.h / 2 between s.y and s.y + s.h)"""
BLOCKS = MEMBERS + """, blk as (select deck_id, page, block_id, round(min(x), 1) x, round(min(y), 1) y, round(max(x + w) - min(x), 1) w, round(max(y + h) - min(y), 1) h,
 min(z_index) z_min, max(z_index) z_max, count(*) n_members, coalesce(string_agg(text, chr(10) order by ord, z_index) filter (trim(text) <> ''), '') text,
 sum(case when kind in ('shape','connector','group') then length(text) else 0 end) chars,
 case when count(*) > 1 then 'decorated_diagram' else case arg_min(kind, ord) when 'vector' then 'vector_image' when 'visio' then 'visio_diagram' when 'group' then 'group_diagram' else 'raster_image' end end block_type
 from mem group by deck_id, page, block_id)"""
