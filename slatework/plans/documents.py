"""Queries of block documents, bindings and deletes on the object view, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bindings as bd
from ..operators import documents as dc
from ..operators import objects as ob
from ..sources.carriers import objects
from ..sources.sinks import stored
from .fragments import BLOCKS, MEMBERS, SEEDS, O
from .readers import _MD, markdown_lines

PAGE = ob.PAGE


def _relations(s: SparkSession, d: str) -> DataFrame:
    return bd.rule_relations(objects(s, d), ob.seeds(objects(s, d)))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """The blocks, stored: deletes read them several times."""
    return stored(ob.blocks(objects(s, d)))


def _gone(rows: DataFrame) -> DataFrame:
    """Of blocks, those of rasters on every third page, and on every page one that is not there."""
    own = rows.where("block_type = 'raster_image' and page % 3 = 0").select(*dc.BLOCK)
    return own.unionByName(rows.select(*PAGE, F.lit("blk_99").alias("block_id")).distinct())


def _documents(s: SparkSession, d: str) -> DataFrame:
    rows = objects(s, d)
    titles = rows.where(F.trim("text") != "").groupBy(*PAGE).agg(F.min_by(F.trim("text"), "z_index").alias("title"))
    found = dc.page_documents(rows.select(*PAGE).distinct(), ob.blocks(rows), _relations(s, d), titles)
    return found.select(
        *PAGE, "slide_id", "title", F.array_join("reading_order", ",").alias("reading_order"), F.size("visual_blocks").cast("bigint").alias("blocks"),
        F.array_join(F.transform("visual_blocks", lambda b: b["block_type"]), ",").alias("types"), F.array_join(F.transform("relations", lambda r: r["relation_id"]), ",").alias("relations"),
    )


def _cascade(s: SparkSession, d: str) -> DataFrame:
    return dc.renumber(dc.delete_blocks(_relations(s, d), _gone(_blocks(s, d)))).select(*PAGE, "block_id", "relation_id", "binding_id", "text_anchor")


def _verify(s: SparkSession, d: str) -> DataFrame:
    """After blocks and bindings were deleted and relations forgotten."""
    blocks, relations = _blocks(s, d), stored(_relations(s, d))
    gone = _gone(blocks)
    return dc.verify(gone, blocks=dc.delete_blocks(blocks, gone), relations=relations, bindings=dc.delete_blocks(dc.bindings(blocks, relations), gone))


def _captions_left(s: SparkSession, d: str) -> DataFrame:
    rows = markdown_lines(s, d)
    files = rows.where("seq <= 64 and deck % 2 = 0").select("deck", F.format_string("slide_%02d_%d.png", F.col("seq") % 5 + 1, F.lit(0)).alias("file"))
    return dc.delete_captions(rows, files)


def _sources(s: SparkSession, d: str) -> DataFrame:
    blocks = ob.blocks(objects(s, d))
    end = F.element_at(F.array(*map(F.lit, ("_grp.xml", ".png", ".svg", "x.xml"))), (F.col("page") % 4 + 1).cast("int"))
    files = blocks.select("deck_id", F.concat(F.format_string("slide_%02d_", "page"), "block_id", end).alias("name"))
    return dc.source_blocks(files, blocks)


def _images(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pictures of the object view bound to what other objects say of them, and pages of text."""
    rows = objects(s, d).where("deck_id < 10")
    files = rows.where("kind in ('raster', 'vector')").withColumn("file", F.format_string("slide_%02d_%d.png", "page", "z_index"))
    captions = files.where("z_index % 2 = 1").select("deck_id", "file", F.format_string("IMG%04d", F.col("page") * 10 + F.col("z_index")).alias("img_id"), F.concat("text", F.lit("，。")).alias("text"))
    entries = rows.where("kind in ('shape', 'table')").select(*PAGE, F.col("z_index").alias("ord"), F.when(F.col("kind") == "shape", "内容").otherwise("标题").alias("type"), F.format_string("TXT%03d-%02d", "page", "z_index").alias("text_id"), "text")
    manifest = files.where("z_index % 3 <> 0").select(*PAGE, "file", F.lit("m").alias("source"), F.upper("kind").alias("form"), (F.col("z_index") % 2 * 100).cast("double").alias("width"), F.lit(0.0).alias("height"), F.col("w").alias("shape_w"), F.col("h").alias("shape_h"), "x", "y")
    links = files.where("z_index % 5 = 1").select("deck_id", "file", F.concat(F.lit("r"), "text").alias("relation"), F.lit("示意。").alias("role"))
    texts = rows.where("kind = 'group'").groupBy(*PAGE).agg(F.min("text").alias("text")).withColumn("title", F.lit("t"))
    return bd.bind_images(files.select(*PAGE, "file"), captions, entries, manifest, links), texts


QUERIES = {
    "block_topology": lambda s, d: dc.topology(ob.members(objects(s, d))),
    "block_captions": lambda s, d: dc.rule_captions(ob.members(objects(s, d))),
    "bind_blocks": lambda s, d: dc.bindings(ob.blocks(objects(s, d)), _relations(s, d)).select(*dc.BLOCK, "relation_id", "block_type", "text_anchor", "relation_type"),
    "block_histogram": lambda s, d: dc.histogram(ob.blocks(objects(s, d))),
    "page_documents": _documents,
    "del_plan": lambda s, d: dc.delete_plan(rows := _blocks(s, d), _gone(rows)),
    "del_cascade": _cascade,
    "del_deck_summary": lambda s, d: dc.deck_summary(objects(s, d), dc.delete_blocks(rows := _blocks(s, d), _gone(rows))),
    "del_verify": _verify,
    "del_captions": _captions_left,
    "block_sources": _sources,
    "bind_images": lambda s, d: _images(s, d)[0],
    "bind_image_summary": lambda s, d: bd.image_summary(bd.bound_pages(_images(s, d)[1], _images(s, d)[0])),
}

_T = BLOCKS + """, t as (select deck_id, page, block_id from blk where block_type = 'raster_image' and page % 3 = 0),
 an as (select deck_id, page, left(arg_min(trim(text), z_index), 60) text_anchor from o where trim(text) <> '' group by all),
 rel as (select deck_id, page, block_id, printf('rel_%02d_%02d', page, row_number() over (partition by deck_id, page order by z_index)) relation_id, coalesce(text_anchor, '') text_anchor from sd left join an using (deck_id, page))"""
_IMG = O + """, r as (select * from o where deck_id < 10), f as (select *, printf('slide_%02d_%d.png', page, z_index) file from r where kind in ('raster', 'vector')),
 e as (select deck_id, page, z_index, kind, text, row_number() over (partition by deck_id, page order by z_index) place from r where kind in ('shape', 'table')),
 c as (select deck_id, page, coalesce(min(case when kind = 'shape' and length(text) >= 4 then place end), 1) paragraph from e group by all),
 p as (select c.*, printf('TXT%03d-%02d', e.page, e.z_index) text_id from c join e on e.deck_id = c.deck_id and e.page = c.page and e.place = c.paragraph),
 g as (select f.*, case when z_index % 2 = 1 then page * 10 + z_index end given, row_number() over (partition by deck_id order by page, file) n from f),
 h as (select *, max(greatest(n, coalesce(given, 0))) over (partition by deck_id) top, given is null and exists (from g g2 where g2.deck_id = g.deck_id and g2.given = g.n) clash from g),
 i as (select *, case when clash then printf('IMG%04d', top + row_number() over (partition by deck_id, clash order by page, file)) else printf('IMG%04d', coalesce(given, n)) end image_id from h),
 b as (select i.deck_id, i.page, file, case when z_index % 2 = 1 then text || '，。' else '' end caption, case when z_index % 3 <> 0 then 'm' else '' end source, case when z_index % 3 <> 0 then kind else 'unknown' end kind, image_id,
  coalesce(paragraph, 0) paragraph, coalesce(text_id, '') text_id, case when z_index % 3 = 0 then cast(0 as double) when z_index % 2 = 1 then 100 else w end w, case when z_index % 3 = 0 then cast(0 as double) else h end h,
  case when z_index % 3 = 0 then cast(0 as double) else x end x, case when z_index % 3 = 0 then cast(0 as double) else y end y,
  '位于第 ' || i.page || ' 页' || case when paragraph > 0 then '（第 ' || paragraph || ' 段）' else '' end || '，该图对该页文字表达起『' || case when z_index % 5 = 1 then '示意' else '辅助理解本页知识点' end || '』的作用' as position,
  case when z_index % 5 = 1 then 'r' || text when z_index % 2 = 1 then text else '' end relation from i left join p using (deck_id, page))"""

ORACLE_SQL = {
    "block_topology": (MEMBERS + """, nd as (select deck_id, page, block_id, ord, z_index, x + w / 2 cx, y + h / 2 cy from mem where kind not in ('connector', 'formula')),
 q as (select a.*, b.ord bo, b.z_index bz, b.cx - a.cx dx, b.cy - a.cy dy from nd a join nd b using (deck_id, page, block_id) where a.z_index <> b.z_index),
 k as (select *, dx * dx + dy * dy d2, row_number() over (partition by deck_id, page, block_id, z_index order by dx * dx + dy * dy, bo, bz) rn from q where dx > -10 and dy > -10 and (dx > 0 or dy > 0)),
 e as (select deck_id, page, block_id, z_index a, bz b from k where rn = 1 and d2 < 160000), u as (select * from e union all select deck_id, page, block_id, b, a from e),
 reach(deck_id, page, block_id, z, r) as (select deck_id, page, block_id, z_index, z_index from nd union select reach.deck_id, reach.page, reach.block_id, u.b, r from reach join u on u.deck_id = reach.deck_id and u.page = reach.page and u.block_id = reach.block_id and u.a = reach.z),
 rt as (select deck_id, page, block_id, z, min(r) root from reach group by all), pt as (select deck_id, page, block_id, count(*) nodes, count(distinct root) parts from rt group by all), ec as (select deck_id, page, block_id, count(*) edges from e group by all)
 select deck_id, page, block_id, nodes, coalesce(edges, 0) edges, case when edges = nodes - 1 and parts = 1 then 'tree' when edges > 0 then 'directed_graph' else 'isolated_nodes' end topology_type from pt left join ec using (deck_id, page, block_id)""").replace("with o", "with recursive o", 1),
    "block_captions": MEMBERS + """, rk as (select *, row_number() over (partition by deck_id, page, block_id order by ord, z_index) n from mem),
 br as (select deck_id, page, block_id, left(coalesce(string_agg(text, '；' order by n) filter (n <= 3 and text <> ''), ''), 80) brief, count(*) n from rk group by deck_id, page, block_id)
 select deck_id, page, block_id, case when brief = '' then '展示本页的可视化内容' else '展示本页与「' || brief || '」相关的可视化内容' end expression_goal, '本块包含 ' || n || ' 个对象' || case when brief = '' then '' else '：' || brief end || '。' vlm_caption from br""",
    "bind_blocks": _T + " select deck_id, page, block_id, relation_id, block_type, text_anchor, 'elaboration' relation_type from rel join blk using (deck_id, page, block_id)",
    "block_histogram": BLOCKS + " select deck_id, block_type, count(*) blocks from blk group by all",
    "page_documents": _T + """, pg as (select distinct deck_id, page from o), fl as (select deck_id, page, arg_min(trim(text), z_index) title from o where trim(text) <> '' group by all),
 bs as (select deck_id, page, count(*) n, string_agg(block_id, ',' order by block_id) ids, string_agg(block_type, ',' order by block_id) types from blk group by all), rs as (select deck_id, page, string_agg(relation_id, ',' order by relation_id) rels from rel group by all)
 select deck_id, page, printf('slide_%03d', page) slide_id, coalesce(title, '') title, 'title_shape_' || page || ',text_body_' || page || coalesce(',' || ids, '') reading_order, coalesce(n, 0) blocks, coalesce(types, '') as types, coalesce(rels, '') relations
 from pg left join fl using (deck_id, page) left join bs using (deck_id, page) left join rs using (deck_id, page)""",
    "del_plan": _T + " select *, true found from t union all select distinct deck_id, page, 'blk_99', false from blk",
    "del_cascade": _T + """, l as (select * from rel anti join t using (deck_id, page, block_id)) select deck_id, page, block_id, printf('rel_%02d_%02d', page, row_number() over (partition by deck_id, page order by relation_id)) relation_id,
 printf('rel_%02d_%02d', page, row_number() over (partition by deck_id order by page, relation_id)) binding_id, text_anchor from l""",
    "del_deck_summary": _T + """, l as (select * from blk anti join t using (deck_id, page, block_id)), c as (select deck_id, count(*) n, count(distinct page) p from l group by all)
 select deck_id, count(distinct o.page) slides, coalesce(any_value(n), 0) blocks_total, coalesce(any_value(p), 0) slides_with_blocks from o left join c using (deck_id) group by deck_id""",
    "del_verify": _T + " select 'blocks' place, 0 residue union all select 'bindings', 0 union all select 'relations', count(*) from rel semi join t using (deck_id, page, block_id)",
    "del_captions": _MD + """, fl as (select distinct deck, printf('slide_%02d_%d.png', seq % 5 + 1, 0) file from m where seq <= 64 and deck % 2 = 0),
 x as (select *, coalesce(last_value(case when regexp_matches(text, '^###\\s+(IMG\\d+)\\s*—') then regexp_extract(text, '`([^`]+)`', 1) when number is not null then '' end ignore nulls) over (partition by deck order by seq), '') file from n)
 select deck, seq, text from x anti join fl using (deck, file)""",
    "block_sources": BLOCKS + """ select deck_id, page, block_id, printf('slide_%02d_', page) || block_id || case page % 4 when 0 then '_grp.xml' when 1 then '.png' else '.svg' end as name,
 case page % 4 when 0 then 'xml' when 1 then 'image' else '' end channel, block_type from blk where page % 4 <> 3""",
    "bind_images": _IMG + " select * from b",
    "bind_image_summary": _IMG + """, tp as (select distinct deck_id, page from r where kind = 'group'), pg as (select deck_id, page, count(file) n, count(*) filter (relation <> '') rl from b group by all),
 al as (select coalesce(tp.deck_id, pg.deck_id) deck_id, n, rl from tp full join pg on tp.deck_id = pg.deck_id and tp.page = pg.page)
 select deck_id, count(*) pages, coalesce(sum(n), 0) images_total, count(n) pages_with_image, coalesce(sum(rl), 0) relations, coalesce(sum(n), 0) positions from al group by deck_id""",
}
