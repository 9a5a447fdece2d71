"""The registered queries of the deck operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import bindings as bd
from ..operators import objects as ob
from ..operators import records as rc
from ..operators import text as tx
from . import documents, files, layouts, outputs, packages, pictures, readers
from .fragments import BLOCKS, BODY, MEMBERS, O, SEEDS
from ..sources.carriers import LINES_SQL, conversation_pages, lines, objects, table

WORDS = {"english": ["the", "and", "thing"], "french": ["le ", "de ", "que"], "german": ["der", "ein", "ung"]}


def _docs(spark, d):
    return table(spark, d, "documents")


def _images(spark, d):
    """Objects with a share of ink and a number of colours."""
    return objects(spark, d).withColumn("ink", F.col("h") % 10 / 10).withColumn("colours", F.col("x") % 12)


def _log(spark, d):
    """Events as entries of steps: deck = user, step = type; status and artifact from the value."""
    status = F.when(F.col("value") < 20, "partial").when(F.col("value") < 60, "done").otherwise("failed")
    return table(spark, d, "events").select(F.col("user_id").alias("deck"), F.col("event_type").alias("step"), F.col("ts").alias("at"), F.col("event_id").alias("n"), status.alias("status"), (F.col("value") < 40).alias("artifact"))


def _targets(spark, d):
    """Raster objects, and for each deck one that is not there."""
    own = objects(spark, d)
    keys = own.where("kind = 'raster'").select("deck_id", "page", "z_index")
    return keys.unionByName(own.select("deck_id", F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("z_index")).distinct())


def _bound(spark, d):
    """Documents as pages of text, raw pages as images of every third page, turns' conversations as captioned files."""
    texts = _docs(spark, d).select(F.col("doc_id").alias("page"), "text")
    images = table(spark, d, "pages").select(F.floor(F.col("page_id") * 3 / 2).cast("bigint").alias("page"), F.col("page_id").alias("file"))
    return bd.bind_pages(texts, images, table(spark, d, "conversations").select(F.col("conv_id").alias("file"), "text"))


QUERIES = {
    "formula_symbols": lambda s, d: lines(s, d).select("deck", "page_key", "seq", bd.is_formula(F.col("text")).alias("keep")),
    "del_renumber": lambda s, d: bd.delete_objects(objects(s, d), _targets(s, d)),
    "del_summary": lambda s, d: bd.delete_summary(objects(s, d), _targets(s, d)),
    "page_binding": _bound,
    "page_binding_summary": lambda s, d: bd.binding_summary(_bound(s, d)),
    "rule_relations": lambda s, d: bd.rule_relations(objects(s, d), ob.seeds(objects(s, d))),
    "text_exclusion": lambda s, d: tx.exclude(lines(s, d), 0.1, 12),
    "text_numbering": lambda s, d: tx.number(tx.exclude(lines(s, d), 0.1, 12)),
    "text_tidy_adjacent": lambda s, d: tx.tidy(lines(s, d)),
    "text_direct_pages": lambda s, d: tx.direct_pages(_docs(s, d)),
    "text_subject_keywords": lambda s, d: tx.subject(_docs(s, d), WORDS, "other"),
    "page_titles": lambda s, d: tx.titles(_docs(s, d)),
    "page_outer_merge": lambda s, d: tx.merge_sources(conversation_pages(s, d), "user", "assistant"),
    "page_missing": lambda s, d: _docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti"),
    "obj_noise_filter": lambda s, d: objects(s, d).select("deck_id", "page", "z_index", ob.outcome().alias("outcome")),
    "obj_visibility": lambda s, d: ob.body(objects(s, d)).select("deck_id", "page", "z_index", "kind"),
    "obj_block_seeds": lambda s, d: ob.seeds(objects(s, d)).select("deck_id", "page", "z_index", "block_id"),
    "obj_block_types": lambda s, d: ob.blocks(objects(s, d)),
    "obj_summary": lambda s, d: ob.summary(objects(s, d)),
    "obj_adjacency": lambda s, d: ob.adjacency(objects(s, d)),
    "obj_components": lambda s, d: ob.page_components(objects(s, d), ob.adjacency(objects(s, d))),
    "obj_knn2": lambda s, d: ob.nearest_two(objects(s, d)),
    "obj_heuristic_edges": lambda s, d: ob.neighbour_edges(objects(s, d)),
    "obj_tree_test": lambda s, d: ob.tree_pages(objects(s, d), ob.neighbour_edges(objects(s, d))),
    "obj_grid_detect": lambda s, d: ob.grids(objects(s, d)),
    "obj_gap_cuts": lambda s, d: ob.gap_cuts(objects(s, d)),
    "obj_text_absorb": lambda s, d: ob.members(objects(s, d)).select("deck_id", "page", "block_id", "ord", "z_index"),
    "text_section_split": lambda s, d: tx.sections(lines(s, d), F.col("seq") % 5 == 2, F.col("seq")),
    "text_dollar_toggle": lambda s, d: tx.toggled(lines(s, d), F.col("seq") % 4 == 0),
    "obj_preview_asof": lambda s, d: rc.preview_asof(table(s, d, "events"), "error", "view", 6 * 3600),
    "rec_index": lambda s, d: rc.record_index(objects(s, d)),
    "rec_inventory": lambda s, d: rc.inventory(objects(s, d)),
    "rec_media_reuse": lambda s, d: rc.reused(table(s, d, "lineitem"), "l_partkey"),
    "img_rule_filter": lambda s, d: ob.image_filter(_images(s, d)).select("deck_id", "page", "z_index", "verdict"),
    "img_gallery": lambda s, d: rc.gallery(ob.image_filter(_images(s, d)).where("verdict = 'keep'")),
    "cap_relevance_default": lambda s, d: rc.relevance(_docs(s, d), table(s, d, "labels")),
    "cap_relevance_reasons": lambda s, d: rc.reasons(rc.relevance(_docs(s, d), table(s, d, "labels"))),
    "merge_prev": lambda s, d: rc.merge_previous(_docs(s, d).select("doc_id", F.lit(-1).alias("quality")), table(s, d, "labels"), "doc_id", "quality"),
    "json_repair": lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(fn.json_in_prose(F.concat(F.lit("Answer: "), "props", F.lit(" (end)"))), "$.k", "bigint").alias("k")),
    "xml_histogram": lambda s, d: rc.tag_histogram(table(s, d, "pages")),
    "del_exclusive": lambda s, d: rc.exclusive_links(table(s, d, "pages")),
    "state_plan": lambda s, d: rc.state_plan(_log(s, d)),
}

_L = f"with l as ({LINES_SQL}), r as (select * from l where text <> '')"
_EXCLUDED = _L + """, p as (select deck, text, count(distinct page_key) on_pages from r group by all), n as (select deck, count(distinct page_key) pages from r group by all),
x as (select r.deck, page_key, seq, r.text, ph, case when ph in ('ftr','sldNum','hdr','dt') then 'placeholder' when pages >= 2 and on_pages >= 0.1 * pages then 'global'
 when length(r.text) < 12 then 'short' end reason from r join p on r.deck = p.deck and r.text = p.text join n on r.deck = n.deck)"""
_PAIRS = O + """, p as (select o.*, b.z_index bz, b.kind bk, b.text bt, b.x bx, b.y byy, b.w bw, b.h bh from o join o b using (deck_id, page))"""

_EDGES = _PAIRS + """, q as (select *, bx + bw / 2 - x - w / 2 dx, byy + bh / 2 - y - h / 2 dy from p where z_index <> bz),
 k as (select *, dx * dx + dy * dy d2, row_number() over (partition by deck_id, page, z_index order by dx * dx + dy * dy, bz) rn from q where dx > -10 and dy > -10 and (dx > 0 or dy > 0)),
 e as (select deck_id, page, z_index a, bz b from k where rn = 1 and d2 < 160000)"""
_NEAR = """, g as (select *, greatest(x, bx) - least(x + w, bx + bw) gx, greatest(y, byy) - least(y + h, byy + bh) gy, case when trim(text) <> '' and trim(bt) <> '' then 100 else 40 end t from p where z_index < bz),
 e as (select deck_id, page, z_index a, bz b from g where (gx <= t and gy <= 40) or (gy <= t and gx <= 40))"""
_ROOTS = """, s as (select deck_id, page, a, b from e union all select deck_id, page, b, a from e),
 reach(deck_id, page, z_index, r) as (select deck_id, page, z_index, z_index from o union select reach.deck_id, reach.page, s.b, r from reach join s on reach.deck_id = s.deck_id and reach.page = s.page and reach.z_index = s.a),
 roots as (select deck_id, page, z_index, min(r) root from reach group by all)"""
_BANDS = """, {c} as (select deck_id, page, 1 + count(*) filter (d > {t}) {c}, count(*) n from (select deck_id, page, v - lag(v) over (partition by deck_id, page order by v) d from (select deck_id, page, round_even({v}, 0) v from o)) group by deck_id, page)"""
_IMAGES = O + """, im as (select *, case when kind = 'vector' and w * h < 10000 then 'drop vector fragment' when kind = 'raster' and w * h < 40000 and h % 10 / 10 < 0.20 then 'drop fragment'
 when least(w, h) < 48 then 'drop small' when greatest(w, h) / least(w, h) > 10 then 'drop thin' when kind = 'raster' and x % 12 <= 4 then 'drop plain' else 'keep' end verdict from o where kind in ('raster','vector'))"""
_RELEVANT = """with rel as (select doc_id, coalesce(toxic, 0) <> 1 as keep, case when toxic = 1 then 'toxic' when toxic is null then 'no verdict' else '' end reason from documents left join labels using (doc_id))"""

_BOUND = """with i as (select cast(floor(page_id * 3 / 2) as bigint) page, count(*) images, count(*) filter (page_id in (select conv_id from conversations)) captioned from pages group by all),
b as (select coalesce(d.doc_id, i.page) page, d.text is not null has_text, coalesce(images, 0) images, coalesce(captioned, 0) captioned from documents d full join i on d.doc_id = i.page)"""

ORACLE_SQL = {
    "formula_symbols": _L + f" select deck, page_key, seq, trim(text) = '' or regexp_matches(text, '{bd.formula_pattern()}') keep from l",
    "del_renumber": O + """ select deck_id, page, z_index, row_number() over (partition by deck_id, page order by z_index) number,
 row_number() over (partition by deck_id order by page, z_index) deck_number from o where kind <> 'raster'""",
    "del_summary": O + " select deck_id, count(*) filter (kind = 'raster') deleted, count(*) filter (kind <> 'raster') kept, 1 missing from o group by all",
    "page_binding": _BOUND + " select page, has_text, images, captioned from b",
    "page_binding_summary": _BOUND + " select count(*) pages, count(*) filter (has_text) pages_with_text, count(*) filter (images > 0) pages_with_image, sum(images) images from b",
    "rule_relations": SEEDS + f""", an as (select deck_id, page, left(arg_min(trim(text), z_index), 60) text_anchor from o where trim(text) <> '' group by all)
 select deck_id, page, block_id, printf('rel_%02d_%02d', page, row_number() over (partition by deck_id, page order by z_index)) relation_id, coalesce(text_anchor, '') text_anchor, 'elaboration' relation_type,
 '{bd.RULE_LINK}' semantic_link from sd left join an using (deck_id, page)""",
    "text_exclusion": _EXCLUDED + " select deck, page_key, seq, text, ph, reason from x",
    "text_numbering": _EXCLUDED + " select deck, page_key, seq, printf('TXT%03d-%02d', page_key, row_number() over (partition by deck, page_key order by seq)) id, text from x where reason is null",
    "text_tidy_adjacent": _L + " select deck, page_key, seq, text from (select *, lag(text) over (partition by deck, page_key order by seq) b from r) where b is null or b <> text",
    "text_direct_pages": "select doc_id, cast(length(replace(replace(text, ' ', ''), chr(10), '')) as bigint) n_chars_solid from documents where length(replace(replace(text, ' ', ''), chr(10), '')) > 500",
    "page_missing": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "obj_noise_filter": O + """ select deck_id, page, z_index, case when kind = 'formula' then 'drop formula' when trim(text) <> '' then 'keep text'
 when kind in ('raster','vector') and w >= 864 and h > 0 and h <= 80 then 'drop banner' when kind in ('raster','vector','visio') then 'keep file' when kind = 'table' then 'keep table'
 when w * h < 1600 or least(w, h) < 48 or greatest(w, h) > 10 * least(w, h) then 'drop small' else 'keep rest' end outcome from o""",
    "obj_adjacency": _PAIRS + """, g as (select *, greatest(x, bx) - least(x + w, bx + bw) gx, greatest(y, byy) - least(y + h, byy + bh) gy,
 case when trim(text) <> '' and trim(bt) <> '' then 100 else 40 end t from p where z_index < bz)
 select deck_id, page, z_index a, bz b from g where (gx <= t and gy <= 40) or (gy <= t and gx <= 40)""",
    "obj_heuristic_edges": _PAIRS + """, q as (select *, bx + bw / 2 - x - w / 2 dx, byy + bh / 2 - y - h / 2 dy from p where z_index <> bz),
 k as (select *, dx * dx + dy * dy d2, row_number() over (partition by deck_id, page, z_index order by dx * dx + dy * dy, bz) rn from q where dx > -10 and dy > -10 and (dx > 0 or dy > 0))
 select deck_id, page, z_index a, bz b from k where rn = 1 and d2 < 160000""",
    "obj_gap_cuts": O + """, e as (select deck_id, page, greatest(x, 0) a, least(x + w, 960) b, z_index from o),
 m as (select *, max(b) over (partition by deck_id, page order by a, b, z_index rows between unbounded preceding and 1 preceding) reach from e)
 select deck_id, page, (reach + a) / 2 cut from m where a - reach > 40""",
    "obj_visibility": BODY + " select deck_id, page, z_index, kind from vis",
    "obj_block_seeds": SEEDS + " select deck_id, page, z_index, block_id from sd",
    "obj_text_absorb": MEMBERS + " select deck_id, page, block_id, ord, z_index from mem",
    "obj_block_types": BLOCKS + " select deck_id, page, block_id, x, y, w, h, z_min, z_max, n_members, text, block_type, round(chars / greatest(w * h, 1.0) * 1e6, 3) text_density from blk",
    "obj_summary": BLOCKS + """ select deck_id, slides, coalesce(t, 0) blocks_total, coalesce(sp, 0) slides_with_blocks, coalesce(c, 0) composed from (select deck_id, count(distinct page) slides from o group by all)
 left join (select deck_id, count(*) t, count(distinct page) sp, count(*) filter (n_members > 1) c from blk group by deck_id) using (deck_id)""",
    "obj_knn2": _PAIRS + """, k as (select *, pow(x + w / 2 - bx - bw / 2, 2) + pow(y + h / 2 - byy - bh / 2, 2) d2 from p where kind = 'connector' and bk <> 'connector')
 select deck_id, page, z_index, rank, node, d2 from (select deck_id, page, z_index, bz node, d2, row_number() over (partition by deck_id, page, z_index order by d2, bz) rank from k) where rank <= 2""",
    "obj_components": (_PAIRS + _NEAR + _ROOTS).replace("with o", "with recursive o", 1) + " select deck_id, page, z_index, root from roots",
    "obj_tree_test": (_EDGES + _ROOTS).replace("with o", "with recursive o", 1) + """ select deck_id, page, nodes, coalesce(ne, 0) edges, coalesce(ne, 0) = nodes - 1 and parts = 1 is_tree
 from (select deck_id, page, count(*) nodes, count(distinct root) parts from roots group by all) left join (select deck_id, page, count(*) ne from e group by all) using (deck_id, page)""",
    "obj_grid_detect": O + _BANDS.format(c="cols", t=60, v="x + w / 2") + _BANDS.format(c="rws", t=50, v="y + h / 2") + """ select deck_id, page, cols.n n, cols, rws as rows, cols >= 2 and rws >= 2 and cols.n >= 0.6 * cols * rws is_grid from cols join rws using (deck_id, page) where cols.n >= 4""",
    "text_section_split": _L + """, x as (select *, max(case when seq % 5 = 2 then seq end) over (partition by deck, page_key order by seq) section from l) select deck, page_key, section, seq, text from x where section is not null and seq % 5 <> 2""",
    "text_dollar_toggle": _L + """, x as (select *, sum(case when seq % 4 = 0 then 1 else 0 end) over (partition by deck, page_key order by seq) marks from l) select deck, page_key, seq, cast((marks + 1) // 2 as bigint) block, text from x where marks % 2 = 1 and seq % 4 <> 0""",
    "page_outer_merge": """with t as (select conv_id, turn // 2 page, turn, role, text from conversations), a as (select conv_id, page, string_agg(text, chr(10) order by turn, text) left_text from t where role = 'user' group by all),
 b as (select conv_id, page, string_agg(text, chr(10) order by turn, text) right_text from t where role = 'assistant' group by all)
 select conv_id, cast(page as bigint) page, coalesce(left_text, '') left_text, coalesce(right_text, '') right_text from a full join b using (conv_id, page)""",
    "obj_preview_asof": """select v.event_id, case when epoch_us(v.ts) - epoch_us(e.ts) <= 21600000000 then e.event_id end preview_of from (from events where event_type = 'view') v
 asof left join (from events where event_type = 'error') e on v.user_id = e.user_id and v.ts >= e.ts""",
    "rec_index": O + " select deck_id, page, z_index, kind, row_number() over (partition by deck_id, page, kind order by z_index) as index from o",
    "rec_inventory": O + " select deck_id, kind, count(*) records, count(*) filter (preview_of <> '') previews from o group by all",
    "rec_media_reuse": "select l_partkey media, count(*) refs from lineitem where l_partkey is not null group by all having count(*) > 1",
    "img_rule_filter": _IMAGES + " select deck_id, page, z_index, verdict from im",
    "img_gallery": _IMAGES + " select deck_id, page, z_index, printf('IMG%04d', row_number() over (partition by deck_id order by page, z_index)) img_id from im where verdict = 'keep'",
    "cap_relevance_default": _RELEVANT + " select doc_id, keep, reason from rel",
    "cap_relevance_reasons": _RELEVANT + " select case when trim(reason) = '' then 'other' else reason end reason, count(*) documents from rel group by 1",
    "merge_prev": "select doc_id, coalesce(quality, -1) quality, quality is not null reused from documents left join labels using (doc_id)",
    "json_repair": "select event_id, cast(regexp_extract(props, '\"k\": *(\\d+)', 1) as bigint) k from events",
    "xml_histogram": "select tag, count(*) n from (select unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) tag from pages) group by tag order by n desc, tag limit 12",
    "del_exclusive": """select link, count(distinct page_id) pages, count(distinct page_id) <= 1 as exclusive from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from pages) group by link""",
    "state_plan": """select user_id deck, event_type step, case when v < 20 then 'resume' when v < 40 then 'skip' else 'run' end action from (select user_id, event_type, arg_max(value, (ts, event_id)) v from events group by all)""",
    "page_titles": """with t as (select doc_id, coalesce(left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 60), '') title from documents),
 c as (select doc_id, title, trim(regexp_replace(title, '[ \\t]+', ' ', 'g')) clean from t) select doc_id, title, case when length(clean) > 30 then left(clean, 30) || '…' else clean end short_title from c""",
    "text_subject_keywords": "with h as (select doc_id, " + ", ".join("+".join(f"cast(contains(text, '{k}') as bigint)" for k in words) + f" {name}" for name, words in WORDS.items()) + """ from documents),
 b as (select *, greatest(english, french, german) hits from h) select doc_id, case when hits = 0 then 'other' when english = hits then 'english' when french = hits then 'french' else 'german' end subject, hits from b""",
}

for module in (packages, readers, documents, layouts, pictures, outputs, files):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
