"""Queries of files that earlier runs have left, of versions, pixels, formula files and raw groups, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bindings as bd
from ..operators import documents as dc
from ..operators import exports as ex
from ..operators import markdown as md
from ..operators import objects as ob
from ..operators import package as pk
from ..operators import pixels as px
from ..sources import results, versions
from ..sources.carriers import LINES_SQL, deck_parts, lines, objects, rounds_of, table
from ..sources.decks import in_rounds, list_files, listed_images, write_files
from ..sources.ooxml import drawings
from ..sources.sinks import shared_folder, stored
from .fragments import MEMBERS, SEEDS, O
from .packages import _D
from .readers import _MD, markdown_lines


def _left(s: SparkSession, rows: DataFrame, key: str, place: str, *order: str) -> str:
    """A folder with a JSON file for each key, as a run leaves it."""
    path = shared_folder(s)
    results.write_json_arrays(rows, path, F.concat(F.lit("deck"), F.col(key).cast("string"), F.lit(f"/{place}")), key, *order)
    return path


def _deck(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deck_id", F.regexp_extract("folder", r"deck([^/]*)$", 1)).drop("folder")


def _objects(s: SparkSession, d: str) -> DataFrame:
    box = F.struct("x", "y", "w", "h")
    rows = objects(s, d).select("deck_id", F.format_string("s%d_%d", "page", "z_index").alias("obj_id"), "page", "kind", F.nullif("text", F.lit("")).alias("text"), box.alias("bbox"), "z_index", "preview_of")
    path = _left(s, rows, "deck_id", results.OBJECT_PLACES[1], "page", "z_index")
    return _deck(results.read_objects(s, path)).select("deck_id", "obj_id", "page", "kind", "text", "x", "y", "w", "h", "z_index", "preview_of", "output_file")


def _entries(s: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    rows = lines(s, d).select("deck", F.when(seq % 7 != 0, F.format_string("TXT%d-%d", "page_key", seq)).alias("id"), F.when(seq % 5 != 0, F.col("page_key").cast("int")).alias("page"), "text", F.when(seq % 2 == 0, seq.cast("double")).alias("x"), "page_key", "seq")
    return _deck(results.read_text_entries(s, _left(s, rows, "deck", "text_entries.json", "page_key", "seq")))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """Pictures of the object view, two records for every third: the later one counts."""
    rows = objects(s, d).where("kind in ('raster', 'vector', 'group')")
    file = F.when(F.col("kind") != "group", F.format_string("slide_%02d_%d.png", "page", "z_index"))
    rows = rows.select("deck_id", "page", "z_index", file.alias("output_file"), "kind", F.explode(F.when(F.col("z_index") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("index"))
    return _deck(results.read_manifest(s, _left(s, rows, "deck_id", "manifest.json", "page", "z_index", "index"))).select("deck_id", "page", "output_file", "kind", "index")


#: Line items of the decks whose pictures, and whose blocks' resources, are written in one round.
PICTURED, BOUND = 4_000_000, 2_000_000


def _folders(s: SparkSession, d: str) -> DataFrame:
    """Pictures written to a folder for each deck, and those folders listed by page, some decks at a time."""
    decks = 10
    rounds = min(decks, rounds_of(s, d, PICTURED))

    def run(i: int, path: str) -> DataFrame:
        rows = objects(s, d).where("kind in ('raster', 'vector')").where((F.col("deck_id") < decks) & (F.pmod("deck_id", F.lit(rounds)) == i))
        name = F.concat(F.lit("deck"), F.col("deck_id").cast("string"), F.lit("/"), F.when(F.col("z_index") % 4 == 0, "x_").otherwise(""), F.format_string("slide_%02d_%d.png", "page", "z_index"))
        write_files(rows.select(name.alias("name"), F.encode(F.concat("kind", "text"), "UTF-8").alias("content")), path)
        return _deck(listed_images(s, path))

    return in_rounds(s, rounds, run)


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Blocks and relations as a version, and a next one without the blocks of rasters; what the pointer shows is counted."""
    path = shared_folder(s)
    rows = ob.seeds(objects(s, d))
    orphans = lambda t: t["relations"].join(t["blocks"], [*ob.PAGE, "block_id"], "left_anti")
    versions.publish(s, path, {"blocks": rows, "relations": bd.rule_relations(objects(s, d), rows)}, orphans)
    blocks, relations = (versions.read(s, path, n) for n in ("blocks", "relations"))
    gone = blocks.where("kind = 'raster'").select(*dc.BLOCK)
    versions.publish(s, path, {"blocks": dc.delete_blocks(blocks, gone), "relations": dc.delete_blocks(relations, gone)}, orphans)
    blocks, relations = (versions.read(s, path, n).groupBy("deck_id").agg(F.count("*").alias(n)) for n in ("blocks", "relations"))
    return blocks.join(relations, "deck_id", "full")


def _formulas(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("doc_id % 3 <> 0")
    pages = F.arrays_zip(F.array(*map(F.lit, (1, 4, 4, 7))).alias("page"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("n"))
    rows = docs.select(F.col("doc_id").alias("deck"), F.explode(pages).alias("f")).select("deck", "f.page", "f.n", F.concat(F.lit(" x_"), F.col("deck").cast("string")).alias("latex"))
    return md.place_formulas(markdown_lines(s, d), rows)


def _segments(s: SparkSession, d: str) -> DataFrame:
    return pk.group_segments(deck_parts(s, d, "slides"))


def _line_ends(s: SparkSession, d: str) -> DataFrame:
    return pk.connector_ends(stored(drawings(deck_parts(s, d, "slides"), "owner", "tag", "group", "name", "shape_id", "text", "start_id", "end_id", *"xywh", holding=("cxnSp",))))


def _pngs(s: SparkSession, d: str) -> DataFrame:
    """A small grey png for each page, and a damaged one for some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n in batch.column(0).to_pylist():
                wide, high = 5 + n % 4, 3 + n % 3
                grey = ((n * 7 + np.arange(wide * high) * 13) % 256).astype(np.uint8).reshape(high, wide, 1)
                content = px.encoded(np.repeat(grey, 3, axis=2))
                made.append(content[:50] + bytes([content[50] ^ 1]) + content[51:] if n % 9 == 0 else content)
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "content"])

    return px.measured(table(s, d, "pages").select("page_id").mapInArrow(run, "page_id bigint, content binary"))


def _resource_files(rows: DataFrame) -> DataFrame:
    """What the members of blocks bring along: vectors as emf or svg, diagrams, and pictures, which are none."""
    form = F.when(F.col("kind") == "vector", F.when(F.col("z_index") % 2 == 0, "EMF").otherwise("svg")).when(F.col("kind") == "visio", "vsdx").when(F.col("kind") == "raster", "png")
    files = rows.where(form.isNotNull()).select(*ob.PAGE, "z_index", F.concat(F.lit("m"), F.col("z_index").cast("string"), F.lit("."), form).alias("file"), form.alias("form"))
    return ex.resource_files(ex.member_resources(ob.members(rows), files))


def _binding(s: SparkSession, d: str) -> DataFrame:
    """Binding files written beside each deck's resources, and read again with what is in the folders, some decks at a time."""
    rounds = rounds_of(s, d, BOUND)
    if rounds > 1:
        rounds = min(rounds, objects(s, d).select("deck_id").distinct().count())
    return in_rounds(s, rounds, lambda i, path: _bound_files(s, objects(s, d).where(F.pmod("deck_id", F.lit(rounds)) == i), path))


def _bound_files(s: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    blocks, sources = ob.blocks(rows), stored(_resource_files(rows))
    at = lambda name: F.concat(F.lit("deck"), F.col("deck_id").cast("string"), F.lit("/"), name).alias("name")
    write_files(sources.select(at(F.concat(F.lit("sources/"), "name")), F.encode("file", "UTF-8").alias("content")), path)
    bound = dc.bindings(blocks, bd.rule_relations(rows, ob.seeds(rows)))
    write_files(ex.binding_files(rows, blocks, bound, sources).select(at(F.lit("binding.json")), "content"), path)
    summary = "struct<slides: bigint, blocks_total: bigint, bindings_total: bigint, sources_total: bigint, xml_sources_total: bigint, rldimg_total: bigint>"
    said = s.read.schema(f"stem string, summary {summary}, bindings array<struct<relation_id: string>>").json(f"{path}/*/binding.json")
    there = list_files(s, path).where(F.col("path").rlike(r"/slide_[^/]*$"))
    there = there.select(F.regexp_extract("path", r"deck([^/]*)/sources/", 1).alias("deck_id"), F.regexp_extract("path", r"/sources/(.*)$", 1).alias("name"))
    counted = ex.source_counts(there).withColumnRenamed("sources_total", "files").select("deck_id", "files")
    return said.join(counted, said.stem == counted.deck_id, "left").select(F.col("stem").alias("deck_id"), "summary.*", F.size("bindings").cast("bigint").alias("listed"), "files")


def _counts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select((F.col("page_id") % 20).alias("deck"), F.element_at(F.array(*map(F.lit, ex.FORMULA_SOURCES)), (F.col("page_id") % 4 + 1).cast("int")).alias("source"), (F.col("page_id") % 3 > 0).alias("keep"))
    wanted = rows.groupBy("deck").agg(F.count_if(F.col("source") == "native").alias("natives"), (F.count_if(F.col("source") != "native") + F.first("deck") % 2).alias("equations"))
    return ex.formula_counts(rows, wanted)


def _report(s: SparkSession, d: str) -> DataFrame:
    rows = markdown_lines(s, d)
    images = table(s, d, "embeddings").select((F.col("vec_id") % 300).alias("deck"), F.col("vec_id").alias("file"))
    return ex.report(rows.where("deck % 2 = 0"), rows.where("deck % 3 = 0"), images)


QUERIES = {
    "block_resources": lambda s, d: _resource_files(objects(s, d)),
    "binding_files": _binding,
    "formula_counts": _counts,
    "report_counts": _report,
    "result_objects": _objects,
    "result_entries": _entries,
    "result_manifest": _manifest,
    "result_images": _folders,
    "del_versions": _versions,
    "md_place_formulas": _formulas,
    "package_groups": _segments,
    "package_line_ends": _line_ends,
    "img_png": _pngs,
}

_EMU = "<a:xfrm><a:off x=\"' || cast(x * 9525 as bigint) || '\" y=\"' || cast(y * 9525 as bigint) || '\"/><a:ext cx=\"' || cast(w * 9525 as bigint) || '\" cy=\"' || cast(h * 9525 as bigint) || '\"/></a:xfrm>"
_GROUP = f"""'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="' || z_index || '" name="group ' || z_index || '"/></p:nvGrpSpPr><p:grpSpPr>{_EMU}</p:grpSpPr><p:sp><p:nvSpPr><p:cNvPr id="' || z_index || '" name="inner ' || z_index || '"/></p:nvSpPr><p:spPr>{_EMU}</p:spPr><p:txBody><a:p><a:r><a:t>in </a:t></a:r><a:r><a:t>' || text || '</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>'"""
_NAME = "case kind when 'group' then 'group ' when 'raster' then 'pic ' when 'vector' then 'pic ' when 'visio' then 'drawing ' when 'formula' then case when z_index % 2 = 1 then 'equation ' else 'math ' end when 'connector' then 'line ' when 'table' then 'table ' else 'box ' end || z_index"
_FILES = MEMBERS + """, rf as (select deck_id, page, block_id, printf('slide_%02d_', page) || block_id || '.' || case mem.kind when 'visio' then 'vsdx' when 'vector' then case when z_index % 2 = 0 then 'emf' else 'svg' end end as name, mem.ord, z_index,
  'm' || z_index || '.' || case mem.kind when 'visio' then 'vsdx' else case when z_index % 2 = 0 then 'EMF' else 'svg' end end as file from mem where mem.kind in ('visio', 'vector')),
 src as (select deck_id, page, block_id, file, name from (select *, row_number() over (partition by deck_id, name order by ord desc, z_index desc) n from rf) where n = 1)"""
ORACLE_SQL = {
    "block_resources": _FILES + " select * from src",
    "binding_files": _FILES + """, b as (select deck_id, count(*) n from sd group by all), f as (select deck_id, count(*) n from src group by all)
 select cast(deck_id as varchar) deck_id, slides, coalesce(b.n, 0) blocks_total, coalesce(b.n, 0) bindings_total, coalesce(f.n, 0) sources_total, 0 xml_sources_total, 0 rldimg_total, coalesce(b.n, 0) listed, f.n files
 from (select deck_id, count(distinct page) slides from o group by all) left join b using (deck_id) left join f using (deck_id)""",
    "formula_counts": """with f as (select page_id % 20 deck, page_id % 4 s, page_id % 3 > 0 keep from pages)
 select deck, count(*) filter (keep and s = 0) native, count(*) filter (keep and s = 1) eq3, count(*) filter (keep and s = 2) ocr, count(*) filter (keep and s = 3) placeholder, count(*) filter (keep) total, count(*) filter (not keep) filtered,
 count(*) + deck % 2 expected, deck % 2 = 0 agrees from f group by deck""",
    "report_counts": _MD + """, t as (select deck, count(*) filter (text like '## 第%') pages from m where deck % 2 = 0 group by all), c as (select deck, count(*) filter (text like '### IMG%') captions from m where deck % 3 = 0 group by all),
 i as (select vec_id % 300 deck, count(*) images from embeddings group by all) select deck, coalesce(pages, 0) pages, coalesce(captions, 0) captions, coalesce(images, 0) images from t full join c using (deck) full join i using (deck)""",
    "result_objects": O + " select cast(deck_id as varchar) deck_id, 's' || page || '_' || z_index obj_id, cast(page as int) page, kind, text, x, y, w, h, cast(z_index as int) z_index, preview_of, '' output_file from o",
    "result_entries": f"""with l as ({LINES_SQL}) select deck deck_id, cast(page_key as int) page, 'TXT' || page_key || '-' || seq text_id, text, case when seq % 2 = 0 then cast(seq as double) else 0.0 end x, cast(0 as double) y, cast(0 as double) w, cast(0 as double) h
 from l where seq % 7 <> 0 and seq % 5 <> 0""",
    "result_manifest": O + " select cast(deck_id as varchar) deck_id, cast(page as int) page, printf('slide_%02d_%d.png', page, z_index) output_file, kind, case when z_index % 3 = 0 then 2 else 1 end as index from o where kind in ('raster', 'vector')",
    "result_images": O + " select cast(deck_id as varchar) deck_id, page, printf('slide_%02d_%d.png', page, z_index) file, cast(length(kind || text) as bigint) bytes from o where kind in ('raster', 'vector') and deck_id < 10 and z_index % 4 <> 0",
    "del_versions": SEEDS + " select deck_id, count(*) blocks, count(*) relations from sd where kind <> 'raster' group by all",
    "md_place_formulas": _MD + f""", fmu as (select doc_id deck, unnest([1, 4, 4, 7]) page, unnest([1, 2, 3, 4]) i, 'x_' || doc_id latex from documents where doc_id % 3 <> 0), fk as (select *, row_number() over (partition by deck, page order by i) own from fmu),
 hd as (select deck, number hp, min(seq) hs from n where number is not null group by all), fa as (select fk.deck, page, own, latex, arg_min(hs, hp) place from fk left join hd on hd.deck = fk.deck and hp > page group by all),
 u as (select deck, seq r0, 1 r1, 0 r2, 0 r3, 0 part, text from m union all
  select deck, coalesce(place, 4611686018427387903), 0, page, own, generate_subscripts(e, 1), unnest(e) from (select *, ['', '- **(p' || page || '-img' || own || ')** $$', latex, '$$', '', '{md.FROM_PICTURE}'] e from fa))
 select deck, row_number() over (partition by deck order by r0, r1, r2, r3, part) seq, text from u""",
    "package_groups": _D + f" select deck_id, part, row_number() over (partition by deck_id, part order by z_index) ord, {_GROUP} xml from s where kind = 'group'",
    "package_line_ends": _D + f", e as (select deck_id, part, z_index, {_NAME} as name from s) select s.deck_id, s.part, 'line ' || s.z_index as name, e.name start_name, 'line ' || s.z_index end_name from s left join e on e.deck_id = s.deck_id and e.part = s.part and e.z_index = 1 where kind = 'connector'",
    "img_png": """with p as (select page_id, 5 + page_id % 4 wide, 3 + page_id % 3 high from pages), v as (select *, list_transform(range(0, wide * high), lambda i: (page_id * 7 + i * 13) % 256) px, page_id % 9 <> 0 whole from p)
 select page_id, whole, case when whole then cast(wide as int) end px_wide, case when whole then cast(high as int) end px_high, case when whole then len(list_filter(px, lambda x: x < 200)) / len(px) end ink, case when whole then len(list_distinct(px)) end colours from v""",
}
