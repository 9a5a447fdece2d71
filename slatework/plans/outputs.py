"""Queries of sinks, models and the stream, each read back, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import markdown as md
from ..operators import models
from ..operators import objects as ob
from ..operators import prompts as pr
from ..operators import text as tx
from ..sources import sinks
from ..sources.carriers import LINES_SQL, lines, objects, table
from ..streaming import append_captions, caption_all, written
from . import readers
from .fragments import SEEDS
from .readers import merged


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Every document's lines as a text file, read again."""
    rows = tx.number(tx.exclude(lines(s, d), 0.1, 12)).join(lines(s, d).select("deck", "page_key", "seq", "ph"), ["deck", "page_key", "seq"])
    entries = rows.select(
        F.col("page_key").alias("deck"), F.lit(1).alias("page"), "seq", F.when(F.col("seq") % 5 == 0, "table").otherwise("sp").alias("kind"), "id", F.when(F.col("ph") == "title", "标题").otherwise("内容").alias("label"),
        F.lit("t").alias("name"), "text", (F.col("seq") % 3 == 0).alias("in_group"), *[(F.col("seq") * i + 0.5).alias(c) for i, c in enumerate("xywh", 1)],
    )
    return md.text_rows(sinks.texts_markdown(entries)).select("deck", "page", "id", "type", "text")


def _captions(s: SparkSession, d: str) -> DataFrame:
    """Pages as captioned files, written as Markdown and read again."""
    rows = table(s, d, "pages")
    entries = rows.select((F.col("page_id") % 20).alias("deck"), (F.col("page_id") % 20 + 1).alias("page"), F.col("page_id").alias("n"), F.format_string("IMG%04d", "page_id").alias("img_id"), F.format_string("slide_%02d_%d.png", F.col("page_id") % 20 + 1, F.col("page_id")).alias("file"), "url")
    return md.captions(sinks.captions_markdown(entries.withColumnRenamed("url", "text"))).select("deck", "img_id", "file", "page", "text")


def _textbook(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    pages = docs.select((F.col("doc_id") % 97).alias("deck"), F.floor(F.col("doc_id") / 97).cast("bigint").alias("page"), "text", (F.length("text") > 500).alias("direct"))
    return md.page_texts(sinks.textbook_markdown(pages)).select("deck", "page", F.md5("text").alias("text_md5"))


def _book(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return sinks.html_book(docs.select((F.col("doc_id") % 97).alias("deck"), F.col("doc_id").alias("page"), F.lit("a < b").alias("title"), "text")).select("page", F.md5("html").alias("html_md5"))


def _formulas(s: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("omml", "eq3", "ocr"))), (F.col("page_id") % 3 + 1).cast("int"))
    latex = F.when(F.col("page_id") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("$x_"), F.col("page_id").cast("string"), F.lit("$")))
    return table(s, d, "pages").select("page_id", sinks.formula_entry(F.col("page_id"), F.col("page_id") + 1, source, latex, F.col("page_id") % 2 == 0, F.col("page_id") % 5 == 0).alias("entry"))


def echo() -> models.Client:
    """A stand-in for a model: fails on every seventh length, says no JSON on every fifth."""
    def reply(prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0:
            raise TimeoutError
        kind = ("contrast", "example", "odd")[n % 3]
        said = {"text_anchor": prompt[:70], "relation_type": kind, "keep": n % 2 == 0, "reason": kind}
        return "sorry" if n % 5 == 0 else f"So: {json.dumps(said)} ok"

    return reply


def describe() -> models.Client:
    """A stand-in for a model that describes: fails and says no JSON by the prompt's length, as ``echo`` does."""
    def reply(prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0:
            raise TimeoutError
        said = {"block_type": ("chart", "odd")[n % 2], "semantic_description": f"of {n}", "formula_latex": "x" * (n % 3), "position_role": f' "role {n}” ', "relation": f"rel {n}", "expression_role": "said" * (n % 2), "vlm_caption": f"c{n}"}
        return "plain words" if n % 5 == 0 else json.dumps(said)

    return reply


def _related(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select("page_id", "url", F.lit("rule").alias("text_anchor"), F.lit("elaboration").alias("relation_type"), F.lit("link").alias("semantic_link"))
    return models.enrich_relations(rows, echo, F.col("url")).drop("url")


def _judged(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select("page_id", F.col("url").alias("caption"), F.when(F.col("page_id") % 6 == 0, " ").otherwise("text").alias("page_text"))
    return models.judge(rows, echo).select("page_id", "keep", "reason")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The first event of each user as a caption, by a stream over the events that works off what there is."""
    path, events = sinks.shared_folder(s), table(s, d, "events")
    images = s.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")
    say = lambda rows: rows.select("user_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("text"))
    append_captions(images, say, path, "user_id", None).awaitTermination()
    return written(s, path, "user_id bigint, text string")


def _tried(s: SparkSession, d: str) -> DataFrame:
    """Users whose captions fail at first, or always, and how often they were asked for."""
    path, events = sinks.shared_folder(s), table(s, d, "events")
    images = s.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet").select("user_id")
    lost = (F.col("user_id") % 7 == 0) | (F.col("user_id") % 3 == 0) & (F.col("tries") == 0)
    say = lambda rows: rows.select("user_id", F.when(~lost, F.concat(F.lit("try "), F.col("tries").cast("string"))).alias("text"))
    caption_all(images, say, path, "user_id", 2)
    failed = written(s, f"{path}-failed", "user_id bigint, tries int").select("user_id", F.concat(F.lit("failed "), F.col("tries").cast("string")).alias("outcome"))
    return written(s, path, "user_id bigint, text string").withColumnRenamed("text", "outcome").unionByName(failed)


def _blocks_of_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages as blocks: their markup as XML, their address as text and as a picture's bytes."""
    rows = table(s, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "chart").otherwise("")
    xml = F.when(F.col("page_id") % 11 == 0, " ").otherwise(F.concat(F.lit("<p:sp><a:t>"), F.col("url"), F.lit("</a:t></p:sp>")))
    return rows.select("page_id", kind.alias("block_type"), F.col("url").alias("text"), xml.alias("xml"), F.when(F.col("page_id") % 5 != 0, F.encode("url", "UTF-8")).alias("image"), F.lit("jpg").alias("format"), F.lit("page").alias("page_text"), F.col("url").alias("caption"))


#: Replies need no pause here.
QUICK = {"pause": 0.0}


def _xml(s: SparkSession, d: str) -> DataFrame:
    return models.read_xml(_blocks_of_pages(s, d), describe, **QUICK).select("page_id", "block_type", "semantic_description", "formula_latex", "caption_source")


def _images(s: SparkSession, d: str) -> DataFrame:
    return models.read_images(_blocks_of_pages(s, d), describe, **QUICK).select("page_id", "block_type", "semantic_description", "caption_source")


def _roles(s: SparkSession, d: str) -> DataFrame:
    return models.position_roles(_blocks_of_pages(s, d), describe, **QUICK).select("page_id", "position_role", "relation")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    """Blocks that a model describes, with the rule's values where it says nothing."""
    rows = _blocks_of_pages(s, d).select("page_id", "block_type", F.lit("goal").alias("expression_goal"), F.lit("role").alias("expression_role"), F.lit("").alias("vlm_caption"), "text")
    return models.enrich_blocks(rows, describe, F.col("text")).drop("text")


def _prompts(s: SparkSession, d: str) -> DataFrame:
    """Merged pages in batches of three, as they are put to a model."""
    pages = merged(s, d)
    said = pr.page_prompts(pages)
    batches = pages.select("deck", "page", F.floor(F.col("page") / 3).cast("bigint").alias("batch"))
    return pr.batch_prompts(said, batches, F.lit("数学"), F.when(F.col("batch") > 0, F.concat(F.lit("第 "), F.col("batch").cast("string"), F.lit(" 批")))).select("deck", "batch", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("chars"))


def _first(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select((F.col("doc_id") % 97).alias("deck"), F.floor(F.col("doc_id") / 97).cast("bigint").alias("page"), "text")
    return pr.first_pages(pr.on_pages(docs, "0-1, 3,5 - 9"), 3).select("deck", F.md5("snippet").alias("snippet_md5"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").withColumn("said", F.concat(F.lit(" **"), "url", F.lit("**  & <x>\n")))
    html = fn.figure(F.when(F.col("page_id") % 3 > 0, F.encode("url", "UTF-8")), F.lit("JPG"), F.lit("f.jpg"), F.col("said"), 60)
    return rows.select("page_id", fn.page_body(F.col("said")).alias("body"), fn.snippet(F.col("said"), 30).alias("snippet"), html.alias("figure"), F.md5(fn.whole_formula(F.lit("<m:oMath/>"))).alias("formula_md5"))


def _renders(s: SparkSession, d: str) -> DataFrame:
    """Blocks without a caption of an earlier run and their pictures, and pictures that no block has."""
    blocks = ob.seeds(objects(s, d))
    old = blocks.where("page % 3 = 0").select(*ob.PAGE, "block_id", F.when(F.col("z_index") % 2 == 0, "said").otherwise(" ").alias("caption"))
    todo = pr.not_interpreted(blocks, old).select("deck_id", F.lit("todo").alias("what"), pr.rendered_image(F.col("page"), F.col("block_id"), F.col("w") - 100, F.col("h")).alias("file"))
    files = objects(s, d).where("kind = 'visio'").select("deck_id", F.explode(F.array(F.format_string("slide_%02d_blk_%02d.png", "page", "z_index"), F.format_string("slide_%02d_x.png", "page"))).alias("file"))
    return todo.unionByName(pr.unreferenced(files, blocks).select("deck_id", F.lit("left").alias("what"), "file"))


QUERIES = {
    "page_prompts": _prompts,
    "page_first": _first,
    "page_figures": _shown,
    "block_renders": _renders,
    "sink_texts": _texts,
    "sink_captions": _captions,
    "sink_textbook": _textbook,
    "sink_html_book": _book,
    "sink_formulas": _formulas,
    "model_relations": _related,
    "model_judge": _judged,
    "stream_captions": _stream,
    "stream_retries": _tried,
    "model_xml": _xml,
    "model_images": _images,
    "model_roles": _roles,
    "model_blocks": _enriched,
}

_TYPE, _SAYS = "['contrast', 'example', 'odd'][length(u) % 3 + 1]", "length(u) % 7 <> 0 and length(u) % 5 <> 0"
_ITEMS = "case when {c} <> '' then chr(10) || '{h}' || chr(10) || array_to_string(list_transform(string_split({c}, '¶'), lambda x: '{a}' || x || '{z}'), chr(10)) || chr(10) else '' end"
_HTML = "regexp_replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"
_ASKED = "with p as (select page_id, url, case when page_id % 3 = 0 then 'chart' else '' end kind from pages)"
_KIND = "case when m % 7 <> 0 and m % 5 <> 0 then case when m % 2 = 0 then 'chart' else 'odd' end else kind end"
ORACLE_SQL = {
    "sink_texts": f"""with l as ({LINES_SQL}), r as (select * from l where text <> ''), p as (select deck, text, count(distinct page_key) on_pages from r group by all), n as (select deck, count(distinct page_key) pages from r group by all),
 k as (select r.* from r join p on r.deck = p.deck and r.text = p.text join n on r.deck = n.deck where ph not in ('ftr') and not (pages >= 2 and on_pages >= 0.1 * pages) and length(r.text) >= 12),
 i as (select *, printf('TXT%03d-%02d', page_key, row_number() over (partition by deck, page_key order by seq)) id from k)
 select page_key deck, 1 page, id, case when ph = 'title' then '标题' else '内容' end as type, case when seq % 3 = 0 then '[图块内文本] ' else '' end || replace(text, '|', '\\|') || ' | (' || seq || ',' || (seq * 2) || ') ' || (seq * 3) || 'x' || (seq * 4) as text from i where seq % 5 <> 0""",
    "sink_captions": "select page_id % 20 deck, printf('IMG%04d', page_id) img_id, printf('slide_%02d_%d.png', page_id % 20 + 1, page_id) file, page_id % 20 + 1 page, url as text from pages",
    "sink_textbook": """with t as (select doc_id, trim(coalesce(array_to_string(list_filter(string_split(case when length(text) > 500 then '> 直出整理（保留原意、尽量不增字数）。' || chr(10) else '' end || text, chr(10)), lambda x: trim(x) <> ''), chr(10)), '')) as text from documents)
 select doc_id % 97 deck, doc_id // 97 page, md5(text) text_md5 from t where text <> ''""",
    "sink_formulas": """with f as (select page_id, page_id % 3 s, '- **(p' || page_id || '-f' || (page_id + 1) || ')**' || case when page_id % 5 = 0 then ' （组合内公式）' else '' end || ' ' head, 'x_' || page_id x from pages)
 select page_id, case when page_id % 4 = 0 then head || 'OLE 嵌入对象未获 LaTeX。' when s = 0 and page_id % 2 = 1 then head || '$' || x || '$' else head || '$$' || chr(10) || x || chr(10) || '$$' ||
 case s when 1 then chr(10) || chr(10) || '  > 来源：EQ3-MTEF 解析' || chr(10) when 2 then chr(10) || chr(10) || '  > 来源：OCR' || chr(10) else '' end end entry from f""",
    "model_relations": f"""with p as (select page_id, url u from pages) select page_id, case when {_SAYS} then left(u, 60) else 'rule' end text_anchor, case when {_SAYS} and length(u) % 3 < 2 then {_TYPE} else 'elaboration' end relation_type,
 case when {_SAYS} then '' else 'link' end semantic_link, {_SAYS} by_model from p""",
    "model_judge": """with p as (select page_id, left(url, 800) || chr(10) || chr(10) || 'text' u, page_id % 6 = 0 blank from pages), r as (select *, length(u) n from p)
 select page_id, case when blank or n % 7 = 0 or n % 5 = 0 then true else n % 2 = 0 end keep, case when blank or n % 7 = 0 then '' when n % 5 = 0 then '无法解析判定（默认保留）' else ['contrast', 'example', 'odd'][n % 3 + 1] end reason from r""",
    "stream_captions": "select distinct user_id, 'user ' || user_id as text from events",
    "stream_retries": "select distinct user_id, case when user_id % 7 = 0 then 'failed 2' when user_id % 3 = 0 then 'try 1' else 'try 0' end outcome from events",
    "model_xml": _ASKED + f""", q as (select *, {len(models.XML_ASKS) + 1} + length('<p:sp><a:t>' || url || '</a:t></p:sp>') + 2 + 4 n, page_id % 11 = 0 blank from p),
 r as (select *, case when blank then null when n % 7 <> 0 then n when (n + {len(models.INSISTS)}) % 7 <> 0 then n + {len(models.INSISTS)} end m from q)
 select page_id, {_KIND} block_type, case when m is null then '该图块为' || case kind when '' then '可视逻辑图' else kind end || '，组内内容：' || left(url, 120) when m % 5 = 0 then 'plain words' else 'of ' || m end semantic_description,
 case when m % 5 <> 0 then repeat('x', m % 3) else '' end formula_latex, case when m is null then 'rule_fallback' else 'model_xml' end caption_source from r""",
    "model_images": _ASKED + f""", q as (select *, {len(models.IMAGE_ASKS) + 1 + len('data:image/jpeg;base64,')} + length(to_base64(encode(url))) n, page_id % 5 = 0 blank from p), r as (select *, case when not blank and n % 7 <> 0 then n end m from q)
 select page_id, {_KIND} block_type, case when m is null then '' when m % 5 = 0 then 'plain words' else 'of ' || m end semantic_description, case when m is null then '' else 'model_image' end caption_source from r""",
    "model_roles": _ASKED + f""", r as (select *, {len(models.ROLE_ASKS) + 1} + 4 + 2 + length(left(url, 800)) m from p)
 select page_id, case when m % 7 = 0 or m % 5 = 0 then '' else 'role ' || m end position_role, case when m % 7 = 0 or m % 5 = 0 then '' else 'rel ' || m end relation from r""",
    "model_blocks": _ASKED + """, r as (select *, length(url) % 7 <> 0 and length(url) % 5 <> 0 spoken, length(url) m from p) select page_id, case when spoken and m % 2 = 0 then 'chart' else kind end block_type, 'goal' expression_goal,
 case when spoken and m % 2 = 1 then 'said' else 'role' end expression_role, case when spoken then 'c' || m else '' end vlm_caption, '教学辅助图示' teaching_use, case when spoken then 'model' else 'rule_fallback' end caption_source from r""",
    "page_prompts": f"""with g as ({readers.ORACLE_SQL['md_merge']}), i as (select deck, page, {_ITEMS.format(c='texts', a='- ', z='', h='【文本】')} || {_ITEMS.format(c='formulas', a='- $$ ', z=' $$', h='【公式】')} || {_ITEMS.format(c='captions', a='- ', z='', h='【图片解读】')} parts from g),
 b as (select deck, page // 3 batch, string_agg('## 第 ' || page || ' 页' || parts, chr(10) order by page) whole from i group by all), p as (select deck, batch, '学科：数学' || chr(10) || chr(10) || case when batch > 0 then '第 ' || batch || ' 批' || chr(10) || chr(10) else '' end || whole prompt from b)
 select deck, batch, md5(prompt) prompt_md5, length(prompt) chars from p""",
    "page_first": """with d as (select doc_id % 97 deck, doc_id // 97 page, text from documents where doc_id // 97 in (0, 1, 3, 5, 6, 7, 8, 9)), r as (select *, row_number() over (partition by deck order by page) n from d)
 select deck, md5(left(string_agg('## 第 ' || page || ' 页' || chr(10) || coalesce(text, ''), chr(10) order by page), 6000)) snippet_md5 from r where n <= 3 group by deck""",
    "page_figures": f"""with p as (select page_id, url, '**' || url || '** & <x>' line from pages), q as (select *, left(line, 60) cut, left(line, 30) short from p)
 select page_id, {_HTML.format(x='line')} body, {_HTML.format(x='short')} || '…' snippet, case when page_id % 3 > 0 then '<figure class="fig"><img src="data:image/jpeg;base64,' || to_base64(encode(url)) || '" alt="f.jpg"><figcaption>' || {_HTML.format(x='cut')} || '</figcaption></figure>' else '' end figure,
 md5('<m:oMathPara xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><m:oMath/></m:oMathPara>') formula_md5 from q""",
    "block_renders": SEEDS + """, f as (select deck_id, unnest([printf('slide_%02d_blk_%02d.png', page, z_index), printf('slide_%02d_x.png', page)]) file from o where kind = 'visio')
 select deck_id, 'todo' what, case when w > 100 and h > 0 then printf('./images/slide_%02d_', page) || block_id || '.png' end file from sd where not (page % 3 = 0 and z_index % 2 = 0)
 union all select deck_id, 'left', file from f where file like '%\\_blk\\_%' escape '\\' and (deck_id, file) not in (select (deck_id, printf('slide_%02d_', page) || block_id || '.png') from sd)""",
}
