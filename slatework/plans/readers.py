"""Queries of the Markdown readers and column functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import markdown as md
from ..operators import text as tx
from ..sources.carriers import LINES_SQL, lines, table


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file: of eight lines each a page heading, a text row, a formula's marks, a caption, an item."""
    rows = lines(spark, sf_dir)
    seq, doc, text = F.col("seq"), F.col("page_key"), F.col("text")
    said = F.when((seq % 16 == 2) & (doc % 7 == 0), "$[]").otherwise(text)
    row = F.format_string("| TXT%03d-%02d | %s | %s |", doc % 1000, seq, F.when(seq % 16 == 2, "标题").otherwise("内容"), said)
    caption = F.format_string("### IMG%04d — `slide_%02d_%d.png`  ✅", seq, seq % 5 + 1, seq % 3)
    line = (
        F.when(seq % 8 == 1, F.format_string("## 第 %d 页", seq % 5 + 1)).when(seq % 8 == 2, row).when((seq % 8).isin(3, 5), "$$").when(seq % 8 == 6, caption)
        .when(seq % 8 == 0, F.concat(F.lit("- "), text)).otherwise(text)
    )
    return rows.select(doc.alias("deck"), "seq", line.alias("text"))


def merged(s: SparkSession, d: str) -> DataFrame:
    """Texts, formulas and captions of every page, as arrays."""
    rows = markdown_lines(s, d)
    texts = md.text_rows(rows).select("deck", "page", F.col("seq").alias("ord"), F.concat(F.lit("["), "type", F.lit("] "), "text").alias("item"))
    formulas = md.formula_blocks(rows).select("deck", "page", F.col("block").alias("ord"), F.col("latex").alias("item"))
    notes = md.captions(rows).where("n_lines > 0").select("deck", "page", F.col("seq").alias("ord"), F.col("text").alias("item"))
    return md.merge_pages(texts, formulas, notes)


def _merged(s: SparkSession, d: str) -> DataFrame:
    joined = [F.array_join(c, "¶").alias(c) for c in ("texts", "formulas", "captions")]
    return merged(s, d).select("deck", "page", *joined)


def _names(s: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("l_partkey") % 3 == 0, "_grp.xml").when(F.col("l_partkey") % 3 == 1, ".PNG").otherwise("")
    name = F.concat(F.when(F.col("l_suppkey") % 4 == 0, "x_").otherwise(""), F.format_string("slide_%02d_blk_%02d", (F.col("l_orderkey") % 130).cast("bigint"), F.col("l_linenumber").cast("bigint")), end)
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    page, block = fn.block_of(F.col("name"))
    return rows.select("*", fn.page_of(F.col("name")).alias("page"), page.alias("block_page"), block.alias("block"), fn.file_kind(fn.extension(F.col("name"))).alias("kind"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "lang", F.lit("。； ")))
    role = F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" "), "lang", F.lit("。；"))).otherwise(role)
    docs = table(s, d, "documents")
    return docs.select("doc_id", fn.position(F.col("doc_id"), F.col("doc_id") % 3, role).alias("position"), fn.caption_start(F.col("text")).alias("relation"))


def _headings(s: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 45))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("$$\n## "), F.substring("text", 1, 18), F.lit("\n"), "text")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", fn.page_heading(text, F.col("doc_id"), title).alias("heading"))


def _formats(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    latex = F.concat(F.lit(" $"), F.substring("lang", 1, 2), F.lit("^2$$ "))
    pages = F.format_string("%d-%d, %d,x, %d", F.col("doc_id") % 5 + 1, F.col("doc_id") % 9 + 1, F.col("doc_id") % 7, F.col("doc_id") % 7)
    return docs.select(
        "doc_id", F.array_join(fn.half_split(F.col("text"), "."), "¶").alias("halves"), fn.data_url(F.encode("lang", "UTF-8"), F.when(F.col("doc_id") % 2 == 0, "JPG").otherwise("png")).alias("url"),
        fn.latex_block(latex, F.col("doc_id") % 2 == 0).alias("latex"), F.array_join(fn.page_list(pages).cast("array<string>"), ",").alias("pages"),
    )


def _replies(s: SparkSession, d: str) -> DataFrame:
    props, n = F.col("props"), F.col("event_id") % 5
    reply = F.when(n == 0, F.concat(F.lit("Answer: "), props, F.lit(" (end)"))).when(n == 1, "no object here ").when(n == 2, F.concat(props, F.lit(" and "), props)).when(n == 3, F.concat(F.lit("{bad "), "event_type", F.lit("}")))
    found = fn.description(reply)
    return table(s, d, "events").select("event_id", F.try_variant_get(found, "$.k", "bigint").alias("k"), F.try_variant_get(found, "$.semantic_description", "string").alias("said"))


_KEYS = [k for words in tx.SUBJECTS.values() for k in words]


def _subjects(s: SparkSession, d: str) -> DataFrame:
    """Documents with three of the words that speak for a subject, or none."""
    keys = F.array(*map(F.lit, _KEYS))
    word = lambda factor: F.element_at(keys, (F.col("doc_id") * factor % len(_KEYS) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", word(1), word(7), word(8)))
    return tx.subject(table(s, d, "documents").select("doc_id", text.alias("text")), tx.SUBJECTS, tx.NO_SUBJECT)


QUERIES = {
    "md_pages": lambda s, d: md.pages(markdown_lines(s, d)),
    "md_page_texts": lambda s, d: md.page_texts(markdown_lines(s, d)),
    "md_last_page_texts": lambda s, d: md.last_page_texts(markdown_lines(s, d)),
    "md_text_rows": lambda s, d: md.text_rows(markdown_lines(s, d)),
    "md_formula_blocks": lambda s, d: md.formula_blocks(markdown_lines(s, d)),
    "md_captions": lambda s, d: md.captions(markdown_lines(s, d)),
    "md_captions_by_file": lambda s, d: md.captions_by_file(markdown_lines(s, d)),
    "md_titles": lambda s, d: md.titles(markdown_lines(s, d)),
    "md_merge": _merged,
    "md_html": lambda s, d: md.html_blocks(markdown_lines(s, d)),
    "name_parse": _names,
    "bind_positions": _positions,
    "page_headings": _headings,
    "value_formats": _formats,
    "model_replies": _replies,
    "subject_words": _subjects,
}

_MD = f"""with l as ({LINES_SQL}), m as (select page_key deck, seq, case when seq % 8 = 1 then '## 第 ' || (seq % 5 + 1) || ' 页'
 when seq % 8 = 2 then printf('| TXT%03d-%02d | %s | %s |', page_key % 1000, seq, case when seq % 16 = 2 then '标题' else '内容' end, case when seq % 16 = 2 and page_key % 7 = 0 then '$[]' else text end)
 when seq % 8 in (3, 5) then '$$' when seq % 8 = 6 then printf('### IMG%04d — `slide_%02d_%d.png`  ✅', seq, seq % 5 + 1, seq % 3) when seq % 8 = 0 then '- ' || text else text end as text from l),
n as (select *, try_cast(nullif(regexp_extract(trim(text), '{md.PAGE}', 1), '') as int) number from m),
v as (select *, last_value(case when number is not null then seq end ignore nulls) over (partition by deck order by seq) visit from n),
pages as (select v.deck, h.number page, v.visit, v.seq, v.text from v join n h on h.deck = v.deck and h.seq = v.visit where v.number is null),
tr as (select deck, page, seq, regexp_extract(text, '{md.TEXT_ROW}', 1) id, regexp_extract(text, '{md.TEXT_ROW}', 2) as type, regexp_extract(text, '{md.TEXT_ROW}', 3) as text from pages where regexp_matches(text, '{md.TEXT_ROW}')),
fm as (select *, sum(case when trim(text) like '$$%' then 1 else 0 end) over (partition by deck, page order by seq) marks, count(*) filter (trim(text) like '$$%') over (partition by deck, page) total from pages),
fb as (select deck, page, cast((marks + 1) // 2 as bigint) block, trim(coalesce(string_agg(trim(text), ' ' order by seq) filter (trim(text) not like '$$%'), '')) latex from fm where marks % 2 = 1 and marks < total group by deck, page, marks),
ch as (select *, last_value(case when regexp_matches(text, '{md.CAPTION}') then seq end ignore nulls) over (partition by deck order by seq) head from m),
cs as (select deck, head seq, count(*) - 1 n_lines, coalesce(string_agg(trim(text), ' ' order by seq) filter (seq <> head and trim(text) <> ''), '') as text from ch where head is not null group by deck, head),
cap as (select cs.deck, cs.seq, regexp_extract(m.text, '{md.CAPTION}', 1) img_id, regexp_extract(m.text, '{md.CAPTION}', 2) file, n_lines, cs.text from cs join m on m.deck = cs.deck and m.seq = cs.seq)"""
_HITS = ", ".join("+".join(f"cast(contains(text, '{k}') as bigint)" for k in words) + f" s{i}" for i, words in enumerate(tx.SUBJECTS.values()))
_NAMES = list(tx.SUBJECTS)

ORACLE_SQL = {
    "md_pages": _MD + " select deck, page, visit, seq, text from pages",
    "md_page_texts": _MD + " select deck, page, trim(string_agg(text, chr(10) order by seq)) as text from pages where trim(text) <> '' group by deck, page",
    "md_last_page_texts": _MD + """, x as (select deck, page, visit, coalesce(string_agg(trim(text), chr(10) order by seq) filter (trim(text) <> ''), '') as text from pages group by all)
 select deck, page, left(arg_max(text, visit), 3000) as text from x group by deck, page""",
    "md_text_rows": _MD + " select * from tr",
    "md_formula_blocks": _MD + " select * from fb",
    "md_captions": _MD + " select deck, seq, img_id, file, cast(regexp_extract(file, '^slide_(\\d+)_', 1) as int) page, n_lines, text from cap",
    "md_captions_by_file": _MD + " select deck, file, arg_max(img_id, seq) img_id, arg_max(text, seq) as text from cap where n_lines > 0 group by all",
    "md_titles": _MD + " select deck, page, arg_min(trim(text), seq) title from tr where type = '标题' and trim(text) <> '' and not regexp_matches(trim(text), '" + fn.SYMBOLS_ONLY + "') group by deck, page",
    "md_merge": _MD + """, i as (select deck, page, 1 src, seq ord, '[' || type || '] ' || text item from tr union all select deck, page, 2, block, latex from fb
  union all select deck, cast(regexp_extract(file, '^slide_(\\d+)_', 1) as int), 3, seq, text from cap where n_lines > 0)
 select deck, page, coalesce(string_agg(item, '¶' order by ord) filter (src = 1), '') texts, coalesce(string_agg(item, '¶' order by ord) filter (src = 2), '') formulas, coalesce(string_agg(item, '¶' order by ord) filter (src = 3), '') captions from i group by deck, page""",
    "name_parse": """with n as (select l_orderkey, l_linenumber, case when l_suppkey % 4 = 0 then 'x_' else '' end || printf('slide_%02d_blk_%02d', l_orderkey % 130, l_linenumber) || case l_partkey % 3 when 0 then '_grp.xml' when 1 then '.PNG' else '' end as name from lineitem)
 select *, try_cast(nullif(regexp_extract(name, '^slide_(\\d+)_', 1), '') as int) page, cast(regexp_extract(name, 'slide_(\\d+)_(blk_\\d+)', 1) as int) block_page, regexp_extract(name, 'slide_(\\d+)_(blk_\\d+)', 2) block,
 case when name like '%.xml' then 'xml' when name like '%.PNG' then 'png' else 'unknown' end kind from n""",
    "bind_positions": """select doc_id, '位于第 ' || doc_id || ' 页' || case when doc_id % 3 > 0 then '（第 ' || (doc_id % 3) || ' 段）' else '' end || '，该图对该页文字表达起『' ||
 case when doc_id % 4 in (0, 1) then '辅助理解本页知识点' else lang end || '』的作用' as position, regexp_replace(left(text, 50), '[；，。 ]+$', '') relation from documents""",
    "page_headings": """with t as (select doc_id, case when doc_id % 3 = 0 then left(text, 45) end title, case when doc_id % 5 = 0 then '$$' || chr(10) || '## ' || left(text, 18) || chr(10) || text else text end as text from documents),
 l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '^[\\\\$\\[\\]{}]+$')) ls from t),
 h as (select *, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '^#+|#+$', '', 'g'))), lambda x: length(x) between 2 and 22 and not regexp_matches(x, '^[\\\\$\\[\\]{}]+$'))[1] short, ls[1] first from l),
 c as (select *, trim(regexp_replace(title, '\\s+', ' ', 'g')) ct, trim(regexp_replace(short, '\\s+', ' ', 'g')) cs from h)
 select doc_id, coalesce(nullif(case when length(ct) > 30 then left(ct, 30) || '…' else ct end, ''), case when length(cs) > 30 then left(cs, 30) || '…' else cs end, case when length(first) > 16 then left(first, 16) || '…' else first end, '第 ' || doc_id || ' 节') heading from c""",
    "value_formats": """with t as (select *, length(text) // 2 m from documents), c as (select *, case when contains(left(text, m), '.') then m - position('.' in reverse(left(text, m))) + 1 when contains(substr(text, m + 1), '.') then m + position('.' in substr(text, m + 1)) else length(text) end cut from t)
 select doc_id, case when left(text, cut) <> '' and substr(text, cut + 1) <> '' then left(text, cut) || '¶' || substr(text, cut + 1) else text end halves, 'data:image/' || case when doc_id % 2 = 0 then 'jpeg' else 'png' end || ';base64,' || to_base64(encode(lang)) url,
 case when doc_id % 2 = 0 then '$$' || chr(10) || left(lang, 2) || '^2' || chr(10) || '$$' else '$' || left(lang, 2) || '^2$' end latex,
 array_to_string(list_sort(list_distinct(list_concat(range(doc_id % 5 + 1, doc_id % 9 + 2), [doc_id % 7]))), ',') pages from c""",
    "model_replies": """select event_id, case when event_id % 5 = 0 then cast(regexp_extract(props, '"k": *(\\d+)', 1) as bigint) end k,
 case event_id % 5 when 0 then null when 1 then 'no object here' when 2 then left(props || ' and ' || props, 500) when 3 then '{bad ' || event_type || '}' else '' end said from events""",
    "subject_words": "with t as (select doc_id, case when doc_id % 4 = 0 then text else text || " + " || ".join(f"ks[doc_id * {f} % {len(_KEYS)} + 1]" for f in (1, 7, 8)) + " end as text from documents, (select [" + ", ".join(f"'{k}'" for k in _KEYS) + f"] ks)), h as (select doc_id, {_HITS} from t), b as (select *, greatest(s0, s1, s2, s3, s4, s5) hits from h) select doc_id, case when hits = 0 then '{tx.NO_SUBJECT}' "
    + " ".join(f"when s{i} = hits then '{n}'" for i, n in enumerate(_NAMES)) + " end subject, hits from b",
}
