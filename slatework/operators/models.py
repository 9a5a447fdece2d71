"""Operators that ask a model: prompts as rows, replies as JSON, rules where no model speaks or its reply can't be read.

A client is a function from prompt to reply; ``make_client`` makes one for each call that a task has in flight, so nothing
of it is shipped and clients need not be shared between threads.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import data_url, json_in_prose, strip, xml_summary

Client = Callable[[str], str]
#: Types of relations, what is said of an undecidable picture, and how much of each text a prompt holds.
RELATIONS = ("elaboration", "title_caption", "contrast", "example", "data_presentation")
KEPT = "无法解析判定（默认保留）"
TYPES = (
    "raster_image", "vector_image", "visio_diagram", "chart", "native_table", "virtual_table", "native_logic_diagram", "decorated_diagram",
    "formula_block", "title_region", "body_text_region", "group_diagram",
)
#: What is asked about XML, pictures and their place, and how the last try insists; how much of XML is shown whole, at its start, in all.
XML_ASKS = '下面是幻灯片中一个图块的 XML。用一个 JSON 对象回答：{"block_type": "类型", "semantic_description": "二至四句解读", "formula_latex": "公式的 LaTeX，没有则为空"}'
IMAGE_ASKS = '解读这张图片。用一个 JSON 对象回答：{"block_type": "类型", "semantic_description": "解读", "formula_latex": "公式的 LaTeX，没有则为空"}'
ROLE_ASKS = '说明图片在本页的作用，以及它和文字的关系。用一个 JSON 对象回答：{"position_role": "四十字以内", "relation": "六十字以内"}'
INSISTS = "\n\n只输出一个完整的 JSON 对象。"
XML_WHOLE, XML_START, XML_MOST = 1500, 1200, 2000
TEACHING_USE, FEATURES = "教学辅助图示", "可视化"


#: Calls in flight of a task, and seconds before the second try, doubled for each further one.
CALLS, PAUSE = 8, 1.0


class Caller:
    """Asks a model for a task: several calls at a time, each worker with a client of its own, replies in order.

    A call that fails or says nothing is made again after a pause that doubles; ``insist`` ends the last try's prompt.
    With ``rate``, calls begin no closer together than that many a second allow, those that are made again too.
    """

    def __init__(self, make_client: Callable[[], Client], retries: int = 1, calls: int = CALLS, pause: float = PAUSE, rate: float | None = None, insist: str = ""):
        self.make_client, self.retries, self.pause, self.insist = make_client, retries, pause, insist
        self.own = threading.local()
        self.turn, self.next, self.apart = threading.Lock(), 0.0, 1 / rate if rate else 0.0
        self.pool = ThreadPoolExecutor(calls)

    def wait(self) -> None:
        """Until a call may begin."""
        if self.apart:
            with self.turn:
                begin = max(self.next, time.monotonic())
                self.next = begin + self.apart
            time.sleep(max(0.0, begin - time.monotonic()))

    def one(self, prompt: str | None) -> str | None:
        if prompt is None or prompt != prompt:
            return None
        for turn in range(self.retries + 1):
            if turn:
                time.sleep(self.pause * 2 ** (turn - 1))
            self.wait()
            try:
                if not hasattr(self.own, "client"):
                    self.own.client = self.make_client()
                reply = self.own.client(prompt + self.insist if turn and turn == self.retries else prompt)
            except Exception:  # whatever a remote model fails with, the rule speaks instead
                continue
            if reply and reply.strip():
                return reply
        return None

    def replies(self, prompts: list[str | None]) -> list[str | None]:
        """In the order of the prompts; equal ones are asked once."""
        asked = list(dict.fromkeys(p for p in prompts if p is not None and p == p))
        found = dict(zip(asked, self.pool.map(self.one, asked)))
        return [found.get(p) if p is not None and p == p else None for p in prompts]


def ask(rows: DataFrame, prompt: Column, make_client: Callable[[], Client] | None, **how) -> DataFrame:
    """``rows`` with ``reply``; null without a client, for null prompts, and where every try fails or says nothing.

    A task has up to CALLS calls in flight (see ``Caller`` for what ``how`` sets), so a stage has that many times its
    tasks: repartition what is asked to bound them. Limit what is asked beforehand: rows that need no reply should have
    a null prompt.
    """
    if make_client is None:
        return rows.withColumn("reply", F.lit(None).cast("string"))
    asked = rows.withColumn("prompt", prompt)
    schema = asked.drop("prompt").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(make_client, **how)
        with caller.pool:
            for batch in batches:
                at = batch.schema.get_field_index("prompt")
                replies = pa.array(caller.replies(batch.column(at).to_pylist()), pa.string())
                yield batch.remove_column(at).append_column("reply", replies)

    return asked.mapInArrow(run, f"{schema}, reply string")


def _said(reply: Column, key: str, most: int) -> Column:
    """A string of the reply's object, stripped and cut; empty without one."""
    return F.left(F.trim(F.coalesce(F.try_variant_get(json_in_prose(reply), f"$.{key}", "string"), F.lit(""))), F.lit(most))


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.nullif(other, F.lit("")), F.lit(""))


def enrich_relations(relations: DataFrame, make_client: Callable[[], Client] | None, prompt: Column) -> DataFrame:
    """Relations with the model's anchor, type and link; as they are where it says neither anchor nor link.

    A type that isn't one of RELATIONS is an elaboration.
    """
    rows = ask(relations, prompt, make_client)
    anchor, link, kind = _said(F.col("reply"), "text_anchor", 60), _said(F.col("reply"), "semantic_link", 120), _said(F.col("reply"), "relation_type", 40)
    spoken = (anchor != "") | (link != "")
    own = F.when(kind.isin(*RELATIONS), kind).otherwise(RELATIONS[0])
    rows = rows.withColumn("spoken", spoken).withColumn("a", anchor).withColumn("l", link).withColumn("k", own)
    pick = lambda new, old: F.when(F.col("spoken"), F.col(new)).otherwise(F.col(old)).alias(old)
    kept = [pick({"text_anchor": "a", "semantic_link": "l", "relation_type": "k"}[c], c) if c in ("text_anchor", "semantic_link", "relation_type") else F.col(c) for c in relations.columns]
    return rows.select(*kept, F.col("spoken").alias("by_model"))


def enrich_blocks(blocks: DataFrame, make_client: Callable[[], Client] | None, prompt: Column) -> DataFrame:
    """``blocks(..., block_type, expression_goal, expression_role, vlm_caption)`` with what the model says in place of what it can.

    A type outside TYPES leaves the rule's; an empty value never wins over a present one.
    """
    rows = ask(blocks, prompt, make_client)
    kind = _said(F.col("reply"), "block_type", 40)
    fresh = {"block_type": F.when(kind.isin(*TYPES), kind).otherwise(F.lit("")), "expression_goal": _said(F.col("reply"), "expression_goal", 500), "expression_role": _said(F.col("reply"), "expression_role", 500), "vlm_caption": _said(F.col("reply"), "vlm_caption", 2000)}
    kept = [_or(fresh[c], F.col(c)).alias(c) if c in fresh else F.col(c) for c in blocks.columns]
    use = F.coalesce(F.nullif(_said(F.col("reply"), "teaching_use", 500), F.lit("")), F.lit(TEACHING_USE))
    source = F.when(json_in_prose(F.col("reply")).isNotNull(), "model").otherwise("rule_fallback")
    return rows.select(*kept, use.alias("teaching_use"), source.alias("caption_source"))


def _described(rows: DataFrame, columns: list[str], source: str, none: Column, none_source: str) -> DataFrame:
    """What ``reply`` says of a block: its object, or its start as the description; the rule's where there is none."""
    reply = F.col("reply")
    whole = json_in_prose(reply)
    kind = _said(reply, "block_type", 40)
    said = F.when(reply.isNull(), none).when(F.try_variant_get(whole, "$.semantic_description", "string").isNotNull() | whole.isNotNull(), _said(reply, "semantic_description", 5000)).otherwise(F.left(F.trim(reply), F.lit(500)))
    kept = [_or(kind, F.col(c)).alias(c) if c == "block_type" else F.col(f"`{c}`") for c in columns]
    return rows.select(*kept, said.alias("semantic_description"), _said(reply, "formula_latex", 5000).alias("formula_latex"), F.when(reply.isNull(), none_source).otherwise(source).alias("caption_source"))


def xml_prompt(xml: Column, page_text: Column) -> Column:
    """What is asked about a block's XML: all of up to XML_WHOLE characters, else its start and a summary, XML_MOST in all."""
    start = F.concat(F.left(xml, F.lit(XML_START)), F.lit("\n\n……（XML 过长已压缩）……\n\n"), xml_summary(xml))
    shown = F.when(F.length(xml) <= XML_WHOLE, xml).otherwise(F.left(start, F.lit(XML_MOST)))
    return F.concat(F.lit(XML_ASKS + "\n"), shown, F.lit("\n\n"), F.left(F.coalesce(page_text, F.lit("")), F.lit(1200)))


def read_xml(blocks: DataFrame, make_client: Callable[[], Client] | None, **how) -> DataFrame:
    """``blocks(..., block_type, text, xml, page_text)`` described from their XML: ``semantic_description``, ``formula_latex``, ``caption_source``.

    Three tries, the last with a request for nothing but the object; a block that gets no reply is described by the rule.
    Blocks without XML are not asked about. A type that the model doesn't say stays.
    """
    asked = ask(blocks, F.when(F.trim("xml") != "", xml_prompt(F.col("xml"), F.col("page_text"))), make_client, **{"retries": 2, "insist": INSISTS, **how})
    rule = F.concat(F.lit("该图块为"), F.coalesce(F.nullif("block_type", F.lit("")), F.lit("可视逻辑图")), F.lit("，组内内容："), F.left(F.coalesce("text", F.lit("")), F.lit(120)))
    return _described(asked, blocks.columns, "model_xml", rule, "rule_fallback")


def read_images(blocks: DataFrame, make_client: Callable[[], Client] | None, **how) -> DataFrame:
    """``blocks(..., block_type, image, format)`` described from their pictures, which the prompt ends with; empty where that fails."""
    prompt = F.when(F.octet_length("image") > 0, F.concat(F.lit(IMAGE_ASKS + "\n"), data_url(F.col("image"), F.col("format"))))
    return _described(ask(blocks, prompt, make_client, **{"retries": 0, **how}), blocks.columns, "model_image", F.lit(""), "")


def position_roles(pictures: DataFrame, make_client: Callable[[], Client] | None, **how) -> DataFrame:
    """``pictures(..., caption, page_text)`` with ``position_role`` and ``relation``, empty where the model says none.

    Quotation marks and spaces around either are dropped.
    """
    prompt = F.concat(F.lit(ROLE_ASKS + "\n"), F.left(F.coalesce("page_text", F.lit("")), F.lit(1500)), F.lit("\n\n"), F.left(F.coalesce("caption", F.lit("")), F.lit(800)))
    rows = ask(pictures, prompt, make_client, **how)
    bare = lambda key, most: F.left(F.regexp_replace(_said(F.col("reply"), key, 5000), "^[\"'“”\\s]+|[\"'“”\\s]+$", ""), F.lit(most)).alias(key)
    own = [F.col(f"`{c}`") for c in pictures.columns if c not in ("position_role", "relation")]
    return rows.select(*own, bare("position_role", 60).cast("string").alias("position_role"), bare("relation", 80).alias("relation"))


def judge(captions: DataFrame, make_client: Callable[[], Client] | None) -> DataFrame:
    """``captions(..., caption, page_text)`` with ``keep`` and ``reason``: kept unless the model says not to.

    Pictures of pages without text are not asked about.
    """
    prompt = F.when(F.trim("page_text") != "", F.concat(F.left("caption", F.lit(800)), F.lit("\n\n"), F.left("page_text", F.lit(1500))))
    rows = ask(captions, prompt, make_client)
    found = json_in_prose(F.col("reply"))
    keep = F.coalesce(F.try_variant_get(found, "$.keep", "boolean"), F.lit(True))
    reason = F.when(F.col("reply").isNull(), "").when(found.isNull(), KEPT).otherwise(_said(F.col("reply"), "reason", 40))
    return rows.select(*captions.columns, keep.alias("keep"), reason.alias("reason"))


def author(pages: DataFrame, batches: DataFrame, make_client: Callable[[], Client] | None) -> DataFrame:
    """``(deck, page, text)`` written by the model for ``pages(deck, page, prompt)`` in ``batches(deck, page, batch)``.

    A batch is one prompt; its reply has the pages under their headings. Pages that a reply leaves out are asked for
    once more, by themselves, and left out if that fails too.
    """
    def written(rows: DataFrame) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "prompt"))), lambda p: p["prompt"]), "\n\n")
        asked = ask(rows.groupBy("deck", "batch").agg(joined.alias("prompt_")), F.col("prompt_"), make_client).where("reply is not null")
        parts = asked.select("deck", F.explode(F.regexp_extract_all("reply", F.lit(r"(?s)## 第 \d+ 页\s*\n.*?(?=## 第 \d+ 页|\z)"), F.lit(0))).alias("part"))
        page = F.regexp_extract("part", r"^## 第 (\d+) 页", 1).cast("bigint")
        text = F.trim(F.regexp_replace("part", r"^## 第 \d+ 页\s*\n", ""))
        return parts.select("deck", page.alias("page"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).where("text <> ''")

    first = written(pages.join(batches, ["deck", "page"])).dropDuplicates(["deck", "page"])
    missing = pages.join(first, ["deck", "page"], "left_anti")
    again = written(missing.withColumn("batch", F.col("page"))).join(missing.select("deck", "page"), ["deck", "page"], "left_semi").dropDuplicates(["deck", "page"])
    return first.unionByName(again)
