"""Queries of the image operators on bytes that Spark writes from line items, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as im
from ..sources.carriers import table

KEYS = ["l_orderkey", "l_linenumber"]


def _hex(value: Column, size: int) -> Column:
    """A whole number's bytes, least first, as digits."""
    digits = F.lpad(F.hex(F.when(value < 0, value + (1 << 8 * size)).otherwise(value).cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def _files(s: SparkSession, d: str) -> DataFrame:
    """A placed or plain wmf, an emf, or an svg for every line item, sized by its quantity and part."""
    rows = table(s, d, "lineitem")
    w, h, kind = (F.col("l_quantity") * 60).cast("bigint"), (F.col("l_partkey") % 500 * 4).cast("bigint"), F.col("l_partkey") % 4
    left, zero = F.lit(-20), F.lit("00")
    record = lambda code, words: F.concat(_hex(F.lit(words), 4), _hex(code, 2), F.repeat(zero, 2 * words - 6))
    code = F.element_at(F.array(*map(F.lit, (0x0A32, 0x0325, 0x0201, 0x0329))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    box = F.concat(_hex(left, 2), _hex(F.lit(0), 2), _hex(w, 2), _hex(h, 2))
    wmf = F.concat(F.lit(im.PLACEABLE), F.repeat(zero, 2), box, F.repeat(zero, 26), record(F.lit(0x0102), 4), record(code, 5), _hex(F.lit(3), 4), F.repeat(zero, 2))
    plain = F.concat(F.repeat(zero, 14), box, F.repeat(zero, 8))
    emf = F.concat(F.repeat(zero, 24), _hex(left, 4), _hex(F.lit(0), 4), _hex(w * 100, 4), _hex(h * 100, 4))
    unit = F.element_at(F.array(*map(F.lit, ("", "px", "pt", "cm", "mm"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    number = lambda v: F.format_string("%d.5", v)
    svg = F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit('<svg viewBox="0 0 '), number(w), F.lit(" "), number(h), F.lit('"/>'))).otherwise(
        F.concat(F.lit('<svg width="'), number(w), unit, F.lit('" height="'), number(h), unit, F.lit('"/>')))
    content = F.when(kind == 0, F.unhex(wmf)).when(kind == 1, F.unhex(plain)).when(kind == 2, F.unhex(emf)).otherwise(F.encode(svg, "UTF-8"))
    form = F.when(kind < 2, "wmf").when(kind == 2, "emf").otherwise("svg")
    return rows.select(*KEYS, "l_partkey", "l_suppkey", form.alias("form"), content.alias("content"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    size = im.vector_size(F.col("content"), F.col("form"))
    return _files(s, d).withColumn("size", size).select(*KEYS, "form", F.round("size.w", 6).alias("w"), F.round("size.h", 6).alias("h"))


def _pixels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    return rows.select(*KEYS, F.transform(F.sequence(F.lit(1), F.col("l_quantity").cast("int")), lambda i: (i * F.col("l_partkey") % 256).cast("int")).alias("pixels"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    form = F.element_at(F.array(*map(F.lit, ("png", "wmf", "svg", "jpg"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    known = F.col("l_suppkey") % 6 > 0
    images = rows.select(
        *KEYS, F.when(F.col("l_suppkey") % 9 == 0, "chart").otherwise("picture").alias("kind"), form.alias("form"), F.when(known, (F.col("l_quantity") * 18).cast("double")).alias("w"),
        F.when(known, (F.col("l_partkey") % 29 * 17 + 10).cast("double")).alias("h"), F.when(known, (F.col("l_partkey") % 10 / 10).cast("double")).alias("ink"), F.when(known, F.col("l_partkey") % 12).alias("colours"),
        ((form == "wmf") & (F.col("l_suppkey") % 5 == 0)).alias("wrapper"), (F.col("l_suppkey") % 4 == 0).alias("detected"),
    )
    return im.verdict(images).select(*KEYS, "verdict", "forced")


def _crops(s: SparkSession, d: str) -> DataFrame:
    side = lambda n: (F.col("l_partkey") % n / 64).cast("double")
    rect = F.struct(side(13).alias("l"), side(17).alias("t"), side(19).alias("r"), side(23).alias("b"))
    box = im.crop_box((F.col("l_quantity") * 8).cast("bigint"), (F.col("l_partkey") % 300 + 64).cast("bigint"), rect)
    return table(s, d, "lineitem").select(*KEYS, F.inline(F.array(box)))


QUERIES = {
    "img_vector_sizes": _sizes,
    "img_wrappers": lambda s, d: _files(s, d).where("form = 'wmf' and l_partkey % 4 = 0").select(*KEYS, im.wraps_bitmap(F.col("content")).alias("wrapper")),
    "img_containers": lambda s, d: table(s, d, "lineitem").select(*KEYS, im.container(F.unhex(F.element_at(F.array(*map(F.lit, ("504B030400", "D0CF11E0A1", "89504E47", ""))), (F.col("l_partkey") % 4 + 1).cast("int")))).alias("container")),
    "img_pixels": lambda s, d: _pixels(s, d).select(*KEYS, im.ink(F.col("pixels")).alias("ink"), im.colours(F.col("pixels")).cast("bigint").alias("colours")),
    "img_verdicts": _judged,
    "img_reasons": lambda s, d: im.reasons(_judged(s, d)),
    "img_crops": _crops,
}

_W, _H = "cast(l_quantity * 60 as bigint)", "(l_partkey % 500 * 4)"
_V = """with i as (select l_orderkey, l_linenumber, l_suppkey % 9 = 0 chart, ['png', 'wmf', 'svg', 'jpg'][l_partkey % 4 + 1] form, case when l_suppkey % 6 > 0 then l_quantity * 18.0 end w, case when l_suppkey % 6 > 0 then l_partkey % 29 * 17 + 10.0 end h,
 case when l_suppkey % 6 > 0 then l_partkey % 10 / 10 end ink, case when l_suppkey % 6 > 0 then l_partkey % 12 end colours, l_suppkey % 5 = 0 s5, l_suppkey % 4 = 0 seen from lineitem),
v as (select l_orderkey, l_linenumber, seen, chart, case when form in ('wmf', 'svg') and w * h < 10000 then 'vector fragment' when form = 'wmf' and s5 then 'wrapped bitmap' when form not in ('wmf', 'svg') and w * h < 40000 and ink < 0.2 then 'sparse fragment' end sp,
 case when least(w, h) < 48 then 'small' when greatest(w, h) / least(w, h) > 10 then 'thin' when colours <= 4 then 'plain' end pl from i),
r as (select l_orderkey, l_linenumber, case when chart then 'keep' when sp is not null then sp when pl is not null and not seen then pl else 'keep' end verdict, not chart and sp is not null forced from v)"""

ORACLE_SQL = {
    "img_vector_sizes": f"""with f as (select l_orderkey, l_linenumber, l_suppkey, l_partkey % 4 k, {_W} w, {_H} h, case l_suppkey % 5 when 2 then 96 / 72.0 when 3 then 96 / 2.54 when 4 then 96 / 25.4 else 1.0 end u from lineitem),
 z as (select l_orderkey, l_linenumber, case k when 2 then 'emf' when 3 then 'svg' else 'wmf' end form, case k when 2 then (w * 100 + 20) * 96 / 2540 when 3 then (w + 0.5) * case when l_suppkey % 7 = 0 then 1 else u end else (w + 20) * 96 / 1440 end w,
  case k when 2 then h * 100 * 96 / 2540 when 3 then (h + 0.5) * case when l_suppkey % 7 = 0 then 1 else u end else h * 96 / 1440 end h from f)
 select l_orderkey, l_linenumber, form, case when w > 0 and h > 0 then round(cast(w as double), 6) end w, case when w > 0 and h > 0 then round(cast(h as double), 6) end h from z""",
    "img_wrappers": "select l_orderkey, l_linenumber, l_suppkey % 4 in (0, 3) wrapper from lineitem where l_partkey % 4 = 0",
    "img_containers": "select l_orderkey, l_linenumber, ['vsdx', 'vsd', 'bin', 'bin'][l_partkey % 4 + 1] container from lineitem",
    "img_pixels": """with p as (select l_orderkey, l_linenumber, list_transform(range(1, cast(l_quantity as int) + 1), lambda i: i * l_partkey % 256) px from lineitem)
 select l_orderkey, l_linenumber, len(list_filter(px, lambda x: x < 200)) / len(px) ink, len(list_distinct(px)) colours from p""",
    "img_verdicts": _V + " select * from r",
    "img_reasons": _V + " select verdict reason, count(*) files from r where verdict <> 'keep' group by all",
    "img_crops": """with c as (select l_orderkey, l_linenumber, cast(l_quantity * 8 as bigint) w, l_partkey % 300 + 64 h, l_partkey % 13 / 64 l, l_partkey % 17 / 64 t, l_partkey % 19 / 64 r, l_partkey % 23 / 64 b from lineitem),
 x as (select *, round_even(w * l, 0) x0, round_even(h * t, 0) y0, round_even(w * (1 - r), 0) x1, round_even(h * (1 - b), 0) y1 from c), y as (select *, x1 - x0 < 64 or y1 - y0 < 64 as small from x)
 select l_orderkey, l_linenumber, cast(case when small then 0 else x0 end as bigint) "left", cast(case when small then 0 else y0 end as bigint) top, cast(case when small then w else x1 end as bigint) "right", cast(case when small then h else y1 end as bigint) bottom, small as "full" from y""",
}
