"""Pictures from their bytes: sizes in vector headers, containers, crops, shares of ink, colours, and the filter cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a placeable metafile begins, units in an inch, and the limits of the rules.
PLACEABLE, TWIPS, HUNDREDTHS_MM = "D7CDC69A", 1440, 2540
MIN_SIDE, MAX_RATIO, MIN_COLOURS, MIN_AREA, MIN_INK, MIN_VECTOR = 48, 10, 4, 40_000, 0.20, 10_000
RASTER = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff", "tif")


def little(content: Column, at: int, size: int) -> Column:
    """The signed whole number of ``size`` bytes at ``at``, least byte first."""
    parts = [F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(size))]
    value = F.conv(F.concat(*parts), 16, 10).cast("bigint")
    return F.when(value >= 1 << (8 * size - 1), value - (1 << 8 * size)).otherwise(value)


def vector_size(content: Column, form: Column) -> Column:
    """Width and height in pixels that the head of a wmf, emf or svg says; null for others and for sizes that aren't positive."""
    head = lambda first, size, unit: F.struct(*[((little(content, first + (2 + i) * size, size) - little(content, first + i * size, size)) * 96 / unit).alias(n) for i, n in enumerate(("w", "h"))])
    n = F.octet_length(content)
    wmf = F.when(n < 22, None).when(F.hex(F.substring(content, 1, 4)) == PLACEABLE, head(6, 2, TWIPS)).otherwise(head(14, 2, TWIPS))
    emf = F.when(n >= 40, head(24, 4, HUNDREDTHS_MM))
    text = F.left(F.decode(content, "UTF-8"), F.lit(4000))
    px = lambda key: _length(text, key)
    box = r'viewBox="[\d.]+ [\d.]+ ([\d.]+) ([\d.]+)"'
    own = F.when(px("width").isNotNull() & px("height").isNotNull(), F.struct(px("width").alias("w"), px("height").alias("h"))).when(
        text.rlike(box), F.struct(*[F.regexp_extract(text, box, i).try_cast("double").alias(n) for i, n in ((1, "w"), (2, "h"))]))
    size = F.when(form == "wmf", wmf).when(form == "emf", emf).when(form == "svg", own)
    return F.when((size["w"] > 0) & (size["h"] > 0), size)


def _length(text: Column, key: str) -> Column:
    pattern = rf'{key}="([\d.]+)(\w*)"'
    value, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2)
    return F.when(unit == "pt", value * 96 / 72).when(unit == "cm", value * 96 / 2.54).when(unit == "mm", value * 96 / 25.4).otherwise(value)


def container(content: Column) -> Column:
    """What an embedded drawing's bytes are: a zipped package, a compound file, or neither."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start.startswith("504B"), "vsdx").when(start == "D0CF11E0", "vsd").otherwise("bin")


def crop_box(width: Column, height: Column, rect: Column, least: int = 64) -> Column:
    """``left, top, right, bottom, full``: the picture's part that ``rect`` leaves; all of it where that is too small."""
    left, top = F.bround(width * rect["l"], 0), F.bround(height * rect["t"], 0)
    right, bottom = F.bround(width * (1 - rect["r"]), 0), F.bround(height * (1 - rect["b"]), 0)
    small = (right - left < least) | (bottom - top < least)
    pick = lambda cut, whole: F.when(small, whole).otherwise(cut).cast("bigint")
    return F.struct(pick(left, F.lit(0)).alias("left"), pick(top, F.lit(0)).alias("top"), pick(right, width).alias("right"), pick(bottom, height).alias("bottom"), small.alias("full"))


def ink(pixels: Column) -> Column:
    """The share of grey values below 200; null without pixels."""
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda p: p < 200)) / F.size(pixels))


def colours(pixels: Column) -> Column:
    return F.when(F.size(pixels) > 0, F.size(F.array_distinct(pixels)))


#: Records that put a bitmap, and those that draw curves.
BITMAPS, CURVES = (0x0A32, 0x0329, 0x032A, 0x032B), (0x0623, 0x0325, 0x0628, 0x0631, 0x0633, 0x0613)


def shown(content: Column, start: int) -> Column:
    """Whether a metafile's records put a bitmap, and whether they draw a curve, as far as their lengths hold."""
    def step(state, _):
        at = state["at"]
        value = lambda shift, size: F.conv(F.concat(*[F.hex(F.substring(content, at + shift + i + 1, F.lit(1))) for i in reversed(range(size))]), 16, 10).cast("bigint")
        size, kind = value(0, 4) * 2, value(4, 2)
        fits = (at + 6 <= F.octet_length(content)) & (size >= 6) & (at + size <= F.octet_length(content))
        seen = lambda name, kinds: (state[name] | (fits & F.coalesce(kind.isin(*kinds), F.lit(False)))).alias(name)
        return F.struct(F.when(fits, at + size).otherwise(F.octet_length(content).cast("bigint")).alias("at"), seen("bitmap", BITMAPS), seen("curve", CURVES))

    most = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.octet_length(content) - start) / 6).cast("int")))  # a record has six bytes at least
    begin = F.struct(F.lit(start).cast("bigint").alias("at"), F.lit(False).alias("bitmap"), F.lit(False).alias("curve"))
    return F.aggregate(most, begin, step)


def wraps_bitmap(content: Column) -> Column:
    """Whether a wmf shows a bitmap and no curve: a symbol or a formula, not a drawing."""
    placed = F.hex(F.substring(content, 1, 4)) == PLACEABLE
    found = F.when(placed, shown(content, 40)).otherwise(shown(content, 18))
    return found["bitmap"] & ~found["curve"]


def verdict(images: DataFrame) -> DataFrame:
    """``images(kind, form, w, h, ink, colours, wrapper, detected)`` with the rule that drops each, or ``keep``, and ``forced``.

    First formulas and groups aside: other kinds than pictures stay. Then fragments: small vectors, wrapped bitmaps,
    small rasters of little ink; those are dropped for good. Then size, shape and colours, from which an object that a
    detector has seen is rescued. What isn't known drops nothing.
    """
    area, least = F.col("w") * F.col("h"), F.least("w", "h")
    vector = F.col("form").isin("wmf", "emf", "svg")
    sparse = F.when(vector & (area < MIN_VECTOR), "vector fragment").when(F.col("wrapper"), "wrapped bitmap").when(~vector & (area < MIN_AREA) & (F.col("ink") < MIN_INK), "sparse fragment")
    plain = F.when(least < MIN_SIDE, "small").when(F.greatest("w", "h") / least > MAX_RATIO, "thin").when(F.col("colours") <= MIN_COLOURS, "plain")
    rescued = F.coalesce("detected", F.lit(False))
    said = F.when(F.col("kind") != "picture", "keep").when(sparse.isNotNull(), sparse).when(plain.isNotNull() & ~rescued, plain).otherwise("keep")
    return images.withColumn("verdict", said).withColumn("forced", (F.col("kind") == "picture") & sparse.isNotNull())


def reasons(judged: DataFrame) -> DataFrame:
    """How many pictures each rule drops."""
    return judged.where("verdict <> 'keep'").groupBy(F.substring_index("verdict", "(", 1).alias("reason")).agg(F.count("*").alias("files"))
