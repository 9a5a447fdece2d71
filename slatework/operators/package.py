"""Scans of presentation packages: relationships, slide order, objects of a slide and their texts, backgrounds, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ["deck_id", "part"]
#: Types of relationships, units of length in a pixel, placeholders that are regions of text.
LAYOUT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slideLayout"
MASTER = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slideMaster"
EMU_PX = 9525
TEXT_REGIONS = ("title", "ctrTitle", "subTitle", "body", "obj")
VECTORS, VISIO = ("emf", "wmf", "svg"), ("vsdx", "vsd")


def folder(part: Column) -> Column:
    return F.regexp_replace(part, r"/?[^/]*$", "")


def resolve(base: Column, target: Column) -> Column:
    """The part that ``target`` means in folder ``base``: absolute ones from the root, others with ``.`` and ``..`` worked out."""
    plain = F.concat(base, F.lit("/"), target)
    path = F.regexp_replace(plain, r"(?<=^|/)\./", "")
    for _ in range(4):  # one more level of parents each
        path = F.regexp_replace(path, r"(?<=^|/)(?!\.\./)[^/]+/\.\./", "")
    return F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(F.when(plain.contains("./"), path).otherwise(plain))


def relationships(nodes: DataFrame) -> DataFrame:
    """``(deck_id, part, rid, target, type)``: what each part refers to; target is a part's name or stays if external."""
    rows = nodes.where("tag = 'Relationship'")
    owner = F.regexp_replace("part", r"_rels/([^/]+)\.rels$", "$1")
    target = F.when(F.col("attrs")["TargetMode"] == "External", F.col("attrs")["Target"]).otherwise(resolve(folder(owner), F.col("attrs")["Target"]))
    return rows.select("deck_id", owner.alias("part"), F.col("attrs")["Id"].alias("rid"), target.alias("target"), F.col("attrs")["Type"].alias("type"))


def slides(nodes: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """``(deck_id, page, part)`` in the order of the presentation; of decks without a list, by the parts' names."""
    there = parts.where(F.col("part").rlike(r"^ppt/slides/slide[^/]*\.xml$")).select(*PART)
    listed = nodes.where("tag = 'p:sldId'").select("deck_id", "node", F.col("attrs")["r:id"].alias("rid"))
    listed = listed.join(rels.where("part = 'ppt/presentation.xml'").select("deck_id", "rid", F.col("target").alias("part")), ["deck_id", "rid"])
    listed = listed.join(there, PART, "left_semi").select(*PART, "node")
    bare = there.join(nodes.where("tag = 'p:sldIdLst'").select("deck_id").distinct(), "deck_id", "left_anti").withColumn("node", F.lit(0))
    page = F.row_number().over(Window.partitionBy("deck_id").orderBy("node", "part"))
    return listed.unionByName(bare).select("deck_id", page.cast("bigint").alias("page"), "part")


def numbered_slides(parts: DataFrame) -> DataFrame:
    """``(deck_id, page, part)`` by the numbers in the slides' names, whatever the presentation lists."""
    rows = parts.where(F.col("part").rlike(r"^ppt/slides/slide[0-9]+\.xml$"))
    number = F.regexp_extract("part", r"slide([0-9]+)\.xml$", 1).cast("bigint")
    page = F.row_number().over(Window.partitionBy("deck_id").orderBy(number, "part"))
    return rows.select("deck_id", page.cast("bigint").alias("page"), "part")


def slide_size(nodes: DataFrame) -> DataFrame:
    """``(deck_id, width, height)`` of a deck's pages in pixels."""
    size = nodes.where("tag = 'p:sldSz'").select("deck_id", *[(F.col("attrs")[k].try_cast("double") / EMU_PX).alias(n) for k, n in (("cx", "width"), ("cy", "height"))])
    return size.groupBy("deck_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))


def first_of(tag: str, value: Column, more: Column | None = None) -> Column:
    """Of a group's nodes with this tag, the value of the first in document order that has one."""
    fit = (F.col("tag") == tag) & value.isNotNull()
    return F.min_by(F.when(fit if more is None else fit & more, value), F.when(fit if more is None else fit & more, F.col("node")))


def shapes(nodes: DataFrame) -> DataFrame:
    """A row for each object of a part, nested ones included, with all that lies in it but not in another object.

    x, y, w, h in pixels, null without a transform; src_rect as shares of the picture; text with paragraphs joined by
    `` | ``, table cells by rows. One grouping of the nodes by object serves all scans below.
    """
    at = F.col("attrs")
    px = lambda tag, key: first_of(tag, at[key].try_cast("double") / EMU_PX)
    written = F.array_sort(F.collect_list(F.when((F.col("tag") == "a:t") & F.col("body").isNotNull() & F.col("cell").isNull(), F.struct("node", "para", "text"))))
    cells = F.array_sort(F.collect_list(F.when(F.col("tag") == "a:tc", F.struct("node", "row"))))
    in_cells = F.array_sort(F.collect_list(F.when((F.col("tag") == "a:t") & F.col("cell").isNotNull(), F.struct("node", "cell", "text"))))
    side = lambda k: F.coalesce(at[k].try_cast("double"), F.lit(0.0)) / 100_000
    rect = F.struct(side("l").alias("l"), side("t").alias("t"), side("r").alias("r"), side("b").alias("b"))
    own = nodes.where("owner is not null").groupBy("deck_id", "part", "owner").agg(
        F.max(F.when(F.col("node") == F.col("owner"), F.col("tag"))).alias("tag"),
        F.max(F.when(F.col("node") == F.col("owner"), F.col("outer_group"))).alias("outer_group"),
        F.max(F.when(F.col("node") == F.col("owner"), F.col("group"))).alias("group"),
        F.max(F.when(F.col("node") == F.col("owner"), F.col("pos"))).alias("pos"),
        first_of("p:cNvPr", at["name"]).alias("name"), first_of("p:cNvPr", at["id"]).alias("shape_id"),
        first_of("p:ph", F.coalesce(at["type"], F.lit("obj"))).alias("ph"),
        px("a:off", "x").alias("x"), px("a:off", "y").alias("y"), px("a:ext", "cx").alias("w"), px("a:ext", "cy").alias("h"),
        first_of("a:blip", F.coalesce(at["r:embed"], at["r:link"])).alias("blip"), first_of("a:srcRect", rect).alias("src_rect"),
        F.bool_or(F.col("tag") == "p:blipFill").alias("pictured"), F.bool_or(F.col("tag") == "a:blipFill").alias("filled"),
        F.min(F.when(F.col("tag") == "p:oleObj", F.col("pos"))).alias("ole_pos"),
        F.coalesce(first_of("p:oleObj", at["r:id"]), first_of("p:oleObjEmbed", at["r:id"])).alias("ole"), first_of("p:oleObj", at["progId"]).alias("prog_id"),
        first_of("c:chart", at["r:id"]).alias("chart"), first_of("a:stCxn", at["id"]).alias("start_id"), first_of("a:endCxn", at["id"]).alias("end_id"),
        F.bool_or(F.col("tag") == "a:tbl").alias("tabled"), written.alias("written"), cells.alias("cells"), in_cells.alias("in_cells"),
    )
    paragraphs = F.transform(F.array_distinct(F.transform("written", lambda t: t["para"])), lambda p: F.trim(F.array_join(F.transform(F.filter("written", lambda t: t["para"].eqNullSafe(p)), lambda t: t["text"]), "")))
    rows = F.transform(
        F.array_distinct(F.transform("cells", lambda c: c["row"])),
        lambda r: F.transform(F.filter("cells", lambda c: c["row"] == r), lambda c: F.trim(F.array_join(F.transform(F.filter("in_cells", lambda t: t["cell"] == c["node"]), lambda t: t["text"]), ""))),
    )
    return own.withColumn("text", F.array_join(F.filter(paragraphs, lambda p: p != ""), " | ")).withColumn("rows", rows).drop("written", "cells", "in_cells")


def pictures(shapes: DataFrame) -> DataFrame:
    return shapes.where("tag = 'p:pic' and pictured").select(*PART, "owner", "name", F.col("blip").alias("rid"), "src_rect", *_box())


def fills(shapes: DataFrame) -> DataFrame:
    """Shapes that a picture fills."""
    return shapes.where("tag = 'p:sp' and filled and blip is not null").select(*PART, "owner", _named("name", "FillShape"), F.col("blip").alias("rid"), "src_rect", *_box())


def ole_objects(shapes: DataFrame) -> DataFrame:
    """Embedded objects; ``is_equation`` by their program."""
    program = F.lower(F.coalesce("prog_id", F.lit("")))
    equation = program.contains("equation")
    name = F.coalesce(F.nullif("name", F.lit("")), F.when(equation, "Equation").otherwise("OLEObject"))
    return shapes.where("tag in ('p:graphicFrame', 'p:sp') and ole is not null").select(
        *PART, "owner", name.alias("name"), F.col("ole").alias("rid"), program.alias("prog_id"), equation.alias("is_equation"), F.col("group").isNotNull().alias("in_group"), *_box()
    )


def charts(shapes: DataFrame) -> DataFrame:
    return shapes.where("tag = 'p:graphicFrame' and chart is not null").select(*PART, "owner", _named("name", "Chart"), F.col("chart").alias("rid"), *_box())


def connectors(shapes: DataFrame) -> DataFrame:
    return shapes.where("tag = 'p:cxnSp' and x is not null").select(*PART, "owner", "name", "text", F.coalesce("start_id", F.lit("")).alias("start_id"), F.coalesce("end_id", F.lit("")).alias("end_id"), *_box())


def connector_ends(shapes: DataFrame) -> DataFrame:
    """``(deck_id, part, name, start_name, end_name)``: the objects of its part that a connector names by their numbers.

    Objects inside groups are not named; of several with one number the first in document order counts.
    """
    named = shapes.where("group is null and shape_id is not null").groupBy(*PART, "shape_id").agg(F.min_by(F.coalesce("name", F.lit("")), "owner").alias("named"))
    rows = connectors(shapes)
    for end in ("start", "end"):
        rows = rows.join(named.select(*PART, F.col("shape_id").alias(f"{end}_id"), F.col("named").alias(f"{end}_name")), [*PART, f"{end}_id"], "left")
    return rows.select(*PART, "name", "start_name", "end_name")


def table_markdown(rows: Column) -> Column:
    """Cells as a Markdown table: the first row is the head, the others are filled up to the widest."""
    clean = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    padded = F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    head = F.array(line(F.element_at(clean, 1)), F.concat(F.lit("|"), F.repeat(F.lit("---|"), width)))
    return F.when(F.size(clean) > 0, F.array_join(F.concat(head, padded), "\n")).otherwise("")


def tables(shapes: DataFrame) -> DataFrame:
    return shapes.where("tag = 'p:graphicFrame' and tabled").select(*PART, "owner", "name", "rows", table_markdown(F.col("rows")).alias("markdown"), *_box())


def slide_texts(shapes: DataFrame) -> DataFrame:
    """Objects with text in document order, tables last; ``in_group`` tells whether a group holds one."""
    rows = shapes.where("(tag = 'p:sp' and text <> '') or (tag = 'p:graphicFrame' and tabled)").withColumn("tabled", F.col("tag") == "p:graphicFrame")
    pick = lambda table, plain: F.when(F.col("tabled"), table).otherwise(plain)
    rows = rows.select(
        *PART, "owner", pick(F.lit("table"), "sp").alias("kind"), pick(_named("name", "表格"), F.coalesce("name", F.lit(""))).alias("name"), pick(F.lit("tbl"), F.coalesce("ph", F.lit(""))).alias("ph"),
        pick(table_markdown(F.col("rows")), F.col("text")).alias("text"), "group", *_box())
    seq = F.row_number().over(Window.partitionBy(*PART).orderBy("kind", "owner")).cast("bigint")
    rows = rows.where("text <> ''").withColumn("seq", seq).withColumn("in_group", F.col("group").isNotNull())
    return rows.select(*PART, "seq", "kind", "name", "ph", "text", "in_group", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xywh"])


def fixed_texts(shapes: DataFrame) -> DataFrame:
    """``(deck_id, text)``: texts of two characters and more of a deck's masters and layouts."""
    rows = shapes.where("tag = 'p:sp'").where(F.col("part").rlike("^ppt/(slideMasters/slideMaster|slideLayouts/slideLayout)"))
    return rows.where(F.length("text") >= 2).select("deck_id", "text").distinct()


def formulas(nodes: DataFrame) -> DataFrame:
    """``(deck_id, part, math, text, in_group)`` of every formula; text is what its runs say."""
    runs = F.array_sort(F.collect_list(F.when(F.col("tag") == "m:t", F.struct("node", "text"))))
    rows = nodes.where("math is not null").groupBy(*PART, "math").agg(runs.alias("runs"), F.bool_or(F.col("group").isNotNull()).alias("in_group"))
    return rows.select(*PART, "math", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), "in_group")


def backgrounds(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """``(deck_id, part, level, rid, target)``: pictures behind a slide, its own, its layout's and that one's master's.

    A relationship of the same folder that a level before has shown is not shown again.
    """
    blips = nodes.where("tag = 'a:blip' and bg is not null").select("deck_id", F.col("part").alias("at"), F.coalesce(F.col("attrs")["r:embed"], F.col("attrs")["r:link"]).alias("rid")).where("rid is not null").distinct()
    to = lambda kind, name: rels.where(F.col("type") == kind).groupBy(*PART).agg(F.min("target").alias(name))
    own = nodes.where(F.col("part").rlike(r"^ppt/slides/slide[^/]*\.xml$")).select(*PART).distinct()
    chain = own.join(to(LAYOUT, "layout"), PART, "left")
    chain = chain.join(to(MASTER, "master").withColumnRenamed("part", "layout"), ["deck_id", "layout"], "left")
    levels = F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(n).alias("level"), F.col(c).alias("at")) for i, (n, c) in enumerate((("SlideBackground", "part"), ("LayoutBackground", "layout"), ("MasterBackground", "master")))])
    rows = chain.select(*PART, F.inline(levels)).join(blips, ["deck_id", "at"])
    first = F.row_number().over(Window.partitionBy(*PART, folder(F.col("at")), "rid").orderBy("depth"))
    rows = rows.withColumn("n", first).where("n = 1")
    named = rels.select("deck_id", F.col("part").alias("at"), "rid", "target")
    return rows.join(named, ["deck_id", "at", "rid"], "left").select(*PART, "level", "rid", F.coalesce("target", F.lit("")).alias("target"))


def previews(shapes: DataFrame, within: int = 300) -> DataFrame:
    """``(deck_id, part, owner, preview_of)``: pictures that begin at most ``within`` characters after an embedded object's start.

    The latest object before a picture counts; both run through one window in document order.
    """
    program = F.lower(F.coalesce("prog_id", F.lit("")))
    kind = F.when(program.contains("equation"), "formula").when(program.contains("visio"), "visio").otherwise("ole")
    marks = shapes.where("ole_pos is not null").select(*PART, F.col("ole_pos").alias("at"), kind.alias("mark"), F.lit(None).cast("int").alias("owner"))
    rows = marks.unionByName(shapes.where("tag = 'p:pic'").select(*PART, F.col("pos").alias("at"), F.lit(None).cast("string").alias("mark"), "owner"))
    before = Window.partitionBy(*PART).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("mark").isNotNull(), F.struct("at", "mark")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last).where("owner is not null")
    return rows.select(*PART, "owner", F.when(F.col("at") - F.col("last.at") <= within, F.col("last.mark")).otherwise("").alias("preview_of"))


def group_children(shapes: DataFrame) -> DataFrame:
    """``(deck_id, part, root, owner, parent, ord, kind, name, text)``: what top-level groups hold, nested groups included."""
    kinds = {"p:sp": "shape", "p:pic": "raster", "p:cxnSp": "connector", "p:graphicFrame": "table", "p:grpSp": "group"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("tag")]
    order = F.row_number().over(Window.partitionBy(*PART, "group").orderBy("owner")).cast("bigint")
    return shapes.where("group is not null").select(*PART, F.col("outer_group").alias("root"), "owner", F.col("group").alias("parent"), order.alias("ord"), kind.alias("kind"), "name", "text")


def group_segments(parts: DataFrame) -> DataFrame:
    """``(deck_id, part, ord, xml)``: the text of each outermost group of a slide, as it stands there.

    ``parts(deck_id, part, content)``. A part is cut at the marks that open and close groups. Depth is a running sum over
    them; an opening mark is closed if depth ever comes back to what it was before it, and others are passed over, so a
    group in one that is never closed is found too. Groups that close themselves hold nothing and are left out.
    """
    text = F.decode("content", "UTF-8")
    cut = F.split(text, r"(?=<p:grpSp[\s>/])|(?<=</p:grpSp>)")
    opens = F.col("xml").rlike(r"^<p:grpSp[\s>]") & ~F.col("xml").rlike(r"^<p:grpSp(?:\s[^>]*)?/>")
    slides = parts.where(F.col("part").rlike(r"^ppt/slides/slide[^/]*\.xml$")).where(F.contains("content", F.encode(F.lit("<p:grpSp"), "UTF-8")))
    pieces = slides.select(*PART, F.posexplode(cut).alias("at", "xml")).where("xml <> ''").withColumn("opens", opens).withColumn("closes", F.col("xml").endswith("</p:grpSp>"))
    upto = Window.partitionBy(*PART).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*PART).orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = lambda mark: F.when(F.col(mark), 1).otherwise(0)
    # a closing mark ends its piece, an opening one begins it
    pieces = pieces.withColumn("sum", F.sum(step("opens") - step("closes")).over(upto))
    pieces = pieces.withColumn("low", F.least(F.min("sum").over(upto), F.lit(0))).withColumn("ends", F.col("sum") - F.col("low"))
    pieces = pieces.withColumn("begins", F.coalesce(F.lag("ends").over(Window.partitionBy(*PART).orderBy("at")), F.lit(0)))
    pieces = pieces.withColumn("closed", F.col("opens") & (F.min("ends").over(after) <= F.col("begins")))
    lost = F.sum(F.when(F.col("opens") & ~F.col("closed"), 1).otherwise(0)).over(upto)
    pieces = pieces.withColumn("depth", F.col("begins") + step("opens") - lost)
    number = F.sum(F.when(F.col("closed") & (F.col("depth") == 1), 1).otherwise(0)).over(upto)
    rows = pieces.withColumn("ord", number).where("depth >= 1")
    own = rows.groupBy(*PART, "ord").agg(F.array_sort(F.collect_list(F.struct("at", "xml"))).alias("held"))
    return own.select(*PART, "ord", F.array_join(F.transform("held", lambda p: p["xml"]), "").alias("xml"))


def group_blips(segments: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """``(deck_id, part, ord, rid, media)``: the media parts that a group's text refers to, each once."""
    ids = F.array_distinct(F.regexp_extract_all("xml", F.lit(r'(?:embed|link)="(rId\d+)"'), F.lit(1)))
    rows = segments.select(*PART, "ord", F.explode(ids).alias("rid"))
    found = rows.join(rels.where(F.col("target").startswith("ppt/media/")).select(*PART, "rid", F.col("target").alias("media")), [*PART, "rid"])
    return found.join(parts.select("deck_id", F.col("part").alias("media")), ["deck_id", "media"], "left_semi").select(*PART, "ord", "rid", "media")


def exclusive_media(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(deck_id, name, held_by, exclusive)``: how many of a deck's ``texts(deck_id, part, xml)`` name each of ``names(deck_id, name)``.

    Texts are taken apart into the words that can be names, so that names meet them by an equal key.
    """
    words = texts.select(*PART, F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r"[\w.-]+"), F.lit(0)))).alias("name"))
    held = words.groupBy("deck_id", "name").agg(F.count_distinct("part").alias("held_by"))
    rows = names.select("deck_id", "name").distinct().join(held, ["deck_id", "name"], "left").withColumn("held_by", F.coalesce("held_by", F.lit(0)))
    return rows.select("deck_id", "name", "held_by", (F.col("held_by") <= 1).alias("exclusive"))


def image_records(shapes: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Pictures and embedded objects with the part that holds them, numbered on the page by kind from 1.

    A relationship or part that is missing leaves an empty file and a note.
    """
    kind = F.when(F.col("tag") == "p:pic", "picture").when(F.lower("prog_id").contains("visio"), "visio").when(F.lower("prog_id").contains("equation"), "formula_ole").when(F.col("chart").isNotNull(), "chart").otherwise("ole")
    rows = shapes.where("(tag = 'p:pic' and pictured) or ole is not null or chart is not null").withColumn("kind", kind)
    rows = rows.withColumn("rid", F.when(F.col("tag") == "p:pic", F.col("blip")).otherwise(F.coalesce("ole", "chart")))
    rows = rows.join(rels.select(*PART, "rid", "target"), [*PART, "rid"], "left")
    rows = rows.join(parts.select("deck_id", F.col("part").alias("target"), F.lit(True).alias("there")), ["deck_id", "target"], "left")
    index = F.row_number().over(Window.partitionBy(*PART, "kind").orderBy("owner")).cast("bigint")
    note = F.when(F.col("target").isNull(), "no relationship").when(F.col("there").isNull(), "no part").otherwise("")
    file = F.when(F.col("there"), F.regexp_extract("target", r"([^/]+)$", 1)).otherwise("")
    form = F.lower(F.regexp_extract(file, r"\.([^.]+)$", 1))
    return rows.select(*PART, "owner", "kind", index.alias("index"), "name", F.coalesce("target", F.lit("")).alias("source_media"), file.alias("file"), form.alias("original_format"), note.alias("note"), F.col("group").isNotNull().alias("in_group"), "prog_id", "src_rect", *_box())


def record_counts(records: DataFrame) -> DataFrame:
    """``(deck_id, kind, records, missing, cropped, vectors_whole)``: records of a kind, those without a file, pictures that are cut
    to a part, and vectors that say a part but are kept whole."""
    part = F.greatest(*[F.coalesce(F.col(f"src_rect.{k}"), F.lit(0.0)) for k in "ltrb"]) > 0
    rows = records.withColumn("partly", part)
    there, vector = F.col("file") != "", F.col("original_format").isin(*VECTORS)
    return rows.groupBy("deck_id", "kind").agg(
        F.count("*").alias("records"), F.count_if(~there).alias("missing"), F.count_if(there & ~vector & F.col("partly")).alias("cropped"), F.count_if(there & vector & F.col("partly")).alias("vectors_whole")
    )


def slide_objects(shapes: DataFrame, records: DataFrame, preview: DataFrame | None, pages: DataFrame) -> DataFrame:
    """The objects of every slide in z order: top-level groups, shapes, connectors and tables share a counter from 0,
    files stand at 1000 and their number; what groups hold is theirs. Text regions are shapes with such a placeholder.
    Without ``preview`` preview_of is empty.

    Objects are dealt out by part once: a group's texts are gathered by a window over it and what it holds.
    """
    held = F.when(F.col("outer_group").isNotNull() & (F.col("tag") != "p:grpSp") & (F.col("text") != ""), F.struct("owner", "text"))
    whole = Window.partitionBy(*PART, F.coalesce("outer_group", "owner"))
    own = shapes.select(*PART, "owner", "tag", "outer_group", "group", "name", "ph", "tabled", "text", *_box()).join(pages, PART).withColumn("texts", F.array_sort(F.collect_list(held).over(whole)))
    placed = own.where("group is null and x is not null and w is not null")
    rank = (
        F.when(F.col("tag") == "p:grpSp", 0).when((F.col("tag") == "p:sp") & ((F.col("text") != "") | (F.col("name") != "")), 1).when(F.col("tag") == "p:cxnSp", 2).when(F.col("tabled"), 3)
    )
    drawn = placed.withColumn("rank", rank).where("rank is not null")
    z = F.row_number().over(Window.partitionBy(*PART, "page").orderBy("rank", "owner")) - 1
    number = F.row_number().over(Window.partitionBy(*PART, "page", "rank").orderBy("owner"))
    drawn = drawn.withColumn("z_index", z.cast("bigint")).withColumn("number", number)
    kind = F.when(F.col("rank") == 0, "group").when(F.col("rank") == 2, "connector").when(F.col("rank") == 3, "table").when(F.col("ph").isin(*TEXT_REGIONS), "text_region").otherwise("shape")
    text = F.when(F.col("rank") == 0, F.array_join(F.transform("texts", lambda t: t["text"]), "\n")).when(F.col("rank") == 3, F.lit("")).otherwise(F.col("text"))
    obj_id = F.when(F.col("rank") == 0, F.format_string("s%02d_g%02d", "page", "number")).otherwise(
        F.format_string("s%02d_%s%03d", F.col("page"), F.when(F.col("rank") == 1, "sp").when(F.col("rank") == 2, "cn").otherwise("tb"), F.col("z_index"))
    )
    none = F.lit("")
    drawn = drawn.select("deck_id", "page", obj_id.alias("obj_id"), kind.alias("kind"), F.coalesce("name", none).alias("name"), F.coalesce(text, none).alias("text"), "z_index", *_box(), none.alias("file"), none.alias("preview_of"))
    files = records.where("file <> '' and not in_group").join(pages, PART)
    files = files.join(preview, [*PART, "owner"], "left") if preview is not None else files.withColumn("preview_of", none)
    form = F.col("original_format")
    a_kind = F.when(F.col("kind") == "picture", F.when(form.isin(*VECTORS), "vector").when(form.isin(*VISIO), "visio").otherwise("raster")).when(F.col("kind") == "formula_ole", "formula").otherwise(F.col("kind"))
    letter = F.create_map(*[F.lit(x) for x in ("picture", "r", "visio", "v", "chart", "c", "formula_ole", "f", "ole", "o")])[F.col("kind")]
    files = files.where("kind <> 'ole'").select(
        "deck_id", "page", F.format_string("s%02d_%s%02d", F.col("page"), letter, F.col("index")).alias("obj_id"), a_kind.alias("kind"), F.coalesce("name", none).alias("name"), none.alias("text"),
        (F.col("index") + 1000).alias("z_index"), *_box(), "file", F.coalesce("preview_of", none).alias("preview_of"),
    )
    return drawn.unionByName(files)


def volume(parts: DataFrame) -> DataFrame:
    """Counts of slides, media and embedded files of each deck, and tokens and minutes that a full run may take."""
    rows = parts.groupBy("deck_id").agg(
        F.count_if(F.col("part").rlike(r"^ppt/slides/slide[^/]*\.xml$")).alias("slides"), F.count_if(F.col("part").startswith("ppt/media/")).alias("media"), F.count_if(F.col("part").startswith("ppt/embeddings/")).alias("embeddings")
    )
    minutes = lambda n, seconds: F.greatest(F.lit(1), F.floor(F.col(n) * seconds / 60)).cast("bigint")
    return rows.select("*", (F.col("slides") * 1850).alias("caption_tokens"), minutes("slides", 8).alias("caption_minutes"), (F.col("media") * 600).alias("relevance_tokens"), minutes("media", 3).alias("relevance_minutes"))


def _box() -> list[Column]:
    return [F.col(c) for c in "xywh"]


def _named(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default)).alias(column)
