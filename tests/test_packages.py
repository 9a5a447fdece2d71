"""Packages read from zipped decks, and operators that have no SQL."""

import io
import zipfile

from slatework import functions as fn
from slatework.operators import markdown as md
from slatework.operators import models
from slatework.operators import package as pk
from slatework.sources import sinks
from slatework.sources.decks import listed_images, read_packages, write_files, write_media, write_packages
from slatework.sources.ooxml import nodes, shred

NS = (
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
)
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def box(x, y, w, h, tag="a:xfrm"):
    return f'<{tag}><a:off x="{x * 9525}" y="{y * 9525}"/><a:ext cx="{w * 9525}" cy="{h * 9525}"/></{tag}>'


def sp(name, *paragraphs, ph="", place=box(1, 2, 30, 40)):
    holder = f'<p:nvPr><p:ph type="{ph}"/></p:nvPr>' if ph else ""
    body = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r><a:fld><a:t>!</a:t></a:fld></a:p>" for t in paragraphs)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/>{holder}</p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody>{body}</p:txBody></p:sp>'


def group(name, *inner):
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="{name}"/></p:nvGrpSpPr><p:grpSpPr>{box(5, 5, 50, 50)}</p:grpSpPr>{"".join(inner)}</p:grpSp>'


def rels(*links):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{to}"/>' for i, t, to in links) + "</Relationships>"


def deck(**more):
    pic = f'<p:pic><p:nvPicPr><p:cNvPr id="3" name="photo"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/><a:srcRect l="25000"/></p:blipFill><p:spPr>{box(7, 8, 9, 10)}</p:spPr></p:pic>'
    gap = "<!--" + "x" * 400 + "-->"
    ole = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name=""/></p:nvGraphicFramePr>{box(1, 1, 2, 2, "p:xfrm")}<p:oleObj progId="Equation.3" r:id="rId3"/></p:graphicFrame>'
    chart = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="6" name=""/></p:nvGraphicFramePr>{box(1, 1, 2, 2, "p:xfrm")}<c:chart r:id="rId9"/></p:graphicFrame>'
    fill = f'<p:sp><p:nvSpPr><p:cNvPr id="5" name=""/></p:nvSpPr><p:spPr><a:blipFill><a:blip r:embed="rId2"/></a:blipFill>{box(0, 0, 1, 1)}</p:spPr></p:sp>'
    slide = lambda *shapes: f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    files = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="256" r:id="rId8"/><p:sldId id="257" r:id="rId7"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId7", "slide", "slides/slide1.xml"), ("rId8", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(sp("Title 1", "Hello", ph="title"), group("outer", sp("in", "a"), group("deep", sp("low", "b"))), ole, pic, gap, pic, fill, chart),
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId2", "image", "../media/a.png"), ("rId3", "oleObject", "/ppt/embeddings/e.bin"), ("rId1", "slideLayout", "../slideLayouts/../slideLayouts/l.xml")),
        "ppt/slides/slide2.xml": slide(sp("x", "One", "Two")),
        "ppt/media/a.png": "p",
        "ppt/embeddings/e.bin": "e",
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, content in files.items():
            if content is not None:
                package.writestr(name, content)
    return out.getvalue()


def read(spark, folder, content):
    (folder / "one.pptx").write_bytes(content)
    (folder / "bad.pptx").write_bytes(b"no zip")
    parts = read_packages(spark, f"file://{folder}").cache()
    found = nodes(parts).cache()
    return parts, found, pk.relationships(found), pk.shapes(found).cache()


def test_a_deck_is_read(spark, tmp_path):
    parts, found, links, shapes = read(spark, tmp_path, deck())
    assert {r.deck_id for r in parts.collect()} == {"one"}
    assert [(r.page, r.part) for r in pk.slides(found, links, parts).orderBy("page").collect()] == [(1, "ppt/slides/slide2.xml"), (2, "ppt/slides/slide1.xml")]
    assert {r.rid: r.target for r in links.where("part like '%slide1.xml'").collect()} == {"rId2": "ppt/media/a.png", "rId3": "ppt/embeddings/e.bin", "rId1": "ppt/slideLayouts/l.xml"}
    assert [tuple(r) for r in pk.slide_size(found).collect()] == [("one", 960.0, 720.0)]
    first = shapes.where("part like '%slide1.xml'")
    photos = pk.pictures(first).orderBy("owner").collect()
    assert [(r.name, r.rid, r.src_rect.l, r.x, r.w) for r in photos] == [("photo", "rId2", 0.25, 7.0, 9.0)] * 2
    assert [r.preview_of for r in pk.previews(first).orderBy("owner").collect()] == ["formula", ""]
    assert [(r.name, r.rid) for r in pk.fills(first).collect()] == [("FillShape", "rId2")] and [(r.name, r.rid) for r in pk.charts(first).collect()] == [("Chart", "rId9")]
    assert [(r.name, r.is_equation, r.in_group) for r in pk.ole_objects(first).collect()] == [("Equation", True, False)]
    texts = [(r.name, r.text, r.ph, r.in_group) for r in pk.slide_texts(first).orderBy("seq").collect()]
    assert texts == [("Title 1", "Hello!", "title", False), ("in", "a!", "", True), ("low", "b!", "", True)]  # a field's text once
    assert pk.slide_texts(shapes.where("part like '%slide2.xml'")).first().text == "One! | Two!"
    kids = [(r.kind, r.name, r.root == r.parent, r.ord) for r in pk.group_children(first).orderBy("owner").collect()]
    assert kids == [("shape", "in", True, 1), ("group", "deep", True, 2), ("shape", "low", False, 1)]
    records = pk.image_records(shapes, links, parts)
    assert sorted((r.kind, r["index"], r.file, r.note) for r in records.collect()) == [("chart", 1, "", "no relationship"), ("formula_ole", 1, "e.bin", ""), ("picture", 1, "a.png", ""), ("picture", 2, "a.png", "")]
    objects = pk.slide_objects(shapes, records, pk.previews(shapes), pk.slides(found, links, parts)).where("page = 2").orderBy("z_index", "obj_id").collect()
    assert [(o.obj_id, o.kind, o.text, o.z_index) for o in objects] == [
        ("s02_g01", "group", "a!\nb!", 0), ("s02_sp001", "text_region", "Hello!", 1), ("s02_f01", "formula", "", 1001), ("s02_r01", "raster", "", 1001), ("s02_r02", "raster", "", 1002)]
    assert [tuple(r)[:4] for r in pk.volume(parts).collect()] == [("one", 2, 1, 1)]


def test_decks_without_a_list_or_with_broken_parts(spark, tmp_path):
    parts, found, links, _ = read(spark, tmp_path, deck(**{"ppt/presentation.xml": None, "ppt/slides/slide3.xml": "<p:sld"}))
    assert [r.part[-5] for r in pk.slides(found, links, parts).orderBy("page").collect()] == ["1", "2", "3"]
    assert found.where("part like '%slide3.xml'").count() == 0


def test_only_wanted_parts_are_unpacked(spark, tmp_path):
    """The bytes of a picture are damaged: whoever reads XML or names never meets them."""
    whole = deck(**{"ppt/media/photo.png": "q" * 500})
    (tmp_path / "one.pptx").write_bytes(whole.replace(b"q" * 500, b"q" * 499 + b"!"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "two.pptx").write_bytes(whole)
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"")
    parts = read_packages(spark, f"file://{tmp_path}")
    slides = parts.where("extension = 'xml' and part like 'ppt/slides/%' and deck_id <> 'x'")
    assert "StringStartsWith" in (plan := slides._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) or "ppt/slides/" in plan
    assert "Filter (" not in plan  # all of it is the reader's
    assert sorted((r.deck_id, r.part) for r in slides.collect()) == [(d, f"ppt/slides/slide{i}.xml") for d in ("one", "two") for i in (1, 2)]
    assert all(r.size == len(r.content) for r in slides.collect())
    assert nodes(parts.where("deck_id = 'one'")).count() == nodes(parts.where("deck_id = 'two'")).count() > 0
    assert {r.deck_id: r.content is None for r in parts.where("part = 'ppt/media/photo.png'").collect()} == {"one": True, "two": False}
    names = read_packages(spark, f"file://{tmp_path}", contents=False)
    assert names.where("content is not null").count() == 0 and names.where("extension in ('png', 'bin')").count() == 6
    assert names.where("size > 100 and part like '%.png'").count() == 2 and names.where("part not like 'ppt/%'").count() == 0
    assert read_packages(spark, f"{tmp_path}/more/two.pptx").select("deck_id").distinct().collect()[0].deck_id == "two"


def test_archives_and_files_are_written(spark, tmp_path):
    rows = [(f"d{i % 5}", f"ppt/{('media', 'embeddings', 'slides')[j % 3]}/f{j}.x", f"{i} {j}".encode() * 50) for i in range(5) for j in range(40)] + [("d9", "ppt/media/none.png", None), (None, "x", b"x")]
    parts = spark.createDataFrame(rows, "deck_id string, part string, content binary").repartition(6)
    write_packages(parts, f"file://{tmp_path}/decks")
    assert sorted(p.name for p in (tmp_path / "decks").iterdir()) == ["d0.pptx", "d1.pptx", "d2.pptx", "d3.pptx", "d4.pptx", "d9.pptx"]
    back = read_packages(spark, f"file://{tmp_path}/decks").select("deck_id", "part", "content")
    assert sorted((r.deck_id, r.part, bytes(r.content)) for r in back.collect()) == sorted((d, p, c or b"") for d, p, c in rows if d)
    write_media(back, f"file://{tmp_path}/media")
    there = {str(p.relative_to(tmp_path / "media")): p.read_bytes() for p in (tmp_path / "media").rglob("*") if p.is_file()}
    assert there == {f"{d}/{p[4:]}": c or b"" for d, p, c in rows if d and "slides" not in p}
    pictures = spark.createDataFrame([(f"a/slide_{i:02d}_img{j}.png", b"12") for i in (1, 12) for j in (1, 2)] + [("b/other.png", b""), ("b/slide_x_1.png", b"")], "name string, content binary")
    write_files(pictures, f"file://{tmp_path}/images")
    assert sorted(map(tuple, listed_images(spark, f"file://{tmp_path}/images").collect())) == [("a", i, f"slide_{i:02d}_img{j}.png", 2) for i in (1, 12) for j in (1, 2)]


def test_distances_to_a_preview_are_in_characters(spark, tmp_path):
    ole = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name=""/></p:nvGraphicFramePr><p:oleObj progId="Visio.1" r:id="rId3"/></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="3" name="photo"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/></p:blipFill></p:pic>'
    before = len('<p:oleObj progId="Visio.1" r:id="rId3"/></p:graphicFrame><!---->')
    for n, want in ((300 - before, "visio"), (301 - before, "")):
        part = f"<p:sld {NS}>{'é' * 9}{ole}<!--{'图' * n}-->{pic}</p:sld>"
        rows = spark.createDataFrame([("d", "ppt/slides/slide1.xml", part.encode())], "deck_id string, part string, content binary")
        assert [r.preview_of for r in pk.previews(pk.shapes(nodes(rows))).collect()] == [want]
        assert [r[2] for r in shred(part.encode()) if r[3] == "p:pic"] == [part.index("<p:pic")]


def test_markdown_as_html(spark):
    text = "# t\n- one **b**\n- two `c`\n\n$$\nx < 1\n$$\n$$ y\na *i* $p<q$ & <b> $$r*s*t$$"
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(text.split("\n"))], "deck string, seq int, text string")
    got = [r.html for r in md.html_blocks(rows).orderBy("seq").collect()]
    assert got == [
        "<p># t</p>", "<ul><li>one <strong>b</strong></li><li>two <code>c</code></li></ul>", '<div class="formula">$$\nx < 1\n$$</div>', '<div class="formula">$$\ny\n$$</div>',
        "<p>a <em>i</em> $p<q$ &amp; &lt;b&gt; $$r*s*t$$</p>"]


def test_a_textbook_is_asked_for_again_where_pages_are_missing(spark):
    pages = spark.createDataFrame([("d", p, f"page {p}") for p in range(1, 6)], "deck string, page bigint, prompt string")
    batches = spark.createDataFrame([("d", p, p // 3) for p in range(1, 6)], "deck string, page bigint, batch bigint")

    def make():
        def reply(prompt):
            asked = [int(line.split()[-1]) for line in prompt.split("\n") if line]
            said = [p for p in asked if not (p == 4 and len(asked) > 1) and p != 5]
            return "intro\n" + "".join(f"## 第 {p} 页\n\ntext of {p}\n\n" for p in said)

        return reply

    got = sorted((r.page, r.text) for r in models.author(pages, batches, make).collect())
    assert got == [(p, f"text of {p}") for p in (1, 2, 3, 4)]
    assert models.author(pages, batches, None).collect() == []


def test_manifests_and_lines_are_written(spark, tmp_path):
    lines = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "deck string, seq int, text string")
    sinks.write_lines(lines, f"file://{tmp_path}/lines")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lines/deck=a").collect()] == ["x", "y"]
    sinks.write_manifest(spark.createDataFrame([(1, [2])], "page int, box array<int>"), f"file://{tmp_path}/m")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/m/manifest_csv").first().asDict() == {"page": "1", "box": "[2]"}
    assert spark.read.json(f"file://{tmp_path}/m/manifest_json").first().page == 1


def test_replies_that_are_no_single_object(spark):
    rows = spark.createDataFrame([("say {\"a\": 1} so",), ("{\"a\": 1} {\"a\": 2}",), ("{bad",), (None,), ("none",)], "t string")
    got = [r.v for r in rows.select(fn.json_in_prose(rows.t).cast("string").alias("v")).collect()]
    assert got == ['{"a":1}', None, None, None, None]
