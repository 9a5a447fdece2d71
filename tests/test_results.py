"""Files of earlier runs, versions, formula placement, group segments, pixels, model calls and the stream, on small fixtures."""

import json
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework import functions as fn
from slatework.operators import images as im
from slatework.operators import markdown as md
from slatework.operators import models
from slatework.operators import package as pk
from slatework.operators import pixels as px
from slatework.sources import results, versions
from slatework.streaming import append_captions, caption_all, written


def test_files_of_earlier_runs_are_read(spark, tmp_path):
    objects = [{"obj_id": "a", "page": 1, "kind": "shape", "bbox": {"x": 1, "y": 2.5, "w": 3, "h": 4}, "z_index": 7}, {"obj_id": "b", "page": 2, "text": "t", "extra": [1]}]
    for folder, place, content in (
        ("one", "atomic_objects.json", json.dumps(objects)), ("one", "_proc/img/atomic_objects.json", json.dumps([{"obj_id": "later"}])),
        ("two", "过程文件/img/atomic_objects.json", json.dumps(objects[1:], ensure_ascii=False)), ("three", "_proc/img/atomic_objects.json", json.dumps(objects[:1])),
        ("four", "atomic_objects.json", "{broken"), ("four", "_proc/img/atomic_objects.json", json.dumps(objects)), ("five + six", "atomic_objects.json", "[]"),
        ("one", "text_entries.json", json.dumps([{"id": "TXT1", "page": 1, "type": "x", "text": "hi", "x": 1}, {"id": "", "page": 1}, {"id": "n"}, {"page": 2}])),
        ("one", "manifest.json", json.dumps([{"output_file": "f.png", "page": 1, "index": 1}, {"output_file": "f.png", "page": 1, "index": 2}, {"page": 1}, {"output_file": "g", "page": None}])),
    ):
        (tmp_path / folder / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / place).write_text(content, encoding="utf-8")
    got = [(r.folder.rsplit("/", 1)[-1], r.obj_id, r.page, r.kind, r.text, r.x, r.h, r.z_index) for r in results.read_objects(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == [("one", "a", 1, "shape", "", 1.0, 4.0, 7), ("one", "b", 2, "", "t", 0.0, 0.0, 0), ("three", "a", 1, "shape", "", 1.0, 4.0, 7), ("two", "b", 2, "", "t", 0.0, 0.0, 0)]
    assert [tuple(r)[1:] for r in results.read_text_entries(spark, f"file://{tmp_path}").collect()] == [(1, "TXT1", "hi", 1.0, 0.0, 0.0, 0.0)]
    assert [(r.page, r.output_file, r["index"]) for r in results.read_manifest(spark, f"file://{tmp_path}").collect()] == [(1, "f.png", 2)]
    back = results.json_array(spark.createDataFrame([("d", 2, None), ("d", 1, "é\"")], "deck string, n int, s string"), "deck", "n").first()
    assert json.loads(bytes(back.content).decode()) == [{"n": 1, "s": "é\""}, {"n": 2, "s": None}]


def test_a_version_counts_only_when_it_is_whole(spark, tmp_path):
    path = f"file://{tmp_path}/deck"
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    ids = lambda name: sorted(r.id for r in versions.read(spark, path, name).collect())
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "blocks")
    check = lambda tables: tables["relations"].join(tables["blocks"], "id", "left_anti")
    first = versions.publish(spark, path, {"blocks": table(1, 2, 3), "relations": table(1, 2)}, check)
    assert ids("blocks") == [1, 2, 3] and versions.current(spark, path) == first
    fails = table(1, 2).select(F.when(F.col("id") == 2, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("int").alias("id"))
    with pytest.raises(Exception, match="half-way"):
        versions.publish(spark, path, {"blocks": table(1), "relations": fails}, check)
    assert ids("blocks") == [1, 2, 3]
    with pytest.raises(ValueError, match="not consistent"):
        versions.publish(spark, path, {"blocks": table(1), "relations": table(1, 2)}, check)
    assert ids("blocks") == [1, 2, 3]
    versions.publish(spark, path, {"blocks": versions.read(spark, path, "blocks").where("id <> 3"), "relations": versions.read(spark, path, "relations")}, check)
    assert ids("blocks") == [1, 2] and sorted(r.id for r in spark.read.parquet(f"{first}/blocks").collect()) == [1, 2, 3]


def placed(lines, page, latex):
    """One formula put into a file's lines."""
    import re

    if not lines:
        lines = list(md.NEW_FILE)
    n = 1 + sum(bool(re.search(rf"\(p{page}-(?:f|img)\d+\)", line)) for line in lines)
    entry = [f"- **(p{page}-img{n})** $$", *latex.strip().split("\n"), "$$", "", md.FROM_PICTURE]
    heads = sorted((int(m[1]), i) for i, line in enumerate(lines) if (m := re.match(r"^##\s*第\s*(\d+)\s*页\s*$", line.strip())))
    if not heads:
        return [*lines, f"## 第 {page} 页", "", *entry, ""]
    at = next((i for p, i in heads if p > page), len(lines))
    return [*lines[:at], "", *entry, *lines[at:]]


def test_formulas_are_placed_by_page(spark):
    files = {
        "a": ["# head", "", "## 第 2 页", "", "- **(p2-f1)** $x$ and (p2-img2)", "## 第 5 页", "- (p5-img1)", "text", "## 第 3 页", "tail (p3-f9)"],
        "b": ["no heading", "(p4-f1)"], "c": [], "d": ["## 第 1 页"], "e": ["## 第 1 页", "x"],
    }
    formulas = [("a", 2, "x\ny"), ("a", 2, " z "), ("a", 1, "low"), ("a", 4, "mid"), ("a", 9, "high"), ("a", 3, "q"), ("b", 4, "f"), ("b", 6, "g"), ("b", 4, "h"), ("c", 3, "new"), ("d", 1, "w"), ("d", 7, " "), ("f", 2, "only")]
    rows = spark.createDataFrame([(d, i, t) for d, own in files.items() for i, t in enumerate(own)], "deck string, seq int, text string")
    asked = spark.createDataFrame([(d, p, i, x) for i, (d, p, x) in enumerate(formulas)], "deck string, page int, n int, latex string")
    got = {}
    for r in md.place_formulas(rows, asked).orderBy("deck", "seq").collect():
        got.setdefault(r.deck, []).append(r.text)
    want = {d: list(own) for d, own in files.items() if own}
    for d, p, x in sorted((f for f in formulas if f[2].strip()), key=lambda f: f[:2]):
        want[d] = placed(want.get(d, []), p, x)
    assert got == want


def test_groups_are_cut_out_of_a_slide_as_they_stand(spark):
    inner = '<p:grpSp><p:grpSpPr/><a:blip r:embed="rId2"/></p:grpSp>'
    slides = {
        1: f"<p:sld>é{inner}<p:sp/><p:grpSp a='1'><p:grpSpPr>x</p:grpSpPr>{inner}<a:blip r:link=\"rId3\"/><a:blip r:embed=\"rId2\"/></p:grpSp><p:grpSp /></p:sld>",
        2: f"<p:sld><p:grpSp>lost {inner} and {inner}", 3: f"</p:grpSp>{inner}</p:grpSp><p:grpSp/>{inner}", 4: "<p:sld/>", 5: f"<p:grpSp>lost<p:grpSp>too {inner}<p:grpSp>kept {inner}</p:grpSp>",
    }
    parts = [("d", f"ppt/slides/slide{i}.xml", t.encode()) for i, t in slides.items()] + [("d", "ppt/media/a.png", b""), ("d", "ppt/slideLayouts/l.xml", inner.encode()), ("d", "ppt/slides/slide9.xml", None)]
    table = spark.createDataFrame(parts, "deck_id string, part string, content binary")
    found = pk.group_segments(table)
    got = {}
    for r in found.orderBy("part", "ord").collect():
        got.setdefault(int(r.part[-5]), []).append(r.xml)
    outer = slides[1][slides[1].index("<p:grpSp a") : slides[1].index("<p:grpSp />")]
    kept = slides[5][slides[5].index("<p:grpSp>kept") :]
    assert got == {1: [inner, outer], 2: [inner, inner], 3: [inner, inner], 5: [inner, kept]}
    rels = spark.createDataFrame([("d", f"ppt/slides/slide{i}.xml", f"rId{j}", t) for i in (1, 2) for j, t in ((2, "ppt/media/a.png"), (3, "ppt/media/none.png"), (4, "ppt/x"))], "deck_id string, part string, rid string, target string")
    blips = sorted((int(r.part[-5]), r.ord, r.rid, r.media) for r in pk.group_blips(found, rels, table).collect())
    assert blips == [(1, 1, "rId2", "ppt/media/a.png"), (1, 2, "rId2", "ppt/media/a.png"), (2, 1, "rId2", "ppt/media/a.png"), (2, 2, "rId2", "ppt/media/a.png")]
    texts = spark.createDataFrame([("d", "p1", '<a t="../media/a.png"/> b.png'), ("d", "p2", "a.png,xb.png"), ("e", "p3", "b.png")], "deck_id string, part string, xml string")
    names = spark.createDataFrame([("d", "a.png"), ("d", "b.png"), ("d", "c.png")], "deck_id string, name string")
    assert sorted(map(tuple, pk.exclusive_media(texts, names).collect())) == [("d", "a.png", 2, False), ("d", "b.png", 1, True), ("d", "c.png", 0, True)]


def png(pixels, colour=2, depth=8, filters=(0, 1, 2, 3, 4), palette=b"", interlaced=0):
    """A file with the given filters in turn; pixels are lines of bytes as they are packed."""
    step = max(1, px.SAMPLES[colour] * depth // 8)
    out, above = b"", np.zeros(pixels.shape[1], dtype=int)
    for i, line in enumerate(pixels.astype(int)):
        left, corner = (np.concatenate([np.zeros(step, dtype=int), x])[: len(line)] for x in (line, above))
        far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))
        near = np.choose(far.argmin(0), [left, above, corner])
        kind = filters[i % len(filters)]
        out += bytes([kind]) + ((line - (np.zeros_like(line), left, above, (left + above) // 2, near)[kind]) % 256).astype(np.uint8).tobytes()
        above = line
    wide = pixels.shape[1] * 8 // (px.SAMPLES[colour] * depth)
    made = [(b"IHDR", struct.pack(">IIBBBBB", wide, len(pixels), depth, colour, 0, 0, interlaced)), *([(b"PLTE", palette)] if palette else []), (b"IDAT", zlib.compress(out)[:20]), (b"IDAT", zlib.compress(out)[20:]), (b"IEND", b"")]
    return px.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in made)


def test_pixels_of_files(spark):
    rng = np.random.default_rng(2)
    rgb = rng.integers(256, size=(11, 7, 3), dtype=np.uint8)
    assert (px.decoded(png(rgb.reshape(11, -1))) == rgb).all() and (px.decoded(px.encoded(rgb)) == rgb).all()
    alpha = np.concatenate([rgb, rng.integers(256, size=(11, 7, 1), dtype=np.uint8)], axis=2)
    assert (px.decoded(png(alpha.reshape(11, -1), 6)) == rgb).all()
    grey = rng.integers(256, size=(6, 5), dtype=np.uint8)
    assert (px.decoded(png(grey, 0))[:, :, 1] == grey).all()
    assert (px.decoded(png(np.repeat(grey, 2, axis=1), 0, 16))[:, :, 0] == grey).all()
    table = bytes(rng.integers(256, size=48, dtype=np.uint8))
    packed = rng.integers(256, size=(4, 3), dtype=np.uint8)
    places = np.stack([packed >> 4, packed & 15], axis=2).reshape(4, 6)
    assert (px.decoded(png(packed, 3, 4, palette=table)) == np.frombuffer(table, dtype=np.uint8).reshape(16, 3)[places]).all()
    assert (px.decoded(png(packed, 0, 1))[:, :, 0] == np.unpackbits(packed, axis=1) * 255).all()
    whole = png(rgb.reshape(11, -1))
    broken = [None, b"", b"GIF89a", whole[:-1], whole[:60] + bytes([whole[60] ^ 1]) + whole[61:], png(rgb.reshape(11, -1), interlaced=1)]
    assert all(px.decoded(b) is None for b in broken)
    rows = [(i, b, 1, 2, 4, 30) for i, b in enumerate([whole, png(np.full((40, 60), 255, dtype=np.uint8), 0), png(np.full((3, 3), 199, dtype=np.uint8), 0), *broken])]
    images = spark.createDataFrame(rows, "ink int, content binary, left int, top int, right int, bottom int").withColumnRenamed("ink", "id")
    got = {r.id: r for r in px.measured(images).collect()}
    assert [got[i].whole for i in range(9)] == [True] * 3 + [False] * 6
    assert (got[0].px_wide, got[0].px_high, got[0].ink) == (7, 11, float((px.grey(rgb) < 200).mean())) and got[0].colours == 77
    assert (got[1].ink, got[1].colours, got[2].ink, got[2].colours, got[5].ink) == (0.0, 1, 1.0, 1, None)
    cut = {r.id: r.content for r in px.cropped(images).collect()}
    assert (px.decoded(bytes(cut[0])) == rgb[2:, 1:4]).all() and px.decoded(bytes(cut[1])).shape == (28, 3, 3) and all(cut[i] is None for i in range(3, 9))


def test_metafiles_with_curves_and_cut_off_records(spark):
    record = lambda kind, words=4: struct.pack("<IH", words, kind) + bytes(2 * words - 6)
    head = bytes(18)
    placed_ = bytes.fromhex("D7CDC69A") + bytes(36)
    rows = [(1, head + record(0x0A32)), (0, head + record(0x0A32) + record(0x0325)), (0, head + record(0x0325) + record(0x0A32)), (0, head + record(0x0A32)[:5]), (1, placed_ + record(0x0329) + record(0x0325)[:6]), (0, head), (1, head + record(0x1111) * 400 + record(0x032B))]
    table = spark.createDataFrame(rows, "want int, content binary")
    assert all(bool(r.want) == r.got for r in table.select("want", im.wraps_bitmap(F.col("content")).alias("got")).collect())


def test_model_calls_overlap_keep_their_order_and_pause():
    going, most, lock, tries = [0], [0], threading.Lock(), {}

    def make():
        def reply(prompt):
            with lock:
                going[0] += 1
                most[0] = max(most[0], going[0])
                tries.setdefault(prompt, []).append(time.monotonic())
            time.sleep(0.05 if prompt != "p0" else 0.2)
            with lock:
                going[0] -= 1
            if prompt in ("p1", "p3"):
                raise TimeoutError
            return " " if prompt == "p2" else prompt.upper()

        return reply

    caller = models.Caller(make, retries=2, calls=8, pause=0.1, insist="!")
    begin = time.monotonic()
    got = caller.replies([f"p{i}" for i in range(32)] + [None, "p5"])
    assert got == [f"P{i}!" if i in (1, 2, 3) else f"P{i}" for i in range(32)] + [None, "P5"]
    assert time.monotonic() - begin < 1.2 and 4 <= most[0] <= 8  # one after the other: 1.75 s and more
    assert len(tries["p1"]) == 2 and tries["p1"][1] - tries["p1"][0] >= 0.14 and len(tries["p5"]) == 1
    slow = models.Caller(lambda: str.upper, calls=8, rate=50)
    begin = time.monotonic()
    assert slow.replies([str(i) for i in range(20)]) == [str(i) for i in range(20)] and time.monotonic() - begin >= 0.35


def test_models_are_asked_by_rows(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"q{i}", f"p {i}") for i in range(50)], "reply_to int, q string, prompt string").repartition(2)
    got = {r.reply_to: r.reply for r in models.ask(rows.drop("prompt"), F.col("q"), lambda: str.upper).collect()}
    assert got == {i: None if i == 3 else f"Q{i}" for i in range(50)}
    assert models.ask(rows, F.col("q"), None).where("reply is not null").count() == 0
    xml = "<p:grpSp>" + "<a:t>A &amp; B</a:t><a:t> </a:t><m:oMath/><m:oMathPara>" * 60 + "</p:grpSp>"
    said = spark.range(1).select(fn.xml_summary(F.lit(xml)).alias("s"), F.length(models.xml_prompt(F.lit(xml), F.lit("t" * 2000))).alias("n")).first()
    assert said.s == "【组合结构】t×120、oMath×60、oMathPara×60、grpSp×1\n【组内文字】" + " | ".join(["A & B"] * 60)[:800] + "\n【公式对象】60 个"
    assert said.n == len(models.XML_ASKS) + 1 + models.XML_START + len("\n\n……（XML 过长已压缩）……\n\n") + len(said.s) + 2 + 1200


def test_a_stream_asks_once_and_again_where_it_failed(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/captions"
    schema = "file string, n int"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
    add(("a", 1), ("b", 1), ("a", 2))
    spark.createDataFrame([("old", "kept", 7)], "file string, text string, batch int").write.partitionBy("batch").parquet(path)
    images = lambda: spark.readStream.schema(schema).parquet(f"file://{source}")
    asked = []

    def caption(rows):
        asked.extend((r.file, r.tries) for r in rows.collect())
        fails = (F.col("file") == "never") | (F.col("file") == "b") & (F.col("tries") == 0)
        return rows.select("file", F.when(fails, " ").otherwise(F.concat(F.lit("of "), "file")).alias("text"))

    append_captions(images(), caption, path, every=None, tries=2).awaitTermination()
    add(("old", 1), ("c", 1), ("never", 1), ("a", 3))
    caption_all(images(), caption, path, tries=2)
    assert sorted((r.file, r.text) for r in written(spark, path, "file string, text string").collect()) == [("a", "of a"), ("b", "of b"), ("c", "of c"), ("old", "kept")]
    assert [(r.file, r.tries) for r in written(spark, f"{path}-failed", "file string, tries int").collect()] == [("never", 2)]
    assert sorted(asked) == [("a", 0), ("b", 0), ("b", 1), ("c", 0), ("never", 0), ("never", 1)]


def as_html(lines):
    """Blocks with the number of their first line: a toggle tells formulas, neighbours of one kind make a list."""
    import itertools
    import re

    def inline(text):
        formula = re.compile(r"\$\$.*?\$\$|(?<!\$)\$[^$\n]+?\$(?!\$)", re.S)
        kept = iter(formula.findall(text))
        rest = formula.sub("\0", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for mark, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"(?<!\*)\*([^*\n]+?)\*(?!\*)", "em"), (r"`([^`\n]+?)`", "code")):
            rest = re.sub(mark, rf"<{tag}>\1</{tag}>", rest)
        return re.sub("\0", lambda _: next(kept), rest)

    inside, marked_ = 0, []
    for i, line in enumerate(lines):
        bare = line.strip() == "$$"
        if bare and not inside % 2:
            start = i
        inside += bare
        if bare or inside % 2:
            marked_.append((("formula", start), i, None if bare else line))
        else:
            line = line.strip()
            kind = "one" if line.startswith("$$") else "item" if line.startswith("- ") else "text"
            marked_.append((("item", -1) if kind == "item" else (kind, i), i, line))
    found = []
    for (kind, _), own in itertools.groupby(marked_, key=lambda m: m[0]):
        own = list(own)
        held = [t for _, _, t in own if t is not None]
        if kind in ("formula", "one"):
            found.append((own[0][1], '<div class="formula">$$\n' + "\n".join(t if kind == "formula" else t[2:] for t in held).strip() + "\n$$</div>"))
        elif kind == "item":
            found.append((own[0][1], "<ul>" + "".join(f"<li>{inline(t[2:])}</li>" for t in held) + "</ul>"))
        elif held[0]:
            found.append((own[0][1], f"<p>{inline(held[0])}</p>"))
    return found


def test_markdown_as_html_against_python(spark):
    rng = np.random.default_rng(21)
    words = ["a", "b*", "*c*", "**d**", "**", "`x`", "$p<q$", "$$r*s$$", "$", "&", "<b>", "- ", "é", "1 $ 2 $", "***e***"]
    line = lambda: str(rng.choice(["", "- ", "  - ", "$$ ", "\t", " "], p=[0.4, 0.25, 0.1, 0.05, 0.1, 0.1])) + " ".join(rng.choice(words, rng.integers(0, 5)))
    files = {f"f{i}": [str(rng.choice(["$$", "", " $$ ", line(), line(), line()])) for _ in range(rng.integers(1, 25))] for i in range(120)}
    rows = spark.createDataFrame([(d, i, t) for d, own in files.items() for i, t in enumerate(own)], "deck string, seq int, text string")
    got = {}
    for r in md.html_blocks(rows).orderBy("deck", "seq").collect():
        got.setdefault(r.deck, []).append((r.seq, r.html))
    assert got == {d: html for d, own in files.items() if (html := as_html(own))}
