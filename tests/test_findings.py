"""Queries against their SQL on odd rows that the given tables lack."""

import io
import os

import pytest
from pyspark.sql import functions as F

from slatework.operators import package as pk
from slatework.plans.catalogue import ORACLE_SQL, QUERIES
from slatework.plans import files, packages
from slatework.sources import results
from slatework.sources.decks import in_rounds, list_files, with_contents, write_files
from slatework.sources.ooxml import drawings, nodes

from .compare import expected, given


def same(spark, folder, query, **tables):
    """Whether the query gives what its SQL gives on these tables."""
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return given(QUERIES[query](spark, str(folder))) == expected(str(folder), ORACLE_SQL[query], list(tables))


def test_titles_of_blank_documents(spark, tmp_path):
    texts = [None, "", " ", "\n \n", "\n  \n one\t two", "w " * 40]
    assert same(spark, tmp_path, "page_titles", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


@pytest.mark.parametrize("query", ["model_images", "page_figures"])
def test_long_contents_in_urls(spark, tmp_path, query):
    rows = [(i, "https://host/" + "p" * i) for i in range(20, 120)]
    assert same(spark, tmp_path, query, pages=spark.createDataFrame(rows, "page_id bigint, url string"))


NS = (
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
)


def odd_parts():
    """Parts with nested groups, tables in groups, texts in odd places, numbers that are none, other prefixes and encodings."""
    named = lambda n, i="1": f'<p:nvSpPr><p:cNvPr id="{i}" name="{n}"/><p:cNvPr name="later" id="z"/></p:nvSpPr>'
    box = lambda x: f'<a:xfrm><a:off x="{x}" y=" 9525 "/><a:off x="19050" y="1"/><a:ext cx="1e4" cy="-5"/></a:xfrm>'
    text = lambda t: f"<a:p><a:r><a:t> {t}</a:t></a:r><a:br/><a:r><a:t>é<a:x>in</a:x>{t} </a:t></a:r></a:p>"
    cell = lambda t: f"<a:tc><a:txBody>{text(t)}{text('2')}</a:txBody></a:tc>"
    frame = f'<p:graphicFrame>{named("t")}<p:xfrm><a:off x="1" y="2"/></p:xfrm><a:tbl><a:tr>{cell("a|b")}{cell("")}</a:tr><a:tr/><a:tr>{cell("c")}</a:tr>{cell("loose")}</a:tbl></p:graphicFrame>'
    ole = f'<p:graphicFrame>{named("")}<p:oleObj progId="Equation.3"/><p:oleObj progId="Visio.1" r:id="rId3"/><p:oleObjEmbed r:id="rId4"/><p:pic><p:blipFill><a:blip/><a:blip r:link="rId5"/><a:srcRect l="x" t="25000"/></p:blipFill></p:pic></p:graphicFrame>'
    plain = f'<p:sp>{named("s")}<p:nvPr><p:ph/></p:nvPr>{box("abc")}<p:txBody>{text("one")}{text(" ")}<a:t>bare</a:t></p:txBody><a:t>not in a body</a:t><a:blipFill><a:blip r:embed="rId1"/></a:blipFill></p:sp>'
    line = f'<p:cxnSp>{named("l", "7")}{box("0x10")}<a:stCxn id="1"/><a:endCxn id="7"/></p:cxnSp>'
    chart = f'<p:graphicFrame>{named("c")}<c:chart r:id="rId9"/></p:graphicFrame>'
    group = lambda *inner: f"<p:grpSp>{named('g')}{box('1d')}{''.join(inner)}</p:grpSp>"
    slide = lambda *inner, head="": f"{head}<p:sld {NS}><p:cSld><p:spTree><a:t>none's</a:t>{''.join(inner)}</p:spTree></p:cSld></p:sld>"
    bodies = [
        slide(plain, group(plain, group(line, frame), ole), line, frame, chart, ole), slide(), "<p:sld", "", "no xml",
        slide(plain, line).replace("p:", "q:"), slide(group(plain, line), head='<!DOCTYPE x [<!ENTITY e "&#60;p:sp/>">]>').replace("none's", "&e;"),
    ]
    contents = [b.encode() for b in bodies] + [slide(plain, group(line)).encode("utf-16"), slide(line, head='<?xml version="1.0" encoding="iso-8859-1"?>').encode("latin-1"), slide(line, head='<?xml version="1.0" encoding="none"?>').encode(), None]
    return [("d", f"ppt/slides/slide{i}.xml", c if c is None else bytearray(c)) for i, c in enumerate(contents)]


def test_drawings_are_the_shapes_of_the_nodes(spark):
    parts = spark.createDataFrame(odd_parts(), "deck_id string, part string, content binary")
    want = pk.shapes(nodes(parts)).drop("pos", "ole_pos")
    assert given(drawings(parts)) == given(want) and want.count() > 20
    for kind, word in (("p:cxnSp", "cxnSp"), ("p:pic", "pic")):
        assert given(drawings(parts, "owner", "tag", "text", kinds=(kind,), holding=(word,))) == given(want.where(f"tag = '{kind}'").select("deck_id", "part", "owner", "tag", "text"))


def test_wanted_nodes_are_those_of_all(spark):
    parts = spark.createDataFrame(odd_parts(), "deck_id string, part string, content binary")
    every = nodes(parts)
    assert given(nodes(parts, "a:blip", "a:t")) == given(every.where("tag in ('a:blip', 'a:t')"))
    assert given(nodes(parts, "a:blip", holding=("blip",))) == given(every.where("tag = 'a:blip'"))
    roots = lambda rows: rows.where("parent is null").select("deck_id", "part", "tag")
    assert given(roots(nodes(parts, "a:blip", root=True, holding=("bg",)))) == given(roots(every))


def test_files_are_listed_and_kept_for_a_round_only(spark, tmp_path):
    rows = [(f"a{i % 7}/b{i % 3}/slide_{i:02d}_x.png", b"x" * i) for i in range(40)] + [("top.txt", b"t"), (".hidden/slide_01_x.png", b""), ("a0/_no", b"")]
    write_files(spark.createDataFrame(rows, "name string, content binary"), f"file://{tmp_path}/f")
    shown = sorted((n, len(c)) for n, c in rows if not n.startswith(".") and "/_" not in n)
    files = list_files(spark, f"file://{tmp_path}/f")
    assert sorted((r.path.split("/f/")[1], r.length) for r in files.collect()) == shown
    assert sorted((r.path.split("/f/")[1], len(r.content)) for r in with_contents(files, str(tmp_path)).collect()) == shown
    seen = []

    def run(i, folder):
        write_files(spark.createDataFrame([(f"d{i}/{j}", b"x") for j in range(i)] + [(f"f{i}", b"")], "name string, content binary"), folder)
        seen.append(folder.removeprefix("file://"))
        assert [os.path.exists(f) for f in seen] == [False] * i + [True]
        return list_files(spark, folder).select(F.lit(i).alias("i"), "length")

    assert sorted(tuple(r) for r in in_rounds(spark, 3, run).collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 1)]
    assert not any(os.path.exists(f) for f in seen)


@pytest.mark.parametrize("query, plan, limits", [("package_archive_relations", packages, {}), ("result_images", files, {"PICTURED": 1500}), ("binding_files", files, {"BOUND": 1500})])
def test_rounds_make_the_same_rows(spark, query, plan, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(plan, name, value)
    own = plan.from_archives(lambda parts, _: pk.relationships(nodes(parts.where("extension = 'rels'"))), 2500) if not limits else QUERIES[query]
    folder = "/root/testdata/sf0.001"
    assert given(own(spark, folder)) == expected(folder, ORACLE_SQL[query])


def test_large_files_are_read_element_by_element(spark, tmp_path, monkeypatch):
    texts = {
        "a [1]": '﻿ [ {"id": "é", "page": 1, "text": "a]\\"}"} ,\n{"id":"2","page":2}, {"id": "3"} ]\n', "b": "[]", "c": '[{"id": "x", "page": 1}, {"id": "y", "page": "no"}]', "d": '[{"id": "x", "page": 1},]',
        "e": '[{"id": "x", "page": 1}', "f": '[{"id": "x", "page": 1}] {}', "g": "", "h": '[{"id": "x", "page": 1}, 5]', "i": '[{"id": "x" "page": 1}, {"id": "y", "page": 1}]', "j": '[{"id": "' + "z" * 100 + '", "page": 12345}]',
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "text_entries.json").write_text(text, encoding="utf-8")
    read = lambda: sorted(tuple(r) for r in results.read_text_entries(spark, f"file://{tmp_path}").collect())
    usual = read()
    monkeypatch.setattr(results, "LARGE", 0)
    for chunk in (7, 4 << 20):
        monkeypatch.setattr(results, "CHUNK", chunk)
        assert [list(results.elements(io.BytesIO(texts[k].encode()))) for k in ("b", "h")] == [[], ['{"id": "x", "page": 1}', "5"]]
        assert [r[1:3] for r in read()] == [r[1:3] for r in usual] and read() == usual and len(usual) == 4


def test_arrays_are_written_object_by_object(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}", i // 3, None if i % 4 else f"é{i}") for i in range(30)], "key string, n int, s string").repartition(5)
    results.write_json_arrays(rows, f"file://{tmp_path}", F.concat("key", F.lit("/a.json")), "key", "n")
    want = {r.key: bytes(r.content) for r in results.json_array(rows, "key", "n").collect()}
    assert {p.parent.name: p.read_bytes() for p in tmp_path.glob("*/a.json")} == want
