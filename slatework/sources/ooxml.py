"""Presentation packages: the elements of the XML parts of decks as rows."""

from __future__ import annotations

import re
from collections.abc import Container, Iterable, Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefixes that the format's namespaces usually have; elements and attributes of others have none.
PREFIXES = {
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/chart": "c",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
}
#: Elements that are objects of a slide; what lies in one, up to the next, is its own.
SHAPES = ("p:sp", "p:pic", "p:graphicFrame", "p:cxnSp", "p:grpSp")
#: Columns that name the nearest element of a kind around a node, and those kinds.
AROUND = {"owner": SHAPES, "body": ("p:txBody",), "para": ("a:p",), "row": ("a:tr",), "cell": ("a:tc",), "bg": ("p:bg",), "ole": ("p:oleObj",), "math": ("m:oMath",)}
#: Nodes that go to Spark together, and the rest of a part.
BATCH_NODES = 8_192
NODES = (
    "deck_id string, part string, node int, parent int, pos bigint, tag string, attrs map<string,string>, text string, outer_group int, group int, "
    + ", ".join(f"{name} int" for name in AROUND)
)


#: For every tag that others are said to lie in, the columns that name it.
_TRACKED = {tag: [column for column, kinds in AROUND.items() if tag in kinds] for kinds in AROUND.values() for tag in kinds}


def _outermost(content: bytes) -> bytes:
    """A document of its outermost element alone, for one that is well-formed; else an empty one."""
    found: list[str] = []
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(name: str, _: dict[str, str]) -> None:
        found.append(name)
        parser.StartElementHandler = None

    parser.StartElementHandler = start
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, LookupError, ValueError):
        return b""
    space, _, local = found[0].rpartition(" ")
    return f"<{local} xmlns={quoteattr(space)}/>".encode() if space else f"<{local}/>".encode()


def shred(content: bytes, tags: frozenset[str] | None = None, root: bool = True) -> list[tuple]:
    """The elements of a document in order, each with what lies around it; none of one that is not well-formed.

    With ``tags`` only elements of these, and the outermost one with ``root``; their numbers are those of the whole document.
    """
    rows: list[list] = []
    count = -1
    nothing = {"outer_group": None, "group": None, **dict.fromkeys(AROUND)}
    stack: list[tuple[int | None, dict, list | None]] = [(None, nothing, None)]
    names: dict[str, str] = {}
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def short(name: str) -> str:
        if (known := names.get(name)) is None:
            space, _, local = name.rpartition(" ")
            known = names[name] = f"{PREFIXES[space]}:{local}" if space in PREFIXES else local
        return known

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal count
        count += 1
        parent, around, _ = stack[-1]
        node, tag = count, names.get(name) or short(name)
        own = inside = around
        if tag in _TRACKED:
            own = {**around, **dict.fromkeys(_TRACKED[tag], node)}
            inside = own
            if tag == "p:grpSp":  # a group is not in itself
                inside = {**own, "group": node, "outer_group": node if own["outer_group"] is None else own["outer_group"]}
        row = None
        if tags is None or tag in tags or root and parent is None:
            row = [node, parent, parser.CurrentByteIndex, tag, [(short(k), v) for k, v in attrs.items()], "", own]
            rows.append(row)
        stack.append((node, inside, row))

    def end(_: str) -> None:
        stack.pop()

    def text(data: str) -> None:
        if (row := stack[-1][2]) is not None:
            row[5] += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, LookupError, ValueError):
        return []
    if not content.isascii():  # places in characters, not bytes
        before = np.cumsum((np.frombuffer(content, dtype=np.uint8) & 0xC0) != 0x80)
        for r in rows:
            r[2] = int(before[r[2]]) - 1
    return [(*r[:6], r[6]["outer_group"], r[6]["group"], *(r[6][k] for k in AROUND)) for r in rows]


def _holds(words: Iterable[str]) -> Column:
    """Whether a part may have elements of these names without prefix; one whose bytes don't show them can't, but for other encodings and entities."""
    content, of = F.col("content"), lambda word: F.lit(bytearray(word, "ascii"))
    return reduce(Column.__or__, [F.contains(content, of(w)) for w in _shown(words)])


def _shown(words: Iterable[str]) -> tuple[str, ...]:
    return (*words, "\0", "<!DOCTYPE")


def _xml(parts: DataFrame) -> DataFrame:
    named = F.col("part").endswith(".xml") | F.col("part").endswith(".rels")
    return parts.where(F.col("extension").isin("xml", "rels") if "extension" in parts.columns else named).select("deck_id", "part", "content")


def nodes(parts: DataFrame, *tags: str, root: bool = False, holding: tuple[str, ...] = ()) -> DataFrame:
    """A row for each element of the XML parts of ``parts(deck_id, part, content)``, or for those with one of ``tags`` and, with ``root``, the outermost.

    With ``holding`` parts that have none of these elements, named without prefix, may be passed over, but for the outermost element's name.
    Where parts have an ``extension``, as those of archives, other parts are not even unpacked. node numbers a part's
    elements in document order; parent is the element around it and pos where it starts, in characters of UTF-8. outer_group and group are the outermost and the nearest group around it, the other columns the nearest
    element of their kind, itself included. Parts that are not well-formed have no elements.
    """
    fields = [f.split() for f in NODES.split(", ")]
    wanted, words = frozenset(tags) or None, [w.encode() for w in _shown(holding)] if root and holding else None
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)], names=[n for n, _ in fields])

        for batch in batches:
            for deck, part, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if words and content and not any(w in content for w in words):
                    content = _outermost(content)
                held += [(deck, part, *row) for row in shred(content or b"", wanted, root)]
                if len(held) >= BATCH_NODES:
                    yield out()
                    held = []
        if held:
            yield out()

    xml = _xml(parts)
    return (xml.where(_holds(holding)) if holding and not root else xml).mapInArrow(run, NODES)


#: Columns of a shape in the order that ``draw`` makes them.
SHAPE_FIELDS = (
    "owner int, tag string, outer_group int, group int, name string, shape_id string, ph string, x double, y double, w double, h double, blip string, src_rect struct<l: double, t: double, r: double, b: double>, "
    "pictured boolean, filled boolean, ole string, prog_id string, chart string, start_id string, end_id string, tabled boolean, text string, rows array<array<string>>"
)
_FIELDS = re.findall(r"(?:^|, )(\w+) (struct<.*?>|\S+?)(?=, \w+ |$)", SHAPE_FIELDS)
_AT = {name: i for i, (name, _) in enumerate(_FIELDS)}
_NAME, _ID, _PH, _X, _Y, _W, _H, _BLIP, _RECT, _PICTURED, _FILLED, _OLE, _PROGRAM, _CHART, _START, _END, _TABLED, _TEXT, _ROWS = range(4, len(_FIELDS))
#: Beyond the columns: a second kind of reference to an object, and what is said in paragraphs and in cells.
_EMBED, _WRITTEN, _CELLS, _IN_CELLS = range(len(_FIELDS), len(_FIELDS) + 4)
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?\s*|\s*[+-]?(nan|inf|infinity)\s*", re.ASCII | re.IGNORECASE)
EMU_PX = 9525
_FULL = {p: uri for uri, p in PREFIXES.items()}


def _full(name: str) -> str:
    """An element's or attribute's name as the tree has it."""
    prefix, _, local = name.rpartition(":")
    return f"{{{_FULL[prefix]}}}{local}"


#: What ``draw`` looks at, by how often it is there.
_LOOKED_AT = ("a:t", "a:p", "p:cNvPr", "a:off", "a:ext", "p:txBody", "a:blip", "p:blipFill", "a:srcRect", "p:ph", "a:tc", "a:tr", "a:tbl", "p:oleObj", "a:stCxn", "a:endCxn", "c:chart", "a:blipFill", "p:oleObjEmbed")
_T, _P, _NV, _OFF, _EXT, _BODY, _BLIP_OF, _PICTURE, _CROP, _HOLDER, _TC, _TR, _TBL, _OLE_OF, _STARTS, _ENDS, _CHART_OF, _FILL, _EMBED_OF = range(len(_LOOKED_AT))
_MARKS = {_full(t): i for i, t in enumerate(_LOOKED_AT)} | {_full(t): t for t in SHAPES}
_RID, _EMBEDDED, _LINKED = map(_full, ("r:id", "r:embed", "r:link"))


def _number(said: str | None) -> float | None:
    """What Spark's cast makes of a number; null of what is none."""
    if said is None or not _NUMBER.fullmatch(said):
        return None
    said = said.strip()
    return float(said if said[-1:] not in "dDfF" or said[-3:].lower() == "inf" else said[:-1])


def _pixels(said: str | None) -> float | None:
    if said and said.isascii() and said.isdecimal():
        return float(said) / EMU_PX
    number = _number(said)
    return None if number is None else number / EMU_PX


def draw(content: bytes, kinds: Container[str] = SHAPES) -> list[list]:
    """The objects of a part as rows of SHAPE_FIELDS, those of ``kinds``: each with what lies in it but not in another one.

    A container is left where the numbers of elements in document order pass its last one.
    """
    try:
        elements = list(ElementTree.fromstring(content).iter())
    except (ElementTree.ParseError, LookupError, ValueError):  # the latter two for encodings that are not known
        return []
    made: list[list] = []
    here, end, body_end, look = None, len(elements), 0, _MARKS.get
    around, groups, paras, rows, cells = [(end, None)], [], [], [], []
    for i, e, mark in [(i, e, m) for i, e in enumerate(elements) if (m := look(e.tag)) is not None]:
        while i >= end:
            around.pop()
            end, here = around[-1]
        if mark.__class__ is str:
            while groups and i >= groups[-1][0]:
                groups.pop()
            here, end = None, i + len(list(e.iter()))
            if mark in kinds:
                made.append(here := [i, mark, groups[0][1] if groups else None, groups[-1][1] if groups else None, *_NEW, [], [], []])
            around.append((end, here))
            if mark == "p:grpSp":
                groups.append((end, i))
        elif mark == _T:
            if here is not None:
                while cells and i >= cells[-1][0]:
                    cells.pop()
                said = (e.text or "") + "".join([x.tail or "" for x in e]) if len(e) else e.text or ""
                if cells:
                    here[_IN_CELLS].append((cells[-1][1], said))
                elif i < body_end:
                    while paras and i >= paras[-1][0]:
                        paras.pop()
                    here[_WRITTEN].append((paras[-1][1] if paras else None, said))
        elif mark in (_P, _TR, _TC):
            held = paras if mark == _P else rows if mark == _TR else cells
            while held and i >= held[-1][0]:
                held.pop()
            held.append((i + len(list(e.iter())), i))
            if mark == _TC and here is not None:
                while rows and i >= rows[-1][0]:
                    rows.pop()
                here[_CELLS].append((i, rows[-1][1] if rows else None))
        elif mark == _BODY:
            body_end = max(body_end, i + len(list(e.iter())))
        elif here is None:
            continue
        elif mark == _NV:
            if here[_NAME] is None:
                here[_NAME] = e.get("name")
            if here[_ID] is None:
                here[_ID] = e.get("id")
        elif mark in (_OFF, _EXT):
            a, b = (_X, _Y) if mark == _OFF else (_W, _H)
            if here[a] is None:
                here[a] = _pixels(e.get("x" if mark == _OFF else "cx"))
            if here[b] is None:
                here[b] = _pixels(e.get("y" if mark == _OFF else "cy"))
        elif mark == _BLIP_OF:
            if here[_BLIP] is None:
                here[_BLIP] = e.get(_EMBEDDED, e.get(_LINKED))
        elif mark == _CROP:
            if here[_RECT] is None:
                here[_RECT] = {k: (_number(e.get(k)) or 0.0) / 100_000 for k in "ltrb"}
        elif mark in _THERE:
            here[_THERE[mark]] = True
        elif mark == _HOLDER:
            if here[_PH] is None:
                here[_PH] = e.get("type", "obj")
        else:
            for at, attribute in _KEPT[mark]:
                if here[at] is None:
                    here[at] = e.get(attribute)
    for shape in made:
        _finish(shape)
    return made


_NEW = [False if kind == "boolean" else None for _, kind in _FIELDS[4:]] + [None]
_THERE = {_PICTURE: _PICTURED, _FILL: _FILLED, _TBL: _TABLED}
_KEPT = {_OLE_OF: ((_OLE, _RID), (_PROGRAM, "progId")), _EMBED_OF: ((_EMBED, _RID),), _CHART_OF: ((_CHART, _RID),), _STARTS: ((_START, "id"),), _ENDS: ((_END, "id"),)}


def _finish(shape: list) -> None:
    """Puts an object's texts together: paragraphs, and cells by rows."""
    if shape[_OLE] is None:
        shape[_OLE] = shape[_EMBED]
    paragraphs: dict[int | None, str] = {}
    for para, said in shape[_WRITTEN]:
        paragraphs[para] = paragraphs.get(para, "") + said
    shape[_TEXT] = " | ".join([bare for p in paragraphs.values() if (bare := p.strip(" "))]) if paragraphs else ""
    table: dict[int | None, list[str]] = {}
    if shape[_CELLS]:
        inside: dict[int, str] = {}
        for cell, said in shape[_IN_CELLS]:
            inside[cell] = inside.get(cell, "") + said
        for cell, row in shape[_CELLS]:
            in_row = table.setdefault(row, [])
            if row is not None:
                in_row.append(inside.get(cell, "").strip(" "))
    shape[_ROWS] = list(table.values())


def drawings(parts: DataFrame, *columns: str, kinds: tuple[str, ...] = SHAPES, holding: tuple[str, ...] = ()) -> DataFrame:
    """What ``operators.package.shapes`` makes of the nodes of ``parts(deck_id, part, content)``, places in the text aside, read in one pass without a shuffle.

    ``columns`` are those that are wanted, all without any; ``kinds`` the objects that are. With ``holding`` parts that have
    none of these elements, named without prefix, may be passed over.
    """
    columns = columns or tuple(_AT)
    types = dict(_FIELDS)
    schema = ", ".join(["deck_id string, part string", *(f"{c} {types[c]}" for c in columns)])
    known = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    arrow = [pa.string(), pa.string(), *(known.get(types[c], pa.struct([(k, pa.float64()) for k in "ltrb"])) for c in columns)]
    at = [_AT[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in arrow]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(held, arrow)], names=["deck_id", "part", *columns])

        for batch in batches:
            for deck, part, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shapes := draw(content or b"", kinds):
                    held[0].extend([deck] * len(shapes))
                    held[1].extend([part] * len(shapes))
                    for i, into in zip(at, held[2:]):
                        into.extend([s[i] for s in shapes])
                    if len(held[0]) >= BATCH_NODES:
                        yield out()
                        held = [[] for _ in arrow]
        if held[0]:
            yield out()

    xml = _xml(parts)
    return (xml.where(_holds(holding)) if holding else xml).mapInArrow(run, schema)
