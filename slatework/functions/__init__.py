"""Column functions: names of files and blocks, positions and captions, titles, markup, LaTeX, page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a position says where no role is known, and characters that titles of symbols alone are made of.
DEFAULT_ROLE = "辅助理解本页知识点"
SYMBOLS_ONLY = r"^[\\$\[\]{}]+$"
WHITE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, WHITE, "")


def extension(name: Column) -> Column:
    """A file's extension in lower case, without the dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def page_of(name: Column) -> Column:
    """The page of a name that begins with slide_NN_; null for others."""
    return F.nullif(F.regexp_extract(name, r"^slide_(\d+)_", 1), F.lit("")).try_cast("int")


def block_of(name: Column) -> tuple[Column, Column]:
    """Page and block of a name that holds slide_NN_blk_NN anywhere; null for others."""
    found = lambda group: F.nullif(F.regexp_extract(name, r"slide_(\d+)_(blk_\d+)", group), F.lit(""))
    return found(1).try_cast("int"), found(2)


def position(page: Column, paragraph: Column, role: Column) -> Column:
    """The sentence that says where a picture stands and what for; a paragraph of 0 is none."""
    said = F.regexp_replace(strip(F.coalesce(role, F.lit(""))), "[。；，]+$", "")
    said = F.when(said == "", DEFAULT_ROLE).otherwise(said)
    where = F.when(paragraph > 0, F.concat(F.lit("位于第 "), page.cast("string"), F.lit(" 页（第 "), paragraph.cast("string"), F.lit(" 段）"))).otherwise(F.concat(F.lit("位于第 "), page.cast("string"), F.lit(" 页")))
    return F.concat(where, F.lit("，该图对该页文字表达起『"), said, F.lit("』的作用"))


def caption_start(caption: Column, n: int = 50) -> Column:
    """The first ``n`` characters without marks and spaces at the end: what a picture says where no relation is known."""
    return F.regexp_replace(F.left(caption, F.lit(n)), "[；，。 ]+$", "")


def file_kind(form: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(form), F.lit("")), F.lit("unknown"))


def clean_title(title: Column, most: int = 30) -> Column:
    """White space made single, cut to ``most`` characters with a mark."""
    clean = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most)), F.lit("…"))).otherwise(clean)


def page_heading(text: Column, page: Column, title: Column) -> Column:
    """A page's heading: its own title; else the first line of 2 to 22 characters; else the start of the first line; else its number.

    Lines of symbols alone don't count.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(SYMBOLS_ONLY))
    short = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^#+|#+$", ""))), lambda x: F.length(x).between(2, 22) & ~x.rlike(SYMBOLS_ONLY))
    first = F.try_element_at(lines, F.lit(1))
    start = F.when(F.length(first) > 16, F.concat(F.left(first, F.lit(16)), F.lit("…"))).otherwise(first)
    number = F.concat(F.lit("第 "), page.cast("string"), F.lit(" 节"))
    return F.coalesce(F.nullif(clean_title(title), F.lit("")), clean_title(F.try_element_at(short, F.lit(1))), start, number)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline_html(text: Column) -> Column:
    """A line of Markdown as HTML: escaped, with strong, em and code; formulas between dollar signs stay as they are.

    Formulas are cut out, a mark takes their places while the rest is marked up, and they come back in order.
    """
    mark = "\ue000"
    formula = r"(?s)\$\$.*?\$\$|(?<!\$)\$[^$\n]+?\$(?!\$)"
    rest = escape(F.array_join(F.split(F.replace(text, F.lit(mark), F.lit("")), formula), mark))
    for pattern, to in ((r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"(?<!\*)\*([^*\n]+?)\*(?!\*)", "<em>$1</em>"), (r"`([^`\n]+?)`", "<code>$1</code>")):
        rest = F.regexp_replace(rest, pattern, to)
    found = F.concat(F.regexp_extract_all(text, F.lit(formula), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(rest, mark), found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def half_split(text: Column, mark: str = "。") -> Column:
    """A text in two parts, after the last ``mark`` in its first half, or the first one beyond; whole if it has none."""
    middle = F.floor(F.length(text) / 2).cast("int")
    before = F.length(text) - F.length(F.substring_index(F.left(text, middle), mark, -1)) - (F.length(text) - middle)
    after = F.call_function("locate", F.lit(mark), text, middle + 1)
    cut = F.when(F.left(text, middle).contains(mark), before).when(after > 0, after).otherwise(F.length(text))
    return F.filter(F.array(F.left(text, cut), F.substring(text, cut + 1, F.length(text))), lambda part: part != "")


def data_url(content: Column, form: Column) -> Column:
    """An image as a URL of its own; jpg is jpeg. Spark breaks base64 into lines, which a URL has none of."""
    return F.concat(F.lit("data:image/"), F.when(F.lower(form) == "jpg", "jpeg").otherwise(F.lower(form)), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def latex_block(latex: Column, display: Column) -> Column:
    """LaTeX between its marks: a block of its own, or within a line."""
    bare = F.regexp_replace(F.trim(latex), r"^\$+|\$+$", "")
    return F.when(display, F.concat(F.lit("$$\n"), bare, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), bare, F.lit("$")))


def page_list(ranges: Column) -> Column:
    """The pages of a list such as 1-5,8: sorted, each once; parts that say no page are left out."""
    parts = F.filter(F.transform(F.split(ranges, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+(\s*-\s*\d+)?$"))
    ends = lambda x: (F.regexp_extract(x, r"^(\d+)", 1).cast("int"), F.regexp_extract(x, r"(\d+)$", 1).cast("int"))
    pages = F.transform(parts, lambda x: F.when(ends(x)[0] <= ends(x)[1], F.sequence(*ends(x))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def json_in_prose(text: Column) -> Column:
    """The text from the first brace to the last as JSON; null where there is none or it isn't one value."""
    listed = F.try_parse_json(F.concat(F.lit("["), F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("]")))  # the parser would stop after the first
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def xml_summary(xml: Column, most_tags: int = 12, most_texts: int = 60, most_chars: int = 800) -> Column:
    """What a long piece of slide XML holds: its most frequent tags, its texts and how many formulas.

    Equally frequent tags come in the order in which they first stand there.
    """
    tags = F.regexp_extract_all(xml, F.lit(r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)"), F.lit(1))
    counted = F.transform(F.array_distinct(tags), lambda t: F.struct((-F.size(F.filter(tags, lambda x: x == t))).alias("n"), F.array_position(tags, t).alias("at"), t.alias("tag")))
    shown = F.transform(F.slice(F.array_sort(counted), 1, most_tags), lambda t: F.concat(t["tag"], F.lit("×"), (-t["n"]).cast("string")))
    plain = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    texts = F.transform(F.regexp_extract_all(xml, F.lit(r"<a:t(?:\s[^>]*)?>([^<]+)</a:t>"), F.lit(1)), lambda t: strip(plain(t)))
    said = F.left(F.array_join(F.slice(F.filter(texts, lambda t: t != ""), 1, most_texts), " | "), F.lit(most_chars))
    formulas = F.regexp_count(xml, F.lit(r"<m:oMath[\s/>]")).cast("string")
    return F.concat(F.lit("【组合结构】"), F.array_join(shown, "、"), F.lit("\n【组内文字】"), F.when(said == "", "（无文字节点）").otherwise(said), F.lit("\n【公式对象】"), formulas, F.lit(" 个"))


def description(reply: Column) -> Column:
    """A model's reply as JSON: its object, or one that has the reply's start as its description."""
    plain = F.to_json(F.struct(F.left(F.trim(F.coalesce(reply, F.lit(""))), F.lit(500)).alias("semantic_description")))
    return F.coalesce(json_in_prose(reply), F.parse_json(plain))


#: What is said of a picture in which nothing was found, and the namespaces that a formula's markup needs by itself.
NO_DETECTION = "未检出明显目标（可能为框图/电路图/波形图等教学图形）"
FORMULA_SPACES = {
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
}


def marked(text: Column) -> Column:
    """Escaped, with what stands between double stars as strong."""
    return F.regexp_replace(escape(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def page_body(text: Column) -> Column:
    """A page's text as one line of HTML."""
    return marked(strip(F.regexp_replace(text, r"\s+", " ")))


def snippet(text: Column, n: int = 260) -> Column:
    """The first ``n`` characters of a page's text as HTML, with a mark if there is more."""
    line = strip(F.regexp_replace(text, r"\s+", " "))
    return marked(F.concat(F.left(line, F.lit(n)), F.when(F.length(line) > n, "…").otherwise("")))


def figure(content: Column, form: Column, file: Column, caption: Column, most: int = 120) -> Column:
    """A picture with its caption as HTML; empty without a picture."""
    said = inline_html(F.left(strip(F.regexp_replace(F.coalesce(caption, F.lit("")), r"\s+", " ")), F.lit(most)))
    shown = F.concat(F.lit('<figure class="fig"><img src="'), data_url(content, form), F.lit('" alt="'), file, F.lit('"><figcaption>'), said, F.lit("</figcaption></figure>"))
    return F.when(F.octet_length(content) > 0, shown).otherwise("")


def whole_formula(xml: Column) -> Column:
    """A formula's markup in a document of its own, with the namespaces that it uses."""
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in FORMULA_SPACES.items())
    return F.concat(F.lit(f"<m:oMathPara{spaces}>"), xml, F.lit("</m:oMathPara>"))
