"""Properties of packages as tables: relationships, styles, sections, runs, paragraphs, tables, comments, images.

Most are values of elements that belong to an owner (a run, a style, a section), gathered by one window over a part's
events and one grouping that keeps its partitioning.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.docx import parse_markup

TEXT = "text()"


def attribute(attrs: Column, key: str) -> Column:
    return F.try_element_at(F.transform(F.filter(attrs, lambda a: a["k"] == key), lambda a: a["v"]), F.lit(1))


def owned_values(evs: DataFrame, owner: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """(doc_id, part_name, event_index, columns): for every element whose path matches ``owner``, the first value of
    each (path below it, attribute); ``""`` is the owner itself, ``text()`` the texts there joined, ``*`` the number
    of such elements. What follows an owner nested in another counts for the nested one."""
    upto = Window.partitionBy("doc_id", "part_name").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin("start", "empty")
    mine = F.when(opens & F.col("path").rlike(owner), F.struct(F.col("event_index").alias("i"), F.col("path").alias("p")))
    rows = evs.withColumn("_o", F.last(mine, ignorenulls=True).over(upto)).where("_o is not null")
    rows = rows.where((F.col("path") == F.col("_o.p")) | F.startswith("path", F.concat(F.col("_o.p"), F.lit("/"))))
    rest = F.expr("substring(path, length(_o.p) + 1)")
    gathered = []
    for name, (below, key) in values.items():
        here = rest == below
        if key == TEXT:
            piece = F.when(here & (F.col("kind") == "text"), F.struct("event_index", "text"))
            gathered.append(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias(name))
        elif key == "*":
            gathered.append(F.count_if(opens & here).alias(name))
        else:
            found = F.when(opens & here, attribute(F.col("attrs"), key))
            gathered.append(F.min_by(found, F.when(found.isNotNull(), F.col("event_index"))).alias(name))
    return rows.groupBy("doc_id", "part_name", F.col("_o.i").alias("event_index")).agg(*gathered)


def tri_state(present: Column, value: Column) -> Column:
    """A toggle property: null where it is not given, else on unless its value says off."""
    return F.when(present > 0, ~F.lower(F.trim(F.coalesce(value, F.lit("1")))).isin("0", "false", "off", "none"))


def relationships(entries: DataFrame) -> DataFrame:
    """(doc_id, source, rid, type, target, external, part_name): relationships of all parts; ``source`` is the part
    they belong to (empty for the package), ``part_name`` where an internal target lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                folder, file = posixpath.split(name)
                source = posixpath.join(posixpath.dirname(folder), file[: -len(".rels")])
                for kind, tag, attrs, _, _ in parse_markup((data or b"").decode("utf-8", "replace")):
                    if kind in ("start", "empty") and tag.split(":")[-1] == "Relationship":
                        own = {a["k"]: a["v"] for a in attrs}
                        target, outside = own.get("Target", ""), own.get("TargetMode") == "External"
                        part = None if outside else posixpath.normpath(posixpath.join("/", posixpath.dirname(source), target)).lstrip("/")
                        rows.append((doc, source, own.get("Id"), own.get("Type", "").rsplit("/", 1)[-1], target, outside, part))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.string()] * 5 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "source", "rid", "type", "target", "external", "part_name"])

    files = entries.where(F.lower("name").endswith(".rels")).select("doc_id", "name", "data")
    return files.mapInArrow(run, "doc_id string, source string, rid string, type string, target string, external boolean, part_name string")


def reachable_parts(rels: DataFrame, rounds: int | None = None) -> DataFrame:
    """(doc_id, part_name): the parts that can be reached from the package over internal relationships, each once."""
    from textloom.session import cut_lineage

    edges = rels.where(~F.col("external")).select("doc_id", "source", "part_name").distinct()
    seen = cut_lineage(edges.where("source = ''").select("doc_id", "part_name").distinct())
    found = seen
    while rounds is None or rounds > 0:
        steps = edges.join(found.withColumnRenamed("part_name", "source"), ["doc_id", "source"]).select("doc_id", "part_name").distinct()
        found = cut_lineage(steps.join(seen, ["doc_id", "part_name"], "left_anti"))
        if found.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(found))
        rounds = None if rounds is None else rounds - 1
    return seen


def content_types(evs_of_types: DataFrame) -> DataFrame:
    """(doc_id, kind, key, content_type) of events of ``[Content_Types].xml``: ``default`` by extension and
    ``override`` by part name."""
    rows = evs_of_types.where(F.col("kind").isin("start", "empty") & F.col("name").isin("Default", "Override"))
    key = F.coalesce(attribute(F.col("attrs"), "Extension"), attribute(F.col("attrs"), "PartName"))
    return rows.select("doc_id", F.lower("name").alias("kind"), key.alias("key"), attribute(F.col("attrs"), "ContentType").alias("content_type"))


def section_references(evs: DataFrame) -> DataFrame:
    """(doc_id, section, story, rid) of the main part's sections, from 1: the default header and footer each names,
    null where it names none."""
    main = evs.where("part_name = 'word/document.xml'")
    opens = F.col("kind").isin("start", "empty")
    upto = Window.partitionBy("doc_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = main.withColumn("section", F.sum((opens & (F.col("name") == "w:sectPr")).cast("int")).over(upto)).where("section > 0")
    inside = rows.where(opens & F.col("path").rlike("/w:sectPr(?:/|$)"))
    default = attribute(F.col("attrs"), "w:type") == "default"
    rid = lambda tag: F.max(F.when((F.col("name") == tag) & default, attribute(F.col("attrs"), "r:id")))
    both = inside.groupBy("doc_id", "section").agg(rid("w:headerReference").alias("header"), rid("w:footerReference").alias("footer"))
    stories = F.explode(F.array(*[F.struct(F.lit(s).alias("story"), F.col(s).alias("rid")) for s in ("header", "footer")]))
    return both.select("doc_id", "section", stories.alias("s")).select("doc_id", "section", "s.story", "s.rid")


def styles(evs: DataFrame) -> DataFrame:
    """(doc_id, style_id, type, is_default, name, based_on, outline, next_style) of the package's styles."""
    rows = owned_values(
        evs.where("part_name = 'word/styles.xml'"),
        "^/w:styles/w:style$",
        {"style_id": ("", "w:styleId"), "type": ("", "w:type"), "dflt": ("", "w:default"), "name": ("/w:name", "w:val"), "based_on": ("/w:basedOn", "w:val"),
         "outline": ("/w:pPr/w:outlineLvl", "w:val"), "next_style": ("/w:next", "w:val")},
    )
    default = F.coalesce(F.col("dflt"), F.lit("0")).isin("1", "true", "on")
    return rows.select("doc_id", "style_id", "type", default.alias("is_default"), "name", "based_on", F.expr("try_cast(outline as int)").alias("outline"), "next_style")


def guessed_level(style_name: Column) -> Column:
    """A heading's level by its style's name: ``Heading 2`` or ``标题 2``; null for others."""
    number = F.regexp_extract(F.coalesce(style_name, F.lit("")), r"(?iU)^\s*(?:heading|标题)\s*(\d+)", 1)
    return F.when(number != "", number.cast("int"))


def section_formats(evs: DataFrame) -> DataFrame:
    """(doc_id, section, start_type, width, height, orientation, margins, different_first_page) of the main part's
    sections; lengths in twentieths of a point."""
    values = {"start_type": ("/w:type", "w:val"), "width": ("/w:pgSz", "w:w"), "height": ("/w:pgSz", "w:h"), "orientation": ("/w:pgSz", "w:orient"),
              "first": ("/w:titlePg", "*"), "first_value": ("/w:titlePg", "w:val"), **{f"{m}_margin": ("/w:pgMar", f"w:{m}") for m in ("left", "right", "top", "bottom", "gutter", "header", "footer")}}
    rows = owned_values(evs.where("part_name = 'word/document.xml'"), "/w:sectPr$", values)
    number = lambda c: F.expr(f"try_cast({c} as int)").alias(c)
    order = Window.partitionBy("doc_id").orderBy("event_index")
    return rows.select(
        "doc_id", F.row_number().over(order).alias("section"), F.coalesce("start_type", F.lit("nextPage")).alias("start_type"), number("width"), number("height"),
        F.coalesce("orientation", F.lit("portrait")).alias("orientation"), *[number(c) for c in values if c.endswith("_margin")],
        F.coalesce(tri_state(F.col("first"), F.col("first_value")), F.lit(False)).alias("different_first_page"),
    )


# Toggle properties of runs, column: element.
TOGGLES = {
    "all_caps": "caps", "bold": "b", "italic": "i", "complex_script": "cs", "cs_bold": "bCs", "cs_italic": "iCs", "double_strike": "dstrike", "emboss": "emboss",
    "hidden": "vanish", "imprint": "imprint", "math": "oMath", "no_proof": "noProof", "outline": "outline", "rtl": "rtl", "shadow": "shadow",
    "small_caps": "smallCaps", "snap_to_grid": "snapToGrid", "spec_vanish": "specVanish", "strike": "strike", "web_hidden": "webHidden",
}


def run_fonts(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, event_index, text, font columns) of all runs; null means inherited. ``size`` is in points."""
    values = {"text": ("/w:t", TEXT), "font": ("/w:rPr/w:rFonts", "w:ascii"), "half_points": ("/w:rPr/w:sz", "w:val"), "color": ("/w:rPr/w:color", "w:val"),
              "highlight": ("/w:rPr/w:highlight", "w:val"), "underline": ("/w:rPr/w:u", "w:val"), "vertical": ("/w:rPr/w:vertAlign", "w:val"), "style": ("/w:rPr/w:rStyle", "w:val")}
    for name, tag in TOGGLES.items():
        values |= {f"_{name}": (f"/w:rPr/w:{tag}", "*"), f"_{name}_value": (f"/w:rPr/w:{tag}", "w:val")}
    rows = owned_values(evs, "/w:r$", values)
    toggles = [tri_state(F.col(f"_{n}"), F.col(f"_{n}_value")).alias(n) for n in TOGGLES]
    size = (F.expr("try_cast(half_points as double)") / 2).alias("size")
    script = [F.when(F.col("vertical").isNotNull(), F.col("vertical") == v).alias(n) for n, v in (("superscript", "superscript"), ("subscript", "subscript"))]
    return rows.select("doc_id", "part_name", "event_index", "text", "style", "font", size, "color", "highlight", "underline", *script, *toggles)


def paragraph_formats(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, event_index, format columns) of all paragraphs; null means inherited. Lengths are in
    twentieths of a point; a hanging indent is a negative first line; tab stops are a count."""
    values = {"style": ("/w:pPr/w:pStyle", "w:val"), "alignment": ("/w:pPr/w:jc", "w:val"), "left_indent": ("/w:pPr/w:ind", "w:left"), "right_indent": ("/w:pPr/w:ind", "w:right"),
              "first": ("/w:pPr/w:ind", "w:firstLine"), "hanging": ("/w:pPr/w:ind", "w:hanging"), "space_before": ("/w:pPr/w:spacing", "w:before"), "space_after": ("/w:pPr/w:spacing", "w:after"),
              "line": ("/w:pPr/w:spacing", "w:line"), "line_rule": ("/w:pPr/w:spacing", "w:lineRule"), "tab_stops": ("/w:pPr/w:tabs/w:tab", "*")}
    toggles = {"keep_together": "keepLines", "keep_with_next": "keepNext", "page_break_before": "pageBreakBefore", "widow_control": "widowControl"}
    for name, tag in toggles.items():
        values |= {f"_{name}": (f"/w:pPr/w:{tag}", "*"), f"_{name}_value": (f"/w:pPr/w:{tag}", "w:val")}
    rows = owned_values(evs, "/w:p$", values)
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return rows.select(
        "doc_id", "part_name", "event_index", "style", "alignment", *[number(c).alias(c) for c in ("left_indent", "right_indent", "space_before", "space_after", "line")],
        F.coalesce(number("first"), -number("hanging")).alias("first_line_indent"), "line_rule", "tab_stops",
        *[tri_state(F.col(f"_{n}"), F.col(f"_{n}_value")).alias(n) for n in toggles],
    )


def hyperlinks(evs: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, part_name, event_index, address, fragment, url, text) of hyperlinks, the address by relationship."""
    rows = owned_values(evs, "/w:hyperlink$", {"rid": ("", "r:id"), "fragment": ("", "w:anchor"), "text": ("/w:r/w:t", TEXT)})
    targets = rels.select("doc_id", F.col("source").alias("part_name"), "rid", F.col("target").alias("address"))
    joined = rows.join(targets, ["doc_id", "part_name", "rid"], "left")
    url = F.when(F.col("address").isNotNull(), F.concat("address", F.coalesce(F.concat(F.lit("#"), "fragment"), F.lit(""))))
    return joined.select("doc_id", "part_name", "event_index", "address", "fragment", url.alias("url"), "text")


def core_properties(evs: DataFrame) -> DataFrame:
    """(doc_id, property, value) of ``docProps/core.xml``, texts of its elements by local name."""
    rows = evs.where((F.col("part_name") == "docProps/core.xml") & (F.col("kind") == "text") & F.col("path").rlike("^/[^/]+/[^/]+$"))
    return rows.groupBy("doc_id", F.regexp_extract("path", "([^/:]+)$", 1).alias("property")).agg(F.max("text").alias("value"))


def comments(evs: DataFrame) -> DataFrame:
    """(doc_id, comment_id, author, initials, written_at, text) of ``word/comments.xml``."""
    values = {"comment_id": ("", "w:id"), "author": ("", "w:author"), "initials": ("", "w:initials"), "date": ("", "w:date"), "text": ("/w:p/w:r/w:t", TEXT)}
    rows = owned_values(evs.where("part_name = 'word/comments.xml'"), "^/w:comments/w:comment$", values)
    return rows.select("doc_id", F.col("comment_id").cast("int").alias("comment_id"), "author", "initials", F.try_to_timestamp("date").alias("written_at"), "text")


def table_cells(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, table_event, row_index, cell_index, grid_span, merge, text) of the cells of body tables, rows
    and cells from 0 in order; ``merge`` is restart, continue or null."""
    opens = F.col("kind").isin("start", "empty")
    table, row, cell = "/w:document/w:body/w:tbl", "/w:document/w:body/w:tbl/w:tr", "/w:document/w:body/w:tbl/w:tr/w:tc"
    upto = Window.partitionBy("doc_id", "part_name").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda path: F.last(F.when(opens & (F.col("path") == path), F.col("event_index")), ignorenulls=True).over(upto)
    rows = evs.withColumns({"table_event": last(table), "row_event": last(row), "cell_event": last(cell)}).where(F.col("path").startswith(cell))
    value = lambda path, key: F.max(F.when(opens & (F.col("path") == cell + path), F.coalesce(attribute(F.col("attrs"), key), F.lit("continue"))))
    piece = F.when((F.col("kind") == "text") & F.col("path").endswith("/w:t"), F.struct("event_index", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "")
    cells = rows.groupBy("doc_id", "part_name", "table_event", "row_event", "cell_event").agg(
        F.coalesce(value("/w:tcPr/w:gridSpan", "w:val"), F.lit("1")).alias("span"),
        value("/w:tcPr/w:vMerge", "w:val").alias("merge"),
        text.alias("text"),
    )
    by_table, by_row = Window.partitionBy("doc_id", "part_name", "table_event"), Window.partitionBy("doc_id", "part_name", "table_event", "row_event")
    return cells.select(
        "doc_id", "part_name", "table_event", (F.dense_rank().over(by_table.orderBy("row_event")) - 1).alias("row_index"),
        (F.row_number().over(by_row.orderBy("cell_event")) - 1).alias("cell_index"), F.expr("coalesce(try_cast(span as int), 1)").alias("grid_span"), "merge", "text",
    )


def grid_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, part_name, table_event, row_index, column_index, text): every place of the grid, so a cell once for each
    column it spans, and where a cell goes on from above, the text of the cell that it continues."""
    keys = ["doc_id", "part_name", "table_event"]
    before = Window.partitionBy(*keys, "row_index").orderBy("cell_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_first", F.coalesce(F.sum("grid_span").over(before), F.lit(0)))
    spread = placed.select(*keys, "row_index", F.explode(F.sequence(F.col("_first").cast("int"), (F.col("_first") + F.col("grid_span") - 1).cast("int"))).alias("column_index"), "merge", "text")
    down = Window.partitionBy(*keys, "column_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("merge").isNull() | (F.col("merge") != "continue"), F.struct("text")), ignorenulls=True).over(down)
    return spread.withColumn("_a", above).select(*keys, "row_index", "column_index", F.coalesce("_a.text", "text").alias("text"))


def page_break_fragments(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, event_index, fragment, text): paragraphs cut at the page breaks last rendered in them;
    fragments count from 0."""
    upto = Window.partitionBy("doc_id", "part_name").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin("start", "empty")
    rows = evs.withColumns(
        {
            "_p": F.last(F.when(opens & F.col("path").endswith("/w:p"), F.col("event_index")), ignorenulls=True).over(upto),
            "_b": F.sum((opens & (F.col("name") == "w:lastRenderedPageBreak")).cast("int")).over(upto),
        }
    ).where((F.col("kind") == "text") & F.col("path").endswith("/w:t") & F.col("_p").isNotNull())
    first = Window.partitionBy("doc_id", "part_name", "_p")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "text"))), lambda x: x["text"]), "")
    cut = rows.withColumn("fragment", F.col("_b") - F.min("_b").over(first))
    return cut.groupBy("doc_id", "part_name", F.col("_p").alias("event_index"), F.col("fragment").cast("int").alias("fragment")).agg(text.alias("text"))


def inline_shapes(evs: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, part_name, event_index, width, height, picture) of inline drawings; sizes in EMU, ``picture`` the part
    of the image, if it is one."""
    values = {"cx": ("/wp:extent", "cx"), "cy": ("/wp:extent", "cy"), "rid": ("/a:graphic/a:graphicData/pic:pic/pic:blipFill/a:blip", "r:embed")}
    rows = owned_values(evs, "/wp:inline$", values)
    parts = rels.select("doc_id", F.col("source").alias("part_name"), "rid", F.col("part_name").alias("picture"))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return rows.join(parts, ["doc_id", "part_name", "rid"], "left").select("doc_id", "part_name", "event_index", number("cx").alias("width"), number("cy").alias("height"), "picture")


# English Metric Units of one unit of length.
EMU = {"emu": 1, "twip": 635, "pt": 12700, "mm": 36000, "cm": 360000, "inch": 914400}


def emu(length: Column, unit: str) -> Column:
    """A length as whole EMU, cut towards zero."""
    return (length * EMU[unit]).cast("bigint")


def length_in(length_emu: Column, unit: str) -> Column:
    return length_emu / F.lit(float(EMU[unit]))


def rgb_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (red, green, blue)])


# Names of choices and how markup writes them.
CHOICES = {
    "alignment": {"left": "left", "center": "center", "right": "right", "both": "justify", "distribute": "distribute", "start": "left", "end": "right"},
    "section": {"continuous": "continuous", "nextColumn": "new_column", "nextPage": "new_page", "evenPage": "even_page", "oddPage": "odd_page"},
    "line_rule": {"auto": "multiple", "exact": "exactly", "atLeast": "at_least"},
}


def choice(kind: str, value: Column) -> Column:
    """The name of a choice by its value in markup; null for values that are none."""
    table = F.create_map(*[F.lit(x) for pair in CHOICES[kind].items() for x in pair])
    return F.try_element_at(table, value)


# --- images ------------------------------------------------------------------------------------------------------


def image_header(data: bytes) -> tuple[str, int, int, int, int] | None:
    """(format, width, height, horizontal and vertical dots per inch) by an image's first bytes; None if it is none
    of PNG, JPEG, GIF, BMP and TIFF. 72 dots per inch where the image does not say (96 for BMP)."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:3] == b"\xff\xd8\xff":
            return _jpeg(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]), 72, 72)
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            per_metre = struct.unpack("<ii", data[38:46])
            return ("bmp", width, abs(height), *(round(p * 0.0254) if p else 96 for p in per_metre))
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
    except (struct.error, IndexError):
        pass
    return None


def _png(data: bytes) -> tuple[str, int, int, int, int] | None:
    size, dpi, at = None, (72, 72), 8
    while at + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            size = struct.unpack(">II", data[at + 8 : at + 16])
        elif kind == b"pHYs":
            x, y, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
            dpi = (round(x * 0.0254), round(y * 0.0254)) if unit == 1 and x and y else dpi
        elif kind == b"IDAT":
            break
        at += 12 + length
    return ("png", *size, *dpi) if size else None


def _jpeg(data: bytes) -> tuple[str, int, int, int, int] | None:
    dpi, at = (72, 72), 2
    while at + 4 <= len(data):
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        if marker == 0xE0 and body[:5] == b"JFIF\0":
            unit, x, y = struct.unpack(">BHH", body[7:12])
            dpi = (x, y) if unit == 1 else (round(x * 2.54), round(y * 2.54)) if unit == 2 else dpi
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            inner = _tiff(body[6:])
            dpi = inner[3:] if inner else dpi
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return ("jpeg", width, height, *dpi)
        elif marker == 0xDA:
            break
        at += 2 + length
    return None


def _tiff(data: bytes) -> tuple[str, int, int, int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    start = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, float] = {}
    for k in range(struct.unpack(order + "H", data[start : start + 2])[0]):
        at = start + 2 + 12 * k
        tag, kind, _ = struct.unpack(order + "HHI", data[at : at + 8])
        if kind == 3:
            tags[tag] = struct.unpack(order + "H", data[at + 8 : at + 10])[0]
        elif kind == 4:
            tags[tag] = struct.unpack(order + "I", data[at + 8 : at + 12])[0]
        elif kind == 5:
            place = struct.unpack(order + "I", data[at + 8 : at + 12])[0]
            above, below = struct.unpack(order + "II", data[place : place + 8])
            tags[tag] = above / below if below else 0
    scale = {2: 1.0, 3: 2.54}.get(int(tags.get(296, 2)), 0.0)
    dots = [round(tags[t] * scale) if tags.get(t) and scale else 72 for t in (282, 283)]
    return ("tiff", int(tags.get(256, 0)), int(tags.get(257, 0)), *dots)


def images(entries: DataFrame) -> DataFrame:
    """(doc_id, name, format, width, height, dpi_x, dpi_y, sha1) of the entries that are images by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [image_header(d or b"") or (None,) * 5 for d in batch.column(2).to_pylist()]
            columns = list(zip(*heads)) or [()] * 5
            types = [pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types)), batch.column(3)], names=_IMAGE)

    own = entries.where(~F.col("is_dir")).select("doc_id", "name", "data", F.sha1("data").alias("sha1"))
    return own.mapInArrow(run, "doc_id string, name string, format string, width int, height int, dpi_x int, dpi_y int, sha1 string").where("format is not null")


_IMAGE = ["doc_id", "name", "format", "width", "height", "dpi_x", "dpi_y", "sha1"]
