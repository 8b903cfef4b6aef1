"""Queries of the package operators over packages with headings, lists, tables, links, sections, styles and headers,
written from the paragraph memory, one for each file.

Of the n-th record of a file with text: every fifth stands in a table cell, every seventh has its second run in a
link, every third is split into runs of like formatting, every fourth is a list item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import token
from textloom.operators import runs, structure, tree, units
from textloom.plans.markup_queries import _escaped
from textloom.plans.text_queries import _WS, records
from textloom.session import table
from textloom.sources import artifacts, docx, properties

Query = Callable[[SparkSession, str], DataFrame]

_STYLES = [
    ("Heading1", None, 0), ("Heading2", "Heading1", 1), ("Base", None, None), ("SubHeading", "Heading2", None), ("Deep", "SubHeading", None),
    ("LoopA", "LoopB", None), ("LoopB", "LoopA", None), ("Plain", "Base", None),
]


def _style_xml() -> str:
    def one(name: str, base: str | None, level: int | None) -> str:
        based = f'<w:basedOn w:val="{base}"/>' if base else ""
        outline = f'<w:pPr><w:outlineLvl w:val="{level}"/></w:pPr>' if level is not None else ""
        return f'<w:style w:type="paragraph" w:styleId="{name}"><w:name w:val="{name}"/>{based}{outline}</w:style>'

    return "<w:styles>" + "".join(one(*s) for s in _STYLES) + "</w:styles>"


_FIXED = {
    "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/main"/></Types>',
    "_rels/.rels": '<Relationships><Relationship Id="rId1" Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId1" Type="http://x/header" Target="header1.xml"/><Relationship Id="rId2" Type="http://x/hyperlink" '
    'Target="https://example.org/" TargetMode="External"/><Relationship Id="rId3" Type="http://x/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": _style_xml(),
}


def numbered_records(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "project_key", "tu_id", "para_style", "source_surface").where("source_surface is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("tu_id", "rec_id")))


def packages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, content)."""
    rows = numbered_records(spark, d)
    half = (F.length("source_surface") / 2).cast("int")
    kept = lambda text: F.replace(F.replace(_escaped(text), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))
    run = lambda text, style: F.concat(F.lit(f'<w:r><w:rPr>{style}</w:rPr><w:t xml:space="preserve">'), kept(text), F.lit("</w:t></w:r>"))
    first, rest = F.left("source_surface", half), F.substring(F.col("source_surface"), half + 1, F.length("source_surface"))
    bold, italic = "<w:b></w:b><w:sz w:val=\"24\"></w:sz>", "<w:i></w:i>"
    second = F.when(F.col("n") % 3 == 0, run(rest, bold)).otherwise(run(rest, italic))
    second = F.when(F.col("n") % 7 == 0, F.concat(F.lit('<w:hyperlink r:id="rId2">'), second, F.lit("</w:hyperlink>"))).otherwise(second)
    style = F.coalesce(F.concat(F.lit('<w:pStyle w:val="'), "para_style", F.lit('"/>')), F.lit(""))
    item = F.when(F.col("n") % 4 == 0, F.concat(F.lit('<w:numPr><w:ilvl w:val="'), F.col("n") % 3, F.lit('"/><w:numId w:val="1"/></w:numPr>'))).otherwise("")
    para = F.concat(F.lit("<w:p><w:pPr>"), style, item, F.lit("</w:pPr>"), run(first, bold), second, F.lit("</w:p>"))
    cell = F.concat(F.lit('<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'), para, F.lit("</w:tc><w:tc><w:p><w:r><w:t>.</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    block = F.when(F.col("n") % 5 == 0, cell).otherwise(para)
    ordered = F.array_sort(F.collect_list(F.struct("n", block.alias("x"))))
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><w:document><w:body>'), F.array_join(F.transform(ordered, lambda p: p["x"]), ""),
        F.lit('<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:pPr></w:p>'),
        F.lit('<w:sectPr><w:headerReference w:type="first" r:id="rId9"/><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:titlePg/></w:sectPr></w:body></w:document>'),
    )
    header = F.concat(F.lit("<w:hdr><w:p><w:r><w:t>"), _escaped(F.max("project_key")), F.lit("</w:t></w:r></w:p></w:hdr>"))
    core = F.concat(F.lit("<cp:coreProperties><dc:title>"), _escaped(F.max("project_key")), F.lit("</dc:title><cp:revision>"), F.count("*"), F.lit("</cp:revision></cp:coreProperties>"))
    files = rows.groupBy("file_id").agg(body.alias("body"), header.alias("header"), core.alias("core"))
    parts = [(k, F.lit(v)) for k, v in _FIXED.items()] + [("word/document.xml", F.col("body")), ("word/header1.xml", F.col("header")), ("docProps/core.xml", F.col("core")), ("word/media/x.bin", F.lit("no markup <"))]
    number = lambda n: F.lit(n).cast("int")
    stamp = {"compression": 8, "year": 2024, "month": 5, "day": 6, "hour": 7, "minute": 8, "second": 10, "unix_mode": 0o644}
    entry = lambda i, name, text: F.struct(number(i).alias("entry_idx"), F.lit(name).alias("name"), F.encode(text, "UTF-8").alias("data"), *[number(v).alias(k) for k, v in stamp.items()], F.lit(False).alias("is_dir"))
    entries = files.select(F.col("file_id").cast("string").alias("doc_id"), F.explode(F.array(*[entry(i, n, t) for i, (n, t) in enumerate(parts)])).alias("e"))
    return docx.pack(entries.select("doc_id", "e.*"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return docx.unpack(packages(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return docx.events(_entries(spark, d))


def q_pkg_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.paragraphs(_events(spark, d))
    return rows.select("doc_id", "para_id", "part_name", "container", "table_index", "row_index", "cell_index", "p_style", "num_id", "num_ilvl", F.md5("text").alias("text"))


def q_pkg_merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs before and after merging those alike, and the text after."""
    evs = _events(spark, d).where("part_name = 'word/document.xml'")
    count = lambda e: e.groupBy("doc_id").agg(F.count_if((F.col("kind") == "start") & (F.col("name") == "w:r")).alias("runs"), F.sum(F.when(F.col("kind") == "text", F.length("text"))).alias("chars"))
    after = count(runs.merged_runs(evs)).select("doc_id", F.col("runs").alias("merged"), F.col("chars").alias("merged_chars"))
    return count(evs).join(after, "doc_id")


def q_pkg_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs left when links and list numbers are dropped with all they hold."""
    rows = structure.paragraphs(structure.filtered_events(_events(spark, d), ["w:hyperlink", "w:numPr"], ["w:styleId"]))
    return rows.where("part_name = 'word/document.xml'").groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.count("num_id").alias("items")
    )


def q_pkg_filtered_properties(spark: SparkSession, d: str) -> DataFrame:
    """Elements left when sizes and bold are dropped as run properties, and styles' own values stay."""
    rows = structure.filtered_events(_events(spark, d), [], [], drop_run_properties=("w:sz", "w:b"))
    return rows.where(F.col("kind").isin("start", "empty") & F.col("name").isin("w:sz", "w:b", "w:i", "w:rPr")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def q_pkg_contexts(spark: SparkSession, d: str) -> DataFrame:
    evs = _events(spark, d)
    known = properties.styles(evs)
    rows = tree.paragraph_contexts(structure.paragraphs(evs).where("part_name = 'word/document.xml'"), known)
    return rows.groupBy("doc_id", "p_style", "outline", "heading", "in_table").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("hint").contains("In table: yes")).alias("hinted"))


def q_pkg_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical hashes of parts before and after masking: texts of text elements do not count."""
    own = packages(spark, d)
    other = artifacts.merged_packages(artifacts.masked_packages(own).withColumn("slot_texts", F.transform("slot_texts", lambda t: F.concat(t, F.lit("x")))))
    a = artifacts.canonical_hashes(docx.unpack(own))
    b = artifacts.canonical_hashes(docx.unpack(other.select("doc_id", "content"))).withColumnRenamed("hash", "other")
    return a.join(b, ["doc_id", "part_name"]).select("doc_id", "part_name", (F.col("hash") == F.col("other")).alias("same"))


def q_pkg_section_stories(spark: SparkSession, d: str) -> DataFrame:
    rels = properties.relationships(_entries(spark, d)).where("source = 'word/document.xml'").select("doc_id", "rid", "part_name")
    return tree.section_stories(properties.section_references(_events(spark, d)), rels)


def q_pkg_section_formats(spark: SparkSession, d: str) -> DataFrame:
    return properties.section_formats(_events(spark, d)).select("doc_id", "section", "start_type", "width", "height", "orientation", "different_first_page")


def q_pkg_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = properties.styles(_events(spark, d))
    outlines = tree.inherited_outline(rows, depth=len(_STYLES))
    return rows.select("doc_id", "style_id", "based_on", properties.guessed_level(F.col("name")).alias("guessed")).join(outlines, ["doc_id", "style_id"])


def q_pkg_relationships(spark: SparkSession, d: str) -> DataFrame:
    return properties.relationships(_entries(spark, d))


def q_pkg_reachable(spark: SparkSession, d: str) -> DataFrame:
    return properties.reachable_parts(properties.relationships(_entries(spark, d)))


def q_pkg_hyperlinks(spark: SparkSession, d: str) -> DataFrame:
    rows = properties.hyperlinks(_events(spark, d), properties.relationships(_entries(spark, d)))
    return rows.groupBy("doc_id", "url").agg(F.count("*").alias("links"), F.sum(F.length("text")).alias("chars"))


def q_pkg_fonts(spark: SparkSession, d: str) -> DataFrame:
    rows = properties.run_fonts(_events(spark, d)).where("part_name = 'word/document.xml'")
    return rows.groupBy("doc_id", "bold", "italic", "size", "all_caps").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))


def q_pkg_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = properties.paragraph_formats(_events(spark, d))
    return rows.groupBy("doc_id", "part_name", "style").agg(F.count("*").alias("paragraphs"), F.count("alignment").alias("aligned"), F.sum("tab_stops").alias("tab_stops"))


def q_pkg_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the tables' grids: cells that span two columns count twice."""
    rows = properties.grid_cells(properties.table_cells(_events(spark, d)))
    return rows.groupBy("doc_id", "column_index").agg(F.count("*").alias("places"), F.sum(F.length("text")).alias("chars"))


def q_pkg_core_properties(spark: SparkSession, d: str) -> DataFrame:
    return properties.core_properties(_events(spark, d))


def q_pkg_content_types(spark: SparkSession, d: str) -> DataFrame:
    return properties.content_types(_events(spark, d).where("part_name = '[Content_Types].xml'"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.paragraphs(_events(spark, d))
    level = F.when(F.lower("p_style").startswith("heading"), F.expr("try_cast(regexp_extract(p_style, '[0-9]+', 0) as int)"))
    place = F.concat_ws("/", "container", F.col("table_index").cast("string"), F.col("row_index").cast("string"), F.col("cell_index").cast("string"))
    return tree.structure_tree(rows.withColumns({"heading": level, "place": place}))


def q_pkg_tree(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).groupBy("doc_id", "part_name", "kind").agg(F.count("*").alias("nodes"), F.count("para_id").alias("paragraphs"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    evs = _events(spark, d)
    return units.paragraph_slots(evs, structure.paragraphs(evs), docx.slots(evs))


def q_pkg_para_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d).where("part_name = 'word/document.xml'")
    plain = F.regexp_replace("source_surface", "<<MT_SLOT:[0-9]{6}>>", "")
    return rows.select("doc_id", "para_id", F.size("slot_ids").alias("slots"), F.md5(plain).alias("text"), F.col("source_surface").endswith("<<MT_SLOT:000000>>").alias("ended"))


def q_pkg_slot_texts(spark: SparkSession, d: str) -> DataFrame:
    """Slots written with a translation that has its vowels in capitals."""
    rows = _units(spark, d).where("part_name = 'word/document.xml'")
    rows = rows.withColumns({"t": F.translate("source_surface", "aeiou", "AEIOU"), "m": F.create_map().cast("map<string,string>"), "k": F.lit(10**9)})
    got = units.slot_texts(rows, "t", "m", "k")
    return got.select("doc_id", "para_id", F.md5(F.array_join(F.transform("texts", lambda x: x["text"]), "")).alias("text"), "error")


def q_pkg_units(spark: SparkSession, d: str) -> DataFrame:
    rows = units.translation_units(_events(spark, d)).where("part_name = 'word/document.xml' and source_surface <> '.'")
    return rows.select("doc_id", F.regexp_extract("scope_key", "#(w:p)@", 1).alias("scope"), "para_style", F.md5("source_surface").alias("text"), F.size("spans").alias("spans"))


def q_pkg_projected(spark: SparkSession, d: str) -> DataFrame:
    """Units translated by themselves and shared out over their spans: whatever the cuts, the pieces are the text."""
    rows = units.translation_units(_events(spark, d)).where("part_name = 'word/document.xml' and source_surface <> '.'")
    rows = rows.withColumns({"t": F.translate("source_surface", "aeiou", "AEIOU"), "m": F.create_map().cast("map<string,string>")})
    got = units.projected_spans(rows, "source_surface", "t", "m")
    return got.select("doc_id", "tu_id", F.size("span_texts").alias("pieces"), F.md5(F.array_join("span_texts", "")).alias("text"), "error")


def q_pkg_mask_merge(spark: SparkSession, d: str) -> DataFrame:
    """Packages masked and merged with their own texts, and with other texts: the first differ in nothing."""
    own = packages(spark, d)
    masks = artifacts.masked_packages(own)
    again = artifacts.merged_packages(masks).select("doc_id", F.col("content").alias("again"), F.col("error").alias("again_error"))
    other = artifacts.merged_packages(masks.withColumn("slot_texts", F.transform("slot_texts", lambda t: F.upper(F.concat(t, F.lit("x"))))))
    both = own.join(again, "doc_id").join(other.select("doc_id", F.col("content").alias("other")), "doc_id")
    same = artifacts.package_differences(both, "content", "again").withColumnRenamed("difference", "same")
    changed = artifacts.package_differences(both, "content", "other").withColumnRenamed("difference", "changed")
    return masks.select("doc_id", F.size("slot_texts").alias("slots"), "error").join(same, "doc_id").join(changed, "doc_id")


def q_pkg_mask_errors(spark: SparkSession, d: str) -> DataFrame:
    """What merging says of a text too few, another prefix, damaged blobs and placeholders left."""
    masks = artifacts.masked_packages(packages(spark, d))
    cases = {
        "texts": ("prefix", F.slice("slot_texts", 1, F.size("slot_texts") - 1), F.col("blobs")), "prefix": ("bad", F.col("slot_texts"), F.col("blobs")),
        "blobs": ("prefix", F.col("slot_texts"), F.encode(F.lit("x"), "UTF-8")), "left": ("prefix", F.transform("slot_texts", lambda t: F.concat(t, F.col("prefix"))), F.col("blobs")),
    }
    out = None
    for name, (prefix, texts, blobs) in cases.items():
        rows = masks.select("doc_id", "mask", "offsets", blobs.alias("blobs"), "prefix", F.lit("bad").alias("bad"), texts.alias("slot_texts"))
        part = artifacts.merged_packages(rows, prefix).select("doc_id", F.lit(name).alias("case"), F.regexp_extract("error", "^[a-z ]*", 0).alias("error"), F.col("content").isNull().alias("none"))
        out = part if out is None else out.unionByName(part)
    return out


def q_pkg_entry_differences(spark: SparkSession, d: str) -> DataFrame:
    """Parts of packages against the same with a header dropped and the styles changed."""
    evs = _events(spark, d)
    other = evs.where("part_name <> 'word/header1.xml'").withColumn("text", F.when(F.col("part_name") == "docProps/core.xml", F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return artifacts.entry_differences(docx.full_hashes(evs), docx.full_hashes(other))


def q_pkg_text_artifacts(spark: SparkSession, d: str) -> DataFrame:
    masks = artifacts.masked_packages(packages(spark, d))
    rows = artifacts.pure_texts(masks, structure.paragraphs(_events(spark, d)))
    j = lambda path: F.get_json_object("artifact", path)
    return rows.select("doc_id", j("$.version").cast("int").alias("version"), F.json_array_length(j("$.paragraphs")).alias("paragraphs"), F.md5(j("$.paragraphs[0].text")).alias("first"))


def q_pkg_structure_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = artifacts.structure_artifacts(_tree(spark, d), artifacts.masked_packages(packages(spark, d)))
    j = lambda path: F.get_json_object("artifact", path)
    return rows.select("doc_id", j("$.version").cast("int").alias("version"), j("$.root.kind").alias("kind"), F.json_array_length(j("$.root.children")).alias("parts"), j("$.root.children[0].part_name").alias("first_part"))


def q_memory_artifacts(spark: SparkSession, d: str) -> DataFrame:
    names = ("file_id", "tu_id", "part_name", "scope_key", "para_style", "source_surface", "frozen_surface", "nt_map", "understanding", "proper_nouns", "terms", "translation_a", "translation_b", "final_translation")
    rows = artifacts.memory_files(records(spark, d, *names), table(spark, d, "memory_files"))
    body = F.substring(F.col("artifact"), 2, 2**31 - 1)
    j = lambda path: F.get_json_object(body, path)
    return rows.select(
        "file_id", F.col("artifact").startswith("﻿").alias("bom"), j("$.schema").alias("schema"), F.json_array_length(j("$.paragraphs")).alias("records"),
        F.md5(j("$.paragraphs[0].原文")).alias("first"), j("$.model_a").alias("model_a"),
    )


def q_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "scope_key", "frozen_surface", "translation_a")
    traced = artifacts.trace_rows(rows, F.concat_ws(":", F.col("rec_id").cast("string"), "scope_key"), F.col("frozen_surface"), F.col("translation_a"))
    return traced.select("file_name", F.md5("content").alias("content"))


def q_slot_positions(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a record looked up by their number among its texts, one beyond the end."""
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"]).where("side = 'source'")
    texts = rows.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "seg_text"))), lambda s: s["seg_text"]).alias("texts"))
    got = units.slot_lookup(F.sequence(F.lit(1), F.size("texts") + 1), F.col("texts"))
    return texts.select("rec_id", F.array_join(got, "|", "?").alias("found"))


def q_first_seen_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "file_id", "tu_id", "terms").select("rec_id", "file_id", "tu_id", F.posexplode("terms").alias("pos", "term")).where("term is not null")
    return units.first_seen(rows, ["file_id", "term"], ["tu_id", "rec_id", "pos"])


def q_latest_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_lines").select("project_key", F.length("payload").alias("chars"), "line_id")
    return units.latest(rows, ["project_key", "chars"], "line_id")


def q_issue_units(spark: SparkSession, d: str) -> DataFrame:
    """Issues reported for two units a record, of which one exists."""
    found = records(spark, d).select(F.explode(F.array("rec_id", F.col("rec_id") + 10**9)).alias("rec_id"), F.lit("style").alias("issue"))
    return units.issues_of_units(found, records(spark, d, "tu_kind"), "rec_id")


QUERIES: dict[str, Query] = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

# --- SQL ---------------------------------------------------------------------------------------------------------

_R = f"""
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS n, s AS t, NOT regexp_full_match(s, '{_WS}*') AS seen
  FROM (SELECT DISTINCT ON (rec_id) rec_id, file_id, project_key, tu_id, para_style, source_surface AS s FROM paragraph_memory) WHERE s IS NOT NULL
"""
#: Lines of the two halves of each record, which are its texts: those not empty.
_HALVES = f"""
  SELECT *, list_filter(string_split(left(t, length(t) // 2), chr(10)), lambda x: x <> '') AS h1,
    list_filter(string_split(substring(t, length(t) // 2 + 1), chr(10)), lambda x: x <> '') AS h2 FROM ({_R})
"""
_FILES = f"(SELECT DISTINCT file_id, max(project_key) OVER (PARTITION BY file_id) AS project_key FROM ({_R}))"
_DOC = "file_id::VARCHAR AS doc_id"

ORACLE: dict[str, str] = {
    "q_pkg_filtered_properties": f"""
      SELECT {_DOC}, 'w:rPr' AS name, 2 * count(*) AS n FROM ({_R}) GROUP BY file_id
      UNION ALL SELECT {_DOC}, 'w:i', count(*) FROM ({_R}) WHERE n % 3 <> 0 GROUP BY file_id
    """,
    "q_pkg_contexts": f"""
      WITH p AS (SELECT file_id, para_style, n % 5 = 0 AS c FROM ({_R}) WHERE seen UNION ALL SELECT file_id, NULL, true FROM ({_R}) WHERE n % 5 = 0),
      o AS (SELECT *, CASE para_style WHEN 'Heading1' THEN 0 WHEN 'Heading2' THEN 1 WHEN 'SubHeading' THEN 1 WHEN 'Deep' THEN 1 END AS outline FROM p)
      SELECT {_DOC}, para_style AS p_style, outline, coalesce(outline + 1, CASE WHEN regexp_matches(para_style, '(?i)^heading *[0-9]+') THEN regexp_extract(para_style, '[0-9]+')::INT END)::INT AS heading,
        c AS in_table, count(*) AS paragraphs, count(*) FILTER (c) AS hinted FROM o GROUP BY ALL
    """,
    "q_pkg_canonical": f"""
      SELECT {_DOC}, x AS part_name, s AS same FROM {_FILES}, (VALUES ('[Content_Types].xml', true), ('word/document.xml', true), ('word/header1.xml', true), ('word/styles.xml', true), ('docProps/core.xml', false)) v(x, s)
    """,
    "q_pkg_paragraphs": f"""
      WITH p AS (
        SELECT file_id, 'word/document.xml' AS part_name, n, 0 AS k, t, para_style, n % 5 = 0 AS c FROM ({_R}) WHERE seen
        UNION ALL SELECT file_id, 'word/document.xml', n, 1, '.', NULL, true FROM ({_R}) WHERE n % 5 = 0
        UNION ALL SELECT file_id, 'word/header1.xml', 0, 0, project_key, NULL, false FROM {_FILES} WHERE NOT regexp_full_match(project_key, '{_WS}*'))
      SELECT {_DOC}, row_number() OVER (PARTITION BY file_id ORDER BY part_name <> 'word/document.xml', n, k)::INT AS para_id, part_name,
        CASE WHEN part_name = 'word/header1.xml' THEN 'header_footer' WHEN c THEN 'table_cell' ELSE 'document_body' END AS container,
        CASE WHEN c THEN n // 5 END::BIGINT AS table_index, CASE WHEN c THEN 1 END::BIGINT AS row_index, CASE WHEN c THEN k + 1 END::BIGINT AS cell_index, para_style AS p_style,
        CASE WHEN n > 0 AND n % 4 = 0 AND k = 0 THEN 1 END::INT AS num_id, CASE WHEN n > 0 AND n % 4 = 0 AND k = 0 THEN n % 3 END::INT AS num_ilvl, md5(t) AS text FROM p
    """,
    "q_pkg_merged_runs": f"""
      SELECT {_DOC}, sum(2 + (n % 5 = 0)::INT)::BIGINT AS runs, sum(length(replace(t, chr(10), '')) + (n % 5 = 0)::INT)::BIGINT AS chars,
        sum(2 + (n % 5 = 0)::INT - (n % 3 = 0 AND n % 7 <> 0 AND NOT contains(t, chr(10)))::INT)::BIGINT AS merged,
        sum(length(replace(t, chr(10), '')) + (n % 5 = 0)::INT)::BIGINT AS merged_chars FROM ({_R}) GROUP BY file_id
    """,
    "q_pkg_filtered": f"""
      WITH f AS (SELECT file_id, n, CASE WHEN n % 7 = 0 THEN left(t, length(t) // 2) ELSE t END AS x FROM ({_R}) UNION ALL SELECT file_id, n, '.' FROM ({_R}) WHERE n % 5 = 0)
      SELECT {_DOC}, count(*) AS paragraphs, sum(length(x))::BIGINT AS chars, 0::BIGINT AS items FROM f WHERE NOT regexp_full_match(x, '{_WS}*') GROUP BY file_id
    """,
    "q_pkg_section_stories": f"SELECT {_DOC}, s::BIGINT AS section, 'header' AS story, 'word/header1.xml' AS part_name FROM {_FILES}, range(1, 3) r(s)",
    "q_pkg_section_formats": f"""
      SELECT {_DOC}, s::INT AS section, 'nextPage' AS start_type, CASE s WHEN 1 THEN 11906 ELSE 16838 END AS width, CASE s WHEN 1 THEN 16838 ELSE 11906 END AS height,
        CASE s WHEN 1 THEN 'portrait' ELSE 'landscape' END AS orientation, s = 2 AS different_first_page FROM {_FILES}, range(1, 3) r(s)
    """,
    "q_pkg_styles": f"""
      WITH RECURSIVE st(style_id, based_on, own) AS (VALUES {", ".join(f"('{s}', {repr(b) if b else 'NULL'}, {o if o is not None else 'NULL::INT'})" for s, b, o in _STYLES)}),
      w AS (SELECT style_id, own, based_on AS up, 0 AS k FROM st UNION ALL SELECT w.style_id, st.own, st.based_on, k + 1 FROM w JOIN st ON w.up = st.style_id WHERE w.own IS NULL AND k < 20)
      SELECT {_DOC}, style_id, based_on, CASE WHEN style_id LIKE 'Heading%' THEN substring(style_id, 8)::INT END AS guessed,
        (SELECT max(own) FROM w WHERE w.style_id = st.style_id) AS outline FROM {_FILES}, st
    """,
    "q_pkg_relationships": f"""
      SELECT {_DOC}, source, rid, type, target, external, part_name FROM {_FILES}, (VALUES ('', 'rId1', 'officeDocument', 'word/document.xml', false, 'word/document.xml'),
        ('word/document.xml', 'rId1', 'header', 'header1.xml', false, 'word/header1.xml'), ('word/document.xml', 'rId2', 'hyperlink', 'https://example.org/', true, NULL),
        ('word/document.xml', 'rId3', 'styles', 'styles.xml', false, 'word/styles.xml')) v(source, rid, type, target, external, part_name)
    """,
    "q_pkg_reachable": f"SELECT {_DOC}, p AS part_name FROM {_FILES}, (VALUES ('word/document.xml'), ('word/header1.xml'), ('word/styles.xml')) v(p)",
    "q_pkg_hyperlinks": f"SELECT {_DOC}, 'https://example.org/' AS url, count(*) AS links, sum(length(array_to_string(h2, '')))::BIGINT AS chars FROM ({_HALVES}) WHERE n % 7 = 0 GROUP BY file_id",
    "q_pkg_fonts": f"""
      WITH r AS (SELECT file_id, true AS b, length(array_to_string(h1, '')) AS c FROM ({_HALVES}) UNION ALL SELECT file_id, n % 3 = 0, length(array_to_string(h2, '')) FROM ({_HALVES})
        UNION ALL SELECT file_id, NULL, 1 FROM ({_R}) WHERE n % 5 = 0)
      SELECT {_DOC}, CASE WHEN b THEN true END AS bold, CASE WHEN NOT b THEN true END AS italic, CASE WHEN b THEN 12.0::DOUBLE END AS size, NULL::BOOLEAN AS all_caps, count(*) AS runs,
        sum(c)::BIGINT AS chars FROM r GROUP BY file_id, b
    """,
    "q_pkg_formats": f"""
      WITH p AS (SELECT file_id, 'word/document.xml' AS part_name, para_style AS style FROM ({_R}) UNION ALL SELECT file_id, 'word/document.xml', NULL FROM ({_R}) WHERE n % 5 = 0
        UNION ALL SELECT file_id, x, NULL FROM {_FILES}, (VALUES ('word/document.xml'), ('word/header1.xml')) v(x))
      SELECT {_DOC}, part_name, style, count(*) AS paragraphs, 0::BIGINT AS aligned, 0::BIGINT AS tab_stops FROM p GROUP BY file_id, part_name, style
    """,
    "q_pkg_grid": f"""
      SELECT {_DOC}, c::INT AS column_index, count(*) AS places, sum(CASE WHEN c < 2 THEN length(replace(t, chr(10), '')) ELSE 1 END)::BIGINT AS chars
      FROM ({_R}), range(3) r(c) WHERE n % 5 = 0 GROUP BY file_id, c
    """,
    "q_pkg_core_properties": f"""
      SELECT {_DOC}, 'title' AS property, project_key AS value FROM {_FILES}
      UNION ALL SELECT {_DOC}, 'revision', count(*)::VARCHAR FROM ({_R}) GROUP BY file_id
    """,
    "q_pkg_content_types": f"""
      SELECT {_DOC}, kind, key, content_type FROM {_FILES}, (VALUES ('default', 'xml', 'application/xml'), ('override', '/word/document.xml', 'application/main')) v(kind, key, content_type)
    """,
    "q_pkg_para_slots": f"""
      WITH p AS (SELECT file_id, n, 0 AS k, len(h1) + len(h2) AS c, array_to_string(list_concat(h1, h2), '') AS x FROM ({_HALVES}) WHERE seen
        UNION ALL SELECT file_id, n, 1, 1, '.' FROM ({_R}) WHERE n % 5 = 0)
      SELECT {_DOC}, row_number() OVER (PARTITION BY file_id ORDER BY n, k)::INT AS para_id, c::INT AS slots, md5(x) AS text, c > 0 AS ended FROM p
    """,
    "q_pkg_slot_texts": f"""
      WITH p AS (SELECT file_id, n, 0 AS k, translate(array_to_string(list_concat(h1, h2), ''), 'aeiou', 'AEIOU') AS x FROM ({_HALVES}) WHERE seen
        UNION ALL SELECT file_id, n, 1, '.' FROM ({_R}) WHERE n % 5 = 0)
      SELECT {_DOC}, row_number() OVER (PARTITION BY file_id ORDER BY n, k)::INT AS para_id, md5(x) AS text, NULL::VARCHAR AS error FROM p
    """,
    "q_pkg_units": f"""
      SELECT {_DOC}, 'w:p' AS scope, para_style, md5(replace(t, chr(10), '<<MT_BR>>')) AS text,
        (len(h1) + len(h2) - (len(h1) > 0 AND len(h2) > 0 AND n % 3 = 0 AND right(left(t, length(t) // 2), 1) <> chr(10) AND substring(t, length(t) // 2 + 1, 1) <> chr(10))::INT)::INT AS spans
      FROM ({_HALVES}) WHERE seen AND t <> '.'
    """,
    "q_pkg_projected": f"""
      SELECT {_DOC}, (1 + count(*) FILTER (seen) OVER w + count(*) FILTER (n % 5 = 0) OVER w)::INT AS tu_id,
        (len(h1) + len(h2) - (len(h1) > 0 AND len(h2) > 0 AND n % 3 = 0 AND right(left(t, length(t) // 2), 1) <> chr(10) AND substring(t, length(t) // 2 + 1, 1) <> chr(10))::INT)::INT AS pieces,
        md5(translate(replace(t, chr(10), ''), 'aeiou', 'AEIOU')) AS text, NULL::VARCHAR AS error
      FROM ({_HALVES}) WINDOW w AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY seen AND t <> '.'
    """,
    "q_pkg_mask_merge": f"""
      SELECT {_DOC}, (sum(len(h1) + len(h2) + (n % 5 = 0)::INT) + 3)::INT AS slots, NULL::VARCHAR AS error, NULL::VARCHAR AS same, 'entry content: word/document.xml' AS changed
      FROM ({_HALVES}) GROUP BY file_id
    """,
    "q_pkg_entry_differences": f"""
      SELECT {_DOC}, x AS name, w AS difference FROM {_FILES}, (VALUES ('word/header1.xml', 'missing'), ('docProps/core.xml', 'changed')) v(x, w)
    """,
    "q_pkg_mask_errors": f"""
      SELECT {_DOC}, c AS case, e AS error, true AS none FROM {_FILES},
        (VALUES ('texts', ''), ('prefix', 'placeholder prefixes differ'), ('blobs', 'blob out of range'), ('left', 'placeholder left over in word')) v(c, e)
    """,
    "q_pkg_text_artifacts": f"""
      SELECT {_DOC}, 3 AS version, (count(*) FILTER (seen) + count(*) FILTER (n % 5 = 0) + 1)::INT AS paragraphs, md5(arg_min(t, n) FILTER (seen)) AS first FROM ({_R}) GROUP BY file_id
    """,
    "q_pkg_structure_artifacts": f"SELECT {_DOC}, 1 AS version, 'root' AS kind, 2 AS parts, 'word/document.xml' AS first_part FROM {_FILES}",
    "q_memory_artifacts": """
      SELECT file_id, true AS bom, 'mt.paragraph_memory.v1' AS schema, count(*)::INT AS records, md5(arg_min(source_surface, (tu_id, rec_id))) AS first, any_value(model_a) AS model_a
      FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory) JOIN memory_files USING (file_id) GROUP BY file_id
    """,
    "q_trace": r"""
      SELECT regexp_replace(rec_id || ':' || scope_key, '[/\\:*?"<>|]', '_', 'g') || '.' || w || '.txt' AS file_name, md5(CASE w WHEN 'prompt' THEN frozen_surface ELSE translation_a END) AS content
      FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory), (VALUES ('prompt'), ('output')) v(w)
    """,
    "q_slot_positions": """
      SELECT rec_id, string_agg(seg_text, '|' ORDER BY seg_idx) || '|?' AS found FROM (SELECT DISTINCT ON (sent_id) * FROM memory_sentences) WHERE side = 'source' GROUP BY rec_id
    """,
    "q_first_seen_terms": """
      WITH e AS (SELECT rec_id, file_id, tu_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory))
      SELECT file_id, term, rec_id, tu_id, pos::INT AS pos FROM e WHERE term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, term ORDER BY tu_id, rec_id, pos) = 1
    """,
    "q_latest_rows": "SELECT project_key, length(payload)::INT AS chars, max(line_id) AS line_id FROM memory_lines GROUP BY 1, 2",
    "q_issue_units": "SELECT DISTINCT rec_id, 'style' AS issue, tu_kind FROM paragraph_memory",
}
