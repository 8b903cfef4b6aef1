"""Queries of the package, markup, segment and model operators. Packages are written from the paragraph memory, one
for each file, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import references
from textloom.operators import model, projection, segments, structure
from textloom.plans.text_queries import _ID, _VALIDATED, _ascii, records
from textloom.session import table
from textloom.sources import docx


def _escaped(text: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def packages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, content): a package for each file of the memory."""
    rows = records(spark, d, "file_id", "tu_id", "para_style", "source_surface")
    body = F.replace(_escaped(F.col("source_surface")), F.lit("\n"), F.lit("</w:t><w:br/><w:t>"))
    style = F.coalesce(F.concat(F.lit('<w:pPr><w:pStyle w:val="'), "para_style", F.lit('"/></w:pPr>')), F.lit(""))
    para = F.concat(F.lit("<w:p>"), style, F.lit("<w:r><w:t>"), body, F.lit("</w:t></w:r></w:p>"))
    ordered = F.array_sort(F.collect_list(F.struct("tu_id", "rec_id", para.alias("x"))))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><w:document><w:body>'), F.array_join(F.transform(ordered, lambda p: p["x"]), ""), F.lit("<w:sectPr/></w:body></w:document>")
    )
    parts = rows.where("source_surface is not null").groupBy("file_id").agg(xml.alias("xml"))
    number = lambda n: F.lit(n).cast("int")
    stamp = [number(v).alias(k) for k, v in (("compression", 8), ("year", 2024), ("month", 5), ("day", 6), ("hour", 7), ("minute", 8), ("second", 10), ("unix_mode", 0o644))]
    entry = lambda i, name, data: parts.select(F.col("file_id").cast("string").alias("doc_id"), number(i).alias("entry_idx"), F.lit(name).alias("name"), data.alias("data"), *stamp, F.lit(False).alias("is_dir"))
    types = F.encode(F.lit("<Types/>"), "UTF-8")
    return docx.pack(entry(0, "[Content_Types].xml", types).unionByName(entry(1, "word/document.xml", F.encode("xml", "UTF-8"))))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return docx.events(docx.unpack(packages(spark, d)))


def q_docx_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = docx.unpack(packages(spark, d))
    return rows.select("doc_id", "entry_idx", "name", "compression", "year", "minute", "second", docx.is_xml(F.col("name")).alias("is_xml"))


def q_docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return structure.paragraphs(_events(spark, d)).select("doc_id", "para_id", "container", "p_style", "text")


def q_markup_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Serialising what was parsed gives the same bytes; masking changes no structure."""
    entries = docx.unpack(packages(spark, d))
    evs = docx.events(entries)
    again = docx.serialized(evs).select("doc_id", "name", F.col("data").alias("again"))
    whole = docx.structure_hashes(evs).withColumnRenamed("part_name", "name")
    hidden = docx.structure_hashes(docx.masked(evs, "0123456789")).select("doc_id", F.col("part_name").alias("name"), F.col("hash").alias("hidden"))
    joined = entries.join(again, ["doc_id", "name"]).join(whole, ["doc_id", "name"]).join(hidden, ["doc_id", "name"])
    return joined.select("doc_id", "name", (F.col("data") == F.col("again")).alias("same_bytes"), (F.col("hash") == F.col("hidden")).alias("same_structure"))


def q_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = docx.slots(_events(spark, d))
    return rows.groupBy("doc_id").agg(F.count("*").alias("slots"), F.sum(F.length("slot_text")).alias("chars"), F.max("slot_id").alias("last_id"))


def q_sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "translation_a").withColumn("s", segments.split_sentences(F.col("translation_a")))
    marked = F.transform("s", lambda x: F.concat(x["text"], F.lit("¦"), x["suffix"]))
    return rows.select("rec_id", F.size("s").alias("segments"), F.array_join(marked, "|").alias("text"))


def q_sentence_list(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "translation_a").withColumn("s", segments.split_sentences(F.col("translation_a")))
    return rows.select("rec_id", segments.sentence_list(F.col("s"), 300).alias("list"))


def q_segmented_output(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    line = F.concat(F.format_string("<<MT_SEG:%06d>>", "seg_idx"), "seg_text", F.format_string("<<MT_END:%06d>>\n", "seg_idx"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line"))))
    texts = rows.groupBy("rec_id", "side").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "").alias("text"), F.array_sort(F.collect_list("seg_idx")).alias("ids"))
    return texts.select("rec_id", "side", F.array_join(segments.segmented_output(F.col("text"), F.col("ids")), "|").alias("parsed"))


def q_patches(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of every translation patched by one written for its record's number."""
    rows = records(spark, d, "translation_a").where("translation_a is not null")
    first = F.get(segments.split_sentences(F.col("translation_a")), F.lit(0))["text"]
    patch = F.to_json(F.array(F.struct(F.lit("sentence_replace").alias("patch_type"), (F.col("rec_id") % 2).cast("int").alias("sentence_index"), first.alias("before"), F.concat(F.trim(first), F.lit(" (checked)")).alias("after"))))
    out = rows.withColumn("p", segments.patched(F.col("translation_a"), patch))
    return out.select("rec_id", F.col("p.text").alias("text"), F.col("p.error").alias("error"))


def q_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in turn: translation A as it is, the stub model's text, the source."""
    rows = records(spark, d, "frozen_surface", "nt_map", "translation_a")
    rows = model.generated(rows, "frozen_surface", "model_text")
    done = model.accepted(rows, "frozen_surface", "nt_map", ["translation_a", "model_text"])
    return done.groupBy("accepted_from").agg(F.count("*").alias("units"))


def q_legal_references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    zh = F.col("seg_text").rlike("[一-鿿]")
    src, tgt = F.when(zh, "zh").otherwise("en"), F.when(zh, "en").otherwise("zh")
    return rows.select("sent_id", references.legal_reference(F.col("seg_text"), src, tgt).alias("reference"))


def q_slot_output(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", F.concat(F.format_string("<<MT_SLOT:%06d>>", "seg_idx"), "seg_text").alias("line"))))
    texts = rows.groupBy("rec_id", "side").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "").alias("text"), F.array_sort(F.collect_list("seg_idx")).alias("ids"))
    return texts.select("rec_id", "side", F.array_join(segments.slot_output(F.col("text"), F.col("ids")), "|").alias("parsed"))


def q_stitched_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Sides a and b that repeat a segment of 24 characters or more while the source at its place is unique."""
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"]).withColumn("n", F.trim(F.regexp_replace("seg_text", r"(?U)\s+", " ")))
    src = rows.where("side = 'source'").withColumn("s_times", F.count("*").over(Window.partitionBy("rec_id", "n"))).select("rec_id", "seg_idx", F.when(F.length("n") >= 24, F.col("s_times")).otherwise(0).alias("s_times"))
    out = rows.where("side <> 'source' and length(n) >= 24").withColumn("o_times", F.count("*").over(Window.partitionBy("rec_id", "side", "n")))
    pairs = out.join(src, ["rec_id", "seg_idx"])
    return pairs.groupBy("rec_id", "side").agg(F.max((F.col("o_times") >= 2) & (F.col("s_times") <= 1)).alias("duplicated"))


def q_first_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_lines").select("line_id", F.concat(F.lit("answer: "), "payload", F.lit(" }")).alias("text"))
    found = segments.first_json_object(F.col("text"))
    return rows.select("line_id", F.trim(F.lower(F.get_json_object(found, "$.tu_kind"))).alias("kind"), F.get_json_object(found, "$.tu_id").cast("int").alias("tu_id"))


def q_projected(spark: SparkSession, d: str) -> DataFrame:
    """Translations cut by the byte weights of their source's sentences: sizes of all pieces add up."""
    rows = table(spark, d, "memory_sentences").dropDuplicates(["sent_id"])
    weights = rows.where("side = 'source'").groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.octet_length("seg_text").alias("w")))), lambda s: s["w"]).alias("weights"))
    texts = records(spark, d, "translation_a").join(weights, "rec_id")
    cut = projection.projected(F.col("translation_a"), F.col("weights"))
    return texts.select("rec_id", F.array_join(cut, "").alias("text"), F.size(cut).alias("pieces"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (q_docx_entries, q_docx_paragraphs, q_markup_roundtrip, q_slots, q_sentence_segments, q_sentence_list, q_segmented_output, q_patches, q_accepted,
              q_legal_references, q_slot_output, q_stitched_duplicates, q_first_json, q_projected)
}

_FILES = "(SELECT DISTINCT rec_id, file_id, tu_id, para_style, source_surface AS s FROM paragraph_memory WHERE source_surface IS NOT NULL)"
_WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Sentences of a text ``t``, each with its white space behind a mark.
_SENTENCES = rf"""list_filter(string_split(regexp_replace(t, '([.!?;。！？；])({_WS}+)|(\r?\n{_WS}*)', '\1' || chr(2) || '\2\3' || chr(1), 'g'), chr(1)), lambda x: x <> '')"""

_EN_KIND = "lower(CASE WHEN f1 <> '' THEN f1 ELSE g1 END)"
_EN_ID = "CASE WHEN f1 <> '' THEN f2 ELSE g2 END"

ORACLE: dict[str, str] = {
    "q_accepted": f"""
      SELECT CASE WHEN e IS NULL AND a IS NOT NULL THEN 'translation_a' WHEN o IS NULL AND f IS NOT NULL THEN 'model_text' ELSE 'source' END AS accepted_from, count(*) AS units
      FROM (SELECT rec_id, max(error) FILTER (k = 'm') AS e FROM ({_VALIDATED}) GROUP BY rec_id)
      JOIN (SELECT rec_id, max(error) FILTER (k = 'm') AS o FROM ({_VALIDATED.replace("coalesce(translation_a, '') AS t", "coalesce(frozen_surface, '') AS t")}) GROUP BY rec_id) USING (rec_id)
      JOIN (SELECT DISTINCT rec_id, translation_a AS a, frozen_surface AS f FROM paragraph_memory) USING (rec_id) GROUP BY 1
    """,
    "q_legal_references": rf"""
      WITH s AS (SELECT DISTINCT sent_id, seg_text AS x, {_ascii("seg_text")} AS a FROM memory_sentences),
      m AS (SELECT sent_id, x, regexp_matches(x, '[一-鿿]') AS zh, regexp_extract(a, '(?i)\b(section|article|clause|paragraph|schedule)s?\s+{_ID}\b', 1) AS f1,
        regexp_extract(a, '(?i)\b(section|article|clause|paragraph|schedule)s?\s+{_ID}\b', 2) AS f2, regexp_extract(a, '(?i)\b(sec|art|cl|para|sch)s?[.]\s+{_ID}\b', 1) AS g1,
        regexp_extract(a, '(?i)\b(sec|art|cl|para|sch)s?[.]\s+{_ID}\b', 2) AS g2,
        regexp_extract(x, '第\s*([0-9]+(?:\([A-Za-z0-9]+\))*)\s*(条|款|节|段|章|篇)((?:\([A-Za-z0-9]+\))*)', 1) AS n, regexp_extract(x, '第\s*([0-9]+(?:\([A-Za-z0-9]+\))*)\s*(条|款|节|段|章|篇)((?:\([A-Za-z0-9]+\))*)', 2) AS mark,
        regexp_extract(x, '第\s*([0-9]+(?:\([A-Za-z0-9]+\))*)\s*(条|款|节|段|章|篇)((?:\([A-Za-z0-9]+\))*)', 3) AS more, regexp_extract(x, '附表\s*([0-9]+(?:\([A-Za-z0-9]+\))*)', 1) AS sched FROM s),
      k AS (SELECT *, {_EN_KIND} AS kind, {_EN_ID} AS id FROM m),
      p AS (SELECT *, regexp_extract(id, '^([0-9][-0-9.,]*)((?:\([A-Za-z0-9]+\))*)$', 1) AS num, regexp_extract(id, '^([0-9][-0-9.,]*)((?:\([A-Za-z0-9]+\))*)$', 2) AS suf,
        CASE WHEN kind IN ('section', 'article', 'sec', 'art') THEN '条' WHEN kind IN ('clause', 'cl') THEN '款' WHEN kind IN ('paragraph', 'para') THEN '段' END AS label FROM k)
      SELECT sent_id, CASE WHEN zh THEN CASE WHEN mark IN ('条', '节', '章', '篇') THEN 'Section ' || n || more WHEN mark = '款' THEN 'Clause ' || n || more WHEN mark = '段' THEN 'Paragraph ' || n || more WHEN sched <> '' THEN 'Schedule ' || sched END
        WHEN kind IN ('schedule', 'sch') THEN '附表' || id WHEN label IS NOT NULL THEN CASE WHEN num <> '' THEN '第' || num || label || suf ELSE '第' || id || label END END AS reference FROM p
    """,
    "q_docx_entries": f"""
      SELECT file_id::VARCHAR AS doc_id, i::INT AS entry_idx, CASE i WHEN 0 THEN '[Content_Types].xml' ELSE 'word/document.xml' END AS name, 8 AS compression, 2024 AS year,
        8 AS minute, 10 AS second, true AS is_xml
      FROM (SELECT DISTINCT file_id FROM {_FILES}), range(2) r(i)
    """,
    "q_docx_paragraphs": f"""
      SELECT file_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id)::INT AS para_id, 'document_body' AS container, para_style AS p_style, s AS text
      FROM {_FILES} WHERE NOT regexp_full_match(s, '{_WS}*')
    """,
    "q_markup_roundtrip": f"""
      SELECT file_id::VARCHAR AS doc_id, n AS name, true AS same_bytes, true AS same_structure
      FROM (SELECT DISTINCT file_id FROM {_FILES}), (VALUES ('[Content_Types].xml'), ('word/document.xml')) v(n)
    """,
    "q_slots": f"""
      SELECT file_id::VARCHAR AS doc_id, count(*) AS slots, sum(length(t))::BIGINT AS chars, count(*)::INT AS last_id
      FROM (SELECT file_id, unnest(string_split(s, chr(10))) AS t FROM {_FILES}) WHERE t <> '' GROUP BY 1
    """.replace("(SELECT file_id, unnest", "(SELECT file_id, unnest"),
    "q_sentence_segments": rf"""
      WITH r AS (SELECT DISTINCT rec_id, translation_a AS t FROM paragraph_memory), p AS (SELECT rec_id, {_SENTENCES} AS ps FROM r)
      SELECT rec_id, CASE WHEN ps IS NULL THEN NULL ELSE len(ps) END::INT AS segments, array_to_string(list_transform(ps, lambda x: CASE WHEN contains(x, chr(2)) THEN replace(x, chr(2), '¦') ELSE x || '¦' END), '|') AS text FROM p
    """,
    "q_sentence_list": rf"""
      WITH r AS (SELECT DISTINCT rec_id, translation_a AS t FROM paragraph_memory), p AS (SELECT rec_id, {_SENTENCES} AS ps FROM r),
      l AS (SELECT rec_id, list_transform(ps, lambda x, i: '[' || (i - 1) || '] ' || split_part(x, chr(2), 1) || chr(10)) AS ls FROM p),
      k AS (SELECT rec_id, ls, len(list_filter(range(1, len(ls) + 1), lambda i: list_sum(list_transform(ls[1:i], lambda y: strlen(y))) <= 300)) AS n FROM l)
      SELECT rec_id, CASE WHEN ls IS NULL THEN NULL ELSE array_to_string(ls[1:n], '') || CASE WHEN n < len(ls) THEN '... (truncated)' || chr(10) ELSE '' END END AS list FROM k
    """,
    "q_segmented_output": """
      SELECT rec_id, side, string_agg(seg_text, '|' ORDER BY seg_idx) AS parsed
      FROM (SELECT DISTINCT sent_id, rec_id, side, seg_idx, seg_text FROM memory_sentences) GROUP BY rec_id, side
    """,
    "q_slot_output": """
      SELECT rec_id, side, string_agg(seg_text, '|' ORDER BY seg_idx) AS parsed
      FROM (SELECT DISTINCT sent_id, rec_id, side, seg_idx, seg_text FROM memory_sentences) GROUP BY rec_id, side
    """,
    "q_stitched_duplicates": rf"""
      WITH s AS (SELECT DISTINCT sent_id, rec_id, side, seg_idx, trim(regexp_replace(seg_text, '{_WS}+', ' ', 'g')) AS n FROM memory_sentences),
      a AS (SELECT rec_id, seg_idx, CASE WHEN length(n) >= 24 THEN count(*) OVER (PARTITION BY rec_id, n) ELSE 0 END AS st FROM s WHERE side = 'source'),
      o AS (SELECT rec_id, side, seg_idx, count(*) OVER (PARTITION BY rec_id, side, n) AS ot FROM s WHERE side <> 'source' AND length(n) >= 24)
      SELECT rec_id, side, bool_or(ot >= 2 AND st <= 1) AS duplicated FROM o JOIN a USING (rec_id, seg_idx) GROUP BY rec_id, side
    """,
    "q_first_json": r"""
      SELECT line_id, trim(lower(json_extract_string(p, '$.tu_kind'))) AS kind, json_extract_string(p, '$.tu_id')::INT AS tu_id
      FROM (SELECT line_id, regexp_replace(payload, '^\x{feff}+', '') AS p FROM memory_lines)
    """,
    "q_projected": """
      SELECT rec_id, translation_a AS text, CASE WHEN translation_a IS NULL THEN NULL ELSE n END AS pieces
      FROM (SELECT DISTINCT rec_id, translation_a FROM paragraph_memory)
      JOIN (SELECT rec_id, count(DISTINCT sent_id)::INT AS n FROM memory_sentences WHERE side = 'source' GROUP BY rec_id) USING (rec_id)
    """,
}
