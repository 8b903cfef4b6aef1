"""Paragraphs out of markup events, by windows over a part's events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BODY = "^/w:document/w:body/w:p$"
CELL = "^/w:document/w:body/w:tbl/w:tr/w:tc/w:p$"
STORY = "^/w:(?:hdr|ftr)/w:p$"


def control_text(name: Column, attrs: Column) -> Column:
    """What a control element adds to a paragraph's text; null for other elements."""
    kind = F.element_at(F.transform(F.filter(attrs, lambda a: a["k"] == "w:type"), lambda a: a["v"]), 1)
    kind = F.when(F.size(F.filter(attrs, lambda a: a["k"] == "w:type")) > 0, kind)
    return (
        F.when(name.isin("w:tab", "w:ptab"), "\t")
        .when(name == "w:cr", "\n")
        .when((name == "w:br") & (kind.isNull() | (kind == "textWrapping")), "\n")
        .when(name == "w:noBreakHyphen", "-")
        .when(name.isin("w:br", "w:softHyphen"), "")
    )


def _value(attrs: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(attrs, lambda a: a["k"] == "w:val"), lambda a: a["v"]), F.lit(1))


def paragraphs(evs: DataFrame) -> DataFrame:
    """(doc_id, para_id, part_name, scope_key, event_index, container, table_index, row_index, cell_index, p_style,
    num_id, num_ilvl, outline_lvl, text) of the paragraphs directly in a body, in cells of outermost tables, and in
    headers and footers; blank ones are left out.

    Text is that of direct runs and of runs in hyperlinks. The first paragraph end after a start ends it, so a
    paragraph nested in a text box cuts the one around it short. CDATA is no text.
    """
    part = Window.partitionBy("doc_id", "part_name").orderBy("event_index")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.col("kind") == "start") & F.col("path").rlike(f"{BODY}|{CELL}|{STORY}")
    opens = F.col("kind").isin("start", "empty")
    at = lambda path: F.sum((opens & (F.col("path") == path)).cast("int")).over(upto)
    rows = evs.withColumns(
        {
            "p": F.last(F.when(starts, F.col("event_index")), ignorenulls=True).over(upto),
            "p_path": F.last(F.when(starts, F.col("path")), ignorenulls=True).over(upto),
            "closed": F.last(F.when((F.col("kind") == "end") & (F.col("name") == "w:p"), F.col("event_index")), ignorenulls=True).over(before),
            "tables": at("/w:document/w:body/w:tbl"),
            "rows": at("/w:document/w:body/w:tbl/w:tr"),
            "cells": at("/w:document/w:body/w:tbl/w:tr/w:tc"),
        }
    )
    # Rows count from each table, cells from each row: subtract what had been counted where it began.
    rows = rows.withColumns(
        {
            "rows0": F.max(F.when(opens & (F.col("path") == "/w:document/w:body/w:tbl"), F.col("rows"))).over(upto),
            "cells0": F.max(F.when(opens & (F.col("path") == "/w:document/w:body/w:tbl/w:tr"), F.col("cells"))).over(upto),
        }
    )
    inside = rows.where(F.col("p").isNotNull() & (F.coalesce(F.col("closed"), F.lit(-1)) < F.col("p")))
    rest = F.expr("substring(path, length(p_path) + 1)")
    run = rest.isin("/w:r/w:t", "/w:hyperlink/w:r/w:t")
    control = opens & rest.rlike("^(?:/w:hyperlink)?/w:r/w:(?:tab|ptab|cr|br|noBreakHyphen|softHyphen)$")
    piece = F.when((F.col("kind") == "text") & run, F.col("text")).when(control, control_text(F.col("name"), F.col("attrs")))
    first = lambda path: F.min_by(F.when(opens & (rest == path), _value(F.col("attrs"))), F.when(opens & (rest == path) & _value(F.col("attrs")).isNotNull(), F.col("event_index")))
    number = lambda c: F.expr(f"try_cast({c} as int)")
    found = inside.groupBy("doc_id", "part_name", F.col("p").alias("event_index"), "p_path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("event_index", piece.alias("s"))))), lambda e: e["s"]), "").alias("text"),
        F.trim(first("/w:pPr/w:pStyle")).alias("p_style"),
        first("/w:pPr/w:numPr/w:numId").alias("num"),
        first("/w:pPr/w:numPr/w:ilvl").alias("ilvl"),
        first("/w:pPr/w:outlineLvl").alias("outline"),
        *[F.min(c).alias(c) for c in ("tables", "rows", "rows0", "cells", "cells0")],
    )
    cell = F.col("p_path").rlike(CELL)
    order = Window.partitionBy("doc_id").orderBy(F.col("part_name") != "word/document.xml", "part_name", "event_index")
    return found.where(~F.col("text").rlike(r"(?U)^\s*$")).select(
        "doc_id",
        F.row_number().over(order).alias("para_id"),
        "part_name",
        F.format_string("%s#w:p@%d", "part_name", "event_index").alias("scope_key"),
        "event_index",
        F.when(cell, "table_cell").when(F.col("p_path").rlike(BODY), "document_body").otherwise("header_footer").alias("container"),
        F.when(cell, F.col("tables")).alias("table_index"),
        F.when(cell, F.col("rows") - F.col("rows0")).alias("row_index"),
        F.when(cell, F.col("cells") - F.col("cells0")).alias("cell_index"),
        F.nullif("p_style", F.lit("")).alias("p_style"),
        number("num").alias("num_id"),
        number("ilvl").alias("num_ilvl"),
        number("outline").alias("outline_lvl"),
        "text",
    )


def filtered_events(
    evs: DataFrame, drop_elements: list[str], drop_attributes: list[str], keep_space_in: tuple[str, ...] = ("w:t", "a:t"), drop_run_properties: tuple[str, ...] = ()
) -> DataFrame:
    """Events without the named elements and what lies in them, without the named run properties where they are
    properties of a run (below ``w:rPr``), without the named attributes, and without text of white space only outside
    the elements in ``keep_space_in``."""
    below = "(?:^|/)(?:" + "|".join(e.replace(".", r"\.") for e in drop_elements) + ")(?:/|$)"
    rows = evs.where(~F.col("path").rlike(below)) if drop_elements else evs
    if drop_run_properties:
        rows = rows.where(~F.col("path").rlike("/w:rPr/(?:" + "|".join(re.escape(p) for p in drop_run_properties) + ")(?:/|$)"))
    parent = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(~((F.col("kind") == "text") & F.col("text").rlike(r"(?U)^\s*$") & ~parent.isin(*keep_space_in)))
    if drop_attributes:
        rows = rows.withColumn("attrs", F.filter("attrs", lambda a: ~a["k"].isin(*drop_attributes)))
    return rows
