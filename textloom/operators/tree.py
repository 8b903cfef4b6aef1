"""Trees and inheritance: headings, lists and items of a part; style inheritance; stories of sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.language import heading_text
from textloom.operators.sequence import heading_path
from textloom.session import cut_lineage
from textloom.sources.properties import guessed_level

TREE = "doc_id string, part_name string, node_id int, parent_id int, kind string, para_id int, level int, num_id int, text string"


class _Part:
    """Grows one part's tree as its paragraphs come by. Node 0 is the part."""

    def __init__(self, doc: str, part: str) -> None:
        self.doc, self.part, self.next = doc, part, 1
        self.rows: list[tuple] = [(doc, part, 0, None, "part", None, None, None, None)]
        self.headings = [0]
        self.lists: list[int] = []
        self.items: list[int | None] = []
        self.context: tuple | None = None

    def node(self, parent: int, kind: str, para: int | None, level: int | None, num: int | None, text: str | None) -> int:
        self.rows.append((self.doc, self.part, self.next, parent, kind, para, level, num, text))
        self.next += 1
        return self.next - 1

    def add(self, para: int, heading: int | None, num: int | None, ilvl: int | None, place: str, text: str) -> None:
        if heading is not None:
            # Headings leave by depth, not by level: after a jump the next of the same level nests.
            del self.headings[heading:]
            self.context = None
            self.headings.append(self.node(self.headings[-1], "heading", para, heading, num, text))
            return
        section = self.headings[-1]
        if num is None or ilvl is None:
            self.context = None
            self.node(section, "paragraph", para, ilvl, num, text)
            return
        level = max(0, ilvl)
        if self.context != (section, num, place):
            self.context = (section, num, place)
            self.lists, self.items = [self.node(section, "list", None, 0, num, None)], [None]
        del self.lists[level + 1 :], self.items[level + 1 :]
        while len(self.lists) <= level:
            parent = self.items[-1] if self.items[-1] is not None else section
            self.lists.append(self.node(parent, "list", None, len(self.lists), num, None))
            self.items.append(None)
        self.items[level] = self.node(self.lists[level], "list_item", para, ilvl, num, text)


def structure_tree(paragraphs: DataFrame) -> DataFrame:
    """Adjacency rows of paragraphs (doc_id, part_name, event_index, para_id, heading, num_id, num_ilvl, place, text),
    one tree a part. A list goes on while its section, number and ``place`` (container and cell) stay the same.
    Paragraphs are sorted and streamed; a task holds the tree of one part."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TREE.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        part: _Part | None = None
        for batch in batches:
            for doc, name, _, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or (part.doc, part.part) != (doc, name):
                    if part:
                        yield pack(part.rows)
                    part = _Part(doc, name)
                part.add(*rest)
        if part:
            yield pack(part.rows)

    rows = paragraphs.select("doc_id", "part_name", "event_index", "para_id", "heading", "num_id", "num_ilvl", F.coalesce("place", F.lit("")).alias("place"), "text")
    return rows.repartition("doc_id", "part_name").sortWithinPartitions("doc_id", "part_name", "event_index").mapInArrow(grow, TREE)


def inherited_outline(styles: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, style_id, outline) of styles (doc_id, style_id, based_on, outline): the first outline up the chain
    of bases; null where it has none or runs in a circle. Every join doubles the steps taken, until no chain goes on.
    One that still does after as many steps as its document may have styles runs in a circle. ``depth``: the most
    styles of a document, if known; they are counted otherwise."""
    known = cut_lineage(styles.select("doc_id", "style_id", "outline", F.when(F.col("outline").isNull(), F.col("based_on")).alias("next")))
    if depth is None:
        depth = known.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while steps < depth and not known.where("next is not null").isEmpty():
        bases = known.select("doc_id", F.col("style_id").alias("next"), F.col("outline").alias("_o"), F.col("next").alias("_n"))
        known = cut_lineage(
            known.join(bases, ["doc_id", "next"], "left").select("doc_id", "style_id", F.coalesce("outline", "_o").alias("outline"), F.col("_n").alias("next"))
        )
        steps *= 2
    return known.select("doc_id", "style_id", "outline")


def section_stories(references: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, section, story, part_name): the part of every section's header and footer. ``references`` has a row
    (doc_id, section, story, rid) for every section and story; a null rid keeps the last one given, as does no
    reference at all; ``rels`` (doc_id, rid, part_name) says which part that is."""
    upto = Window.partitionBy("doc_id", "story").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    held = references.withColumn("rid", F.last("rid", ignorenulls=True).over(upto)).where("rid is not null")
    return held.join(rels, ["doc_id", "rid"]).select("doc_id", "section", "story", "part_name")


def paragraph_contexts(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """``paragraphs`` (as ``structure.paragraphs`` gives them) with ``style_name``, ``outline``, ``heading``,
    ``is_heading``, ``in_table``, ``section_path`` and ``hint``, the context as text for a prompt.

    The outline is the paragraph's own or that its style inherits; the heading's level follows from it, else from a
    style called ``Heading n``. Styles are unique by document and id.
    """
    known = styles.select("doc_id", F.col("style_id").alias("p_style"), F.col("name").alias("style_name"))
    outlines = inherited_outline(styles).select("doc_id", F.col("style_id").alias("p_style"), F.col("outline").alias("_o"))
    rows = paragraphs.join(known, ["doc_id", "p_style"], "left").join(outlines, ["doc_id", "p_style"], "left")
    rows = rows.withColumn("outline", F.coalesce("outline_lvl", "_o")).drop("_o")
    level = F.coalesce(F.when(F.col("outline") >= 0, F.col("outline") + 1), guessed_level(F.coalesce("style_name", "p_style")))
    rows = rows.withColumns({"heading": level, "in_table": F.col("container") == "table_cell", "_head": heading_text(F.col("text"), 100)})
    rows = rows.withColumn("is_heading", F.col("heading").isNotNull())
    rows = heading_path(rows, ["doc_id", "part_name"], ["event_index"], "heading", "_head").drop("_head")
    line = lambda when, *parts: F.when(when, F.concat(*parts))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hint = F.concat_ws(
        "\n",
        line(F.size("section_path") > 0, F.lit("Section path: "), F.array_join("section_path", " > ")),
        line(F.col("is_heading"), F.lit("Paragraph role: Heading(level="), text("heading"), F.lit(")")),
        line(F.coalesce("style_name", "p_style").isNotNull(), F.lit("Paragraph style: "), F.trim(F.coalesce("style_name", "p_style"))),
        line(F.col("outline").isNotNull(), F.lit("Outline level: "), text("outline")),
        line(F.col("num_id").isNotNull() | F.col("num_ilvl").isNotNull(), F.lit("List: numId="), text("num_id"), F.lit(" ilvl="), text("num_ilvl")),
        line(F.col("in_table"), F.lit("In table: yes")),
    )
    return rows.withColumn("hint", hint)
