"""Word-processing packages as tables: entries of the archive, markup events of its parts, and back again."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = (
    "doc_id string, entry_idx int, name string, data binary, compression int, year int, month int, day int, hour int, minute int, second int, "
    "unix_mode int, is_dir boolean"
)
EVENTS = "doc_id string, part_name string, event_index int, kind string, name string, attrs array<struct<k:string,v:string>>, text string, path string"

_ATTRIBUTES = r"(?:\s+[^\s=<>/\"']+\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*"
_MARKUP = re.compile(rf"<!--(.*?)-->|<!\[CDATA\[(.*?)\]\]>|<\?(.*?)\?>|<!DOCTYPE([^>]*)>|<(/?)([^\s/<>=\"'!?]+)({_ATTRIBUTES})\s*(/?)>|([^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|([^;\s&]*))(;?)")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


class MarkupError(ValueError):
    """A part that is no well-formed markup."""


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all packages under ``path``, in archive order."""
    return unpack(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content"))


def unpack(packages: DataFrame) -> DataFrame:
    """Entries of packages (doc_id, content). A content that is null or no archive has none."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for i, e in enumerate(archive.infolist()):
                    data = b"" if e.is_dir() else archive.read(e)
                    rows.append((doc, i, e.filename, data, e.compress_type, *e.date_time, e.external_attr >> 16, e.is_dir()))
                if rows:
                    types = [pa.string(), pa.int32(), pa.string(), pa.binary(), *[pa.int32()] * 8, pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return packages.select(F.col("doc_id").cast("string"), "content").mapInArrow(entries, ENTRIES)


def pack(entries: DataFrame) -> DataFrame:
    """(doc_id, content): entries written back in order, with their method, time and mode. A package's entries meet
    in one row, as they did in its file."""
    fields = [f.split()[0] for f in ENTRIES.split(", ")][1:]
    rows = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entries"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for items in batch.column(1).to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as archive:
                    for e in items:
                        info = zipfile.ZipInfo(e["name"], (e["year"], e["month"], e["day"], e["hour"], e["minute"], e["second"]))
                        info.compress_type, info.external_attr = e["compression"], e["unix_mode"] << 16
                        archive.writestr(info, e["data"])
                contents.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(write, "doc_id string, content binary")


def is_xml(name: Column) -> Column:
    return F.lower(name).endswith(".xml")


def replaced(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries with the data of ``parts`` (doc_id, name, data) in place of their own."""
    new = parts.select("doc_id", "name", F.col("data").alias("_new"))
    return entries.join(new, ["doc_id", "name"], "left").withColumn("data", F.coalesce("_new", "data")).select(*entries.columns)


def unescaped(text: str) -> str:
    """Text with the five named references of XML and character references resolved; any other is an error."""

    def one(m: re.Match[str]) -> str:
        sixteen, ten, name, end = m.groups()
        try:
            return _NAMED[name] if end and name is not None else chr(int(sixteen, 16) if sixteen else int(ten)) if end else _NAMED[m.group()]
        except (KeyError, ValueError, OverflowError, TypeError):
            raise MarkupError(f"unknown reference {m.group()[:40]!r}") from None

    return _REFERENCE.sub(one, text) if "&" in text else text


def parse_markup(text: str) -> list[tuple]:
    """(kind, name, attributes, text, path) of every piece: text unescaped, attributes raw and in order (double quotes
    within single-quoted ones as ``&quot;``, since they are written in double quotes), the path of the element that a
    piece is, or lies in. Every character belongs to a piece: what does not fit, elements closed out of order or left
    open, doubled attributes and unknown references raise ``MarkupError``."""
    out: list[tuple] = []
    stack, names, at = [""], [], 0
    text = text.removeprefix("\ufeff")
    while at < len(text):
        m = _MARKUP.match(text, at)
        if m is None:
            raise MarkupError(f"no markup at character {at}: {text[at : at + 40]!r}")
        at = m.end()
        comment, cdata, instruction, doctype, end, name, attributes, empty, plain = m.groups()
        if plain is not None:
            out.append(("text", None, None, unescaped(plain), stack[-1]))
        elif name is not None:
            if end:
                if not names or names[-1] != name or attributes.strip() or empty:
                    raise MarkupError(f"</{name}> closes {names[-1] if names else 'nothing'}")
                out.append(("end", name, None, None, stack.pop()))
                names.pop()
                continue
            attrs = [{"k": k, "v": double or single.replace('"', "&quot;")} for k, double, single in _ATTRIBUTE.findall(attributes)]
            if len({a["k"] for a in attrs}) < len(attrs):
                raise MarkupError(f"attribute given twice in <{name}>")
            path = f"{stack[-1]}/{name}"
            out.append(("empty" if empty else "start", name, attrs, None, path))
            if not empty:
                stack.append(path)
                names.append(name)
        elif comment is not None:
            out.append(("comment", None, None, comment, stack[-1]))
        elif cdata is not None:
            out.append(("cdata", None, None, cdata, stack[-1]))
        elif instruction is not None:
            kind = "decl" if re.match(r"xml\s", instruction) else "pi"
            out.append((kind, None, None, instruction, stack[-1]))
        else:
            out.append(("doctype", None, None, doctype, stack[-1]))
    if names:
        raise MarkupError(f"<{names[-1]}> is left open")
    return out


def write_markup(pieces: list[tuple]) -> str:
    """Pieces as markup, as ``event_text`` writes them."""
    out = []
    for kind, name, attrs, text, _ in pieces:
        if kind == "text":
            out.append(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif kind in ("start", "empty"):
            out.append("".join([f"<{name}", *(f' {a["k"]}="{a["v"]}"' for a in attrs), "/>" if kind == "empty" else ">"]))
        elif kind == "end":
            out.append(f"</{name}>")
        else:
            before, after = {"cdata": ("<![CDATA[", "]]>"), "comment": ("<!--", "-->"), "doctype": ("<!DOCTYPE", ">")}.get(kind, ("<?", "?>"))
            out.append(f"{before}{text}{after}")
    return "".join(out)


def events(entries: DataFrame, strict: bool = True) -> DataFrame:
    """Markup events of the XML parts, in order. Data that is no UTF-8 is read with replacement characters. A part
    that is not well-formed fails the job; if not ``strict`` it has one event of kind ``error`` with the message."""

    def parsed(part: str, data: bytes | None) -> list[tuple]:
        try:
            return parse_markup((data or b"").decode("utf-8", "replace"))
        except MarkupError as e:
            if strict:
                raise MarkupError(f"{part}: {e}") from None
            return [("error", None, None, str(e), "")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in re.sub("<.*?>>", "", EVENTS).split(", ")]
        attrs = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), attrs, pa.string(), pa.string()]
        for batch in batches:
            for doc, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(doc, part, i, *e) for i, e in enumerate(parsed(part, data))]
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000]), types)], names=names)

    xml = entries.where(is_xml(F.col("name")) & ~F.col("is_dir") & (F.octet_length("data") > 0)).select("doc_id", F.col("name").alias("part_name"), "data")
    return xml.mapInArrow(parse, EVENTS)


def event_text(kind: Column, name: Column, attrs: Column, text: Column) -> Column:
    """One event as markup: ``& < >`` escaped in text, attributes and CDATA as they are."""
    own = F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["k"], F.lit('="'), a["v"], F.lit('"'))), "")
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return (
        F.when(kind == "text", escaped)
        .when(kind == "start", F.concat(F.lit("<"), name, own, F.lit(">")))
        .when(kind == "empty", F.concat(F.lit("<"), name, own, F.lit("/>")))
        .when(kind == "end", F.concat(F.lit("</"), name, F.lit(">")))
        .when(kind == "cdata", F.concat(F.lit("<![CDATA["), text, F.lit("]]>")))
        .when(kind == "comment", F.concat(F.lit("<!--"), text, F.lit("-->")))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE"), text, F.lit(">")))
        .otherwise(F.concat(F.lit("<?"), text, F.lit("?>")))
    )


def serialized(evs: DataFrame) -> DataFrame:
    """(doc_id, name, data): parts written from their events."""
    piece = event_text(F.col("kind"), F.col("name"), F.col("attrs"), F.col("text"))
    rows = evs.select("doc_id", "part_name", F.struct("event_index", piece.alias("s")).alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), "")
    return rows.groupBy("doc_id", F.col("part_name").alias("name")).agg(F.encode(joined, "UTF-8").alias("data"))


def structure_hashes(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, hash): SHA-256 over the events, blind to what translation may change: text in text
    elements, ``xml:space`` and the text of list levels. Attributes are sorted; an empty element equals a start and
    an end."""
    last = F.element_at(F.split(F.col("path"), "/"), -1)
    attrs = F.filter(F.col("attrs"), lambda a: (a["k"] != "xml:space") & ~((F.col("name") == "w:lvlText") & (a["k"] == "w:val")))
    listed = F.array_join(F.transform(F.array_sort(attrs), lambda a: F.concat_ws("=", a["k"], a["v"])), "|")
    opened = F.concat_ws("|", F.lit("S:"), F.col("name"), listed)
    closed = F.concat_ws("|", F.lit("E:"), F.col("name"))
    line = (
        F.when(F.col("kind") == "start", opened)
        .when(F.col("kind") == "empty", F.concat_ws("\n", opened, closed))
        .when(F.col("kind") == "end", closed)
        .when((F.col("kind") == "text") & last.isin("w:t", "a:t", "w:delText"), None)
        .otherwise(F.concat_ws(":", "kind", "text"))
    )
    rows = evs.withColumn("line", line).where("line is not null").select("doc_id", "part_name", F.struct("event_index", "line").alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")
    return rows.groupBy("doc_id", "part_name").agg(F.sha2(joined, 256).alias("hash"))


def full_hashes(evs: DataFrame) -> DataFrame:
    """(doc_id, part_name, hash): SHA-256 over everything the events hold, text with the element it lies in.
    Attributes are sorted; an empty element equals a start and an end."""
    attrs = F.array_join(F.transform(F.array_sort("attrs"), lambda a: F.concat(a["k"], F.lit("="), a["v"], F.lit(";"))), "")
    opened = F.concat(F.lit("S:"), F.col("name"), F.lit("|"), attrs)
    closed = F.concat(F.lit("E:"), F.col("name"))
    declared = [F.regexp_extract("text", rf"\b{k}\s*=\s*[\"']([^\"']*)", 1) for k in ("version", "encoding", "standalone")]
    line = (
        F.when(F.col("kind") == "start", opened)
        .when(F.col("kind") == "empty", F.concat_ws("\n", opened, closed))
        .when(F.col("kind") == "end", closed)
        .when(F.col("kind") == "text", F.concat(F.lit("T:"), F.element_at(F.split("path", "/"), -1), F.lit("|"), "text"))
        .when(F.col("kind") == "decl", F.concat(F.lit("D:"), F.concat_ws("|", *declared)))
        .when(F.col("kind") == "cdata", F.concat(F.lit("C:"), "text"))
        .when(F.col("kind") == "comment", F.concat(F.lit("M:"), "text"))
        .when(F.col("kind") == "pi", F.concat(F.lit("P:"), "text"))
        .otherwise(F.concat(F.lit("Y:"), F.ltrim("text")))
    )
    rows = evs.select("doc_id", "part_name", F.struct("event_index", F.concat(line, F.lit("\n")).alias("line")).alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "")
    return rows.groupBy("doc_id", "part_name").agg(F.sha2(joined, 256).alias("hash"))


def slots(evs: DataFrame) -> DataFrame:
    """Every text, CDATA and list-level text as a slot, numbered by part and event within its document."""
    from pyspark.sql import Window

    level = F.filter(F.col("attrs"), lambda a: a["k"] == "w:val")
    is_level = (F.col("name") == "w:lvlText") & F.col("kind").isin("start", "empty") & (F.size(level) > 0)
    rows = evs.where(F.col("kind").isin("text", "cdata") | is_level)
    order = Window.partitionBy("doc_id").orderBy("part_name", "event_index")
    return rows.select(
        "doc_id",
        F.row_number().over(order).alias("slot_id"),
        "part_name",
        F.when(F.col("kind").isin("text", "cdata"), F.col("kind")).otherwise("attr").alias("kind"),
        "event_index",
        F.when(F.col("kind").isin("text", "cdata"), F.col("text")).otherwise(level[0]["v"]).alias("slot_text"),
    )


def placeholder(prefix: Column, slot_id: Column) -> Column:
    return F.concat(F.lit("__MT_MASK_"), prefix, F.format_string("_%08d__", slot_id))


def masked(evs: DataFrame, prefix: str) -> DataFrame:
    """Events whose slots hold placeholders instead of text."""
    return filled(evs, slots(evs).withColumn("slot_text", placeholder(F.lit(prefix), F.col("slot_id"))))


def filled(evs: DataFrame, values: DataFrame) -> DataFrame:
    """Events with ``slot_text`` of ``values`` (doc_id, part_name, event_index, slot_text) put in; others stay."""
    new = values.select("doc_id", "part_name", "event_index", F.col("slot_text").alias("_new"))
    put = F.transform(F.col("attrs"), lambda a: F.struct(a["k"].alias("k"), F.when(a["k"] == "w:val", F.col("_new")).otherwise(a["v"]).alias("v")))
    attr = F.col("_new").isNotNull() & F.col("kind").isin("start", "empty")
    return (
        evs.join(new, ["doc_id", "part_name", "event_index"], "left")
        .withColumn("attrs", F.when(attr, put).otherwise(F.col("attrs")))
        .withColumn("text", F.when(F.col("_new").isNotNull() & ~attr, F.col("_new")).otherwise(F.col("text")))
        .select(*evs.columns)
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
