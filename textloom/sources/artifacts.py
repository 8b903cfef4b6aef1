"""Packages taken apart into artifacts and put together again: masks, offsets, blobs, texts, structure, memory.

A package is one row, so masking, merging and comparing run over rows as they are, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import sanitized_name
from textloom.sources.docx import MarkupError, parse_markup, write_markup

# Versions of the artifacts.
MASK_VERSION, OFFSETS_VERSION, TEXT_VERSION, STRUCTURE_VERSION, MEMORY_SCHEMA = 2, 1, 3, 1, "mt.paragraph_memory.v1"
LEVEL_TEXT, LEVEL_VALUE = "w:lvlText", "w:val"


class ArtifactError(ValueError):
    """Artifacts that do not belong together or are damaged."""


def placeholder(prefix: str, slot: int) -> str:
    return f"__MT_MASK_{prefix}_{slot:08d}__"


def _entries(content: bytes) -> list[tuple[zipfile.ZipInfo, bytes]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        return [(e, b"" if e.is_dir() else archive.read(e)) for e in archive.infolist()]
    except (zipfile.BadZipFile, NotImplementedError) as e:
        raise ArtifactError(f"no readable package: {e}") from None


def _is_xml(name: str) -> bool:
    return name.lower().endswith(".xml")


def _slots_of(pieces: list[tuple]) -> Iterator[tuple[int, str, str]]:
    """(event index, kind, text) of the slots of a part."""
    for i, (kind, name, attrs, text, _) in enumerate(pieces):
        if kind in ("text", "cdata"):
            yield i, {"text": "text", "cdata": "c_data"}[kind], text
        elif kind in ("start", "empty") and name == LEVEL_TEXT:
            value = next((a["v"] for a in attrs if a["k"] == LEVEL_VALUE), None)
            if value is not None:
                yield i, "attr", value


def _put(pieces: list[tuple], at: int, kind: str, text: str) -> None:
    own, name, attrs, old, path = pieces[at]
    if kind == "attr":
        attrs = [{"k": a["k"], "v": text if a["k"] == LEVEL_VALUE else a["v"]} for a in attrs]
        text = old
    pieces[at] = (own, name, attrs, text, path)


def mask_package(content: bytes) -> dict:
    """``prefix``, ``mask`` and ``offsets`` (JSON), ``blobs`` and ``slot_texts`` of a package: every slot in the order
    of entries and events, its text replaced by a placeholder; the data of all entries one after another in the
    blobs, each with its place, length and SHA-256 in the mask."""
    prefix = hashlib.sha256(content).hexdigest()[:10]
    slots, texts, entries, blobs = [], [], [], io.BytesIO()
    for info, data in _entries(content):
        year, month, day, hour, minute, second = info.date_time
        if _is_xml(info.filename) and data and not info.is_dir():
            pieces = parse_markup(data.decode("utf-8", "replace"))
            for at, kind, text in list(_slots_of(pieces)):
                texts.append(text)
                slots.append({"id": len(texts), "part_name": info.filename, "kind": kind, "event_index": at, "attr_name": LEVEL_VALUE if kind == "attr" else None})
                _put(pieces, at, kind, placeholder(prefix, len(texts)))
            data = write_markup(pieces).encode()
        place = {"encoding": "empty"}
        if data:
            place = {"encoding": "external", "value": {"offset": blobs.tell(), "length": len(data), "sha256": hashlib.sha256(data).hexdigest()}}
            blobs.write(data)
        entries.append(
            {
                "name": info.filename,
                "compression": info.compress_type,
                "last_modified": [(year - 1980) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2],
                "unix_mode": info.external_attr >> 16 or None,
                "is_dir": info.is_dir(),
                "data": place,
            }
        )
    mask = {"version": MASK_VERSION, "placeholder_prefix": prefix, "blobs_file": f"{prefix}.blobs", "entries": entries}
    offsets = {"version": OFFSETS_VERSION, "placeholder_prefix": prefix, "slots": slots}
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    return {"prefix": prefix, "mask": dump(mask), "offsets": dump(offsets), "blobs": blobs.getvalue(), "slot_texts": texts}


def decode_entry(data: dict, blobs: bytes | None) -> bytes:
    """The data of a mask's entry: nothing, text, base64 or a stretch of the blobs, whose bounds and hash must fit."""
    kind, value = data["encoding"], data.get("value")
    if kind == "empty":
        return b""
    if kind == "utf8":
        return value.encode()
    if kind == "base64":
        try:
            return base64.b64decode(value, validate=True)
        except ValueError:
            raise ArtifactError("no base64") from None
    if kind != "external":
        raise ArtifactError(f"unknown encoding {kind}")
    if blobs is None:
        raise ArtifactError("blobs are missing")
    start, stop = value["offset"], value["offset"] + value["length"]
    if not 0 <= start <= stop <= len(blobs):
        raise ArtifactError(f"blob out of range: {start} to {stop} of {len(blobs)}")
    if hashlib.sha256(blobs[start:stop]).hexdigest() != value["sha256"]:
        raise ArtifactError(f"blob differs from its hash at {start}")
    return blobs[start:stop]


def merge_package(mask: str, offsets: str, blobs: bytes | None, prefix: str, slot_texts: list[str]) -> bytes:
    """The package of a mask with ``slot_texts`` in its slots. The prefixes must be equal, the slots numbered from 1
    without a gap and as many as the texts, every placeholder at its event, and none left over."""
    own, places = json.loads(mask), json.loads(offsets)
    if not own["placeholder_prefix"] == places["placeholder_prefix"] == prefix:
        raise ArtifactError("placeholder prefixes differ")
    slots = places["slots"]
    if sorted(s["id"] for s in slots) != list(range(1, len(slots) + 1)):
        raise ArtifactError("slot ids are not 1 to n")
    if len(slots) != len(slot_texts):
        raise ArtifactError(f"{len(slot_texts)} texts for {len(slots)} slots")
    data = [decode_entry(e["data"], blobs) for e in own["entries"]]
    parts = {e["name"]: parse_markup(d.decode("utf-8", "replace")) for e, d in zip(own["entries"], data) if _is_xml(e["name"]) and d}
    for slot in slots:
        pieces, at, expected = parts.get(slot["part_name"]), slot["event_index"], placeholder(prefix, slot["id"])
        where = f"{slot['part_name']}#{at}"
        if pieces is None or not 0 <= at < len(pieces):
            raise ArtifactError(f"no event {where}")
        held = {i: (kind, text) for i, kind, text in _slots_of(pieces[at : at + 1])}.get(0)
        if held != (slot["kind"], expected):
            raise ArtifactError(f"no placeholder of slot {slot['id']} at {where}")
        _put(pieces, at, slot["kind"], slot_texts[slot["id"] - 1])
    for name, pieces in parts.items():
        if any(prefix in (text or "") for kind, _, _, text, _ in pieces if kind in ("text", "cdata")) or any(
            prefix in a["v"] for kind, _, attrs, _, _ in pieces if kind in ("start", "empty") for a in attrs
        ):
            raise ArtifactError(f"placeholder left over in {name}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for e, d in zip(own["entries"], data):
            day, time = e["last_modified"]
            stamp = ((day >> 9) + 1980, day >> 5 & 15, day & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
            info = zipfile.ZipInfo(e["name"], stamp)
            info.compress_type, info.external_attr = e["compression"], (e["unix_mode"] or 0) << 16
            archive.writestr(info, write_markup(parts[e["name"]]).encode() if e["name"] in parts else d)
    return out.getvalue()


MASKS = "doc_id string, prefix string, mask string, offsets string, blobs binary, slot_texts array<string>, error string"


def masked_packages(packages: DataFrame) -> DataFrame:
    """(doc_id, prefix, mask, offsets, blobs, slot_texts, error) of packages (doc_id, content). A package that cannot
    be read, null ones too, has an error and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    row = {"doc_id": doc, **mask_package(content or b"")}
                except (ArtifactError, MarkupError) as e:
                    row = {"doc_id": doc, "error": str(e)}
                yield pa.RecordBatch.from_pylist([row], schema=_MASK_SCHEMA)

    return packages.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, MASKS)


_MASK_SCHEMA = pa.schema(
    [("doc_id", pa.string()), ("prefix", pa.string()), ("mask", pa.string()), ("offsets", pa.string()), ("blobs", pa.binary()),
     ("slot_texts", pa.list_(pa.string())), ("error", pa.string())]
)


def merged_packages(masks: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(doc_id, content, error) of rows (doc_id, mask, offsets, blobs, slot_texts and the texts' ``prefix``): the
    package, or why it cannot be made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *own in zip(*(c.to_pylist() for c in batch.columns)):
                content = error = None
                try:
                    if any(x is None for x in (own[0], own[1], own[3], own[4])):
                        raise ArtifactError("artifacts are missing")
                    content = merge_package(*own)
                except (ArtifactError, MarkupError, KeyError, json.JSONDecodeError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "content": content, "error": error}], schema=_CONTENT)

    return masks.select("doc_id", "mask", "offsets", "blobs", prefix, "slot_texts").mapInArrow(run, "doc_id string, content binary, error string")


_CONTENT = pa.schema([("doc_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _same_markup(a: bytes, b: bytes) -> bool:
    """Whether two parts hold the same, attributes in any order, an empty element as a start and an end."""

    def flat(data: bytes) -> list[tuple]:
        out = []
        for kind, name, attrs, text, _ in parse_markup(data.decode("utf-8", "replace")):
            if kind in ("start", "empty"):
                out.append(("start", name, sorted((a["k"], a["v"]) for a in attrs), None))
            if kind in ("end", "empty"):
                out.append(("end", name, None, None))
            elif kind != "start":
                out.append((kind, None, None, text))
        return out

    return flat(a) == flat(b)


def compare_packages(one: bytes, other: bytes) -> str | None:
    """The first difference of two packages, entry by entry in their order, or None: their number, names, methods,
    times, kinds, bytes of what is no markup, and the content of markup."""
    a, b = _entries(one), _entries(other)
    if len(a) != len(b):
        return f"entry count: {len(a)} and {len(b)}"
    for (x, xd), (y, yd) in zip(a, b):
        if x.filename != y.filename:
            return f"entry name: {x.filename} and {y.filename}"
        for what, p, q in (("method", x.compress_type, y.compress_type), ("time", x.date_time, y.date_time), ("kind", x.is_dir(), y.is_dir())):
            if p != q:
                return f"entry {what}: {x.filename}"
        if xd != yd and (not _is_xml(x.filename) or not xd or not yd or not _same_markup(xd, yd)):
            return f"entry content: {x.filename}"
    return None


def package_differences(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """``pairs`` with ``difference``: null where both packages hold the same, else what differs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    found.append(compare_packages(a or b"", b or b""))
                except (ArtifactError, MarkupError) as e:
                    found.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "difference"])

    return pairs.select("doc_id", one, other).mapInArrow(run, "doc_id string, difference string")


def entry_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, name, difference) of hashes (doc_id, part_name, hash) of two sets: ``missing`` in the other,
    ``extra`` there, or ``changed``."""
    a, b = one.select("doc_id", "part_name", F.col("hash").alias("_a")), other.select("doc_id", "part_name", F.col("hash").alias("_b"))
    what = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, ["doc_id", "part_name"], "full").select("doc_id", F.col("part_name").alias("name"), what.alias("difference")).where("difference is not null")


def pure_texts(masks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, artifact): the text artifact as JSON: version, prefix, the texts of all slots, and the paragraphs.
    A document's paragraphs, which came from one package, meet in one row."""
    names = ["para_id", "part_name", "scope_key", "xml_event_index", "container", "table_index", "row_index", "cell_index", "p_style", "num_id", "num_ilvl", "outline_lvl", "text"]
    rows = paragraphs.withColumnRenamed("event_index", "xml_event_index")
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("paragraphs"))
    none = F.array().cast(listed.schema["paragraphs"].dataType)
    whole = F.struct(F.lit(TEXT_VERSION).alias("version"), F.col("prefix").alias("placeholder_prefix"), "slot_texts", F.coalesce("paragraphs", none).alias("paragraphs"))
    return masks.where("error is null").join(listed, "doc_id", "left").select("doc_id", F.to_json(whole).alias("artifact"))


def structure_artifacts(tree: DataFrame, masks: DataFrame) -> DataFrame:
    """(doc_id, artifact): adjacency rows of ``structure_tree`` nested into one JSON tree a document. A document's
    nodes meet in one task, which holds one document at a time."""
    fields = ["kind", "part_name", "para_id", "heading_level", "num_id", "ilvl", "text"]

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prefix, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                root: dict = {"kind": "root", "children": []}
                made: dict[tuple, dict] = {}
                for n in nodes:
                    level = {"heading": "heading_level", "part": None}.get(n["kind"], "ilvl")
                    own = {"kind": n["kind"], "part_name": n["part_name"], "para_id": n["para_id"], level: n["level"], "num_id": n["num_id"], "text": n["text"]}
                    node = {k: own[k] for k in fields if own.get(k) is not None} | {"children": []}
                    made[n["part_name"], n["node_id"]] = node
                    (root if n["parent_id"] is None else made[n["part_name"], n["parent_id"]])["children"].append(node)
                out.append(json.dumps({"version": STRUCTURE_VERSION, "placeholder_prefix": prefix, "root": root}, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "artifact"])

    order = (F.col("part_name") != "word/document.xml").alias("other")
    listed = tree.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, "part_name", "node_id", "parent_id", "kind", "para_id", "level", "num_id", "text"))).alias("nodes"))
    return masks.where("error is null").select("doc_id", "prefix").join(listed, "doc_id").mapInArrow(nest, "doc_id string, artifact string")


def memory_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, artifact): the paragraph memory of a file as JSON behind a byte order mark, records by tu_id. A
    record is a paragraph if its scope is one, else ``other``; translations are those given."""
    paragraph = F.col("scope_key").contains("#w:p") | F.col("scope_key").contains("#a:p")
    record = F.struct(
        "tu_id", "part_name", "scope_key", "para_style", F.when(paragraph, "paragraph").otherwise("other").alias("tu_kind"),
        F.col("source_surface").alias("原文"), F.col("frozen_surface").alias("冻结原文"), F.col("nt_map").alias("不可翻译映射"), F.col("understanding").alias("上下文理解"),
        F.col("proper_nouns").alias("专有名词"), F.col("terms").alias("术语"), F.col("translation_a").alias("译文A"), F.col("translation_b").alias("译文B"),
        F.col("final_translation").alias("最终译文"),
    )
    keyed = records.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("tu_id", "rec_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("j")))).alias("r"))
    head = F.to_json(F.struct(F.lit(MEMORY_SCHEMA).alias("schema"), "source_lang", "target_lang", "model_a", "model_b", "agent_model"), {"ignoreNullFields": "false"})
    body = F.array_join(F.transform("r", lambda x: x["j"]), ",")
    whole = F.concat(F.lit("﻿"), F.expr("''"), F.regexp_replace(head, r"\}$", ""), F.lit(',"paragraphs":['), body, F.lit("]}"))
    return keyed.join(files, "file_id").select("file_id", whole.alias("artifact"))


def write_memory(records: DataFrame, files: DataFrame, path: str, stage: str) -> None:
    """The memory of a stage below ``path``, one folder a stage, replaced if it is there."""
    memory_files(records, files).withColumn("stage", F.lit(stage)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def trace_rows(df: DataFrame, name: Column, prompt: Column, output: Column) -> DataFrame:
    """(file_name, content) of what a model was asked and gave: two texts a row, under names fit for files."""
    both = F.explode(F.array(F.struct(F.lit("prompt").alias("what"), prompt.alias("content")), F.struct(F.lit("output").alias("what"), output.alias("content"))))
    named = df.select(name.alias("_name"), both.alias("t"))
    return named.select(F.concat(sanitized_name(F.col("_name")), F.lit("."), F.col("t.what"), F.lit(".txt")).alias("file_name"), "t.content")


def blob_offsets(entries: DataFrame) -> DataFrame:
    """(doc_id, entry_idx, offset, length, sha256): where the data of each entry lies when all follow one another."""
    before = Window.partitionBy("doc_id").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("data").cast("bigint")
    return entries.select("doc_id", "entry_idx", F.coalesce(F.sum(length).over(before), F.lit(0)).alias("offset"), length.alias("length"), F.sha2("data", 256).alias("sha256"))


def canonical_hash(data: bytes, text_tags: frozenset[str] = frozenset({"w:t", "a:t", "w:delText"}), without: frozenset[str] = frozenset({"xml:space"})) -> str:
    """SHA-256 of a part's canonical form: no comments or declarations, attributes in order, empty elements opened,
    CDATA as text; texts of ``text_tags`` and the attributes ``without`` do not count."""
    out = []
    for kind, name, attrs, text, path in parse_markup(data.decode("utf-8", "replace")):
        if kind in ("start", "empty"):
            out.append(f"<{name}" + "".join(f' {k}="{v}"' for k, v in sorted((a["k"], a["v"]) for a in attrs) if k not in without) + ">")
        if kind in ("end", "empty"):
            out.append(f"</{name}>")
        elif kind in ("text", "cdata") and path.rsplit("/", 1)[-1] not in text_tags:
            out.append(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif kind == "pi":
            out.append(f"<?{text}?>")
    return hashlib.sha256("".join(out).encode()).hexdigest()


def canonical_hashes(entries: DataFrame) -> DataFrame:
    """(doc_id, part_name, hash) of the XML parts by ``canonical_hash``; null for a part that is not well-formed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(2).to_pylist():
                try:
                    found.append(canonical_hash(data))
                except MarkupError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "part_name", "hash"])

    xml = entries.where(F.lower("name").endswith(".xml") & (F.octet_length("data") > 0)).select("doc_id", F.col("name").alias("part_name"), "data")
    return xml.mapInArrow(run, "doc_id string, part_name string, hash string")
