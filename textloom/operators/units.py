"""Units of translation out of markup, and translations written back into it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.functions.masking import unfreeze
from textloom.functions.text import blank, token
from textloom.operators.projection import shares
from textloom.operators.segments import slot_output

PARAGRAPHS_ABOVE = r"/w:p(?=/|$)"
_SENTINEL = re.compile(f"({P.SENTINEL})")
_CONTROL = re.compile(f"({P.CONTROL})")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of every key: of duplicates, the last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def paragraph_slots(evs: DataFrame, paragraphs: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, para_id, part_name, scope_key, p_style, slot_ids, source_surface): for every paragraph its slots in
    order, and their texts behind slot tokens, ended by slot 0; paragraphs without slots have neither.

    A slot belongs to the outermost paragraph it lies in if it is the text of a text element and lies in no
    paragraph nested in that one. Of paragraphs found twice at one event, as shared headers are, the last gets the
    slots. Slots meet events by part, event and kind.
    """
    upto = Window.partitionBy("doc_id", "part_name").orderBy("event_index").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.size(F.regexp_extract_all("path", F.lit(PARAGRAPHS_ABOVE), F.lit(0)))
    opened = (F.col("kind") == "start") & (F.col("name") == "w:p") & (depth == 1)
    placed = evs.withColumn("para_event", F.last(F.when(opened, F.col("event_index")), ignorenulls=True).over(upto))
    texts = placed.where(F.col("kind").isin("text", "cdata") & F.col("path").endswith("/w:t") & (depth == 1))
    own = texts.select("doc_id", "part_name", "event_index", "kind", "para_event").join(slots, ["doc_id", "part_name", "event_index", "kind"])
    ordered = F.array_sort(F.collect_list(F.struct("event_index", "slot_id", "slot_text")))
    held = own.groupBy("doc_id", "part_name", F.col("para_event").alias("event_index")).agg(ordered.alias("s"))
    last = latest(paragraphs.select("doc_id", "part_name", "event_index", "para_id"), ["doc_id", "part_name", "event_index"], "para_id")
    surface = F.concat(F.array_join(F.transform("s", lambda x: F.concat(token("SLOT", x["slot_id"]), x["slot_text"])), ""), token("SLOT", 0))
    filled = held.join(last, ["doc_id", "part_name", "event_index"]).select("doc_id", "para_id", F.transform("s", lambda x: x["slot_id"]).alias("slot_ids"), surface.alias("source_surface"))
    return paragraphs.select("doc_id", "para_id", "part_name", "scope_key", "p_style").join(filled, ["doc_id", "para_id"], "left").select(
        "doc_id", "para_id", "part_name", "scope_key", "p_style",
        F.coalesce("slot_ids", F.array().cast("array<int>")).alias("slot_ids"), F.coalesce("source_surface", F.lit("")).alias("source_surface"),
    )


def slot_texts(units: DataFrame, translated: str, nt_map: str, slot_count: str) -> DataFrame:
    """``units`` with ``texts``, an array of (slot_id, text) that a translation gives the slots in ``slot_ids``, and
    ``error``: slot_output (markers missing or out of order, or text before the first), slot_terminator_has_content,
    or slot_id_out_of_range (beyond ``slot_count``). Units without slots have neither texts nor error."""
    ids = F.concat("slot_ids", F.array(F.lit(0)))
    step = units.withColumn("_p", slot_output(F.col(translated), ids))
    none = F.size("slot_ids") == 0
    error = (
        F.when(none, None)
        .when(F.col("_p").isNull(), "slot_output")
        .when(~blank(F.element_at("_p", -1)), "slot_terminator_has_content")
        .when(F.array_max("slot_ids") > F.col(slot_count), "slot_id_out_of_range")
    )
    texts = F.transform(F.arrays_zip(F.col("slot_ids").alias("i"), F.col("_p").alias("t")), lambda x: F.struct(x["i"].alias("slot_id"), unfreeze(x["t"], F.col(nt_map)).alias("text")))
    good = F.filter(texts, lambda x: x["slot_id"].isNotNull())
    return step.withColumn("error", error).withColumn("texts", F.when(F.col("error").isNull() & ~none, good)).drop("_p")


# --- units with formatted spans ----------------------------------------------------------------------------------

SPAN = "struct<style_sig:string,nodes:array<struct<elem_index:int,text_index:int,attr:string,text:string>>,text:string>"
UNITS = f"doc_id string, part_name string, start_index int, scope_key string, para_style string, source_surface string, spans array<{SPAN}>"
_NODE = pa.struct([("elem_index", pa.int32()), ("text_index", pa.int32()), ("attr", pa.string()), ("text", pa.string())])
_UNIT_SCHEMA = pa.schema(
    [("doc_id", pa.string()), ("part_name", pa.string()), ("start_index", pa.int32()), ("scope_key", pa.string()), ("para_style", pa.string()),
     ("source_surface", pa.string()), ("spans", pa.list_(pa.struct([("style_sig", pa.string()), ("nodes", pa.list_(_NODE)), ("text", pa.string())])))]
)

# Elements that stand for control tokens, by the kind of paragraph.
CONTROLS = {
    "w:p": {"w:tab": "<<MT_TAB>>", "w:br": "<<MT_BR>>", "w:cr": "<<MT_BR>>", "w:noBreakHyphen": "<<MT_NBH>>", "w:softHyphen": "<<MT_SHY>>"},
    "a:p": {"a:tab": "<<MT_TAB>>", "a:br": "<<MT_BR>>"},
}
# What makes up a run's style signature, by element, in order.
W_FLAGS, W_VALUES = ("w:b", "w:i", "w:strike"), ("w:u", "w:color", "w:highlight", "w:sz", "w:szCs", "w:rStyle")
W_FONTS = ("w:ascii", "w:hAnsi", "w:eastAsia", "w:cs")
A_VALUES = ("b", "i", "u", "strike", "sz")


def switched_on(value: str | None) -> bool:
    """A toggle property by its value: on unless it says 0, false, off or none."""
    return value is None or value.strip().lower() not in ("0", "false", "off", "none")


def run_signature(kind: str, seen: dict[str, dict[str, str]] | None) -> str:
    """The style of a run as text; ``seen`` maps property elements to their attributes, None without properties."""
    if seen is None:
        return "w:rPr()" if kind == "w:p" else "a:rPr()"
    if kind == "a:p":
        own = seen.get("a:rPr", {})
        return "|".join([*(f"{k}={own.get(k, '')}" for k in A_VALUES), f"typeface={seen.get('a:latin', {}).get('typeface', '')}"])
    flag = {k: "1" if k in seen and switched_on(seen[k].get("w:val")) else "0" for k in W_FLAGS}
    value = {k: seen.get(k, {}).get("w:val", "") for k in W_VALUES}
    fonts = "|".join(seen.get("w:rFonts", {}).get(k, "") for k in W_FONTS)
    shown = [("b", flag["w:b"]), ("i", flag["w:i"]), ("u", value["w:u"]), ("strike", flag["w:strike"]), *((k[2:], value[k]) for k in W_VALUES[1:]), ("fonts", fonts)]
    return "|".join(f"{k}={v}" for k, v in shown)


class _Paragraph:
    def __init__(self, kind: str, start: int) -> None:
        self.kind, self.start, self.style = kind, start, None
        self.pieces: list[str] = []
        self.spans: list[dict] = []
        self.joined = False

    def control(self, token_: str) -> None:
        self.pieces.append(token_)
        self.joined = False

    def text(self, signature: str, elem: int, index: int, text: str) -> None:
        self.pieces.append(text)
        if not (self.joined and self.spans[-1]["style_sig"] == signature):
            self.spans.append({"style_sig": signature, "nodes": [], "text": ""})
        self.joined = True
        self.spans[-1]["nodes"].append({"elem_index": elem, "text_index": index, "attr": None, "text": text})
        self.spans[-1]["text"] += text


def part_units(events: Iterator[dict]) -> Iterator[dict]:
    """Units of one part's events in order: paragraphs with visible text, of either kind, and texts of list levels."""
    para: _Paragraph | None = None
    runs: list[dict[str, dict[str, str]] | None] = []
    in_format, holder = False, None
    for e in events:
        kind, name, at = e["kind"], e["name"], e["event_index"]
        attrs = {a["k"]: a["v"] for a in reversed(e["attrs"] or [])} if kind in ("start", "empty") else {}
        if kind in ("start", "empty") and name == "w:lvlText" and attrs.get("w:val", "").strip():
            node = {"elem_index": at, "text_index": None, "attr": "w:val", "text": attrs["w:val"]}
            yield {"start_index": at, "scope": "w:lvlText", "para_style": None, "source_surface": attrs["w:val"], "spans": [{"style_sig": "attr", "nodes": [node], "text": attrs["w:val"]}]}
        if kind == "start" and name in CONTROLS:
            para, in_format = _Paragraph(name, at), False
        if para is None:
            continue
        family = para.kind[0]
        if kind in ("start", "empty"):
            if name == "w:pStyle" and family == "w" and attrs.get("w:val", "").strip():
                para.style = attrs["w:val"].strip()
            if kind == "start" and name == f"{family}:r":
                runs.append(None)
            if kind == "start" and name == f"{family}:rPr":
                in_format = True
                if runs:
                    runs[-1] = runs[-1] or {}
            if kind == "start" and name in ("w:t", "a:t"):
                holder = at
            if kind == "start" and in_format and runs and runs[-1] is not None:
                runs[-1][name] = attrs
            if kind == "empty" and name in CONTROLS[para.kind]:
                para.control(CONTROLS[para.kind][name])
        elif kind == "text" and holder is not None:
            para.text(run_signature(f"{family}:p", runs[-1] if runs else None), holder, at, e["text"])
        elif kind == "end":
            if name == f"{family}:rPr":
                in_format = False
            elif name == f"{family}:r" and runs:
                runs.pop()
            elif name in ("w:t", "a:t"):
                holder = None
            elif name == para.kind:
                if any(s["text"].strip() for s in para.spans):
                    yield {"start_index": para.start, "scope": para.kind, "para_style": para.style, "source_surface": "".join(para.pieces), "spans": para.spans}
                para = None


def translation_units(evs: DataFrame) -> DataFrame:
    """(doc_id, tu_id, part_name, scope_key, para_style, source_surface, spans) of the paragraphs and list levels of
    all parts. Spans are stretches of one style between control elements, with the nodes they came from; properties
    count in run elements with a start and an end. A part's events are sorted and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (doc, part), own in groupby(rows, key=lambda r: (r["doc_id"], r["part_name"])):
            held: list[dict] = []
            for u in part_units(own):
                held.append({"doc_id": doc, "part_name": part, "scope_key": f"{part}#{u.pop('scope')}@{u['start_index']}", **u})
                if len(held) == 2000:
                    yield pa.RecordBatch.from_pylist(held, schema=_UNIT_SCHEMA)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_UNIT_SCHEMA)

    columns = ["doc_id", "part_name", "event_index", "kind", "name", "attrs", "text"]
    units = evs.select(*columns).repartition("doc_id", "part_name").sortWithinPartitions("doc_id", "part_name", "event_index").mapInArrow(run, UNITS)
    order = Window.partitionBy("doc_id").orderBy(F.col("part_name") != "word/document.xml", "part_name", "start_index")
    return units.select("doc_id", F.row_number().over(order).alias("tu_id"), "part_name", "scope_key", "para_style", "source_surface", "spans")


def _tokens_and_letters(text: str) -> list[str]:
    out: list[str] = []
    for i, piece in enumerate(_SENTINEL.split(text)):
        out.extend([piece] if i % 2 else piece)
    return out


def project_spans(weights: list[int], blanks: list[bool], frozen: str, target: str) -> tuple[list[str] | None, str | None]:
    """(texts, error): a translation shared out over spans.

    ``weights`` are the spans' sizes in UTF-8 bytes and ``blanks`` whether they are blank. Between control tokens, of
    which source and translation must have the same, the spans that make up the source's bytes share the letters of
    the translation by largest remainders; tokens cost nothing and go where the letter before them went. Spans left
    over at the end are empty, if they were blank.
    """
    source_parts, target_parts = _CONTROL.split(frozen), _CONTROL.split(target)
    if source_parts[1::2] != target_parts[1::2]:
        return None, "control_token_sequence_mismatch"
    out: list[str] = []
    for part, text in zip(source_parts[::2], target_parts[::2]):
        first, size, filled = len(out), len(part.encode()), 0
        while first < len(weights) and filled < size:
            filled += weights[first]
            first += 1
        own = weights[len(out) : first]
        if not own:
            if text.strip():
                return None, "text_for_empty_block"
            continue
        letters = _tokens_and_letters(text)
        wanted = shares(sum(len(x) == 1 for x in letters), [max(1, w) for w in own])
        slices: list[list[str]] = [[]]
        plain = 0
        for x in letters:
            slices[-1].append(x)
            plain += len(x) == 1
            if len(slices) < len(own) and plain >= wanted[len(slices) - 1]:
                slices.append([])
                plain = 0
        out += ["".join(s) for s in slices] + [""] * (len(own) - len(slices))
    if not all(blanks[len(out) :]):
        return None, "span_coverage_mismatch"
    return out + [""] * (len(weights) - len(out)), None




def projected_spans(units: DataFrame, frozen: str, translated: str, nt_map: str) -> DataFrame:
    """``units`` with ``span_texts``, the translation shared out over their spans and unfrozen, and ``error``; null
    translations have neither."""

    def run(weights: pd.Series, blanks: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else project_spans([int(x) for x in w], [bool(x) for x in b], s or "", t) for w, b, s, t in zip(weights, blanks, sources, targets)]
        return pd.DataFrame(rows, columns=["texts", "error"])

    sizes = F.transform("spans", lambda s: F.octet_length(s["text"]))
    empty = F.transform("spans", lambda s: blank(s["text"]))
    shared = F.pandas_udf(run, "texts array<string>, error string")(sizes, empty, F.col(frozen), F.col(translated))
    step = units.withColumn("_p", shared)
    return step.select(*units.columns, F.transform("_p.texts", lambda t: unfreeze(t, F.col(nt_map))).alias("span_texts"), F.col("_p.error").alias("error"))


def written(evs: DataFrame, writes: DataFrame) -> DataFrame:
    """Events with ``writes`` (doc_id, part_name, elem_index, text_index, attr, text) in them: the text of a text
    element, or an attribute. An element whose text begins or ends with a space keeps spaces (``xml:space``)."""
    texts = writes.where("text_index is not null").select("doc_id", "part_name", F.col("text_index").alias("event_index"), F.col("text").alias("_text"))
    edge = F.col("text").startswith(" ") | F.col("text").endswith(" ")
    own = writes.select(
        "doc_id", "part_name", F.col("elem_index").alias("event_index"), F.coalesce("attr", F.lit("xml:space")).alias("_k"),
        F.when(F.col("attr").isNotNull(), F.col("text")).when(edge, "preserve").alias("_v"),
    ).where("_v is not null")
    one = own.groupBy("doc_id", "part_name", "event_index").agg(F.first("_k").alias("_k"), F.first("_v").alias("_v"))
    pair = F.struct(F.col("_k").alias("k"), F.col("_v").alias("v"))
    has = F.exists("attrs", lambda a: a["k"] == F.col("_k"))
    put = F.when(has, F.transform("attrs", lambda a: F.when(a["k"] == F.col("_k"), pair).otherwise(a))).otherwise(F.concat("attrs", F.array(pair)))
    keys = ["doc_id", "part_name", "event_index"]
    return (
        evs.join(texts, keys, "left")
        .join(one, keys, "left")
        .withColumn("text", F.coalesce("_text", "text"))
        .withColumn("attrs", F.when(F.col("_k").isNull(), F.col("attrs")).otherwise(put))
        .select(*evs.columns)
    )


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of every key the row that comes first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def issues_of_units(issues: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Issues whose unit exists, with the unit's columns; others are skipped. Units are unique by ``key``."""
    return issues.join(units, key, "inner")


def slot_lookup(ids: Column, texts: Column) -> Column:
    """The texts at the positions ``ids`` (from 1) of an array of slot texts; null beyond its end."""
    return F.transform(ids, lambda i: F.try_element_at(texts, i))
