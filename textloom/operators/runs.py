"""Merging adjacent runs of text that are formatted alike."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.sources.docx import EVENTS

Event = dict
PRESERVE = {"k": "xml:space", "v": "preserve"}


class _Run:
    """A run that holds nothing but formatting and text: its own start and end, formatting, and text."""

    def __init__(self, events: list[Event]) -> None:
        self.start, self.end, self.format, self.texts = events[0], events[-1], [], []
        self.simple, inside, self.holder = True, None, None
        for e in events[1:-1]:
            if inside is None and e["kind"] in ("start", "empty") and e["name"] in ("w:rPr", "w:t"):
                self.simple &= e["name"] == "w:t" or not (self.format or self.holder)
                if e["name"] == "w:t":
                    self.holder = self.holder or e
                    self.preserve = getattr(self, "preserve", False) or PRESERVE in (e["attrs"] or [])
                else:
                    self.format.append(e)
                inside = e["name"] if e["kind"] == "start" else None
            elif inside == "w:rPr":
                self.format.append(e)
                inside = None if e["kind"] == "end" and e["name"] == "w:rPr" else inside
            elif inside == "w:t" and e["kind"] == "text":
                self.texts.append(e["text"])
            elif inside == "w:t" and e["kind"] == "end":
                inside = None
            else:
                self.simple = False
        self.simple &= self.holder is not None
        self.alike = [(e["kind"], e["name"], sorted((a["k"], a["v"]) for a in e["attrs"] or []), e["text"]) for e in self.format]

    def take(self, other: _Run) -> None:
        self.texts += other.texts
        self.preserve |= other.preserve

    def events(self) -> list[Event]:
        attrs = [a for a in self.holder["attrs"] or [] if a["k"] != "xml:space"] + [PRESERVE] * self.preserve
        path = self.holder["path"]
        text = {"kind": "text", "name": None, "attrs": None, "text": "".join(self.texts), "path": path}
        middle = [text] if text["text"] else []
        opened = {**self.holder, "kind": "start", "attrs": attrs}
        closed = {"kind": "end", "name": "w:t", "attrs": None, "text": None, "path": path}
        return [self.start, *self.format, opened, *middle, closed, self.end]


def merge_events(events: list[Event]) -> list[Event]:
    """The events of a part with neighbouring simple runs of like formatting, directly in a paragraph, made one;
    runs in hyperlinks or insertions stay as they are. Whatever stands between two
    runs keeps them apart; the first run's attributes stay; space is preserved if it was in any."""
    out: list[Event] = []
    held: _Run | None = None
    at = 0
    while at < len(events):
        e = events[at]
        if e["kind"] == "start" and e["name"] == "w:r" and e["path"].endswith("/w:p/w:r"):
            close = next((k for k in range(at + 1, len(events)) if events[k]["kind"] == "end" and events[k]["path"] == e["path"]), None)
            if close is not None:
                run = _Run(events[at : close + 1])
                if run.simple and held and held.alike == run.alike:
                    held.take(run)
                else:
                    out += held.events() if held else []
                    held = run if run.simple else None
                    out += [] if run.simple else events[at : close + 1]
                at = close + 1
                continue
        out += held.events() if held else []
        held = None
        out.append(e)
        at += 1
    return out + (held.events() if held else [])


def merged_runs(evs: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """Events with runs merged in the parts that match one of the ``*`` patterns (None: in all), numbered anew. A
    part's events, which were one file, are held together."""
    fits = None if parts is None else re.compile("|".join(".*".join(map(re.escape, p.split("*"))) for p in parts) or r"(?!)")
    names = ["doc_id", "part_name", "event_index", "kind", "name", "attrs", "text", "path"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (doc, part), own in groupby(rows, key=lambda r: (r["doc_id"], r["part_name"])):
            events = [{k: r[k] for k in names[3:]} for r in own]
            if fits is None or fits.fullmatch(part):
                events = merge_events(events)
            numbered = [{"doc_id": doc, "part_name": part, "event_index": i, **e} for i, e in enumerate(events)]
            for k in range(0, len(numbered), 20_000):
                yield pa.RecordBatch.from_pylist(numbered[k : k + 20_000], schema=SCHEMA)

    return evs.select(*names).repartition("doc_id", "part_name").sortWithinPartitions("doc_id", "part_name", "event_index").mapInArrow(merge, EVENTS)


SCHEMA = pa.schema(
    [("doc_id", pa.string()), ("part_name", pa.string()), ("event_index", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
     ("attrs", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), ("text", pa.string()), ("path", pa.string())]
)
