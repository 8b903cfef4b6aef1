"""Segments in model output, sentences of a draft, and patches to them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lossless: sentence text up to a mark before white space or the end, or up to a line break; then the white space.
_SPLIT = re.compile(r"(.*?(?:[.!?;。！？；](?=\s|\Z)|(?=\r?\n)|\Z))(\s*)", re.S)
_SPACE = re.compile(r"\s+")
SEGMENTS = "array<struct<text:string,suffix:string>>"


def sentence_segments(text: str) -> list[dict]:
    """Segments whose texts and suffixes joined give the text back."""
    out, at = [], 0
    while at < len(text):
        m = _SPLIT.match(text, at)
        if m.end() == at:
            break
        out.append({"text": m[1], "suffix": m[2]})
        at = m.end()
    return out


def _segments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else sentence_segments(t))


def split_sentences(text: Column) -> Column:
    return F.pandas_udf(_segments, SEGMENTS)(text)


def join_sentences(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(s["text"], s["suffix"])), "")


def segmented_output(text: Column, ids: Column) -> Column:
    """The texts between ``<<MT_SEG:id>>`` and ``<<MT_END:id>>`` for every id, found one after another; null if one
    is missing or out of order."""
    blank = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("at"), blank.alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, i: Column) -> Column:
        opening, closing = F.format_string("<<MT_SEG:%06d>>", i), F.format_string("<<MT_END:%06d>>", i)
        a = F.position(opening, text, state["at"])
        b = F.position(closing, text, a + F.length(opening))
        ok = state["ok"] & (a > 0) & (b > 0)
        body = F.substring(text, a + F.length(opening), b - a - F.length(opening))
        return F.struct(
            F.when(ok, b + F.length(closing)).otherwise(state["at"]).alias("at"),
            F.when(ok, F.concat(state["out"], F.array(body))).otherwise(state["out"]).alias("out"),
            ok.alias("ok"),
        )

    done = F.aggregate(ids, start, step)
    return F.when(done["ok"], done["out"])


def slot_output(text: Column, ids: Column) -> Column:
    """The texts behind ``<<MT_SLOT:id>>`` marks, each up to the next id's mark, the last to the end; null if a mark
    is missing or out of order, or if anything but white space stands before the first."""
    blank = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("open"), blank.alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, i: Column) -> Column:
        mark = F.format_string("<<MT_SLOT:%06d>>", i)
        a = F.position(mark, text, state["at"])
        first = state["open"] == 0
        gap = F.substring(text, F.when(first, F.lit(1)).otherwise(state["open"]), a - F.when(first, F.lit(1)).otherwise(state["open"]))
        ok = state["ok"] & (a > 0) & (~first | gap.rlike(r"(?U)^\s*$"))
        after = a + F.length(mark)
        return F.struct(
            F.when(ok, after).otherwise(state["at"]).alias("at"),
            F.when(ok, after).otherwise(state["open"]).alias("open"),
            F.when(ok & ~first, F.concat(state["out"], F.array(gap))).otherwise(state["out"]).alias("out"),
            ok.alias("ok"),
        )

    def finish(state: Column) -> Column:
        tail = F.substring(text, state["open"], F.length(text) + 1)
        return F.when(state["ok"], F.when(state["open"] == 0, state["out"]).otherwise(F.concat(state["out"], F.array(tail))))

    return F.aggregate(ids, start, step, finish)


def sentence_list(segments: Column, max_bytes: int) -> Column:
    """``[i] sentence`` lines up to ``max_bytes`` (0: no limit), then ``... (truncated)``."""
    lines = F.transform(segments, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s["text"], F.lit("\n")))
    if not max_bytes:
        return F.array_join(lines, "")
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, line: Column) -> Column:
        fits = state["ok"] & (F.octet_length(state["out"]) + F.octet_length(line) <= max_bytes)
        return F.struct(F.when(fits, F.concat(state["out"], line)).otherwise(state["out"]).alias("out"), fits.alias("ok"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["ok"], s["out"]).otherwise(F.concat(s["out"], F.lit("... (truncated)\n"))))


def first_json_object(text: Column) -> Column:
    """The first JSON object in free text, as text; null if there is none."""

    def run(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def find(t: str | None) -> str | None:
            at = t.find("{") if t else -1
            while at >= 0:
                try:
                    _, end = decoder.raw_decode(t, at)
                    return t[at:end]
                except ValueError:
                    at = t.find("{", at + 1)
            return None

        return texts.map(find)

    return F.pandas_udf(run, "string")(text)


# Fixed values below: the order of the checks and the texts of the errors.
def apply_patches(draft: str, patches: list[dict]) -> tuple[str | None, str | None]:
    """(text, error): sentence patches applied in order to a draft; the first that does not fit stops with its error.

    A patch names a sentence by index, its text before and after; texts before must match, white space aside, texts
    after be one line, not empty and different; expected pieces and tokens to keep must hold.
    """
    if not patches:
        return draft, None
    segments = sentence_segments(draft)
    if not segments:
        return None, "cannot apply patches to empty draft"
    plain = lambda t: _SPACE.sub(" ", t.strip())
    for patch in patches:
        kind = patch.get("patch_type", "")
        if kind == "term_map_update":
            continue
        if kind not in ("sentence_replace", "sentence_minimal_edit"):
            return None, f"unknown_patch_type:{kind}"
        index = patch.get("sentence_index")
        if index is None:
            return None, "patch missing sentence_index"
        if index >= len(segments):
            return None, f"patch sentence_index out of range: idx={index} len={len(segments)}"
        current, before, after = segments[index]["text"], (patch.get("before") or "").strip(), (patch.get("after") or "").strip()
        if not after:
            return None, "patch after.sentence is empty"
        if "\n" in after or "\r" in after:
            return None, "patch after.sentence contains newline"
        if plain(current) != plain(before):
            return None, f"patch before.sentence mismatch at idx={index}"
        if plain(after) == plain(before):
            return None, f"patch_no_change idx={index}"
        for name, where in (("expect_before_contains", current), ("expect_after_contains", after)):
            for piece in map(str.strip, patch.get(name) or []):
                if piece and piece not in where:
                    return None, f"patch {name} failed: {piece}"
        for token in map(str.strip, patch.get("must_preserve_tokens") or []):
            count = lambda t, k=token: re.findall(r"\d+", t).count(k) if k.isascii() and k.isdigit() else t.count(k)
            if token and count(before) and count(after) != count(before):
                return None, f"patch must_preserve_tokens mismatch token={token} before={count(before)} after={count(after)}"
        segments[index]["text"] = after
    return "".join(s["text"] + s["suffix"] for s in segments), None


def patched(draft: Column, patches_json: Column) -> Column:
    """struct(text, error) of a draft and a JSON list of patches; a list that is no JSON is an error."""

    def run(drafts: pd.Series, patches: pd.Series) -> pd.DataFrame:
        out = []
        for d, p in zip(drafts, patches):
            try:
                out.append((None, None) if d is None else apply_patches(d, json.loads(p or "[]")))
            except ValueError:
                out.append((None, "patches are no JSON"))
        return pd.DataFrame(out, columns=["text", "error"])

    return F.pandas_udf(run, "text string, error string")(draft, patches_json)
