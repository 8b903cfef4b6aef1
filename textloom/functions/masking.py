"""Masking: what must not be translated becomes tokens, and comes back."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import patterns as P

#: Stands between pieces while a text is taken apart; one that the text holds itself is hidden behind HIDDEN.
CUT, HIDDEN = "\u0001", "\u0002\u0003"


_SENTINEL = regex.compile(P.SENTINEL)
#: Characters without which an alternative of the mask cannot match; it is left out of the search then.
_NEEDS = ("®™©", None, ":", "@", "\\", "{", "%")


@lru_cache(maxsize=256)
def _search(present: tuple[bool, ...]) -> regex.Pattern:
    kept = [a for a, use in zip(P.FREEZE_ALTERNATIVES, present + (True,) * len(P.FREEZE_ALTERNATIVES)) if use]
    return regex.compile("|".join([P.SENTINEL, *kept]))


@lru_cache(maxsize=1)
def _legacy() -> regex.Pattern:
    return regex.compile(f"{P.SENTINEL}|(?i:{'|'.join(P.LEGACY_ALTERNATIVES)})")


def _matches(text: str):
    present = tuple(need is None or any(c in text for c in need) for need in _NEEDS)
    return _search(present).finditer(text)


FROZEN = "frozen string, nt array<struct<token:string,original:string>>, spans array<struct<src_start:int,src_end:int,token:string,original:string>>"


def freeze_text(text: str, legacy: bool = False) -> tuple[str, list[dict], list[dict]]:
    """The frozen text, its tokens with their originals, and the spans in UTF-8 bytes. The older (``legacy``) mask
    freezes whole references, and every place has a token of its own."""
    tokens: dict = {}
    pieces, spans, at, offset = [], [], 0, 0
    for m in _legacy().finditer(text) if legacy else _matches(text):
        gap, found = text[at : m.start()], m.group()
        pieces.append(gap)
        start = offset + len(gap.encode())
        offset = start + len(found.encode())
        at = m.end()
        if _SENTINEL.fullmatch(found):
            pieces.append(found)
            continue
        name = tokens.setdefault((found, len(tokens) if legacy else 0), f"<<MT_NT:{len(tokens) + 1:0{P.NT_WIDTH}d}>>")
        pieces.append(name)
        spans.append({"src_start": start, "src_end": offset, "token": name, "original": found})
    pieces.append(text[at:])
    return "".join(pieces), [{"token": t, "original": o} for (o, _), t in tokens.items()], spans


def _frozen(texts: pd.Series) -> pd.DataFrame:
    done = [(None, None, None) if t is None else freeze_text(t) for t in texts]
    return pd.DataFrame(done, columns=["frozen", "nt", "spans"])


def _frozen_legacy(texts: pd.Series) -> pd.DataFrame:
    done = [(None, None, None) if t is None else freeze_text(t, legacy=True) for t in texts]
    return pd.DataFrame(done, columns=["frozen", "nt", "spans"])


def frozen(df: DataFrame, text_col: str, profile: str = "current") -> DataFrame:
    """``df`` with ``frozen`` (text), ``nt`` array<struct(token, original)> and ``spans`` array<struct(src_start,
    src_end, token, original)>.

    Equal originals share a token, numbered by first occurrence; tokens already in the text stay and are not
    numbered (the ``legacy`` profile gives every place its own token); starts and ends count UTF-8 bytes. Null gives nulls, the empty string no tokens. One pass in Python
    over Arrow batches: array lambdas would go over all matches again for every match.
    """
    run = {"current": _frozen, "legacy": _frozen_legacy}[profile]
    out = df.withColumn("_f", F.pandas_udf(run, FROZEN)(F.col(text_col)))
    return out.select(*df.columns, "_f.frozen", "_f.nt", "_f.spans")


def unfreeze(text: Column, nt_map: Column) -> Column:
    """Tokens of the map back to their originals in one pass, so originals that look like tokens stay; tokens that
    the map lacks stay too. A null map changes nothing."""
    found = F.regexp_extract_all(text, F.lit(P.NT), F.lit(0))
    plain = F.split(F.regexp_replace(F.replace(text, F.lit(CUT), F.lit(HIDDEN)), P.NT, CUT), CUT, -1)
    back = F.transform(found, lambda t: F.coalesce(F.try_element_at(nt_map, t), t))
    pieces = F.transform(
        F.arrays_zip(plain.alias("l"), back.alias("t")),
        lambda p: F.concat(F.replace(p["l"], F.lit(HIDDEN), F.lit(CUT)), F.coalesce(p["t"], F.lit(""))),
    )
    return F.array_join(pieces, "")


def rendered_map(nt_map: Column) -> Column:
    """``token=original`` lines in token order."""
    entries = F.array_sort(F.map_entries(nt_map))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")
