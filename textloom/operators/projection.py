"""Projecting a translation back onto the formatted spans and nodes of its source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a cut may move to spare a word.
REACH = 12


def shares(total: int, weights: list[int]) -> list[int]:
    """``total`` by largest remainders over the weights; ties to the earlier; all alike if no weight is above 0."""
    if not weights:
        return []
    if sum(weights) <= 0:
        weights = [1] * len(weights)
    whole = sum(weights)
    out = [total * w // whole for w in weights]
    for i in sorted(range(len(weights)), key=lambda k: -(total * weights[k] % whole))[: total - sum(out)]:
        out[i] += 1
    return out


def _cuts_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and all(c.isascii() and c.isalnum() for c in text[at - 1 : at + 1])


def pieces(text: str, weights: list[int]) -> list[str]:
    """``text`` cut into as many pieces as there are weights, in proportion. A cut within an ASCII word moves up to
    ``REACH`` characters, to the nearest place that cuts none, beside white space rather than not; cuts never pass
    one another, and the pieces joined give the text."""
    cuts, at, last = [], 0, 0
    for n in shares(len(text), weights)[:-1]:
        at += n
        best = at
        if _cuts_word(text, at):
            near = [p for p in range(max(last, at - REACH), min(len(text), at + REACH) + 1) if not _cuts_word(text, p)]
            if near:
                best = min(near, key=lambda p: (abs(p - at), not (text[p - 1 : p].isspace() or text[p : p + 1].isspace()), p))
        best = max(best, last)
        cuts.append(best)
        last = best
    bounds = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])] if weights else []


def projected(text: Column, weights: Column) -> Column:
    """Array of pieces of ``text`` by ``weights`` (array<int>): null text or weights give null."""

    def run(texts: pd.Series, all_weights: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or w is None else pieces(t, [int(x) for x in w]) for t, w in zip(texts, all_weights)], dtype=object)

    return F.pandas_udf(run, "array<string>")(text, weights)
