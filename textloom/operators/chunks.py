"""Texts cut to fit a model: by tokens, for embedding, and rows packed into batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.retrieval import norm, weighted_mean
from textloom.operators.sequence import pack_chunks

_STRONG = re.compile(r"(?<=[.!?;:。！？；：])\s+")
_WEAK = re.compile(r"(?<=[,，])\s+")
# Fixed values of the hard cut: characters a token has at most, the shortest cap, and the step of shrinking.
CHARS_PER_TOKEN, LEAST_CAP, STEP = 3, 64, 16

# Kinds of packing, with the share of the context that makes a budget of bytes, its least value, the
# rows of a chunk at most (None: any number) and the bytes that a row adds.
PACKINGS = {
    "basic": (2, -1800, 4000, 64, 64),
    "full": (2, -1800, 4000, 32, 96),
    "fuse": (2, -2200, 6000, 20, 160),
    "notes": (1, -1400, 0, 24, 64),
    "audit": (1, -1800, 0, None, 96),
}


def count_words(text: str) -> int:
    """The default token counter: words and marks, Han characters one by one."""
    return len(re.findall(r"[㐀-鿿]|[^\W㐀-鿿]+|[^\w\s]", text))


def fit_tokens(text: str, count: Callable[[str], int], most: int) -> list[str]:
    """``text`` in pieces of at most ``most`` tokens, which joined give it back: cut after sentence marks and white
    space, or after commas where there is no sentence mark at all, as late as fits; stretches that do not fit are
    cut hard, by characters."""
    if not text or most <= 0 or count(text) <= most:
        return [text]
    places = [m.end() for m in _STRONG.finditer(text)] or [m.end() for m in _WEAK.finditer(text)]

    def hard(start: int) -> int:
        end = min(len(text), start + max(LEAST_CAP, most * CHARS_PER_TOKEN))
        while end > start + 2 * STEP and count(text[start:end]) > most:
            end -= STEP
        return max(end, start + 1)

    out, start, good = [], 0, 0
    for place in places:
        if place <= start:
            continue
        if count(text[start:place]) <= most:
            good = place
            continue
        end = good if good > start else hard(start)
        out.append(text[start:end])
        start = good = end
    while start < len(text):
        end = len(text) if count(text[start:]) <= most else hard(start)
        out.append(text[start:end])
        start = end
    return out


def fitted(text: Column, most: int, count: Callable[[str], int] = count_words) -> Column:
    """Array of pieces of at most ``most`` tokens by ``count``, which runs in the workers; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else fit_tokens(t, count, most))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


def embedding_chunks(text: Column, most: int) -> Column:
    """Array of chunks of at most ``most`` characters: whole sentences of the collapsed text, as many as fit, joined
    by spaces; a longer sentence is a chunk of its own. Blank and null texts have none."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    parts = F.filter(F.transform(F.split(line, r"(?<=[.!?;:。！？；：]) ", -1), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("own"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["own"]) + 1 + F.length(p) <= most
        own = F.when(acc["own"] == "", p).when(fits, F.concat(acc["own"], F.lit(" "), p)).otherwise(p)
        closed = F.when((acc["own"] != "") & ~fits, F.concat(acc["done"], F.array(acc["own"]))).otherwise(acc["done"])
        return F.struct(closed.alias("done"), own.alias("own"))

    packed = F.aggregate(parts, start, step, lambda acc: F.when(acc["own"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["own"]))))
    return F.when(line == "", F.array().cast("array<string>")).when(F.lit(most <= 0) | (F.length(line) <= most), F.array(line)).otherwise(packed)


def chunked_means(chunks: DataFrame, keys: list[str], order: str, text: str, vector: str) -> DataFrame:
    """(keys, mean, norm): one vector a key out of those of its chunks, each weighing its characters, at least 1.
    Chunks without a vector, and those of other dimensions than the first, do not count."""
    held = chunks.where(F.size(vector) > 0)
    first = held.groupBy(*keys).agg(F.min_by(F.size(vector), order).alias("_d"))
    own = held.join(first, keys).where(F.size(vector) == F.col("_d")).withColumn("_n", F.greatest(F.lit(1), F.length(text)))
    return weighted_mean(own, keys, vector, "_n").withColumn("norm", norm(F.col("mean")))


def packed(df: DataFrame, kind: str, key: str, order: list[str], size: str, ctx_size: str, carry: list[str]) -> DataFrame:
    """Rows in chunks of one of the ``PACKINGS``, by the context of the model."""
    times, less, least, items, overhead = PACKINGS[kind]
    budget = F.greatest(F.lit(least), times * F.coalesce(ctx_size, F.lit(0)) + less)
    return pack_chunks(df.withColumn("_budget", budget), key, order, size, "_budget", items or 2**31 - 1, overhead, carry)


def token_batches(df: DataFrame, key: str, order: list[str], tokens: str, carry: list[str], most: int = 2048) -> DataFrame:
    """Rows in batches of at most ``most`` tokens, in order."""
    return pack_chunks(df.withColumn("_budget", F.lit(most)), key, order, tokens, "_budget", 2**31 - 1, 0, carry)
