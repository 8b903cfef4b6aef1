"""Operators over rows in document order: numbering, neighbours, carrying, islands, packing and apportioning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "seq") -> DataFrame:
    """Dense ids from 1 in document order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def limited(df: DataFrame, keys: list[str], order: list[str], most: int | None) -> DataFrame:
    """The first ``most`` rows of each key in document order, one at least; all where ``most`` is None."""
    if most is None:
        return df
    return numbered(df, keys, order, "_seq").where(F.col("_seq") <= max(1, most)).drop("_seq")


def top_values(df: DataFrame, keys: list[str], order: str, column: str, k: int = 6) -> DataFrame:
    """(keys, column, n, rank): the ``k`` most frequent values of ``column`` in each key, those that come first in
    ``order`` before others as frequent."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first", column))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("_first")


def neighbours(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """``prev_text`` and ``next_text``; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"prev_text": F.lag(text).over(w), "next_text": F.lead(text).over(w)})


def carried_forward(df: DataFrame, keys: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last value that is not null up to each row; never reset within a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def running_offset(df: DataFrame, keys: list[str], order: list[str], length: str, out: str = "offset") -> DataFrame:
    """The sum of the lengths before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)))


def islands(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "island") -> DataFrame:
    """Numbers runs of equal ``value`` (null equals null) from 1; a change starts the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = df.withColumn("_value", value).withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("_value").eqNullSafe(F.lag("_value").over(w))).cast("int")))
    return changed.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_value", "_new")


def heading_level(style: Column, outline: Column) -> Column:
    """The level from an outline (0 to 9, plus one), else from a style name: the number in ``Heading n``, 1 for
    ``Title``; null for other paragraphs."""
    low = F.lower(F.trim(style))
    number = F.regexp_extract(low, r"^heading[^0-9]*([0-9]+)$", 1)
    named = F.when(low.startswith("heading") & (number != "") & (F.try_to_number(number, F.lit("999999")) > 0), F.try_to_number(number, F.lit("999999")).cast("int"))
    return F.when(outline >= 0, outline + 1).otherwise(F.coalesce(named, F.when(low == "title", 1)))


def heading_path(df: DataFrame, keys: list[str], order: list[str], level: str, text: str, out: str = "section_path", levels: int = 10) -> DataFrame:
    """The headings above each row, outermost first. A heading closes those of its level and deeper; a blank one
    closes without standing in the path itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_row", F.row_number().over(w))
    at = {n: F.last(F.when(F.col(level) == n, F.col("_row")), ignorenulls=True).over(upto) for n in range(1, levels + 1)}
    name = {
        n: F.last(F.when(F.col(level) == n, F.struct(F.trim(text).alias("t"))), ignorenulls=True).over(upto) for n in range(1, levels + 1)
    }
    df = df.withColumns({f"_at{n}": at[n] for n in at} | {f"_name{n}": name[n] for n in name})
    parts = []
    for n in range(1, levels + 1):
        # Rows without headings of a level count as 0: nothing closes before the first.
        higher = F.greatest(F.lit(0), *[F.coalesce(F.col(f"_at{k}"), F.lit(0)) for k in range(1, n)], F.lit(0)) if n > 1 else F.lit(0)
        parts.append(F.when((F.col(f"_at{n}") > higher) & (F.col(f"_name{n}")["t"] != ""), F.col(f"_name{n}")["t"]))
    return df.withColumn(out, F.array_compact(F.array(*parts))).drop("_row", *[f"_at{n}" for n in at], *[f"_name{n}" for n in name])


def pack_chunks(df: DataFrame, key: str, order: list[str], size: str, budget: str, max_items: int, overhead: int, carry: list[str]) -> DataFrame:
    """Greedy packing in order: a chunk closes when the next row's size plus ``overhead`` would pass its budget, or
    at ``max_items`` rows; a first row is always taken. Returns key, the carried columns, ``chunk`` and ``used``.

    Whether a chunk closes depends on the running state, so no window gives it; rows are sorted and streamed
    instead, a key's rows never gathered.
    """
    columns = [key, *order, *[c for c in carry if c not in (key, *order)], size, budget]
    own = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    kept = [i for i, c in enumerate(columns) if c == key or c in carry]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk, used, items = object(), 0, 0, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            sizes = batch.column(len(columns) - 2).to_pylist()
            budgets = batch.column(len(columns) - 1).to_pylist()
            chunks, useds = [], []
            for k, s, b in zip(keys, sizes, budgets):
                if k != last:
                    last, chunk, used, items = k, 1, 0, 0
                add = (s or 0) + overhead
                if items and (used + add > (b or 0) or items >= max_items):
                    chunk, used, items = chunk + 1, 0, 0
                used, items = used + add, items + 1
                chunks.append(chunk)
                useds.append(used)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(chunks, pa.int32()), pa.array(useds, pa.int64())],
                names=[*(columns[i] for i in kept), "chunk", "used"],
            )

    schema = ", ".join(f"`{columns[i]}` {types[f'c{i}']}" for i in kept) + ", chunk int, used bigint"
    sort = ["c0", *[f"c{i}" for i in range(1, 1 + len(order))]]
    return own.repartition("c0").sortWithinPartitions(*sort).mapInArrow(scan, schema)


def apportioned(df: DataFrame, keys: list[str], order: str, total: str, weight: str, out: str = "share") -> DataFrame:
    """Splits ``total`` over the rows of a key by weight, by largest remainders; ties go to the earlier row. With no
    weight at all, every row weighs the same."""
    group = Window.partitionBy(*keys)
    df = df.withColumn("_w", F.when(F.sum(weight).over(group) > 0, F.col(weight)).otherwise(F.lit(1)))
    df = df.withColumn("_exact", F.col(total) * F.col("_w")).withColumn("_sum", F.sum("_w").over(group))
    df = df.withColumn("_floor", F.expr("_exact div _sum")).withColumn("_left", F.col("_exact") % F.col("_sum"))
    missing = F.col(total) - F.sum("_floor").over(group)
    rank = F.row_number().over(group.orderBy(F.col("_left").desc(), F.col(order)))
    return df.withColumn(out, (F.col("_floor") + F.when(rank <= missing, 1).otherwise(0)).cast("bigint")).drop("_w", "_exact", "_sum", "_floor", "_left")
