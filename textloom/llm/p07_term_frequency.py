"""Problem 7: how often every distinct term occurs, and in how many records.

Method: (field, term, record) pairs are range-partitioned and sorted externally by Spark's shuffle; one
run-length scan over each sorted partition yields occurrences and distinct records for every run. A term whose
pairs span several ranges gives one partial row per range, which a last aggregation of those small rows adds up.
A hot term is therefore split over ranges by record id and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"(?U)^\s*$"


def term_pairs(memory: DataFrame, fields: tuple[str, ...], id_col: str = "rec_id") -> DataFrame:
    """One row (field, term, record, pos) per stored element; null and blank elements are ignored."""
    none = F.array().cast("array<struct<field:string,term:string,pos:int>>")

    def elements(field: str) -> Column:
        tag = F.lit(field).alias("field")
        return F.coalesce(F.transform(field, lambda x, i: F.struct(tag, x.alias("term"), i.alias("pos"))), none)

    items = F.concat(*map(elements, fields))
    return (
        memory.select(F.col(id_col).alias("record"), F.explode(items).alias("e"))
        .select("e.field", "e.term", "record", "e.pos")
        .where(F.col("term").isNotNull() & ~F.col("term").rlike(BLANK))
    )


def _changed(column: pa.ChunkedArray | pa.Array, before: object) -> np.ndarray:
    """True where a value differs from the one above it; ``before`` precedes the first. Nulls equal nulls."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if n > 1:
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        gone = pc.is_null(column).to_numpy(zero_copy_only=False)
        out[1:] = differs | (gone[1:] != gone[:-1])
    out[0] = column[0].as_py() != before
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of a sorted partition. A pair repeated with the same record and position is one element
    of a redelivered row; runs crossing a batch edge go out in parts, counted so that the parts add up."""
    last: tuple = (object(), object(), object(), object())
    for batch in batches:
        if batch.num_rows == 0:
            continue
        field, term, record, pos = (batch.column(i) for i in range(4))
        new_term = _changed(field, last[0]) | _changed(term, last[1])
        new_record = new_term | _changed(record, last[2])
        new_pair = new_record | _changed(pos, last[3])
        starts = np.flatnonzero(new_term)
        if len(starts) == 0 or starts[0] != 0:
            starts = np.concatenate([[0], starts])
        yield pa.RecordBatch.from_arrays(
            [
                field.take(pa.array(starts)),
                term.take(pa.array(starts)),
                pa.array(np.add.reduceat(new_pair.astype(np.int64), starts)),
                pa.array(np.add.reduceat(new_record.astype(np.int64), starts)),
            ],
            names=["field", "term", "occurrences", "records"],
        )
        last = tuple(c[batch.num_rows - 1].as_py() for c in (field, term, record, pos))


def term_frequency(memory: DataFrame, fields: tuple[str, ...] = ("terms", "proper_nouns"), id_col: str = "rec_id") -> DataFrame:
    """(field, term, occurrences, records) of every distinct element.

    Null arrays and null or blank elements count nothing; a record id that comes in several rows (redelivery)
    counts each of its positions once; rows with a null id count as one record; an empty table gives no rows;
    other columns are not read.
    """
    pairs = term_pairs(memory, fields, id_col)
    order = ["field", "term", "record", "pos"]
    runs = (
        pairs.repartitionByRange(*order[:3])
        .sortWithinPartitions(*order)
        .mapInArrow(_scan, "field string, term string, occurrences bigint, records bigint")
    )
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(
    memory: DataFrame,
    fields: tuple[str, ...] = ("terms", "proper_nouns"),
    id_col: str = "rec_id",
    rare_at_most: int = 2,
    common_above: float = 0.05,
) -> DataFrame:
    """``term_frequency`` with ``mark``: ``rare`` (in at most ``rare_at_most`` records), ``common`` (in more than
    the share ``common_above`` of all distinct record ids) or null. ``rare`` wins where a tiny table meets both."""
    total = memory.agg(F.count_distinct(id_col).alias("n")).scalar()
    return term_frequency(memory, fields, id_col).withColumn(
        "mark",
        F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > common_above * total, "common"),
    )
