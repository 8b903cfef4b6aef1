"""The model boundary: batches of prompts to any text model, and a ladder of candidates behind validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from textloom.functions.validate import validated

#: Makes a model in a worker, once: the model turns a list of prompts into as many texts.
ModelFactory = Callable[[], Callable[[list[str]], list[str]]]

_made: dict[str, Callable[[list[str]], list[str]]] = {}


def stub_model() -> Callable[[list[str]], list[str]]:
    """The deterministic default: gives every prompt back, so that results can be checked."""
    return lambda prompts: list(prompts)


def with_answers(df: DataFrame, inputs: list[str], out: str, kind: DataType, work: Callable[[Callable, list[tuple]], list], factory: ModelFactory, name: str) -> DataFrame:
    """``df`` with a column ``out`` of ``work(model, rows)``, batch by batch, of the columns ``inputs``. A stage of its
    own: expressions on the column are not merged into it."""
    schema = StructType([*df.schema.fields, StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made[name] = factory()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in inputs)))
            values = pa.array(work(_made[name], rows), to_arrow_type(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def generated(df: DataFrame, prompt: str, out: str, factory: ModelFactory = stub_model, name: str = "stub") -> DataFrame:
    """``df`` with the model's text for every prompt. ``name`` keys the model within a worker process, where it is
    made once. A null prompt gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _made:
            _made[name] = factory()
        for prompts in batches:
            asked = prompts.notna()
            texts = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            if asked.any():
                texts[asked] = _made[name](prompts[asked].tolist())
            yield texts

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(prompt)))


def accepted(df: DataFrame, frozen: str, nt_map: str, candidates: list[str], out: str = "accepted") -> DataFrame:
    """``df`` with the first candidate that passes validation, or the frozen source, and ``<out>_from``: the
    candidate's name or ``source``."""
    step = df
    for c in candidates:
        step = validated(step, frozen, nt_map, c, f"_error_{c}")
    fits = [F.when(F.col(f"_error_{c}").isNull() & F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), F.lit(c).alias("name"))) for c in candidates]
    best = F.coalesce(*fits, F.struct(F.col(frozen).alias("text"), F.lit("source").alias("name")))
    return step.withColumn("_best", best).select(*df.columns, F.col("_best.text").alias(out), F.col("_best.name").alias(f"{out}_from"))
