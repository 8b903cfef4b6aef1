"""Comparing two extractions: multisets, aligned rows and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """How often both sides have each row: one aggregation with map-side counts."""
    ones = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return ones.groupBy(*columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, as often as they exceed it: ``change`` is missing (left
    only) or extra (right only). Null equals null."""
    surplus = F.col("l") - F.col("r")
    rows = _counts(left, right, left.columns).where(surplus != 0)
    change = F.when(surplus > 0, "missing").otherwise("extra")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs(surplus)))
    return rows.select(*left.columns, change.alias("change"), times.alias("time")).drop("time")


def multiset_recall(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: items of both sides, those found in both by count, missing and extra. One aggregation over counts
    instead of two set differences."""
    counts = _counts(left, right, [*keys, value])
    return counts.groupBy(*keys).agg(
        F.sum("l").alias("left_items"),
        F.sum("r").alias("right_items"),
        F.sum(F.least("l", "r")).alias("found"),
        F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("extra"),
    )


def aligned_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a full outer join on ``keys`` that differ: ``problem`` is missing, extra or the first column that
    differs."""
    l = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    r = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    problem: Column = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra")
    for c in columns:
        problem = problem.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), c)
    return l.join(r, keys, "full").withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def translation_report(df: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Per key: units, changed, unchanged, unchanged ones with Latin letters, targets with Han, and their rates."""
    src, tgt = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    same = src == tgt
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("units"),
            F.count_if(~same).alias("changed"),
            F.count_if(same).alias("unchanged"),
            F.count_if(same & src.rlike("[A-Za-z]")).alias("latin_unchanged"),
            F.count_if(tgt.rlike(r"[一-鿿]")).alias("with_han"),
        )
        .withColumns(
            {
                "changed_rate": F.round(F.col("changed") / F.col("units"), 6),
                "han_rate": F.round(F.col("with_han") / F.col("units"), 6),
            }
        )
    )
