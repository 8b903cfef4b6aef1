"""Problem 6: records identical except for formatting, collapsed to one each with the number of copies.

Method: a canonical 128-bit key per record; exact partial counts per key find the hot keys; hot keys are salted
into a two-level aggregation, the rest take a one-level shuffle; the representative is the smallest identifier.
Attaching members to representatives splits the hot keys over salts in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage

#: A mark between two digits belongs to the number; every other mark, and white or invisible characters, do not count.
FORMATTING = r"(?U)(?:(?<!\p{Nd})[\p{P}|^`~｜]|[\p{P}|^`~｜](?!\p{Nd})|[\s\p{Z}\p{Cc}\p{Cf}])"
ITEM = r"(?U)^[^:：]+[:：].*\S"
SEPARATOR = "[;；|｜]"
#: Rows of one key above which the key is hot and is salted.
HOT_ROWS = 50_000


def canonical_text(text: Column) -> Column:
    """Text without what formatting may change; letter case is folded by upper, then lower."""
    return F.regexp_replace(F.lower(F.upper(text)), FORMATTING, "")


def canonical_record(kind: Column, text: Column) -> Column:
    """Canonical form of (kind, text). An ``other`` text made wholly of two or more ``label: value`` items loses
    the order of its items. Null text gives null: it holds nothing to compare."""
    kind = F.lower(F.regexp_replace(F.coalesce(kind, F.lit("")), r"(?U)^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    items = F.filter(F.split(text, SEPARATOR), lambda x: F.length(canonical_text(x)) > 0)
    is_list = (kind == "other") & (F.size(items) >= 2) & F.forall(items, lambda x: x.rlike("(?s)" + ITEM))
    body = F.when(
        is_list, F.concat(F.lit("list\u0001"), F.array_join(F.array_sort(F.transform(items, canonical_text)), "\u0001"))
    ).otherwise(canonical_text(text))
    return F.when(text.isNotNull(), F.concat_ws("\u0002", kind, body))


def keyed_lines(lines: DataFrame, id_col: str = "line_id", payload: str = "payload") -> DataFrame:
    """(id, key): the 16-byte key of each JSON payload; null where the payload is no object with a text."""
    record = F.from_json(F.regexp_replace(F.col(payload), "^[﻿\\s]+", ""), "tu_kind string, `原文` string")
    key = F.unhex(F.md5(canonical_record(record["tu_kind"], record["原文"])))
    return lines.select(F.col(id_col).alias("id"), key.alias("key")).where(F.col("id").isNotNull())


class _Groups:
    """The keys of all rows, split into hot ones and the rest.

    A key is hot if it has more than max(``hot_rows``, rows / (4 x shuffle partitions)) rows, by exact counts. So
    there are fewer than 4 x shuffle partitions hot keys, which bounds what is broadcast, and any other key fills
    at most a quarter of an average partition.
    """

    def __init__(self, keyed: DataFrame, hot_rows: int) -> None:
        spark = keyed.sparkSession
        self.keyed = keyed
        counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = keyed.count()
        self.hot_keys = counts.where(F.col("n") > max(hot_rows, rows // (4 * parts))).select("key")
        self.hot_rows = keyed.join(F.broadcast(self.hot_keys), "key")
        self.cold_rows = keyed.join(F.broadcast(self.hot_keys), "key", "left_anti")
        salted = self.hot_rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("salt")).agg(
            F.min("id").alias("keep_id"), F.count("*").alias("n")
        )
        self.hot = salted.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        self.cold = self.cold_rows.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def _keyed(lines: DataFrame, id_col: str, payload: str) -> DataFrame:
    """24 bytes a row, kept: the payloads are parsed once."""
    return cut_lineage(keyed_lines(lines, id_col, payload).distinct())


def format_groups(lines: DataFrame, id_col: str = "line_id", payload: str = "payload", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keep_id, copies): one row per distinct record. ``copies`` counts all rows of the record.

    A payload that is null, no JSON object or without a text stands for itself (copies 1). An id repeated in
    several rows counts once for each record it names; rows with a null id are left out, as they cannot be named;
    an empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(lines, id_col, payload)
    groups = _Groups(keyed.where(F.col("key").isNotNull()), hot_rows)
    alone = keyed.where(F.col("key").isNull()).select(F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return groups.hot.unionByName(groups.cold).select("keep_id", F.col("n").alias("copies")).unionByName(alone)


def format_copies(lines: DataFrame, id_col: str = "line_id", payload: str = "payload", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keep_id, copy_id): the representative and each other row of every record that has two or more.

    Rules for odd rows as in ``format_groups``. Members of hot keys meet their representative in place, through
    the broadcast of those few keys; the others are shuffled once.
    """
    groups = _Groups(_keyed(lines, id_col, payload).where(F.col("key").isNotNull()), hot_rows)
    hot = groups.keyed.join(F.broadcast(groups.hot.select("key", "keep_id")), "key")
    cold = groups.cold_rows.join(groups.cold.where(F.col("n") > 1).select("key", "keep_id"), "key")
    return (
        hot.unionByName(cold)
        .where(F.col("id") != F.col("keep_id"))
        .select("keep_id", F.col("id").alias("copy_id"))
    )
