"""Problem 9: documents assigned to containers of fixed capacity, whole unless one alone exceeds it.

Method: large-item matching. Items above one third of the capacity go at most two to a bin, each paired greedily with
the largest partner that fits; smaller items fill the smallest gap that takes them (best fit), largest first. All of
this depends on sizes alone, and there are at most ``capacity`` different ones, so it is worked out on the histogram
of sizes: a plan of runs (size, ranks from-to, bins from). The documents are then only ranked within their size,
which is spread over shards, and looked up in the plan. Neither the plan nor any task grows with the documents of one
size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.p08_byte_bpe import token_counts
from textloom.session import cut_lineage

#: Specifications are configuration; a table with more is refused.
MAX_SPECS = 1000
#: Histogram and plan hold at most one row per size up to the capacity; a larger capacity is refused.
MAX_CAPACITY = 1 << 23
#: Shards of a size, at least, and the rows of one size that a shard has on average, at most.
SHARDS, SHARD_ROWS = 64, 250_000


class _Gaps:
    """Runs of equal bins by gap: for each gap, runs (first bin, number of bins)."""

    def __init__(self) -> None:
        self.order: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, bins: int) -> None:
        if gap <= 0 or bins <= 0:
            return
        if gap not in self.runs:
            insort(self.order, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, bins))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """The run with the smallest gap of ``size`` or more, removed: (gap, first bin, bins)."""
        at = bisect_left(self.order, size)
        if at == len(self.order):
            return None
        gap = self.order[at]
        first, bins = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.order.pop(at)
        return gap, first, bins


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, bins) for items of the sizes and counts given, all from 1 to ``capacity``.

    A run (size, from_rank, to_rank, first_bin, per_bin) puts the items of ``size`` with those ranks (the upper one
    excluded) into successive bins from ``first_bin``, ``per_bin`` to a bin.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    ranked = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps = _Gaps()
    bins = 0

    def put(size: int, items: int, first: int, per_bin: int = 1) -> None:
        runs.append((size, ranked[size], ranked[size] + items, first, per_bin))
        ranked[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect_left(large, capacity - size + 1) - 1
        if at < 0:
            items = left[size]
            put(size, items, bins)
            gaps.add(capacity - size, bins, items)
            bins += items
            large.pop()
            continue
        partner = large[at]
        if partner == size:
            pairs, odd = divmod(left[size], 2)
            if pairs:
                put(size, 2 * pairs, bins, 2)
                gaps.add(capacity - 2 * size, bins, pairs)
                bins += pairs
            if odd:
                # The odd one meets the next smaller partner, if there is one.
                if at > 0:
                    other = large[at - 1]
                    put(size, 1, bins)
                    put(other, 1, bins)
                    gaps.add(capacity - size - other, bins, 1)
                    if not left[other]:
                        large.remove(other)
                else:
                    put(size, 1, bins)
                    gaps.add(capacity - size, bins, 1)
                bins += 1
            large.remove(size)
            continue
        items = min(left[size], left[partner])
        put(size, items, bins)
        put(partner, items, bins)
        gaps.add(capacity - size - partner, bins, items)
        bins += items
        for s in (size, partner):
            if not left[s]:
                large.remove(s)
    for size in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.take(size)
            if found is None:
                gap, first, room = capacity, bins, -(-left[size] // (capacity // size))
                bins += room
            else:
                gap, first, room = found
            per_bin = gap // size
            full = min(room, left[size] // per_bin)
            if full:
                put(size, full * per_bin, first, per_bin)
                gaps.add(gap - per_bin * size, first, full)
            if full < room:
                rest = left[size]
                if rest:
                    put(size, rest, first + full, rest)
                    gaps.add(gap - rest * size, first + full, 1)
                    full += 1
                gaps.add(gap, first + full, room - full)
    return runs, bins


def _assign(shared: Broadcast):
    """Looks items (spec, size, rank) up in the plan by binary search."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[int, tuple[np.ndarray, ...]] = shared.value
        for batch in batches:
            spec, size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            bins = np.zeros(batch.num_rows, dtype=np.int64)
            for s in np.unique(spec):
                key, start, first, per_bin, count = plan[int(s)]
                rows = np.flatnonzero(spec == s)
                at = np.searchsorted(key, (size[rows].astype(np.int64) << 40) | rank[rows], side="right") - 1
                own = first[at] + (rank[rows] - start[at]) // per_bin[at]
                none = size[rows] == 0
                own[none] = rank[rows][none] % max(1, count)
                bins[rows] = own
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bins)], names=NAMES)

    return assign


NAMES = ["spec_id", "doc_id", "piece", "start_token", "n_tokens", "bin_id"]
SCHEMA = "spec_id int, doc_id bigint, piece int, start_token bigint, n_tokens bigint, bin_id bigint"


def _ranked(items: DataFrame, shards: int) -> DataFrame:
    """A rank from 0 within every (spec, size): a row number within one of ``shards`` shards, after the counts of
    the shards before. A size that a third of all documents share is ranked by many tasks."""
    own = items.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
    counts = own.groupBy("spec_id", "n_tokens", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("spec_id", "n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec_id", "n_tokens", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("spec_id", "n_tokens", "shard").orderBy("row", "piece")
    return own.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["spec_id", "n_tokens", "shard"]).withColumn(
        "rank", (F.col("place") + F.col("offset")).cast("bigint")
    )


def pack_documents(docs: DataFrame, specs: DataFrame, tokenizers: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(spec_id, doc_id, piece, start_token, n_tokens, bin_id) for every specification and document.

    A document above the capacity is cut into pieces of the capacity, which fill a bin each, and a last piece, which
    is packed like a document; any other document is one piece 0. Null and
    empty texts have no tokens and go, one piece each, to the bins in turn. Every row is packed, repeated ids too;
    a null id stays null; a specification with a null or non-positive capacity, one above ``MAX_CAPACITY`` or a null
    tokenizer is refused; an
    empty table of documents gives no rows; other columns are not read.

    ``tokenizers`` is the folder of the rank files, ``<tokenizer>.tiktoken``.
    """
    wanted = specs.select("spec_id", "tokenizer", "capacity").distinct().limit(MAX_SPECS + 1).collect()
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specifications")
    if any(w["capacity"] is None or w["capacity"] < 1 or w["tokenizer"] is None for w in wanted):
        raise ValueError("a specification needs a tokenizer and a capacity of 1 or more")
    if any(w["capacity"] > MAX_CAPACITY for w in wanted):
        raise ValueError(f"a capacity above {MAX_CAPACITY}")
    parts = []
    for name in sorted({w["tokenizer"] for w in wanted}):
        sized = token_counts(docs, f"{tokenizers}/{name}.tiktoken", id_col, text_col)
        parts.append(sized.select(F.lit(name).alias("tokenizer"), F.col(id_col).alias("doc_id"), "n_tokens"))
    if not parts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    sizes = parts[0]
    for part in parts[1:]:
        sizes = sizes.unionByName(part)
    sizes = cut_lineage(sizes.withColumn("row", F.monotonically_increasing_id()))
    # At most MAX_SPECS rows; null-safe, as all are checked above.
    spec_rows = F.broadcast(docs.sparkSession.createDataFrame([(w["spec_id"], w["tokenizer"], w["capacity"]) for w in wanted], "spec_id int, tokenizer string, capacity bigint"))
    sized = sizes.join(spec_rows, "tokenizer")
    # Cut where the capacity is passed: ceil(n / capacity) pieces, one for a text without tokens.
    count = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    start = F.col("piece") * F.col("capacity")
    items = sized.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "spec_id",
        "doc_id",
        "row",
        "piece",
        start.alias("start_token"),
        F.least(F.col("n_tokens") - start, F.col("capacity")).alias("n_tokens"),
    )
    histograms: dict[int, dict[int, int]] = {w["spec_id"]: {} for w in wanted}
    most = 0
    for r in items.groupBy("spec_id", "n_tokens").count().collect():  # at most capacity + 1 rows a spec
        most = max(most, r["count"])
        if r["n_tokens"] > 0:
            histograms[r["spec_id"]][r["n_tokens"]] = r["count"]
    plan = {}
    for w in wanted:
        runs, bins = plan_bins(histograms[w["spec_id"]], w["capacity"])
        runs.sort()
        table = np.array(runs or [(0, 0, 0, 0, 1)], dtype=np.int64)
        plan[w["spec_id"]] = ((table[:, 0] << 40) | table[:, 1], table[:, 1], table[:, 3], table[:, 4], bins)
    ranked = _ranked(items, max(SHARDS, -(-most // SHARD_ROWS)))
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    return ranked.select("spec_id", "doc_id", "piece", "start_token", "n_tokens", "rank").mapInArrow(_assign(shared), SCHEMA)


def fill_rates(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, bins, tokens, capacity, fill): how well the containers of every specification are filled."""
    totals = packed.groupBy("spec_id").agg(F.count_distinct("bin_id").alias("bins"), F.sum("n_tokens").alias("tokens"))
    return totals.join(specs.select("spec_id", "capacity").distinct(), "spec_id").withColumn(
        "fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6)
    )
