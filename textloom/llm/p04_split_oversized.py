"""Problem 4: texts above a byte limit, cut into pieces at natural boundaries with an overlap.

Method: lexical cohesion. At every sentence end the words of a block before and a block after are compared; valleys of
that similarity are topic boundaries. The window a piece may end in reaches from the overlap's length to the size
limit; the deepest valley of the whole window wins. A window without any sentence end is searched at its clause marks
and white space in the same way. The next piece starts ``overlap`` bytes before the end of the last one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks after which a text may be cut naturally, besides white space.
BREAKS = "。！？；，、"
FLOOR_BYTES = 4000
TOKEN = re.compile(r"<<MT_[^<>]*>>")
#: A sentence end or a line break.
STRONG = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s)|[。！？｡．।॥]+[”’」』）]*|\n")
WORD = re.compile(r"<<MT_[^<>]*>>|[^\W\d_㐀-鿿぀-ヿ]+|\d+|[㐀-鿿぀-ヿ]")
BLOCK_WORDS = 60


def byte_limit(ctx_size: Column) -> Column:
    """max(4000, 2 x ctx_size - 1800); 4000 where the backend is unknown."""
    return F.greatest(F.lit(FLOOR_BYTES), 2 * ctx_size - 1800)


def _boundaries(text: str) -> tuple[list[int], list[int]]:
    """Ascending character positions where ``text`` may be cut: sentence ends, and places of any kind. None lies
    inside a token."""
    ends = set()
    for m in STRONG.finditer(text):
        end = m.end()
        while end < len(text) and text[end].isspace():
            end += 1
        ends.add(end)
    places = {m.end() for m in re.finditer(rf"\s+|[{BREAKS}]", text)} | ends
    inside = {p for m in TOKEN.finditer(text) for p in range(m.start() + 1, m.end())} | {0, len(text)}
    return sorted(ends - inside), sorted(places - inside)


def _valleys(text: str, spots: list[int]) -> list[float]:
    """Depth of the similarity valley at each spot: how far the similarity of the blocks beside it lies below the
    peaks on both sides. Blocks slide with the spots, so the cost is in proportion to the text."""
    words = [(m.start(), m.group().lower()) for m in WORD.finditer(text)]
    starts = [s for s, _ in words]
    left: Counter[str] = Counter()
    right: Counter[str] = Counter()
    lo = mid = hi = 0
    dot, sims = 0, []
    sq = [0, 0]

    def add(side: int, word: str, by: int) -> None:
        nonlocal dot
        own, other = (left, right) if side == 0 else (right, left)
        sq[side] += 2 * by * own[word] + 1
        dot += by * other[word]
        own[word] += by

    for spot in spots:
        at = bisect_left(starts, spot)
        while hi < min(len(words), at + BLOCK_WORDS):
            add(1, words[hi][1], 1)
            hi += 1
        while mid < at:
            add(1, words[mid][1], -1)
            add(0, words[mid][1], 1)
            mid += 1
        while lo < mid - BLOCK_WORDS:
            add(0, words[lo][1], -1)
            lo += 1
        sims.append(dot / (sq[0] * sq[1]) ** 0.5 if sq[0] and sq[1] else 0.0)
    depth = []
    up_left, climb = [], 0.0
    for i, s in enumerate(sims):
        climb = s if i == 0 or sims[i - 1] <= s else max(climb, s)
        up_left.append(climb)
    climb = 0.0
    for i in range(len(sims) - 1, -1, -1):
        climb = sims[i] if i == len(sims) - 1 or sims[i + 1] <= sims[i] else max(climb, sims[i])
        depth.append(up_left[i] + climb - 2 * sims[i])
    return depth[::-1]


class Cohesion:
    """The places where one text may be cut and the depths of the valleys there."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends, self.places = _boundaries(text)
        self._depths: dict[bool, list[float]] = {}

    def _depth(self, ends: bool) -> list[float]:
        if ends not in self._depths:
            self._depths[ends] = _valleys(self.text, self.ends if ends else self.places)
        return self._depths[ends]

    def window(self, low: int, high: int) -> list[tuple[float, int]]:
        """(depth, position) of the sentence ends in (low, high], or of all places if there is no sentence end."""
        for ends, spots in ((True, self.ends), (False, self.places)):
            a, b = bisect_right(spots, low), bisect_right(spots, high)
            if a < b:
                return list(zip(self._depth(ends)[a:b], spots[a:b]))
        return []

    def next_place(self, low: int) -> int:
        at = bisect_right(self.places, low)
        return self.places[at] if at < len(self.places) else len(self.text)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) character spans of the pieces of ``text``, each of at most ``limit`` UTF-8 bytes.

    Every piece ends at the deepest valley of its window, the later one of equals, and is longer than the overlap. Consecutive pieces share
    ``overlap`` bytes (at most half the limit), less what is needed to stay on whole characters and tokens; a
    stretch without any boundary that fits a piece only with less overlap gets as much as then fits. ``forced``
    pieces end inside a stretch longer than the limit, at the last whole character or token of the window, and
    share the overlap too. Texts within the limit give one piece.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    offsets = [0]
    for ch in text:
        o = ord(ch)
        offsets.append(offsets[-1] + (1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4))
    if offsets[-1] <= limit:
        return [(0, len(text), False)]
    cohesion = Cohesion(text)
    tokens = [m.span() for m in TOKEN.finditer(text)]
    token_starts = [a for a, _ in tokens]

    def token_at(p: int) -> tuple[int, int] | None:
        """The token that a cut at ``p`` would cut."""
        i = bisect_left(token_starts, p) - 1
        return tokens[i] if i >= 0 and tokens[i][0] < p < tokens[i][1] else None

    def behind(p: int) -> int:
        token = token_at(p)
        return token[1] if token else p

    pieces: list[tuple[int, int, bool]] = []
    start = done = 0
    while offsets[-1] - offsets[start] > limit:
        last = bisect_right(offsets, offsets[start] + limit) - 1
        longer = max(done, bisect_right(offsets, offsets[start] + overlap) - 1)
        window = cohesion.window(longer, last)
        if not window and (near := cohesion.window(done, longer)):
            # Places only within what the next piece repeats: of use if the stretch behind the last one fits a piece.
            if offsets[cohesion.next_place(near[-1][1])] - offsets[near[-1][1]] <= limit:
                window = near[-1:]
        if window:
            end = max(window)[1]
        else:
            stop = cohesion.next_place(done)
            if start < done and not pieces[-1][2] and offsets[stop] - offsets[done] <= limit:
                start = min(behind(bisect_left(offsets, offsets[stop] - limit)), done)
                continue
            token = token_at(last)
            end = max(token[0] if token and token[0] > done else last, done + 1)
        pieces.append((start, end, not window))
        start = min(behind(bisect_left(offsets, offsets[end] - overlap)), end)
        done = end
    pieces.append((start, len(text), False))
    return pieces


def has_long_stretch(text: str, limit: int) -> bool:
    """Whether some stretch without white space and without any of 。！？；，、 has more than ``limit`` bytes."""
    return any(len(s.encode()) > limit for s in re.split(rf"[\s{BREAKS}]+", text) if 4 * len(s) > limit)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rec_id", "piece", "start_pos", "end_pos", "text", "forced", "cut_kind"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for i, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            pieces = split_text(text, limit, overlap)
            kind = "forced" if any(f for *_, f in pieces) and has_long_stretch(text, limit) else "natural"
            for n, (a, b, forced) in enumerate(pieces):
                for col, value in zip(cols, (i, n, a, b, text[a:b], forced, kind)):
                    col.append(value)
            if len(cols[0]) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SCHEMA_TYPES)], names=names)
                cols = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SCHEMA_TYPES)], names=names)


SCHEMA_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]


def split_oversized(memory: DataFrame, files: DataFrame, backends: DataFrame) -> DataFrame:
    """(rec_id, piece, start_pos, end_pos, text, forced, cut_kind): the pieces of every record above its limit.

    The limit and overlap follow from the backend that ``model_a`` of the record's file names; a null or unknown
    file or backend has the lowest limit, 4000 bytes, and no overlap. ``cut_kind`` is ``forced`` if some piece
    had to end inside a stretch longer than the limit. Null texts and texts within the limit give no pieces;
    redelivered rows are split once; empty tables give no rows; other columns are not read. Only texts above the
    lowest limit leave the scan, so the joins move few rows.
    """
    large = (
        memory.where(F.octet_length("frozen_surface") > FLOOR_BYTES)
        .select("rec_id", "file_id", F.col("frozen_surface").alias("frozen"))
        .dropDuplicates(["rec_id"])
    )
    budgets = (
        files.select("file_id", F.col("model_a").alias("backend_name"))
        .join(backends.select("backend_name", "ctx_size", "overlap_bytes"), "backend_name", "left")
        .select("file_id", byte_limit(F.col("ctx_size")).alias("limit"), F.coalesce("overlap_bytes", F.lit(0)).alias("overlap"))
    )
    over = (
        large.join(budgets, "file_id", "left")
        .withColumns({"limit": F.coalesce("limit", F.lit(FLOOR_BYTES)), "overlap": F.coalesce("overlap", F.lit(0))})
        .where(F.octet_length("frozen") > F.col("limit"))
        .select("rec_id", "frozen", F.col("limit").cast("bigint"), F.col("overlap").cast("bigint"))
    )
    return over.mapInArrow(
        _split, "rec_id bigint, piece int, start_pos int, end_pos int, text string, forced boolean, cut_kind string"
    )
