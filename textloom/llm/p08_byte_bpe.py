"""Problem 8: token ids of every text by a byte-level BPE vocabulary given as ranks.

Method: contiguous rank arrays. Each short word holds its parts and the ranks of adjacent pairs in arrays; the
minimum is scanned for again and again, the boundary there deleted, and the neighbouring ranks refreshed. Words of
one length lie in one matrix, a word to a row, so each scan, deletion and refresh is one vectorised step over many
words. Longer words use the same merges from a heap over linked parts, which does not grow quadratically.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import spread

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts whose numbers are all decimal digits, in the faster standard module.
_SPLIT_DECIMAL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_SPLIT = regex.compile(PATTERN).findall
#: The two modules agree on texts of these characters: ASCII, Latin letters, common marks, kana, CJK, full width.
_COMMON = re.compile("[\t\n\r -~ -±À-ɏ‐-‧　-〆〈-〟ぁ-ゖァ-ヺー一-龥！-～]*")
SHORT_BYTES = 96
CACHE_WORDS = 600_000
#: Marks a chunk in the word store: a lone surrogate, which no valid text holds.
SPACED = "\ud800"
NO_RANK = np.int64(1 << 40)
MAX_VOCABULARY_BYTES = 32 << 20


def _split_words(text: str) -> list[str]:
    return _SPLIT_DECIMAL(text) if _COMMON.fullmatch(text) else _SPLIT(text)


class ByteBPE:
    """Encoder over a rank file: lines of base64 token and rank. Ids are the ranks."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Every way to cut a token into two tokens is a pair that merges into it.
        size = max(self.ranks.values()) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.size, self.pairs = size, pairs
        self._hash_pairs(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.index: dict[str, int] = {}
        self.first: list[int] = []
        self.count: list[int] = []

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing, filled and probed in vectorised rounds."""
        self.mask = (1 << max(4, int(len(keys) * 4).bit_length())) - 1
        self.slot_key = np.full(self.mask + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(self.mask + 1, NO_RANK, dtype=np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[todo[free]]
            won = self.slot_key[at] == keys[todo]
            self.slot_rank[at[won]] = ranks[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(24)) & self.mask

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK where a pair does not merge or a side is missing (negative)."""
        keys = left * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at_open = (at[open_] + 1) & self.mask
            at[open_] = at_open
            found = self.slot_key[at_open]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at_open[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one per row of ``words``: their bytes, then -1. Returns the rows' ids one after another
        and their numbers."""
        n, width = words.shape
        parts = np.where(words < 0, -1, self.byte_ids[words])
        if width == 1:
            return parts[:, 0].astype(np.int32), np.ones(n, dtype=np.int64)
        ranks = self._rank(parts[:, :-1].ravel().copy(), parts[:, 1:].ravel()).reshape(n, width - 1)
        done_parts, done_at = np.full((n, width), -1, dtype=np.int64), np.arange(n)
        live = width
        while len(done_at):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(best))
            lowest = ranks[rows, best]
            stop = lowest >= NO_RANK
            if stop.any():
                done_parts[done_at[stop], :live] = parts[stop]
                keep = ~stop
                parts, ranks, best, lowest, done_at = parts[keep], ranks[keep], best[keep], lowest[keep], done_at[keep]
                rows = np.arange(len(best))
                if not len(best):
                    break
            parts[rows, best] = lowest
            # Delete the boundary: everything right of it moves one place to the left.
            kept = np.ones(parts.shape, dtype=bool)
            kept[rows, best + 1] = False
            live -= 1
            parts = parts[kept].reshape(len(rows), live)
            if live == 1:
                done_parts[done_at, :1] = parts
                break
            kept = np.ones(ranks.shape, dtype=bool)
            kept[rows, best] = False
            ranks = ranks[kept].reshape(len(rows), live - 1)
            has_left, has_right = best > 0, best < live - 1
            sides = np.concatenate([rows[has_left], rows[has_right]])
            spots = np.concatenate([best[has_left] - 1, best[has_right]])
            ranks[sides, spots] = self._rank(parts[sides, spots], parts[sides, spots + 1])
        whole = done_parts >= 0
        return done_parts[whole].astype(np.int32), whole.sum(axis=1)

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges, lowest rank and then leftmost first, from a heap over linked parts."""
        ids = [int(self.byte_ids[b]) for b in word]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        get, size = self.pairs.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(ids):
                    right = after[left]
                    r = get(ids[left] * size + ids[right])
                    if r is not None:
                        heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def _store(self, ids: np.ndarray, lengths: np.ndarray, words: list[str]) -> None:
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), dtype=np.int32)])
        self.pool[self.used : need] = ids
        firsts = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = len(self.first)
        self.index.update(zip(words, range(base, base + len(words))))
        self.first.extend(firsts.tolist())
        self.count.extend(lengths.tolist())
        self.used = need

    def _learn(self, words: set[str]) -> None:
        """Words of like length share a matrix, the shorter ones padded."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) > SHORT_BYTES:
                ids = self.merge_long(raw)
                self._store(np.array(ids, dtype=np.int32), np.array([len(ids)]), [word])
            else:
                known = by_length.setdefault(len(raw) if len(raw) <= 8 else -(-len(raw) // 6) * 6, ([], []))
                known[0].append(word)
                known[1].append(raw)
        for width, (names, raws) in by_length.items():
            step = max(1, 400_000 // width)
            for i in range(0, len(raws), step):
                own = raws[i : i + step]
                block = np.full((len(own), width), -1, dtype=np.int16)
                real = np.arange(width) < np.fromiter(map(len, own), np.int64, len(own))[:, None]
                block[real] = np.frombuffer(b"".join(own), dtype=np.uint8)
                self._store(*self.merge_short(block), names[i : i + step])

    def _learn_chunks(self, chunks: set[str]) -> None:
        """A chunk is a space and what follows up to the next one; its ids are those of its words."""
        split = {c: _split_words(" " + c) for c in chunks}
        new = set(chain.from_iterable(split.values())).difference(self.index)
        if new:
            self._learn(new)
        get = self.index.__getitem__
        flat = np.fromiter(map(get, chain.from_iterable(split.values())), np.int64)
        words = np.fromiter(map(len, split.values()), np.int64, len(split))
        ids, offsets = self._gather(flat, words)
        self._store(ids, np.diff(offsets), [SPACED + c for c in split])

    def _gather(self, flat: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.array(self.count, dtype=np.int64)[flat]
        sums = np.concatenate([[0], np.cumsum(n)])
        start = np.array(self.first, dtype=np.int64)[flat]
        ids = self.pool[np.repeat(start - sums[:-1], n) + np.arange(sums[-1])]
        return ids, sums[np.concatenate([[0], np.cumsum(words)])]

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices into the word store of all texts' words one after another, and the number of words of each.

        In texts written with single spaces the unit is the chunk from one space to the next. No match of the
        pattern crosses such a space and what is matched depends only on what follows, so chunks can be split
        alone, and once each."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.first, self.count, self.used = {}, [], [], 0
        split: list[list[str]] = []
        chunks: list[str] = []
        for text in texts:
            parts = text.split(" ") if text else []
            if len(parts) * 20 > len(text or "") and "" not in parts:
                rest = [SPACED + p for p in parts[1:]]
                split.append(_split_words(parts[0]) + rest)
                chunks += rest
            else:
                split.append(_split_words(text) if text else [])
        known = self.index
        new_chunks = {c[1:] for c in set(chunks).difference(known)}
        new = {w for w in set(chain.from_iterable(split)).difference(known) if w[0] != SPACED}
        if new:
            self._learn(new)
        if new_chunks:
            self._learn_chunks(new_chunks)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64)
        return flat, np.fromiter(map(len, split), np.int64, len(split))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        flat, words = self._words(texts)
        sums = np.concatenate([[0], np.cumsum(np.array(self.count, dtype=np.int64)[flat] if len(flat) else flat)])
        ends = np.cumsum(words)
        return sums[ends] - sums[ends - words]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        flat, words = self._words(texts)
        if not len(flat):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        ids, offsets = self._gather(flat, words)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


_loaded: dict[int, ByteBPE] = {}


def ship_vocabulary(spark: SparkSession, rank_path: str) -> Callable[[], ByteBPE]:
    """The rank file, read once on the driver and broadcast; its size is checked (a vocabulary does not grow with
    the data). Each worker process builds the encoder once."""
    with open(rank_path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{rank_path} has more than {MAX_VOCABULARY_BYTES} bytes")
    shared = spark.sparkContext.broadcast(content)
    key = hash(content)

    def load() -> ByteBPE:
        if key not in _loaded:
            _loaded[key] = ByteBPE(shared.value)
        return _loaded[key]

    return load


def _slices(batch: pa.RecordBatch, size: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, so that memory does not follow the length of the texts."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(sizes, before + size)))
        yield batch.slice(at, to - at)
        at = to


def token_ids(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every text, without special tokens, whose strings are ordinary text.

    Null and empty text give the empty list. Every row, repeated ids and texts included, gives one row; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """
    load = ship_vocabulary(df.sparkSession, rank_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), bpe.encode(part.column(1).to_pylist())], names=[id_col, "ids"])

    rows = spread(df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")))
    return rows.mapInArrow(encode, f"`{id_col}` bigint, ids array<int>")


def token_counts(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): the sizes of ``token_ids`` without the ids; the same rules."""
    load = ship_vocabulary(df.sparkSession, rank_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.counts(part.column(1).to_pylist()))], names=[id_col, "n_tokens"])

    rows = spread(df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")))
    return rows.mapInArrow(count, f"`{id_col}` bigint, n_tokens bigint")
