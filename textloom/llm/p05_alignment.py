"""Problem 5: which segments of a record's source are translated by which segments of its translations.

Method: translation tables are learned on all roughly parallel segments: those of the same place in a source and a
translation of as many segments. Every segment becomes a bag of weighted units; the tables translate a unit into target
units. Within a record an inverted index from target
units to segments retrieves matches in both directions; pairs that are each other's best are kept, and from these
matches grow to neighbouring segments that the same partner also covers, which are merges. Reordering costs nothing,
since retrieval looks at no positions; segments that nothing covers stay alone.
"""

from __future__ import annotations

import itertools
import pickle
import re
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage

#: Rounds of expectation-maximization.
ROUNDS = 5
#: Probabilities that a task holds at once (of some target units, for every source unit), cells of pairs that it takes
#: at once, and bytes of cells it keeps in memory; those beyond go to a file of the task.
DENSE, SLICE, IN_MEMORY = 8_000_000, 2_000_000, 64 << 20
#: Translations kept for a unit, and the least probability of one.
KEEP, LEAST_P = 8, 0.03
#: Joint score that a pair of mutual best needs. Coverage by one partner that a segment left over needs: next to a
#: match, elsewhere, and with all its anchors found; and how much of the partner it must cover in turn.
SEED_SCORE, GROW_NEAR, GROW_FAR, GROW_ANCHORED, RETURN = 0.38, 0.52, 0.62, 0.42, 0.12

MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
HAN_SCALES = {"十": 10, "百": 100, "千": 1000, "万": 10000}

_MONTH = "|".join(m.capitalize() for m in MONTHS)
DATE = re.compile(
    rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})|(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日|(\d{{1,2}}) ({_MONTH}) (\d{{4}})|({_MONTH}) (\d{{1,2}}), (\d{{4}})"
)
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,}-\d+(?![A-Za-z0-9])")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
DIGIT = re.compile(r"\d")
HAN_NUMBER = re.compile("[零一二三四五六七八九两〇十百千万]{2,}|[十百]")
WORD = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’]*")
HAN_RUN = re.compile("[㐀-鿿]+")
NAME = re.compile(r"(?:[bcdfghjklmnpqrstvwxyz]{1,2}[aeiou]+){2,}[nrs]?$")
SYLLABLE = re.compile(r"[bcdfghjklmnpqrstvwxyz]{0,2}[aeiou]+")
STOP = set("the a an of and to in is for by that with on be at or any not as it its was has been are from under".split())


def han_value(text: str) -> int:
    total = part = 0
    for ch in text:
        if ch in HAN_SCALES:
            part = (part or 1) * HAN_SCALES[ch]
            total, part = total + part, 0
        else:
            part = HAN_DIGITS[ch]
    return total + part


def _spelled(words: list[str]) -> list[int]:
    """Numbers of ten or more written in English words."""
    out, value, open_ = [], 0, False
    for w in [p for word in words for p in word.split("-")] + [""]:
        if w in TENS or w in UNITS:
            value += TENS.get(w, UNITS.get(w, 0))
            open_ = True
        elif w == "hundred" and open_:
            value *= 100
        elif w == "and" and open_ and value >= 100:
            continue
        else:
            if open_ and value >= 10:
                out.append(value)
            value, open_ = 0, False
    return out


def units(text: str) -> dict[str, float]:
    """Weighted units of a segment. ``d:`` dates, ``k:`` codes and ``n:`` numbers are the same in every language;
    ``l:`` Latin names stay or are transliterated; ``w:`` words, ``b:`` pairs and ``h:`` single Han letters go
    through the tables. Weights of the last three come from the tables."""
    out: dict[str, float] = {}
    rest = text

    def date(m: re.Match) -> str:
        y, mo, d = next(
            (g for g in ((m[1], m[2], m[3]), (m[4], m[5], m[6]), (m[9], m[8], m[7]), (m[12], m[10], m[11])) if g[0]), ("0", "1", "1")
        )
        out[f"d:{y}-{int(MONTHS.get(mo.lower(), 0) or mo)}-{int(d)}"] = 3.0
        return " "

    if DIGIT.search(rest):
        rest = DATE.sub(date, rest)
        for m in CODE.finditer(rest):
            out["k:" + m.group().lower()] = 3.0
        rest = CODE.sub(" ", rest)
        for m in NUMBER.finditer(rest):
            number = m.group().replace(",", "")
            if "." in number and number.count(".") == 1:
                number = number.rstrip("0").rstrip(".") if len(number.split(".")[1]) == 2 and number.endswith("00") else number
            out["n:" + number] = 2.5 if len(number) > 1 else 1.5
    words = WORD.findall(rest)
    for w in words:
        low = w.lower()
        if w[0].isupper() and NAME.fullmatch(low) and low not in STOP and len(low) >= 4:
            out["l:" + low] = 2.0
        elif len(low) > 1 and low not in STOP:
            out["w:" + low] = 1.0
    if words:
        for value in _spelled(re.findall(r"[a-z]+(?:-[a-z]+)*", rest.lower())):
            out[f"n:{value}"] = 2.0
    for m in HAN_RUN.finditer(rest):
        run = m.group()
        for v in HAN_NUMBER.findall(run):
            if han_value(v) >= 10:
                out[f"n:{han_value(v)}"] = 2.0
        for i, ch in enumerate(run):
            out.setdefault("h:" + ch, 0.5)
            if i + 1 < len(run):
                out.setdefault("b:" + run[i : i + 2], 1.0)
    return out


def syllables(name: str) -> list[str]:
    return ["y:" + s for s in SYLLABLE.findall(name)]


def table_units(bag: dict[str, float]) -> list[str]:
    """The units of a bag that the tables translate; names as their syllables."""
    out = []
    for u in bag:
        if u[0] in "wbh":
            out.append(u)
        elif u[0] == "l":
            out.extend(syllables(u[2:]))
    return list(dict.fromkeys(out))


@dataclass
class Tables:
    """Learned translations, both ways: unit -> (other unit, probability relative to the best)."""

    forward: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    #: What a table unit looks up: its weight, its translations from the strongest on, no name.
    ready: dict[str, tuple[float, list[tuple[str, float]], None]] = field(default_factory=dict)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table units of roughly parallel segments, each side's set apart by spaces, which no unit holds."""
    for some in itertools.batched(_parallel(batches), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.string()) for side in zip(*some)], names=["one", "other"])


def _parallel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for record in _records(batches):
        source = record.get("source", [])
        even = [record[side] for side in ("a", "b") if side in record and len(record[side]) == len(source)]
        bags = [" ".join(table_units(units(row[4]))) for row in source] if even else []
        for rows in even:
            for bag, own, row in zip(bags, source, rows):
                if own[4] and row[4]:
                    yield bag, " ".join(table_units(units(row[4])))


def _chunk(sources: list[np.ndarray], targets: list[np.ndarray], blocks: int) -> Iterator[tuple[int, bytes]]:
    """The pairs by block of target units: the sources that have a target there, and for each place of a target its
    source and its number within the block."""
    pair = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
    target = np.concatenate(targets)
    for block in range(blocks):
        here = np.flatnonzero(target % blocks == block)
        if len(here):
            here = here[np.argsort(target[here], kind="stable")]
            kept, own = np.unique(pair[here], return_inverse=True)
            some = [sources[k] for k in kept]
            parts = (np.concatenate(some), np.array([len(s) for s in some]), own, target[here] // blocks)
            yield block, zlib.compress(pickle.dumps([x.astype(np.min_scalar_type(x.max())) for x in parts]), 1)


def _cells(payload: bytes, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (target of the block, source unit) of a chunk, and how many of them each place of a target has, by slices
    of whole places."""
    flat, lengths, own, target = (x.astype(np.int64) for x in pickle.loads(zlib.decompress(payload)))
    begins = np.cumsum(lengths) - lengths
    own_lengths = lengths[own]
    slices = np.cumsum(own_lengths) // SLICE
    for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(slices)) + 1):
        n = own_lengths[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells = np.repeat(target[at] * width, n) + flat[np.repeat(begins[own[at]], n) + inside]
        yield cells.astype(np.int32) if cells[-1] < 1 << 30 else cells, n


def _expected(payloads: Iterator[bytes], size: int, width: int, totals: list[np.ndarray]) -> np.ndarray:
    """Expected counts (target of the block, source unit) after as many rounds as there are totals of rounds, and one.
    A target unit's share among the source units of its segment hangs on no other target unit; only the sums over all
    target units, which are the totals, come from elsewhere."""
    with tempfile.SpooledTemporaryFile(IN_MEMORY) as kept:
        slices = 0
        for payload in payloads:
            for part in _cells(payload, width):
                pickle.dump(part, kept)
                slices += 1
        p, counts = np.ones(size * width), np.zeros(size * width)
        for total in [None, *totals]:
            if total is not None:
                np.divide(counts.reshape(size, width), np.maximum(total, 1e-12), out=p.reshape(size, width))
                counts.fill(0.0)
            kept.seek(0)
            for _ in range(slices):
                cells, n = pickle.load(kept)
                cells = cells.astype(np.intp)
                w = p[cells]
                w /= np.repeat(np.add.reduceat(w, np.cumsum(n) - n), n)
                np.add.at(counts, cells, w)
    return counts.reshape(size, width)


def _translations(bags: DataFrame, names: list[str]) -> Iterator[dict[str, list[tuple[str, float]]]]:
    """P(target unit | source unit) by IBM model 1 with an empty word over all pairs, for either direction.

    Each task holds the probabilities of a block of target units, so that no table of all cells is ever in one place;
    between rounds only the totals of the source units go by the driver. A round begins anew from the totals of those
    before, so nothing but the pairs is stored.
    """
    spark = bags.sparkSession
    sc = spark.sparkContext
    width = len(names) + 1  # 0 is the empty word
    blocks = min(len(names), max(sc.defaultParallelism, -(-width * width // DENSE)))
    tasks = min(2 * blocks, max(2 * sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ids = sc.broadcast({u: i for i, u in enumerate(names, 1)})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = ids.value
        for batch in filter(len, batches):
            sides = [[np.array(sorted(number[u] for u in bag.split()), np.int64) for bag in c.to_pylist()] for c in batch.columns]
            for way, (sources, targets) in enumerate((sides, sides[::-1])):
                with_empty = [np.concatenate(([0], s)) for s in sources]
                parts = [(way * blocks + block, payload) for block, payload in _chunk(with_empty, targets, blocks)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts), (pa.int32(), pa.binary()))], names=["part", "payload"])

    def rounds(totals: list[np.ndarray], last: bool) -> DataFrame:
        """(way, source, target, n): counts of the cells that may be kept in the last round, and with target -1 the
        totals of the source units."""
        shared = sc.broadcast(totals)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((c, b) for batch in batches for c, b in zip(batch.column(0).to_pylist(), batch.column(1)))
            for part, own in itertools.groupby(rows, key=lambda row: row[0]):
                way, block = divmod(part, blocks)
                counts = _expected((b.as_py() for _, b in own), width // blocks + 1, width, [t[way] for t in shared.value])
                sums = counts.sum(axis=0)
                source = np.flatnonzero(sums)
                target, n = np.full(len(source), -1), sums[source]
                if last:  # a total is no less than its part of this block, nor than 1 where it counts
                    t, s = np.nonzero(counts >= LEAST_P * 0.999 * np.maximum(sums, 1.0))
                    source, target, n = np.concatenate((source, s)), np.concatenate((target, t * blocks + block)), np.concatenate((n, counts[t, s]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(source), way, np.int32)), pa.array(source, pa.int64()), pa.array(target, pa.int64()), pa.array(n, pa.float64())],
                    names=["way", "source", "target", "n"],
                )

        return placed.mapInArrow(run, "way int, source bigint, target bigint, n double")

    def summed(found: DataFrame) -> DataFrame:
        # Decimals add up to the same in any order.
        return found.where("target < 0").groupBy("way", "source").agg(F.sum(F.col("n").cast("decimal(30,12)")).cast("double").alias("total"))

    # Payloads are sorted by their hash, so that sums come out alike whatever order the blocks arrive in.
    placed = cut_lineage(
        bags.mapInArrow(chunks, "part int, payload binary").repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", F.xxhash64("payload"))
    )
    totals: list[np.ndarray] = []
    for _ in range(ROUNDS - 1):
        total = np.zeros((2, width))
        for way, source, n in summed(rounds(totals, False)).collect():  # a row a unit and direction
            total[way, source] = n
        totals.append(total)
    found = cut_lineage(rounds(totals, True))
    p = F.round(F.col("n") / F.col("total"), 9).alias("p")
    likely = found.where("target > 0 and source > 0").join(summed(found).where("total >= 1"), ["way", "source"]).select("way", "source", "target", p)
    order = Window.partitionBy("way", "source").orderBy(F.desc("p"), "target")
    kept = likely.where(F.col("p") >= LEAST_P).withColumn("k", F.row_number().over(order)).where(F.col("k") <= KEEP)
    out: tuple[dict, dict] = ({}, {})
    for way, source, target, p, _ in kept.orderBy("way", "source", "k").collect():  # at most KEEP rows a unit and direction
        out[way].setdefault(names[source - 1], []).append((names[target - 1], p))
    yield from out


def learn_tables(bags: DataFrame) -> Tables:
    """Tables from the bags (one, other) of parallel segments, both directions. The tables hold every unit of the
    pairs, so what reaches the driver and is broadcast grows with the vocabulary, not with the rows."""
    bags = cut_lineage(bags)
    n = max(1, bags.count())
    unit = F.explode(F.split(F.concat_ws(" ", "one", "other"), " ")).alias("unit")
    seen = dict(map(tuple, bags.select(unit).where("unit <> ''").groupBy("unit").count().collect()))
    tables = Tables()
    if not seen:
        return tables
    # By falling number, so that the most frequent units are dealt out over the blocks.
    for way in _translations(bags, sorted(seen, key=lambda u: (-seen[u], u))):
        for u, ts in way.items():
            best = ts[0][1]
            known = dict(tables.forward.get(u, ()))
            for t, p in ts:
                known[t] = max(known.get(t, 0.0), p / best)
            tables.forward[u] = sorted(known.items(), key=lambda x: -x[1])[:KEEP]
    # Rare units tell segments apart; those in every second segment tell nothing.
    tables.weight = {u: max(0.05, float(np.log(n / c)) / float(np.log(n + 1))) for u, c in seen.items()}
    scale = {"w": 1.0, "b": 0.6, "h": 0.3}
    tables.ready = {u: (scale[u[0]] * tables.weight.get(u, 1.0), ts, None) for u, ts in tables.forward.items() if u[0] in scale}
    return tables


def _lookups(bag: dict[str, float], tables: Tables) -> list[tuple[float, list[tuple[str, float]], str | None]]:
    """The bag as (weight, translations with their strength, name) per unit. A Latin name counts half as it is, if it
    is there at all, and half by its syllables."""
    out, ready = [], tables.ready
    for u, w in bag.items():
        kind = u[0]
        if kind in "wbh":
            if u in ready:
                out.append(ready[u])
        elif kind == "l":
            parts = syllables(u[2:])
            out.append((w / 2, [], u))
            out.extend((w / 2 / len(parts), [(u, 1.0), *tables.forward.get(s, ())], None) for s in parts)
        else:
            out.append((w, [(u, 1.0)], None))
    return out


def _index(bags: list[dict[str, float]]) -> dict[str, list[int]]:
    """Units, names' syllables included, to the segments that hold them."""
    index: dict[str, list[int]] = defaultdict(list)
    for i, bag in enumerate(bags):
        keys = set(bag)
        for u in bag:
            if u[0] == "l":
                keys.update(syllables(u[2:]))
        for k in keys:
            index[k].append(i)
    return index


class _Side:
    """The segments of one side of a record: bags, inverted index, and what the bags look up in another index."""

    def __init__(self, texts: list[str], tables: Tables) -> None:
        self.bags = [units(t) for t in texts]
        self.index = _index(self.bags)
        self.lookups = [_lookups(bag, tables) for bag in self.bags]


def _coverage(side: _Side, index: dict[str, list[int]]) -> list[dict[int, float]]:
    """For every bag of ``side``: how much of its weight each indexed segment covers."""
    out, get = [], index.get
    for lookups in side.lookups:
        total, score = 0.0, defaultdict(float)
        for w, translations, name in lookups:
            if name is not None:
                held = get(name)
                if held:
                    total += w
                    for i in held:
                        score[i] += w
                continue
            total += w
            best: dict[int, float] = {}
            for t, strength in translations:  # the strongest first
                held = get(t)
                if held:
                    for i in held:
                        if i not in best:
                            best[i] = strength
            for i, strength in best.items():
                score[i] += w * strength
        out.append({i: s / total for i, s in score.items()} if total else {})
    return out


def align(source: list[str], target: list[str], tables: Tables) -> list[tuple[int, int]]:
    """Pairs (source position, target position) of segments that translate one another, whole or in part."""
    return _align(_Side(source, tables), _Side(target, tables))


def _align(one: _Side, other: _Side) -> list[tuple[int, int]]:
    a, b = one.bags, other.bags
    there = _coverage(one, other.index)
    back = _coverage(other, one.index)
    joint: dict[tuple[int, int], float] = {}
    for i, row in enumerate(there):
        for j, f in row.items():
            r = back[j].get(i, 0.0)
            # The fuller direction counts more: a part of a merged segment is covered whole, but covers half.
            joint[i, j] = 0.65 * max(f, r) + 0.35 * min(f, r) + 1e-6 * (1 - abs(i / max(1, len(a)) - j / max(1, len(b))))
    best_there = {}
    best_back = {}
    for (i, j), v in joint.items():
        if v > joint.get((i, best_there.get(i, -1)), 0.0):
            best_there[i] = j
        if v > joint.get((best_back.get(j, -1), j), 0.0):
            best_back[j] = i
    links = {(i, j) for i, j in best_there.items() if best_back.get(j) == i and _seeds(joint[i, j], a[i], b[j])}
    _grow(links, a, b, there, back)
    return sorted(links)


def _anchors(bag: dict[str, float], other: dict[str, float]) -> float | None:
    """The share of a bag's dates, codes and longer numbers that another holds; None if it has none."""
    own = [u for u in bag if u[0] in "dk" or u[0] == "n" and len(u) > 4]
    return sum(u in other for u in own) / len(own) if own else None


def _seeds(score: float, one: dict[str, float], other: dict[str, float]) -> bool:
    """A weak pair of mutual best needs an anchor in common where either side has any."""
    return score >= SEED_SCORE and (score >= 0.75 or (_anchors(one, other) != 0 and _anchors(other, one) != 0))


def _grow(links: set[tuple[int, int]], a: list[dict], b: list[dict], there: list[dict[int, float]], back: list[dict[int, float]]) -> None:
    """Adds to ``links`` the segments left over that are part of a partner's merge. A match grows to neighbours
    first; a part further off needs more coverage, or all of its anchors, as merges may follow reordering."""

    def joins(cover: float, again: float, found: float | None, near: bool) -> bool:
        if again < RETURN or (found == 0 and cover < 0.75):
            return False
        return cover >= (GROW_ANCHORED if found == 1 else GROW_NEAR if near else GROW_FAR)

    for near in (True, False):
        grown = True
        while grown:
            grown = False
            used_i, used_j = {i for i, _ in links}, {j for _, j in links}
            for j in range(len(b)):
                if j not in used_j and back[j]:
                    i = max(back[j], key=lambda x: (back[j][x], -x))
                    if (not near or any((i, k) in links for k in (j - 1, j + 1))) and joins(
                        back[j][i], there[i].get(j, 0.0), _anchors(b[j], a[i]), near
                    ):
                        links.add((i, j))
                        grown = True
            for i in range(len(a)):
                if i not in used_i and there[i]:
                    j = max(there[i], key=lambda x: (there[i][x], -x))
                    if (not near or any((k, j) in links for k in (i - 1, i + 1))) and joins(
                        there[i][j], back[j].get(i, 0.0), _anchors(a[i], b[j]), near
                    ):
                        links.add((i, j))
                        grown = True


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[tuple]]]:
    """Rows (rec_id, side, seg_idx, sent_id, text), sorted by record, as one record at a time: side to rows, each
    sent_id once."""
    own: dict[str, list[tuple]] = {}
    current, seen = None, set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != current:
                if own:
                    yield own
                own, current, seen = {}, row[0], set()
            if row[3] not in seen:
                seen.add(row[3])
                own.setdefault(row[1], []).append(row)
    if own:
        yield own


def align_segments(segments: DataFrame) -> DataFrame:
    """(src_sent_id, tgt_sent_id): a source segment and a segment of side a or b of its record that translates all
    or a part of it.

    Rows repeated under one sent_id of a record count once. Segments whose record, side or id is null, and sides other than
    source, a and b, are not aligned; null and empty texts match nothing; ties go to the nearest place, then the
    first; empty tables give no rows; other columns are not read. A record's segments, which made up one text, are
    aligned together; records are sorted and streamed, so a task holds one record at a time.
    """
    rows = segments.where(F.col("rec_id").isNotNull() & F.col("sent_id").isNotNull() & F.col("side").isin("source", "a", "b")).select(
        "rec_id", "side", "seg_idx", "sent_id", F.coalesce("seg_text", F.lit("")).alias("seg_text")
    )
    records = rows.repartition("rec_id").sortWithinPartitions("rec_id", "side", "seg_idx", "sent_id")
    tables = segments.sparkSession.sparkContext.broadcast(learn_tables(records.mapInArrow(_pairs, "one string, other string")))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        learned = tables.value
        for record in _records(batches):
            if "source" not in record or len(record) < 2:
                continue
            own = {side: _Side([r[4] for r in rows], learned) for side, rows in record.items()}
            for side in ("a", "b"):
                if side in own:
                    for i, j in _align(own["source"], own[side]):
                        left.append(record["source"][i][3])
                        right.append(record[side][j][3])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src_sent_id", "tgt_sent_id"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src_sent_id", "tgt_sent_id"])

    return records.mapInArrow(pair, "src_sent_id bigint, tgt_sent_id bigint")
