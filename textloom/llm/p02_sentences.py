"""Problem 2: sentence units of every document, in any of six languages.

Method: a semi-Markov model over whole spans. A line's candidate boundaries are found first; dynamic programming
then selects the spans of the best total score. A span's score joins its length, the closing word before its end,
the opening word of what follows, and the balance of quotations and brackets within it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import spread

# Abbreviations after which a sentence goes on, and those that may also end one.
GOES_ON = set(
    "dr mr mrs ms prof st no nos nr art arts fig figs abs anl abschn fa vgl approx cl ext vs sec secs ing dipl bzw ca "
    "ie eg cf pp vol vols tel ref dept hon gen capt bd kap ziff evtl ggf inkl zzgl max min zb dh vh डॉ रु श्री पृ सं".split()
)
MAY_END = set("etc ltd inc co corp pm am usw seq ff jr sr bros al ag gmbh".split())
#: Words before a number with a point that make it a German ordinal.
ORDINAL_BEFORE = set("am vom zum der die das den dem des bis ab im jeder jede jedes seit".split())
#: Words that continue a sentence after a closing quotation mark, where the script has no capitals.
CONTINUES = re.compile(r"और|तथा|ने|का|की|के|से|को|पर|में|कि|है|是|的|地|得|と|に|を|は|が|の|も|で|へ|や|から|まで|より|ため|という|って|など")
#: A list or article label at the start of a line; it belongs to what follows.
LABEL = re.compile(
    r"(?:[•\-–—*►▪·○●]\s*)?(?:[(（](?:[0-9]{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,6}|[一二三四五六七八九十百]{1,4})[)）]|"
    r"(?:[0-9]{1,3}(?:\.[0-9]{1,3})*|[a-zA-Z]|[ivxlcIVXLC]{1,6})[.)](?=\s|[^\x00-\x7f])|"
    r"(?:[0-9]{1,3}|[一二三四五六七八九十百]{1,4})[、．]|[0-9]{1,3}(?:\.[0-9]{1,3})+(?=\s))?\s*"
)
LINE = re.compile("[^\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+")
END = re.compile(r"[.!?。！？।॥｡…]+")
THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
LAST_WORD = re.compile(r"[^\s(\[{„“\"'«「『（]*$")
EDGE = " \t\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\ufeff"
PAIRS = {"„": "“", "“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
CLOSERS = frozenset("”’」』）)]】》〉»")
#: What ends inside brackets does not end the sentence around them, where no capital says that another begins.
BRACKETS = frozenset(")）]】》〉")
MARKS = re.compile("[\"„“”‘’«»「」『』()（）\\[\\]【】《》〈〉]")

# Weights of the model.
STRONG, GOOD, FAIR, NEVER = 3.0, 2.0, 1.5, -9.0
OPEN_COST = 4.0
SHORT_COST, LONG_FROM, LONG_STEP = 4.0, 400, 150.0
#: Differences of scores below this are rounding.
ROUNDING = 1e-9


class _Depth:
    """Open quotations and brackets at any position of a line, and where closing marks stand."""

    def __init__(self, line: str) -> None:
        self.at: list[int] = []
        self.depth: list[int] = []
        self.closing: set[int] = set()
        stack: list[tuple[str, int]] = []
        for m in MARKS.finditer(line):
            ch, i = m.group(), m.start()
            if ch == '"':
                if any(c == '"' for c, _ in stack):
                    while stack and stack.pop()[0] != '"':
                        pass
                    self.closing.add(i)
                else:
                    stack.append(('"', i))
            elif ch == "“" and any(c == "“" for c, _ in stack):
                while stack and stack.pop()[0] != "“":
                    pass
                self.closing.add(i)
            elif ch in PAIRS:
                if ch == "‘" and i and line[i - 1].isalnum():
                    continue
                stack.append((PAIRS[ch], i))
            elif any(c == ch for c, _ in stack):
                while stack and stack.pop()[0] != ch:
                    pass
                self.closing.add(i)
            else:
                continue
            self.at.append(i)
            self.depth.append(len(stack))

    def __call__(self, p: int) -> int:
        """Depth just before position ``p``."""
        lo, hi = 0, len(self.at)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.at[mid] < p:
                lo = mid + 1
            else:
                hi = mid
        return self.depth[lo - 1] if lo else 0


def _opening(line: str, p: int) -> tuple[str, str]:
    """The first character of what follows position ``p`` and its class: upper, lower, digit, letter (a script
    without case), quote, mark."""
    ch = line[p]
    if ch.isalpha():
        if ch.islower():
            # A name such as iPhone opens a sentence like a capital.
            return ch, "upper" if line[p + 1 : p + 2].isupper() else "lower"
        return ch, "upper" if ch.isupper() or ch.istitle() else "letter"
    if ch.isdigit():
        return ch, "digit"
    return ch, "quote" if ch in "\"„“‘«「『【《(（[" else "mark"


def _point(line: str, start: int, at: int, run: int, gap: bool, kind: str, closed: bool) -> float:
    """Score of a boundary after a full point at ``at`` (a run of ``run`` points); ``start`` is where the line's
    text begins, ``gap`` whether white space follows, ``closed`` whether closing marks do."""
    if run > 3:
        return NEVER
    if kind == "lower" or kind == "mark" and not closed:
        return NEVER
    if run > 1:
        return 0.5 if gap else NEVER
    if closed:
        return GOOD if gap or kind in ("upper", "letter", "quote") else NEVER
    word = LAST_WORD.search(line, max(start, at - 40), at).group()
    tail = re.split(r"[.\-–/]", word)[-1].lower()
    bare = word.replace(".", "").lower()
    if not tail and not bare:
        return NEVER
    if len(tail) == 1 and tail.isalpha() and not ("぀" <= tail <= "鿿"):
        return FAIR if bare in MAY_END and gap and kind != "lower" else NEVER
    if tail in GOES_ON or bare in GOES_ON:
        return NEVER
    if tail in MAY_END or bare in MAY_END:
        return FAIR if gap else NEVER
    if tail.isdigit():
        before = line[max(start, at - 30) : at - len(word)].split()
        if not gap:
            return FAIR if kind in ("upper", "quote") and before else NEVER
        if len(word) <= 2:
            if not before or before[-1].lower() in ORDINAL_BEFORE or re.fullmatch(r"\d+\.", before[-1]):
                return NEVER
        return GOOD
    if not gap:
        if kind == "digit" or "@" in word or "/" in word or "\\" in word or "://" in line[max(start, at - 60) : at].split(" ")[-1]:
            return NEVER
        return FAIR if kind in ("upper", "quote", "letter") else NEVER
    return GOOD


def split_line(line: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the units of ``line[start:end]``, whose edges are no white space."""
    body = LABEL.match(line, start, end).end()
    if body >= end:
        return [(start, end)]
    found: list[tuple[int, int, float]] = []
    depth: _Depth | None = None
    for m in END.finditer(line, body, end):
        at, p = m.start(), m.end()
        marks = m.group()
        if depth is None:
            depth = _Depth(line[:end])
        closed = False
        while p < end and (line[p] in CLOSERS or line[p] in '"“') and p in depth.closing:
            p += 1
            closed = True
        while closed and p < end and line[p] in ".!?。！？।":
            p += 1
        if p >= end:
            break
        q = p
        while q < end and line[q] in EDGE:
            q += 1
        if q >= end:
            break
        ch, kind = _opening(line, q)
        gap = q > p
        last = marks[-1]
        if last == ".":
            score = _point(line, body, at, len(marks), gap, kind, closed) if set(marks) == {"."} else GOOD
        elif last == "…":
            score = NEVER if len(marks) > 1 or kind != "upper" or not gap else 0.5
        elif last in "!?":
            if kind == "lower" or kind == "mark":
                score = NEVER
            elif gap:
                score = STRONG
            else:
                score = GOOD if kind in ("upper", "letter", "quote") else NEVER
        else:
            score = NEVER if kind == "mark" and ch in "，、；：,;:.。…—-" else STRONG
        if closed and score > 0 and (CONTINUES.match(line, q) or (kind == "letter" and line[p - 1] in BRACKETS)):
            score = NEVER
        if score > NEVER:
            found.append((p, q, score - OPEN_COST * depth(p)))
    if "฀" <= max(line[start:end]) and THAI_GAP.search(line, body, end):
        for m in THAI_GAP.finditer(line, body, end):
            found.append((m.start(), m.end(), GOOD))
        found.sort()
    found = [f for f in found if f[2] > -OPEN_COST * 2]
    if not found:
        return [(start, end)]
    return _best_spans(found, start, end)


def _span_cost(length: int) -> float:
    cost = SHORT_COST if length < 3 else 0.0
    return cost + (length - LONG_FROM) / LONG_STEP if length > LONG_FROM else cost


def _best_spans(found: list[tuple[int, int, float]], start: int, end: int) -> list[tuple[int, int]]:
    """The spans of the highest total score. Where every candidate has a positive score and no span between
    neighbours costs anything, taking all of them is that best choice, and the search is not needed.

    The search is bounded by the scores alone, so its choice is the best of all. A span's cost grows by at most 1 /
    LONG_STEP a character: a start whose score lies further below an earlier one's than that can make up is dropped
    for good. Looking back ends where no earlier start can reach the best choice found."""
    opens = [start] + [q for _, q, _ in found]
    closes = [p for p, _, _ in found] + [end]
    scores = [s for *_, s in found] + [0.0]
    if all(s > 0 for s in scores[:-1]) and all(3 <= c - o <= LONG_FROM for o, c in zip(opens, closes)):
        return list(zip(opens, closes))
    n = len(closes)
    best = [0.0] + [float("-inf")] * n
    back = [0] * (n + 1)
    # Starts still worth a look; up to each, the best score, and the best of score and place for spans beyond LONG_FROM.
    starts, highest, reach = [0], [0.0], [opens[0] / LONG_STEP]
    for j in range(1, n + 1):
        close, own = closes[j - 1], scores[j - 1]
        for k in range(len(starts) - 1, -1, -1):
            i = starts[k]
            if close > opens[i]:
                value = best[i] + own - _span_cost(close - opens[i])
                # Of equal choices the longest span is taken.
                if value >= best[j]:
                    best[j], back[j] = value, i
            if k and own + min(highest[k - 1], reach[k - 1] - (close - LONG_FROM) / LONG_STEP) < best[j] - ROUNDING:
                break
        if j < n and best[j] + opens[j] / LONG_STEP >= reach[-1] - ROUNDING:
            starts.append(j)
            highest.append(max(highest[-1], best[j]))
            reach.append(max(reach[-1], best[j] + opens[j] / LONG_STEP))
    spans, j = [], n
    while j:
        i = back[j]
        spans.append((opens[i], closes[j - 1]))
        j = i
    return spans[::-1]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and exclusive end of every unit of ``text``, in code points. Every visible character lies in a unit."""
    out: list[tuple[int, int]] = []
    for m in LINE.finditer(text):
        a, b = m.span()
        while a < b and (text[a] in EDGE or text[a].isspace()):
            a += 1
        while b > a and (text[b - 1] in EDGE or text[b - 1].isspace()):
            b -= 1
        if a == b:
            continue
        line = text[m.start() : m.end()]
        base = m.start()
        for s, e in split_line(line, a - base, b - base):
            out.append((base + s, base + e))
    return out


TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
NAMES = ["doc_id", "unit", "start_pos", "end_pos", "text", "suffix"]


def _units(with_text: bool):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(TYPES) if with_text else 4

        def flush(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES[:width])

        cols: list[list] = [[] for _ in range(width)]
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                spans = sentence_spans(text)
                cols[0].extend([doc] * len(spans))
                cols[1].extend(range(len(spans)))
                cols[2].extend(a for a, _ in spans)
                cols[3].extend(b for _, b in spans)
                if with_text:
                    nexts = [a for a, _ in spans[1:]] + [len(text)]
                    cols[4].extend(text[a:b] for a, b in spans)
                    cols[5].extend(text[b:n] for (_, b), n in zip(spans, nexts))
                held += len(text)
                if held > 4_000_000:
                    yield flush(cols)
                    cols, held = [[] for _ in range(width)], 0
        yield flush(cols)

    return units


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, unit, start_pos, end_pos[, text, suffix]): the units of every text, in order; ``suffix`` is the
    white space after a unit, up to the next one or the end.

    Null, empty and blank texts have no units. Every row is split, so repeated ids give repeated units; a null id
    stays null; an empty table gives no rows; other columns are not read. Texts are processed whole.
    """
    rows = spread(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    schema = "doc_id bigint, unit int, start_pos int, end_pos int"
    return rows.mapInArrow(_units(with_text), schema + (", text string, suffix string" if with_text else ""))
