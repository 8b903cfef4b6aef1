"""Model output brought into shape: token spellings, white space, leaked prompts, scripts, numbers.

All steps are columns but one: restoring numbers depends on what earlier numbers of the same text used up, and runs
over Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import patterns as P
from textloom.functions.issues import has_prompt_artifact
from textloom.functions.masking import CUT
from textloom.functions.text import control_tokens, sentinels, strip_sentinels, trimmed

#: Marks a token while it is rewritten.
MARK = "\u0002"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: what a lambda refers to from outside is else worked out for
    every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def binding(position: int):
    """Binds the text that a function takes at ``position``, which its expression names several times."""

    def wrap(function):
        @wraps(function)
        def call(*args: Column) -> Column:
            return bound(args[position], lambda t: function(*args[:position], t, *args[position + 1 :]))

        return call

    return wrap


def sentinel_parts(text: Column) -> Column:
    """Text and tokens in turn, empty texts kept: the tokens at odd places."""
    return F.split(F.regexp_replace(_text(text), f"({P.SENTINEL})", f"{CUT}$1{CUT}"), CUT, -1)


def on_plain_parts(text: Column, change) -> Column:
    """``text`` with ``change`` applied to what lies between tokens."""
    return F.array_join(F.transform(sentinel_parts(text), lambda p, i: F.when(i % 2 == 1, p).otherwise(change(p))), "")


def decoded_sentinels(text: Column) -> Column:
    """Tokens that a model spelt in double or corner brackets, ``[[TAB]]``, ``【NT:3】`` or ``《SEG:12》``, as they should be."""
    opened, closed = r"(?:\[\[|【|《)(?U:\s*)", r"(?U:\s*)(?:\]\]|】|》)"
    out = F.regexp_replace(_text(text), f"{opened}(TAB|BR|NBH|SHY){closed}", "<<MT_$1>>")
    for kinds, most, width in (("NT", 4, P.NT_WIDTH), ("SEG|END", 6, P.SEG_WIDTH)):
        out = F.regexp_replace(out, f"{opened}({kinds}):([0-9]{{1,{most}}}){closed}", f"<<{MARK}$1:{'0' * width}$2>>")
        out = F.regexp_replace(out, f"<<{MARK}({kinds}):[0-9]*([0-9]{{{width}}})>>", "<<MT_$1:$2>>")
    return out


def exact_markers(text: Column) -> Column:
    """Segment markers with spaces about their number or another number of zeros, in their exact form."""
    out = F.regexp_replace(_text(text), r"<<MT_(SEG|END):(?U:\s*)0*([0-9]{1,6})(?U:\s*)>>", f"<<{MARK}$1:000000$2>>")
    return F.regexp_replace(out, f"<<{MARK}(SEG|END):[0-9]*([0-9]{{6}})>>", "<<MT_$1:$2>>")


@binding(0)
def cleaned_output(text: Column) -> Column:
    """Without the fence of a code block, surrounding double quotes and edge spaces."""
    bare = trimmed(_text(text))
    fenced = bare.startswith("```")
    inner = F.when(fenced, F.regexp_replace(bare, r"^[^\n]*\n", "")).otherwise(bare)
    inner = F.when(fenced & inner.contains("```"), F.regexp_extract(inner, r"(?s)^(.*)```", 1)).otherwise(inner)
    return trimmed(F.regexp_replace(trimmed(inner), r'^"+|"+$', ""))


def with_first_replaced(text: Column, needle: Column, replacement: Column, n: Column) -> Column:
    """``text`` with the first ``n`` places of ``needle`` replaced; an empty needle replaces nothing."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def joined(parts: Column) -> Column:
        rest = F.slice(parts, n + 2, F.greatest(F.size(parts) - n - 1, F.lit(0)))
        head = F.replace(F.array_join(F.slice(parts, 1, n + 1), CUT), F.lit(CUT), replacement)
        return F.when(F.size(rest) > 0, F.concat(head, needle, F.replace(F.array_join(rest, CUT), F.lit(CUT), needle))).otherwise(head)

    return F.when((needle == "") | (n <= 0) | ~F.contains(text, needle), text).otherwise(bound(F.split(text, quoted, -1), joined))


def _times(text: Column, piece: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)).cast("int")


def _folded(nt_map: Column, text: Column, step) -> Column:
    entries = F.array_sort(F.coalesce(F.map_entries(nt_map), F.array().cast("array<struct<key:string,value:string>>")))
    return F.aggregate(entries, text, lambda acc, e: step(acc, e["key"], F.coalesce(e["value"], F.lit(""))))


def balanced_tokens(frozen: Column, nt_map: Column, text: Column) -> Column:
    """As many of every token as the source has: missing ones take the place of their originals, surplus ones turn
    back into them, first places first, tokens in order."""

    def step(acc: Column, token: Column, original: Column) -> Column:
        def change(n: Column) -> Column:
            wanted, held = n["wanted"], n["held"]
            return (
                F.when((wanted > 0) & (held < wanted), with_first_replaced(acc, original, token, wanted - held))
                .when((wanted > 0) & (held > wanted), with_first_replaced(acc, token, original, held - wanted))
                .otherwise(acc)
            )

        return bound(F.struct(_times(_text(frozen), token).alias("wanted"), _times(acc, token).alias("held")), change)

    return _folded(nt_map, _text(text), step)


def restored_tokens(nt_map: Column, text: Column) -> Column:
    """Every token that ``text`` lacks, put in the first place of its original."""
    return _folded(nt_map, _text(text), lambda acc, token, original: F.when(F.contains(acc, token), acc).otherwise(with_first_replaced(acc, original, token, F.lit(1))))


def only_allowed_sentinels(text: Column, allowed: Column) -> Column:
    parts = F.transform(sentinel_parts(text), lambda p, i: F.when((i % 2 == 1) & ~F.array_contains(allowed, p), F.lit("")).otherwise(p))
    return F.array_join(parts, "")


@binding(1)
def without_prompt_artifacts(source: Column, text: Column) -> Column:
    """Leaked labels and tags of prompts taken out, unless the source has such itself."""
    leaked = has_prompt_artifact(strip_sentinels(_text(text))) & ~has_prompt_artifact(strip_sentinels(_text(source)))
    clean = F.regexp_replace(F.regexp_replace(_text(text), P.PROMPT_TAG, " "), P.PROMPT_LABEL, " ")
    return F.when(leaked, trimmed(F.regexp_replace(clean, r"(?U)\s{2,}", " "))).otherwise(_text(text))


def plain_output(text: Column) -> Column:
    """Odd spaces as spaces, none between Han characters, none at the edges; line ends and tabs stay."""
    spaced = F.regexp_replace(_text(text), P.ODD_SPACES, " ")
    return F.trim(F.regexp_replace(spaced, P.HAN_GAP, ""))


@binding(1)
def edges_of_source(frozen: Column, text: Column) -> Column:
    """Every part between tokens with the edge spaces of the source's part, where both have as many parts; parts
    with line ends or tabs at an edge stay."""
    edge = lambda s, k: F.regexp_extract(s, r"(?Us)^(\s*)(.*?)(\s*)$", k)

    def part(p: Column) -> Column:
        raw = F.concat(edge(p["t"], 1), edge(p["t"], 3)).rlike("[\r\n\t]")
        return F.when(p["s"].rlike(f"^{P.SENTINEL}$"), p["s"]).when(raw, p["t"]).otherwise(F.concat(edge(p["s"], 1), edge(p["t"], 2), edge(p["s"], 3)))

    def fitted(both: Column) -> Column:
        pieces = F.transform(F.arrays_zip(both["s"].alias("s"), both["t"].alias("t")), part)
        return F.when(F.size(both["s"]) == F.size(both["t"]), F.array_join(pieces, "")).otherwise(_text(text))

    parts = F.struct(sentinel_parts(frozen).alias("s"), sentinel_parts(text).alias("t"))
    return F.when(_text(text) == "", "").otherwise(bound(parts, fitted))


def _inner(target_lang: Column, text: Column) -> Column:
    zh = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, P.HAN_GAP, ""), P.ZH_SPACE_BEFORE, "$1"), P.ZH_SPACE_AFTER, "$1")
    other = F.regexp_replace(text, " {2,}", " ")
    for pattern in (P.EN_SPACE_BEFORE, P.EN_SPACE_AFTER, P.EN_SPACE_BEFORE_CLOSE):
        other = F.regexp_replace(other, pattern, "$1")
    return F.when(F.lower(_text(target_lang)).startswith("zh"), zh).otherwise(other)


def inner_spaces(target_lang: Column, text: Column) -> Column:
    """Spaces between Han characters and at punctuation taken out, by the target language; edges of parts stay."""
    edge = lambda s, k: F.regexp_extract(s, r"(?Us)^(\s*)(.*?)(\s*)$", k)
    return on_plain_parts(text, lambda p: F.concat(edge(p, 1), _inner(target_lang, edge(p, 2)), edge(p, 3)))


def space_flags(target_lang: Column, text: Column) -> Column:
    """What ``inner_spaces`` would mend: a sorted array of cjk_inner_space, multi_space and space_punct."""
    zh = F.lower(_text(target_lang)).startswith("zh")

    def flags(cores: Column) -> Column:
        any_of = lambda *patterns: F.exists(cores, lambda c: c.rlike("|".join(patterns)))
        closed = F.exists(F.transform(cores, lambda c: F.regexp_replace(c, P.HAN_GAP, "")), lambda c: c.rlike(f"{P.ZH_SPACE_BEFORE}|{P.ZH_SPACE_AFTER}"))
        return F.array_compact(
            F.array(
                F.when(zh & any_of(P.HAN_GAP), "cjk_inner_space"),
                F.when(~zh & any_of(" {2,}"), "multi_space"),
                F.when((zh & closed) | (~zh & any_of(P.EN_SPACE_BEFORE, P.EN_SPACE_AFTER, P.EN_SPACE_BEFORE_CLOSE)), "space_punct"),
            )
        )

    return bound(F.transform(F.filter(sentinel_parts(text), lambda p, i: i % 2 == 0), trimmed), flags)


@binding(1)
def repaired_controls(frozen: Column, text: Column) -> Column:
    """Raw line ends and tabs as the tokens that are missing against the source, first places first, else spaces."""
    lack = lambda name: F.greatest(F.lit(0), _times(_text(frozen), F.lit(name)) - _times(_text(text), F.lit(name)))
    found = F.transform(_all(_text(text), "\r\n|\r|\n|\t"), lambda b, i: F.struct(i.alias("i"), (b == "\t").alias("tab")))

    def replaced(own: Column) -> Column:
        first = lambda tab, n: F.transform(F.slice(F.filter(own["breaks"], lambda b: b["tab"] == tab), F.lit(1), n), lambda b: b["i"])

        def pieces(use: Column) -> Column:
            instead = F.transform(
                own["breaks"],
                lambda b: F.when(F.array_contains(use["tabs"], b["i"]), "<<MT_TAB>>").when(F.array_contains(use["lines"], b["i"]), "<<MT_BR>>").otherwise(" "),
            )
            return F.transform(F.arrays_zip(own["parts"].alias("l"), instead.alias("t")), lambda p: F.concat(p["l"], F.coalesce(p["t"], F.lit(""))))

        return bound(F.struct(first(F.lit(True), own["need_tabs"]).alias("tabs"), first(F.lit(False), own["need_lines"]).alias("lines")), pieces)

    own = F.struct(
        found.alias("breaks"), F.split(_text(text), "\r\n|\r|\n|\t", -1).alias("parts"), lack("<<MT_TAB>>").alias("need_tabs"), lack("<<MT_BR>>").alias("need_lines")
    )
    return F.array_join(bound(own, replaced), "")


@binding(2)
def expected_scripts(source: Column, target_lang: Column, text: Column) -> Column:
    """For Chinese targets, characters of other scripts that the source does not have taken out."""

    def cleaned(allowed: Column) -> Column:
        return on_plain_parts(text, lambda p: F.array_join(F.filter(F.split(p, ""), lambda c: ~c.rlike(P.OTHER_SCRIPTS) | F.array_contains(allowed, c)), ""))

    allowed = F.array_distinct(_all(strip_sentinels(_text(source)), P.OTHER_SCRIPTS))
    foreign = F.lower(_text(target_lang)).startswith("zh") & _text(text).rlike(P.OTHER_SCRIPTS)
    return F.when(foreign, bound(allowed, cleaned)).otherwise(_text(text))


@binding(2)
def filled_references(source: Column, target_lang: Column, text: Column) -> Column:
    """For Chinese targets, ``第X条`` and ``第条`` with the source's number, where the source has one number only."""
    def filled(numbers: Column) -> Column:
        fill = lambda p: F.replace(F.regexp_replace(p, rf"(?U)第\s*(?:[Xx?*]\s*)?({P.ZH_REFERENCE_KINDS})", f"第{CUT}$1"), F.lit(CUT), F.get(numbers, F.lit(0)))
        return F.when(F.size(numbers) == 1, on_plain_parts(text, fill)).otherwise(_text(text))

    numbers = F.array_distinct(_all(strip_sentinels(_text(source)), P.NUMBER_TOKEN))
    return F.when(F.lower(_text(target_lang)).startswith("zh"), bound(numbers, filled)).otherwise(_text(text))


def chinese_numeral(n: int) -> str:
    """A number below 10,000 in Chinese; ten to nineteen begin with 十."""
    if n < 10:
        return P.HAN_NUMERALS[n]
    out, gap = "", False
    for base, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        digit = n // base % 10
        if digit:
            out += ("零" if gap and out else "") + ("" if base == 10 and digit == 1 and not out else P.HAN_NUMERALS[digit]) + unit
        gap = digit == 0
    return out


_NUMBER = re.compile(P.NUMBER_TOKEN.replace("(?U)", "").replace(r"(?<!\d)", "").replace(r"(?!\d)", ""))  # runs of digits are taken whole
_SENTINEL = re.compile(P.SENTINEL)
_PARTS = re.compile(f"({P.SENTINEL})")
_YEAR = re.compile(r"(?<!\d)\d{4}(?!\d)")
_NUMERAL_REFERENCE = re.compile(rf"第\s*([{P.HAN_NUMERALS}十百千]+)\s*({P.ZH_REFERENCE_KINDS})")
_REFERENCES = tuple(
    (re.compile(rf"\b{word}\s+(\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?)\b", re.IGNORECASE), form)
    for word, form in P.REFERENCE_FORMS
)


def _numbers(text: str) -> Counter[str]:
    return Counter(_NUMBER.findall(_SENTINEL.sub(" ", text)))


def kept_numbers(source: str | None, nt_map: dict[str, str] | None, translated: str | None, target_lang: str | None) -> str:
    """``translated`` with the numbers of the source and no others.

    Numbers beyond those of the source, less those of its tokens, are taken out. For Chinese targets, numbers still
    missing are put back: for a Chinese numeral of a reference, as a year before the first text where the source
    begins with that year, or for a phrase such as 本条 where the source names a section, article, clause, paragraph
    or schedule of that number.
    """
    text, plain, names = translated or "", _SENTINEL.sub(" ", source or ""), nt_map or {}
    required = _numbers(source or "")
    left = required - sum((Counter(_NUMBER.findall(names.get(t) or "")) for t in _SENTINEL.findall(text) if t.startswith("<<MT_NT:")), Counter())

    def keep(m: re.Match[str]) -> str:
        if left[m.group()] <= 0:
            return ""
        left[m.group()] -= 1
        return m.group()

    def parts(t: str) -> list[str]:
        return _PARTS.split(t)

    def missing(t: str) -> Counter[str]:
        return required - _numbers(_SENTINEL.sub(lambda m: names.get(m.group()) or m.group(), t))

    text = "".join(p if i % 2 else _NUMBER.sub(keep, p) for i, p in enumerate(parts(text)))
    lost = missing(text) if text and target_lang == "zh" else None
    if not lost:
        return text
    before = text
    wanted = {chinese_numeral(int(t)): t for t in lost if t.isdigit() and (t[0] != "0" or t == "0") and int(t) < 10_000}
    left = Counter({t: lost[t] for t in wanted.values()})

    def in_digits(m: re.Match[str]) -> str:
        token = wanted.get(m[1])
        if token is None or left[token] <= 0:
            return m[0]
        left[token] -= 1
        return f"第{token}{m[2]}"

    text = _NUMERAL_REFERENCE.sub(in_digits, text) if wanted else text
    lost = missing(text) if text != before else lost
    before = text
    for token in lost:
        if token in _YEAR.findall(plain[:32]):
            pieces = parts(text)
            at = next((i for i in range(0, len(pieces), 2) if pieces[i].strip()), None)
            if at is not None:
                body = pieces[at].lstrip()
                pieces[at] = pieces[at][: len(pieces[at]) - len(body)] + token + "年" + body
                text = "".join(pieces)
    lost = missing(text) if text != before else lost
    forms: dict[str, str] = {}
    for pattern, form in _REFERENCES if lost else ():
        for number in pattern.findall(plain):
            forms.setdefault(number, form)
    for token, n in lost.items():
        for _ in range(n if token in forms else 0):
            phrase = next((p for p in P.ZH_GENERIC_REFERENCES if p in text), None)
            if phrase:
                text = text.replace(phrase, forms[token].format(token), 1)
    return text


def _with_kept_numbers(names: list[str], out: str):
    """Adds ``out`` to batches: ``kept_numbers`` of the columns named (source, map, text, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in names))
            kept = pa.array([kept_numbers(s, dict(m) if m is not None else None, t, lang) for s, m, t, lang in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], names=[*batch.schema.names, out])

    return run


def normalized_candidate(df: DataFrame, source: str, frozen: str, nt_map: str, raw: str, target_lang: str, out: str = "candidate") -> DataFrame:
    """``df`` with ``out``, a model's translation brought into shape in a fixed order, and ``space_flags``; a null
    translation is empty."""
    src, frz, back, lang = F.col(source), F.col(frozen), F.col(nt_map), F.col(target_lang)
    step = df.withColumn("_1", repaired_controls(frz, plain_output(F.col(raw))))
    step = step.withColumn("_2", only_allowed_sentinels(restored_tokens(back, without_prompt_artifacts(src, F.col("_1"))), sentinels(frz)))
    schema = StructType([*step.schema.fields, StructField("_3", StringType())])
    step = step.mapInArrow(_with_kept_numbers([source, nt_map, "_2", target_lang], "_3"), schema)
    step = step.withColumn("_4", edges_of_source(frz, expected_scripts(src, lang, filled_references(src, lang, F.col("_3")))))
    step = step.withColumns({out: edges_of_source(frz, inner_spaces(lang, F.col("_4"))), "space_flags": space_flags(lang, F.col("_4"))})
    return step.drop("_1", "_2", "_3", "_4")


def missing_controls(frozen: Column, text: Column) -> Column:
    """Whether the control tokens of ``text`` are another sequence than the source's."""
    return control_tokens(_text(frozen)) != control_tokens(_text(text))
