"""Problem 10: texts cut off by a field limit or mid-transfer, and how often each source cuts.

Method: length histograms per source, in characters and in bytes, are tested for spikes. Two tests follow. Values at a
spike without terminal punctuation are cut by the limit, unless their last line is one that the corpus shows to be
whole. Limits miss texts cut mid-transfer, so values of other lengths are tested too, by their ending alone. What is
whole the corpus itself shows: a line that is followed by another line was never cut, so its form is a whole line's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.p02_sentences import EDGE, GOES_ON, LAST_WORD, LINE, MAY_END, _Depth
from textloom.session import cut_lineage, spread

FULL_END = re.compile(r"[.!?。！？।॥｡][\"'”’“»)）」』\]】》]*$")
CONTENTS = re.compile(r"(?:\.{4,}|…{2,})\s*\d*$|_{3,}$")
CONTENTS_LEADER = re.compile(r"^[^.…]{1,60}?\s*(?:\.{4,}|…{4,})$")
DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
NAME = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’]*(?: [A-ZÀ-ÖØ-ÞĀ-Ž][\w'’]*)*")
LABELLED = re.compile(r"^([^:：.。]{1,24}[:：])")
THAI_END = re.compile(r"[฀-๿]$")
SPIKE_REACH = 40
SALTS = 16
#: A form of last line that this share of all texts have is a customary closing, if at least so many do.
CLOSING_SHARE, CLOSING_LEAST = 0.001, 3
#: Names masked in a form vary if two of its lines agree in their exact form at most this often, as they do where
#: 20 exact forms are equally common.
SAME_SHARE = 0.05


def _digits(line: str) -> str:
    return DIGITS.sub("9", line)


def line_forms(line: str) -> list[str]:
    """The forms under which a line without final punctuation is known: digits aside, names aside, its
    marks if it stands between two, and for Thai, which has no final punctuation, its ending."""
    forms = []
    if len(line) <= 80:
        exact = _digits(line)
        forms.append("l" + exact)
        masked = NAME.sub("X", exact)
        if re.search(r"[^\W\d_X]|[^\w\s,.]", masked.replace("X", "")) or re.search(r"\d", masked):
            forms.append("m" + masked)
    if len(line) > 2 and not line[0].isalnum() and not line[-1].isalnum() and len(line) <= 80:
        forms.append(f"d{line[0]}{line[-1]}")
    if THAI_END.search(line):
        forms.append("t" + NAME.sub("X", _digits(line[-40:]))[-10:])
    return forms


def closing_form(line: str) -> str | None:
    """The form under which last lines are counted as closings: the label alone, or names and digits masked."""
    if len(line) > 80:
        return None
    m = LABELLED.match(line)
    if m:
        return m.group(1)
    masked = NAME.sub("X", _digits(line))
    return None if re.fullmatch(r"[X\s,.]*", masked) and "." not in masked else masked


def doubtful_end(line: str) -> str | None:
    """A key for ends that a full point leaves in doubt: after a number or an abbreviation. None: beyond doubt."""
    body = line.rstrip("\"'”’“»)）」』]】》")
    if not body.endswith(".") or len(body) < 2:
        return None
    word = LAST_WORD.search(body, max(0, len(body) - 41), len(body) - 1).group()
    tail = re.split(r"[.\-–/]", word)[-1].lower()
    bare = word.replace(".", "").lower()
    if word[-1:].isdigit():
        if not word[:1].isdigit():
            return "e" + NAME.sub("X", _digits(word))
        before = body[: len(body) - 1 - len(word)].split()
        return "e" + (before[-1] if before and not before[-1][:1].isdigit() else "") + " " + _digits(word)
    if tail in GOES_ON or bare in GOES_ON or tail in MAY_END or bare in MAY_END or len(tail) == 1:
        return "e" + word.lower()
    if "@" in word or "\\" in word or "/" in word or "." in word:
        return "e" + re.sub(r"\w+", "w", word)
    return None


def ending(text: str) -> tuple[str, list[str], str | None]:
    """How ``text`` ends: ``none`` (no visible character), ``full``, ``open`` (inside a quotation, bracket or
    ellipsis), ``doubt`` or ``bare``; with the forms to look up and the closing form."""
    visible = text.rstrip()
    while visible and (visible[-1] in EDGE or visible[-1].isspace()):
        visible = visible[:-1].rstrip()
    if not visible:
        return "none", [], None
    line = LINE.findall(visible)[-1].strip(EDGE)
    if CONTENTS.search(line) and (line[-1] not in ".…" or CONTENTS_LEADER.match(line)):
        return "full", [], None
    if line.endswith(("..", "…", "[...]")):
        return "open", [], None
    if FULL_END.search(line):
        if _Depth(line)(len(line)) > 0:
            return "open", [], None
        key = doubtful_end(line)
        return ("doubt", [key], None) if key else ("full", [], None)
    return "bare", line_forms(line), closing_form(line)


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, texts = (batch.column(i) for i in range(3))
        found = [ending(t) if t else ("none", [], None) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                sources,
                batch.column(3),
                batch.column(4),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.list_(pa.string())),
                pa.array([f[2] for f in found], pa.string()),
                batch.column(5),
            ],
            names=["doc_id", "source", "n_chars", "n_bytes", "ends", "forms", "closing", "same"],
        )


def _whole_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms of all lines that are followed by another visible line, with the exact form of the line for forms that
    mask names, and counts; each once per batch."""
    for batch in batches:
        known: Counter[tuple[str, str]] = Counter()
        for text in batch.column(0).to_pylist():
            lines = [s for line in LINE.findall(text or "") if (s := line.strip(EDGE))]
            for line in lines[:-1]:
                if FULL_END.search(line):
                    key = doubtful_end(line)
                    if key:
                        known[key, ""] += 1
                else:
                    forms = line_forms(line)
                    for form in forms:
                        known[form, forms[0] if form[0] == "m" else ""] += 1
        forms, exact = zip(*known) if known else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(forms, pa.string()), pa.array(exact, pa.string()), pa.array(list(known.values()), pa.int64())], names=["form", "exact", "n"]
        )


def _varied(exact: DataFrame) -> DataFrame:
    """(form, n, varied) of (form, exact, n): whether exact forms vary within a form. The measure is the share of
    pairs of lines that have the same exact form. Its expectation does not depend on the number of lines, as the
    number of exact forms per line does: names drawn from a finite set run out while lines grow."""
    pairs = F.sum(F.col("n") * (F.col("n") - 1.0))
    return (
        exact.groupBy("form", "exact")
        .agg(F.sum("n").alias("n"))
        .groupBy("form")
        .agg(F.sum("n").alias("n"), pairs.alias("same"))
        .select("form", "n", ((F.col("n") > 1) & (F.col("same") <= SAME_SHARE * F.col("n") * (F.col("n") - 1.0))).alias("varied"))
    )


def _known(forms: DataFrame) -> DataFrame:
    """The forms that vouch for a last line. One that masks names does so only if names in it vary, as in ``Prepared
    by X``: where few exact forms make up many lines, as headings do, a last line must have one of those."""
    return _varied(forms).where(~F.col("form").startswith("m") | F.col("varied")).select("form")


def length_spikes(lengths: DataFrame) -> DataFrame:
    """(source, measure, length, n): lengths that far more texts of a source have than lengths nearby.

    ``lengths`` has source, n_chars and n_bytes. The histogram is exact. A length is a spike if its count is above
    the mean of the ``SPIKE_REACH`` lengths on either side by more than 6 times that mean's square root, and 4.
    Null sources form one source.
    """
    measured = lengths.select(
        "source",
        F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("n_chars", "n_bytes"))).alias("measure", "length"),
    ).where("length > 0")
    histogram = measured.groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    mean = (F.sum("n").over(near) - F.col("n")) / (2 * SPIKE_REACH)
    return (
        histogram.withColumn("mean", mean)
        .where(F.col("n") > F.col("mean") + 6 * F.sqrt("mean") + 4)
        .select("source", "measure", "length", "n")
    )


def judge_endings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, cut, at_limit, how): every row, whether its text was cut, whether its length is at a spike, and
    how it was cut: ``limit``, ``transfer`` or null.

    Null, empty and blank texts are not cut. Every row is judged by itself, repeated ids and texts too; a null
    source is a source of its own; an empty table gives no rows; other columns are not read. What the corpus shows
    is counted over distinct texts, so repeating a table changes no judgement.
    """
    rows = spread(
        df.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.col(text_col).cast("string").alias("text"),
        )
    )
    texts = rows.select("doc_id", "source", "text", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("same"))
    docs = cut_lineage(
        texts.mapInArrow(
            _endings,
            "doc_id bigint, source string, n_chars int, n_bytes int, ends string, forms array<string>, closing string, same bigint",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    docs = _at_spike(docs, length_spikes(docs.select("source", "n_chars", "n_bytes", "same").distinct()))
    whole = _known(df.select(F.col(text_col).cast("string").alias("text")).distinct().mapInArrow(_whole_forms, "form string, exact string, n bigint"))
    # Closings are counted where no limit was met: what a limit cuts off often must not pass for customary.
    lines = (
        docs.where(F.col("closing").isNotNull() & ~F.col("at_limit"))
        .select(F.concat(F.lit("c"), "closing").alias("form"), F.get("forms", F.lit(0)).alias("exact"), "same")
        .distinct()
        .groupBy("form", "exact")
        .agg(F.count("*").alias("n"))
    )
    enough = F.col("n") >= F.greatest(F.lit(CLOSING_LEAST), F.lit(CLOSING_SHARE) * docs.select("same").distinct().count())
    customary = _varied(lines).where(enough & F.col("varied")).select("form").unionByName(
        lines.where(enough).select(F.col("exact").alias("form"))
    )
    asked = docs.select(
        "row", F.explode(F.concat(F.col("forms"), F.when(F.col("closing").isNotNull(), F.array(F.concat(F.lit("c"), "closing"))).otherwise(F.array().cast("array<string>")))).alias("form")
    )
    salted = whole.unionByName(customary).select("form", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    vouched = (
        asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        .join(salted, ["form", "salt"], "left_semi")
        .select("row")
        .distinct()
    )
    judged = docs.join(vouched.withColumn("whole", F.lit(True)), "row", "left")
    terminal, whole = F.col("ends").isin("full", "none"), (F.col("ends") != "open") & F.col("whole").isNotNull()
    how = F.when(terminal | whole, None).when(F.col("at_limit"), "limit").otherwise("transfer")
    return judged.select("doc_id", "source", how.isNotNull().alias("cut"), "at_limit", how.alias("how"))


def _at_spike(docs: DataFrame, spikes: DataFrame) -> DataFrame:
    """Spikes are few: per source at most as many as lengths with 5 texts or more. Gathered to one small row per
    (source, length) and joined on both, so a source with a third of all rows is spread over its lengths."""
    key: Column = F.coalesce("source", F.lit("\u0000"))
    chars = spikes.where("measure = 'chars'").select(key.alias("s"), F.col("length").alias("n_chars"), F.lit(True).alias("by_chars"))
    size = spikes.where("measure = 'bytes'").select(key.alias("s"), F.col("length").alias("n_bytes"), F.lit(True).alias("by_bytes"))
    return (
        docs.withColumn("s", key)
        .join(chars, ["s", "n_chars"], "left")
        .join(size, ["s", "n_bytes"], "left")
        .withColumn("at_limit", F.coalesce("by_chars", "by_bytes", F.lit(False)))
    )


def truncation_rates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, documents, cut, cut_at_limit, cut_in_transfer, share): how often each source cuts, and how; rules as
    in ``judge_endings``."""
    return (
        judge_endings(df, id_col, text_col, source_col)
        .groupBy("source")
        .agg(
            F.count("*").alias("documents"),
            F.count_if("cut").alias("cut"),
            F.count_if(F.col("how") == "limit").alias("cut_at_limit"),
            F.count_if(F.col("how") == "transfer").alias("cut_in_transfer"),
        )
        .withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
    )
