"""Problem 3: one consistent form for texts that look the same.

Method: texts are exploded to positioned code points; a broadcast table maps each code point to what it decomposes
to or looks like; combining marks are ordered by class behind their base; a second broadcast table recomposes each
base with its marks; the string is rebuilt by position. Code points that map to themselves and combine with nothing
need none of this: texts made of them only keep their form as they are and are not exploded, and within other texts
a run of them is one positioned unit.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import cut_lineage

# Letters that look like Latin ones (Cyrillic, Greek, Armenian, small capitals aside), as pairs.
LOOK_ALIKES = dict(
    pair.split("=")
    for pair in (
        "А=A В=B Е=E Ѕ=S І=I Ј=J К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ү=Y Ԍ=G Ԛ=Q Ԝ=W "
        "а=a е=e о=o р=p с=c у=y х=x ѕ=s і=i ј=j һ=h ԁ=d ԛ=q ԝ=w ѵ=v к=k ӏ=l ү=y "
        "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X "
        "ο=o ν=v ρ=p ι=i κ=k υ=u χ=x α=a γ=y "
        "Օ=O Ս=U Տ=S օ=o ս=u ո=n հ=h ց=g ք=p ɡ=g ɑ=a"
    ).split()
)
#: Marks that look like a hyphen or an apostrophe; dashes of another width stay what they are.
LOOK_ALIKE_MARKS = {"‐": "-", "‑": "-", "⁃": "-", "˗": "-", "ʼ": "'", "՚": "'", "∕": "/", "⁄": "/"}
#: Compatibility decompositions that leave the look as it is, but for width: of letters, digits and marks alike.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
#: Invisible characters.
INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x180B, 0x180E), *range(0x200B, 0x2010),
             *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0000, 0xE0080)}


def _step(ch: str) -> str | None:
    """What one character becomes in one step, or None if it stays."""
    code = ord(ch)
    if code in INVISIBLE:
        return ""
    if ch in LOOK_ALIKES or ch in LOOK_ALIKE_MARKS:
        return LOOK_ALIKES.get(ch) or LOOK_ALIKE_MARKS[ch]
    category = unicodedata.category(ch)
    if category == "Zs":
        return None if ch == " " else " "
    form = unicodedata.decomposition(ch)
    if not form:
        return None
    if not form.startswith("<"):
        return "".join(chr(int(x, 16)) for x in form.split())
    kind, *points = form.split()
    target = "".join(chr(int(x, 16)) for x in points)
    if kind in SAME_LOOK:
        return target
    # Radicals that look like their ideographs, and ligatures that look like their letters.
    if kind == "<compat>" and (0x2E80 <= code < 0x2FE0 or 0xFB00 <= code < 0xFB07):
        return target
    return None


@cache
def _full(ch: str) -> str:
    step = _step(ch)
    return ch if step is None else "".join(map(_full, step))


@cache
def mapping_table() -> tuple[dict[str, str], dict[str, int]]:
    """(character: what it becomes, for all that do not stay; combining mark: its class). Built from rules over all
    of Unicode, so the size is fixed: some 2,800 and 900 rows. Hangul syllables stay composed."""
    changed, marks = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        target = _full(ch)
        if target != ch:
            changed[ch] = target
        if unicodedata.combining(ch):
            marks[ch] = unicodedata.combining(ch)
    return changed, marks


@cache
def composition_table() -> dict[str, str]:
    """Base and marks in order: the composed characters they make."""
    changed, _ = mapping_table()
    out = {}
    for ch, target in changed.items():
        if len(target) > 1 and unicodedata.normalize("NFC", target) != target:
            out[target] = unicodedata.normalize("NFC", target)
    return out


#: Ranges of everyday characters. A text of these only, less those that the tables concern, needs no work; texts
#: with any other character are worked out, so the ranges decide on speed alone.
EVERYDAY = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x17F), (0x2013, 0x2026), (0x3001, 0x301F), (0x3041, 0x3096),
            (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0xFF01, 0xFF1F))


def _char_class(points: Iterable[int]) -> str:
    """A pattern of one character of ascending ``points``."""
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@cache
def _stays() -> str:
    changed, marks = mapping_table()
    compositions = set(composition_table().values())
    everyday = (p for low, high in EVERYDAY for p in range(low, high + 1))
    return _char_class(p for p in everyday if chr(p) not in marks and (chr(p) not in changed or chr(p) in compositions))


@cache
def plain_pattern() -> str:
    """A pattern of the texts that are their own consistent form by their characters alone."""
    return f"^{_stays()}*+$"


@cache
def unit_pattern() -> str:
    """A pattern of the positioned units of a text: one code point, or a run of code points that all stay. The last
    of a run is left to itself where what follows may become a mark on it, or vanish before such a mark."""
    changed, marks = mapping_table()
    joins = _char_class(sorted({ord(c) for c in marks} | {ord(c) for c, t in changed.items() if not t or t[0] in marks}))
    return f"(?s){_stays()}+(?!{joins})|."


def canonical(text: str) -> str:
    """The specification for one string: what the distributed operator gives."""
    changed, marks = mapping_table()
    flat = "".join(changed.get(c, c) for c in text)
    out, cluster = [], []
    compose = composition_table()

    def close() -> None:
        if cluster:
            base = cluster[0] if cluster[0] not in marks else ""
            tail = sorted(cluster[1:] if base else cluster, key=lambda c: marks[c])
            whole = base + "".join(tail)
            out.append(compose.get(whole) or (compose.get(whole[:2], whole[:2]) + whole[2:]))

    for c in flat:
        if c in marks:
            cluster.append(c)
        else:
            close()
            cluster = [c]
    close()
    return "".join(out)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    changed, marks = mapping_table()
    maps = spark.createDataFrame(list(changed.items()), "ch string, target string")
    classes = spark.createDataFrame([(c, k) for c, k in marks.items()], "unit string, ccc int")
    composed = spark.createDataFrame(list(composition_table().items()), "cluster string, composed string")
    return F.broadcast(maps), F.broadcast(classes), F.broadcast(composed)


def consistent_form(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with ``out_col``: the consistent form of ``text_col``.

    Full-width characters, punctuation too, become narrow and half-width ones wide, invisible characters go, all spaces become U+0020, canonical
    equivalents and look-alike letters become one; case, accents, digits and wording stay. Null stays null, empty
    stays empty; equal texts are worked out once; rows keep their number and their other columns, of which none may
    be called ``out_col``, ``text_key`` or ``rebuilt``; an empty table gives no rows. Broadcast tables are built from
    Unicode and of fixed size.
    """
    touched = ~F.col(text_col).rlike(plain_pattern())
    some = df.where(touched).withColumn("text_key", F.md5(text_col))
    rest = df.where(~touched | F.col(text_col).isNull()).withColumn(out_col, F.col(text_col))
    texts = some.select("text_key", F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    # A text of invisible characters alone has nothing left to rebuild: its form is the empty string.
    done = some.join(rebuild(texts), "text_key", "left").withColumn(out_col, F.coalesce("rebuilt", F.lit(""))).drop("text_key", "rebuilt")
    return rest.unionByName(done)


def rebuild(texts: DataFrame) -> DataFrame:
    """(text_key, rebuilt) of (text_key, text). One shuffle by text brings the code points of a text together, as
    they were in the text; what follows keeps that partitioning."""
    maps, classes, composed = _tables(texts.sparkSession)
    units = (
        texts.select("text_key", F.posexplode(F.regexp_extract_all("text", F.lit(unit_pattern()), F.lit(0))).alias("pos", "ch"))
        .join(maps, "ch", "left")
        .select("text_key", "pos", F.posexplode(F.when(F.col("target").isNull(), F.array("ch")).otherwise(F.split("target", ""))).alias("sub", "unit"))
        .where("unit <> ''")
        .join(classes, "unit", "left")
        .withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    )
    place = Window.partitionBy("text_key").orderBy("pos", "sub")
    clusters = (
        units.withColumn("cluster", F.sum((F.col("ccc") == 0).cast("int")).over(place))
        .groupBy("text_key", "cluster")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "unit"))), lambda u: u["unit"]), "").alias("cluster_text"))
    )
    head = F.substring("cluster_text", 1, 2)
    short = composed.select(F.col("cluster").alias("head"), F.col("composed").alias("head_composed"))
    whole = composed.select(F.col("cluster").alias("cluster_text"), "composed")
    joined = clusters.join(whole, "cluster_text", "left").join(F.broadcast(short), head == F.col("head"), "left")
    form = F.coalesce(
        "composed",
        F.concat("head_composed", F.expr("substring(cluster_text, 3)")),
        "cluster_text",
    )
    return joined.groupBy("text_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", form.alias("form")))), lambda u: u["form"]), "").alias("rebuilt")
    )


#: Members of one string above which they are spread over salts, and the salts.
HOT_STRING, HOT_SALTS = 100_000, 64


def _classes(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, string, salt, id), and pairs of different strings of one key with the number of members of
    each. The members of hot strings have salts above 0; there are at most ``rows / HOT_STRING`` hot strings, which
    are counted exactly."""
    members = cut_lineage(forms.distinct())
    strings = members.groupBy("key", "string").agg(F.count("*").alias("n"))
    several = strings.groupBy("key").agg(F.count("*").alias("strings")).where("strings > 1").select("key")
    alike = strings.join(several, "key")
    pairs = alike.alias("a").join(alike.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.string") < F.col("b.string")))
    pairs = pairs.select(F.col("a.key").alias("key"), F.col("a.string").alias("one"), F.col("b.string").alias("other"), F.col("a.n").alias("ones"), F.col("b.n").alias("others"))
    hot = strings.where(F.col("n") > HOT_STRING).select("string", F.lit(HOT_SALTS).alias("salts"))
    salted = members.join(F.broadcast(hot), "string", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    return salted.select("key", "string", "salt", "id"), pairs


def look_alike_records(df: DataFrame, id_col: str = "rec_id", text_col: str = "source_surface") -> DataFrame:
    """(left_id, right_id): records whose texts look the same but are not the same string, the smaller id first.

    Null texts look like nothing; an id repeated with one text counts once; an id whose rows have look-alike texts
    is not paired with itself; an empty table gives no rows; other columns are not read. Pairs are formed between
    the different strings of a form, of which there are few, and then joined with the members of each string,
    spread over salts, so the many copies of one string never meet in one task.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    forms = consistent_form(texts, "text", "form").select(
        F.unhex(F.md5("form")).alias("key"), F.unhex(F.md5("text")).alias("string"), "id"
    )
    members, pairs = _classes(forms)

    def with_salts(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.when(F.col(count) > HOT_STRING, HOT_SALTS - 1).otherwise(0)))

    left = pairs.withColumn("salt", with_salts("ones")).join(
        members.select("key", F.col("string").alias("one"), "salt", F.col("id").alias("a")), ["key", "one", "salt"]
    )
    both = left.withColumn("salt", with_salts("others")).join(
        members.select("key", F.col("string").alias("other"), "salt", F.col("id").alias("b")), ["key", "other", "salt"]
    )
    return (
        both.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
        .distinct()
    )


def look_alike_terms(df: DataFrame, glossary: DataFrame, id_col: str = "rec_id", terms_col: str = "terms") -> DataFrame:
    """(left_id, right_id): a record and the glossary term whose src or tgt looks the same as an element of the
    record's terms that equals neither. Null arrays and elements look like nothing; rows repeated under one id count
    once; other columns are not read. The glossary is joined by its form; Spark sends it out whole only if it is
    below the session's broadcast limit."""
    elements = (
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("left_id"), F.explode(terms_col).alias("term"))
        .where(F.col("term").isNotNull() & (F.trim("term") != ""))
    )
    names = glossary.select("term_id", "src", "tgt", F.explode(F.array("src", "tgt")).alias("name")).where("name is not null")
    wanted = consistent_form(names, "name", "form").select(F.col("term_id").alias("right_id"), "src", "tgt", "form").distinct()
    equal = F.coalesce(F.col("term") == F.col("src"), F.lit(False)) | F.coalesce(F.col("term") == F.col("tgt"), F.lit(False))
    return consistent_form(elements, "term", "form").join(wanted, "form").where(~equal).select("left_id", "right_id").distinct()
