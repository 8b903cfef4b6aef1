"""Languages of texts and units: looks, labels, previews, number tokens and the language pair of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.patterns import ACRONYM_TOKEN, COMMON_WORDS, ENTITY_STOP_WORDS, ENTITY_SUFFIX, NUMBER_TOKEN, OTHER_SCRIPTS
from textloom.functions.text import blank, collapsed, counted, scope_type, sentinels, strip_sentinels, trimmed


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def one_line(text: Column) -> Column:
    """White space runs as one space, edges none."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def other_script_count(text: Column) -> Column:
    return counted(text, OTHER_SCRIPTS)


def looks_english(text: Column) -> Column:
    """Has Latin words, and a common English one among them if there are four or more."""
    words = _all(F.lower(text), "[a-z]{2,}")
    return (F.size(words) > 0) & ((F.size(words) < 4) | F.exists(words, lambda w: w.isin(*COMMON_WORDS)))


def looks_like_entity(text: Column) -> Column:
    """Reads as the name of a company: a legal form, no function words but ``and``, most words capitalised."""
    line = one_line(text)
    words = F.transform(_all(line, r"[A-Za-z][A-Za-z'.]+"), lambda w: F.struct(F.lower(w).alias("low"), F.regexp_replace(w, r"^\.+|\.+$", "").alias("w")))
    stops = F.exists(words, lambda x: (x["low"] != "and") & F.regexp_replace(x["low"], r"^\.+|\.+$", "").isin(*ENTITY_STOP_WORDS))
    upper = lambda x: (F.length(x["w"]) >= 2) & (F.upper(x["w"]) == x["w"])
    title = lambda x: upper(x) | x["w"].rlike(r"^[A-Z](?:$|[a-z'.]*[a-z][a-z'.]*$)")
    n, uppers, titles = F.size(words), F.size(F.filter(words, upper)), F.size(F.filter(words, title))
    enough = ((uppers >= 2) & (uppers >= 0.6 * n)) | ((titles >= F.when(n <= 4, 2).otherwise(3)) & (titles >= 0.6 * n))
    return (line != "") & (F.length(line) <= 120) & line.rlike(ENTITY_SUFFIX) & (n > 0) & ~stops & enough


def _code(code: Column) -> Column:
    return F.replace(F.lower(trimmed(F.coalesce(code, F.lit("")))), F.lit("_"), F.lit("-"))


def normalized_lang(code: Column) -> Column:
    """``en`` or ``zh`` by prefix; null for any other code."""
    return F.when(_code(code).startswith("en"), "en").when(_code(code).startswith("zh"), "zh")


def lang_label(code: Column) -> Column:
    """Chinese or English by prefix, else the code without edge spaces."""
    return F.when(_code(code).startswith("zh"), "Chinese").when(_code(code).startswith("en"), "English").otherwise(trimmed(code))


def lang_prompt_name(code: Column, native: bool = False) -> Column:
    chinese = "简体中文" if native else "Simplified Chinese"
    return F.when(_code(code).startswith("en"), "English").when(_code(code).startswith("zh"), chinese).otherwise(code)


def cut_short(text: Column, width: int, mark: str = "...") -> Column:
    """At most ``width`` characters, the mark included."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(max(0, width - len(mark)))), F.lit(mark))).otherwise(text)


def preview(text: Column, width: int) -> Column:
    """A line for logs: line ends spelled out, tokens in single brackets, white space collapsed, cut to ``width``."""
    spelled = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    bare = F.regexp_replace(spelled, "<(<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]{4}|SEG:[0-9]{6}|END:[0-9]{6})>)>", "$1")
    line = one_line(F.regexp_replace(bare, "<(<MT_[A-Z:0-9]+>)>", "$1"))
    return cut_short(line, width) if width > 0 else line


def heading_text(text: Column, width: int = 120) -> Column:
    return cut_short(collapsed(F.coalesce(text, F.lit(""))), width)


def shortened(text: Column, width: int) -> Column:
    """A collapsed line of ``width`` characters and an ellipsis after them if there were more."""
    line = one_line(F.coalesce(text, F.lit("")))
    return F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width)), F.lit("…"))).otherwise(line)


def number_tokens(text: Column) -> Column:
    """Numbers of a text, tokens aside: groups, decimals and ranges in one, in order."""
    return _all(strip_sentinels(F.coalesce(text, F.lit(""))), NUMBER_TOKEN)


def must_preserve(text: Column) -> Column:
    """Tokens, digit runs and acronyms of a text, each once, in that order."""
    return F.array_distinct(F.concat(sentinels(text), _all(text, r"(?U)\d+"), _all(text, ACRONYM_TOKEN)))


def translate_decision(source: Column, frozen: Column, source_lang: Column) -> Column:
    """Why a unit is translated (``ok``) or not: nine reasons, the first that holds."""
    t = collapsed(F.coalesce(source, F.lit("")))
    han, latin, accented = counted(t, "[一-鿿]"), counted(t, "[A-Za-z]"), counted(t, "[À-ɏ]")
    english, chinese = source_lang == "en", source_lang == "zh"
    return (
        F.when(t == "", "empty")
        .when(blank(F.regexp_replace(F.coalesce(frozen, F.lit("")), "<<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]{4}|SEG:[0-9]{6}|END:[0-9]{6}|SLOT:[0-9]{6})>>", "")), "sentinel_only")
        .when((other_script_count(t) > 0) & (han + latin + accented == 0), "other_script")
        .when(english & (latin == 0) & (han > 0), "already_zh")
        .when(english & (latin == 0), "no_latin")
        .when(english & (accented >= 2) & ~looks_english(t), "non_english_latin")
        .when(chinese & (han == 0) & (latin > 0), "already_en")
        .when(chinese & (han == 0), "no_cjk")
        .otherwise("ok")
    )


#: Units of a document that vote on its languages, at most: a feature of the decision.
VOTERS = 200


def detect_language_pair(units: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, en_votes, zh_votes, unknown_votes, cjk, latin, latin_ext, other, src, tgt, decision) for every document.

    ``units`` has part_name, scope_key and source_surface. The first 200 paragraphs of the main part vote, or the
    first 200 units where it has none; blank ones count among them and do not vote. src, tgt and decision are null
    where other scripts alone are found. One shuffle by document; each unit's votes are worked out before it.
    """
    t = collapsed(F.coalesce("source_surface", F.lit("")))
    rows = units.select(
        key,
        *order,
        (F.coalesce(F.col("part_name").endswith("word/document.xml"), F.lit(False)) & (scope_type(F.col("scope_key")) == "w:p") & (F.coalesce("source_surface", F.lit("")) != "")).alias("preferred"),
        counted(t, "[一-鿿]").alias("cjk"),
        counted(t, "[A-Za-z]").alias("latin"),
        counted(t, "[À-ɏ]").alias("latin_ext"),
        other_script_count(t).alias("other"),
        looks_english(t).alias("english"),
        (t == "").alias("none"),
    )
    first = Window.partitionBy(key, "preferred").orderBy(*order)
    heads = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= VOTERS)
    cjk, latin, ext = F.col("cjk"), F.col("latin"), F.col("latin_ext")
    vote = (
        F.when(F.col("none"), None)
        .when(F.col("other") > 0, "unknown")
        .when((cjk >= 4) & (cjk >= 2 * (latin + ext)), "zh")
        .when((latin >= 4) & (latin >= 2 * cjk) & (ext <= F.greatest(F.lit(1), F.floor(latin * 0.03))), F.when(F.col("english"), "en").otherwise("unknown"))
        .when((cjk > 0) & (latin == 0) & (ext == 0), "zh")
        .when((latin > 0) & (cjk == 0) & (ext == 0), "en")
        .otherwise("unknown")
    )
    sums = heads.withColumn("_vote", vote).groupBy(key, "preferred").agg(
        *[F.count_if(F.col("_vote") == v).alias(f"{v}_votes") for v in ("en", "zh", "unknown")],
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("cjk", "latin", "latin_ext", "other")],
    )
    names = [c for c in sums.columns if c not in (key, "preferred")]
    best = sums.groupBy(key).agg(F.max_by(F.struct(*names), "preferred").alias("s")).select(key, *[f"s.{c}" for c in names])
    en, zh = F.col("en_votes"), F.col("zh_votes")
    above = lambda a, b, by: a >= F.floor(b * by)
    decision = (
        F.when((en + zh + latin + cjk == 0) & (F.col("other") > 0), None)
        .when((zh >= 3) & above(zh, en, 1.2) & above(cjk, latin, 1.1), "zh->en")
        .when((en >= 3) & above(en, zh, 1.2) & above(latin, cjk, 1.1), "en->zh")
        .when(above(cjk, latin, 1.25) & (cjk >= 20), "zh->en(low_conf)")
        .when(above(latin, cjk, 1.25) & (latin >= 20), "en->zh(low_conf)")
        .when(zh > en, "zh->en(weak_vote)")
        .when(en > zh, "en->zh(weak_vote)")
        .when(cjk > latin, "zh->en(weak_char)")
        .otherwise("en->zh(weak_char)")
    )
    return best.withColumn("decision", decision).withColumns({"src": F.left("decision", F.lit(2)), "tgt": F.substring("decision", 5, 2)})
