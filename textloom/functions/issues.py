"""Named issues of a translation against its source, and the decisions that rest on them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.functions.language import looks_english, looks_like_entity, number_tokens, one_line
from textloom.functions.masking import unfreeze
from textloom.functions.text import collapsed, control_tokens, counted, multiset, sentinels, strip_sentinels, trimmed


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def has_prompt_artifact(text: Column) -> Column:
    return text.rlike(P.PROMPT_TAG) | text.rlike(P.PROMPT_LABEL)


def unexpected_scripts(source: Column, target: Column) -> Column:
    """Characters of scripts beside Latin and Han that the target has and the source has not."""
    return F.array_except(_all(target, P.OTHER_SCRIPTS), _all(source, P.OTHER_SCRIPTS))


def repeated_sentence(text: Column) -> Column:
    """A sentence of 12 characters or more that occurs twice."""
    parts = F.filter(F.transform(F.split(text, P.SENTENCE_MARKS, -1), one_line), lambda s: F.length(s) >= 12)
    return F.size(parts) > F.size(F.array_distinct(parts))


def protocol_error(source: Column, frozen: Column, nt_map: Column, translated: Column) -> Column:
    """The first rule of the token protocol that a translation breaks, or null: raw line ends or tabs, control
    tokens other than the source's, tokens of non-numeric originals missing, foreign or not exactly once, any other
    token, and numbers other than the source's."""
    t, f = _text(translated), _text(frozen)
    entries = F.coalesce(F.map_entries(nt_map), F.array().cast("array<struct<key:string,value:string>>"))
    numeric = lambda e: F.coalesce(e["value"], F.lit("")).rlike(r"(?U)^\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?$")
    expected = F.transform(F.filter(entries, lambda e: ~numeric(e)), lambda e: e["key"])
    numbers = F.transform(F.filter(entries, numeric), lambda e: e["key"])
    found = F.filter(_all(t, P.NT), lambda x: ~F.array_contains(numbers, x))
    times = lambda e: F.size(F.filter(found, lambda x: x == e))
    return (
        F.when(t.rlike("[\r\n]"), "raw_newline")
        .when(t.contains("\t"), "raw_tab")
        .when(control_tokens(f) != control_tokens(t), "control_tokens_mismatch")
        .when((F.size(F.array_except(expected, found)) > 0) | (F.size(F.array_except(found, expected)) > 0), "nt_mismatch")
        .when(F.exists(expected, lambda e: times(e) != 1), "nt_count")
        .when(t.rlike("<<MT_(?:SEG:[0-9]{6}|END:[0-9]{6}|SLOT:[0-9]{6})>>"), "unexpected_sentinel")
        .when(multiset(number_tokens(source)) != multiset(number_tokens(unfreeze(t, F.coalesce(nt_map, _no_map())))), "number_mismatch")
    )


def quality_issues(df: DataFrame, source: str, nt_map: str | None, translated: str, source_lang: str, target_lang: str, out: str = "issues") -> DataFrame:
    """``df`` with a sorted array of the issues of ``translated`` against ``source``.

    A null or empty translation has ``empty_output`` alone. Rules depend on the target language: Chinese and English
    have their own, others only those of characters and prompts. Leaks of the glossary need its table: see
    ``glossary_leaks``.
    """
    back = F.coalesce(F.col(nt_map), _no_map()) if nt_map else _no_map()
    step = df.withColumns(
        {
            "_o": strip_sentinels(unfreeze(_text(translated), back)),
            "_i": strip_sentinels(_text(source)),
            "_sl": F.lower(_text(source_lang)),
            "_tl": F.lower(_text(target_lang)),
        }
    )
    step = step.withColumns(
        {
            "_ol": F.lower(one_line(F.col("_o"))),
            "_il": F.lower(one_line(F.col("_i"))),
            "_on": F.length(one_line(F.col("_o"))),
            "_in": F.length(one_line(F.col("_i"))),
            **{f"_{side}_{k}": counted(F.col(f"_{side}"), p) for side in "oi" for k, p in (("cjk", "[一-鿿]"), ("latin", "[A-Za-z]"))},
            "_words": _all(F.col("_o"), "[A-Za-z]{2,}"),
        }
    )
    o, i, zh, en = F.col("_o"), F.col("_i"), F.col("_tl").startswith("zh"), F.col("_tl").startswith("en")
    from_en, from_zh = F.col("_sl").startswith("en"), F.col("_sl").startswith("zh")
    ocjk, olatin, icjk, ilatin, words = F.col("_o_cjk"), F.col("_o_latin"), F.col("_i_cjk"), F.col("_i_latin"), F.size("_words")
    share = lambda least, of, by: F.greatest(F.lit(least), F.floor(of * by))
    lost = lambda marker: i.rlike(rf"(?U)\b{marker}\b") & ~o.rlike(rf"(?U)\b{marker}\b")
    phrases = lambda least: _all(o, P.LATIN_PHRASE.format(least=least))

    def echoed(phrase: Column) -> Column:
        line = F.lower(one_line(phrase))
        return (F.length(line) >= 12) & F.col("_il").contains(line) & F.col("_ol").contains(line) & ~looks_like_entity(phrase)

    short_zh = zh & from_en & (ilatin >= 120) & (ocjk <= share(18, ilatin, 0.25))
    short_en = en & from_zh & (icjk >= 60) & (words <= share(10, icjk, 0.25))
    rules = {
        "zero_width_chars": o.rlike(P.ZERO_WIDTH),
        "repeated_char_run": o.rlike(P.REPEATED_CHARACTER),
        "prompt_artifact": has_prompt_artifact(o) & ~has_prompt_artifact(i),
        "unexpected_script": (zh | en) & (F.size(unexpected_scripts(i, o)) > 0),
        "it_default_sense": zh & o.contains("默认") & i.rlike(r"(?iU)\bDefault\b") & ~i.rlike(P.DEFAULT_SETTING),
        "bad_reference_placeholder": zh & o.rlike(P.ZH_REFERENCE_OPEN),
        "variable_marker_missing": zh & (lost("X") | lost("Y") | lost("Z")),
        "looks_untranslated": (zh & from_en & (ilatin >= 12) & (ocjk <= share(2, ilatin, 0.08)) & (olatin >= share(8, ilatin, 0.35)))
        | (en & from_zh & (icjk >= 12) & (words == 0) & (F.length(trimmed(o)) >= 6)),
        "too_short": short_zh | short_en,
        "coverage_low": (short_zh & (ocjk <= share(14, ilatin, 0.18))) | (short_en & (icjk >= 120) & (words <= share(16, icjk, 0.18))),
        "mixed_language": zh & (olatin >= 18) & (ocjk >= 6),
        "untranslated_english": zh & (olatin >= 24) & (F.exists("_words", lambda w: F.lower(w).isin("the", "and", "of", "to")) | looks_english(o)),
        "english_skeleton": zh & F.exists(phrases(30), lambda p: (F.length(one_line(p)) >= 30) & ~looks_like_entity(p)),
        "source_echo": (zh | en) & F.exists(phrases(12), echoed),
        "over_expansion": zh & (F.col("_in") >= 40) & (F.col("_on") >= F.floor(F.col("_in") * 2.8)),
        "unjustified_condition": zh & o.rlike(P.ZH_CONDITION) & ~i.rlike(P.EN_CONDITION),
        "repeated_sentence": (zh | en) & (F.col("_in") >= 80) & repeated_sentence(o),
    }
    found = F.sort_array(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    issues = F.when(_text(translated) == "", F.array(F.lit("empty_output"))).otherwise(found)
    return step.withColumn(out, issues).select(*[c for c in df.columns if c != out], out)


def glossary_leaks(df: DataFrame, glossary: DataFrame, id_col: str, source: str, translated: str) -> DataFrame:
    """(id, issue): ``glossary_leakage:<term>`` for texts whose English-to-Chinese translation holds the target of a
    glossary term that the source gives no reason for: the first such term by term_id.

    A term counts if its English side has two words of four letters or more and its Chinese side six characters with
    Han. It has a reason where the source holds the term or any of those words. Targets are found by the glossary's
    automaton, so no text meets every term.
    """
    from textloom.operators.terms import glossary_matches

    clean = glossary.select("term_id", trimmed(F.col("src")).alias("en"), trimmed(F.col("tgt")).alias("zh"))
    clean = clean.withColumn("words", F.transform(_all(F.col("en"), "[A-Za-z]{4,}"), lambda w: F.lower(w)))
    clean = clean.where((F.size("words") >= 2) & (F.length("zh") >= 6) & F.col("zh").rlike("[一-鿿]"))
    texts = df.select(id_col, collapsed(_text(source)).alias("_i"), collapsed(_text(translated)).alias("_o"))
    wanted = clean.select("term_id", F.col("zh").alias("src"), F.col("en").alias("tgt"), F.lit(0).alias("seen"))
    found = glossary_matches(texts, wanted, id_col, "_o", 2**31 - 1).select(id_col, "term_id")
    low = F.lower("_i")
    reason = F.contains(low, F.lower("en")) | F.exists("words", lambda w: F.array_contains(F.split(low, r"(?U)\W+", -1), w))
    leaks = found.join(clean, "term_id").join(texts.select(id_col, "_i"), id_col).where(~reason)
    return leaks.groupBy(id_col).agg(F.min_by("en", "term_id").alias("_en")).select(id_col, F.concat(F.lit("glossary_leakage:"), F.left("_en", F.lit(32))).alias("issue"))


def hard_issues(issues: Column) -> Column:
    return F.filter(issues, lambda x: x.isin(*P.HARD_ISSUES) | x.startswith("glossary_leakage:"))


RETRANSLATED = ("output_identical_to_source", "contains_ellipsis_placeholder", "len_ratio_too_short_extreme", "len_ratio_too_long_extreme")


def wants_retranslation(hard_flags: Column) -> Column:
    """Any of the flags for which a unit is translated anew."""
    return F.exists(hard_flags, lambda f: f.isin(*RETRANSLATED) | f.startswith("target_script_missing_"))


def asks_again(flag: str) -> bool:
    """Whether ``wants_retranslation`` holds for this one flag."""
    return flag in RETRANSLATED or flag.startswith("target_script_missing_")


def needs_review(issues: Column, forced: Column, source: Column, is_heading: Column, list_level: Column, in_table: Column, least_chars: int) -> Column:
    """A hard issue, a forced unit, a long one, a heading, list or table paragraph, or a word of a legal decision."""
    plain = strip_sentinels(_text(source))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        (F.size(hard_issues(issues)) > 0)
        | yes(forced)
        | (F.length(plain) >= max(0, least_chars))
        | yes(is_heading)
        | list_level.isNotNull()
        | yes(in_table)
        | plain.rlike(P.DECISION_RISK)
    )


def review_passes(ok: Column, fidelity: Column, fluency: Column, style: Column, least: tuple[int, int, int]) -> Column:
    return F.coalesce(ok & (fidelity >= least[0]) & (fluency >= least[1]) & (style >= least[2]), F.lit(False))


def chosen_text(rewrite: Column, draft: Column) -> Column:
    """The rewrite without edge spaces, or the draft where it is blank."""
    return F.coalesce(F.nullif(trimmed(rewrite), F.lit("")), draft)


def hard_failures(df: DataFrame, decision: str, final: list[str], source: str, frozen: str, nt_map: str, source_lang: str, target_lang: str) -> DataFrame:
    """Rows to be translated whose final text has hard issues, with ``final``, ``issues`` and ``protocol_error``. The
    final text is the first of the ``final`` columns that is not empty."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in final])
    step = df.where(F.col(decision) == "ok").withColumn("final", text)
    step = step.withColumn("protocol_error", protocol_error(F.col(source), F.col(frozen), F.col(nt_map), F.col("final")))
    step = quality_issues(step, source, nt_map, "final", source_lang, target_lang)
    broken = F.when(F.col("protocol_error").isNotNull(), F.array(F.lit("protocol_error"))).otherwise(F.array().cast("array<string>"))
    return step.withColumn("issues", F.array_sort(F.array_union("issues", broken))).where(F.size(hard_issues(F.col("issues"))) > 0)


def rendered_quality(src_chars: Column, tgt_chars: Column, ratio: Column, han: Column, latin: Column, brackets: Column, hard: Column, soft: Column) -> Column:
    """The report of a unit's quality as text; empty lists have no line. Ratios are rounded half to even."""
    two = lambda x: F.replace(F.format_number(x, 2), F.lit(","))
    line = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(items, " | ")))
    return F.concat_ws(
        "\n",
        F.lit("QUALITY_HEURISTICS:"),
        F.format_string("- len: src_chars=%d tgt_chars=%d ratio=%s", src_chars, tgt_chars, two(ratio)),
        F.format_string("- scripts: han_ratio=%s latin_alpha_ratio=%s", two(han), two(latin)),
        line("brackets", brackets),
        line("hard_flags", hard),
        line("soft_flags", soft),
    )
