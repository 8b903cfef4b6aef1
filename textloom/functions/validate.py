"""Validation of a translation against its source, and quality heuristics, as columns."""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import patterns as P
from textloom.functions.masking import CUT, HIDDEN, unfreeze
from textloom.functions.text import (
    blank,
    bracket_total,
    control_parts,
    control_tokens,
    has_short_ellipsis,
    multiset,
    normalized_for_similarity,
    sentinels,
    text_metrics,
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _count(text: Column, piece: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)).cast("int")


def _legal_ids(text: Column, pattern: str) -> Column:
    """Compound identifiers such as 4.1(b), 1-2.3 and IV, widths and marks made equal."""
    ids = F.transform(_all(text, pattern, 1), lambda x: F.upper(F.translate(x, "（），,．。－–—−", "()....----")))
    compound = lambda x: x.rlike(r"[.\-()]") | (x.rlike("[A-Za-z]") & (F.length(x) > 1))
    return F.filter(ids, compound)


def validated(df: DataFrame, frozen: str, nt_map: str | None, translated: str, out: str = "error") -> DataFrame:
    """``df`` with the first check that fails, or null if all pass; a null translation is empty, no map is empty.

    In order: empty_output, unexpected_mt_token, sentinel_sequence_mismatch, control_token_sequence_mismatch,
    control_token_layout_mismatch, nt_token_count_mismatch, nt_token_control_block_mismatch, digits_mismatch,
    legal_ref_id_mismatch, compound_legal_id_mismatch.
    """
    none = F.create_map().cast("map<string,string>")
    tokens = F.coalesce(F.map_keys(nt_map), F.array().cast("array<string>")) if nt_map else F.array().cast("array<string>")
    back = F.col(nt_map) if nt_map else none
    step = df.withColumns({"_s": F.coalesce(frozen, F.lit("")), "_t": F.coalesce(translated, F.lit("")), "_tokens": tokens})
    plain = lambda t: F.regexp_replace(unfreeze(F.col(t), back), P.ANY_MT, " ")
    step = step.withColumns({"_sp": plain("_s"), "_tp": plain("_t"), "_pairs": F.arrays_zip(control_parts(F.col("_s")).alias("s"), control_parts(F.col("_t")).alias("t"))})
    step = step.withColumns(
        {
            "_refs": _legal_ids(F.col("_sp"), P.LEGAL_REF),
            "_own": _legal_ids(F.col("_sp"), P.LEGAL_ID),
            "_found": _legal_ids(F.col("_tp"), P.LEGAL_ID),
        }
    )
    source, target = F.col("_s"), F.col("_t")
    ordered = lambda t: F.filter(sentinels(t), lambda s: ~s.startswith("<<MT_NT:"))
    layout = F.exists("_pairs", lambda p: p["s"].isNull() | p["t"].isNull() | (blank(p["s"]) != blank(p["t"])))
    digits = lambda t: multiset(_all(F.col(t), r"(?U)\d+"))
    same = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    error = (
        F.when(blank(target), "empty_output")
        .when(F.size(F.array_except(_all(target, P.ANY_MT), _all(source, P.ANY_MT))) > 0, "unexpected_mt_token")
        .when(ordered(source) != ordered(target), "sentinel_sequence_mismatch")
        .when(control_tokens(source) != control_tokens(target), "control_token_sequence_mismatch")
        .when(layout, "control_token_layout_mismatch")
        .when(F.exists("_tokens", lambda t: _count(source, t) != _count(target, t)), "nt_token_count_mismatch")
        .when(
            F.exists("_tokens", lambda t: F.exists("_pairs", lambda p: _count(p["s"], t) != _count(p["t"], t))),
            "nt_token_control_block_mismatch",
        )
        .when(digits("_sp") != digits("_tp"), "digits_mismatch")
        .when(F.exists("_refs", lambda x: same("_refs", x) != same("_found", x)), "legal_ref_id_mismatch")
        .when((F.size("_own") > 0) & (multiset(F.col("_own")) != multiset(F.col("_found"))), "compound_legal_id_mismatch")
    )
    return step.withColumn(out, error).drop("_s", "_t", "_tokens", "_sp", "_tp", "_pairs", "_refs", "_own", "_found")


def quality_flags(df: DataFrame, frozen: str, nt_map: str | None, translated: str, source_lang: str, target_lang: str) -> DataFrame:
    """``df`` with ``src_chars``, ``tgt_chars``, ``len_ratio``, ``han_ratio``, ``latin_ratio``, ``bracket_notes``,
    ``hard_flags`` and ``soft_flags`` (sorted arrays)."""
    back = F.col(nt_map) if nt_map else F.create_map().cast("map<string,string>")
    plain = lambda t: F.regexp_replace(unfreeze(F.coalesce(t, F.lit("")), back), P.ANY_MT, " ")
    step = df.withColumns({"_s": plain(frozen), "_t": plain(translated)})
    sm, tm = text_metrics(F.col("_s")), text_metrics(F.col("_t"))
    step = step.withColumns(
        {f"_s_{k}": v for k, v in sm.items()}
        | {f"_t_{k}": v for k, v in tm.items()}
        | {"_sn": normalized_for_similarity(F.col("_s")), "_tn": normalized_for_similarity(F.col("_t"))}
        | {f"_{side}_{name}": bracket_total(F.col(f"_{side}"), chars) for side in "st" for name, chars in P.BRACKETS}
    )
    chars_s, chars_t, zero = F.col("_s_non_ws"), F.col("_t_non_ws"), F.lit(0.0)
    share = lambda k: F.when(chars_t == 0, zero).otherwise(F.col(f"_t_{k}") / chars_t)
    step = step.withColumns({"len_ratio": F.when(chars_s == 0, zero).otherwise(chars_t / chars_s)} | {f"_r_{k}": share(k) for k in ("han", "latin", "kana", "hangul")})
    ratio, han, latin = F.col("len_ratio"), F.col("_r_han"), F.col("_r_latin")
    long = chars_s >= 40
    target, source = F.lower(F.trim(target_lang)), F.lower(F.trim(source_lang))
    differ = (source != "") & (target != "") & (source != target) & (chars_t >= 20)
    hard = [
        F.when((F.col("_sn") == F.col("_tn")) & (F.octet_length("_sn") >= 24), "output_identical_to_source"),
        F.when(long & (ratio > 0) & (ratio < 0.25), "len_ratio_too_short_extreme"),
        F.when(long & (ratio > 4.0), "len_ratio_too_long_extreme"),
        F.when(differ & target.startswith("zh") & (han < 0.06) & (latin > 0.25), "target_script_missing_han"),
        F.when(differ & target.startswith("en") & (latin < 0.18) & (han > 0.20), "target_script_missing_latin"),
        F.when(differ & target.startswith("ja") & (han + F.col("_r_kana") < 0.10) & (latin > 0.25), "target_script_missing_japanese"),
        F.when(differ & target.startswith("ko") & (F.col("_r_hangul") < 0.10) & (latin > 0.25), "target_script_missing_korean"),
        F.when(has_short_ellipsis(F.col("_t")) & ~has_short_ellipsis(F.col("_s")), "contains_ellipsis_placeholder"),
    ]
    soft = [
        F.when(long & (ratio >= 0.25) & (ratio < 0.35), "len_ratio_too_short"),
        F.when(long & (ratio <= 4.0) & (ratio > 2.8), "len_ratio_too_long"),
        F.when(differ & target.startswith("en") & ~((latin < 0.18) & (han > 0.20)) & (han > 0.25), "target_contains_much_han"),
    ]
    notes = []
    for name, characters in P.BRACKETS:
        a, b = F.col(f"_s_{name}"), F.col(f"_t_{name}")
        notes.append(F.when(a != b, F.format_string(f"{characters[:2]}:src=%d tgt=%d", a, b)))
        hard.append(F.when((a > 0) & (b == 0), f"missing_brackets_{name}"))
        differs = (b > 0) & (a != b)
        soft.append(F.when(differs & (F.abs(a - b) >= 4), f"bracket_count_mismatch_{name}"))
        soft.append(F.when(differs & (F.abs(a - b) < 4), "bracket_count_mismatch"))
    flags = {
        "src_chars": chars_s,
        "tgt_chars": chars_t,
        "han_ratio": han,
        "latin_ratio": latin,
        "bracket_notes": F.array_compact(F.array(*notes)),
        "hard_flags": F.sort_array(F.array_compact(F.array(*hard))),
        "soft_flags": F.sort_array(F.array_compact(F.array(*soft))),
    }
    return step.withColumns(flags).select(*df.columns, "len_ratio", *flags)


# --- one text in Python, for loops that judge a text again and again -----------------------------------------------

#: What Unicode calls white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]+")
_ANY_MT, _NT, _SENTINEL, _CONTROL, _LATIN, _DOTS, _DIGITS = map(re.compile, (P.ANY_MT, P.NT, P.SENTINEL, P.CONTROL, "[A-Za-z]", "…+", r"\d+"))
_HAN, _KANA, _HANGUL = (re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)) for p in (P.HAN, P.KANA, P.HANGUL))
_LEGAL_ID = regex.compile(P.LEGAL_ID.removeprefix("(?U)"))
#: Where Java passes over case, dotless and dotted i are i too.
_LEGAL_REF = regex.compile(P.LEGAL_REF.removeprefix("(?iU)").replace("i", "[iıİ]").replace("[IV", "[IıİV").replace("a-z0", "a-zıİ0"), regex.IGNORECASE)
_COMPOUND, _NUMERAL = re.compile(r"[.\-()]"), re.compile("[A-Za-z]")
_WIDTHS, _SAME = str.maketrans("（），,．。－–—−", "()....----"), str.maketrans(P.SAME_FROM, P.SAME_TO)


def is_blank(text: str) -> bool:
    """``blank`` of one text."""
    return not text.strip(SPACES)


def parts_of(text: str, pattern: re.Pattern = _SENTINEL) -> list[str]:
    """``sentinel_parts`` of one text; with the pattern of control tokens, ``control_parts``."""
    return pattern.sub(rf"{CUT}\g<0>{CUT}", text).split(CUT)


def _ids(text: str, pattern: regex.Pattern) -> list[str]:
    """``_legal_ids`` of one text, in order of their own."""
    ids = (x.translate(_WIDTHS).upper() for x in pattern.findall(text))
    return sorted(x for x in ids if _COMPOUND.search(x) or (len(x) > 1 and _NUMERAL.search(x)))


def _short_dots(text: str) -> bool:
    return any(len(run) < 8 for run in _DOTS.findall(text))


def _share(pattern: re.Pattern, text: str, chars: int) -> float:
    return len(pattern.findall(text)) / chars if chars else 0.0


class Source:
    """The source of a unit, against which its translations are judged one after another. What is worked out of the
    source is kept; ``error`` is ``validated`` and ``flags`` are those of ``quality_flags``, of one text."""

    def __init__(self, frozen: str | None, nt_map: dict[str, str | None] | None):
        self.frozen, self.names = frozen or "", nt_map or {}

    def plain(self, text: str) -> str:
        back = lambda m: t if (t := self.names.get(m.group())) is not None else m.group()
        return _ANY_MT.sub(" ", _NT.sub(back, text.replace(HIDDEN, CUT)))

    def held(self, text: str, tokens: list[str] | None = None) -> dict[str, int]:
        """How often a text has each token of the map. No token of the usual form overlaps another, so that one pass
        counts them all."""
        counts = Counter(_ANY_MT.findall(text) if tokens is None else tokens)
        return {t: n for t, n in counts.items() if t in self.names} | {t: text.count(t) for t in self.odd}

    found = cached_property(lambda self: _ANY_MT.findall(self.frozen))
    any_mt = cached_property(lambda self: {*self.found})
    tokens = cached_property(lambda self: _SENTINEL.findall(self.frozen))
    ordered = cached_property(lambda self: [t for t in self.tokens if not t.startswith("<<MT_NT:")])
    in_order = cached_property(lambda self: {*self.ordered})
    controls = cached_property(lambda self: [t for t in self.ordered if t in P.CONTROL_TOKENS])
    odd = cached_property(lambda self: [t for t in self.names if not _NT.fullmatch(t)])
    wanted = cached_property(lambda self: self.held(self.frozen, self.found))
    blocks = cached_property(lambda self: parts_of(self.frozen, _CONTROL))
    blanks = cached_property(lambda self: [*map(is_blank, self.blocks)])
    by_block = cached_property(lambda self: [*map(self.held, self.blocks)])
    text = cached_property(lambda self: self.plain(self.frozen))
    digits = cached_property(lambda self: sorted(_DIGITS.findall(self.text)))
    refs = cached_property(lambda self: _ids(self.text, _LEGAL_REF))
    ids = cached_property(lambda self: _ids(self.text, _LEGAL_ID))
    bare = cached_property(lambda self: _SPACE.sub("", self.text))
    same = cached_property(lambda self: self.bare.translate(_SAME).lower())

    def error(self, text: str) -> str | None:
        if is_blank(text):
            return "empty_output"
        found = _ANY_MT.findall(text)
        if not self.any_mt.issuperset(found):
            return "unexpected_mt_token"
        ordered = [t for t in found if t in self.in_order]
        if self.ordered != ordered:
            return "sentinel_sequence_mismatch"
        if self.controls != [t for t in ordered if t in P.CONTROL_TOKENS]:
            return "control_token_sequence_mismatch"
        blocks = parts_of(text, _CONTROL)
        if self.blanks != [*map(is_blank, blocks)]:
            return "control_token_layout_mismatch"
        if self.wanted != self.held(text, found):
            return "nt_token_count_mismatch"
        if len(blocks) > 1 and self.by_block != [*map(self.held, blocks)]:
            return "nt_token_control_block_mismatch"
        plain = self.plain(text)
        if self.digits != sorted(_DIGITS.findall(plain)):
            return "digits_mismatch"
        found = _ids(plain, _LEGAL_ID) if self.refs or self.ids else []
        if any(self.refs.count(x) != found.count(x) for x in self.refs):
            return "legal_ref_id_mismatch"
        return "compound_legal_id_mismatch" if self.ids and self.ids != found else None

    def flags(self, text: str, source_lang: str | None, target_lang: str | None) -> tuple[list[str], list[str]]:
        """The hard and the soft flags."""
        plain = self.plain(text)
        bare = _SPACE.sub("", plain)
        source, target = (x.strip(" ").lower() if x is not None else "" for x in (source_lang, target_lang))
        chars, long = len(bare), len(self.bare) >= 40
        ratio = chars / len(self.bare) if self.bare else 0.0
        differ = source != "" and target != "" and source != target and chars >= 20
        share = lambda pattern: _share(pattern, plain, chars)
        hard = {
            "output_identical_to_source": self.same == bare.translate(_SAME).lower() and len(self.same.encode()) >= 24,
            "len_ratio_too_short_extreme": long and 0 < ratio < 0.25,
            "len_ratio_too_long_extreme": long and ratio > 4.0,
            "contains_ellipsis_placeholder": _short_dots(plain) and not _short_dots(self.text),
        }
        soft = [name for name, holds in (("len_ratio_too_short", long and 0.25 <= ratio < 0.35), ("len_ratio_too_long", long and 2.8 < ratio <= 4.0)) if holds]
        if differ and target.startswith("zh"):
            hard["target_script_missing_han"] = share(_HAN) < 0.06 and share(_LATIN) > 0.25
        if differ and target.startswith("en"):
            han, missing = share(_HAN), share(_LATIN) < 0.18
            hard["target_script_missing_latin"] = missing and han > 0.20
            soft += ["target_contains_much_han"] if han > 0.25 and not missing else []
        if differ and target.startswith("ja"):
            hard["target_script_missing_japanese"] = share(_HAN) + share(_KANA) < 0.10 and share(_LATIN) > 0.25
        if differ and target.startswith("ko"):
            hard["target_script_missing_korean"] = share(_HANGUL) < 0.10 and share(_LATIN) > 0.25
        for name, characters in P.BRACKETS:
            a, b = (sum(map(t.count, characters)) for t in (self.text, plain))
            hard[f"missing_brackets_{name}"] = a > 0 and b == 0
            if b > 0 and a != b:
                soft.append(f"bracket_count_mismatch_{name}" if abs(a - b) >= 4 else "bracket_count_mismatch")
        return sorted(name for name, holds in hard.items() if holds), sorted(soft)
