"""Text columns: tokens, scripts, normal forms and predicates. Every function is Column to Column, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import patterns as P


def blank(text: Column) -> Column:
    """True for text of white space only, by Unicode; null stays null."""
    return text.rlike(r"(?U)^\s*$")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token(kind: str, number: Column | int) -> Column:
    """``<<MT_NT:0001>>`` and its like: kinds NT, SEG, END and SLOT, with their minimum widths."""
    width = P.NT_WIDTH if kind == "NT" else P.SEG_WIDTH
    return F.format_string(f"<<MT_{kind}:%0{width}d>>", number if isinstance(number, Column) else F.lit(number))


def sentinels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.SENTINEL), F.lit(0))


def control_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.CONTROL), F.lit(0))


def must_keep_tokens(text: Column) -> Column:
    return F.array_join(sentinels(text), " ")


def strip_sentinels(text: Column) -> Column:
    return F.regexp_replace(text, P.SENTINEL, " ")


def control_parts(text: Column) -> Column:
    """Text and control tokens in turn, empty texts kept: the tokens at odd places."""
    return F.split(F.regexp_replace(text, f"({P.CONTROL})", "\u0001$1\u0001"), "\u0001", -1)


def is_trivial(text: Column) -> Column:
    """Nothing to translate: blank or without a letter, tokens aside."""
    return ~strip_sentinels(text).rlike(r"(?U)\p{L}")


def collapsed(text: Column) -> Column:
    """Tokens become spaces, runs of white space one space, edges none."""
    return F.trim(F.regexp_replace(strip_sentinels(text), r"(?U)\s+", " "))


def scope_type(scope_key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(scope_key, "#(w:p|a:p|w:lvlText)@", 1), F.lit("")), F.lit("unknown"))


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_metrics(text: Column) -> dict[str, Column]:
    """Counts of visible characters, Han, ASCII letters, kana and hangul."""
    return {
        "non_ws": counted(text, r"(?U)\S"),
        "han": counted(text, P.HAN),
        "latin": counted(text, "[A-Za-z]"),
        "kana": counted(text, P.KANA),
        "hangul": counted(text, P.HANGUL),
    }


def normalized_for_similarity(text: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(text, r"(?U)\s+", ""), P.SAME_FROM, P.SAME_TO))


def normalized_for_match(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), r"(?U)\s+", " ")


def has_short_ellipsis(text: Column) -> Column:
    """A run of fewer than eight ``…``; ASCII dots do not count."""
    return F.exists(F.regexp_extract_all(text, F.lit("…+"), F.lit(0)), lambda run: F.length(run) < 8)


def bracket_total(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def multiset(tokens: Column) -> Column:
    """A canonical form in which equal multisets are equal arrays."""
    return F.sort_array(tokens)


def wildcard(pattern: str) -> str:
    """A ``*`` glob as an anchored pattern."""
    return "(?s)^" + ".*".join("\\Q" + part + "\\E" if part else "" for part in pattern.split("*")) + "$"


def sanitized_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


def part_target(target: Column) -> Column:
    """A relationship's target as a part name: forward slashes, no leading / or ../, under word/."""
    clean = F.regexp_replace(F.regexp_replace(target, r"\\", "/"), r"^(?:/|\.\./)+", "")
    return F.when(clean.startswith("word/"), clean).otherwise(F.concat(F.lit("word/"), clean))


def render(template: str, **values: Column) -> Column:
    """``{{name}}`` places of a template filled in, one after another."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def rendered(template: str, **values: str | None) -> str:
    """``render`` of texts."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", value or "")
    return template


def in_paragraph(scope_key: Column) -> Column:
    """Whether a scope is a paragraph of text, of either kind."""
    return F.coalesce(scope_key.contains("#w:p") | scope_key.contains("#a:p"), F.lit(False))


def ends_sentence(text: Column) -> Column:
    """Whether a text's last character ends a sentence."""
    return F.coalesce(text.rlike(r"[.!?;。！？；]\z"), F.lit(False))


def is_control(token_: Column) -> Column:
    return token_.isin(*P.CONTROL_TOKENS)


def is_placeholder(text: Column, prefix: str) -> Column:
    return text.rlike(rf"(?s)^__MT_MASK_{prefix}_.{{8,}}__$")


def final_text(final: Column, draft: Column, frozen: Column) -> Column:
    """What is written in the end: the final translation, else the draft, else the source."""
    return F.coalesce(final, draft, frozen)
