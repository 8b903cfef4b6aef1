"""Queries of the language decisions, the issue list, review and normalising operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import issues, language, normalize, validate
from textloom.functions.patterns import BRACKETS
from textloom.functions.text import sentinels
from textloom.plans.text_queries import _ENGLISH, _NOT_OTHER, _SENTINEL, _WS, _n, records, with_files
from textloom.plans.text_queries import ORACLE as TEXT_ORACLE
from textloom.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def both_sides(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The records with either translation: (rec_id, side, translated, the languages, columns)."""
    rows = with_files(spark, d, "translation_a", "translation_b", *columns)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"translation_{s}").alias("translated")) for s in "ab"]))
    return rows.withColumn("_s", sides).select("rec_id", "_s.side", "_s.translated", "source_lang", "target_lang", *columns)


def q_detect_pair(spark: SparkSession, d: str) -> DataFrame:
    return language.detect_language_pair(records(spark, d, "file_id", "tu_id", "part_name", "scope_key", "source_surface"), "file_id", ["tu_id", "rec_id"])


def q_text_looks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents that look English, and those that look like the name of a company."""
    lines = spread(table(spark, d, "documents").select("lang", "text")).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    line = F.col("line")
    return lines.groupBy("lang").agg(
        F.count("*").alias("lines"),
        F.count_if(language.looks_english(line)).alias("english"),
        F.count_if(language.looks_like_entity(line)).alias("entities"),
        F.sum(language.other_script_count(line).cast("bigint")).alias("other"),
    )


def q_lang_labels(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("lang")
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return rows.select(
        "lang", "documents", language.normalized_lang(code).alias("code"), language.lang_label(code).alias("label"),
        language.lang_prompt_name(code).alias("name"), language.lang_prompt_name(code, native=True).alias("native"),
    )


def q_previews(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("frozen_surface")
    rows = records(spark, d, "frozen_surface")
    return rows.select("rec_id", language.preview(text, 60).alias("preview"), language.heading_text(text, 40).alias("heading"), language.shortened(text, 30).alias("short"))


def q_preserved_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "frozen_surface")
    return rows.select("rec_id", F.array_join(language.must_preserve(F.col("frozen_surface")), " ").alias("tokens"))


def q_number_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    numbers = language.number_tokens(F.col("text"))
    return rows.select("doc_id", F.size(numbers).alias("n"), F.array_join(F.array_sort(numbers), " ").alias("numbers"))


def q_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = both_sides(spark, d, "source_surface", "nt_map")
    rows = issues.quality_issues(rows, "source_surface", "nt_map", "translated", "source_lang", "target_lang")
    return rows.select("rec_id", "side", F.array_join("issues", ",").alias("issues"), F.array_join(issues.hard_issues(F.col("issues")), ",").alias("hard"))


def q_protocol(spark: SparkSession, d: str) -> DataFrame:
    rows = both_sides(spark, d, "source_surface", "frozen_surface", "nt_map")
    error = issues.protocol_error(F.col("source_surface"), F.col("frozen_surface"), F.col("nt_map"), F.col("translated"))
    return rows.select("rec_id", "side", error.alias("error"))


def q_hard_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "frozen_surface", "nt_map", "translation_a", "final_translation")
    rows = rows.withColumn("decision", language.translate_decision(F.col("source_surface"), F.col("frozen_surface"), F.col("source_lang")))
    failed = issues.hard_failures(
        rows, "decision", ["final_translation", "translation_a", "frozen_surface"], "source_surface", "frozen_surface", "nt_map", "source_lang", "target_lang"
    )
    return failed.select("rec_id", "protocol_error", F.array_join("issues", ",").alias("issues"))


def q_review_needed(spark: SparkSession, d: str) -> DataFrame:
    rows = both_sides(spark, d, "source_surface", "nt_map", "para_style", "tu_kind")
    rows = issues.quality_issues(rows, "source_surface", "nt_map", "translated", "source_lang", "target_lang")
    heading = F.lower("para_style").startswith("heading")
    wanted = issues.needs_review(F.col("issues"), F.lit(None).cast("boolean"), F.col("source_surface"), heading, F.lit(None).cast("int"), F.col("tu_kind") == "table", 400)
    return rows.select("rec_id", "side", wanted.alias("review"))


def q_retranslate(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "translation_a").where("source_surface is not null")
    rows = validate.quality_flags(rows, "source_surface", None, "translation_a", "source_lang", "target_lang")
    return rows.select("rec_id", issues.wants_retranslation(F.col("hard_flags")).alias("again"))


def q_rendered_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "translation_a").where("source_surface is not null")
    rows = validate.quality_flags(rows, "source_surface", None, "translation_a", "source_lang", "target_lang")
    c = {k: F.col(k) for k in rows.columns}
    block = issues.rendered_quality(c["src_chars"], c["tgt_chars"], c["len_ratio"], c["han_ratio"], c["latin_ratio"], c["bracket_notes"], c["hard_flags"], c["soft_flags"])
    return rows.select("rec_id", block.alias("report"))


def q_glossary_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Translations held against the source of the unit before: stitched one place off, they leak the glossary."""
    rows = with_files(spark, d, "tu_id", "source_surface", "translation_a")
    before = F.lag("source_surface").over(Window.partitionBy("file_id").orderBy("tu_id", "rec_id"))
    rows = rows.withColumn("source_surface", before).where("source_lang like 'en%' and target_lang like 'zh%'")
    return issues.glossary_leaks(rows, table(spark, d, "glossary"), "rec_id", "source_surface", "translation_a")


def q_decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens respelt as models do, and decoded."""
    respelt = F.regexp_replace(F.regexp_replace("frozen_surface", "<<MT_NT:0*([0-9]+)>>", "[[ NT:$1 ]]"), "<<MT_(TAB|BR|NBH|SHY)>>", "【$1】")
    return records(spark, d, "frozen_surface").select("rec_id", F.md5(normalize.decoded_sentinels(respelt)).alias("text"), (respelt != F.col("frozen_surface")).alias("respelt"))


def q_cleaned_output(spark: SparkSession, d: str) -> DataFrame:
    """Translations in a code block and quotes, cleaned of both."""
    fenced = F.concat(F.lit(' ```json\n"'), F.col("translation_a"), F.lit('" \n``` '))
    return records(spark, d, "translation_a").select("rec_id", F.md5(normalize.cleaned_output(fenced)).alias("text"))


def q_plain_output(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "translation_a").select("rec_id", F.md5(normalize.plain_output(F.col("translation_a"))).alias("text"))


def q_expected_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Translations with foreign letters put in after every full stop, and what is left of them."""
    rows = with_files(spark, d, "source_surface", "translation_a")
    dirty = F.regexp_replace("translation_a", "([。.])", "$1Жカ")
    clean = normalize.expected_scripts(F.col("source_surface"), F.col("target_lang"), dirty)
    return rows.select("rec_id", F.md5(clean).alias("text"), (clean != dirty).alias("changed"))


def q_repaired_controls(spark: SparkSession, d: str) -> DataFrame:
    """Document texts of several lines against a source with two line breaks and a tab."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))
    return rows.select("doc_id", F.md5(normalize.repaired_controls(F.lit("a<<MT_BR>>b<<MT_TAB>>c<<MT_BR>>"), F.col("text"))).alias("text"))


def q_allowed_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Frozen texts with all tokens but the first kind's taken out."""
    rows = records(spark, d, "frozen_surface")
    allowed = F.array(F.lit("<<MT_NT:0001>>"), F.lit("<<MT_NT:0003>>"))
    text = normalize.only_allowed_sentinels(F.col("frozen_surface"), allowed)
    return rows.select("rec_id", F.md5(text).alias("text"), F.size(sentinels(text)).alias("tokens"))


def q_normalized_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = both_sides(spark, d, "source_surface", "frozen_surface", "nt_map")
    rows = normalize.normalized_candidate(rows, "source_surface", "frozen_surface", "nt_map", "translated", "target_lang")
    return rows.select("rec_id", "side", "candidate", F.array_join("space_flags", ",").alias("space_flags"))


def q_balanced_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Unmasked texts with their tokens put back by originals."""
    rows = records(spark, d, "source_surface", "frozen_surface", "nt_map")
    text = normalize.balanced_tokens(F.col("frozen_surface"), F.col("nt_map"), F.col("source_surface"))
    return rows.select("rec_id", F.md5(text).alias("text"), F.array_join(F.array_sort(sentinels(text)), " ").alias("tokens"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        q_detect_pair, q_text_looks, q_lang_labels, q_previews, q_preserved_tokens, q_number_tokens, q_quality_issues, q_protocol, q_hard_failures,
        q_review_needed, q_retranslate, q_rendered_quality, q_glossary_leaks, q_decoded_tokens, q_cleaned_output, q_plain_output,
        q_expected_scripts, q_repaired_controls, q_allowed_sentinels, q_normalized_candidate, q_balanced_tokens,
    )
}

# --- SQL ---------------------------------------------------------------------------------------------------------

_W, _NW = r"[\pL\pN\pM_]", r"[^\pL\pN\pM_]"


def _plain(text: str) -> str:
    return f"regexp_replace({text}, '{_SENTINEL}', ' ', 'g')"


def _line(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"


def _unfrozen(text: str, nt_map: str) -> str:
    entries = f"coalesce(list_sort(map_entries({nt_map})), [])"
    return (
        f"list_reduce(list_prepend({text}, list_transform({entries}, lambda e: e.key || chr(1) || e.value)),"
        " lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))"
    )


def _word(text: str, pattern: str, flags: str = "") -> str:
    """Whether a pattern occurs as whole words."""
    return f"regexp_matches({text}, '{flags}(?:^|{_NW})(?:{pattern})(?:$|{_NW})')"


_WORD_SUFFIX = "inc|incorporated|ltd|limited|llc|plc|gmbh|corp|corporation|company|ag|bv"
_DOT_SUFFIX = r"inc\.|ltd\.|l\.l\.c\.|s\.a\.|s\.a\.s\.|s\.r\.l\.|corp\.|co\.|n\.a\.|n\.v\.|b\.v\."
_STOPS = "is are was were to the a an of for in on at by as from and or not will shall may must subject"


def _entity(text: str) -> str:
    line = _line(text)
    words = rf"regexp_extract_all({line}, '[A-Za-z][A-Za-z''.]+')"
    bare = f"list_transform({words}, lambda w: trim(w, '.'))"
    upper = f"len(list_filter({bare}, lambda w: length(w) >= 2 AND upper(w) = w))"
    title = f"len(list_filter({bare}, lambda w: (length(w) >= 2 AND upper(w) = w) OR regexp_full_match(w, '[A-Z](?:[a-z''.]*[a-z][a-z''.]*)?')))"
    stops = f"len(list_filter({words}, lambda w: lower(w) <> 'and' AND list_contains(string_split('{_STOPS}', ' '), trim(lower(w), '.'))))"
    suffix = f"(regexp_matches({line}, '(?i)(?:^|{_NW})(?:{_WORD_SUFFIX})(?:$|{_NW})') OR regexp_matches({line}, '(?i)(?:^|{_NW})(?:{_DOT_SUFFIX}){_W}'))"
    return (
        f"({line} <> '' AND length({line}) <= 120 AND {suffix} AND len({words}) > 0 AND {stops} = 0 AND"
        f" (({upper} >= 2 AND {upper} >= 0.6 * len({words})) OR ({title} >= CASE WHEN len({words}) <= 4 THEN 2 ELSE 3 END AND {title} >= 0.6 * len({words}))))"
    )


_SIDES = """
  SELECT DISTINCT rec_id, side, CASE side WHEN 'a' THEN translation_a ELSE translation_b END AS t, lower(coalesce(source_lang, '')) AS sl,
    lower(coalesce(target_lang, '')) AS tl, coalesce(source_surface, '') AS s, coalesce(frozen_surface, '') AS f, nt_map, para_style, tu_kind
  FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory) JOIN memory_files USING (file_id), (VALUES ('a'), ('b')) AS sides(side)
"""
_OTHER = "[" + _NOT_OTHER[2:]
_PHRASE = r"""[A-Za-z][A-Za-z0-9 ,.;:''"()/\\-]{%d,}"""
_PROMPT = (
    r"(?i)\[(?:/?(?:CONTEXT|TEXT|TARGET|SRC|DRAFT|DOC_CONTEXT|CURRENT_PROBLEMS|STRUCTURE|EXCERPTS|TERMS|NEIGHBOR_SRC_PREV|NEIGHBOR_SRC_NEXT|"
    rf"BAD_OUTPUT|BAD_OUTPUT_SEG|SRC_SEG))\]|(?:^|{_NW})(?:(?:Domain|Document\s+type|Document\s+summary|Target\s+writing\s+style|Style\s+guide|Glossary|"
    r"Relevant\s+excerpts|Text\s+to\s+translate|Source\s+text|Draft\s+translation|Bad\s+output|Structure\s+hints|Previous\s+source\s+paragraph|"
    r"Next\s+source\s+paragraph)\s*:)"
)
_REPEATED = (
    "len(list_filter(list_transform(regexp_split_to_array(o, '[。！？；：.!?;:]'), lambda x: " + _line("x") + "), lambda x: length(x) >= 12)) > "
    "len(list_distinct(list_filter(list_transform(regexp_split_to_array(o, '[。！？；：.!?;:]'), lambda x: " + _line("x") + "), lambda x: length(x) >= 12)))"
)
_RULES = {
    "zero_width_chars": r"regexp_matches(o, '[\x{200b}\x{200c}\x{200d}\x{2060}]')",
    "repeated_char_run": "len(list_filter(list_distinct(string_split(o, '')), lambda c: c NOT IN ('', chr(10), chr(13), chr(133)) AND contains(o, repeat(c, 13)))) > 0",
    "prompt_artifact": f"regexp_matches(o, '{_PROMPT}') AND NOT regexp_matches(i, '{_PROMPT}')",
    "unexpected_script": f"(zh OR en) AND len(list_filter(regexp_extract_all(o, '{_OTHER}'), lambda c: NOT contains(i, c))) > 0",
    "it_default_sense": f"zh AND contains(o, '默认') AND {_word('i', 'default', '(?i)')} AND NOT {_word('i', 'by' + chr(92) + 's+default|default' + chr(92) + 's+settings?|default' + chr(92) + 's+value|default' + chr(92) + 's+configuration', '(?i)')}",
    "bad_reference_placeholder": rf"zh AND regexp_matches(o, '第{_WS}*(?:(?:[Xx?*]|[IVXLCDM]{{1,8}}){_WS}*)?(?:条|款|节|段|章|篇)')",
    "variable_marker_missing": "zh AND (" + " OR ".join(f"({_word('i', c)} AND NOT {_word('o', c)})" for c in "XYZ") + ")",
    "looks_untranslated": "(zh AND sl LIKE 'en%' AND il >= 12 AND oc <= greatest(2, floor(il * 0.08)) AND ol >= greatest(8, floor(il * 0.35)))"
    f" OR (en AND sl LIKE 'zh%' AND ic >= 12 AND w = 0 AND length(regexp_replace(o, '^{_WS}+|{_WS}+$', '', 'g')) >= 6)",
    "too_short": "(zh AND sl LIKE 'en%' AND il >= 120 AND oc <= greatest(18, floor(il * 0.25))) OR (en AND sl LIKE 'zh%' AND ic >= 60 AND w <= greatest(10, floor(ic * 0.25)))",
    "coverage_low": "(zh AND sl LIKE 'en%' AND il >= 120 AND oc <= greatest(14, floor(il * 0.18))) OR (en AND sl LIKE 'zh%' AND ic >= 120 AND w <= greatest(16, floor(ic * 0.18)))",
    "mixed_language": "zh AND ol >= 18 AND oc >= 6",
    "untranslated_english": "zh AND ol >= 24 AND (list_has_any(list_transform(regexp_extract_all(o, '[A-Za-z]{2,}'), lambda x: lower(x)), ['the', 'and', 'of', 'to']) OR " + _ENGLISH.format("o") + ")",
    "english_skeleton": f"zh AND len(list_filter(regexp_extract_all(o, '{_PHRASE % 30}'), lambda p: length({_line('p')}) >= 30 AND NOT {_entity('p')})) > 0",
    "source_echo": f"(zh OR en) AND len(list_filter(regexp_extract_all(o, '{_PHRASE % 12}'), lambda p: length({_line('p')}) >= 12 AND contains(lower({_line('i')}), lower({_line('p')})) AND contains(lower({_line('o')}), lower({_line('p')})) AND NOT {_entity('p')})) > 0",
    "over_expansion": "zh AND ni >= 40 AND no >= floor(ni * 2.8)",
    "unjustified_condition": rf"zh AND regexp_matches(o, '(?:如果|若|如){_WS}*适用') AND NOT {_word('i', chr(92).join(['if|unless|provided', 's+that|in', 's+the', 's+event|to', 's+the', 's+extent|subject', 's+to']), '(?i)')}",
    "repeated_sentence": f"(zh OR en) AND ni >= 80 AND {_REPEATED}",
}
def _issues(sides: str) -> str:
    return f"""
  SELECT rec_id, side, s, para_style, tu_kind, CASE WHEN coalesce(t, '') = '' THEN ['empty_output'] ELSE list_sort(list_filter([
    {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES.items())}], lambda x: x IS NOT NULL)) END AS issues
  FROM (
    SELECT *, tl LIKE 'zh%' AS zh, tl LIKE 'en%' AS en, {_n("i", "[^A-Za-z]")} AS il, {_n("i", r"[^\x{4e00}-\x{9fff}]")} AS ic, {_n("o", "[^A-Za-z]")} AS ol,
      {_n("o", r"[^\x{4e00}-\x{9fff}]")} AS oc, length({_line("i")}) AS ni, length({_line("o")}) AS no, len(regexp_extract_all(o, '[A-Za-z]{{2,}}')) AS w
    FROM (SELECT *, {_plain("s")} AS i, {_plain(_unfrozen("coalesce(t, '')", "nt_map"))} AS o FROM ({sides})))
"""


_ISSUES = _issues(_SIDES)
_NUMBERS = r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:-\p{Nd}+(?:[.,]\p{Nd}+)*)?"
_CONTROLS = "regexp_extract_all({0}, '<<MT_(?:TAB|BR|NBH|SHY)>>')"
_RISK = (
    "shall|must|may not|may|unless|provided that|in the event|notwithstanding|subject to|void|invalid|terminate|termination|breach|indemnif|"
    "representation|warrant|condition|governing law|jurisdiction|assignment|transfer|consent|notice|default"
).replace(" ", r"\s+")
def _protocol(sides: str) -> str:
    return rf"""
      WITH u AS ({sides}),
      x AS (SELECT rec_id, side, s, f, nt_map, coalesce(t, '') AS t,
        list_filter(coalesce(map_entries(nt_map), []), lambda e: NOT regexp_full_match(e.value, '{_NUMBERS}')) AS named,
        list_filter(coalesce(map_entries(nt_map), []), lambda e: regexp_full_match(e.value, '{_NUMBERS}')) AS numeric FROM u),
      y AS (SELECT *, list_transform(named, lambda e: e.key) AS want,
        list_filter(regexp_extract_all(t, '<<MT_NT:[0-9]{{4}}>>'), lambda x: NOT list_contains(list_transform(numeric, lambda e: e.key), x)) AS have FROM x)
      SELECT rec_id, side, CASE WHEN contains(t, chr(10)) OR contains(t, chr(13)) THEN 'raw_newline' WHEN contains(t, chr(9)) THEN 'raw_tab'
        WHEN {_CONTROLS.format("f")} <> {_CONTROLS.format("t")} THEN 'control_tokens_mismatch'
        WHEN list_sort(list_distinct(want)) <> list_sort(list_distinct(have)) THEN 'nt_mismatch'
        WHEN len(have) <> len(list_distinct(have)) THEN 'nt_count'
        WHEN regexp_matches(t, '<<MT_(?:SEG|END|SLOT):[0-9]{{6}}>>') THEN 'unexpected_sentinel'
        WHEN list_sort(regexp_extract_all({_plain("s")}, '{_NUMBERS}')) <> list_sort(regexp_extract_all({_plain(_unfrozen("t", "nt_map"))}, '{_NUMBERS}')) THEN 'number_mismatch' END AS error
      FROM y
    """


def _times(text: str, piece: str) -> str:
    return f"((length({text}) - length(replace({text}, {piece}, ''))) // length({piece}))"


def _first(text: str, needle: str, by: str, n: str) -> str:
    """``text`` with the first ``n`` places of ``needle`` replaced."""
    parts = f"string_split({text}, {needle})"
    joined = lambda own, mark: f"list_reduce({own}, lambda p, q: p || {mark} || q)"
    return f"{joined(f'{parts}[1:{n} + 1]', by)} || CASE WHEN len({parts}) > {n} + 1 THEN {needle} || {joined(f'{parts}[{n} + 2:]', needle)} ELSE '' END"


_TOKEN, _ORIGINAL = "split_part(x, chr(1), 1)", "split_part(x, chr(1), 2)"
_WANTED, _HELD = _times("f", _TOKEN), _times("a", _TOKEN)

#: Every record once, with its final text for a translation.
_FINAL = _SIDES.replace("CASE side WHEN 'a' THEN translation_a ELSE translation_b END AS t", "coalesce(nullif(final_translation, ''), nullif(translation_a, ''), nullif(frozen_surface, '')) AS t").replace(", ('b')", "")
_DECIDED = TEXT_ORACLE["q_translate_decision"].replace("SELECT source_lang, CASE", "SELECT rec_id, CASE").replace(", count(*) AS units", "").replace("GROUP BY 1, 2", "")
_FLAGS = TEXT_ORACLE["q_quality_flags"]


def _note(characters: str) -> str:
    a, b = (f"(length({t}) - length(translate({t}, '{characters}', '')))" for t in "st")
    return f"CASE WHEN {a} <> {b} THEN printf('{characters[:2]}:src=%d tgt=%d', {a}, {b}) END"


_NOTES = ", ".join(_note(c) for _, c in BRACKETS)
_MORE = _FLAGS.replace("SELECT rec_id, sn AS src_chars", f"SELECT rec_id, ratio, han, latin, array_to_string(list_filter([{_NOTES}], lambda y: y IS NOT NULL), ' | ') AS notes, sn AS src_chars")

ORACLE: dict[str, str] = {
    "q_detect_pair": rf"""
      WITH r AS (
        SELECT DISTINCT rec_id, file_id, tu_id, part_name, scope_key, source_surface,
          {_line(_plain("coalesce(source_surface, '')"))} AS t FROM paragraph_memory),
      c AS (SELECT *, coalesce(part_name LIKE '%word/document.xml' AND regexp_extract(scope_key, '#(w:p|a:p|w:lvlText)@', 1) = 'w:p' AND coalesce(source_surface, '') <> '', false) AS p,
        {_n("t", r"[^\x{4e00}-\x{9fff}]")} AS cjk, {_n("t", "[^A-Za-z]")} AS latin, {_n("t", r"[^\x{c0}-\x{24f}]")} AS ext, {_n("t", _NOT_OTHER)} AS oth,
        {_ENGLISH.format("t")} AS e FROM r),
      k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id, p ORDER BY tu_id, rec_id) <= 200),
      v AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN oth > 0 THEN 'u' WHEN cjk >= 4 AND cjk >= 2 * (latin + ext) THEN 'z'
          WHEN latin >= 4 AND latin >= 2 * cjk AND ext <= greatest(1, floor(latin * 0.03)) THEN CASE WHEN e THEN 'e' ELSE 'u' END
          WHEN cjk > 0 AND latin = 0 AND ext = 0 THEN 'z' WHEN latin > 0 AND cjk = 0 AND ext = 0 THEN 'e' ELSE 'u' END AS vote FROM k),
      s AS (SELECT file_id, p, count(*) FILTER (vote = 'e') AS en_votes, count(*) FILTER (vote = 'z') AS zh_votes, count(*) FILTER (vote = 'u') AS unknown_votes,
          sum(cjk)::BIGINT AS cjk, sum(latin)::BIGINT AS latin, sum(ext)::BIGINT AS latin_ext, sum(oth)::BIGINT AS other FROM v GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY p DESC) = 1),
      x AS (SELECT * EXCLUDE (p), CASE WHEN en_votes + zh_votes + latin + cjk = 0 AND other > 0 THEN NULL
          WHEN zh_votes >= 3 AND zh_votes >= floor(en_votes * 1.2) AND cjk >= floor(latin * 1.1) THEN 'zh->en'
          WHEN en_votes >= 3 AND en_votes >= floor(zh_votes * 1.2) AND latin >= floor(cjk * 1.1) THEN 'en->zh'
          WHEN cjk >= floor(latin * 1.25) AND cjk >= 20 THEN 'zh->en(low_conf)' WHEN latin >= floor(cjk * 1.25) AND latin >= 20 THEN 'en->zh(low_conf)'
          WHEN zh_votes > en_votes THEN 'zh->en(weak_vote)' WHEN en_votes > zh_votes THEN 'en->zh(weak_vote)'
          WHEN cjk > latin THEN 'zh->en(weak_char)' ELSE 'en->zh(weak_char)' END AS decision FROM s)
      SELECT *, substring(decision, 1, 2) AS src, substring(decision, 5, 2) AS tgt FROM x
    """,
    "q_text_looks": f"""
      WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT lang, count(*) AS lines, count(*) FILTER ({_ENGLISH.format("line")}) AS english, count(*) FILTER ({_entity("line")}) AS entities,
        sum({_n("line", _NOT_OTHER)})::BIGINT AS other FROM l GROUP BY lang
    """,
    "q_lang_labels": f"""
      WITH l AS (SELECT lang, count(*) AS documents, regexp_replace(coalesce(lang, ''), '^{_WS}+|{_WS}+$', '', 'g') AS b FROM documents GROUP BY lang),
      c AS (SELECT *, replace(lower(b), '_', '-') AS c FROM l)
      SELECT lang, documents, CASE WHEN c LIKE 'en%' THEN 'en' WHEN c LIKE 'zh%' THEN 'zh' END AS code,
        CASE WHEN c LIKE 'zh%' THEN 'Chinese' WHEN c LIKE 'en%' THEN 'English' WHEN lang IS NOT NULL THEN b END AS label,
        CASE WHEN c LIKE 'en%' THEN 'English' WHEN c LIKE 'zh%' THEN 'Simplified Chinese' ELSE lang END AS name,
        CASE WHEN c LIKE 'en%' THEN 'English' WHEN c LIKE 'zh%' THEN '简体中文' ELSE lang END AS native
      FROM c
    """,
    "q_previews": rf"""
      WITH r AS (SELECT DISTINCT rec_id, coalesce(frozen_surface, '') AS f FROM paragraph_memory),
      l AS (SELECT rec_id, {_line(r"regexp_replace(replace(replace(f, chr(13), '\r'), chr(10), '\n'), '<(<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]{4}|SEG:[0-9]{6}|END:[0-9]{6}|SLOT:[0-9]{6})>)>', '\1', 'g')")} AS p,
        {_line(_plain("f"))} AS h, {_line("f")} AS s FROM r)
      SELECT rec_id, CASE WHEN length(p) > 60 THEN left(p, 57) || '...' ELSE p END AS preview,
        CASE WHEN length(h) > 40 THEN left(h, 37) || '...' ELSE h END AS heading, CASE WHEN length(s) > 30 THEN left(s, 30) || '…' ELSE s END AS short FROM l
    """,
    "q_preserved_tokens": rf"""
      WITH r AS (SELECT DISTINCT rec_id, frozen_surface AS f FROM paragraph_memory),
      l AS (SELECT rec_id, regexp_extract_all(f, '{_SENTINEL}') || regexp_extract_all(f, '\p{{Nd}}+') ||
          list_filter(regexp_extract_all(f, '{_W}+'), lambda w: regexp_full_match(w, '[A-Z]{{2,10}}')) AS t FROM r)
      SELECT rec_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens FROM l
    """,
    "q_number_tokens": f"""
      SELECT doc_id, len(regexp_extract_all({_plain("coalesce(text, '')")}, '{_NUMBERS}'))::INT AS n,
        array_to_string(list_sort(regexp_extract_all({_plain("coalesce(text, '')")}, '{_NUMBERS}')), ' ') AS numbers FROM documents
    """,
    "q_quality_issues": f"""
      SELECT rec_id, side, array_to_string(issues, ',') AS issues, array_to_string(issues, ',') AS hard FROM ({_ISSUES})
    """,
    "q_protocol": _protocol(_SIDES),
    "q_hard_failures": f"""
      SELECT rec_id, error AS protocol_error, array_to_string(list_sort(CASE WHEN error IS NULL THEN issues ELSE list_append(issues, 'protocol_error') END), ',') AS issues
      FROM ({_issues(_FINAL)}) JOIN ({_protocol(_FINAL)}) USING (rec_id) JOIN ({_DECIDED}) USING (rec_id) WHERE reason = 'ok' AND (error IS NOT NULL OR len(issues) > 0)
    """,
    "q_review_needed": f"""
      SELECT rec_id, side, len(issues) > 0 OR length({_plain("s")}) >= 400 OR coalesce(lower(para_style) LIKE 'heading%', false) OR coalesce(tu_kind = 'table', false)
        OR {_word(_plain("s"), _RISK, "(?i)")} AS review FROM ({_ISSUES})
    """,
    "q_retranslate": rf"""
      SELECT rec_id, regexp_matches(hard_flags, '(^|,)(output_identical_to_source|contains_ellipsis_placeholder|len_ratio_too_(short|long)_extreme|target_script_missing_\w+)($|,)') AS again
      FROM ({_FLAGS})
    """,
    "q_rendered_quality": f"""
      SELECT rec_id, concat_ws(chr(10), 'QUALITY_HEURISTICS:', printf('- len: src_chars=%d tgt_chars=%d ratio=%.2f', src_chars, tgt_chars, ratio),
        printf('- scripts: han_ratio=%.2f latin_alpha_ratio=%.2f', han, latin), CASE WHEN notes <> '' THEN '- brackets: ' || notes END,
        CASE WHEN hard_flags <> '' THEN '- hard_flags: ' || replace(hard_flags, ',', ' | ') END, CASE WHEN soft_flags <> '' THEN '- soft_flags: ' || replace(soft_flags, ',', ' | ') END) AS report
      FROM ({_MORE})
    """,
    "q_glossary_leaks": rf"""
      WITH g AS (SELECT term_id, trim(src) AS en, trim(tgt) AS zh, list_transform(regexp_extract_all(src, '[A-Za-z]{{4,}}'), lambda w: lower(w)) AS ws FROM glossary),
      b AS (SELECT *, lag(source_surface) OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS p FROM (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory)),
      u AS (SELECT rec_id, {_line(_plain("coalesce(p, '')"))} AS i, {_line(_plain("coalesce(translation_a, '')"))} AS o
        FROM b JOIN memory_files USING (file_id) WHERE source_lang LIKE 'en%' AND target_lang LIKE 'zh%')
      SELECT rec_id, 'glossary_leakage:' || left(arg_min(en, term_id), 32) AS issue FROM u JOIN g ON contains(o, zh)
      WHERE len(ws) >= 2 AND length(zh) >= 6 AND regexp_matches(zh, '[\x{{4e00}}-\x{{9fff}}]') AND NOT contains(lower(i), lower(en))
        AND NOT list_has_any(ws, regexp_extract_all(lower(i), '{_W}+')) GROUP BY rec_id
    """,
    "q_decoded_tokens": """
      SELECT DISTINCT rec_id, md5(coalesce(frozen_surface, '')) AS text, regexp_matches(frozen_surface, '<<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]+)>>') AS respelt FROM paragraph_memory
    """,
    "q_cleaned_output": f"""
      SELECT DISTINCT rec_id, md5(regexp_replace(regexp_replace(coalesce(translation_a, ''), '^"+|("|{_WS})*$', '', 'g'), '^{_WS}+', '')) AS text FROM paragraph_memory
    """,
    "q_plain_output": rf"""
      WITH r AS (SELECT DISTINCT rec_id, regexp_replace(coalesce(translation_a, ''), '[\x{{000b}}\x{{000c}}\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]', ' ', 'g') AS t FROM paragraph_memory)
      SELECT rec_id, md5(trim(regexp_replace(regexp_replace(t, '([\x{{4e00}}-\x{{9fff}}]){_WS}+([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'), '([\x{{4e00}}-\x{{9fff}}]){_WS}+([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'))) AS text FROM r
    """,
    "q_expected_scripts": rf"""
      WITH r AS (SELECT DISTINCT rec_id, target_lang LIKE 'zh%' AS zh, regexp_replace(coalesce(translation_a, ''), '([。.])', '\1Жカ', 'g') AS t,
          list_distinct(regexp_extract_all({_plain("coalesce(source_surface, '')")}, '{_OTHER}')) AS own FROM paragraph_memory JOIN memory_files USING (file_id)),
      c AS (SELECT rec_id, t, CASE WHEN zh THEN array_to_string(list_filter(string_split(t, ''), lambda c: NOT regexp_full_match(c, '{_OTHER}') OR list_contains(own, c)), '') ELSE t END AS k FROM r)
      SELECT rec_id, md5(k) AS text, (SELECT CASE WHEN bool_or(translation_a IS NULL) THEN NULL ELSE k <> t END FROM paragraph_memory p WHERE p.rec_id = c.rec_id) AS changed FROM c
    """,
    "q_repaired_controls": """
      WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '\\r\\n|\\r|\\n|\\t') AS l, regexp_extract_all(text, '\\r\\n|\\r|\\n|\\t') AS b,
          greatest(0, 2 - len(regexp_extract_all(text, '<<MT_BR>>'))) AS lines, greatest(0, 1 - len(regexp_extract_all(text, '<<MT_TAB>>'))) AS tabs FROM documents WHERE text IS NOT NULL),
      k AS (SELECT *, list_filter(range(1, len(b) + 1), lambda i: b[i] = chr(9))[1:tabs] AS t, list_filter(range(1, len(b) + 1), lambda i: b[i] <> chr(9))[1:lines] AS n FROM p)
      SELECT doc_id, md5(array_to_string(list_transform(l, lambda x, i: x || CASE WHEN i > len(b) THEN '' WHEN list_contains(t, i) THEN '<<MT_TAB>>'
        WHEN list_contains(n, i) THEN '<<MT_BR>>' ELSE ' ' END), '')) AS text FROM k
    """.replace("\\\\", "\\"),
    "q_balanced_tokens": f"""
      WITH r AS (SELECT DISTINCT ON (rec_id) rec_id, coalesce(frozen_surface, '') AS f, coalesce(source_surface, '') AS s, coalesce(list_sort(map_entries(nt_map)), []) AS es FROM paragraph_memory),
      b AS (SELECT rec_id, list_reduce(list_prepend(s, list_transform(es, lambda e: e.key || chr(1) || e.value)), lambda a, x:
          CASE WHEN {_WANTED} > 0 AND {_HELD} < {_WANTED} AND {_ORIGINAL} <> '' THEN {_first("a", _ORIGINAL, _TOKEN, f"({_WANTED} - {_HELD})")}
            WHEN {_WANTED} > 0 AND {_HELD} > {_WANTED} THEN {_first("a", _TOKEN, _ORIGINAL, f"({_HELD} - {_WANTED})")} ELSE a END) AS t FROM r)
      SELECT rec_id, md5(t) AS text, array_to_string(list_sort(regexp_extract_all(t, '{_SENTINEL}')), ' ') AS tokens FROM b
    """,
    "q_allowed_sentinels": rf"""
      SELECT rec_id, md5(t) AS text, len(regexp_extract_all(t, '{_SENTINEL}'))::INT AS tokens FROM (
        SELECT DISTINCT rec_id, regexp_replace(coalesce(frozen_surface, ''), '<<MT_(?:TAB|BR|NBH|SHY|NT:(?:[1-9][0-9]{{3}}|0[1-9][0-9]{{2}}|00[1-9][0-9]|000[02456789])|(?:SEG|END|SLOT):[0-9]{{6}})>>', '', 'g') AS t FROM paragraph_memory)
    """,
}
