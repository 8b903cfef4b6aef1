"""Queries of the text, masking and validation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import language, masking, text, validate
from textloom.functions.patterns import FREEZE_ALTERNATIVES
from textloom.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The records of the paragraph memory: redelivered rows once."""
    return table(spark, d, "paragraph_memory").select("rec_id", *columns).dropDuplicates(["rec_id"])


def with_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(spark, d, "file_id", *columns).join(table(spark, d, "memory_files").select("file_id", "source_lang", "target_lang"), "file_id")


def q_lang_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return (
        lines.where(F.col("line").rlike(r"(?U)\p{L}"))
        .groupBy("lang")
        .agg(
            F.count("*").alias("paragraphs"),
            F.sum(F.regexp_count("line", F.lit("[A-Za-z]")).cast("bigint")).alias("latin_letters"),
            F.sum(F.octet_length("line").cast("bigint")).alias("bytes"),
            F.sum(F.length("line").cast("bigint")).alias("chars"),
        )
    )


def q_trivial_units(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "tu_kind", "frozen_surface", "source_surface")
    return rows.groupBy("tu_kind").agg(
        F.count("*").alias("units"),
        F.count_if(text.is_trivial(F.col("frozen_surface"))).alias("trivial_frozen"),
        F.count_if(text.is_trivial(F.col("source_surface"))).alias("trivial_source"),
    )


def q_script_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = text.text_metrics(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("lang", *[c.cast("bigint").alias(k) for k, c in m.items()])
    return rows.groupBy("lang").agg(*[F.sum(k).alias(k) for k in m])


def q_language_pair(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = records(spark, d, "file_id", "tu_id", "source_surface")
    order = Window.partitionBy("file_id").orderBy("tu_id", "rec_id")
    head = rows.withColumn("n", F.row_number().over(order)).where("n <= 64").where(~text.blank(F.col("source_surface")))
    excerpts = head.withColumn("k", F.row_number().over(order)).where("k <= 20")
    plain = text.strip_sentinels(F.col("source_surface"))
    sums = excerpts.groupBy("file_id").agg(
        F.sum(text.counted(plain, "[一-鿿]").cast("bigint")).alias("cjk"), F.sum(text.counted(plain, "[A-Za-z]").cast("bigint")).alias("latin")
    )
    zh = (F.col("latin") < F.greatest(2 * F.col("cjk"), F.lit(12))) & (F.col("cjk") >= F.greatest(2 * F.col("latin"), F.lit(12)))
    return sums.withColumns({"src": F.when(zh, "zh").otherwise("en"), "tgt": F.when(zh, "en").otherwise("zh")})


def q_scope_types(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "scope_key", "part_name")
    return rows.groupBy(text.scope_type(F.col("scope_key")).alias("scope_type"), "part_name").agg(F.count("*").alias("units"))


def q_translate_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "frozen_surface")
    why = language.translate_decision(F.col("source_surface"), F.col("frozen_surface"), F.col("source_lang"))
    return rows.groupBy("source_lang", why.alias("reason")).agg(F.count("*").alias("units"))


def q_must_keep(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "frozen_surface")
    return rows.select("rec_id", text.must_keep_tokens(F.col("frozen_surface")).alias("tokens"), F.size(text.sentinels(F.col("frozen_surface"))).alias("n"))


def q_control_parts(spark: SparkSession, d: str) -> DataFrame:
    joined = F.regexp_replace("source_surface", "\n", "<<MT_BR>>")
    parts = text.control_parts(joined)
    return records(spark, d, "source_surface").select("rec_id", F.size(parts).alias("parts"), F.array_join(parts, "|").alias("joined"))


def q_token_formats(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "tu_id", "source_surface")
    n = F.col("tu_id")
    return rows.select(
        "rec_id",
        text.token("NT", n).alias("nt"),
        text.token("SEG", n).alias("seg_start"),
        text.token("END", n).alias("seg_end"),
        text.token("SLOT", n).alias("slot"),
        F.left(F.sha2("source_surface", 256), F.lit(10)).alias("hash_prefix"),
    )


def q_freeze(spark: SparkSession, d: str) -> DataFrame:
    rows = masking.frozen(records(spark, d, "source_surface"), "source_surface")
    return rows.select("rec_id", "frozen", F.size("nt").alias("tokens"), F.size("spans").alias("spans"))


def q_freeze_originals(spark: SparkSession, d: str) -> DataFrame:
    """What is frozen, place by place; wide digits are given as narrow ones."""
    rows = masking.frozen(records(spark, d, "source_surface"), "source_surface")
    found = F.translate(F.array_join(F.transform("spans", lambda s: s["original"]), "|"), "０１２３４５６７８９", "0123456789")
    return rows.select("rec_id", found.alias("originals"), F.size("spans").alias("spans"))


def q_freeze_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = masking.frozen(records(spark, d, "source_surface").where("source_surface is not null"), "source_surface")
    return rows.select("rec_id", masking.unfreeze(F.col("frozen"), F.map_from_entries("nt")).alias("text"))


def q_unfreeze(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "frozen_surface", "nt_map")
    return rows.select("rec_id", masking.unfreeze(F.col("frozen_surface"), F.col("nt_map")).alias("text"), masking.rendered_map(F.col("nt_map")).alias("tokens"))


def q_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "frozen_surface", "source_surface", "nt_map", "translation_a")
    rows = validate.validated(rows, "frozen_surface", "nt_map", "translation_a", "masked_error")
    return validate.validated(rows, "source_surface", None, "translation_a", "plain_error").select("rec_id", "masked_error", "plain_error")


def q_validate_digits(spark: SparkSession, d: str) -> DataFrame:
    """The checks up to digits on unmasked pairs."""
    rows = records(spark, d, "source_surface", "translation_a").where("source_surface is not null")
    rows = validate.validated(rows, "source_surface", None, "translation_a")
    later = F.col("error").isin("legal_ref_id_mismatch", "compound_legal_id_mismatch")
    return rows.select("rec_id", F.when(~later, F.col("error")).alias("error"))


def q_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = with_files(spark, d, "source_surface", "translation_a").where("source_surface is not null")
    rows = validate.quality_flags(rows, "source_surface", None, "translation_a", "source_lang", "target_lang")
    return rows.select(
        "rec_id",
        F.col("src_chars").cast("bigint"),
        F.col("tgt_chars").cast("bigint"),
        F.round("len_ratio", 6).alias("len_ratio"),
        F.array_join("hard_flags", ",").alias("hard_flags"),
        F.array_join("soft_flags", ",").alias("soft_flags"),
    )


def q_similarity_form(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_sentences").select("sent_id", "seg_text").dropDuplicates(["sent_id"])
    return rows.select("sent_id", F.md5(text.normalized_for_similarity(F.col("seg_text"))).alias("form"), text.has_short_ellipsis(F.col("seg_text")).alias("ellipsis"))


def q_name_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "scope_key", "part_name", "tu_kind")
    return rows.select(
        "rec_id",
        text.sanitized_name(F.col("scope_key")).alias("file_name"),
        text.part_target(F.concat(F.lit("../"), F.col("part_name"))).alias("part"),
        F.col("part_name").rlike(text.wildcard("word/f*.xml")).alias("is_footer"),
        text.render("{{kind}} in {{part}}", kind=F.col("tu_kind"), part=F.col("part_name")).alias("label"),
    )


def q_repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 12 characters or more that the documents of a source hold twice or more."""
    lines = spread(table(spark, d, "documents").select("source", "text")).select("source", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("source", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")).alias("line")).where("length(line) >= 12")
    return rows.groupBy("source", "line").agg(F.count("*").alias("times")).where("times >= 2")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        q_lang_profile, q_trivial_units, q_script_metrics, q_language_pair, q_scope_types, q_translate_decision, q_must_keep, q_control_parts,
        q_token_formats, q_freeze, q_freeze_originals, q_freeze_roundtrip, q_unfreeze, q_validate, q_validate_digits, q_quality_flags, q_similarity_form, q_name_forms,
        q_repeated_sentences,
    )
}

_WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SENTINEL = r"<<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]{4}|SEG:[0-9]{6}|END:[0-9]{6}|SLOT:[0-9]{6})>>"
_HAN = r"[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{2ceb0}-\x{2ebef}]"


_NOT_OTHER = r"[^\x{900}-\x{97f}\x{980}-\x{9ff}\x{600}-\x{6ff}\x{400}-\x{4ff}\x{370}-\x{3ff}\x{590}-\x{5ff}\x{e00}-\x{e7f}\x{ac00}-\x{d7af}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]"
_COMMON = (
    "an and are as at be between by dated for from has have in into is it its may not of on or shall subject such that the their this to under will with"
)
#: Whether a text looks English, over the place for its expression.
_ENGLISH = (
    "(len(regexp_extract_all(lower({0}), '[a-z]{{2,}}')) > 0 AND (len(regexp_extract_all(lower({0}), '[a-z]{{2,}}')) < 4 OR "
    f"list_has_any(regexp_extract_all(lower({{0}}), '[a-z]{{{{2,}}}}'), string_split('{_COMMON}', ' '))))"
)


def _n(text: str, outside: str) -> str:
    """Characters left when those outside a class are taken away."""
    return f"length(regexp_replace({text}, '{outside}', '', 'g'))"


def _metrics(text: str) -> dict[str, str]:
    return {
        "non_ws": _n(text, _WS),
        "han": _n(text, _HAN),
        "latin": _n(text, "[^A-Za-z]"),
        "kana": _n(text, r"[^\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}]"),
        "hangul": _n(text, r"[^\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}]"),
    }


def _same(text: str) -> str:
    return f"lower(translate(regexp_replace({text}, '{_WS}+', '', 'g'), '（）【】｛｝，。：；！？“”„‟‘’‚‛', '()[]{{}},.:;!?\"\"\"\"'''''''''))"


_SRC, _TGT = _metrics("s"), _metrics("t")


def _bracket(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_BRACKETS = (("parens", "()（）"), ("square", "[]【】"), ("curly", "{}｛｝"), ("angle", "<>《》"))
_SHORT_ELLIPSIS = "len(list_filter(regexp_extract_all({0}, '…+'), lambda x: length(x) < 8)) > 0"

def _unfrozen_sql(text: str) -> str:
    entries = "coalesce(list_sort(map_entries(m)), [])"
    return (
        f"list_reduce(list_prepend({text}, list_transform({entries}, lambda e: e.key || chr(1) || e.value)),"
        " lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))"
    )


def _ascii(text: str) -> str:
    """Letters beyond ASCII as ``q`` and marks beyond it as spaces, so that ASCII word boundaries are Unicode's."""
    return rf"regexp_replace(regexp_replace({text}, '[^\pL\pN\pM_\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', 'q', 'g')"


_ID = r"([0-9]+(?:[.,][0-9]+)*(?:-[0-9]+(?:[.,][0-9]+)*)?(?:\([A-Za-z0-9]+\))*|[IVXLCDM]{1,8})"


def _compound(text: str, before: str = "", flags: str = "") -> str:
    ids = rf"list_transform(regexp_extract_all({_ascii(text)}, '{flags}\b{before}{_ID}\b', 1), lambda x: upper(replace(x, ',', '.')))"
    return rf"list_filter({ids}, lambda x: regexp_matches(x, '[.()-]') OR (regexp_matches(x, '[A-Za-z]') AND length(x) > 1))"


_TIMES = "((length({0}) - length(replace({0}, {1}, ''))) // length({1}))"
_MT = r"<<MT_[A-Za-z0-9_:\-]{1,64}>>"
_BLOCKS = "string_split(regexp_replace({0}, '(<<MT_(?:TAB|BR|NBH|SHY)>>)', chr(1), 'g'), chr(1))"
#: (rec_id, k, error): the first failing check of translation A, with the mask (k = m) and without (k = p).
_VALIDATED = rf"""
  WITH r AS (SELECT DISTINCT ON (rec_id) * FROM paragraph_memory),
  u AS (SELECT rec_id, 'm' AS k, coalesce(frozen_surface, '') AS s, coalesce(translation_a, '') AS t, nt_map AS m FROM r
    UNION ALL SELECT rec_id, 'p', coalesce(source_surface, ''), coalesce(translation_a, ''), MAP {{}}::MAP(VARCHAR, VARCHAR) FROM r),
  x AS (SELECT *, coalesce(map_keys(m), []) AS keys, regexp_replace({_unfrozen_sql("s")}, '{_MT}', ' ', 'g') AS sp, regexp_replace({_unfrozen_sql("t")}, '{_MT}', ' ', 'g') AS tp,
    {_BLOCKS.format("s")} AS sb, {_BLOCKS.format("t")} AS tb FROM u),
  y AS (SELECT *, {_compound("sp", r"(?:section|article|clause|paragraph|schedule|sec|art|cl|para|sch)[.]?\s+", "(?i)")} AS refs, {_compound("sp")} AS own, {_compound("tp")} AS found FROM x)
  SELECT rec_id, k, CASE WHEN regexp_full_match(t, '{_WS}*') THEN 'empty_output'
    WHEN len(list_filter(regexp_extract_all(t, '{_MT}'), lambda z: NOT list_contains(regexp_extract_all(s, '{_MT}'), z))) > 0 THEN 'unexpected_mt_token'
    WHEN list_filter(regexp_extract_all(s, '{_SENTINEL}'), lambda z: NOT starts_with(z, '<<MT_NT:')) <> list_filter(regexp_extract_all(t, '{_SENTINEL}'), lambda z: NOT starts_with(z, '<<MT_NT:')) THEN 'sentinel_sequence_mismatch'
    WHEN list_transform(sb, lambda z: regexp_full_match(z, '{_WS}*')) <> list_transform(tb, lambda z: regexp_full_match(z, '{_WS}*')) THEN 'control_token_layout_mismatch'
    WHEN len(list_filter(keys, lambda z: {_TIMES.format("s", "z")} <> {_TIMES.format("t", "z")})) > 0 THEN 'nt_token_count_mismatch'
    WHEN len(list_filter(keys, lambda z: list_transform(sb, lambda b: {_TIMES.format("b", "z")}) <> list_transform(tb, lambda b: {_TIMES.format("b", "z")}))) > 0 THEN 'nt_token_control_block_mismatch'
    WHEN list_sort(regexp_extract_all(sp, '\p{{Nd}}+')) <> list_sort(regexp_extract_all(tp, '\p{{Nd}}+')) THEN 'digits_mismatch'
    WHEN len(list_filter(refs, lambda z: len(list_filter(refs, lambda q: q = z)) <> len(list_filter(found, lambda q: q = z)))) > 0 THEN 'legal_ref_id_mismatch'
    WHEN len(own) > 0 AND list_sort(own) <> list_sort(found) THEN 'compound_legal_id_mismatch' END AS error FROM y
"""

#: Letters beyond ASCII. Between one and an ASCII letter or digit is no word boundary; an underscore tells RE2 so.
_BEYOND = (  # the two joiners are word characters too
    r"[\x{200c}\x{200d}\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{300}-\x{1fff}\x{3005}-\x{3007}\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}"
    r"\x{30fc}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{20000}-\x{2ebef}]"
)
_NARROW = "translate(t, '０１２３４５６７８９', '0123456789')"
_BOUNDED = rf"regexp_replace(regexp_replace({_NARROW}, '({_BEYOND})([0-9A-Za-z])', '\1' || chr(1) || '_\2', 'g'), '([0-9A-Za-z)])({_BEYOND})', '\1_' || chr(1) || '\2', 'g')"
_FREEZE = "|".join([_SENTINEL, *(a.replace(r"\s", _WS[1:-1]) for a in FREEZE_ALTERNATIVES)]).replace("'", "''")

ORACLE: dict[str, str] = {
    "q_freeze_originals": f"""
      WITH r AS (SELECT DISTINCT rec_id, source_surface AS t FROM paragraph_memory),
      m AS (SELECT rec_id, list_filter(regexp_extract_all({_BOUNDED}, '{_FREEZE}'), lambda x: NOT regexp_full_match(x, '{_SENTINEL}')) AS ms FROM r)
      SELECT rec_id, array_to_string(ms, '|') AS originals, len(ms)::INT AS spans FROM m
    """,
    "q_lang_profile": r"""
      WITH lines AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT lang, count(*) AS paragraphs,
        sum(length(regexp_replace(line, '[^A-Za-z]', '', 'g')))::BIGINT AS latin_letters,
        sum(strlen(line))::BIGINT AS bytes, sum(length(line))::BIGINT AS chars
      FROM lines WHERE regexp_matches(line, '\pL') GROUP BY lang
    """,
    "q_trivial_units": rf"""
      SELECT tu_kind, count(*) AS units,
        count(*) FILTER (NOT regexp_matches(regexp_replace(frozen_surface, '{_SENTINEL}', ' ', 'g'), '\pL')) AS trivial_frozen,
        count(*) FILTER (NOT regexp_matches(regexp_replace(source_surface, '{_SENTINEL}', ' ', 'g'), '\pL')) AS trivial_source
      FROM (SELECT DISTINCT rec_id, tu_kind, frozen_surface, source_surface FROM paragraph_memory) GROUP BY tu_kind
    """,
    "q_script_metrics": "SELECT lang, "
    + ", ".join(f"sum({c})::BIGINT AS {k}" for k, c in _metrics("text").items())
    + " FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "q_language_pair": rf"""
      WITH r AS (SELECT DISTINCT rec_id, file_id, tu_id, source_surface AS s FROM paragraph_memory),
      a AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS n FROM r),
      b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tu_id, rec_id) AS k FROM a
            WHERE n <= 64 AND NOT regexp_full_match(s, '{_WS}*')),
      c AS (SELECT file_id, regexp_replace(s, '{_SENTINEL}', ' ', 'g') AS p FROM b WHERE k <= 20),
      e AS (SELECT file_id, sum({_n("p", r"[^\x{4e00}-\x{9fff}]")})::BIGINT AS cjk, sum({_n("p", "[^A-Za-z]")})::BIGINT AS latin FROM c GROUP BY file_id)
      SELECT *, CASE WHEN z THEN 'zh' ELSE 'en' END AS src, CASE WHEN z THEN 'en' ELSE 'zh' END AS tgt
      FROM (SELECT *, latin < greatest(2 * cjk, 12) AND cjk >= greatest(2 * latin, 12) AS z FROM e)
    """.replace("SELECT *, CASE WHEN z", "SELECT file_id, cjk, latin, CASE WHEN z"),
    "q_scope_types": """
      SELECT coalesce(nullif(regexp_extract(scope_key, '#(w:p|a:p|w:lvlText)@', 1), ''), 'unknown') AS scope_type, part_name, count(*) AS units
      FROM (SELECT DISTINCT rec_id, scope_key, part_name FROM paragraph_memory) GROUP BY 1, 2
    """,
    "q_translate_decision": rf"""
      WITH r AS (
        SELECT DISTINCT rec_id, source_lang, frozen_surface AS f,
          trim(regexp_replace(regexp_replace(coalesce(source_surface, ''), '{_SENTINEL}', ' ', 'g'), '{_WS}+', ' ', 'g')) AS t
        FROM paragraph_memory JOIN memory_files USING (file_id)),
      c AS (SELECT *, {_n("t", r"[^\x{4e00}-\x{9fff}]")} AS han, {_n("t", "[^A-Za-z]")} AS latin, {_n("t", r"[^\x{c0}-\x{24f}]")} AS accented,
        {_n("t", _NOT_OTHER)} AS other, {_ENGLISH.format("t")} AS english
        FROM r)
      SELECT source_lang, CASE WHEN t = '' THEN 'empty'
        WHEN regexp_full_match(regexp_replace(coalesce(f, ''), '{_SENTINEL}', '', 'g'), '{_WS}*') THEN 'sentinel_only'
        WHEN other > 0 AND han + latin + accented = 0 THEN 'other_script'
        WHEN source_lang = 'en' AND latin = 0 AND han > 0 THEN 'already_zh'
        WHEN source_lang = 'en' AND latin = 0 THEN 'no_latin'
        WHEN source_lang = 'en' AND accented >= 2 AND NOT english THEN 'non_english_latin'
        WHEN source_lang = 'zh' AND han = 0 AND latin > 0 THEN 'already_en'
        WHEN source_lang = 'zh' AND han = 0 THEN 'no_cjk' ELSE 'ok' END AS reason, count(*) AS units
      FROM c GROUP BY 1, 2
    """,
    "q_must_keep": rf"""
      SELECT rec_id, array_to_string(regexp_extract_all(frozen_surface, '{_SENTINEL}'), ' ') AS tokens,
        len(regexp_extract_all(frozen_surface, '{_SENTINEL}'))::INT AS n
      FROM (SELECT DISTINCT rec_id, frozen_surface FROM paragraph_memory)
    """,
    "q_control_parts": """
      SELECT rec_id, (2 * len(string_split(source_surface, chr(10))) - 1 + 2 * len(regexp_extract_all(source_surface, '<<MT_(?:TAB|BR|NBH|SHY)>>')))::INT AS parts,
        regexp_replace(replace(source_surface, chr(10), '<<MT_BR>>'), '(<<MT_(?:TAB|BR|NBH|SHY)>>)', '|\\1|', 'g') AS joined
      FROM (SELECT DISTINCT rec_id, source_surface FROM paragraph_memory)
    """.replace("\\\\1", "\\1"),
    "q_token_formats": """
      SELECT rec_id, printf('<<MT_NT:%04d>>', tu_id) AS nt, printf('<<MT_SEG:%06d>>', tu_id) AS seg_start, printf('<<MT_END:%06d>>', tu_id) AS seg_end,
        printf('<<MT_SLOT:%06d>>', tu_id) AS slot, left(sha256(source_surface), 10) AS hash_prefix
      FROM (SELECT DISTINCT rec_id, tu_id, source_surface FROM paragraph_memory)
    """,
    "q_freeze_roundtrip": "SELECT DISTINCT rec_id, source_surface AS text FROM paragraph_memory WHERE source_surface IS NOT NULL",
    "q_unfreeze": """
      WITH r AS (SELECT DISTINCT ON (rec_id) rec_id, frozen_surface AS f, nt_map FROM paragraph_memory),
      e AS (SELECT rec_id, f, list_sort(map_entries(nt_map)) AS es FROM r)
      SELECT rec_id,
        list_reduce(list_prepend(f, list_transform(es, lambda x: x.key || chr(1) || x.value)),
          lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) AS text,
        array_to_string(list_transform(es, lambda x: x.key || '=' || x.value), chr(10)) AS tokens
      FROM e
    """,
    "q_validate_digits": rf"""
      WITH r AS (SELECT DISTINCT rec_id, source_surface AS s, coalesce(translation_a, '') AS t FROM paragraph_memory WHERE source_surface IS NOT NULL),
      c AS (SELECT *, regexp_extract_all(s, '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>') AS sm, regexp_extract_all(t, '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>') AS tm,
        list_filter(regexp_extract_all(s, '{_SENTINEL}'), lambda x: NOT starts_with(x, '<<MT_NT:')) AS ss,
        list_filter(regexp_extract_all(t, '{_SENTINEL}'), lambda x: NOT starts_with(x, '<<MT_NT:')) AS ts,
        regexp_extract_all(s, '<<MT_(?:TAB|BR|NBH|SHY)>>') AS sc, regexp_extract_all(t, '<<MT_(?:TAB|BR|NBH|SHY)>>') AS tc,
        list_transform(string_split(regexp_replace(s, '<<MT_(?:TAB|BR|NBH|SHY)>>', chr(1), 'g'), chr(1)), lambda x: regexp_full_match(x, '{_WS}*')) AS sb,
        list_transform(string_split(regexp_replace(t, '<<MT_(?:TAB|BR|NBH|SHY)>>', chr(1), 'g'), chr(1)), lambda x: regexp_full_match(x, '{_WS}*')) AS tb,
        list_sort(regexp_extract_all(regexp_replace(s, '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>', ' ', 'g'), '\p{{Nd}}+')) AS sd,
        list_sort(regexp_extract_all(regexp_replace(t, '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>', ' ', 'g'), '\p{{Nd}}+')) AS td FROM r)
      SELECT rec_id, CASE WHEN regexp_full_match(t, '{_WS}*') THEN 'empty_output'
        WHEN len(list_filter(tm, lambda x: NOT list_contains(sm, x))) > 0 THEN 'unexpected_mt_token'
        WHEN ss <> ts THEN 'sentinel_sequence_mismatch' WHEN sc <> tc THEN 'control_token_sequence_mismatch'
        WHEN sb <> tb THEN 'control_token_layout_mismatch' WHEN sd <> td THEN 'digits_mismatch' END AS error
      FROM c
    """,
    "q_quality_flags": rf"""
      WITH r AS (SELECT DISTINCT rec_id, source_lang AS sl, target_lang AS tl, regexp_replace(source_surface, '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>', ' ', 'g') AS s,
          regexp_replace(coalesce(translation_a, ''), '<<MT_[A-Za-z0-9_:\-]{{1,64}}>>', ' ', 'g') AS t
        FROM paragraph_memory JOIN memory_files USING (file_id) WHERE source_surface IS NOT NULL),
      m AS (SELECT *, {_SRC["non_ws"]} AS sn, {_TGT["non_ws"]} AS tn, {_TGT["han"]} AS th, {_TGT["latin"]} AS tla, {_TGT["kana"]} AS tk, {_TGT["hangul"]} AS tg FROM r),
      x AS (SELECT *, CASE WHEN sn = 0 THEN 0.0 ELSE tn / sn END AS ratio, CASE WHEN tn = 0 THEN 0.0 ELSE th / tn END AS han,
        CASE WHEN tn = 0 THEN 0.0 ELSE tla / tn END AS latin, CASE WHEN tn = 0 THEN 0.0 ELSE tk / tn END AS kana, CASE WHEN tn = 0 THEN 0.0 ELSE tg / tn END AS hangul,
        sl <> '' AND tl <> '' AND sl <> tl AND tn >= 20 AS d FROM m)
      SELECT rec_id, sn AS src_chars, tn AS tgt_chars, round(ratio, 6) AS len_ratio,
        array_to_string(list_sort(list_filter([
          CASE WHEN {_same("s")} = {_same("t")} AND strlen({_same("s")}) >= 24 THEN 'output_identical_to_source' END,
          CASE WHEN sn >= 40 AND ratio > 0 AND ratio < 0.25 THEN 'len_ratio_too_short_extreme' END,
          CASE WHEN sn >= 40 AND ratio > 4 THEN 'len_ratio_too_long_extreme' END,
          CASE WHEN d AND tl LIKE 'zh%' AND han < 0.06 AND latin > 0.25 THEN 'target_script_missing_han' END,
          CASE WHEN d AND tl LIKE 'en%' AND latin < 0.18 AND han > 0.20 THEN 'target_script_missing_latin' END,
          CASE WHEN d AND tl LIKE 'ja%' AND han + kana < 0.10 AND latin > 0.25 THEN 'target_script_missing_japanese' END,
          CASE WHEN d AND tl LIKE 'ko%' AND hangul < 0.10 AND latin > 0.25 THEN 'target_script_missing_korean' END,
          CASE WHEN {_SHORT_ELLIPSIS.format("t")} AND NOT ({_SHORT_ELLIPSIS.format("s")}) THEN 'contains_ellipsis_placeholder' END,
          {", ".join(f"CASE WHEN {_bracket('s', c)} > 0 AND {_bracket('t', c)} = 0 THEN 'missing_brackets_{n}' END" for n, c in _BRACKETS)}
        ], lambda y: y IS NOT NULL)), ',') AS hard_flags,
        array_to_string(list_sort(list_filter([
          CASE WHEN sn >= 40 AND ratio >= 0.25 AND ratio < 0.35 THEN 'len_ratio_too_short' END,
          CASE WHEN sn >= 40 AND ratio <= 4 AND ratio > 2.8 THEN 'len_ratio_too_long' END,
          CASE WHEN d AND tl LIKE 'en%' AND NOT (latin < 0.18 AND han > 0.20) AND han > 0.25 THEN 'target_contains_much_han' END,
          {", ".join(f"CASE WHEN {_bracket('t', c)} > 0 AND {_bracket('s', c)} <> {_bracket('t', c)} THEN CASE WHEN abs({_bracket('s', c)} - {_bracket('t', c)}) >= 4 THEN 'bracket_count_mismatch_{n}' ELSE 'bracket_count_mismatch' END END" for n, c in _BRACKETS)}
        ], lambda y: y IS NOT NULL)), ',') AS soft_flags
      FROM x
    """,
    "q_similarity_form": rf"""
      SELECT DISTINCT sent_id, md5({_same("seg_text")}) AS form, {_SHORT_ELLIPSIS.format("seg_text")} AS ellipsis FROM memory_sentences
    """,
    "q_name_forms": r"""
      SELECT DISTINCT rec_id, regexp_replace(scope_key, '[/\\:*?"<>|]', '_', 'g') AS file_name, part_name AS part,
        regexp_full_match(part_name, 'word/f.*\.xml') AS is_footer, tu_kind || ' in ' || part_name AS label
      FROM paragraph_memory
    """,
    "q_repeated_sentences": rf"""
      WITH l AS (SELECT source, trim(regexp_replace(unnest(string_split(text, chr(10))), '{_WS}+', ' ', 'g')) AS line FROM documents)
      SELECT source, line, count(*) AS times FROM l WHERE length(line) >= 12 GROUP BY 1, 2 HAVING count(*) >= 2
    """,
    "q_validate": f"""
      SELECT rec_id, max(error) FILTER (k = 'm') AS masked_error, max(error) FILTER (k = 'p') AS plain_error FROM ({_VALIDATED}) GROUP BY rec_id
    """,
}
