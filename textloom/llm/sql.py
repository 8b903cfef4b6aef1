"""DuckDB SQL for those llm queries that SQL can express."""

from __future__ import annotations

_ELEMENTS = """
  SELECT DISTINCT field, term, rec_id, pos FROM (
    SELECT 'terms' AS field, unnest(terms) AS term, rec_id, generate_subscripts(terms, 1) AS pos FROM paragraph_memory
    UNION ALL
    SELECT 'proper_nouns', unnest(proper_nouns), rec_id, generate_subscripts(proper_nouns, 1) FROM paragraph_memory
  ) WHERE term IS NOT NULL AND NOT regexp_full_match(term, '[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*')
"""

_FREQUENCY = f"""
  SELECT field, term, count(*)::BIGINT AS occurrences, count(DISTINCT rec_id)::BIGINT AS records
  FROM ({_ELEMENTS}) GROUP BY field, term
"""

_MARKS = r"[\p{P}|^`~｜]"
_BLANK = r"[\s\x{000b}\x{0085}\p{Z}]"


def _canonical(text: str) -> str:
    """A text without formatting, as the operator of problem 6 has it; marks between two digits stay, behind a sign."""
    low = f"lower(upper({text}))"
    behind = rf"regexp_replace({low}, '(\p{{Nd}})({_MARKS})', '\1' || chr(3) || '\2', 'g')"
    between = rf"regexp_replace({behind}, '\x03({_MARKS}\p{{Nd}})', chr(4) || '\1', 'g')"
    return rf"regexp_replace({between}, '(\x04{_MARKS})|{_MARKS}|{_BLANK}|[\p{{Cc}}\p{{Cf}}]', '\1', 'g')"


#: (id, key) of every line.
_LINES = rf"""
  WITH l AS (SELECT DISTINCT line_id AS id, regexp_replace(payload, '^(?:\x{{feff}}|\s)+', '') AS p FROM memory_lines WHERE line_id IS NOT NULL),
  r AS (SELECT id, lower(regexp_replace(coalesce(CASE WHEN json_valid(p) THEN json_extract_string(p, '$.tu_kind') END, ''), '^({_BLANK}|\p{{Cf}})+|({_BLANK}|\p{{Cf}})+$', '', 'g')) AS kind,
    CASE WHEN json_valid(p) THEN json_extract_string(p, '$."原文"') END AS t FROM l),
  i AS (SELECT *, list_filter(regexp_split_to_array(t, '[;；|｜]'), lambda x: length({_canonical("x")}) > 0) AS parts FROM r)
  SELECT id, CASE WHEN t IS NULL THEN NULL WHEN kind = 'other' AND len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '(?s)^[^:：]+[:：].*[^\s\x{{000b}}\x{{0085}}\p{{Z}}]'))) = 0
    THEN kind || chr(2) || 'list' || chr(1) || array_to_string(list_sort(list_transform(parts, lambda x: {_canonical("x")})), chr(1))
    ELSE kind || chr(2) || {_canonical("t")} END AS key FROM i
"""

ORACLE: dict[str, str] = {
    "p6_records": f"""
      WITH k AS ({_LINES})
      SELECT min(id) AS keep_id, count(*) AS copies FROM k WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT id, 1 FROM k WHERE key IS NULL
    """,
    "p6_found": f"""
      WITH k AS ({_LINES}), m AS (SELECT id, min(id) OVER (PARTITION BY key) AS keep_id FROM k WHERE key IS NOT NULL)
      SELECT keep_id, id AS copy_id FROM m WHERE id <> keep_id
    """,
    "p7_frequency": _FREQUENCY,
    "p7_found": f"""
      SELECT field, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark
      FROM ({_FREQUENCY})
      WHERE records <= 2 OR records > 0.05 * (SELECT count(DISTINCT rec_id) FROM paragraph_memory)
    """,
    "p4_found": r"""
      WITH r AS (
        SELECT DISTINCT rec_id, frozen_surface AS t, greatest(4000, 2 * coalesce(ctx_size, 0) - 1800) AS lim
        FROM paragraph_memory LEFT JOIN memory_files USING (file_id)
        LEFT JOIN model_backends ON model_a = backend_name WHERE strlen(frozen_surface) > 4000
      )
      SELECT rec_id, CASE WHEN len(list_filter(
          regexp_split_to_array(t, '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}。！？；，、]+'),
          lambda x: strlen(x) > lim)) > 0 THEN 'forced' ELSE 'natural' END AS cut_kind
      FROM r WHERE strlen(t) > lim
    """,
}
