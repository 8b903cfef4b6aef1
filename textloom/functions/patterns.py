"""Token formats, patterns and constants that results depend on, in Java's syntax.

``(?U)`` makes classes and word boundaries follow Unicode.
"""

from __future__ import annotations

NT_WIDTH, SEG_WIDTH, SLOT_WIDTH = 4, 6, 6
CONTROL_TOKENS = ("<<MT_TAB>>", "<<MT_BR>>", "<<MT_NBH>>", "<<MT_SHY>>")
CONTROL = "<<MT_(?:TAB|BR|NBH|SHY)>>"
SENTINEL = r"<<MT_(?:TAB|BR|NBH|SHY|NT:[0-9]{4}|SEG:[0-9]{6}|END:[0-9]{6}|SLOT:[0-9]{6})>>"
ANY_MT = r"<<MT_[A-Za-z0-9_:\-]{1,64}>>"
NT = r"<<MT_NT:[0-9]{4}>>"

#: What masking freezes; the first alternative that matches at a place wins.
FREEZE_ALTERNATIVES = (
    r"[\p{L}\p{N}]{2,24}[®™©]",
    r"[ऀ-ॿঀ-৿؀-ۿЀ-ӿͰ-Ͽ֐-׿฀-๿가-힯぀-ゟ゠-ヿ]+",
    r"https?://[^\s<>()]+",
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r'(?:[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*)',
    r"(?:\{[^{}\r\n]{1,100}\}|\$\{[^{}\r\n]{1,100}\})",
    r"%\d+",
    r"(?:\b\d+(?:[.,]\d+)+(?:-\d+(?:[.,]\d+)*)?(?:\([A-Za-z0-9]+\))*\b|\b\d+(?:-\d+)+(?:\([A-Za-z0-9]+\))*\b"
    r"|\b\d+\([A-Za-z0-9]+\)(?:\([A-Za-z0-9]+\))*\b|\b[IVXLCDM]{1,8}\b)",
    r"\(\d{1,3}\)",
    r"\((?:[ivxlcdmIVXLCDM]{1,6})\)",
    r"\([A-Za-z]\)",
    r"[.…]{8,}",
    r"_{5,}",
    r"[-‐‑‒–—―−]{5,}",
    r"\b\d{1,2}:\d{2}\b",
    r"\b\d+\b",
    r"\b[XYZ]\b",
)
FREEZE = "(?U)" + SENTINEL + "|" + "|".join(FREEZE_ALTERNATIVES)

ID = r"\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?(?:\([A-Za-z0-9]+\))*|[IVXLCDM]{1,8}"
LEGAL_ID = rf"(?U)\b({ID})\b"
LEGAL_REF = rf"(?iU)\b(?:section|article|clause|paragraph|schedule|sec|art|cl|para|sch)\.?\s+({ID})\b"
HAN = r"[㐀-䶿一-鿿豈-﫿\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}]"
KANA = r"[぀-ゟ゠-ヿㇰ-ㇿ]"
HANGUL = r"[가-힯ᄀ-ᇿ㄰-㆏]"

#: Characters that count as the same when two texts are compared, as from and to.
SAME_FROM = "（）【】｛｝，。：；！？“”„‟‘’‚‛"
SAME_TO = "()[]{},.:;!?\"\"\"\"''''"
#: Kinds of brackets: name, characters.
BRACKETS = (("parens", "()（）"), ("square", "[]【】"), ("curly", "{}｛｝"), ("angle", "<>《》"))

#: Candidate terms: pattern, weight; the pattern's first group is the term.
QUOTED = "[“\"‘']([^”\"’'\\r\\n]{2,80})[”\"’']"
ACRONYM = r"(?U)(\b[A-Z][A-Z0-9]{1,12}\b)"
TITLE = r"(?U)(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,6}\b)"
TITLE_CONNECTED = (
    r"(?U)(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,6}(?:\s+(?:and|of|for|to|the|&)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,6})+\b)"
)
TERM_WEIGHTS = ((QUOTED, 8), (ACRONYM, 4), (TITLE_CONNECTED, 3), (TITLE, 2))

# Fixed values of the language and issue rules.
OTHER_SCRIPTS = r"[ऀ-ॿঀ-৿؀-ۿЀ-ӿͰ-Ͽ֐-׿฀-๿가-힯぀-ゟ゠-ヿ]"
NUMBER_TOKEN = r"(?U)(?<!\d)\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?(?!\d)"
ACRONYM_TOKEN = r"(?U)\b[A-Z]{2,10}\b"
COMMON_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "between", "by", "dated", "for", "from", "has", "have", "in", "into", "is", "it", "its", "may",
    "not", "of", "on", "or", "shall", "subject", "such", "that", "the", "their", "this", "to", "under", "will", "with",
)
ENTITY_STOP_WORDS = (
    "is", "are", "was", "were", "to", "the", "a", "an", "of", "for", "in", "on", "at", "by", "as", "from", "and", "or", "not", "will", "shall",
    "may", "must", "subject",
)
ENTITY_SUFFIX = (
    r"(?iU)\b(?:inc\.?|incorporated|ltd\.?|limited|llc|l\.l\.c\.|plc|gmbh|s\.a\.|s\.a\.s\.|s\.r\.l\.|"
    r"corp\.?|corporation|company|co\.|n\.a\.|n\.v\.|ag|bv|b\.v\.)\b"
)
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{2060}]"
REPEATED_CHARACTER = r"(.)\1{12,}"
PROMPT_TAG = (
    r"(?i)\[(?:/?(?:CONTEXT|TEXT|TARGET|SRC|DRAFT|DOC_CONTEXT|CURRENT_PROBLEMS|STRUCTURE|EXCERPTS|TERMS|"
    r"NEIGHBOR_SRC_PREV|NEIGHBOR_SRC_NEXT|BAD_OUTPUT|BAD_OUTPUT_SEG|SRC_SEG))\]"
)
PROMPT_LABEL = (
    r"(?iU)\b(?:Domain|Document\s+type|Document\s+summary|Target\s+writing\s+style|Style\s+guide|Glossary|Context\s*\(|"
    r"Relevant\s+excerpts|Text\s+to\s+translate|Source\s+text|Draft\s+translation|Bad\s+output|Structure\s+hints|"
    r"Previous\s+source\s+paragraph|Next\s+source\s+paragraph)\b\s*:"
)
ZH_REFERENCE_KINDS = "条|款|节|段|章|篇"
ZH_REFERENCE_OPEN = rf"(?U)第\s*(?:X|x|\?|\*|[IVXLCDM]{{1,8}})\s*(?:{ZH_REFERENCE_KINDS})|第\s*(?:{ZH_REFERENCE_KINDS})"
EN_CONDITION = r"(?iU)\b(?:if|unless|provided\s+that|in\s+the\s+event|to\s+the\s+extent|subject\s+to|if\s+applicable|if\s+specified)\b"
ZH_CONDITION = r"(?U)(?:如果|若|如)\s*适用"
DEFAULT_SETTING = r"(?iU)\bby\s+default\b|\bdefault\s+settings?\b|\bdefault\s+value\b|\bdefault\s+configuration\b"
LATIN_PHRASE = r"""[A-Za-z][A-Za-z0-9 ,.;:'"()/\\-]{{{least},}}"""
SENTENCE_MARKS = "[。！？；：.!?;:]"
#: Issues that fail a unit.
HARD_ISSUES = (
    "protocol_error", "empty_output", "prompt_artifact", "unexpected_script", "zero_width_chars", "repeated_char_run", "repeated_sentence",
    "bad_reference_placeholder", "variable_marker_missing", "too_short", "coverage_low", "over_expansion", "unjustified_condition",
    "it_default_sense", "looks_untranslated", "english_skeleton", "mixed_language", "untranslated_english", "source_echo",
    "duplicate_paragraph", "stitch_duplicate_chunk",
)
#: Words of a legal decision: a unit that holds one is reviewed.
DECISION_RISK = (
    r"(?iU)\b(?:shall|must|may\s+not|may|unless|provided\s+that|in\s+the\s+event|notwithstanding|subject\s+to|void|invalid|terminate|"
    r"termination|breach|indemnif|representation|warrant|condition|governing\s+law|jurisdiction|assignment|transfer|consent|notice|default)\b"
)

# Fixed values of normalising model output. Tabs are no odd spaces: they stand for a token.
ODD_SPACES = r"[\x{000b}\x{000c}\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}]"
HAN_GAP = r"(?U)(?<=[\x{4e00}-\x{9fff}])\s+(?=[\x{4e00}-\x{9fff}])"
ZH_SPACE_BEFORE, ZH_SPACE_AFTER = r"(?U)\s+([，。！？；：、）】》」』])", r"(?U)([（【《「『])\s+"
EN_SPACE_BEFORE, EN_SPACE_AFTER, EN_SPACE_BEFORE_CLOSE = r"(?U)\s+([,.;:!?])", r"(?U)([(\[{])\s+", r"(?U)\s+([)\]}])"
HAN_NUMERALS = "零一二三四五六七八九"
#: English words of a reference and its Chinese form.
REFERENCE_FORMS = (("Section", "第{}条"), ("Article", "第{}条"), ("Clause", "第{}款"), ("Paragraph", "第{}段"), ("Schedule", "附表{}"))
ZH_GENERIC_REFERENCES = ("本条款", "本条", "该条款", "该条", "本节", "该节")

# Fixed values of the older mask: references frozen whole, whatever their case.
LEGACY_ALTERNATIVES = (
    r"[A-Za-z0-9]{2,24}[®™℠]",
    OTHER_SCRIPTS + "+",
    FREEZE_ALTERNATIVES[2],
    FREEZE_ALTERNATIVES[3],
    FREEZE_ALTERNATIVES[4],
    FREEZE_ALTERNATIVES[5],
    r"%\d+",
    r"\b(?:Section|Article|Clause|Paragraph|Schedule)s?\s+(?:\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?(?:\([A-Za-z0-9]+\))*|[IVXLCDM]{1,8})\b",
    r"\b(?:Sec|Art|Cl|Para|Sch)s?\.\s+(?:\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?(?:\([A-Za-z0-9]+\))*|[IVXLCDM]{1,8})\b",
    r"第\s*\d+(?:\([A-Za-z0-9]+\))*\s*(?:条|款|项|段|章|节)\b",
    r"(?:附表|附件)\s*\d+(?:\([A-Za-z0-9]+\))*\b",
    r"\b\d+(?:\([A-Za-z0-9]+\))+",
    r"\(\d{1,3}\)",
    r"\((?:[ivxlcdmIVXLCDM]{1,6})\)",
    r"\([A-Za-z]\)",
    r"[.…]{8,}",
    r"_{5,}",
    r"[-‐‑‒–—―−]{5,}",
    r"\b[XYZ]\b",
)
