"""Problem 1: source and translation pairs that are broken, each with its defect type.

Method: noisy labelling functions vote for, against or not at all on every defect of every side; for each defect an
expectation-maximization label model over the exact counts of vote patterns learns how reliable each function is and
gives every pattern a posterior. Labels whose posterior exceeds the defect's cutoff are kept, several if need be.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage, spread

#: The defects, the more telling ones first: where only one may stand, it is the first of the kept ones.
DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
#: Posterior cutoffs, validated on two planted sets, one held out, over 0.05 to 0.95 (tests/llm/test_p01.py).
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "wrong_language": 0.5, "truncated": 0.5}
#: Functions per defect; a defect's patterns number at most 3 to this power, which bounds what reaches the driver.
FUNCTIONS = {"empty": 3, "refusal": 4, "copy": 4, "wrong_language": 3, "truncated": 4}

TOKEN = re.compile(r"<<MT_[^<>]*>>")
NOT_ALNUM = re.compile(r"[\W_]+")
NUMBER = re.compile(r"\d{2,}")
SENTENCE_END = re.compile(r"[。！？।]|(?<!\d)[.!?](?=[\s\"'”’)\]]|$)|\d[.!?](?=[\"'”’)\]]*\s*$)")
FULL_END = re.compile(r"[.!?。！？।][\"'”’“»)）」』\]】]*\s*$")
BROKEN_END = re.compile(r"(?:[,，、;；:：(（“„「…-]|\.\.\.|\b(?:and|or|the|of|to|in|for|by|with|a|an|at|on|und|der|die|das))\s*$")
PAIRED = (("(", ")"), ("（", "）"), ("“", "”"), ("「", "」"), ("[", "]"))

# Ways to decline, in several languages; then words of talk about a text rather than of a text.
DECLINES = re.compile(
    r"\bI(?:'m| am)(?: very| so)? (?:sorry|afraid|unable|not able)\b|\bI apologi[sz]e\b|\bI (?:can't|cannot|can not|won't|will not|must decline|regret that I)\b"
    r"|^\W*(?:sorry|unfortunately|apologies)\b[,;]? (?:but )?(?:I|it is not|this|we cannot|no)\b|\bas an? (?:AI|language|machine)\b[\w ]* (?:assistant|model)\b"
    r"|\bthank you for the text\b|\bthis request (?:falls outside|has been|cannot|is)\b|\bagainst my (?:instructions|guidelines|policy)\b|\bmy guidelines\b"
    r"|\bconsult a (?:qualified|professional) translator\b|\bno translation can be\b|\b(?:withheld|blocked|removed) under the content policy\b"
    r"|\bit is not possible for me\b|\blet us talk about something else\b|\btranslation (?:is )?(?:declined|refused|not available)\b"
    r"|抱歉|对不起|非常遗憾，|感谢您的信任|作为一?个?(?:语言|人工智能|AI)(?:助手|模型)|恕我|恕难|我(?:无法|不能|不便|没有办法|难以)(?:翻译|提供|处理|完成|协助|满足)"
    r"|超出了我的|请求已被拒绝|不予翻译|建议您咨询|换个话题|无法提供(?:该|此|这)?(?:段落|文本|内容)?的?(?:译文|翻译)|请提供其他文本"
    r"|申し訳(?:ありません|ございません)|翻訳(?:でき|いたしかね|をお断り)|お手伝いでき|お応えでき"
    r"|\bes tut mir leid\b|\bleider kann ich\b|\bich kann (?:diesen|das|dabei|leider)\b[^.]*\bnicht\b|\bnicht übersetzen\b"
    r"|\bje suis désolée?\b|\bje ne peux pas\b|\blo siento\b|\bno puedo (?:traducir|ayudar)\b"
    r"|ขออภัย|ไม่สามารถ(?:แปล|ช่วย|ให้)|क्षमा करें|माफ़ कीजिए|अनुवाद नहीं कर|सहायता नहीं कर",
    re.IGNORECASE,
)
TALK = re.compile(
    r"\b(?:translat\w*|passage|paragraph|request|guidelines?|policy|assistant|assist|help|content|confidential|task|text|instructions)\b"
    r"|翻译|译文|译员|请求|请提供|内容|规范|政策|机密|助手|协助|文本|任务|话题|段落|翻訳|übersetz|traduc|แปล|अनुवाद",
    re.IGNORECASE,
)
FUNCTION_WORDS = {
    "en": "the of and to in is for by that with on be at or any not has from may shall which are it as was under",
    "de": "der die das und ist wird nicht bei von mit für zu den dem im am auf über des ein eine werden haftet darf zur zum",
    "fr": "le la les des et est une dans pour que qui sur par au aux du ne pas ce cette",
    "es": "el los las una del que por con para se al lo su como más esta este",
    "it": "il di che della per una con del sono non le gli alla dei nel",
    "pt": "os da do em um uma não com para ao dos das pelo pela",
    "nl": "de het een van en niet met voor door aan bij wordt zijn",
}
WORD_LANGUAGE: dict[str, set[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        WORD_LANGUAGE.setdefault(_word, set()).add(_language)
LATIN_RUN = re.compile(r"(?<![A-Za-zÀ-ɏ0-9-])[a-zß-öø-ɏ][a-zß-öø-ɏ'’]*(?![A-Za-zÀ-ɏ0-9])")
#: Scripts other than Latin, by the ranges that give their letters away.
SCRIPTS = {
    "zh": re.compile("[㐀-鿿豈-﫿]"),
    "ja": re.compile("[ぁ-ゖァ-ヺ]"),
    "ko": re.compile("[가-힣]"),
    "th": re.compile("[ก-๎]"),
    "hi": re.compile("[ऀ-ॣ]"),
    "ru": re.compile("[Ѐ-ӿ]"),
    "ar": re.compile("[ء-ي]"),
}
GERMAN = re.compile("[äöüß]")
NOT_LATIN = re.compile("[\u0400-\uffff]")


def languages(text: str) -> tuple[str, str, str]:
    """Three opinions on the language of running text: by the script of most letters, by letters that give another
    script away, by function words. ``none`` where there is nothing to go by. Names and codes are no running text."""
    words = LATIN_RUN.findall(text)
    latin = sum(map(len, words))
    counts = {k: len(p.findall(text)) for k, p in SCRIPTS.items()} if NOT_LATIN.search(text) else {}
    hits: dict[str, int] = {}
    for w in words:
        for lang in WORD_LANGUAGE.get(w, ()):
            hits[lang] = hits.get(lang, 0) + 1
    by_words = max(hits, key=lambda k: (hits[k], k == "en")) if hits else "none"
    han, kana = counts.get("zh", 0), counts.get("ja", 0)
    others = {k: n for k, n in counts.items() if k not in ("zh", "ja") and n}
    top = max(others, key=lambda k: others[k]) if others else None
    total = latin + 3 * (han + kana) + sum(others.values())
    if total < 4:
        by_script = "none"
    elif top and others[top] >= 0.3 * total:
        by_script = top
    elif kana and kana >= 0.08 * (han + kana) and 3 * (han + kana) >= 0.5 * total:
        by_script = "ja"
    elif 3 * han >= 0.5 * total:
        by_script = "zh"
    else:
        by_script = by_words if by_words != "none" and (hits[by_words] > 1 or by_words == "en") else "latin"
    foreign = top if top and others[top] >= 0.2 * total else "ja" if kana >= 3 and kana >= 0.08 * (han + kana) else "none"
    if foreign == "none" and han >= 4 and 3 * han >= 0.5 * total and not kana:
        foreign = "zh"
    if foreign == "none" and hits.get("en", 0) < 2 and any(GERMAN.search(w) for w in words):
        foreign = "de"
        by_script = "de" if by_script in ("none", "latin", "de") else by_script
    return by_script, foreign, by_words if hits and hits[by_words] >= 2 else "none"


def _plain(text: str) -> str:
    return NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


def _grams(text: str, n: int = 8) -> set[str]:
    return {text[i : i + n] for i in range(0, len(text) - n + 1)}


def side_votes(source: str, plain: str, numbers: set[str], sentences: bool, text: str | None) -> tuple[list[str], list[str], float]:
    """Votes of the functions on one side (``1`` for, ``0`` against, ``-`` none), a string per defect, without those
    that need the target language; the three opinions on its language; and its length against the source's."""
    raw = text or ""
    body = TOKEN.sub(" ", raw)
    own = _plain(body)
    ratio = len(own) / max(1, len(plain))
    empty = ("1" if not raw.strip() else "0") + ("1" if not own else "0") + ("1" if ratio < 0.02 else "0")
    if not own:
        return [empty, "----", "---", "---"], ["none"] * 3, 0.0
    declines = DECLINES.search(body)
    talk = TALK.search(body)
    have = set(NUMBER.findall(body))
    shared = len(numbers & have) / len(numbers) if numbers else None
    refusal = (
        ("1" if declines else "0")
        + ("-" if shared is None else "1" if shared == 0 else "0")
        + ("1" if talk and len(own) < 160 else "0")
        + ("-" if 0.5 < ratio < 2 else "1" if len(own) < 160 else "0")
    )
    extra = len(own) - len(plain)
    same = own == plain
    inside = same or (0 <= extra <= 24 and (own.endswith(plain) or own.startswith(plain)))
    close = inside
    if not inside and len(plain) >= 40 and 0.9 <= ratio <= 1.3:
        grams = _grams(plain)
        close = len(grams & _grams(own)) >= 0.9 * len(grams)
    copy = ("1" if same else "-" if inside else "0") + ("1" if inside else "0") + ("1" if close else "0")
    full = FULL_END.search(body)
    opened = any(body.count(a) > body.count(b) for a, b in PAIRED)
    broken = BROKEN_END.search(body)
    truncated = (
        ("-" if not sentences else "0" if full else "1")
        + ("1" if broken and not full else "-")
        + ("1" if opened and not full else "-")
    )
    return [empty, refusal, copy, truncated], list(languages(body)), ratio


VOTE_SCHEMA = (
    "rec_id bigint, file_id bigint, side string, v_empty string, v_refusal string, v_copy string, v_truncated string, "
    "by_script string, by_letters string, by_words string, src_script string, ratio double"
)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in VOTE_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64()] + [pa.string()] * 9 + [pa.float64()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for rec, file, frozen, surface, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if not re.search(r"[^\W\d_]", TOKEN.sub(" ", frozen or "")):
                continue
            source = TOKEN.sub(" ", surface if surface is not None else frozen)
            plain = _plain(source)
            numbers = set(NUMBER.findall(source))
            sentences = bool(SENTENCE_END.search(source))
            script = languages(source)[0]
            for side, text in (("A", a), ("B", b)):
                votes, langs, ratio = side_votes(source, plain, numbers, sentences, text)
                for col, value in zip(cols, (rec, file, side, *votes, *langs, script, ratio)):
                    col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def fit_label_model(patterns: dict[str, int], functions: int, rounds: int = 60, trust: float = 0.05) -> dict[str, float]:
    """Posterior of the defect for every vote pattern, by MAP expectation-maximization over pattern counts.

    The model: a prior for the defect and, for each function, how often it votes for the defect where it is present
    and where it is absent; no vote says nothing. Pseudo-counts, a share ``trust`` of all rows and 20 at least, say
    that functions are right more often than not. They keep the classes from drifting to some other grouping, such
    as short and long texts, and weigh the same at every size of the data.
    """
    total = sum(patterns.values())
    strength = max(20.0, trust * total)
    believed = {True: 0.9, False: 0.03}
    given = {y: [believed[y]] * functions for y in (True, False)}
    prior = 0.02
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = log(prior) - log(1 - prior)
            for k, v in enumerate(p):
                if v == "1":
                    odds += log(given[True][k]) - log(given[False][k])
                elif v == "0":
                    odds += log(1 - given[True][k]) - log(1 - given[False][k])
            posterior[p] = 1 / (1 + exp(-max(-60.0, min(60.0, odds))))
        mass = sum(posterior[p] * n for p, n in patterns.items())
        prior = min(0.5, max(1e-6, (mass + 0.5) / (total + 10)))
        for y in (True, False):
            for k in range(functions):
                weight = {v: sum(n * (posterior[p] if y else 1 - posterior[p]) for p, n in patterns.items() if p[k] == v) for v in "01"}
                given[y][k] = (weight["1"] + strength * believed[y]) / (weight["1"] + weight["0"] + strength)
    return posterior


def pair_labels(memory: DataFrame, files: DataFrame) -> DataFrame:
    """(rec_id, side, defect, posterior): every label whose posterior exceeds its cutoff; a side may have several.

    Side B counts only where the file has a ``model_b``; a record whose ``frozen_surface`` is null or has no letter
    outside tokens has no labels. A null text is empty. A row repeated under one rec_id counts once; a record whose
    file is unknown is judged with its language unknown, its side B left out; empty tables give no rows; other
    columns are not read. Texts stay in the scan: only votes, some 80 bytes a side, are shuffled.
    """
    rows = spread(memory.select("rec_id", "file_id", "frozen_surface", "source_surface", "translation_a", "translation_b"))
    votes = rows.mapInArrow(_votes, VOTE_SCHEMA).dropDuplicates(["rec_id", "side"])
    target = F.lower(F.substring(F.coalesce("target_lang", F.lit("none")), 1, 2))
    sides = (
        votes.join(files.select("file_id", "target_lang", "model_b"), "file_id", "left")
        .where((F.col("side") == "A") | F.col("model_b").isNotNull())
        .withColumn("target", F.when(target == "jp", "ja").otherwise(target))
    )
    unknown = F.col("target") == "no"

    def differs(column: str):
        c = F.col(column)
        return F.when(unknown | (c == "none") | (c == "latin"), "-").when(c == F.col("target"), "0").otherwise("1")

    latin = F.col("target").isin("en", "de", "fr", "es", "it", "pt", "nl")
    script = F.when(F.col("by_script") == "latin", F.when(unknown, "-").otherwise(F.when(latin, "-").otherwise("1"))).otherwise(
        differs("by_script")
    )
    sides = cut_lineage(
        sides.withColumns(
            {
                "v_wrong_language": F.concat(script, differs("by_letters"), differs("by_words")),
                "v_copy": F.concat("v_copy", F.when(F.substring("v_copy", 1, 1) == "-", "-").otherwise(
                    F.when(F.col("by_script").isin("none", "latin"), "-").when(F.col("by_script") == F.col("src_script"), "1").otherwise("0"))),
            }
        )
    )
    typical = sides.where("ratio > 0").groupBy("target").agg(F.percentile_approx("ratio", 0.5, 1000).alias("typical"))
    # One row per target language, of which there are few; languages are cut to two letters above.
    sides = sides.join(F.broadcast(typical), "target", "left").withColumn(
        "v_truncated",
        F.concat("v_truncated", F.when(F.col("ratio") < 0.75 * F.col("typical"), "1").otherwise("-")),
    )
    long = sides.select(
        "rec_id", "side", F.explode(F.create_map(*[x for d in DEFECTS for x in (F.lit(d), F.col(f"v_{d}"))])).alias("defect", "pattern")
    )
    counts: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for row in long.groupBy("defect", "pattern").count().collect():  # at most the sum of 3 ** FUNCTIONS rows
        pattern = row["pattern"]
        counts[row["defect"]][pattern] = row["count"]
    kept = [
        (d, p, float(q))
        for d in DEFECTS
        for p, q in fit_label_model({p: n for p, n in counts[d].items() if set(p) != {"-"}}, FUNCTIONS[d]).items()
        if q > CUTOFFS[d]
    ]
    posteriors = memory.sparkSession.createDataFrame(kept, "defect string, pattern string, posterior double")
    return long.join(F.broadcast(posteriors), ["defect", "pattern"]).select("rec_id", "side", "defect", "posterior")


def pair_defects(memory: DataFrame, files: DataFrame) -> DataFrame:
    """(rec_id, side, defect): the first of each side's labels in the order of ``DEFECTS``."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return (
        pair_labels(memory, files)
        .groupBy("rec_id", "side")
        .agg(F.min_by("defect", order).alias("defect"))
    )
