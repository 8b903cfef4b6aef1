import pytest
from pyspark.sql import functions as F

from textloom.functions import issues, language, normalize


def values(spark, column_of, texts, *more):
    """The column for every row of texts (and further string columns)."""
    names = ["c0", *[f"c{i + 1}" for i in range(len(more))]]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, *more)), "id int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("id").select(column_of(*[F.col(n) for n in names])).collect()]


def test_looks(spark):
    texts = ["the notice was sent", "Zug Bern", "Ordélan Vaxol Brik Tund", "", None, "one two three four"]
    assert values(spark, language.looks_english, texts) == [True, True, False, False, None, False]
    names = ["Westerby Trading Co. Ltd", "Norholm Ltd is a company", "WESTERBY POWER GMBH", "lower ltd", "", "Norholm and Sons Limited"]
    assert values(spark, language.looks_like_entity, names) == [True, False, True, False, False, True]


@pytest.mark.parametrize(
    "source, frozen, lang, reason",
    [("", "", "en", "empty"), (None, None, "en", "empty"), ("X", "<<MT_NT:0001>>", "en", "sentinel_only"), ("Жд", "Жд", "en", "other_script"), ("合同", "合同", "en", "already_zh"),
     ("12", "12", "en", "no_latin"), ("Ordélän Vaxél Brik Tund", "Ordélän Vaxél Brik Tund", "en", "non_english_latin"), ("a bond", "a bond", "zh", "already_en"), ("12", "12", "zh", "no_cjk"),
     ("a bond", "a bond", "en", "ok"), ("x", "x", "de", "ok")],
)
def test_decisions(spark, source, frozen, lang, reason):
    assert values(spark, language.translate_decision, [source], [frozen], [lang]) == [reason]


def test_pair_of_documents(spark):
    rows = [(1, i, "word/document.xml", "x#w:p@1", t) for i, t in enumerate(["The notice of the seller", "a bond is due", "it is the law", None])]
    rows += [(1, 9, "word/footer1.xml", "x#w:p@1", "合同" * 90), (2, 1, "p", "k", "合同终止通知书"), (3, 1, "p", "k", "Жд"), (4, 1, "p", "k", "")]
    df = spark.createDataFrame(rows, "doc int, n int, part_name string, scope_key string, source_surface string")
    got = {r["doc"]: r for r in language.detect_language_pair(df, "doc", ["n"]).collect()}
    assert (got[1]["src"], got[1]["decision"], got[1]["en_votes"]) == ("en", "en->zh", 3)
    assert [got[d]["decision"] for d in (2, 3, 4)] == ["zh->en(weak_vote)", None, "en->zh(weak_char)"]
    assert language.detect_language_pair(df.limit(0), "doc", ["n"]).count() == 0


def test_labels_and_previews(spark):
    assert values(spark, language.normalized_lang, [" EN_us", "zh-Hant", "de", None]) == ["en", "zh", None, None]
    assert values(spark, language.lang_label, [" zh_CN ", "English", " de ", None]) == ["Chinese", "English", "de", None]
    assert values(spark, lambda c: language.preview(c, 12), ["a\r\nb", "<<MT_NT:0001>> long text here", "", None]) == ["a\\r\\nb", "<MT_NT:00...", "", ""]
    assert values(spark, lambda c: language.shortened(c, 3), [" a  bc d", "ab", None]) == ["a b…", "ab", ""]
    assert values(spark, language.must_preserve, ["PV 12 <<MT_BR>> PV 3 ABCDEFGHIJK"]) == [["<<MT_BR>>", "12", "3", "PV"]]


ISSUES = [
    ("The bond is due.", None, "en", "zh", ["empty_output"]),
    ("The bond is due.", "保函到期​。", "en", "zh", ["zero_width_chars"]),
    ("The bond.", "保函" + "。" * 13, "en", "zh", ["repeated_char_run"]),
    ("The bond.", "[CONTEXT] 保函。", "en", "zh", ["prompt_artifact"]),
    ("The bond.", "保函Ж。", "en", "zh", ["unexpected_script"]),
    ("An event of Default.", "默认事件。", "en", "zh", ["it_default_sense"]),
    ("by default it is on. Default", "默认开启。", "en", "zh", []),
    ("As in Section 4.", "见第X条。", "en", "zh", ["bad_reference_placeholder"]),
    ("Party X pays.", "一方付款。", "en", "zh", ["variable_marker_missing"]),
    ("The bond is due now.", "The bond is due now.", "en", "zh", ["looks_untranslated", "source_echo"]),
    ("x" * 130, "短", "en", "zh", ["coverage_low", "too_short"]),
    ("The Bank pays the Norholm sum.", "保函由银行支付 the Norholm bank sum today 款项已经到期", "en", "zh", ["mixed_language"]),
    ("甲乙" * 25, "保函" * 80, "zh", "zh", ["over_expansion"]),
    ("The bond.", "如果适用，保函。", "en", "zh", ["unjustified_condition"]),
    ("If due, the bond.", "如果适用，保函。", "en", "zh", []),
    ("合同终止通知书应送达对方当事人", "1234567", "zh", "en", ["looks_untranslated"]),
    ("合" * 130, "The bond", "zh", "en", ["coverage_low", "too_short"]),
    ("合" * 100, "The bond of the seller is due. " * 2 + "word " * 30, "zh", "en", ["repeated_sentence"]),
]


@pytest.mark.parametrize("source, target, sl, tl, expected", ISSUES)
def test_issues(spark, source, target, sl, tl, expected):
    df = spark.createDataFrame([(source, target, sl, tl, 1)], "s string, t string, sl string, tl string, _o int")
    got = issues.quality_issues(df.drop("_o"), "s", None, "t", "sl", "tl").first()["issues"]
    assert [i for i in got if i not in ("untranslated_english", "english_skeleton")] == expected


def test_protocol_and_predicates(spark):
    cases = [("a\nb", "raw_newline"), ("a\tb", "raw_tab"), ("a <<MT_NT:0001>>", "control_tokens_mismatch"), ("<<MT_BR>> 7", "nt_mismatch"), ("<<MT_BR>><<MT_NT:0001>><<MT_NT:0001>> 7", "nt_count"),
             ("<<MT_BR>><<MT_NT:0001>><<MT_SEG:000001>> 7", "unexpected_sentinel"), ("<<MT_BR>><<MT_NT:0001>> 8", "number_mismatch"), ("<<MT_BR>><<MT_NT:0001>> <<MT_NT:0002>>", None), ("<<MT_BR>> <<MT_NT:0001>> 7", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    names = F.create_map(F.lit("<<MT_NT:0001>>"), F.lit("http://x"), F.lit("<<MT_NT:0002>>"), F.lit("7"))
    got = df.orderBy("id").select(issues.protocol_error(F.lit("http://x 7"), F.lit("<<MT_BR>><<MT_NT:0001>> <<MT_NT:0002>>"), names, F.col("t"))).collect()
    assert [r[0] for r in got] == [e for _, e in cases]
    row = spark.range(1).select(
        issues.hard_issues(F.array(F.lit("too_short"), F.lit("x"), F.lit("glossary_leakage:y"))).alias("h"),
        issues.wants_retranslation(F.array(F.lit("target_script_missing_han"))).alias("w"),
        issues.wants_retranslation(F.array(F.lit("missing_brackets_curly"))).alias("n"),
        issues.review_passes(F.lit(True), F.lit(4), F.lit(4), F.lit(3), (4, 4, 3)).alias("p"),
        issues.review_passes(F.lit(None).cast("boolean"), F.lit(4), F.lit(4), F.lit(3), (4, 4, 3)).alias("q"),
        issues.chosen_text(F.lit(" \n"), F.lit("draft")).alias("c"),
        issues.needs_review(F.array().cast("array<string>"), F.lit(None).cast("boolean"), F.lit("the seller shall pay"), F.lit(False), F.lit(None).cast("int"), F.lit(False), 400).alias("r"),
    ).first()
    assert list(row) == [["too_short", "glossary_leakage:y"], True, False, True, False, "draft", True]


def test_spellings_and_cleaning(spark):
    assert values(spark, normalize.decoded_sentinels, ["[[TAB]] 【NT:3】《 SEG:12 》[[NT:12345]] [[x]]", None]) == ["<<MT_TAB>> <<MT_NT:0003>><<MT_SEG:000012>>[[NT:12345]] [[x]]", ""]
    assert values(spark, normalize.exact_markers, ["<<MT_SEG: 7 >>a<<MT_END:007>>"]) == ["<<MT_SEG:000007>>a<<MT_END:000007>>"]
    cleaned = ['```json\n"x"\n```', " plain ", '"a" "b"', "```", None, "``` a\nb"]
    assert values(spark, normalize.cleaned_output, cleaned) == ["x", "plain", 'a" "b', "", "", "b"]
    assert values(spark, normalize.plain_output, [" 合 同　x  ", "合 同 书"]) == ["合同 x", "合同书"]


def brute_first(text, needle, by, n):
    return text.replace(needle, by, n) if needle else text


def test_tokens_balance_like_a_loop(spark):
    names = {"<<MT_NT:0001>>": "a\\Eb", "<<MT_NT:0002>>": "7", "<<MT_NT:0003>>": ""}
    frozen = "<<MT_NT:0001>> <<MT_NT:0002>><<MT_NT:0002>> <<MT_NT:0003>>"
    texts = ["a\\Eb 7 7 7", "<<MT_NT:0001>><<MT_NT:0001>> 7", "", None, "none", "a\\Eba\\Eb<<MT_NT:0002>>" * 3]
    expected = []
    for text in texts:
        out = text or ""
        for token, original in sorted(names.items()):
            wanted, held = frozen.count(token), out.count(token)
            out = brute_first(out, original, token, wanted - held) if held < wanted else brute_first(out, token, original, held - wanted) if held > wanted else out
        expected.append(out)
    back = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    assert values(spark, lambda c: normalize.balanced_tokens(F.lit(frozen), back, c), texts) == expected


def test_spaces_controls_scripts_and_references(spark):
    frozen = " a <<MT_BR>>b"
    assert values(spark, lambda c: normalize.edges_of_source(F.lit(frozen), c), ["x<<MT_TAB>> y ", "one part", " \nx<<MT_BR>>y", ""]) == [" x <<MT_BR>>y", "one part", " \nx<<MT_BR>>y", ""]
    zh = lambda f: (lambda c: f(F.lit("zh"), c))
    en = lambda f: (lambda c: f(F.lit("en"), c))
    assert values(spark, zh(normalize.inner_spaces), [" 合 同 ，（ x", "a<<MT_BR>> 合 同"]) == [" 合同，（x", "a<<MT_BR>> 合同"]
    assert values(spark, en(normalize.inner_spaces), ["a  b , c ( d )"]) == ["a b, c (d)"]
    assert values(spark, zh(normalize.space_flags), ["合 同 ，", "合同"]) == [["cjk_inner_space", "space_punct"], []]
    assert values(spark, en(normalize.space_flags), ["a  b ,"]) == [["multi_space", "space_punct"]]
    raw = ["a\r\nb\nc\td\te", "plain", None]
    assert values(spark, lambda c: normalize.repaired_controls(F.lit("<<MT_BR>><<MT_TAB>>"), c), raw) == ["a<<MT_BR>>b c<<MT_TAB>>d e", "plain", ""]
    assert values(spark, lambda c: normalize.expected_scripts(F.lit("Ж"), F.lit("zh"), c), ["Жд合<<MT_BR>>カ", "x"]) == ["Ж合<<MT_BR>>", "x"]
    assert values(spark, lambda c: normalize.filled_references(F.lit("Section 4"), F.lit("zh"), c), ["第X条与第 条", "x"]) == ["第4条与第4条", "x"]
    assert values(spark, lambda c: normalize.filled_references(F.lit("4 and 5"), F.lit("zh"), c), ["第X条"]) == ["第X条"]
    assert values(spark, lambda c: normalize.only_allowed_sentinels(c, F.array(F.lit("<<MT_BR>>"))), ["a<<MT_BR>>b<<MT_TAB>>c"]) == ["a<<MT_BR>>bc"]
    assert values(spark, lambda c: normalize.without_prompt_artifacts(F.lit("a"), c), ["Glossary: 合同  x", "合同  x"]) == ["合同 x", "合同  x"]


@pytest.mark.parametrize(
    "source, names, text, expected",
    [("Pay 5", {}, "付5和6", "付5和"), ("Pay", {}, "付5", "付"), ("Section 12", {}, "第十二条", "第12条"), ("2002 Act", {}, "法案", "2002年法案"), ("Clause 7 holds", {}, "本条款有效", "第7款有效"),
     ("Pay 5", {"<<MT_NT:0001>>": "5"}, "付<<MT_NT:0001>>5", "付<<MT_NT:0001>>"), ("Pay 5", {}, None, ""), ("Schedule 3", {}, "该条", "附表3")],
)
def test_numbers_of_the_source(source, names, text, expected):
    assert normalize.kept_numbers(source, names, text, "zh") == expected


@pytest.mark.parametrize("n, text", [(0, "零"), (7, "七"), (10, "十"), (15, "十五"), (20, "二十"), (105, "一百零五"), (110, "一百一十"), (1005, "一千零五"), (1050, "一千零五十"), (9999, "九千九百九十九")])
def test_numerals(n, text):
    assert normalize.chinese_numeral(n) == text


def test_whole_normalising(spark):
    rows = [("Section 4 applies.\nX", "<<MT_NT:0001>> applies.<<MT_BR>>X", {"<<MT_NT:0001>>": "Section 4"}, " Section 4 适 用 。\nX<<MT_TAB>> ", "zh"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, f string, m map<string,string>, r string, tl string")
    got = [tuple(r) for r in normalize.normalized_candidate(df, "s", "f", "m", "r", "tl").select("candidate", "space_flags").collect()]
    assert got == [("<<MT_NT:0001>> 适用。<<MT_BR>>X", ["space_punct"]), ("", [])]
