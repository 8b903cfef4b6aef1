import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import masking, text, validate

FREEZE_CASES = [
    ("see https://a.example/x and a@b.example", "see <<MT_NT:0001>> and <<MT_NT:0002>>"),
    ("12 and 12", "<<MT_NT:0001>> and <<MT_NT:0001>>"),
    ("4.1(b) here", "<<MT_NT:0001>><<MT_NT:0002>> here"),
    ("1-2.3", "<<MT_NT:0001>>.<<MT_NT:0002>>"),
    ("7(a)x", "<<MT_NT:0001>>x"),
    ("I am IV, MIX and (i) (12) (b)", "<<MT_NT:0001>> am <<MT_NT:0002>>, <<MT_NT:0003>> and <<MT_NT:0004>> <<MT_NT:0005>> <<MT_NT:0006>>"),
    ("........ _____ ----- 09:30 X", "<<MT_NT:0001>> <<MT_NT:0002>> <<MT_NT:0003>> <<MT_NT:0004>> <<MT_NT:0005>>"),
    ("<<MT_TAB>> Foo® Договор {x} %1", "<<MT_TAB>> <<MT_NT:0001>> <<MT_NT:0002>> <<MT_NT:0003>> <<MT_NT:0004>>"),
    ("", ""),
    ("第12条", "第12条"),
]


@pytest.mark.parametrize("source, frozen", FREEZE_CASES)
def test_freeze_cases(source, frozen):
    assert masking.freeze_text(source)[0] == frozen


def test_freeze_and_back(spark):
    rng = random.Random(1)
    pieces = ["Section 4.1(b)", " 12", "第3条", "<<MT_BR>>", "a@b.example", " I ", "合同 ", "\u0001", "........", "Ω", "€5 "]
    texts = [c[0] for c in FREEZE_CASES] + ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(80)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = masking.frozen(df, "text").withColumn("back", masking.unfreeze(F.col("frozen"), F.map_from_entries("nt"))).collect()
    for r in rows:
        assert r["back"] == r["text"]
        for s in r["spans"] or []:
            assert r["text"].encode()[s["src_start"] : s["src_end"]].decode() == s["original"]


def test_unfreeze_keeps_what_it_does_not_know(spark):
    row = spark.createDataFrame([("<<MT_NT:0001>><<MT_NT:0002>>", {"<<MT_NT:0001>>": "<<MT_NT:0002>>"})], "t string, m map<string,string>")
    assert row.select(masking.unfreeze(F.col("t"), F.col("m")).alias("x")).first()["x"] == "<<MT_NT:0002>><<MT_NT:0002>>"


VALIDATE_CASES = [
    ("a 1", {}, " 　", "empty_output"),
    ("a", {}, "b <<MT_X:1>>", "unexpected_mt_token"),
    ("a<<MT_BR>>b<<MT_TAB>>c", {}, "a<<MT_TAB>>b<<MT_BR>>c", "sentinel_sequence_mismatch"),
    ("a<<MT_BR>><<MT_BR>>b", {}, "a<<MT_BR>>x<<MT_BR>>b", "control_token_layout_mismatch"),
    ("a<<MT_NT:0001>>", {"<<MT_NT:0001>>": "12"}, "b", "nt_token_count_mismatch"),
    ("a<<MT_NT:0001>><<MT_BR>>b", {"<<MT_NT:0001>>": "x"}, "a<<MT_BR>>b<<MT_NT:0001>>", "nt_token_control_block_mismatch"),
    ("12 and 13", {}, "13 und 14", "digits_mismatch"),
    ("see Section 4.1", {}, "siehe 4-1", "legal_ref_id_mismatch"),
    ("IV is 4.1", {}, "4.1 ist V", "compound_legal_id_mismatch"),
    ("a <<MT_NT:0001>> of 4.1", {"<<MT_NT:0001>>": "12"}, "4.1 von <<MT_NT:0001>>", None),
    (None, None, None, "empty_output"),
]


def test_validation_order(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(VALIDATE_CASES)], "i int, s string, m map<string,string>, t string")
    got = {r["i"]: r["error"] for r in validate.validated(df, "s", "m", "t").collect()}
    assert [got[i] for i in range(len(VALIDATE_CASES))] == [c[3] for c in VALIDATE_CASES]


def test_quality_flags(spark):
    long = "x" * 40
    cases = [
        (long, "x" * 9, "len_ratio_too_short_extreme", ""), (long, "x" * 13, "", "len_ratio_too_short"), (long, "x" * 161, "len_ratio_too_long_extreme", ""),
        ("a" * 24, "A" * 24, "output_identical_to_source", ""), ("a" * 23, "A" * 23, "", ""), ("a", "b…", "contains_ellipsis_placeholder", ""),
        ("a", "b" + "…" * 8, "", ""), ("a...", "b...", "", ""), ("(a)", "（b）", "", ""), ("(a)", "b", "missing_brackets_parens", ""), ("[a] [b]", "[b]", "", "bracket_count_mismatch"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1], "x", "x") for i, c in enumerate(cases)], "i int, s string, t string, sl string, tl string")
    got = {r["i"]: (",".join(r["hard_flags"]), ",".join(r["soft_flags"])) for r in validate.quality_flags(df, "s", None, "t", "sl", "tl").collect()}
    assert [got[i] for i in range(len(cases))] == [c[2:] for c in cases]


@pytest.mark.parametrize("pattern, name, fits", [("word/*.xml", "word/a.xml", True), ("*", "x", True), ("a.b", "axb", False), ("a*c", "abd", False)])
def test_wildcard(pattern, name, fits):
    own = re.compile(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), text.wildcard(pattern)))
    assert bool(own.match(name)) is fits


def test_small_forms(spark):
    df = spark.createDataFrame([("..\\..\\media\\a/b.png", "x#w:p@3", "A<<MT_BR>>B")], "t string, k string, c string")
    row = df.select(text.part_target(F.col("t")), text.scope_type(F.col("k")), text.control_parts(F.col("c")), text.is_trivial(F.lit("<<MT_NT:0001>> 12"))).first()
    assert tuple(row) == ("word/media/a/b.png", "w:p", ["A", "<<MT_BR>>", "B"], True)
