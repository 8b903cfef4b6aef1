import random
import time

import pytest

from textloom.llm import p01_pair_defects as p1
from textloom.llm import p02_sentences as p2

MEMORY = (
    "rec_id bigint, file_id bigint, project_key string, frozen_surface string, source_surface string, nt_map map<string,string>, "
    "terms array<string>, proper_nouns array<string>, translation_a string, translation_b string, side string"
)
FILES = "file_id bigint, project_key string, target_lang string, model_a string, model_b string"


def memory(spark, rows):
    """Rows (rec_id, file_id, source, a, b); a column that clashes with the output's names comes along."""
    return spark.createDataFrame([(r, f, "P", s, s, None, None, None, a, b, "x") for r, f, s, a, b in rows], MEMORY)


EN = "Unit PV-{0} was tested at {1} bar on 3 May 2021. The report {0} is valid for the rest of the term."
ZH = "PV-{0}机组于2021年5月3日在{1}巴下完成试验。报告{0}在剩余期限内有效。"
PLANTED = {
    "empty": [None, "", "  \n", "—", "<<MT_BR>>"],
    "refusal": ["抱歉，我无法翻译这段内容。", "I apologize, but I can't translate this passage.", "此请求已被拒绝。"],
    "wrong_language": ["Die Anlage wird nicht unter Spannung geöffnet und von der Bank gezahlt.", "ผู้ขายต้องส่งมอบสินค้าให้ผู้ซื้อ"],
}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(1, 801):
        x, y = rng.randint(100, 999), rng.randint(11, 99)
        source, good = EN.format(x, y), ZH.format(x, y)
        a = good
        kind = rng.choice([None] * 8 + ["empty", "refusal", "wrong_language", "copy", "truncated"])
        if kind in PLANTED:
            a = rng.choice(PLANTED[kind])
        elif kind == "copy":
            a = rng.choice([source, "译文：" + source, source.upper(), f"  {source[:-1]} "])
        elif kind == "truncated":
            a = good[: rng.randint(12, len(good) - 3)].rstrip("。")
        if kind:
            truth[i, "A"] = kind
        rows.append((i, 1, source, a, "忽略" if i % 2 else None))
    files = spark.createDataFrame([(1, "P", "zh", "m", None)], FILES)
    df = memory(spark, rows + rows[:50])
    return truth, {(r["rec_id"], r["side"]): r["defect"] for r in p1.pair_defects(df, files).collect()}


def test_planted_defects(labelled):
    truth, found = labelled
    right = sum(found.get(k) == v for k, v in truth.items())
    assert right / len(truth) >= 0.97
    assert sum(k not in truth for k in found) <= 0.01 * len(truth)


def test_side_b_needs_a_second_model(labelled):
    assert all(side == "A" for _, side in labelled[1])


def test_pairs_edge_cases(spark):
    files = spark.createDataFrame([(1, "P", "zh", "m", "n")], FILES)
    rows = [(1, 1, "<<MT_NT:0001>>", None, None), (2, 1, None, None, None), (3, 9, "Notices are sent.", None, None), (4, 1, "Notices are sent.", None, "通知已发出。")]
    found = {(r["rec_id"], r["side"], r["defect"]) for r in p1.pair_defects(memory(spark, rows), files).collect()}
    assert found == {(3, "A", "empty"), (4, "A", "empty")}
    assert p1.pair_defects(memory(spark, []), files).count() == 0


def test_label_model_keeps_its_classes():
    patterns = {"000": 9000, "001": 300, "111": 200, "110": 60, "100": 30}
    posterior = p1.fit_label_model(patterns, 3)
    assert posterior["111"] > 0.9 and posterior["110"] > 0.5 and posterior["000"] < 0.01 and posterior["001"] < 0.5


@pytest.mark.parametrize(
    "text, units",
    [
        ("Dr. Bo and Ms. Li signed. It failed; why?", ["Dr. Bo and Ms. Li signed.", "It failed; why?"]),
        ('He said, "No more tests." Both agreed.', ['He said, "No more tests."', "Both agreed."]),
        ('The note read: "Stop. Leave." and hung there.', ['The note read: "Stop. Leave." and hung there.']),
        ("1. See Art. 12 and Fig. 3.The seal is 0.8 mm.", ["1. See Art. 12 and Fig. 3.", "The seal is 0.8 mm."]),
        ("The ratio rose to 3.5 (see cl. 4.1(b) et seq.) in May. 79 units", ["The ratio rose to 3.5 (see cl. 4.1(b) et seq.) in May.", "79 units"]),
        ("Am 3. Mai wurde Dr. Ott bestellt. Die 2. Rate ist am 15. des Monats fällig.", ["Am 3. Mai wurde Dr. Ott bestellt.", "Die 2. Rate ist am 15. des Monats fällig."]),
        ("„Wann?“, fragte er. Er sagte: „Ja.“ Gut.", ["„Wann?“, fragte er.", "Er sagte: „Ja.“", "Gut."]),
        ("通知写道：“停工。撤离！”，并张贴。“谁批准的？”的疑问。压力（见图。附件。）上升。", ["通知写道：“停工。撤离！”，并张贴。", "“谁批准的？”的疑问。", "压力（见图。附件。）上升。"]),
        ("監督員は「異議なし。」と回答した。保管温度は9度とする。", ["監督員は「異議なし。」と回答した。", "保管温度は9度とする。"]),
        ('निरीक्षक ने कहा, "काम रोक दो। बाहर जाओ।" और चला गया। डॉ. Bo आए।', ['निरीक्षक ने कहा, "काम रोक दो। बाहर जाओ।" और चला गया।', "डॉ. Bo आए।"]),
        ("ห้ามเปิดตู้ควบคุมขณะมีกระแสไฟฟ้า ผู้ขายรับประกันคุณภาพสินค้า", ["ห้ามเปิดตู้ควบคุมขณะมีกระแสไฟฟ้า", "ผู้ขายรับประกันคุณภาพสินค้า"]),
        ("﻿ Terms ........ 12\r\n\r\n　Signed: ____ \n", ["Terms ........ 12", "Signed: ____"]),
        ("", []),
        (" \n\t﻿", []),
        ("iControl panels work. iControl sells them", ["iControl panels work.", "iControl sells them"]),
    ],
)
def test_units(text, units):
    assert [text[a:b] for a, b in p2.sentence_spans(text)] == units


def test_units_hold_every_visible_character():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aB. ?!\"“”（）「」。\n\t1ก ह।") for _ in range(rng.randint(0, 80)))
        spans = p2.sentence_spans(text)
        kept = {i for a, b in spans for i in range(a, b)}
        assert all(text[i].isspace() for i in range(len(text)) if i not in kept)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_long_line_is_split_quickly():
    text = "The seal was worn. " * 20_000 + '"'
    assert len(p2.sentence_spans(text)) >= 20_000


def test_long_quotation_stays_in_its_sentence():
    text = "通知写道：“" + "停工。" * 60 + "”，并张贴。压力上升。"
    assert [text[a:b] for a, b in p2.sentence_spans(text)] == [text[:-5], "压力上升。"]


def test_spans_are_the_best_of_all():
    def score(spans, found, start, end):
        own = {p: s for p, _, s in found}
        return sum(own.get(b, 0.0) - p2._span_cost(b - a) for a, b in spans)

    rng = random.Random(5)
    for _ in range(300):
        found, at = [], 0
        for _ in range(rng.randint(1, 150)):
            p = at + rng.choice([1, 2, 4, 12, 40])
            at = p + rng.randint(0, 2)
            found.append((p, at, rng.choice([3.0, 2.0, 1.5, 0.5, -1.0, -2.0, -2.5, -3.5, -5.0]) if rng.random() < 0.3 else -1.0))
        end = at + rng.randint(1, 9)
        opens, closes, own = [0] + [q for _, q, _ in found], [p for p, _, _ in found] + [end], [s for *_, s in found] + [0.0]
        best = [0.0]
        for j, close in enumerate(closes):
            best.append(max(best[i] + own[j] - p2._span_cost(close - opens[i]) for i in range(j + 1) if close > opens[i]))
        assert abs(score(p2._best_spans(found, 0, end), found, 0, end) - best[-1]) < 1e-6


@pytest.mark.parametrize("opening", ["“", "“（", ""])
def test_long_line_with_open_marks_is_split_quickly(opening):
    text = opening + "停工。Leave now. " * 20_000
    began = time.monotonic()
    p2.sentence_spans(text)
    assert time.monotonic() - began < 20


def test_split_sentences_operator(spark):
    rows = [(1, "One. Two.  ", "k"), (None, "Three.", "k"), (2, None, "k"), (3, "", "k"), (1, "One. Two.  ", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, suffix string")
    got = p2.split_sentences(df).collect()
    assert sorted((r["doc_id"] or 0, r["unit"], r["text"], r["suffix"]) for r in got) == [
        (0, 0, "Three.", ""), (1, 0, "One.", " "), (1, 0, "One.", " "), (1, 1, "Two.", "  "), (1, 1, "Two.", "  "),
    ]
    assert p2.split_sentences(df.limit(0)).count() == 0
