import random
from collections import Counter

from textloom.llm import p03_consistent_form as p3
from textloom.llm import p04_split_oversized as p4
from textloom.llm import p05_alignment as p5
from textloom.llm import p06_format_duplicates as p6

LOOKS = ["Ｓｅｃtion ｔwo", "Sectiоn two", "Section two", "Sec​tion two", "Section two", "Ordélan", "Ordélan", "⽉光", "月光", "", None]


def test_forms_equal_the_specification(spark):
    rng = random.Random(1)
    letters = "aȩ́о⁠Ａ１  ，,é⽉月क़İß한"
    letters += "ｶﾞ゙（；：\u0344\u0301\u200b"
    texts = LOOKS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["é" * 3000 + "​"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, text string, target string")
    got = {r["id"]: r["form"] for r in p3.consistent_form(df, "text", "form").collect()}
    assert len(got) == len(texts)
    assert all(got[i] == (None if t is None else p3.canonical(t)) for i, t in enumerate(texts))


def test_what_looks_the_same_is_one_and_what_does_not_stays():
    assert len({p3.canonical(t) for t in LOOKS[:5]}) == 1
    assert p3.canonical("é") == "é" != p3.canonical("e") and p3.canonical("A") != p3.canonical("a") and p3.canonical("，") == "," and p3.canonical("（ａ；") == "(a;"
    assert p3.canonical("q̣̇") == p3.canonical("q̣̇")


def test_look_alike_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    bases = ["Termination", "Price and pay", "合同终止", "Ordélan"]
    spell = [lambda t: t, lambda t: t.replace("a", "а"), lambda t: t + "​", lambda t: t.replace("终", "⁠终"), lambda t: t.replace("é", "é")]
    rows = [(i, rng.choice(spell)(rng.choice(bases))) for i in range(1, 121)] + [(500, None), (501, ""), (502, "​")]
    df = spark.createDataFrame(rows + rows[:10], "rec_id bigint, source_surface string")
    got = {tuple(r) for r in p3.look_alike_records(df).collect()}
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and x != y and p3.canonical(x) == p3.canonical(y)]
    assert got == set(pairs)
    assert p3.look_alike_records(df.limit(0)).count() == 0


def test_look_alike_terms(spark):
    glossary = spark.createDataFrame([(1, "Party", "当事人", "n"), (2, "Bond", None, None)], "term_id bigint, src string, tgt string, note string")
    rows = [(1, ["Pаrty", "x", None, " "]), (2, ["Party"]), (3, None), (4, ["当​事人", "Bond"]), (4, ["当​事人", "Bond"]), (5, ["party"])]
    df = spark.createDataFrame(rows, "rec_id bigint, terms array<string>")
    assert sorted(map(tuple, p3.look_alike_terms(df, glossary).collect())) == [(1, 1), (4, 1)]


def test_pieces_cover_overlap_and_keep_tokens():
    rng = random.Random(5)
    words = ["seal", "bond", "<<MT_NT:0001>>", "。", "合同", "Payment", "\n", ". ", "，"]
    for n in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(50, 400))) if n % 3 else "合同" * rng.randint(50, 400)
        limit, overlap = rng.randint(60, 300), rng.randint(0, 40)
        pieces = p4.split_text(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for a, b, _ in pieces:
            assert 0 < len(text[a:b].encode()) <= limit
            for m in p4.TOKEN.finditer(text):
                assert not (m.start() < a < m.end() or m.start() < b < m.end())
        for x, y in zip(pieces, pieces[1:]):
            assert x[0] < y[0] <= x[1] and len(text[y[0] : x[1]].encode()) <= overlap
        assert any(f for *_, f in pieces) == p4.has_long_stretch(text, limit)


def test_natural_cuts_are_the_deepest_valleys_of_whole_windows_and_joints_share_the_overlap():
    rng = random.Random(8)
    topics = [["bond", "bank", "guarantee", "claim"], ["pump", "seal", "pressure", "outlet"], ["<<MT_NT:0007>>", "notice", "court", "law"]]
    for n in range(40):
        sentences = []
        for k in range(60):
            words = topics[k // 6 % 3]
            sentences.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + (". " if n % 2 else "。"))
        if n % 4 == 3:
            sentences.insert(30, "x" * 1500 + " ")
        text = "".join(sentences)
        limit, overlap = 700, rng.randint(20, 90)
        pieces = p4.split_text(text, limit, overlap)
        cohesion = p4.Cohesion(text)
        done = 0
        for a, b, forced in pieces[:-1]:
            high = max(p for p in range(a, len(text) + 1) if len(text[a:p].encode()) <= limit)
            longer = max(p for p in range(a, len(text) + 1) if len(text[a:p].encode()) <= overlap)
            window = cohesion.window(max(done, longer), high)
            assert forced == (not window)
            assert forced or (b in dict(map(reversed, window)) and dict(map(reversed, window))[b] == max(d for d, _ in window))
            done = b
        for x, y in zip(pieces, pieces[1:]):
            shared = len(text[y[0] : x[1]].encode())
            assert overlap - len("<<MT_NT:0007>>") < shared <= overlap
    assert p4.split_text("x" * 10000, 4000, 200) == [(0, 4000, True), (3800, 7800, True), (7600, 10000, False)]
    assert p4.split_text("a b " + "x" * 3900, 3901, 200)[-1] == (3, 3904, False)  # one byte of the overlap fits


def test_cuts_follow_topics():
    one = "The pump seal was worn and the pump pressure fell at the outlet seal. " * 9
    other = "The bank paid the guarantee after the claim and the bank sent the bond back. " * 9
    text = one + other
    (first, *_) = p4.split_text(text, 1000, 50)
    assert first[1] == len(one)


def test_split_operator(spark):
    memory = spark.createDataFrame(
        [(1, 1, "a b " * 1500, "k"), (1, 1, "a b " * 1500, "k"), (2, 1, "合" * 1500, "k"), (3, 9, "x" * 4001, "k"), (4, 1, None, "k"), (5, 1, "short", "k"), (6, None, "y z" * 3000, "k")],
        "rec_id bigint, file_id bigint, frozen_surface string, piece string",
    )
    files = spark.createDataFrame([(1, "m")], "file_id bigint, model_a string")
    backends = spark.createDataFrame([("m", 2048, 100), ("n", None, None)], "backend_name string, ctx_size int, overlap_bytes int")
    got = p4.split_oversized(memory, files, backends)
    kinds = {r["rec_id"]: r["cut_kind"] for r in got.collect()}
    assert kinds == {1: "natural", 2: "forced", 3: "forced", 6: "natural"}
    assert got.where("octet_length(text) > 4000").count() == 0
    assert p4.split_oversized(memory.limit(0), files, backends).count() == 0


def test_numbers_and_dates_are_the_same_in_both_languages():
    en = p5.units("From 3 May 2021, one hundred and eighteen days for EUR 30,100.00 in PV-4404")
    zh = p5.units("自2021年5月3日起，一百一十八日，30100欧元，PV-4404机组")
    shared = set(en) & set(zh)
    assert {"d:2021-5-3", "n:118", "n:30100", "k:pv-4404"} <= shared


def make_segments(spark):
    rng = random.Random(4)
    parts = [("The bond {0} is valid for {1} days.", "保函{0}有效期为{1}天。"), ("Unit PV-{0} was tested at {1} bar.", "PV-{0}机组已在{1}巴下试验。"), ("Payment {0} falls due after {1} months.", "付款{0}于{1}个月后到期。")]
    rows, truth, sid = [], set(), 0
    for rec in range(1, 121):
        pairs = [(e.format(x, y), z.format(x, y)) for e, z in rng.choices(parts, k=rng.randint(2, 6)) for x, y in [(rng.randint(100, 999), rng.randint(11, 99))]]
        ids = []
        for k, (e, _) in enumerate(pairs):
            sid += 1
            ids.append(sid)
            rows.append((sid, rec, "source", k, e, " "))
        kept = [k for k in range(len(pairs)) if rng.random() > 0.1]
        if rng.random() < 0.3:
            rng.shuffle(kept)
        k = 0
        place = 0
        while k < len(kept):
            merge = k + 1 < len(kept) and rng.random() < 0.2
            own = kept[k : k + 2] if merge else kept[k : k + 1]
            sid += 1
            rows.append((sid, rec, "a", place, "".join(pairs[i][1] for i in own).replace("。", "，", len(own) - 1), ""))
            truth |= {(ids[i], sid) for i in own}
            k += len(own)
            place += 1
    schema = "sent_id bigint, rec_id bigint, side string, seg_idx int, seg_text string, suffix string"
    return spark.createDataFrame(rows + rows[:20] + [(900000, None, "source", 0, "x", ""), (900001, 1, "b", 0, None, "")], schema), truth


def test_alignment_recovers_planted_pairs(spark):
    df, truth = make_segments(spark)
    got = {tuple(r) for r in p5.align_segments(df).collect()}
    right = len(got & truth)
    assert right / len(got) > 0.95 and right / len(truth) > 0.93
    assert p5.align_segments(df.limit(0)).count() == 0


def lines(spark, payloads):
    return spark.createDataFrame([(i, p, "k") for i, p in payloads], "line_id bigint, payload string, keep_id string")


SAME = [
    '{"tu_kind":"other","原文":"Seller: Bo; Due: 2025-01-13; Amount: 910.38"}',
    '﻿{ "\\u539f\\u6587" : " amount：910.38 | seller: BO ｜ due: 2025-01-13! ", "tu_kind":" OTHER"}',
]


def test_duplicates_by_format(spark):
    different = ['{"tu_kind":"other","原文":"Seller: Bo; Due: 2025-01-13; Amount: 91038"}', '{"tu_kind":"paragraph","原文":"Seller: Bo; Due: 2025-01-13; Amount: 910.38"}',
                 None, "no json", '{"tu_kind":"other"}', '{"tu_kind":"other","原文":""}']
    rows = [(i, p) for i, p in enumerate(SAME * 3 + different, 1)]
    df = lines(spark, rows + rows[:2])
    for hot in (1, 50_000):
        assert sorted(map(tuple, p6.format_copies(df, hot_rows=hot).collect())) == [(1, i) for i in range(2, 7)]
        assert Counter(r["copies"] for r in p6.format_groups(df, hot_rows=hot).collect()) == {6: 1, 1: 6}
    assert p6.format_copies(df.limit(0)).count() == 0


def test_items_with_long_labels_lose_their_order(spark):
    label = "pressure measured at the outlet of the second stage of the main pump of the plant"
    assert len(label) > 64
    texts = [f"{label}: 9 bar; seal: worn", f"Seal: worn | {label}: 9 bar", f"{label}: 9 bar; seal: new"]
    rows = [(i, '{"tu_kind":"other","原文":"%s"}' % t) for i, t in enumerate(texts, 1)]
    assert list(map(tuple, p6.format_copies(lines(spark, rows)).collect())) == [(1, 2)]


def test_hot_key_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ["Notice one.", "notice  ONE", "(Notice one!)", "Notice 1.2", "Notice 12"]
    rows = [(i, '{"tu_kind":"paragraph","原文":"%s"}' % rng.choice(texts)) for i in range(1, 301)]
    groups: dict[str, list[int]] = {}
    for i, p in rows:
        text = p.split('"')[-2].lower()
        key = "".join(c for k, c in enumerate(text) if c.isalnum() or (c == "." and text[k - 1].isdigit() and text[k + 1 : k + 2].isdigit()))
        groups.setdefault(key, []).append(i)
    expected = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(map(tuple, p6.format_copies(lines(spark, rows), hot_rows=20).collect())) == expected
