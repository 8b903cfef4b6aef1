import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import masking, validate
from textloom.functions.language import lang_label
from textloom.operators import chunks, retrieval, stages
from textloom.plans.stage_queries import forgetful_model, vowels_model
from textloom.sources import config
from textloom.streaming import stages as stream_stages


def test_texts_fit_and_come_back():
    rng = random.Random(3)
    for n in range(60):
        text = "".join(rng.choice(["word ", "stop. ", "one, ", "合同", "。 ", "x" * 90]) for _ in range(rng.randint(0, 60)))
        most = rng.randint(1, 30)
        pieces = chunks.fit_tokens(text, chunks.count_words, most)
        assert "".join(pieces) == text
        assert all(chunks.count_words(p) <= most or len(p) <= 32 for p in pieces)
    assert chunks.fit_tokens("a. b, c. d", chunks.count_words, 5) == ["a. ", "b, c. d"]
    assert chunks.fit_tokens("", chunks.count_words, 5) == [""] and chunks.fit_tokens("abc", chunks.count_words, 0) == ["abc"]


def test_embedding_chunks_keep_every_character(spark):
    rows = [(1, "One 1. Two 2! Three 3? 四。 五"), (2, ""), (3, None), (4, " \n "), (5, "x" * 50)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["id"]: r["c"] for r in df.select("id", chunks.embedding_chunks(F.col("t"), 14).alias("c")).collect()}
    assert got == {1: ["One 1. Two 2!", "Three 3? 四。 五"], 2: [], 3: [], 4: [], 5: ["x" * 50]}


def test_means_pass_over_other_dimensions(spark):
    df = spark.createDataFrame([("a", 1, "xx", [1.0, 0.0]), ("a", 2, "", [0.0, 1.0]), ("a", 3, "x", [1.0]), ("b", 1, "x", [])], "k string, n int, t string, v array<double>")
    (row,) = chunks.chunked_means(df, ["k"], "n", "t", "v").collect()
    assert row["k"] == "a" and row["mean"] == pytest.approx([2 / 3, 1 / 3]) and row["norm"] == pytest.approx((5 / 9) ** 0.5)


def test_nearest_with_exclusions_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, None]), [rng.uniform(-1, 1) for _ in range(5 if i % 9 else 4)]) for i in range(120)] + [(500, 0, []), (501, 0, [0.0] * 5), (None, 0, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<double>")
    asked = df.where("id % 10 = 3").withColumn("out", F.array(F.col("id") + 1))
    got = {}
    for r in retrieval.nearest(df, asked, "id", "v", "label", 4, exclude_col="out").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))

    def cosine(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    for q, label, v in rows:
        if q is None or q % 10 != 3 or not v:
            continue
        scored = [(-round(cosine(v, w) + 0.02 * (label is not None and label == m), 6), i) for i, m, w in rows if i not in (None, q, q + 1) and len(w) == len(v)]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in sorted(scored)[:4]]
    assert retrieval.nearest(df, asked.limit(0), "id", "v", "label", 4).count() == 0


def test_bisection_asks_in_halves():
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        return forgetful_model()(prompts)

    texts = [f"text {i}" for i in range(7)]
    assert stages.bisected([(list(range(7)), texts), ([], [])], model) == [[t.replace("e", "E") for t in texts], []]
    assert calls == [1, 2, 4]
    assert stages.bisected([([4], ["x"])], lambda ps: ["<<MT_SEG:000004>> y"]) == [["y"]]


def test_gaps_keep_tokens(spark):
    rows = [("a <<MT_NT:0001>> be<<MT_BR>>", "en", "zh"), ("<<MT_BR>>", "en", "zh"), (None, "en", "zh"), ("", None, None)]
    df = spark.createDataFrame(rows, "f string, s string, t string")
    assert [r["o"] for r in stages.gaps_translated(df, "f", "s", "t", "o", vowels_model, "vowels").collect()] == ["A<<MT_NT:0001>>bE<<MT_BR>>", "<<MT_BR>>", None, ""]


def repair_model():
    """Mends a draft whose prompt names digits; else gives rubbish, and gaps back as they are."""

    def answer(p):
        if "Keep [[MT_HOLE]]" in p:
            return p.split("\n", 1)[1]
        return "付款 7 天内" if "digits_mismatch" in p else "<<MT_NT:9999>>"

    return lambda prompts: [answer(p) for p in prompts]


def test_repairs(spark):
    rows = [(1, "pay in 7 days", {}, "付款 7 天内"), (2, "pay in 7 days", {}, "付款天内"), (3, "pay<<MT_BR>>now", {}, "付款"), (4, "<<MT_NT:0001>> pays", {"<<MT_NT:0001>>": "Bo"}, "Bo 付款"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, f string, m map<string,string>, d string").withColumns({"sl": F.lit("en"), "tl": F.lit("zh")})
    got = {r["id"]: (r["o"], r["o_from"]) for r in stages.repaired(df, "f", "m", "d", "sl", "tl", "o", repair_model, "repair", rounds=2).collect()}
    assert got[1] == ("付款 7 天内", "draft") and got[2] == ("付款 7 天内", "repair") and got[4] == ("<<MT_NT:0001>> 付款", "draft")
    assert got[3] == ("pay<<MT_BR>>now", "gaps") and got[5][0] == ""


def test_repairs_are_one_pass(spark):
    df = spark.createDataFrame([(1, "pay in 7 days", {}, "付款天内")], "id int, f string, m map<string,string>, d string").withColumns({"sl": F.lit("en"), "tl": F.lit("zh")})
    plans = [stages.repaired(df, "f", "m", "d", "sl", "tl", "o", repair_model, "repair", rounds=n)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 6)]
    assert [plan.count("MapInArrow") for plan in plans] == [1, 1]


def test_rounds_ask_for_what_fails_and_no_more():
    asked = []

    def model(prompts):
        asked.append([p.split("Source: ")[-1].split("\n")[0] if "Source: " in p else p.split("\n", 1)[1] for p in prompts])
        return ["<<MT_NT:0009>>" if "token" in p else "no number" for p in prompts]

    rows = [("pay 7", [], "付 7"), ("pay 8", [], "付"), ("<<MT_BR>>", [], "x"), (None, None, None), ("pay<<MT_TAB>>", [("<<MT_NT:0001>>", None)], "<<MT_BR>>")]
    got = stages._repairs(6)(model, [(*row, "en", "zh", "English", "Chinese") for row in rows])
    assert got[0] == ("付 7", None, "draft") and got[1] == ("pay 8", "digits_mismatch", "source") and got[2] == ("<<MT_BR>>", "sentinel_sequence_mismatch", "gaps")
    assert got[3] == ("", "unexpected_mt_token", "source") and got[4] == ("no number<<MT_TAB>>", "unexpected_mt_token", "gaps")
    tokens = ["<<MT_BR>>", "", "pay<<MT_TAB>>"]
    assert asked == [["pay 8", *tokens]] * 2 + [tokens] * 4 + [["pay 8", "pay[[MT_HOLE]]"]]


def test_texts_are_judged_as_columns_are(spark):
    rng = random.Random(5)
    bits = ["<<MT_BR>>", "<<MT_TAB>>", "<<MT_NT:0001>>", "<<MT_NT:0002>>", "<<MT_X>>", "7", "٣", "²", "Section 4.1(b)", "ſECTION 4-1", "Artıcle IV", "ARTİCLE IXİ", "第4.1条", "xiv", "（1）", "e\u0301", "_"]
    bits += [" ", "\u3000", "\u200b", "\x1c", "\x85", "\r\n", "\x01", "\x02\x03", "a", "the ", "合同", "の", "한글", "𠀀", "(", "【", "》", "…", "…" * 8, "ΑΣ", "İ", "x" * 30, "甲" * 12, "”", "，", "\u200d", ".", "-"]
    maps = [None, {}, {"<<MT_NT:0001>>": "4.1(b)", "<<MT_NT:0002>>": None}, {"<<MT_NT:0001>>": "7", "<<MT_NT:0002>>": "<<MT_BR>>", "MT_": "x"}, {"7": "IV \x02\x03 …"}]
    rows = []
    for i in range(4000):
        s = None if i % 97 == 0 else "".join(rng.choices(bits, k=rng.choice([0, 1, 2, 4, 8, 20])))
        t = s if s is not None and rng.random() < 0.7 else "".join(rng.choices(bits, k=rng.choice([0, 1, 4, 40])))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice([*bits, ""]) + t[k + rng.choice([0, 1, 3]) :]
        rows.append((s, None if i % 89 == 0 else t, rng.choice(maps), rng.choice(["en", "zh", " ZH-cn ", None]), rng.choice(["en", "zh", "ja", "ko", " EN", "", None])))
    df = spark.createDataFrame(rows, "s string, t string, m map<string,string>, sl string, tl string")
    got = validate.quality_flags(validate.validated(df, "s", "m", "t", "e"), "s", "m", "t", "sl", "tl").collect()
    units = [(validate.Source(r["s"], r["m"]), r["t"] or "", r) for r in got]
    assert [(u.error(t), *u.flags(t, r["sl"], r["tl"])) for u, t, r in units] == [(r["e"], r["hard_flags"], r["soft_flags"]) for r in got]
    assert len({r["e"] for r in got}) >= 9
    model = lambda: lambda ps: [None if len(p) % 11 == 0 else ("```x\n%s\n```" if len(p) % 5 == 0 else '\x1c "%s" \u3000' if len(p) % 3 == 0 else "%s") % p.split("\n", 1)[-1] for p in ps]
    gaps = stages.gaps_translated(df.where("s is not null"), "s", "sl", "tl", "o", model, "odd").select("s", lang_label(F.col("sl")), lang_label(F.col("tl")), "o").collect()
    assert stages._gap_by_gap(model(), [tuple(r)[:3] for r in gaps]) == [r["o"] for r in gaps]


def json_model():
    return lambda prompts: ['Sure: {"understanding":"u","terms":["a"]} ok' if "proper_nouns" in p else '{"issues":[{"tu_id":3,"issue":"x"},{"issue":"y"}]}' if "List issues" in p else "甲 7" for p in prompts]


def test_notes_audit_and_fusion(spark):
    df = spark.createDataFrame([(1, "pay 7", {}, "付 7", "给 7"), (2, "pay 7", {}, "付 7", None), (3, "pay 8", {}, "付 8", "x")], "id int, f string, m map<string,string>, a string, b string").withColumn("tl", F.lit("zh"))
    note = stages.noted(df, "f", json_model, "json").first()["notes"]
    assert (note["understanding"], note["proper_nouns"], note["terms"]) == ("u", [], ["a"])
    assert {tuple(r) for r in stages.audited(df, "tu_id", "f", json_model, "json").collect()} == {(3, "x")}
    got = {r["id"]: (r["fused"], r["fused_from"]) for r in stages.fused(df, "f", "m", "a", "b", "tl", json_model, "json").collect()}
    assert got == {1: ("甲 7", "_fused"), 2: ("付 7", "a"), 3: ("付 8", "a")}


def test_answers_and_contexts(spark):
    answers = [("j", '{"domain":"law","doc_type":"x"}'), ("l", "- Domain: steel\n* 风格: \"plain\"\nsummary: s: t"), ("n", None)]
    df = spark.createDataFrame(answers, "k string, a string").withColumn("tl", F.lit("zh"))
    got = {r["k"]: r["context"] for r in stages.document_context(df, "a", "tl", {("legal", "Chinese"): "formal"}).collect()}
    assert (got["j"]["domain"], got["j"]["target_style"]) == ("law", "formal") and (got["l"]["domain"], got["l"]["target_style"], got["l"]["summary"]) == ("steel", "plain", "s: t")
    assert got["n"]["target_style"] is None
    assert [r[0] for r in df.select(stages.is_json(F.col("a"))).collect()] == [True, False, False]
    ladder = spark.createDataFrame([("合同到期。", "x", "d"), (None, "x", "d"), (None, None, "d")], "i string, x string, d string").withColumns({"s": F.lit("The bond is due."), "m": F.create_map().cast("map<string,string>"), "sl": F.lit("en"), "tl": F.lit("zh")})
    assert [r["text_from"] for r in stages.agent_ladder(ladder, "i", "x", "d", "s", "m", "sl", "tl").collect()] == ["instruction", "direct", "draft"]


def test_limits_and_prompts():
    assert stages.ModelLimits().clamped() == stages.ModelLimits(4096, 0, 512, 512)
    assert stages.ModelLimits(9000, 2048, 4, 99).clamped() == stages.ModelLimits(2048, 2048, 8, 8)
    assert stages.fitted_context("h", ["a a", "b b"], "t", chunks.count_words, 4) == "h\na a\nt"
    assert stages.fitted_context("h", ["a a"], "t", chunks.count_words, 1) == "h\nt"


def test_legacy_mask():
    frozen, tokens, _ = masking.freeze_text("See section 4(b) and 第12条, x, section 4(b).", legacy=True)
    assert [t["original"] for t in tokens] == ["section 4", "(b)", "第12条", "x", "section 4", "(b)"]
    assert len(tokens) == frozen.count("<<MT_NT:") and "section" not in frozen


def test_configuration(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "m.gguf").write_bytes(b"x")
    (tmp_path / "p.txt").write_text("custom", encoding="utf-8")
    path = tmp_path / "app.toml"
    path.write_text('[pipeline]\nmode = "full"\nautosave_every = 3\nunknown = 1\n[prompts]\ntranslate = "p.txt"\n[models]\nmodel_dir = "."\n[models.backends.a]\npath = "m.gguf"\ntemplate_hint = " "\nctx_size = 8192\n[models.backends.b]\npath = "none.gguf"\n')
    cfg = config.load_config(path)
    assert cfg.pipeline.mode == "full" and cfg.pipeline.autosave_every == 3
    assert config.find_upwards(tmp_path / "deep" / "er", "app.toml") == path.resolve() and config.find_upwards(tmp_path, "no.toml", 1) is None
    got = config.resolved_backend(cfg, "a", default_hint="gemma")
    assert got.ctx_size == 8192 and got.template_hint == "gemma" and got.path.name == "m.gguf"
    assert config.prompt_set(cfg, stages.PROMPTS)["translate"] == "custom"
    for bad in ("b", "c"):
        with pytest.raises(config.ConfigError):
            config.resolved_backend(cfg, bad)
    rules = tmp_path / "rules.toml"
    rules.write_text('version = 1\ndrop_elements = ["w:x"]\nmerge_adjacent_runs = true\n')
    assert config.load_rules(rules).drop_elements == ("w:x",) and config.load_rules(rules).merges() is None and config.FilterRules().merges() == []
    rules.write_text("version = 2\n")
    with pytest.raises(config.ConfigError):
        config.load_rules(rules)
    found = config.settings_from({"TEXTLOOM_MAX_TUS": "-4", "TEXTLOOM_PROGRESS": "off", "TEXTLOOM_EMBEDDING_MIN_SIM": "x", "TEXTLOOM_TARGET_LANG_CODE": " zh ", "TEXTLOOM_LOG_TU_EVERY": "0"})
    assert (found.max_tus, found.progress, found.embedding_min_sim, found.target_lang_code, found.log_tu_every) == (0, False, 0.0, "zh", 1)


def test_streams_save_batches_and_say_so(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").write.parquet(str(tmp_path / "in"))
    told = []
    beat = stream_stages.Heartbeat(told.append)
    spark.streams.addListener(beat)
    try:
        for _ in range(2):
            stream = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
            query = stream_stages.saved_units(stream, lambda b: b.withColumn("t", F.upper("t")), str(tmp_path / "out"), str(tmp_path / "ck"))
            query.awaitTermination(60)
    finally:
        spark.streams.removeListener(beat)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r["id"], r["t"]) for r in rows] == [(1, "A"), (2, "B")]
    assert all(json.loads(x)["event"] for x in told)


def test_states(spark):
    log = spark.createDataFrame([(1, "pending", 1), (1, "judged", 2), (1, "pending", 9), (2, "odd", 1), (3, "verified", 1)], "u int, state string, at int")
    assert {tuple(r) for r in stream_stages.current_states(log, "u", "at").collect()} == {(1, "judged"), (3, "verified")}
    assert [r[0] for r in log.select(stream_stages.next_state(F.col("state"))).collect()] == ["translated_a", "applied", "translated_a", "pending", "verified"]
