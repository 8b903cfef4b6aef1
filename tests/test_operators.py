import hashlib
import random

from pyspark.sql import functions as F

from textloom.operators import compare, model, retrieval, segments, sequence, structure, terms
from textloom.sources import docx


def test_packing_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 120)) for k in range(5) for i in range(60)] + [(9, 0, 5000)]
    df = spark.createDataFrame(rows, "k int, i int, n int").withColumn("budget", F.lit(400))
    got = {(r["k"], r["i"]): r["chunk"] for r in sequence.pack_chunks(df, "k", ["i"], "n", "budget", 7, 10, ["i"]).collect()}
    for k in {r[0] for r in rows}:
        chunk, used, items = 1, 0, 0
        for _, i, n in [r for r in rows if r[0] == k]:
            if items and (used + n + 10 > 400 or items >= 7):
                chunk, used, items = chunk + 1, 0, 0
            used, items = used + n + 10, items + 1
            assert got[k, i] == chunk


def test_heading_paths(spark):
    rows = [(1, 1, "A"), (2, 3, "B"), (3, None, "x"), (4, 2, "C"), (5, 2, " "), (6, None, "y"), (7, 1, "D"), (8, 3, "E")]
    df = spark.createDataFrame([(1, *r) for r in rows], "d int, i int, level int, text string")
    got = {r["i"]: r["section_path"] for r in sequence.heading_path(df, ["d"], ["i"], "level", "text").collect()}
    stack, expected = [], {}
    for i, level, t in rows:
        if level is not None:
            while stack and stack[-1][0] >= level:
                stack.pop()
            if t.strip():
                stack.append((level, t))
        expected[i] = [s for _, s in stack]
    assert got == expected


def test_heading_levels(spark):
    cases = [("Heading 2", None, 2), ("heading3", None, 3), ("Title", None, 1), ("Heading", None, None), ("Heading 0", None, None), ("Normal", None, None), (None, 9, 10), ("Heading 2", 0, 1), (None, -1, None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, s string, o int")
    got = {r["i"]: r["l"] for r in df.select("i", sequence.heading_level(F.col("s"), F.col("o")).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_apportioning_adds_up(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 9) if k else 0, k * 7 + 3) for k in range(6) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "k int, i int, w bigint, total bigint")
    sums = sequence.apportioned(df, ["k"], "i", "total", "w").groupBy("k", "total").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == r["total"] for r in sums)


def test_multisets(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "t string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "t string")
    assert sorted((r["t"], r["change"]) for r in compare.multiset_difference(a, b).collect()) == [("x", "missing"), ("y", "missing"), ("z", "extra")]


def test_glossary_and_terms(spark):
    glossary = spark.createDataFrame([(1, "bond", "a", 1), (2, "joint bond", "b", 1), (3, "", "c", 9), (4, None, "d", 1), (5, "bond", "e", 7)], "term_id bigint, src string, tgt string, seen bigint")
    texts = spark.createDataFrame([(1, "the joint bond"), (2, "Bond"), (3, None), (4, "")], "id int, text string")
    got = [(r["id"], r["term_id"]) for r in terms.glossary_matches(texts, glossary, "id", "text", 2).orderBy("id", "rank").collect()]
    assert got == [(1, 2), (1, 5)]
    updates = spark.createDataFrame([(1, " a ", "x", None), (2, "a", "y", "k"), (3, "a", "x", " "), (4, "", "z", None)], "seq int, src string, tgt string, kind string")
    assert [tuple(r) for r in terms.term_decisions(updates, ["seq"]).collect()] == [("a", "x", None, 3)]
    assert sorted((r["seq"], r["event"]) for r in terms.term_events(updates, ["seq"]).collect()) == [(1, "added"), (2, "conflict")]


def test_candidate_terms_drop_what_better_ones_hold(spark):
    df = spark.createDataFrame([(1, 'The “Joint Bond” and the Joint Bond Act of Trade; NATO, NATO. Joint Bond.')], "k int, t string")
    got = [r["term"] for r in terms.candidate_terms(df, "t", ["k"], 10).orderBy("rank").collect()]
    assert "Joint Bond" in got and "NATO" in got and len(set(got)) == len(got)
    for i, term in enumerate(got):
        assert not any(term.lower() in better.lower() for better in got[:i])


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist(), int(i % 3)) for i in range(300)] + [(900, [], 0), (901, None, 1), (902, [0.0] * 8, None), (903, [1.0], 0)]
    df = spark.createDataFrame(vectors, "id bigint, v array<double>, label int")
    got = retrieval.nearest(df, df.where("id % 50 = 0"), "id", "v", "label", 3).collect()
    m = {i: (np.array(v), label) for i, v, label in vectors[:300]} | {902: (np.zeros(8), None)}
    for q in (0, 50, 250):
        scores = sorted((-round(float(m[q][0] @ v / (np.linalg.norm(m[q][0]) * np.linalg.norm(v) or 1)) + 0.02 * (m[q][1] == label), 6), i) for i, (v, label) in m.items() if i != q)
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in scores[:3]]


XML = (
    '<?xml version="1.0"?><w:document><w:body><w:p><w:pPr><w:pStyle w:val=" Heading1 "/><w:outlineLvl w:val="2"/></w:pPr><w:r><w:t>A &amp; B</w:t><w:tab/></w:r>'
    '<w:hyperlink><w:r><w:t>link</w:t><w:br w:type="page"/><w:br/></w:r></w:hyperlink><w:ins><w:r><w:t>no</w:t></w:r></w:ins></w:p><w:p><w:r><w:t> </w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr>"
    "<w:tr><w:tc><w:p><w:r><w:t>c3</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    '<w:p><w:r><w:t>out</w:t><w:pict><w:p><w:r><w:t>box</w:t></w:r></w:p></w:pict></w:r><w:r><w:t>lost</w:t></w:r></w:p><w:p><w:r><w:t><![CDATA[raw]]>t</w:t></w:r></w:p>'
    '<w:x o:gfxdata="A&#xD;&#xA;B"/><!-- c --></w:body></w:document>'
)


def package(spark):
    row = ("d", 0, "word/document.xml", XML.encode(), 8, 2024, 1, 2, 3, 4, 6, 0o644, False)
    other = ("d", 1, "media/a.PNG", b"\x00\x01", 0, 2024, 1, 2, 3, 4, 6, 0o600, False)
    return docx.pack(spark.createDataFrame([row, other], docx.ENTRIES))


def test_package_and_markup_round_trip(spark):
    entries = docx.unpack(package(spark))
    rows = {r["name"]: r for r in entries.collect()}
    assert list(rows) == ["word/document.xml", "media/a.PNG"] and rows["media/a.PNG"]["data"] == b"\x00\x01" and rows["media/a.PNG"]["unix_mode"] == 0o600
    evs = docx.events(entries)
    assert docx.serialized(evs).first()["data"].decode() == XML
    hidden = docx.masked(evs, "abc")
    back = docx.filled(hidden, docx.slots(evs))
    assert docx.serialized(back).first()["data"].decode() == XML
    assert docx.unpack(spark.createDataFrame([("x", b"no zip"), ("y", None)], "doc_id string, content binary")).count() == 0


def test_paragraphs(spark):
    rows = structure.paragraphs(docx.events(docx.unpack(package(spark)))).orderBy("para_id").collect()
    assert [r["text"] for r in rows] == ["A & B\tlink\n", "c1", "c2", "c3", "out", "t"]
    assert [(r["table_index"], r["row_index"], r["cell_index"]) for r in rows[1:4]] == [(1, 1, 1), (1, 1, 2), (1, 2, 1)]
    assert rows[0]["p_style"] == "Heading1" and rows[0]["outline_lvl"] == 2 and rows[0]["container"] == "document_body"


def test_filter_drops_subtrees_and_attributes(spark):
    evs = structure.filtered_events(docx.events(docx.unpack(package(spark))), ["w:tbl", "w:pPr"], ["o:gfxdata"])
    out = docx.serialized(evs).first()["data"].decode()
    assert "w:tbl" not in out and "w:pPr" not in out and "<w:x/>" in out and "A &amp; B" in out


def test_sentences_and_patches():
    for t in ["A. B", "3.14 x", "没有。空格", "a\r\nb", "\nx", "", "  a; b"]:
        assert "".join(s["text"] + s["suffix"] for s in segments.sentence_segments(t)) == t
    assert [s["text"] for s in segments.sentence_segments("A. B! 没有。空格 3.14\r\nc")] == ["A.", "B!", "没有。空格 3.14", "c"]
    patch = {"patch_type": "sentence_replace", "sentence_index": 1, "before": "B  12.", "after": "C 12."}
    assert segments.apply_patches("A. B 12. D", [patch]) == ("A. C 12. D", None)
    bad = [({"sentence_index": 9}, "out of range"), ({"before": "x"}, "mismatch"), ({"after": " "}, "is empty"), ({"after": "a\nb"}, "newline"), ({"after": "B 12."}, "no_change"),
           ({"must_preserve_tokens": ["12"], "after": "C."}, "must_preserve"), ({"patch_type": "x"}, "unknown_patch_type"), ({"expect_after_contains": ["q"]}, "expect_after")]
    for change, error in bad:
        assert error in segments.apply_patches("A. B 12. D", [patch | change])[1]


def test_segmented_output(spark):
    t = "x<<MT_SEG:000001>>a<<MT_END:000001>>\n<<MT_SEG:000002>><<MT_END:000002>>"
    df = spark.createDataFrame([(t, [1, 2]), (t, [2, 1]), (t, []), (t, [3])], "t string, ids array<int>")
    assert [r[0] for r in df.select(segments.segmented_output(F.col("t"), F.col("ids"))).collect()] == [["a", ""], None, [], None]


def test_model_ladder(spark):
    df = spark.createDataFrame([(1, "a <<MT_NT:0001>>", {"<<MT_NT:0001>>": "1"}, "b"), (2, None, None, None)], "i int, f string, m map<string,string>, c string")
    df = model.generated(df, "f", "g")
    got = {r["i"]: (r["accepted"], r["accepted_from"]) for r in model.accepted(df, "f", "m", ["c", "g"]).collect()}
    assert got == {1: ("a <<MT_NT:0001>>", "g"), 2: (None, "source")}


def test_streamed_terms(spark, tmp_path):
    from textloom.streaming.terms import streamed_term_events

    source, out = str(tmp_path / "in"), []
    for part in ([(1, "a", "x"), (2, "a", "y")], [(3, "a", "x"), (4, "a", "z"), (5, " ", "q")]):
        spark.createDataFrame(part, "seq int, src string, tgt string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("seq int, src string, tgt string").option("maxFilesPerTrigger", 1).parquet(source)
    query = streamed_term_events(stream).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert sorted(r[:4] for r in out if r[1] == "conflict") == sorted([("a", "conflict", "x", "y"), ("a", "conflict", "x", "z")]) and sum(r[1] == "added" for r in out) == 1


def test_top_values_and_limit_keep_the_first(spark):
    parts = ["c", "a", "b", "b", "d", "e", "f", "g", "h", "h", "h"]
    df = spark.createDataFrame([(f, i, p) for f in (1, 2) for i, p in enumerate(parts)] + [(3, 0, None)], "file_id int, tu_id int, part_name string")
    top = sequence.top_values(df, ["file_id"], "tu_id", "part_name").orderBy("file_id", "rank").collect()
    assert [(r["part_name"], r["n"]) for r in top if r["file_id"] == 1] == [("h", 3), ("b", 2), ("c", 1), ("a", 1), ("d", 1), ("e", 1)]
    assert [(r["part_name"], r["n"]) for r in top if r["file_id"] == 3] == [(None, 1)]
    for most, kept in ((None, 11), (0, 1), (1, 1), (4, 4), (99, 11)):
        rows = sequence.limited(df, ["file_id"], ["tu_id"], most).where("file_id = 2")
        assert sorted(r["tu_id"] for r in rows.collect()) == list(range(kept)) and rows.columns == df.columns


def test_full_hash_sees_text_and_equals_its_definition(spark):
    xml = '<?xml version="1.0" encoding="UTF-8"?><!--n--><w:p b="2" a="1"><w:t xml:space="preserve">x &amp; y</w:t>{0}</w:p>'
    texts = [xml.format("<w:br/>"), xml.format("<w:br></w:br>"), xml.format("<w:br/>").replace("x &", "z &"), xml.format("<w:br/>").replace(' xml:space="preserve"', "")]
    entries = spark.createDataFrame([(str(i), "word/document.xml", False, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id string, name string, is_dir boolean, data binary")
    evs = docx.events(entries)
    got = {r["doc_id"]: r["hash"] for r in docx.full_hashes(evs).collect()}
    lines = ["D:1.0|UTF-8|", "M:n", "S:w:p|a=1;b=2;", "S:w:t|xml:space=preserve;", "T:w:t|x & y", "E:w:t", "S:w:br|", "E:w:br", "E:w:p"]
    assert got["0"] == got["1"] == hashlib.sha256("".join(f"{line}\n" for line in lines).encode()).hexdigest()
    assert len({got["0"], got["2"], got["3"]}) == 3
    assert len({r["hash"] for r in docx.structure_hashes(evs).collect()}) == 1
