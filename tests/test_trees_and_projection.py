import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import references
from textloom.operators import projection, segments, tree

PARAGRAPHS = "doc_id string, part_name string, event_index int, para_id int, heading int, num_id int, num_ilvl int, place string, text string"


def grown(spark, rows):
    """Child texts (or kinds) by parent text, from (heading, num, level, place, text)."""
    df = spark.createDataFrame([("d", "p", i, i, h, n, lv, pl, t) for i, (h, n, lv, pl, t) in enumerate(rows, 1)], PARAGRAPHS)
    nodes = {r["node_id"]: r for r in tree.structure_tree(df).collect()}
    name = lambda r: r["text"] or r["kind"]
    return [(name(nodes[r["parent_id"]]), name(r)) for _, r in sorted(nodes.items()) if r["parent_id"] is not None]


def test_headings_nest_by_depth(spark):
    assert grown(spark, [(1, None, None, "b", "A"), (3, None, None, "b", "B"), (3, None, None, "b", "C"), (None, None, None, "b", "x"), (1, None, None, "b", "D")]) == [
        ("part", "A"), ("A", "B"), ("B", "C"), ("C", "x"), ("part", "D"),
    ]


def test_lists_nest_and_break(spark):
    rows = [(None, 1, 0, "b", "a"), (None, 1, 1, "b", "a1"), (None, 1, 0, "b", "c"), (None, 2, 0, "b", "d"), (None, None, None, "b", "p"), (None, 2, 2, "b", "e"), (None, 2, 0, "cell", "f")]
    assert grown(spark, rows) == [
        ("part", "list"), ("list", "a"), ("a", "list"), ("list", "a1"), ("list", "c"), ("part", "list"), ("list", "d"), ("part", "p"),
        ("part", "list"), ("part", "list"), ("part", "list"), ("list", "e"), ("part", "list"), ("list", "f"),
    ]


def test_styles_inherit_and_stop_in_circles(spark):
    rows = [("d", "a", "b", None), ("d", "b", "c", None), ("d", "c", None, 2), ("d", "x", "y", None), ("d", "y", "x", None), ("d", "z", "missing", None), ("e", "a", None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, style_id string, based_on string, outline int")
    got = {(r["doc_id"], r["style_id"]): r["outline"] for r in tree.inherited_outline(df, 6).collect()}
    assert got == {("d", "a"): 2, ("d", "b"): 2, ("d", "c"): 2, ("d", "x"): None, ("d", "y"): None, ("d", "z"): None, ("e", "a"): 1}


@pytest.mark.parametrize("length", [32, 33, 34, 100])
def test_styles_inherit_along_long_chains(spark, length):
    rows = [("d", f"s{i}", f"s{i + 1}", None) for i in range(length)] + [("d", f"s{length}", None, 3)]
    rows += [("d", f"c{i}", f"c{(i + 1) % 5}", None) for i in range(5)] + [("d", "into", "c0", None), ("e", "s0", None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, style_id string, based_on string, outline int")
    got = {(r["doc_id"], r["style_id"]): r["outline"] for r in tree.inherited_outline(df).collect()}
    assert got == {(d, s): 1 if d == "e" else 3 if s[0] == "s" else None for d, s, *_ in rows}
    assert tree.inherited_outline(df.limit(0)).count() == 0


def test_sections_carry_their_stories(spark):
    refs = spark.createDataFrame([("d", 1, "header", "r1"), ("d", 2, "header", None), ("d", 3, "header", "r2"), ("d", 1, "footer", None)], "doc_id string, section int, story string, rid string")
    rels = spark.createDataFrame([("d", "r1", "h1"), ("d", "r2", "h2")], "doc_id string, rid string, part_name string")
    assert sorted((r["section"], r["part_name"]) for r in tree.section_stories(refs, rels).collect()) == [(1, "h1"), (2, "h1"), (3, "h2")]


def test_shares_and_pieces():
    assert projection.shares(0, [1, 2]) == [0, 0] and projection.shares(5, [0, 0]) == [3, 2] and projection.shares(7, []) == []
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  c合同1") for _ in range(rng.randint(0, 60)))
        weights = [rng.randint(0, 9) for _ in range(rng.randint(1, 6))]
        assert sum(projection.shares(len(text), weights)) == len(text)
        cut = projection.pieces(text, weights)
        assert "".join(cut) == text and len(cut) == len(weights)
    assert projection.pieces("hello world", [1, 1]) == ["hello ", "world"]


@pytest.mark.parametrize(
    "text, src, tgt, out",
    [
        ("see Section 4.1(b) now", "en", "zh", "第4.1条"), ("Cl. 3", "en", "zh", "第3款"), ("Paragraphs 2", "en", "zh", "第2段"), ("Schedule IV", "en", "zh", "附表IV"), ("Article IV", "en", "zh", "第IV条"),
        ("第4条(b)", "zh", "en", "Section 4(b)"), ("第 12 款", "zh", "en", "Clause 12"), ("附表3", "zh", "en", "Schedule 3"), ("nothing", "en", "zh", None), ("Section 4", "en", "de", None), (None, "en", "zh", None),
    ],
)
def test_legal_references(spark, text, src, tgt, out):
    row = spark.createDataFrame([(text, src, tgt)], "t string, s string, g string")
    assert row.select(references.legal_reference(F.col("t"), F.col("s"), F.col("g"))).first()[0] == out


def test_slots_lists_and_json(spark):
    t = " \n<<MT_SLOT:000001>>a<<MT_SLOT:000002>>b c"
    df = spark.createDataFrame([(t, [1, 2]), (t, [2, 1]), ("x" + t, [1, 2]), (t, [])], "t string, ids array<int>")
    assert [r[0] for r in df.select(segments.slot_output(F.col("t"), F.col("ids"))).collect()] == [["a", "b c"], None, None, []]
    one = spark.createDataFrame([('say {"a": {"b": 1}} and {x',), ("none {",), (None,)], "t string")
    assert [r[0] for r in one.select(segments.first_json_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None, None]
    listed = spark.createDataFrame([("A. B. C.",)], "t string").select(segments.split_sentences(F.col("t")).alias("s"))
    assert listed.select(segments.sentence_list(F.col("s"), 14), segments.sentence_list(F.col("s"), 0)).first()[:] == ("[0] A.\n[1] B.\n... (truncated)\n", "[0] A.\n[1] B.\n[2] C.\n")
