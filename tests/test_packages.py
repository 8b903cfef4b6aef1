import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import units
from textloom.sources import artifacts, docx, properties


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (2024, 5, 6, 7, 8, 10))
            info.compress_type = 8
            archive.writestr(info, data)
    return out.getvalue()


@pytest.mark.parametrize("bad", ["<a b=1>t</a>", "1 < 2", "<a><b></a></b>", "<a>", "</a>", "<a>&nbsp;</a>", "<a>& b</a>", '<a b="1" b="2"/>', "<a b='<'/>", "<a", "<>"])
def test_malformed_markup_fails(bad):
    with pytest.raises(docx.MarkupError):
        docx.parse_markup(bad)


@pytest.mark.parametrize(
    "xml", ['<o:a o:gfxdata="A&#xD;&#xA;B"/>', "<a>&amp;&lt;&gt;</a>", "<?xml version=\"1.0\"?><!DOCTYPE a><a><!-- x --><![CDATA[<b>]]><?pi x?></a>", '<a  b="1"/>']
)
def test_markup_comes_back(xml):
    assert docx.write_markup(docx.parse_markup(xml)) == xml.replace("  ", " ")


def test_references_and_quotes():
    assert docx.parse_markup("<a>&#x80;&#65;&quot;&apos;</a>")[1][3] == "\x80A\"'"
    (piece,) = docx.parse_markup("<a b='x\"y'/>")
    assert docx.write_markup([piece]) == '<a b="x&quot;y"/>'


def test_errors_as_rows(spark):
    row = ("d", 0, "a.xml", b"<a>", 8, 2024, 1, 2, 3, 4, 6, 0o644, False)
    entries = spark.createDataFrame([row], docx.ENTRIES)
    assert [r["kind"] for r in docx.events(entries, strict=False).collect()] == ["error"]
    with pytest.raises(Exception, match="left open"):
        docx.events(entries).collect()


def test_mask_and_merge(spark):
    content = package(**{"word/document.xml": '<w:p><w:t>a &amp; b</w:t><w:lvlText w:val="%1."/><![CDATA[c]]></w:p>', "x.bin": b"\x00<", "empty.xml": ""})
    done = artifacts.mask_package(content)
    assert done["slot_texts"] == ["a & b", "%1.", "c"] and [s["kind"] for s in json.loads(done["offsets"])["slots"]] == ["text", "attr", "c_data"]
    again = artifacts.merge_package(done["mask"], done["offsets"], done["blobs"], done["prefix"], done["slot_texts"])
    assert artifacts.compare_packages(content, again) is None
    other = artifacts.merge_package(done["mask"], done["offsets"], done["blobs"], done["prefix"], ["z", "%1.", "c"])
    assert artifacts.compare_packages(content, other) == "entry content: word/document.xml"
    df = spark.createDataFrame([("d", bytearray(content)), ("bad", bytearray(b"no zip")), ("none", None)], "doc_id string, content binary")
    masks = artifacts.masked_packages(df)
    assert {r["doc_id"]: r["error"] is None for r in masks.collect()} == {"d": True, "bad": False, "none": False}
    assert {r["doc_id"]: r["error"] for r in artifacts.merged_packages(masks).collect()} == {"d": None, "bad": "artifacts are missing", "none": "artifacts are missing"}
    assert artifacts.masked_packages(df.limit(0)).count() == 0


def test_entries_decode():
    blobs = b"abcdef"
    import hashlib

    place = lambda a, n, h: {"encoding": "external", "value": {"offset": a, "length": n, "sha256": h}}
    good = hashlib.sha256(b"cd").hexdigest()
    assert artifacts.decode_entry(place(2, 2, good), blobs) == b"cd"
    assert artifacts.decode_entry({"encoding": "base64", "value": "YWI="}, None) == b"ab" and artifacts.decode_entry({"encoding": "utf8", "value": "é"}, None) == "é".encode()
    assert artifacts.decode_entry({"encoding": "empty"}, None) == b""
    for bad in (place(2, 9, good), place(1, 2, good), {"encoding": "base64", "value": "*"}, {"encoding": "x"}):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.decode_entry(bad, blobs)


def evs_of(spark, **parts):
    rows = [("d", i, n, x.encode(), 8, 2024, 1, 2, 3, 4, 6, 0o644, False) for i, (n, x) in enumerate(parts.items())]
    return docx.events(spark.createDataFrame(rows, docx.ENTRIES))


def test_units_and_signatures(spark):
    xml = (
        '<w:body><w:p><w:pPr><w:pStyle w:val=" Title "/></w:pPr><w:r><w:rPr><w:b w:val="off"></w:b><w:i></w:i><w:sz w:val="20"></w:sz></w:rPr><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r>'
        '<w:r><w:t>c</w:t></w:r></w:p><a:p><a:r><a:rPr b="1"></a:rPr><a:t>x</a:t></a:r><a:br/></a:p><w:lvlText w:val="%1."/><w:p><w:r><w:t> </w:t></w:r></w:p></w:body>'
    )
    got = units.translation_units(evs_of(spark, **{"word/document.xml": xml})).orderBy("tu_id").collect()
    assert [(r["source_surface"], r["para_style"]) for r in got] == [("a<<MT_TAB>>bc", "Title"), ("x<<MT_BR>>", None), ("%1.", None)]
    plain = "b=0|i=1|u=|strike=0|color=|highlight=|sz=20|szCs=|rStyle=|fonts=|||"
    assert [s["style_sig"] for r in got for s in r["spans"]] == [plain, plain, "w:rPr()", "b=1|i=|u=|strike=|sz=|typeface=", "attr"]


@pytest.mark.parametrize(
    "weights, source, target, texts, error",
    [([2, 2], "abcd", "wxyz", ["wx", "yz"], None), ([2, 2], "ab<<MT_BR>>cd", "x<<MT_BR>>yz", ["x", "yz"], None), ([2], "ab", "x<<MT_BR>>", None, "control_token_sequence_mismatch"),
     ([2, 2], "abcd", "<<MT_NT:0001>>xy", ["<<MT_NT:0001>>x", "y"], None), ([2], "ab<<MT_BR>>", "x<<MT_BR>>y", None, "text_for_empty_block"), ([2, 3], "ab", "xy", None, "span_coverage_mismatch"), ([2, 2], "abcd", "", ["", ""], None)],
)
def test_projection(weights, source, target, texts, error):
    assert units.project_spans(weights, [False] * len(weights), source, target) == (texts, error)


def test_written_nodes(spark):
    evs = evs_of(spark, **{"word/document.xml": '<w:p><w:t>a</w:t><w:t xml:space="x">b</w:t><w:lvlText w:val="1"/></w:p>'})
    writes = spark.createDataFrame(
        [("d", "word/document.xml", 1, 2, None, " A"), ("d", "word/document.xml", 4, 5, None, "B "), ("d", "word/document.xml", 7, None, "w:val", "2")],
        "doc_id string, part_name string, elem_index int, text_index int, attr string, text string",
    )
    got = docx.serialized(units.written(evs, writes)).first()["data"].decode()
    assert got == '<w:p><w:t xml:space="preserve"> A</w:t><w:t xml:space="preserve">B </w:t><w:lvlText w:val="2"/></w:p>'


def test_paragraph_slots_skip_nested_and_last_duplicate_wins(spark):
    from textloom.operators import structure

    xml = "<w:document><w:body><w:p><w:r><w:t>a</w:t><w:pict><w:p><w:r><w:t>in</w:t></w:r></w:p></w:pict><w:t>b</w:t></w:r></w:p></w:body></w:document>"
    evs = evs_of(spark, **{"word/document.xml": xml})
    paras = structure.paragraphs(evs)
    twice = paras.unionByName(paras.withColumn("para_id", F.lit(9)))
    got = {r["para_id"]: (r["slot_ids"], r["source_surface"]) for r in units.paragraph_slots(evs, twice, docx.slots(evs)).collect()}
    assert got == {1: ([], ""), 9: ([1, 3], "<<MT_SLOT:000001>>a<<MT_SLOT:000003>>b<<MT_SLOT:000000>>")}


@pytest.mark.parametrize("text, error", [("<<MT_SLOT:000001>>x<<MT_SLOT:000000>>", None), ("x", "slot_output"), ("<<MT_SLOT:000001>>x<<MT_SLOT:000000>>y", "slot_terminator_has_content"), (None, "slot_output")])
def test_slot_texts(spark, text, error):
    df = spark.createDataFrame([([1], text, {}, 1)], "slot_ids array<int>, t string, m map<string,string>, k int")
    row = units.slot_texts(df, "t", "m", "k").first()
    assert row["error"] == error and (error or row["texts"][0]["text"] == "x")


def png(width, height, dpi):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", dpi, dpi, 1)) + chunk(b"IDAT", b"")


def test_image_headers(spark):
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1" + struct.pack(">BHHBB", 1, 300, 300, 0, 0) + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + b"\0" * 4
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6) + b"\0" * 12 + struct.pack("<ii", 11811, 11811)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 40, 0) + struct.pack("<HHII", 257, 4, 1, 50)
    heads = [properties.image_header(x) for x in (png(3, 4, 11811), gif, jpeg, bmp, tiff, b"", b"\xff\xd8\xff", b"text")]
    assert heads == [("png", 3, 4, 300, 300), ("gif", 7, 9, 72, 72), ("jpeg", 30, 20, 300, 300), ("bmp", 5, 6, 300, 300), ("tiff", 40, 50, 72, 72), None, None, None]
    rows = [("d", i, n, x, 8, 2024, 1, 2, 3, 4, 6, 0o644, False) for i, (n, x) in enumerate((("a.png", png(3, 4, 1)), ("b.txt", b"x")))]
    assert [r["name"] for r in properties.images(spark.createDataFrame(rows, docx.ENTRIES)).collect()] == ["a.png"]


def test_grid_repeats_merged_cells(spark):
    cell = lambda text, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [cell("a", '<w:gridSpan w:val="2"/>') + cell("b", '<w:vMerge w:val="restart"/>'), cell("c") + cell("d") + cell("x", "<w:vMerge/>")]
    xml = f"<w:document><w:body><w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl></w:body></w:document>"
    got = {(r["row_index"], r["column_index"]): r["text"] for r in properties.grid_cells(properties.table_cells(evs_of(spark, **{"word/document.xml": xml}))).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (0, 2): "b", (1, 0): "c", (1, 1): "d", (1, 2): "b"}


def test_breaks_comments_shapes_and_units(spark):
    xml = '<w:document><w:body><w:p><w:r><w:t>a</w:t><w:lastRenderedPageBreak/><w:t>b</w:t></w:r></w:p><w:p><w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="5"/></wp:inline></w:drawing></w:r></w:p></w:body></w:document>'
    notes = '<w:comments><w:comment w:id="3" w:author="A" w:date="2024-01-02T03:04:05Z"><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:comment></w:comments>'
    evs = evs_of(spark, **{"word/document.xml": xml, "word/comments.xml": notes})
    assert sorted((r["fragment"], r["text"]) for r in properties.page_break_fragments(evs.where("part_name = 'word/document.xml'")).collect()) == [(0, "a"), (1, "b")]
    (note,) = properties.comments(evs).collect()
    assert (note["comment_id"], note["author"], note["text"]) == (3, "A", "hi")
    rels = spark.createDataFrame([], "doc_id string, source string, rid string, type string, target string, external boolean, part_name string")
    (shape,) = properties.inline_shapes(evs, rels).collect()
    assert (shape["width"], shape["height"], shape["picture"]) == (914400, 5, None)
    row = spark.range(1).select(
        properties.emu(F.lit(2.5), "cm"), properties.length_in(F.lit(914400), "pt"), properties.rgb_hex(F.lit(255), F.lit(0), F.lit(10)), properties.choice("alignment", F.lit("both")),
        properties.choice("alignment", F.lit("x")), properties.guessed_level(F.lit("标题 3")), properties.guessed_level(F.lit("Title")),
    ).first()
    assert list(row) == [900000, 72.0, "FF000A", "justify", None, 3, None]
