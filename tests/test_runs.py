from textloom.operators import runs
from textloom.sources import docx


def merged(xml):
    events = [dict(zip(("kind", "name", "attrs", "text", "path"), e)) for e in docx.parse_markup(xml)]
    tag = lambda e: f"<{e['name']}{''.join(f' {a["k"]}="{a["v"]}"' for a in e['attrs'] or [])}{'/' if e['kind'] == 'empty' else ''}>"
    return "".join(e["text"] if e["kind"] == "text" else f"</{e['name']}>" if e["kind"] == "end" else tag(e) for e in runs.merge_events(events))


def test_alike_neighbours_merge():
    run = "<w:r><w:rPr><w:b/></w:rPr><w:t>{}</w:t></w:r>"
    assert merged(f"<w:p>{run.format('a')}{run.format('b')}{run.format('c')}</w:p>") == f"<w:p>{run.format('abc')}</w:p>"


def test_what_keeps_runs_apart():
    a, b = "<w:r><w:t>a</w:t></w:r>", "<w:r><w:rPr><w:i/></w:rPr><w:t>b</w:t></w:r>"
    for between in ("<w:bookmarkStart/>", " ", "<w:r><w:tab/></w:r>", b):
        assert merged(f"<w:p>{a}{between}{a}</w:p>") == f"<w:p>{a}{between}{a}</w:p>"
    assert merged(f"<w:p>{a}</w:p><w:p>{a}</w:p>") == f"<w:p>{a}</w:p><w:p>{a}</w:p>"


def test_first_attributes_and_space_stay():
    got = merged('<w:p><w:r w:id="1"><w:t>a</w:t></w:r><w:r w:id="2"><w:t xml:space="preserve"> b</w:t></w:r></w:p>')
    assert got == '<w:p><w:r w:id="1"><w:t xml:space="preserve">a b</w:t></w:r></w:p>'


def test_runs_outside_paragraphs_proper_stay():
    linked = "<w:p><w:hyperlink><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:hyperlink></w:p>"
    assert merged(linked) == linked


def test_operator(spark):
    xml = "<w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p>"
    row = lambda i, n: ("d", i, n, xml.encode(), 8, 2024, 1, 2, 3, 4, 6, 0o644, False)
    evs = docx.events(spark.createDataFrame([row(0, "word/a.xml"), row(1, "word/b.xml")], docx.ENTRIES))
    got = {r["name"]: r["data"].decode() for r in docx.serialized(runs.merged_runs(evs, ["*/a.xml"])).collect()}
    assert got == {"word/a.xml": "<w:p><w:r><w:t>ab</w:t></w:r></w:p>", "word/b.xml": xml}
    assert runs.merged_runs(evs.limit(0)).count() == 0
