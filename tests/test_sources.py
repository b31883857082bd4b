"""Readers and writers on small files."""

import gzip
import io
import json
import zipfile

import pytest

from lexforge.sources import corpus, docx, sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text, *properties, deleted=False):
    tag = "delText" if deleted else "t"
    return f"<w:r><w:rPr>{''.join(properties)}</w:rPr><w:{tag} xml:space='preserve'>{text}</w:{tag}></w:r>"


def paragraph(*runs, style=None):
    return f"<w:p><w:pPr>{f'<w:pStyle w:val={style!r}/>' if style else ''}</w:pPr>{''.join(runs)}</w:p>"


HIDE, SHOW = "<w:vanish/>", '<w:vanish w:val="0"/>'


def archive(**members) -> bytes:
    """A file whose members are given by the last part of their names, each as the XML inside its root element."""
    roots = {"document": "document", "footnotes": "footnotes", "comments": "comments", "styles": "styles"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, inner in members.items():
            path, text = (f"word/{name}.xml", f"<w:{roots[name]} {NS}>{inner}</w:{roots[name]}>") if name in roots else (f"docProps/{name}.xml", inner)
            z.writestr(path, text)
    return out.getvalue()


def document() -> bytes:
    letter = paragraph(run("Frau Anna "), run("Mus", "<w:b/>"), run("ter"), run(" klagt."))
    changed = paragraph(f"<w:del>{run('alt', deleted=True)}</w:del>", run("geheim", HIDE), run("neu"))
    return archive(
        document=f"<w:body>{letter}{changed}</w:body>",
        footnotes=f'<w:footnote w:type="continuationSeparator" w:id="-1">{paragraph(run("Strich"))}</w:footnote><w:footnote w:id="1">{paragraph(run("Note"))}</w:footnote>',
        comments=f'<w:comment w:id="3">{paragraph(run("Bemerkung"))}</w:comment>',
        core="<c><a>Anna Muster</a></c>",
    )


def test_hiding_comes_from_run_style_paragraph_and_defaults():
    styles = (
        f'<w:docDefaults><w:rPrDefault><w:rPr>{SHOW}</w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="usual"/>'
        f'<w:style w:styleId="c"><w:basedOn w:val="b"/></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/></w:style><w:style w:styleId="a"><w:rPr>{HIDE}</w:rPr></w:style>'
        f'<w:style w:styleId="loop"><w:basedOn w:val="loop"/></w:style><w:style w:styleId="open"><w:basedOn w:val="a"/><w:rPr>{SHOW}</w:rPr></w:style>'
    )
    body = paragraph(run("p1"), style="c") + paragraph(run("p2", SHOW), run("p3", '<w:rStyle w:val="open"/>'), run("p4"), style="c")
    body += paragraph(run("p5", '<w:rStyle w:val="b"/>'), run("p6", '<w:rStyle w:val="loop"/>')) + paragraph(f"<w:moveFrom>{run('p7')}</w:moveFrom>", f"<w:moveTo>{run('p8')}</w:moveTo>")
    got = {(r["part"], r["text"]) for r in docx.read_parts(archive(document=f"<w:body>{body}</w:body>", styles=styles))}
    assert got == {("hidden", "p1"), ("body", "p2p3"), ("hidden", "p4"), ("hidden", "p5"), ("body", "p6"), ("deleted", "p7"), ("body", "p8")}
    usual = styles.replace('w:styleId="usual"/>', f'w:styleId="usual"><w:rPr>{HIDE}</w:rPr></w:style>')
    assert [r["part"] for r in docx.read_parts(archive(document=f"<w:body>{paragraph(run('x'))}</w:body>", styles=usual))] == ["hidden"]


def test_every_surface_is_read(spark):
    rows = docx.parts(spark.createDataFrame([("/x/brief.docx", document()), ("/x/broken.docx", b"no zip")], "path string, content binary")).collect()
    got = {(r.part, r.text) for r in rows}
    assert {("body", "Frau Anna Muster klagt."), ("body", "neu"), ("deleted", "alt"), ("hidden", "geheim"), ("footnote", "Note"), ("comment", "Bemerkung"), ("property", "Anna Muster"), ("filename", "brief.docx")} <= got


def test_redacted_copy(spark):
    files = spark.createDataFrame([("/x/brief.docx", document())], "path string, content binary")
    places = spark.createDataFrame([("/x/brief.docx", "word/document.xml", 0, 5, 16, "A.____")], "path string, file string, index int, start int, end int, label string")
    copy = docx.copies(files, places).first().content
    texts = [(r["part"], r["text"]) for r in docx.read_parts(bytes(copy))]
    assert texts == [("body", "Frau A.____ klagt."), ("body", "neu"), ("footnote", "Note")]
    assert bytes(docx.copies(files, places).first().content) == bytes(copy)


def test_cite_list_is_reproducible(spark, tmp_path):
    rows = spark.createDataFrame([("B", "c", "C", "2001-01-01", ["1"], "d2"), ("A", "c", "C", "2000-01-01", [], "d\t1")], "key string, court string, canton string, date string, enums array<string>, id string")
    first = sinks.cite_list(rows, f"file://{tmp_path}", "2024-05-01T00:00:00Z")
    second = sinks.cite_list(rows.repartition(3), f"file://{tmp_path}", "2024-05-01T00:00:00Z")
    assert first == second and json.loads((tmp_path / "index.json").read_text())["labels"] == 2
    lines = gzip.decompress((tmp_path / first["file"]).read_bytes()).decode().split("\n")
    assert lines[1:3] == ["A\tc\tC\t2000-01-01\t\td 1", "B\tc\tC\t2001-01-01\t1\td2"]
    back = corpus.headed_tsv(spark, str(tmp_path / first["file"]), "#cite-index 1", ("key", "court"))
    assert [r.key for r in back.collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        corpus.headed_tsv(spark, str(tmp_path / first["file"]), "#other", ("key",))


def test_gap_filled_and_names(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "court string, n int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "court string, n int")
    assert sorted(map(tuple, corpus.gap_filled(a, b, "court").collect())) == [("x", 1), ("y", 3)]
    (tmp_path / "n.csv").write_text("﻿TIME_PERIOD,LASTNAME,VALUE\n2020,Muster,5\n2020,Muster,2\n2020,Rest,\n", encoding="utf-8")
    assert [tuple(r) for r in corpus.surname_csv(spark, str(tmp_path / "n.csv")).collect()] == [("Muster", 7)]
    (tmp_path / "l.tsv").write_text('"Anna"@de\nnoise\n')
    assert [r.name for r in corpus.quoted_labels(spark, str(tmp_path / "l.tsv")).collect()] == ["Anna"]
    assert corpus.table_or_empty(spark, "no_such_table").count() == 0


def test_lines_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 50)}" for k in range(3000)]
    (tmp_path / "a.txt").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = corpus.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [r.text for r in sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.paragraph)]
    assert of("a.txt") == lines and of("b.txt") == ["one", "", "two"]
    assert sorted(r.paragraph for r in rows if r.file.endswith("a.txt")) == list(range(3000))


def test_every_file_of_a_list_starts_with_its_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#list 1\nx\t1\n#note\n")
    (tmp_path / "b.tsv").write_text("#list 1\ny\t2\n")
    read = lambda: sorted(map(tuple, corpus.headed_tsv(spark, str(tmp_path), "#list 1", ("name", "n")).collect()))
    assert read() == [("x", "1"), ("y", "2")]
    (tmp_path / "c.tsv").write_text("z\t3\n#list 1\n")
    with pytest.raises(ValueError, match="does not start"):
        read()


def test_a_kept_table_is_made_anew_when_its_input_has_changed(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(3).coalesce(1).write.parquet(source)
    assert sinks.kept(spark.read.parquet(source), path).count() == 3
    first = (tmp_path / "kept.version").read_text()
    assert sinks.kept(spark.read.parquet(source), path).count() == 3 and (tmp_path / "kept.version").read_text() == first
    spark.range(5).coalesce(1).write.mode("append").parquet(source)
    assert sinks.kept(spark.read.parquet(source), path).count() == 8 and (tmp_path / "kept.version").read_text() != first
