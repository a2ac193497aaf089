"""The composed plans, the command line, recognition, pictures and PDF files."""

import io
import json
import sqlite3
import struct
import urllib.error
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta import cli, webui
from sedimenta.plans import notes as N
from sedimenta.plans import pipeline
from sedimenta.sources import files, pdf, pictures, recognition, sinks
from sedimenta.sources.config import Recognition


def png(pixels, kind=0):
    """A PNG file of an array of rows of RGB; every row with the same filter."""
    height, width, _ = pixels.shape
    rows, before = b"", np.zeros((width, 3), int)
    for row in pixels.astype(int):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        if kind == 4:
            a, b, c = abs(before - corner), abs(left - corner), abs(left + before - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))
        else:
            guess = [0 * row, left, before, (left + before) // 2][kind]
        rows += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


NOISE = np.random.default_rng(1).integers(0, 256, (60, 60, 3))
SOLID = np.full((400, 400, 3), 90)


def deck(pictures_=True):
    out = io.BytesIO()
    shape = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="950" cy="100"/></a:xfrm></p:spPr><p:txBody><a:p><a:t>{}</a:t></a:p></p:txBody></p:sp>'
    pic = '<p:pic><p:blipFill><a:blip r:embed="r1"/></p:blipFill></p:pic>' if pictures_ else ""
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", '<p xmlns:p="p"><p:sldSz cx="1000" cy="1000"/></p>')
        for n in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:spTree>{shape.format(f"Slide {n}")}{pic}</p:spTree></p:sld>')
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", f'<R><Relationship Id="r1" Target="../media/image{11 - n}.png"/></R>')
            z.writestr(f"ppt/media/image{11 - n}.png", png(NOISE))
    return out.getvalue()


def pdf_file(*texts, packed=True):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(texts))) + b"] /Count 1 >>", 3: b"<< /Type /Font >>"}
    for i, text in enumerate(texts):
        content = b"BT /F1 12 Tf (" + text.replace("(", "\\(").encode("cp1252") + b") Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET" if text else b""
        data = zlib.compress(content) if packed else content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


# Pictures ------------------------------------------------------------------------------------------------------------


def test_pictures_are_read_from_their_bytes(spark):
    for kind in range(5):
        assert np.array_equal(pictures._png(png(NOISE, kind)), NOISE)
    assert pictures.variances(png(SOLID)) == [0.0, 0.0, 0.0] and min(pictures.variances(png(np.repeat(np.repeat(NOISE[:10, :10], 6, 0), 6, 1)))) > 100
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(range(9)) + b"\0\0\0" + bytes(range(9)) + b"\0\0\0"
    assert pictures.size(bmp) == (3, 2) and pictures.variances(bmp) is not None
    assert pictures.size(b"GIF89a" + struct.pack("<HH", 7, 8)) == (7, 8)
    assert pictures.size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x09\0\x0a" + b"\0" * 20) == (10, 9)
    for broken in (b"", b"no picture", png(NOISE)[:40], b"BM" + b"\0" * 60):
        assert pictures.variances(broken) is None
    rows = [("noise.png", png(NOISE)), ("solid.png", png(SOLID) + b"\0" * 500), ("small.png", b"x"), ("low.bmp", bmp + b"\0" * 500), ("odd.tif", b"?" * 900), ("none.png", None)]
    verdicts = pictures.judged(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: r.reason for r in verdicts.collect()} == {"noise.png": "kept", "solid.png": "solid colour", "small.png": "too small", "low.bmp": "low resolution", "odd.tif": "unreadable, kept", "none.png": "missing"}
    assert {r.reason: r.pictures for r in pictures.reasons(verdicts).collect()} == {"solid colour": 1, "too small": 1, "low resolution": 1, "missing": 1}
    assert {r.path for r in pictures.worth(spark.createDataFrame(rows, "path string, content binary")).collect()} == {"noise.png", "odd.tif"}


def test_pictures_of_decks_are_named_by_slide_and_shape(spark):
    assert [n for n, _ in files.pptx_images(deck())] == ["slide1_img2.png", "slide2_img2.png", "slide3_img2.png"]
    found = spark.createDataFrame([("a/x.pptx", deck()), ("b.pptx", b"broken"), ("c.txt", b"")], "path string, content binary")
    assert [(r.file, r.position, r.name) for r in files.office_images(found).orderBy("position").collect()][0] == ("a/x.pptx", 0, "slide1_img2.png")
    layouts = files.deck_layouts(found).collect()
    assert len(layouts) == 1 and layouts[0].layouts[1] == ["标题(整页宽)", "图片"]


# PDF -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("packed", [True, False])
def test_text_of_pdf_pages(spark, packed):
    data = pdf_file("First (page", "", "caf\xe9", packed=packed)
    assert pdf.page_texts(data) == ["First (page\nsecond line", "", "café\nsecond line"]
    with pytest.raises(ValueError):
        pdf.page_texts(b"no file of this kind")
    found = spark.createDataFrame([("a.pdf", pdf_file("x" * 60, "y" * 60)), ("scan.pdf", pdf_file("", "")), ("bad.pdf", b"?")], "path string, content binary")
    pages = files.pdf_pages(found)
    assert pages.count() == 4
    assert {r.path: r.has_text_layer for r in files.text_layer(pages, "path", "text").collect()} == {"a.pdf": True, "scan.pdf": False}


def test_codes_of_fonts_are_read_by_their_maps():
    table = b"1 beginbfchar <0001> <4E2D> endbfchar 2 beginbfrange <0002> <0003> <0041> <0004> <0005> [<0062> <0063>] endbfrange"
    codes = pdf._unicode(table)
    assert pdf._read(bytes([0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 9]), codes) == "中ABbc"
    assert pdf._raw(rb"(a\(b\)\n\101\\)") == b"a(b)\nA\\" and pdf._raw(b"<414>") == b"A@"


def test_more_formats():
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="o/p.opf"/></c>')
        z.writestr("o/p.opf", '<p><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><itemref idref="a"/><itemref idref="b"/></p>')
        z.writestr("o/a.xhtml", "<h1>One</h1>")
        z.writestr("o/b.xhtml", "<p>Two</p>")
    assert files.epub_markdown(book.getvalue()) == "# One\n\nTwo"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("b/x.txt", "text")
        z.writestr("a.bin", "?")
    assert files.zip_markdown(packed.getvalue()) == "## File: b/x.txt\n\ntext"
    assert files.picture_markdown(png(NOISE)) == "ImageSize: 60x60" and files.picture_markdown(b"?") == ""


# Recognition ---------------------------------------------------------------------------------------------------------


def test_model_client_and_its_marks():
    sent = []

    def send(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body), timeout))
        return json.dumps({"choices": [{"message": {"content": None, "reasoning": "seen"}}]}).encode()

    client = recognition.ModelClient("u", "k", "m", send=send)
    assert client(png(NOISE)) == "seen"
    url, headers, body, timeout = sent[0]
    assert (url, headers["Authorization"], body["model"], timeout) == ("u", "Bearer k", "m", 60)
    assert body["messages"][1]["content"][0]["image_url"]["url"].startswith("data:image/png;base64,iVBOR")

    def failing(error):
        def send(*_):
            raise error
        return recognition.ModelClient("u", send=send)(b"")

    assert failing(urllib.error.HTTPError("u", 429, "Too Many", {}, None)) == "[图片识别失败: HTTP 429 Too Many]"
    assert failing(TimeoutError("late")) == "[图片识别失败: late]"
    assert recognition.ModelClient("u", send=lambda *_: b"{}")(b"").startswith("[图片解析失败")
    assert recognition.ModelClient("u", send=lambda *_: b"no json")(b"").startswith("[图片解析失败")
    assert recognition.CommandClient(command="no-such-command")(b"").startswith("[本地 OCR 失败")


def test_service_by_mode():
    assert recognition.service(Recognition()) is None
    assert isinstance(recognition.service(Recognition(enabled=True, mode="slide")), recognition.ModelClient)
    assert isinstance(recognition.service(Recognition(enabled=True, mode="local", language="deu")), recognition.CommandClient)
    with pytest.raises(NotImplementedError):
        recognition.service(Recognition(enabled=True, mode="hybrid"))


def test_pages_are_numbered_deduplicated_and_tried_again(spark):
    rows = [("f", "x/page2.png", b"2"), ("f", "y/page2.png", b"other"), ("f", "a.png", b"1"), ("f", "page10.png", b"10"), ("g", "page1.png", b"bad")]
    pages = spark.createDataFrame(rows, "file string, path string, content binary")
    assert [tuple(r)[:3] for r in recognition.numbered_pages(pages, "file").orderBy("file", "page").collect()] == [("f", 1, "a.png"), ("f", 2, "x/page2.png"), ("f", 10, "page10.png"), ("g", 1, "page1.png")]
    seen = {}

    def client(content):
        seen[content] = seen.get(content, 0) + 1
        return "" if content == b"bad" else "[图片识别失败: x]" if seen[content] < 3 else content.decode()

    said = {r.file: r.said for r in recognition.recognise_pages(pages, "file", client, waits=(0,)).collect()}
    assert said == {"f": {1: "1", 2: "2", 10: "10"}, "g": {1: "[图片识别失败: empty answer]"}}
    wanted = spark.createDataFrame([("f", 10)], "file string, page int")
    assert [r.said for r in recognition.recognise_pages(pages, "file", lambda c: "ok", wanted=wanted).collect()] == [{10: "ok"}]


# Plans ---------------------------------------------------------------------------------------------------------------

TEXT = "# Plan {0}\n\n## Goal\n\n- one\n- two\n\nThe architecture of the {1} and its database design are described here.\n\n```\ncode\n```\n" + "More words on {2} follow. " * 60


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "src"
    (root / "chapter 1").mkdir(parents=True)
    (root / "chapter 1" / "plan_v1.md").write_text(TEXT.format("alpha", "alpha", "alpha"))
    (root / "chapter 1" / "plan_v2.md").write_text(TEXT.format("beta", "gamma", "delta") + "The newer one.")
    (root / "copy.md").write_text(TEXT.format("alpha", "alpha", "alpha"))
    (root / "short.txt").write_text("few")
    (root / "deck.pptx").write_bytes(deck())
    (root / "paper.pdf").write_bytes(pdf_file("A paper " * 30))
    (root / "bad.docx").write_bytes(b"broken")
    (root / "logo.svg").write_text("<svg/>")
    (root / "data.bin").write_bytes(b"\0\1")
    return root


def test_convert_extract_export(spark, source, tmp_path):
    mirror, out = tmp_path / "mirror", tmp_path / "out"
    stats = pipeline.convert_tree(spark, str(source), str(mirror))
    assert stats == {"converted": 6, "copied": 1, "skipped": 1, "errors": 1, "images": 3, "existing": 0}
    made = (mirror / "deck.pptx.md").read_text()
    assert made.startswith("---\ntitle: \"deck\"") and "images_extracted: \"3\"" in made and (mirror / "deck.pptx_images" / "slide2_img2.png").read_bytes() == png(NOISE)
    assert (mirror / "data.bin").exists() and "skipped" in (mirror / "data.bin.md").read_text() and (mirror / "logo.svg").exists()
    assert "A paper" in (mirror / "paper.pdf.md").read_text() and not (mirror / "bad.docx.md").exists()
    again = pipeline.convert_tree(spark, str(source), str(mirror))
    assert again["existing"] == 8 and again["converted"] == 0 and again["errors"] == 1
    assert pipeline.convert_tree(spark, str(source), str(mirror), overwrite=True, formats=["MD"])["converted"] == 3
    dry = pipeline.extract_tree(spark, str(mirror), str(out), merge=True, dry_run=True)
    assert not out.exists()
    stats = pipeline.extract_tree(spark, str(mirror), str(out), merge=True, keep_deprecated=True)
    assert stats == dry and stats["kept"] >= 1 and stats["deduped"] >= 1 and stats["low_score"] >= 1
    written = sorted(str(p.relative_to(out)) for p in out.rglob("*.md"))
    assert any(p.startswith("deprecated/") for p in written) and sum(not p.startswith("deprecated/") for p in written) == stats["kept"]
    assert all("dk_score: " in p.read_text() and "dk_tags: [" in p.read_text() for p in out.rglob("*.md"))
    assert pipeline.extract_tree(spark, str(mirror), str(out), incremental=True)["kept"] <= stats["kept"]
    written = sorted(str(p.relative_to(out)) for p in out.rglob("*.md"))  # what was a duplicate stands alone among what is new
    got = pipeline.export_tree(spark, str(out), "obsidian", vault=str(tmp_path / "vault"))
    assert got == {"exported": len(written), "errors": 0} and len(list((tmp_path / "vault" / "sedimenta").rglob("*.md"))) == len(written)
    assert pipeline.export_tree(spark, str(out))["exported"] == len(written) and (tmp_path / "exported").is_dir()
    posted = pipeline.export_tree(spark, str(out), "notes", api_url="http://x", send=lambda *_: None)
    assert posted == {"exported": len(written), "errors": 0}
    for lacking in ("obsidian", "notes"):
        with pytest.raises(ValueError):
            pipeline.export_tree(spark, str(out), lacking)


def test_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert set(pipeline.convert_tree(spark, str(tmp_path / "none"), str(tmp_path / "m")).values()) == {0}


def test_recognised_pictures_and_pages(spark, source, tmp_path):
    stats = pipeline.convert_tree(spark, str(source), str(tmp_path / "m"), formats=["pptx"], client=lambda data: "a chart", waits=())
    assert stats["converted"] == 1 and stats["images"] == 3
    (source / "scan.pdf").write_bytes(pdf_file("", ""))
    render = lambda path, data: [b"p1", b"p2"]
    told = lambda data: "[DK-标题]T[DK-正文]B" if data == b"p1" else "[图片识别失败: x]"
    pipeline.convert_tree(spark, str(source), str(tmp_path / "s"), formats=["pptx", "pdf"], client=told, pages=True, renderer=render, layout=True, waits=())
    made = (tmp_path / "s" / "deck.pptx.md").read_text()
    assert "📊 **T**" in made and "整页理解" in made and "版式" in made
    assert "<!-- Slide number: 2 -->" in (tmp_path / "s" / "scan.pdf.md").read_text() and "A paper" in (tmp_path / "s" / "paper.pdf.md").read_text()
    asked = []

    def mend(data):
        return "[DK-标题]New[DK-正文]Body"

    got = pipeline.retry_slide(spark, str(tmp_path / "s" / "deck.pptx.md"), mend, renderer=lambda path, data: asked.append(path) or [b"p1", b"p2"], waits=())
    assert got == {"tried": 1, "mended": 1} and "📊 **New**" in (tmp_path / "s" / "deck.pptx.md").read_text() and "📊 **T**" in (tmp_path / "s" / "deck.pptx.md").read_text()
    assert pipeline.retry_slide(spark, str(tmp_path / "s" / "deck.pptx.md"), mend) == {"tried": 0, "mended": 0}
    with pytest.raises(ValueError):
        pipeline.retry_slide(spark, str(source / "copy.md"), mend)


@pytest.fixture
def store(tmp_path):
    db = tmp_path / "notes.db"
    c = sqlite3.connect(db)
    c.executescript("CREATE TABLE workspaces (id INTEGER PRIMARY KEY, name TEXT, created_at TEXT); CREATE TABLE notes (id INTEGER PRIMARY KEY, workspace_id INT, title TEXT, content TEXT, created_at TEXT, updated_at TEXT);"
                    "CREATE TABLE tags (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE note_tags (note_id INT, tag_id INT, UNIQUE (note_id, tag_id));")  # fmt: skip
    c.commit()
    c.close()
    return str(db)


def test_store_without_a_tags_column_and_reports(spark, store, tmp_path):
    rows = [("a.md", '---\ntitle: "A"\ndk_tags: ["x", "y"]\n---\n\nalpha beta gamma delta epsilon'), ("b.md", '---\ntitle: "B"\ndk_tags: ["x"]\n---\n\nalpha beta gamma delta epsilon zeta'), ("c.md", "other words entirely"), ("d.md", "nothing like them"), ("a2.md", '---\ntitle: "A"\n---\n\nalpha beta gamma delta epsilon')]
    docs = spark.createDataFrame(rows, "path string, content string")
    assert sinks.to_sqlite(docs, store, "default") == {"exported": 4, "existing": 1}
    assert sinks.to_sqlite(docs, store, "default") == {"exported": 0, "existing": 5}
    assert sinks.to_sqlite(docs.limit(1), store, "other") == {"exported": 1, "existing": 0}
    reports = pipeline.post_reports(spark, store, dedup=True, consolidate=True)
    assert set(reports) == {"duplicates", "topics", "merges", "stale"}
    group = reports["duplicates"].collect()
    assert len(group) == 1 and group[0].notes == 2 and group[0].titles == "A, B" and group[0].common_tags == "x" and 0.6 <= group[0].similarity < 1
    assert pipeline.post_reports(spark, None, dedup=True) == {} and pipeline.post_reports(spark, str(tmp_path / "no.db"), dedup=True) == {}


def test_groups_of_like_notes(spark):
    notes = spark.createDataFrame([(i, f"T{i}", "the same words of one note") for i in range(5)] + [(9, None, None), (10, None, ""), (11, "x", "far away")], "id long, title string, content string")
    links = spark.createDataFrame([(i, t) for i in range(5) for t in range(1, 8)] + [(0, 9)], "note_id long, tag_id long")
    tags = spark.createDataFrame([(t, f"t{t}") for t in range(1, 10)], "id long, name string")
    got = N.similar_groups(notes, links, tags).collect()
    assert len(got) == 1 and got[0].notes == 5 and got[0].titles == "T0, T1, T2 (+2)" and got[0].common_tags == "t1, t2, t3, t4, t5"
    assert N.similar_groups(notes.limit(0), links, tags).count() == 0


def test_commands(spark, source, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda cores: spark)
    out = str(tmp_path / "k")
    assert cli.main(["convert", str(source), "--dry-run"]) == 0 and "'to_convert': 7" in capsys.readouterr().out
    assert cli.main(["pipeline", str(source), "-o", out, "--format", "md", "-t", "obsidian"]) == 0  # no vault: the export is left out
    assert "'export'" not in capsys.readouterr().out and not (tmp_path / "k_workspace").exists() and any((tmp_path / "k").rglob("*.md"))
    assert cli.main(["export", out, "-t", "obsidian"]) == 1 and cli.main(["export", str(tmp_path / "none")]) == 2
    assert cli.main(["export", out, "-t", "markdown", "-o", str(tmp_path / "e")]) == 0 and any((tmp_path / "e").rglob("*.md"))
    assert cli.main(["extract", out, "--dry-run", "--simhash"]) == 0
    assert cli.main(["convert", str(source), "--ocr", "hybrid"]) == 1
    assert cli.main(["retry-slide", str(source / "copy.md")]) == 1


def test_web_page_builds_command_lines(monkeypatch):
    assert webui.argv("extract", {"source": "a b", "--merge": "1", "--threshold": "0.9", "--output": " ", "--evil": "x"}) == ["extract", "a b", "--threshold=0.9", "--merge"]
    for command, values in (("webui", {"source": "x"}), ("convert", {})):
        with pytest.raises(ValueError):
            webui.argv(command, values)
    assert all(f'action="/{c}"' in webui.page("<x>") for c in webui.FORMS) and "&lt;x&gt;" in webui.page("<x>")
