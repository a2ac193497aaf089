"""Front matter, image references, slides, conversion and sinks, on small inputs with exact outputs."""

import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from sedimenta.functions import frontmatter, images, slides
from sedimenta.sources import config, files, recognition, sinks


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first().x


def test_body(spark):
    cases = {"---\na\n---\nb": "b", "---\r\na\r\n---\r\nb": "b", "a\n---\nb": "a\n---\nb", "---\na": "---\na", "": "", "---\n---\nx": "x", "---\na\n---": ""}
    df = spark.createDataFrame(list(cases.items()), "c string, b string")
    assert all(r.b == r.x for r in df.select("b", frontmatter.body(F.col("c")).alias("x")).collect())


def test_render_and_parse(spark):
    c = lambda v: F.lit(v)
    text = one(spark, frontmatter.render(c("T"), c("a/b.pdf"), c("b.pdf"), c("pdf"), c("converted"), c("2026"), c(""), {"k": c("v")}), z=1)
    assert text == '---\ntitle: "T"\nsource: "file:///a/b.pdf"\nsource_relative: "b.pdf"\nconverted_at: "2026"\noriginal_format: "pdf"\nconversion_status: "converted"\nk: "v"\n---\n'
    skipped = one(spark, frontmatter.render(c("T"), c("x.bin"), c(""), c("bin"), c("skipped"), c("2026"), c("9")), z=1)
    assert skipped.endswith('file_size: "9"\n---\n# T\n\n> ⚠️ 此文件类型为 `.bin`，暂不支持转换。\n> [打开源文件](file:///x.bin)')
    parsed = one(spark, frontmatter.parse(F.col("t"), F.lit("p/stem.docx.md")), t='---\ntitle: "A"\ndk_tags: ["x", "y"]\n---\n\n body \n')
    assert (parsed.title, parsed.tags, parsed.body) == ("A", ["x", "y"], "body")
    bare = one(spark, frontmatter.parse(F.col("t"), F.lit("p/stem.docx.md")), t="body")
    assert (bare.title, bare.tags, bare.body) == ("stem.docx", [], "body")


def test_scores_in_front_matter(spark):
    detail = F.struct(*(F.lit(x).alias(n) for n, x in zip(("length", "structure", "freshness", "keywords", "uniqueness"), (0.05, 0.15, 50.0, 0.25, 20.0))))
    lines = "\ndk_score: 7\ndk_score_detail:\n  length: 0.1\n  structure: 0.1\n  freshness: 50.0\n  keywords: 0.2\n  uniqueness: 20.0\ndk_tags: [{}]\n"
    tagged = one(spark, frontmatter.with_scores(F.col("t"), F.lit(7), detail, F.array(F.lit("a"), F.lit("b"))), t="---\nk: v\n---\nbody")
    assert tagged == "---\nk: v" + lines.format('"a", "b"') + "---\n\nbody"
    empty = one(spark, frontmatter.with_scores(F.col("t"), F.lit(7), detail, F.array().cast("array<string>")), t="body")
    assert empty == "---\n" + lines.format("") + "---\n\nbody"


def test_vault(spark):
    new = one(spark, frontmatter.for_vault(F.col("t"), F.lit("a/n.md"), F.lit("2026-01-01")), t="body")
    assert new == '---\ntitle: "n"\ncreated: "2026-01-01"\ntags: []\n---\n\nbody'
    text = "---\ndk_tags: [\"x\"]\n---\nbody"
    assert one(spark, frontmatter.for_vault(F.col("t"), F.lit("n.md"), F.lit("D")), t=text) == '---\ndk_tags: ["x"]\ntags: []\ncreated: "D"\n---\n\nbody'
    assert one(spark, frontmatter.for_vault(F.col("t"), F.lit("n.md"), F.lit("D"), False), t=text) == '---\ndk_tags: ["x"]\ncreated: "D"\n---\n\nbody'


def test_images(spark):
    text = "a ![x](1.jpg) b ![w](http://w/2.jpg) c ![](1.jpg)\n![](../up.png)"
    mapped = one(spark, images.image_map(F.col("t"), F.array(F.lit("i1.png"), F.lit("i2.png")), F.lit("d.docx")), t=text)
    assert [(m.ref, m.new_path) for m in mapped] == [("1.jpg", "d.docx_images/i1.png"), ("1.jpg", "d.docx_images/i2.png")]
    replaced = one(spark, images.replace_references(F.col("t"), images.image_map(F.col("t"), F.array(F.lit("i1.png"), F.lit("i2.png")), F.lit("d"))), t=text)
    assert replaced == "a ![x](d_images/i1.png) b ![w](http://w/2.jpg) c ![](d_images/i2.png)\n![](../up.png)"
    assert one(spark, images.rebase(F.col("t"), F.lit("p/q/f.md"), "m"), t=text) == "a ![x](../../../m/p/q/1.jpg) b ![w](http://w/2.jpg) c ![](../../../m/p/q/1.jpg)\n![](../up.png)"
    assert one(spark, images.strip_references(F.col("t")), t="a ![x](1) b") == "a  b"
    assert one(spark, images.drop_positions(F.col("t"), F.array(F.lit(1))), t=text) == "a ![x](1.jpg) b ![w](http://w/2.jpg) c \n![](../up.png)"
    said = F.create_map(F.lit("i2.png"), F.lit("two.jpg text"))
    injected = one(spark, images.inject_recognised(F.col("t"), images.image_map(F.col("t"), F.array(F.lit("i1.png"), F.lit("i2.png")), F.lit("d")), said), t=text)
    assert injected == text.replace("c ![](1.jpg)", "c ![](1.jpg)\n\n> 📷 **图片识别**: two.jpg text")
    df = spark.createDataFrame([("image10.png",), ("image2.png",), ("cover.jpg",)], "n string")
    assert [r.n for r in df.orderBy(images.sort_key(F.col("n"))).collect()] == ["image2.png", "image10.png", "cover.jpg"]


def test_slides(spark):
    good = "[DK-标题]T[DK-结构]S[DK-概述]O[DK-正文]B [DK-标题] stays"
    parsed = one(spark, slides.parse_page(F.col("t")), t=good)
    assert (parsed.title, parsed.structure, parsed.overview, parsed.body) == ("T", "S", "O", "B [DK-标题] stays")
    for bad in ("[DK-标题]T", "[DK-正文]  ", "[图片识别失败: x][DK-正文]B", ""):
        assert one(spark, slides.parse_page(F.col("t")), t=bad) is None
    text = "<!-- Slide number: 1 -->\none\n<!-- Slide number: 2 -->\ntwo\n<!-- Slide number: 3 -->\nthree"
    said = F.create_map(F.lit(1), F.lit(good), F.lit(2), F.lit("[图片识别失败: x]"))
    done = one(spark, slides.inject_pages(F.col("t"), said), t=text)
    assert done.startswith("<!-- Slide number: 1 -->\n\n📊 **T**（S）\n\n**概述**：O\n\nB [DK-标题] stays\n\n<details><summary>markitdown 原文（兜底参考）</summary>\none\n</details>\n<!-- Slide number: 2 -->\ntwo\n\n> 📊 **整页理解**: ⚠️")
    assert done.endswith("<!-- Slide number: 3 -->\nthree")
    assert one(spark, slides.failed_pages(F.col("t")), t=done) == [2]
    again = one(spark, slides.update_pages(F.col("t"), F.create_map(F.lit(2), F.lit("[DK-正文]new"))), t=done)
    assert "<!-- Slide number: 2 -->\n\nnew\n\n<details>" in again and "⚠️" not in again
    layout = one(spark, slides.inject_layout(F.col("t"), F.create_map(F.lit(2), F.array(F.lit("标题"), F.lit("正文")))), t=text)
    assert layout == text.replace("number: 2 -->", "number: 2 -->\n> 🗂 **版式**: 标题 · 正文")
    assert one(spark, slides.page_number(F.col("t")), t="x/page12.png") == 12 and one(spark, slides.page_number(F.col("t")), t="p.png") == 0


def deck():
    ns = 'xmlns:p="p" xmlns:a="a"'
    shape = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="95" cy="10"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:txBody></p:sp>'
    body = '<p:sp><p:spPr><a:xfrm><a:off x="60" y="60"/><a:ext cx="30" cy="20"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>Text</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldSz cx="100" cy="100"/></p:presentation>')
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{shape}{body}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def test_convert_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.HTML").write_text("<html><head><title>t</title><style>x{}</style></head><body><h1>Hi</h1><p>a <b>b</b> &amp; <a href='u'>l</a></p><ul><li>1<li>2</ul><script>no()</script></body></html>")
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1,a|b\n2\n")
    (tmp_path / "c.ipynb").write_text('{"cells":[{"cell_type":"markdown","source":["# N"]},{"cell_type":"code","source":"1+1"}]}')
    (tmp_path / "d.pptx").write_bytes(deck())
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.svg").write_text("<svg/>")
    (tmp_path / "g.bin").write_text("x")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.convert(files.scan(spark, str(tmp_path))).collect()}
    assert {k: v.status for k, v in rows.items()} == {"a.HTML": "converted", "b.csv": "converted", "c.ipynb": "converted", "d.pptx": "converted", "e.docx": "error", "f.svg": "copied", "g.bin": "skipped", "h.pdf": "error"}
    assert rows["a.HTML"].markdown == "# Hi\n\na **b** & [l](u)\n\n- 1\n- 2"
    assert rows["b.csv"].markdown == "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    assert rows["c.ipynb"].markdown == "# N\n\n```python\n1+1\n```"
    assert rows["d.pptx"].markdown == "<!-- Slide number: 1 -->\n# Head\n\nText"
    shapes = spark.createDataFrame(files.pptx_shapes(deck()), "page int, number int, kind int, placeholder string, chart boolean, `rows` int, columns int, text string, left long, top long, width long, height long, slide_width long, slide_height long")
    facts = F.struct("placeholder", "chart", "rows", "columns", "kind", "text")
    box = [F.col(c) for c in ("left", "top", "width", "height", "slide_width", "slide_height")]
    assert [(r.a, r.b) for r in shapes.orderBy("number").select(slides.shape_role(facts).alias("a"), slides.shape_region(*box).alias("b")).collect()] == [("标题", "整页宽"), ("正文", "右栏")]
    assert files.scan(spark, str(tmp_path), recursive=False).count() == 7


def test_text_layer_rules(spark):
    pages = spark.createDataFrame([("a", "x" * 60), ("a", " " * 500), ("b", "x" * 60), ("b", "x" * 60), ("c", None)], "f string, t string")
    assert {r.f: r.has_text_layer for r in files.text_layer(pages, "f", "t").collect()} == {"a": False, "b": True, "c": False}
    df = spark.createDataFrame([("x.pdf", "", False), ("x.pdf", "", None), ("x.doc", "", False), ("x.PDF", "y" * 60, False)], "p string, t string, l boolean")
    assert [r.x for r in df.select(files.needs_recognition(F.col("p"), F.col("t"), F.col("l")).alias("x")).collect()] == [True, False, False, False]


def test_recognition(spark):
    images_ = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")

    def client(content):
        if content == b"2":
            raise RuntimeError("down")
        return "seen"

    got = {r.path: r.said for r in recognition.recognise(images_, client, waits=()).collect()}
    assert got == {"a": "seen", "b": "[图片识别失败: down]"}
    rule = recognition.worth_recognising(F.col("n"), F.col("w"), F.col("h"), F.col("v"))
    df = spark.createDataFrame([(None, 9, 9, None), (10, 99, 99, None), (999, 9, 99, None), (999, None, None, None), (999, 99, 99, [1.0, 2.0, 3.0]), (999, 99, 99, [1.0, 20.0, 3.0])], "n int, w int, h int, v array<double>")
    assert [r.x.keep for r in df.select(rule.alias("x")).collect()] == [False, False, False, True, False, True]


def test_config(monkeypatch, tmp_path):
    monkeypatch.setenv("SOME_KEY", "k")
    raw = {"recognition": {"mode": "odd", "model": {"key": "${SOME_KEY}", "url": "${NOT_SET}", "name": "x${SOME_KEY}"}}, "tags": ["${SOME_KEY}"], "min_score": 5}
    assert config.resolve(raw)["tags"] == ["${SOME_KEY}"]
    made = config.build(config.resolve(raw))
    assert (made.recognition.mode, made.recognition.model.key, made.recognition.model.url, made.recognition.model.name, made.min_score) == ("cloud", "k", "", "x${SOME_KEY}", 5)
    assert config.load(str(tmp_path / "none.yaml")) == config.Config()


def test_trees_and_stores(spark, tmp_path):
    df = spark.createDataFrame([("a/x.md", '---\ntitle: "A"\ndk_tags: ["t", "u"]\n---\nbody'), ("../out.md", "no"), ("y.md", None)], "relative string, content string")
    done = {r.path: r.status for r in sinks.write_tree(df, str(tmp_path / "tree")).collect()}
    assert done == {"a/x.md": "exported", "../out.md": "error", "y.md": "exported"}
    assert (tmp_path / "tree" / "a" / "x.md").read_text().endswith("body")
    store = tmp_path / "n.db"
    con = sqlite3.connect(store)
    con.executescript("CREATE TABLE workspaces(id INTEGER PRIMARY KEY, name TEXT, created_at TEXT); CREATE TABLE notes(id INTEGER PRIMARY KEY, workspace_id INT, title TEXT, content TEXT, tags TEXT, created_at TEXT, updated_at TEXT); CREATE TABLE tags(id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE note_tags(note_id INT, tag_id INT, UNIQUE(note_id, tag_id)); INSERT INTO tags(name) VALUES ('t')")
    con.close()
    notes = spark.createDataFrame([("a.md", '---\ntitle: "A"\ndk_tags: ["t", "u"]\n---\nbody')], "path string, content string")
    assert sinks.to_sqlite(notes, str(store), "w") == {"exported": 1, "existing": 0}
    assert sinks.to_sqlite(notes, str(store), "w") == {"exported": 0, "existing": 1}
    con = sqlite3.connect(store)
    assert con.execute("SELECT title, content, tags FROM notes").fetchall() == [("A", "body", '["t", "u"]')]
    assert con.execute("SELECT name FROM tags ORDER BY id").fetchall() == [("t",), ("u",)] and con.execute("SELECT count(*) FROM note_tags").fetchone() == (2,)
    assert sinks.missing_columns({"notes": []}) == ["missing table note_tags", "missing table tags", "missing table workspaces"]
    assert sinks.missing_columns({t: c[:-1] for t, c in sinks.REQUIRED.items()})[0] == "missing column note_tags.tag_id"

    def send(url, key, note):
        if note["title"] != "A" or not url.endswith("/api/notes"):
            raise ConnectionError("refused")

    assert [r.status for r in sinks.to_notes_api(notes, "http://h", send=send).collect()] == ["exported"]
    assert [r.status for r in sinks.to_notes_api(notes.withColumn("content", F.lit("x")), "http://h", send=send).collect()] == ["error"]
    rows = sinks.note_rows(notes, "path", "content", 1, 10, "now").collect()
    assert (rows[0].id, rows[0].title, rows[0].tags) == (10, "A", '["t","u"]')


def test_scan_markdown(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x\n\ny")
    (tmp_path / "b.txt").write_text("no")
    rows = files.markdown(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in rows] == [("a.md", "x\n\ny")]
