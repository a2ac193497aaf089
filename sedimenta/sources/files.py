"""Scans of source folders and of Markdown mirrors, and the conversion of files to Markdown.

Conversion reads ``binaryFile`` rows in Arrow batches. Text, Markdown, CSV, HTML, notebooks, PDF text, e-books, archives,
picture and sound headers and the office formats that are zip archives of XML are read with the standard library; other
formats come out with status ``error`` and can be given a converter of the caller's in the registry.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import slides
from sedimenta.sources import pdf, pictures

# Extensions that are converted, and images that are copied only where they are not among these.
SUPPORTED = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "epub", "csv", "txt", "md", "png", "jpg", "jpeg", "gif", "bmp", "webp", "mp3", "wav", "m4a", "zip", "msg", "ipynb"]
IMAGES = ["png", "jpg", "jpeg", "gif", "bmp", "webp", "svg"]
#: Characters per page from which a PDF counts as having a text layer, and below which its text is not taken.
TEXT_LAYER = 50


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of all files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content, modified_at`` of all Markdown files below a folder, each as one row."""
    reader = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))


def extension(path: Column) -> Column:
    """The lower-cased extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def classify(path: Column, formats: list[str] | None = None) -> Column:
    """convert, copy or skip by extension; null for a file that the wanted formats leave out."""
    ext = extension(path)
    kind = F.when(ext.isin(SUPPORTED), "convert").when(ext.isin(IMAGES), "copy").otherwise("skip")
    return kind if not formats else F.when(ext.isin([f.lower().lstrip(".") for f in formats]), kind)


def path_order(path: Column) -> Column:
    """Orders paths part by part."""
    return F.split(path, "/")


def text_layer(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``key, has_text_layer``: at least 50 characters a page on average; a file without pages has none."""
    size = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\A\s+|\s+\z", ""))
    return pages.groupBy(key).agg((F.try_divide(F.sum(size), F.count(text)) >= TEXT_LAYER).alias("has_text_layer")).select(key, F.coalesce("has_text_layer", F.lit(False)).alias("has_text_layer"))


def needs_recognition(path: Column, text: Column, has_text_layer: Column) -> Column:
    """Whether a PDF goes through page recognition: hardly any text and no text layer; an unknown layer counts as one."""
    return (extension(path) == "pdf") & (F.length(F.trim(F.coalesce(text, F.lit("")))) < TEXT_LAYER) & ~F.coalesce(has_text_layer, F.lit(True))


# Converters ----------------------------------------------------------------------------------------------------------


class _Page(HTMLParser):
    """HTML to Markdown: headings, paragraphs, links, images, lists, tables, emphasis and code; no scripts, no styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []
        self.lists: list[list] = []
        self.cells: list[str] | None = None
        self.row_at: int | None = None
        self.rows = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        get = dict(attrs).get
        if tag in ("script", "style", "head", "noscript", "template"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote", "pre"):
            self.out.append("\n\n" + {"blockquote": "> ", "pre": "```\n"}.get(tag, ""))
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.links.append(get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{get('alt') or ''}]({get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.out.append("" if self.lists else "\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if top[0] == "ul" else f"{top[1]}. "))
        elif tag == "tr":
            self.out.append("\n|")
            self.rows, self.row_at = self.rows + 1, len(self.out)
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "pre":
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "tr" and self.rows == 1 and self.row_at is not None:
            self.out.append("\n|" + " --- |" * sum(x == " |" for x in self.out[self.row_at :]))
        elif tag == "table":
            self.rows = 0
        elif tag == "title":
            pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_markdown(data: bytes) -> str:
    """HTML as Markdown."""
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    text = re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", "".join(page.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def csv_markdown(data: bytes) -> str:
    """CSV as a Markdown table; short rows are filled with empty cells."""
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def notebook_markdown(data: bytes) -> str:
    """A notebook's Markdown cells as they are and its code cells as fenced blocks."""
    cells = []
    for cell in json.loads(data.decode("utf-8", "replace")).get("cells", []):
        text = cell.get("source", "")
        text = "".join(text) if isinstance(text, list) else text
        cells.append(f"```python\n{text}\n```" if cell.get("cell_type") == "code" else text)
    return "\n\n".join(c for c in cells if c.strip())


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_markdown(data: bytes) -> str:
    """Paragraphs of a Word file, headings by their style, tables as Markdown tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = next(e for e in _xml(archive, "word/document.xml").iter() if _local(e.tag) == "body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    out = []
    for block in body:
        if _local(block.tag) == "tbl":
            rows = [[text_of(c) for c in row if _local(c.tag) == "tc"] for row in block.iter() if _local(row.tag) == "tr"]
            for i, row in enumerate(rows):
                out.append("| " + " | ".join(row) + " |" + ("\n|" + " --- |" * len(row) if not i else ""))
            continue
        style = next((v for e in block.iter() if _local(e.tag) == "pStyle" for v in e.attrib.values()), "")
        level = re.search(r"(?i)heading\s*(\d)", style)
        text = text_of(block)
        if text.strip():
            out.append("#" * int(level.group(1)) + " " + text if level else text)
    return "\n\n".join(out)


def _slide_names(archive: zipfile.ZipFile) -> list[str]:
    names = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    return sorted(names, key=lambda n: int(re.search(r"\d+", n).group()))


def pptx_shapes(data: bytes) -> list[dict]:
    """The shapes of a slide deck with the facts that roles and regions are told by."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        size = next((e.attrib for e in _xml(archive, "ppt/presentation.xml").iter() if _local(e.tag) == "sldSz"), {})
        for page, name in enumerate(_slide_names(archive), 1):
            tree = next((e for e in _xml(archive, name).iter() if _local(e.tag) == "spTree"), ())
            for number, shape in enumerate((s for s in tree if _local(s.tag) in ("sp", "pic", "graphicFrame", "grpSp")), 1):
                find = lambda tag, shape=shape: next((e for e in shape.iter() if _local(e.tag) == tag), None)
                off, ext, ph, table = find("off"), find("ext"), find("ph"), find("tbl")
                kinds = {"pic": 13, "grpSp": 6}
                place = {"title": "TITLE", "ctrTitle": "CENTER_TITLE", "subTitle": "SUBTITLE"}
                box = lambda e, k: int(e.attrib[k]) if e is not None and k in e.attrib else None
                rows = [r for r in table if _local(r.tag) == "tr"] if table is not None else None
                out.append({
                    "page": page, "number": number, "kind": kinds.get(_local(shape.tag), 1),
                    "placeholder": None if ph is None else place.get(ph.attrib.get("type", ""), "BODY"), "chart": find("chart") is not None,
                    "rows": None if rows is None else len(rows), "columns": None if rows is None else sum(_local(g.tag) == "gridCol" for g in table.iter()),
                    "text": "\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in shape.iter() if _local(p.tag) == "p"),
                    "left": box(off, "x"), "top": box(off, "y"), "width": box(ext, "cx"), "height": box(ext, "cy"),
                    "slide_width": int(size.get("cx", 0)), "slide_height": int(size.get("cy", 0)),
                })
    return out


def pptx_markdown(data: bytes) -> str:
    """Slides with their anchors, titles as headings, other texts as paragraphs."""
    pages: dict[int, list[str]] = {}
    for shape in pptx_shapes(data):
        text = shape["text"].strip()
        title = shape["placeholder"] in ("TITLE", "CENTER_TITLE")
        pages.setdefault(shape["page"], []).extend(["# " + text if title else text] if text else [])
    return "\n\n".join(f"<!-- Slide number: {n} -->\n" + "\n\n".join(texts) for n, texts in sorted(pages.items()))


def xlsx_markdown(data: bytes) -> str:
    """Each sheet of a workbook as a heading and a Markdown table."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _xml(archive, "xl/sharedStrings.xml")]
        titles = [e.attrib.get("name", "") for e in _xml(archive, "xl/workbook.xml").iter() if _local(e.tag) == "sheet"]
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        out = []
        for title, name in zip(titles, names):
            rows = []
            for row in (r for r in _xml(archive, name).iter() if _local(r.tag) == "row"):
                cells = []
                for cell in row:
                    value = next((v.text or "" for v in cell.iter() if _local(v.tag) in ("v", "t")), "")
                    cells.append(shared[int(value)] if cell.attrib.get("t") == "s" and value else value)
                rows.append(cells)
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
            out.append("\n".join([f"## {title}", *lines[:1], *(["|" + " --- |" * width] if lines else []), *lines[1:]]))
    return "\n\n".join(out)


def zip_images(data: bytes, folder: str) -> list[tuple[str, bytes]]:
    """The images of an office file below ``folder`` (word/media/), in order of their numbers."""

    def order(name: str) -> tuple:
        digits = re.search(r"\d+", name.rpartition("/")[2])
        return (0, int(digits.group()), name) if digits else (1, 0, name)

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [(n.rpartition("/")[2], archive.read(n)) for n in sorted((n for n in archive.namelist() if n.startswith(folder)), key=order)]


def pptx_images(data: bytes) -> list[tuple[str, bytes]]:
    """The pictures of a deck in order of slide and shape, named by both: ``slide{i}_img{j}`` with j the shape's place."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        for page, name in enumerate(_slide_names(archive), 1):
            links = f"ppt/slides/_rels/{name.rpartition('/')[2]}.rels"
            targets = {e.attrib.get("Id"): e.attrib.get("Target", "") for e in _xml(archive, links)} if links in names else {}
            tree = next((e for e in _xml(archive, name).iter() if _local(e.tag) == "spTree"), ())
            for number, shape in enumerate((s for s in tree if _local(s.tag) in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")), 1):
                blip = next((e for e in shape.iter() if _local(e.tag) == "blip"), None) if _local(shape.tag) == "pic" else None
                link = next((v for k, v in blip.attrib.items() if _local(k) == "embed"), None) if blip is not None else None
                member = "ppt/" + targets.get(link, "").removeprefix("/ppt/").removeprefix("../")
                if member in names:
                    out.append((f"slide{page}_img{number}.{member.rpartition('.')[2] or 'png'}", archive.read(member)))
    return out


def office_images(files: DataFrame) -> DataFrame:
    """``file, position, name, content``: the images inside decks and Word files (``path, content``); broken files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = pptx_images(bytes(content)) if path.lower().endswith(".pptx") else zip_images(bytes(content), "word/media/")
                except Exception:  # noqa: BLE001
                    found = []
                if found:
                    yield pd.DataFrame([(path, at, name, image) for at, (name, image) in enumerate(found)], columns=["file", "position", "name", "content"])

    wanted = files.filter(extension(F.col("path")).isin("pptx", "docx")).select("path", "content")
    return wanted.mapInPandas(run, "file string, position int, name string, content binary")


SHAPE = "page int, number int, kind int, placeholder string, chart boolean, rows int, columns int, text string, left long, top long, width long, height long, slide_width long, slide_height long"


def deck_layouts(files: DataFrame) -> DataFrame:
    """``file, layouts``: for each deck (``path, content``) the map of page to its notes, one ``role(region)`` a shape in order."""
    names = [part.split()[0] for part in SHAPE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    shapes = pptx_shapes(bytes(content))
                except Exception:  # noqa: BLE001
                    shapes = []
                if shapes:
                    yield pd.DataFrame([(path, *(shape[n] for n in names)) for shape in shapes], columns=["file", *names])

    decks = files.filter(extension(F.col("path")) == "pptx").select("path", "content")
    shapes = decks.mapInPandas(run, "file string, " + SHAPE).withColumn("shape", F.struct(*names))
    c = F.col
    region = slides.shape_region(c("left"), c("top"), c("width"), c("height"), c("slide_width"), c("slide_height"))
    noted = shapes.withColumn("role", slides.shape_role(c("shape"))).filter("role IS NOT NULL")
    note = F.concat("role", F.when(region != "", F.concat(F.lit("("), region, F.lit(")"))).otherwise(""))
    pages = noted.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("number", note.alias("note")))).alias("n"))
    entries = F.struct("page", F.transform("n", lambda x: x["note"]).alias("notes"))
    return pages.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(entries))).alias("layouts"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """``path, page, text`` of PDF files (``path, content``); a file that can't be read has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    texts = pdf.page_texts(bytes(content))
                except Exception:  # noqa: BLE001
                    texts = []
                if texts:
                    yield pd.DataFrame({"path": path, "page": range(1, len(texts) + 1), "text": texts})

    wanted = files.filter(extension(F.col("path")) == "pdf").select("path", "content")
    return wanted.mapInPandas(run, "path string, page int, text string")


def epub_markdown(data: bytes) -> str:
    """The chapters of an e-book in order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = next(e.attrib["full-path"] for e in _xml(archive, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
        package = _xml(archive, root)
        items = {e.attrib.get("id"): e.attrib.get("href", "") for e in package.iter() if _local(e.tag) == "item"}
        folder = root.rpartition("/")[0]
        chapters = [items.get(e.attrib.get("idref"), "") for e in package.iter() if _local(e.tag) == "itemref"]
        return "\n\n".join(html_markdown(archive.read(f"{folder}/{c}".lstrip("/"))) for c in chapters if c)


def zip_markdown(data: bytes) -> str:
    """The members of an archive that can be converted, each below a heading with its name."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in sorted(n for n in archive.namelist() if not n.endswith("/")):
            converter = CONVERTERS.get(name.rpartition(".")[2].lower())
            if converter:
                out.append(f"## File: {name}\n\n{converter(archive.read(name))}")
    return "\n\n".join(out)


def picture_markdown(data: bytes) -> str:
    """The resolution of a picture; empty if its bytes do not tell it."""
    found = pictures.size(data)
    return f"ImageSize: {found[0]}x{found[1]}" if found else ""


def wave_markdown(data: bytes) -> str:
    """Channels, rate and length of a sound file."""
    import wave

    with wave.open(io.BytesIO(data)) as sound:
        return f"NumChannels: {sound.getnchannels()}\nSampleRate: {sound.getframerate()}\nDuration: {sound.getnframes() / sound.getframerate():.2f} s"


def _plain(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


CONVERTERS: dict[str, Callable[[bytes], str]] = {
    "txt": _plain, "md": _plain, "csv": csv_markdown, "html": html_markdown, "htm": html_markdown, "ipynb": notebook_markdown,
    "docx": docx_markdown, "pptx": pptx_markdown, "xlsx": xlsx_markdown, "pdf": pdf.pdf_markdown, "epub": epub_markdown, "zip": zip_markdown, "wav": wave_markdown,
    **{kind: picture_markdown for kind in ("png", "jpg", "jpeg", "gif", "bmp", "webp")},
}


def convert(files: DataFrame, more: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, modified_at, status, markdown, error`` of scanned files: converted, error, copied or skipped.

    A file that fails is a row with status ``error``, never an exception. ``more`` adds or replaces converters.
    """
    registry = CONVERTERS | (more or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, modified, content in zip(batch["path"], batch["modified_at"], batch["content"]):
                ext = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
                if ext not in SUPPORTED and ext not in registry:
                    rows.append((path, modified, "copied" if ext in IMAGES else "skipped", None, None))
                    continue
                try:
                    rows.append((path, modified, "converted", registry[ext](bytes(content)), None))
                except KeyError:
                    rows.append((path, modified, "error", None, f"no converter for .{ext}"))
                except Exception as failure:  # noqa: BLE001
                    rows.append((path, modified, "error", None, f"{type(failure).__name__}: {failure}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "modified_at", "status", "markdown", "error"])

    named = files.select("path", F.col("modificationTime").alias("modified_at"), "content")
    return named.mapInPandas(run, "path string, modified_at timestamp, status string, markdown string, error string")
