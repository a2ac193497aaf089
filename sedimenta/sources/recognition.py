"""Recognition of pictures and pages: which are worth it, clients by mode, retries and second passes inside the workers.

A client is a callable of a picture's bytes that gives a text or a failure mark, never an exception. ``service`` makes one from the
settings: a model behind an HTTP interface, or a local command. Its transport is injectable.
"""

from __future__ import annotations

import base64
import json
import shutil
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import slides
from sedimenta.sources.config import Recognition

#: Waits between the tries of one picture, in seconds.
WAITS = (5, 10, 20)
# The marks of failed recognitions, and the media types of pictures by their first bytes.
FAILED, UNREADABLE, LOCAL_FAILED = "[图片识别失败: {}]", "[图片解析失败: {}]", "[本地 OCR 失败: {}]"
MEDIA = {b"\x89PNG": "image/png", b"GIF8": "image/gif", b"RIFF": "image/webp", b"BM": "image/bmp", b"\xff\xd8": "image/jpeg"}
Client = Callable[[bytes], str]


def worth_recognising(length: Column, width: Column, height: Column, variances: Column, min_bytes: int = 500, min_pixels: int = 50) -> Column:
    """Struct ``keep, reason`` by size, resolution and the variances of the three channels of a 10 x 10 thumbnail.

    An unknown resolution keeps the image, unknown variances mean no solid colour.
    """
    reason = (
        F.when(length.isNull(), "missing")
        .when(length < min_bytes, "too small")
        .when((width < min_pixels) | (height < min_pixels), "low resolution")
        .when(width.isNull() | height.isNull(), "unreadable, kept")
        .when(F.coalesce(F.forall(variances, lambda v: v < 10), F.lit(False)) & (F.size(variances) == 3), "solid colour")
        .otherwise("kept")
    )
    return F.struct(reason.isin("unreadable, kept", "kept").alias("keep"), reason.alias("reason"))


# Clients -------------------------------------------------------------------------------------------------------------


def _send(url: str, headers: dict[str, str], body: bytes, timeout: int) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as answer:
        return answer.read()


@dataclass
class ModelClient:
    """A vision model behind a chat interface: the picture goes as a data URL, the first choice's message comes back."""

    url: str
    key: str = ""
    model: str = ""
    system: str = "Describe the picture."
    ask: str = "What does the picture show? Read its text."
    max_tokens: int = 1024
    timeout: int = 60
    send: Callable[[str, dict[str, str], bytes, int], bytes] = _send

    def request(self, data: bytes) -> dict:
        """The request's content."""
        media = next((kind for start, kind in MEDIA.items() if data.startswith(start)), "image/jpeg")
        picture = {"type": "image_url", "image_url": {"url": f"data:{media};base64,{base64.b64encode(data).decode('ascii')}"}}
        asked = [{"role": "system", "content": self.system}, {"role": "user", "content": [picture, {"type": "text", "text": self.ask}]}]
        return {"model": self.model, "messages": asked, "max_tokens": self.max_tokens}

    def __call__(self, data: bytes) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        try:
            answer = json.loads(self.send(self.url, headers, json.dumps(self.request(data)).encode(), self.timeout))
            message = answer["choices"][0]["message"]
        except urllib.error.HTTPError as failure:
            return FAILED.format(f"HTTP {failure.code} {failure.reason}")
        except (KeyError, IndexError, TypeError, ValueError) as failure:
            return UNREADABLE.format(failure)
        except OSError as failure:
            return FAILED.format(failure)
        return message.get("content") or message.get("reasoning") or ""


@dataclass
class CommandClient:
    """A local recognition command that reads a picture and writes its text."""

    language: str = "chi_sim+eng"
    command: str = "tesseract"
    timeout: int = 30

    def __call__(self, data: bytes) -> str:
        found = shutil.which(self.command)
        if not found:
            return LOCAL_FAILED.format(f"{self.command} is not installed")
        try:
            done = subprocess.run([found, "stdin", "stdout", "-l", self.language, "--psm", "6"], input=data, capture_output=True, timeout=self.timeout, check=False)
            return done.stdout.decode("utf-8", "replace").strip()
        except (OSError, subprocess.SubprocessError) as failure:
            return LOCAL_FAILED.format(failure)


def service(settings: Recognition, **more) -> Client | None:
    """The client that the settings ask for; None if recognition is off. A mixed mode is not there."""
    if not settings.enabled:
        return None
    if settings.mode == "hybrid":
        raise NotImplementedError("take the mode cloud or local")
    if settings.mode == "local":
        return CommandClient(settings.language, **more)
    model = settings.model
    return ModelClient(model.url, model.key, model.name, timeout=model.timeout, max_tokens=model.max_tokens, **more)


# Recognition ---------------------------------------------------------------------------------------------------------


def _good(said: str | None) -> bool:
    return bool(said and said.strip()) and not said.startswith(slides.FAILED)


def _tried(client: Client, content: bytes, waits: tuple[float, ...]) -> str:
    """What the client says, asked again after each wait while it fails; the last answer or a failure mark at the end."""
    said = ""
    for wait in (*waits, None):
        try:
            said = client(content)
        except Exception as failure:  # noqa: BLE001
            said = FAILED.format(str(failure)[:200])
        if _good(said):
            return said
        if wait is not None:
            time.sleep(wait)
    return said or FAILED.format("empty answer")


def recognise(images: DataFrame, client: Client, threads: int = 4, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """``path, said``: what the client said of each image's ``content``; after the last try a failure mark, never an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                said = pool.map(lambda content: _tried(client, bytes(content), waits), batch["content"])
                yield pd.DataFrame({"path": batch["path"], "said": list(said)})

    return images.select("path", "content").mapInPandas(run, "path string, said string")


def numbered_pages(pages: DataFrame, key: str) -> DataFrame:
    """``key, page, path, content`` of page pictures: the number in page{N}.png, else the place among a file's others; the first
    of several pictures of one page counts."""
    number = slides.page_number(F.col("path"))
    place = F.row_number().over(Window.partitionBy(key, (number == 0)).orderBy("path"))
    with_page = pages.withColumn("page", F.when(number == 0, place).otherwise(number))
    first = F.row_number().over(Window.partitionBy(key, "page").orderBy(number == 0, "path"))
    return with_page.withColumn("__first", first).filter("__first = 1").select(key, "page", "path", "content")


def recognise_pages(pages: DataFrame, key: str, client: Client, threads: int = 1, waits: tuple[float, ...] = WAITS, wanted: DataFrame | None = None) -> DataFrame:
    """``key, said`` (map of page to text) of the page pictures of each file (``key, path, content``).

    Failed pages are asked for a second time when the first round of their batch is over. ``wanted`` (``key, page``) restricts the
    work to some pages by a semi join.
    """
    rows = numbered_pages(pages, key)
    if wanted is not None:
        rows = rows.join(wanted.select(key, "page").distinct(), [key, "page"], "left_semi")
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                ask = lambda at, batch=batch: _tried(client, bytes(batch["content"][at]), waits)
                said = list(pool.map(ask, range(len(batch))))
                again = [at for at, text in enumerate(said) if not _good(text)]
                for at, text in zip(again, pool.map(ask, again)):
                    said[at] = text
                yield pd.DataFrame({key: batch[key], "page": batch["page"], "said": said})

    said = rows.select(key, "page", "path", "content").mapInPandas(run, f"`{key}` {kind}, page int, said string")
    return said.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "said")))).alias("said"))


def render_pages(files: DataFrame, renderer: Callable[[str, bytes], list[bytes]] | None = None) -> DataFrame:
    """``file, path, content``: one PNG row named page{N}.png for each page of decks and PDF files (``path, content``).

    ``renderer`` gives the pictures of a file; by default the commands ``soffice`` and ``pdftoppm`` do. A file that can't be
    rendered has no row.
    """
    renderer = renderer or rendered

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pictures = renderer(path, bytes(content))
                except (OSError, RuntimeError, ValueError, subprocess.SubprocessError):
                    pictures = []
                rows = [(path, f"page{n}.png", picture) for n, picture in enumerate(pictures, 1)]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "file string, path string, content binary")


def rendered(path: str, data: bytes, dpi: int = 150, timeout: int = 180) -> list[bytes]:
    """The pages of a deck or PDF as PNG pictures by commands of the machine; raises if they are missing."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # scratch of one task, nothing is shared through it
        source = Path(folder) / ("in" + Path(path).suffix.lower())
        source.write_bytes(data)
        if source.suffix != ".pdf":
            if not shutil.which("soffice"):
                raise RuntimeError("soffice is not installed")
            subprocess.run(["soffice", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)], check=True, capture_output=True, timeout=timeout)
        if not shutil.which("pdftoppm"):
            raise RuntimeError("pdftoppm is not installed")
        subprocess.run(["pdftoppm", "-png", "-r", str(dpi), str(source.with_suffix(".pdf")), f"{folder}/page"], check=True, capture_output=True, timeout=timeout)
        found = sorted(Path(folder).glob("page*.png"), key=lambda p: int("".join(c for c in p.stem if c.isdigit())))
        return [p.read_bytes() for p in found]
