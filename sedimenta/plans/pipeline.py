"""The composed plans on folders: convert a source tree to a Markdown mirror, extract what is worth keeping, export it.

Each plan is one chain of DataFrames from a scan to a writer that runs in the executors; only counts come to the driver. Folders
must be ones that all executors share. What is made once and used twice is written to the checkpoint folder in between.
"""

from __future__ import annotations

import logging
import shutil
import sqlite3
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import frontmatter, images, slides
from sedimenta.operators import tfidf
from sedimenta.plans import extract as X
from sedimenta.plans import notes as N
from sedimenta.session import cut
from sedimenta.sources import files, pictures, recognition, sinks

LOG = logging.getLogger(__name__)
#: Named counts of a run.
Stats = dict[str, int]


def relative(path: Column, folder: str) -> Column:
    """The path below a folder of what a scan calls ``path``."""
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return F.substring(plain, F.lit(len(str(Path(folder).resolve())) + 2), F.length(plain))


def listing(spark: SparkSession, folder: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """``path, relative, modified_at, length`` of a folder's files, contents not read; empty if there is no such folder."""
    if not Path(folder).is_dir():
        return spark.createDataFrame([], "path string, relative string, modified_at timestamp, length long")
    found = files.scan(spark, str(Path(folder).resolve()), recursive)
    found = found.select("path", relative(F.col("path"), folder).alias("relative"), F.col("modificationTime").alias("modified_at"), "length")
    return found.filter(F.col("relative").rlike(pattern)) if pattern else found


def missing(source: DataFrame, existing: DataFrame, target: str) -> DataFrame:
    """Rows of ``source`` whose output (column ``target``) does not exist yet."""
    return source.join(existing.select(F.col("relative").alias(target)), target, "left_anti")


def counts(df: DataFrame, names: list[str]) -> Stats:
    """Rows by ``status``; zero for a name without rows."""
    found = {r.status: r.n for r in df.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return dict.fromkeys(names, 0) | found


# Convert -------------------------------------------------------------------------------------------------------------


def convert_plan(spark: SparkSession, source: str, formats: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """``path, relative, modified_at, length, class, output``: what a conversion would do with each file of a folder."""
    planned = listing(spark, source, recursive).withColumn("class", files.classify(F.col("path"), formats)).filter("class IS NOT NULL")
    return planned.withColumn("output", F.when(F.col("class") == "copy", F.col("relative")).otherwise(F.concat("relative", F.lit(".md"))))


def _file(relative_path: Column) -> Column:
    return F.element_at(F.split(relative_path, "/"), -1)


def _with_images(made: DataFrame, office: DataFrame, client: recognition.Client | None, waits: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Images of office files under their references: the rewritten files, and ``relative, content`` of the images to write.

    Where a client is given, pictures not worth recognising are dropped with their references, and what it says of the
    others is put below them.
    """
    found = office.withColumnRenamed("file", "path")
    names = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("names"))
    with_names = made.join(names, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    text = F.col("markdown")
    if client is not None:
        keyed = found.withColumn("file", F.col("path")).withColumn("path", F.concat("file", F.lit("\0"), "name"))
        verdicts = cut(pictures.judged(keyed))
        told = recognition.recognise(keyed.join(verdicts.filter("keep").select("path"), "path", "left_semi"), client, waits=waits)
        told = told.filter(images.recognised_ok(F.col("said"))).select(F.split("path", "\0")[0].alias("path"), F.split("path", "\0")[1].alias("name"), "said")
        said = told.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "said"))).alias("said"))
        poor = verdicts.filter("NOT keep").select(F.split("path", "\0")[0].alias("path"), F.split("path", "\0")[1].alias("name"))
        poor = poor.groupBy("path").agg(F.collect_set("name").alias("poor"))
        with_names = with_names.join(said, "path", "left").join(poor, "path", "left")
        bad = F.coalesce("poor", F.array().cast("array<string>"))
        places = F.filter(F.transform("names", lambda n, i: F.when(F.array_contains(bad, n), i)), lambda i: i.isNotNull())
        with_names = with_names.withColumn("markdown", images.drop_positions(text, places)).withColumn("names", F.filter("names", lambda n: ~F.array_contains(bad, n)))
        found = found.join(poor.select("path", F.explode("poor").alias("name")), ["path", "name"], "left_anti")
    pairs = images.image_map(text, F.col("names"), _file(F.col("relative")))
    with_pairs = with_names.withColumn("pairs", pairs).withColumn("images", F.size("names"))
    rewritten = with_pairs.withColumn("markdown", images.replace_references(text, F.col("pairs")))
    if client is not None:
        rewritten = rewritten.withColumn("markdown", F.when(F.col("said").isNotNull(), images.inject_recognised(text, F.col("pairs"), F.col("said"))).otherwise(text))
    kept = found.join(made.select("path", "relative"), "path").select(F.concat("relative", F.lit("_images/"), "name").alias("relative"), "content")
    return rewritten.drop("names", "pairs", "said", "poor"), kept


def convert_tree(spark: SparkSession, source: str, target: str, formats: list[str] | None = None, recursive: bool = True, overwrite: bool = False, layout: bool = False,
                 client: recognition.Client | None = None, pages: bool = False, renderer: Callable | None = None, waits: tuple[float, ...] = recognition.WAITS) -> Stats:
    """Converts a folder's files to ``target/<path>.md``, copies pictures of other kinds, wraps what can't be converted.

    Outputs that exist stay unless ``overwrite``. A file that fails is counted under ``errors``. With a ``client``, pictures in
    office files are recognised, or with ``pages`` whole rendered pages of decks and of PDF files without a text layer.
    """
    names = ["converted", "copied", "skipped", "errors", "images", "existing"]
    plan = convert_plan(spark, source, formats, recursive)
    todo = plan if overwrite else missing(plan, listing(spark, target), "output")
    todo = cut(todo.select("path", "relative", "class"))
    stats = dict.fromkeys(names, 0) | {"existing": plan.count() - todo.count()}
    if todo.isEmpty():
        return stats
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    contents = files.scan(spark, str(Path(source).resolve()), recursive).join(todo.filter("class = 'convert'"), "path")
    made = files.convert(contents).join(todo.select("path", "relative"), "path")
    text = F.col("markdown")
    if client is not None and pages:
        layer = files.text_layer(files.pdf_pages(contents), "path", "text")
        scanned = made.join(layer, "path", "left")
        scanned = scanned.filter(files.needs_recognition(F.col("path"), text, F.coalesce("has_text_layer", F.lit(False)))).select("path")
        wanted = contents.join(todo.filter(F.col("relative").rlike(r"(?i)\.pptx$")).select("path").unionByName(scanned), "path", "left_semi")
        rendered = recognition.render_pages(wanted, renderer)
        said = recognition.recognise_pages(rendered, "file", client, waits=waits).withColumnRenamed("file", "path")
        whole = F.array_join(F.transform(F.map_entries("said"), lambda e: F.concat(F.lit("<!-- Slide number: "), e["key"].cast("string"), F.lit(" -->\n\n"), e["value"])), "\n\n")
        merged = F.when(F.col("said").isNull(), text).when(text.contains("<!-- Slide number:"), slides.inject_pages(text, F.col("said"))).otherwise(whole)
        made = made.join(said, "path", "left").withColumn("markdown", merged).drop("said")
    if layout:
        notes = files.deck_layouts(contents).withColumnRenamed("file", "path")
        made = made.join(notes, "path", "left").withColumn("markdown", F.when(F.col("layouts").isNotNull(), slides.inject_layout(text, F.col("layouts"))).otherwise(text)).drop("layouts")
    made, pictures_ = _with_images(cut(made), files.office_images(contents), None if pages else client, waits)
    name = _file(F.col("relative"))
    extra = {"images_extracted": F.when(F.col("images") > 0, F.col("images").cast("string"))}
    head = frontmatter.render(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_replace("path", r"^file:/+", "/"), F.col("relative"), files.extension(F.col("path")), F.col("status"), now, F.lit(""), extra)
    done = cut(made.withColumn("content", F.concat(head, F.lit("\n"), text)).withColumn("output", F.concat("relative", F.lit(".md"))))
    wrote = cut(sinks.write_tree(done.filter("status = 'converted'"), target, "output"))
    others = todo.filter("class != 'convert'")
    wrapped = others.filter("class = 'skip'").select("path", "relative", F.concat("relative", F.lit(".md")).alias("output"))
    note = frontmatter.render(_file(F.col("relative")), F.regexp_replace("path", r"^file:/+", "/"), F.col("relative"), files.extension(F.col("path")), F.lit("skipped"), now, F.lit(""))
    sinks.write_tree(wrapped.withColumn("content", note), target, "output").count()
    copied = cut(sinks.copy_files(others.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")), target))
    failed = done.filter("status = 'error'").select("output", "error").collect() if LOG.isEnabledFor(logging.WARNING) else []
    for row in failed[:20]:  # a report, not the result
        LOG.warning("%s: %s", row.output, row.error)
    stats["images"] = sinks.write_tree(pictures_, target).filter("status = 'exported'").count()
    stats["converted"] = wrote.filter("status = 'exported'").count()
    stats["errors"] = done.filter("status = 'error'").count() + wrote.filter("status = 'error'").count() + copied.filter("status = 'error'").count()
    good = copied.filter("status = 'copied'").withColumnRenamed("path", "relative").join(others, "relative")
    stats["copied"], stats["skipped"] = good.filter("class = 'copy'").count(), good.filter("class = 'skip'").count()
    return stats


# Extract -------------------------------------------------------------------------------------------------------------


def documents(spark: SparkSession, mirror: str, target: str | None = None) -> DataFrame:
    """``ord, path, relative, content, modified_at`` of a mirror's files in order of their paths, part by part.

    With ``target`` only files that are new or newer than what the target holds under the same path.
    """
    found = files.markdown(spark, str(Path(mirror).resolve()))
    found = found.withColumn("relative", relative(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), mirror))
    if target:
        found = X.changed(found, listing(spark, target), "relative", "modified_at")
    ordered = sinks.number_rows(found.withColumn("__order", files.path_order(F.col("relative"))), "__order")
    return ordered.withColumnRenamed("row", "ord").drop("__order")


def extract_tree(spark: SparkSession, mirror: str, target: str, threshold: float = tfidf.THRESHOLD, min_score: int = 30, use_simhash: bool = False, merge: bool = False,
                 keep_deprecated: bool = False, incremental: bool = False, dry_run: bool = False) -> Stats:
    """Scores, tags and deduplicates a mirror's files and writes those worth keeping below ``target``.

    Duplicates and merged versions go to ``target/deprecated`` if they are to be kept. Image references lead back into the mirror.
    """
    docs = cut(documents(spark, mirror, target if incremental else None))
    title = F.element_at(F.split("relative", "/"), -1)
    found = cut(X.extract(docs.withColumn("title", F.regexp_replace(title, r"\.md$", "")), "ord", "content", "title", "relative", "modified_at", None, threshold, use_simhash, merge, min_score))
    by_status = counts(found, ["kept", "duplicate", "merged", "low_score"])
    stats = {"kept": by_status["kept"], "deduped": by_status["duplicate"] + by_status["merged"], "low_score": by_status["low_score"], "errors": 0}
    if dry_run:
        return stats
    scored = frontmatter.with_scores(F.col("content"), F.col("score"), F.col("score_detail"), F.col("tags"))
    kept = found.filter("status = 'kept'").select("relative", images.rebase(scored, F.col("relative"), Path(mirror).resolve().name).alias("content"))
    rows = kept
    if keep_deprecated:
        old = found.filter("status IN ('duplicate', 'merged')").select(F.concat(F.lit("deprecated/"), "relative").alias("relative"), scored.alias("content"))
        rows = kept.unionByName(old)
    wrote = cut(sinks.write_tree(rows, target))
    stats["errors"] = wrote.filter("status = 'error'").count()
    stats["kept"] -= wrote.filter("status = 'error' AND NOT path LIKE 'deprecated/%'").count()
    return stats


# Export --------------------------------------------------------------------------------------------------------------


def export_tree(spark: SparkSession, folder: str, target: str = "markdown", output: str | None = None, vault: str | None = None, api_url: str | None = None, api_key: str = "",
                workspace: str = "default", db: str | None = None, **more) -> Stats:
    """Publishes a folder's Markdown files as a tree, in a note vault or in a note store; ``exported, errors`` (and ``existing``)."""
    docs = documents(spark, folder)
    if target == "obsidian":
        if not vault:
            raise ValueError("a vault is needed")
        wrote = sinks.write_tree(sinks.vault(docs, "relative", "content", F.date_format(F.current_date(), "yyyy-MM-dd")), vault)
    elif target == "notes":
        if db:
            return {"errors": 0} | sinks.to_sqlite(docs, db, workspace, "relative")
        if not api_url:
            raise ValueError("an address or a database is needed")
        wrote = sinks.to_notes_api(docs, api_url, api_key, workspace, "relative", **more)
    else:
        wrote = sinks.write_tree(docs, output or str(Path(folder).resolve().parent / "exported"))
    found = counts(cut(wrote), ["exported", "error"])
    return {"exported": found["exported"], "errors": found["error"]}


def run(spark: SparkSession, source: str, output: str, work: str | None = None, convert: dict | None = None, extract: dict | None = None, export: dict | None = None) -> dict[str, Stats]:
    """Convert, extract and, if a target is given, export. The mirror lies in ``work``, which is removed if it was not given."""
    place = Path(work) / "sedimenta-workspace" if work else Path(f"{Path(output).resolve()}_workspace")
    try:
        stats = {"convert": convert_tree(spark, source, str(place / "mirror"), **(convert or {}))}
        stats["extract"] = extract_tree(spark, str(place / "mirror"), output, **(extract or {}))
        if export:
            stats["export"] = export_tree(spark, output, **export)
        return stats
    finally:
        if not work:
            shutil.rmtree(place, ignore_errors=True)


# Slides again --------------------------------------------------------------------------------------------------------


def retry_slides(spark: SparkSession, mirror: DataFrame, client: recognition.Client, renderer: Callable | None = None, waits: tuple[float, ...] = recognition.WAITS) -> DataFrame:
    """``path, content, tried, mended`` of the mirror files (``path, content``) with failed pages, those pages recognised again.

    Files that name no source, or one that can't be read, stay as they are. Only failed pages are asked for: a semi join.
    """
    failed = mirror.select("path", "content", slides.source_file(F.col("content")).alias("source"), slides.failed_pages(F.col("content")).alias("pages"))
    failed = cut(failed.filter("size(pages) > 0 AND source IS NOT NULL"))
    wanted = failed.select(F.col("path").alias("file"), F.explode("pages").alias("page"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = [(path, source) for path, source in zip(batch["path"], batch["source"]) if Path(source).is_file()]
            if named:
                yield pd.DataFrame([(path, source, Path(source).read_bytes()) for path, source in named], columns=["path", "source", "content"])

    sources = failed.select("path", "source").mapInPandas(read, "path string, source string, content binary")
    render = renderer or recognition.rendered
    # the renderer tells files by their source's name, the result by the mirror file
    keyed = sources.select(F.concat("path", F.lit("\0"), "source").alias("path"), "content")
    pages = recognition.render_pages(keyed, lambda path, data: render(path.split("\0")[1], data)).withColumn("file", F.split("file", "\0")[0])
    said = recognition.recognise_pages(pages, "file", client, waits=waits, wanted=wanted).withColumnRenamed("file", "path")
    mended = F.size(F.map_filter("said", lambda _, text: slides.page_ok(text)))
    joined = failed.join(said, "path").withColumn("content", slides.update_pages(F.col("content"), F.col("said")))
    return joined.select("path", "content", F.size("pages").alias("tried"), mended.alias("mended"))


def retry_slide(spark: SparkSession, markdown: str, client: recognition.Client, **more) -> Stats:
    """Recognises the failed pages of one mirror file again and rewrites it; ``tried, mended``."""
    file = Path(markdown)
    text = file.read_text(encoding="utf-8")
    mirror = spark.createDataFrame([(str(file), text)], "path string, content string")
    facts = mirror.select(slides.source_file(F.col("content")).alias("source"), F.size(slides.failed_pages(F.col("content"))).alias("failed")).first()
    if not facts.source:
        raise ValueError("the file names no source")
    if not Path(facts.source).is_file():
        raise ValueError(f"no such source: {facts.source}")
    if not facts.failed:
        return {"tried": 0, "mended": 0}
    done = retry_slides(spark, mirror, client, **more).first()
    if done is None:
        return {"tried": facts.failed, "mended": 0}
    file.write_text(done.content, encoding="utf-8")
    return {"tried": done.tried, "mended": done.mended}


# Reports on a note store ---------------------------------------------------------------------------------------------


def store_tables(spark: SparkSession, db: str, workspace: str) -> dict[str, DataFrame]:
    """``notes, tags, note_tags`` of one workspace of a SQLite store. SQLite is one file for one process: the driver reads it."""
    connection = sqlite3.connect(f"file:{Path(db).resolve()}?mode=ro", uri=True)
    try:
        own = "SELECT id FROM workspaces WHERE name = ?"
        notes = connection.execute(f"SELECT id, title, content, created_at, updated_at FROM notes WHERE workspace_id IN ({own})", (workspace,)).fetchall()
        links = connection.execute(f"SELECT note_id, tag_id FROM note_tags WHERE note_id IN (SELECT id FROM notes WHERE workspace_id IN ({own}))", (workspace,)).fetchall()
        tags = connection.execute("SELECT id, name FROM tags").fetchall()
    finally:
        connection.close()
    return {
        "notes": spark.createDataFrame(notes, "id long, title string, content string, created_at string, updated_at string"),
        "note_tags": spark.createDataFrame(links, "note_id long, tag_id long"),
        "tags": spark.createDataFrame([(*t, None) for t in tags], "id long, name string, alias_for long"),
    }


def post_reports(spark: SparkSession, db: str | None, workspace: str = "default", dedup: bool = False, consolidate: bool = False, similarity: float = 0.6, days: int = 90) -> dict[str, DataFrame]:
    """The reports asked for on a note store; nothing without one. A report that fails is a warning, never an error."""
    out: dict[str, DataFrame] = {}
    if not db:
        return out
    plans = {
        "duplicates": (dedup, lambda t: N.similar_groups(t["notes"], t["note_tags"], t["tags"], similarity)),
        "topics": (consolidate, lambda t: N.topics(t["note_tags"], t["tags"])),
        "merges": (consolidate, lambda t: N.merge_suggestions(t["note_tags"], similarity)),
        "stale": (consolidate, lambda t: N.stale(t["notes"], F.current_timestamp(), days)),
    }
    for name, (wanted, make) in plans.items():
        if wanted:
            try:
                out[name] = cut(make(store_tables(spark, db, workspace)))
            except Exception as failure:  # noqa: BLE001
                LOG.warning("report %s: %s", name, failure)
    return out
