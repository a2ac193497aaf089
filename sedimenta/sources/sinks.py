"""Sinks: Markdown trees, note vaults and note stores. Files are written by the executors, one row at a time."""

from __future__ import annotations

import hashlib
import json
import shutil
import sqlite3
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import frontmatter

# What a note store must have.
REQUIRED = {
    "workspaces": ["id", "name", "created_at"],
    "notes": ["id", "workspace_id", "title", "content", "created_at", "updated_at"],
    "tags": ["id", "name"],
    "note_tags": ["note_id", "tag_id"],
}


def write_tree(df: DataFrame, folder: str, path: str = "relative", content: str = "content") -> DataFrame:
    """Writes each row's content to ``folder/path``; returns ``path, status, error``, failures counted and not raised.

    The folder must be one that all executors share. Writing again replaces files, so a repeated task does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch[path], batch[content]):
                try:
                    target = (Path(folder) / str(name).lstrip("/")).resolve()
                    if Path(folder).resolve() not in target.parents:
                        raise ValueError("path leaves the folder")
                    target.parent.mkdir(parents=True, exist_ok=True)
                    if isinstance(text, (bytes, bytearray)):
                        target.write_bytes(text)
                    else:
                        target.write_text(text or "", encoding="utf-8", newline="")
                    rows.append((name, "exported", None))
                except (OSError, ValueError) as failure:
                    rows.append((name, "error", str(failure)[:300]))
            yield pd.DataFrame(rows, columns=["path", "status", "error"])

    return df.select(path, content).mapInPandas(run, "path string, status string, error string")


def copy_files(files: DataFrame, folder: str, source: str = "path", path: str = "relative") -> DataFrame:
    """Copies files (``source`` on a file system that all executors share) to ``folder/path``; ``path, status, error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, name in zip(batch[source], batch[path]):
                try:
                    target = (Path(folder) / str(name).lstrip("/")).resolve()
                    if Path(folder).resolve() not in target.parents:
                        raise ValueError("path leaves the folder")
                    target.parent.mkdir(parents=True, exist_ok=True)
                    shutil.copy2(origin, target)
                    rows.append((name, "copied", None))
                except (OSError, ValueError) as failure:
                    rows.append((name, "error", str(failure)[:300]))
            yield pd.DataFrame(rows, columns=["path", "status", "error"])

    return files.select(source, path).mapInPandas(run, "path string, status string, error string")


def vault(df: DataFrame, path: str, content: str, today: Column, folder: str = "sedimenta", exact_keys: bool = True) -> DataFrame:
    """``relative, content`` of files for a note vault, below one folder of it."""
    return df.select(F.concat(F.lit(folder + "/"), F.col(path)).alias("relative"), frontmatter.for_vault(F.col(content), F.col(path), today, exact_keys).alias("content"))


def missing_columns(tables: dict[str, list[str]]) -> list[str]:
    """Complaints about a note store's tables: missing tables, or else missing columns in order of name."""
    absent = sorted(set(REQUIRED) - set(tables))
    if absent:
        return [f"missing table {t}" for t in absent]
    return [f"missing column {t}.{c}" for t in sorted(REQUIRED) for c in sorted(set(REQUIRED[t]) - set(tables[t]))]


def resolve_ids(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """``name, id, is_new`` of all distinct names: known ids, and for new names ids after the greatest one in order of name."""
    wanted = names.select(name).filter(F.col(name).isNotNull()).distinct()
    ids = known.groupBy(name).agg(F.min("id").alias("id"))
    base = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    fresh = wanted.join(ids, name, "left_anti")
    # ids must be dense: new names are sorted by range and numbered by partition offsets
    numbered = number_rows(fresh, name).join(F.broadcast(base)).select(name, (F.col("base") + F.col("row")).alias("id"), F.lit(True).alias("is_new"))
    return wanted.join(ids, name).select(name, "id", F.lit(False).alias("is_new")).unionByName(numbered)


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """Adds ``row``, from 1 in order of a column, without gathering all rows: each range partition numbers its own."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    local = Window.partitionBy("__part").orderBy(order)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.withColumn("__row", F.row_number().over(local)).join(F.broadcast(before), "__part").withColumn("row", F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")


def note_rows(documents: DataFrame, path: str, content: str, workspace_id: int, first_id: int, now: str) -> DataFrame:
    """Rows of the table ``notes`` for Markdown files: title, body and tags as JSON text, ids in order of path."""
    parsed = documents.select(F.col(path).alias("__path"), frontmatter.parse(F.col(content), F.col(path)).alias("p"))
    numbered = number_rows(parsed, "__path")
    return numbered.select(
        (F.lit(first_id - 1) + F.col("row")).alias("id"), F.lit(workspace_id).cast("long").alias("workspace_id"), F.col("p.title").alias("title"), F.col("p.body").alias("content"),
        F.to_json("p.tags").alias("tags"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.col("p.tags").alias("tag_names"),
    )


def _mark(title: str | None, body: str | None) -> bytes:
    """A short key of a note, by which equal notes are looked up."""
    return hashlib.blake2b(f"{title or ''}\0{body or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def to_sqlite(documents: DataFrame, database: str, workspace: str, path: str = "path", content: str = "content") -> dict[str, int]:
    """Appends files as notes to a SQLite store on the driver, in one transaction; notes with the same title and body are not repeated.

    SQLite is a file for one writer, so rows are streamed to the driver partition by partition, never gathered.
    """
    connection = sqlite3.connect(database)
    try:
        present = {r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        columns = {t: [c[1] for c in connection.execute(f"PRAGMA table_info({t})")] for t in REQUIRED if t in present}
        problems = missing_columns(columns)
        if problems:
            raise ValueError("; ".join(problems))
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        stats = {"exported": 0, "existing": 0}

        def id_of(table: str, name: str) -> int:
            row = connection.execute(f"SELECT id FROM {table} WHERE name = ? ORDER BY id LIMIT 1", (name,)).fetchone()
            if row:
                return row[0]
            dated = "created_at" in columns[table]
            sql = f"INSERT INTO {table} (name, created_at) VALUES (?, ?)" if dated else f"INSERT INTO {table} (name) VALUES (?)"
            return connection.execute(sql, (name, now) if dated else (name,)).lastrowid

        with connection:
            home = id_of("workspaces", workspace)
            connection.execute("CREATE TEMP TABLE marks (mark BLOB PRIMARY KEY)")
            connection.create_function("mark_of", 2, _mark, deterministic=True)
            connection.execute("INSERT OR IGNORE INTO temp.marks SELECT mark_of(title, content) FROM main.notes WHERE workspace_id = ?", (home,))
            for row in documents.select(frontmatter.parse(F.col(content), F.col(path)).alias("p")).toLocalIterator():
                note = row.p
                mark = _mark(note.title, note.body)
                if connection.execute("SELECT 1 FROM temp.marks WHERE mark = ?", (mark,)).fetchone():
                    stats["existing"] += 1
                    continue
                connection.execute("INSERT INTO temp.marks VALUES (?)", (mark,))
                values = {"workspace_id": home, "title": note.title, "content": note.body, "created_at": now, "updated_at": now}
                if "tags" in columns["notes"]:
                    values["tags"] = json.dumps(list(note.tags), ensure_ascii=False)
                made = connection.execute(f"INSERT INTO notes ({', '.join(values)}) VALUES ({', '.join('?' * len(values))})", [*values.values()]).lastrowid
                for tag in dict.fromkeys(note.tags):
                    connection.execute("INSERT OR IGNORE INTO note_tags (note_id, tag_id) VALUES (?, ?)", (made, id_of("tags", tag)))
                stats["exported"] += 1
        return stats
    finally:
        connection.close()


def _post(url: str, key: str, note: dict) -> None:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(note, ensure_ascii=False).encode(), headers)
    with urllib.request.urlopen(request, timeout=30) as answer:
        answer.read()


def to_notes_api(documents: DataFrame, url: str, key: str = "", workspace: str = "default", path: str = "path", content: str = "content", send: Callable[[str, str, dict], None] = _post) -> DataFrame:
    """Posts each file as a note; ``path, status, error``. Errors are counted and don't end the run."""
    rows = documents.select(F.col(path).alias("path"), frontmatter.parse(F.col(content), F.col(path)).alias("p")).select("path", "p.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    send(url.rstrip("/") + "/api/notes", key, {"title": row.title, "content": row.body, "tags": list(row.tags), "workspace": workspace})
                    out.append((row.path, "exported", None))
                except Exception as failure:  # noqa: BLE001
                    out.append((row.path, "error", str(failure)[:300]))
            yield pd.DataFrame(out, columns=["path", "status", "error"])

    return rows.mapInPandas(run, "path string, status string, error string")
