"""Problem 3: one surviving record for each group of records of the same file, built field by field.

The operator unpivots the fields to long rows, gives each row a vote, chooses the winners with ``max_by`` and pivots
back. Everything is one aggregation with map-side partials, so a group that holds a third of all rows is as cheap as
any other: no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of version, revision, date, draft or final state and copy at the ends of file names, after
# lower-casing and after every run of blanks, "_", "-" and "." became one blank.
NUMBERED = r"v(?:er(?:sion)?)? ?\d{1,4}(?: \d{1,3}){0,3}|r(?:ev(?:ision|isé)?)? ?\d{1,3}|rev(?:ision)? ?[a-z]"
DATED = (
    r"(?:19|20)\d\d ?(?:0[1-9]|1[0-2]) ?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01]) (?:0[1-9]|1[0-2]) (?:19|20)\d\d"
    r"|(?:19|20)\d\d年\d{1,2}月\d{1,2}日"
)
STATES = (
    r"final version|final|finale|latest|newest|draft|wip|entwurf|endfassung|endgültig|endversion|aktuell|neueste"
    r"|brouillon|ébauche|définitif|définitive|version finale|dernière version|rascunho|versão final"
    r"|черновик|копия|финал|итог"
)
COPIES = r"copy of|copy ?\d*|kopie von|kopie ?\d*|copie de|copie ?\d*|duplicate|duplikat|cópia de|cópia ?\d*"
HAN = r"副本 ?\d*|复制 ?\d*|终稿|定稿|草稿|初稿|草案|修订版?|修改稿|最终版?|最新版?|第 ?\d+ ?版|版本 ?\d+"
MARKER = f"(?:{NUMBERED}|{DATED}|{STATES}|{COPIES})"


def file_key(path: Column) -> Column:
    """The folder and name of the file that ``path`` denotes, without case, separators, escapes and markers.

    Null for null. A name that consists of markers only keeps them.
    """
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    slashes = F.regexp_replace(F.regexp_replace(F.lower(decoded), r"\\", "/"), r"/(?:\.?/)+", "/")
    plain = F.regexp_replace(F.regexp_replace(slashes, r"\A(?:\./+)+", ""), "（", "(")
    plain = F.regexp_replace(plain, "）", ")")
    folder = F.regexp_replace(F.regexp_extract(plain, r"(?s)\A(.*/)?", 0), r"[\s_\- ]+", " ")
    name = F.regexp_extract(plain, r"(?s)([^/]*)\z", 1)
    ending = F.regexp_extract(name, r"((?:\.[a-z][a-z0-9]{0,4}){1,2})\z", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ending))
    spaced = F.trim(F.regexp_replace(stem, r"[\s_\-. ]+", " "))
    ends = rf"(?: ?(?:\((?:\d{{1,4}}|{MARKER}|{HAN})\)|{HAN})| {MARKER})+\z"
    starts = rf"\A(?:(?:\((?:\d{{1,4}}|{MARKER}|{HAN})\)|{HAN}) ?|{MARKER} )+"
    bare = F.trim(F.regexp_replace(F.regexp_replace(spaced, ends, ""), starts, ""))
    return F.concat(folder, F.when(bare == "", spaced).otherwise(bare), ending)


def unpivot(df: DataFrame, group: Column, record: Column, fields: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Long rows ``group_key, field_name, record_id, eligible, vote, value``: one for each record and field.

    ``fields`` maps a field's name to (its value, whether the record may supply it, its vote: any orderable column).
    The values stay where they are unless a caller asks for them, so that only votes are shuffled.
    """
    rows = [
        F.struct(F.lit(name).alias("field_name"), eligible.alias("eligible"), vote.alias("vote"), value.alias("value"))
        for name, (value, eligible, vote) in fields.items()
    ]
    long = df.select(group.alias("group_key"), record.alias("record_id"), F.explode(F.array(*rows)).alias("f"))
    return long.select("group_key", "record_id", "f.*")


def suppliers(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per group of at least two records: ``group_id`` and, for each field, the record that supplies it.

    The winner by ``max_by`` has the greatest vote among the records that may supply the field, then the smallest
    ``record_id``; null where none may. ``group_id`` is the group's smallest ``record_id``. Rows without a group key are
    dropped: they denote no file. Repeated rows of one record count once.
    """
    order = F.when(F.col("eligible"), F.struct(F.col("vote"), -F.col("record_id")))
    best = long.filter("group_key IS NOT NULL").groupBy("group_key", "field_name").agg(
        F.min("record_id").alias("group_id"), F.max("record_id").alias("last_id"), F.max_by("record_id", order).alias("winner_id"), F.max("eligible").alias("any")
    )
    winners = best.filter("group_id != last_id").withColumn("winner_id", F.when(F.col("any"), F.col("winner_id")))
    return pivot_back(winners, "group_id", "winner_id", names)


def voted(long: DataFrame) -> DataFrame:
    """Winners by summed votes: ``group_key, field_name, value``, and ``winner_id``, the first record that has the value.

    ``vote`` is a number; votes of records whose value is the same add up, and the value with the greatest sum wins,
    then the one with the smallest ``record_id``. Values that may not be supplied have no vote. ``first_id`` and
    ``last_id`` are the smallest and greatest ``record_id`` of the field's voters.
    """
    sums = long.filter("group_key IS NOT NULL AND eligible").groupBy("group_key", "field_name", "value").agg(
        F.sum("vote").alias("votes"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"), F.count("*").alias("voters")
    )
    order = F.struct(F.col("votes"), -F.col("first_id"))
    return sums.groupBy("group_key", "field_name").agg(
        F.max_by("value", order).alias("value"),
        F.max_by("first_id", order).alias("winner_id"),
        F.max("votes").alias("votes"),
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.sum("voters").alias("voters"),
    )


def pivot_back(winners: DataFrame, key: str, value: str, names: list[str]) -> DataFrame:
    """One row per group with a column for each field; null where a field has no winner."""
    return winners.groupBy(key).agg(
        *(F.max(F.when(F.col("field_name") == name, F.col(value))).alias(name) for name in names)
    )
