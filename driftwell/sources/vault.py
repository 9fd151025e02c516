"""Notes from Markdown files: scan, parse, journal entries, incremental merge."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import markdown as M

#: Files whose modification time differs by less count as unchanged.
TOLERANCE = 0.01


@dataclass(frozen=True)
class JournalRules:
    """When a file counts as a journal: sections and the share of them that are dated; globs that never do."""

    min_sections: int = 2
    date_threshold: float = 0.5
    exclude: tuple[str, ...] = ()


def below(root: str) -> Column:
    """A file's path below ``root``, from its metadata."""
    base = root.rstrip("/").rsplit("/", 1)[-1]
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, rf"^.*?/{re.escape(base)}/", "")


def note(notes: DataFrame, path: str) -> DataFrame:
    """The note of that path, or no row."""
    return notes.where(F.col("path") == path)


def by_paths(notes: DataFrame, paths: list[str] | DataFrame) -> DataFrame:
    """The notes of the given paths; a list of thousands or a table with ``path`` is joined, a short list pushed to the scan."""
    if isinstance(paths, DataFrame):
        return notes.join(paths.select("path").distinct(), "path", "left_semi")
    if len(paths) <= 500:
        return notes.where(F.col("path").isin(list(paths)))
    return by_paths(notes, notes.sparkSession.createDataFrame([(p,) for p in paths], "path string"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, file_mtime, modified) of every Markdown file below ``root``, one row a file."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    when = F.col("_metadata.file_modification_time")
    return raw.select(below(root).alias("path"), F.col("value").alias("content"), (F.unix_micros(when) / 1e6).alias("file_mtime"), when.alias("modified"))


def changed(files: DataFrame, known: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Files whose time differs from the one known for their path; ``known`` has path and file_mtime."""
    old = known.select(F.col("path").alias("__p"), F.col("file_mtime").alias("__m"))
    return files.join(old, (files["path"] == F.col("__p")) & (F.abs(files["file_mtime"] - F.col("__m")) < tolerance), "left_anti")


def sections(files: DataFrame) -> DataFrame:
    """(path, position, heading, entry_date, content): the text under each dated second-level heading, empty ones dropped."""
    lines = files.select("path", F.posexplode(F.split(M.body(F.col("content")), "\n")).alias("line", "text"))
    heading = F.when(F.trim("text").startswith("## "), F.trim(F.substring(F.trim("text"), 4, 1 << 20)))
    lines = lines.withColumn("heading", heading).withColumn("date", M.heading_date(F.col("heading")))
    order = Window.partitionBy("path").orderBy("line")
    lines = lines.withColumn("section", F.sum(F.when(F.col("date").isNotNull(), 1).otherwise(0)).over(order))
    parts = lines.where("section > 0").groupBy("path", "section").agg(
        F.max_by("heading", F.when(F.col("date").isNotNull(), 1).otherwise(0)).alias("heading"),
        F.max("date").alias("entry_date"),
        F.array_sort(F.collect_list(F.when(F.col("date").isNull(), F.struct("line", "text")))).alias("rows"),
    )
    text = F.btrim(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), F.lit(" \t\n\r"))
    return parts.select("path", F.col("section").alias("position"), "heading", "entry_date", text.alias("content")).where("content <> ''")


def is_journal(content: Column, path: Column, rules: JournalRules = JournalRules()) -> Column:
    heads = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*## +([^\n]*?)[ \t]*$"), F.lit(1))
    dated = F.size(F.filter(heads, lambda h: M.heading_date(h).isNotNull()))
    out = (F.size(heads) >= rules.min_sections) & (dated >= F.size(heads) * rules.date_threshold)
    for glob in rules.exclude:
        out = out & ~path.rlike(translate(glob).replace(r"\Z", r"\z").replace(r"\z", "$"))
    return out


def entries(files: DataFrame) -> DataFrame:
    """Journal files as one virtual note a date: sections of equal date joined, titled by the first heading."""
    parts = sections(files).groupBy("path", "entry_date").agg(F.array_sort(F.collect_list(F.struct("position", "heading", "content"))).alias("s"))
    text = F.array_join(F.transform("s", lambda r: r["content"]), "\n\n")
    joined = parts.join(files.select("path", "file_mtime", "modified", F.col("content").alias("whole")), "path")
    return joined.select(
        F.concat("path", F.lit("/"), F.col("entry_date").cast("string")).alias("path"), F.col("s")[0]["heading"].alias("title"), text.alias("content"), F.col("entry_date").cast("timestamp").alias("created"), "modified", "file_mtime",
        F.lit(True).alias("is_virtual"), F.col("path").alias("source_file"), "entry_date", M.links(text).alias("links"), F.array_sort(F.array_distinct(F.concat(M.front_list(F.col("whole"), "tags"), M.tags(text)))).alias("tags"),
    )


def parse(files: DataFrame, rules: JournalRules = JournalRules()) -> DataFrame:
    """Notes with links and tags: a row a file, or a row a date for journals."""
    content, path = F.col("content"), F.col("path")
    flagged = files.withColumn("__j", is_journal(content, path, rules))
    plain = flagged.where("NOT __j").select(
        "path", M.title(content, path).alias("title"), M.body(content).alias("content"), F.col("modified").alias("created"), "modified", "file_mtime", F.lit(False).alias("is_virtual"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("date").alias("entry_date"), M.links(content).alias("links"), M.tags(content).alias("tags"),
    )
    return plain.unionByName(entries(flagged.where("__j").drop("__j")))


def owner(notes: DataFrame) -> Column:
    """The file that a note comes from."""
    return F.coalesce(notes["source_file"], notes["path"])


def merge(notes: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """The notes after a scan: those of vanished files and of files read anew go, ``fresh`` ones come in."""
    gone = notes.join(files.select(F.col("path").alias("__p")), owner(notes) == F.col("__p"), "left_semi")
    owners = fresh.select(F.coalesce("source_file", "path").alias("__p")).distinct()
    return gone.join(owners, owner(gone) == F.col("__p"), "left_anti").unionByName(fresh)


def sync(spark: SparkSession, root: str, notes: DataFrame | None = None, rules: JournalRules = JournalRules()) -> tuple[DataFrame, int]:
    """The notes below ``root`` and how many files were read anew."""
    files = scan(spark, root)
    if notes is None:
        return parse(files, rules), files.count()
    known = notes.select(owner(notes).alias("path"), "file_mtime").distinct()
    new = changed(files, known)
    return merge(notes, files, parse(new, rules)), new.count()


def link_rows(notes: DataFrame) -> DataFrame:
    """(source_path, position, target, display_text, is_embed, block_ref), duplicates kept."""
    return notes.select(F.col("path").alias("source_path"), F.posexplode("links").alias("position", "l")).select("source_path", "position", "l.*")


def tag_rows(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("note_path"), F.explode("tags").alias("tag"))
