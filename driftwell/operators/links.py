"""Link resolution and the link graph's simple shapes.

A link may name a note by path, path without extension or title. Notes are exploded to these forms once, so every join
is an equi-join: an OR of three equalities would be planned as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import markdown as M


def note_forms(notes: DataFrame) -> DataFrame:
    """(form, path)"""
    return notes.select("path", F.explode(M.forms(F.col("path"), F.col("title"))).alias("form"))


def resolver(notes: DataFrame) -> DataFrame:
    """(form, path): what each link target means. Path first, then path without ``.md``, then title, then ``file#heading``
    of a journal entry; of equal claims the least path."""
    is_entry = F.col("is_virtual") & F.col("source_file").isNotNull()
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    claims = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("path").alias("form")),
        F.struct(F.lit(2).alias("rank"), F.when(F.col("path").endswith(".md"), stem(F.col("path"))).alias("form")),
        F.struct(F.lit(3).alias("rank"), F.col("title").alias("form")),
        F.struct(F.lit(4).alias("rank"), F.when(is_entry, F.concat(stem(F.col("source_file")), F.lit("#"), F.col("title"))).alias("form")),
    )
    rows = notes.select("path", F.inline(claims)).where("form IS NOT NULL")
    return rows.groupBy("form").agg(F.min(F.struct("rank", "path")).alias("m")).select("form", F.col("m.path").alias("path"))


def resolve_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` with ``target_path``, null for dangling ones; a target that does not resolve is tried without heading or block."""
    r = resolver(notes)
    a, b = r.select(F.col("form").alias("__fa"), F.col("path").alias("__pa")), r.select(F.col("form").alias("__fb"), F.col("path").alias("__pb"))
    bare = F.trim(F.substring_index(F.substring_index("target", "^", 1), "#", 1))
    out = links.join(a, links["target"] == F.col("__fa"), "left").withColumn("__bare", bare).join(b, F.col("__bare") == F.col("__fb"), "left")
    return out.withColumn("target_path", F.coalesce("__pa", "__pb")).drop("__fa", "__pa", "__fb", "__pb", "__bare")


def resolve_relative(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links of journal entries that name a date alone: ``target_path`` is that date's entry in the same journal."""
    e = notes.where("is_virtual").select(F.col("source_file").alias("__s"), F.col("entry_date").alias("__d"), F.col("path").alias("relative_path"))
    src = notes.select(F.col("path").alias("__p"), F.col("source_file").alias("__own"))
    tagged = links.join(src, links["source_path"] == F.col("__p"), "left").withColumn("__date", M.heading_date(F.col("target")))
    return tagged.join(e, (F.col("__own") == F.col("__s")) & (F.col("__date") == F.col("__d")), "left").drop("__p", "__own", "__date", "__s", "__d")


def outgoing(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, position, target_path): resolved links in order, duplicates kept, dangling ones dropped."""
    return resolve_links(notes, links).where("target_path IS NOT NULL").select(F.col("source_path").alias("path"), "position", "target_path")


def backlinks(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, source_path), distinct: which notes name ``path`` in any of its forms."""
    f = note_forms(notes)
    return links.join(f, links["target"] == f["form"]).select("path", "source_path").distinct()


def edges(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) with a < b for every two different notes that link in either direction."""
    e = outgoing(notes, links).select(F.least("path", "target_path").alias("a"), F.greatest("path", "target_path").alias("b"))
    return e.where("a <> b").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def graph_neighbours(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, neighbour), distinct: notes linked to and backlinks."""
    out = outgoing(notes, links).select("path", F.col("target_path").alias("neighbour"))
    return out.unionByName(backlinks(notes, links).withColumnRenamed("source_path", "neighbour")).distinct()


def links_between(notes: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Links from a to b, then from b to a."""
    f = note_forms(notes.where(F.col("path").isin(a, b)))
    hits = links.where(F.col("source_path").isin(a, b)).join(f, links["target"] == f["form"]).where("path <> source_path")
    return hits.select(F.when(F.col("source_path") == a, 0).otherwise(1).alias("direction"), "source_path", "position", "target").orderBy("direction", "position")


def hubs(notes: DataFrame, links: DataFrame, count: int | None = 10) -> DataFrame:
    """(path, link_count): notes by distinct linking notes, most first; names are path, path without ``.md``, title."""
    f = notes.select("path", F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.md$", ""), "title"))).alias("form"))
    out = links.join(f, links["target"] == f["form"]).groupBy("path").agg(F.countDistinct("source_path").alias("link_count")).orderBy(F.desc("link_count"), "path")
    return out if count is None else out.limit(count)


def find_hubs(notes: DataFrame, links: DataFrame, least: int = 10) -> DataFrame:
    """(path, backlinks) of notes with at least so many."""
    return backlinks(notes, links).groupBy("path").agg(F.count("*").alias("backlinks")).where(F.col("backlinks") >= least)


def outgoing_hubs(notes: DataFrame, links: DataFrame, least: int = 10) -> DataFrame:
    """The statistics' notion: notes with many link rows of their own."""
    out = links.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("outgoing"))
    return notes.select("path").join(out, "path").where(F.col("outgoing") >= least)


def orphans(notes: DataFrame, links: DataFrame, count: int | None = None) -> DataFrame:
    """Notes that write no link, dangling ones included, and that no link names; the last modified first."""
    named = note_forms(notes).join(links.select("target"), F.col("form") == F.col("target"), "left_semi").select("path").distinct()
    out = notes.join(links.select(F.col("source_path").alias("path")), "path", "left_anti").join(named, "path", "left_anti").orderBy(F.desc("modified"), "path")
    return out if count is None else out.limit(count)


def find_orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes without backlinks and without a link that resolves."""
    return notes.join(backlinks(notes, links).select("path"), "path", "left_anti").join(outgoing(notes, links).select("path"), "path", "left_anti")


def raw_orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """The statistics' notion: no link row has the note as source, and none its path or title as target."""
    out = notes.join(links.select(F.col("source_path").alias("path")), "path", "left_anti")
    return out.join(links.select(F.col("target").alias("path")), "path", "left_anti").join(links.select(F.col("target").alias("title")), "title", "left_anti")


def bidirectional(links: DataFrame) -> DataFrame:
    """One row: distinct ordered pairs of raw source and target that are linked back."""
    l = links.select("source_path", "target").distinct()
    back = l.select(F.col("target").alias("source_path"), F.col("source_path").alias("target"))
    return l.join(back, ["source_path", "target"], "left_semi").agg(F.count("*").alias("bidirectional"))


def top_linked(notes: DataFrame, links: DataFrame, count: int = 10) -> DataFrame:
    """(path, outgoing, incoming, total): link rows out, and in where the target is the path itself."""
    out = links.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("outgoing"))
    into = links.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("incoming"))
    t = notes.select("path").join(out, "path", "left").join(into, "path", "left").na.fill(0, ["outgoing", "incoming"])
    return t.withColumn("total", F.col("outgoing") + F.col("incoming")).orderBy(F.desc("total"), "path").limit(count)


def degrees(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, out_links, in_links): link rows out, distinct notes in."""
    out = links.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("out_links"))
    into = backlinks(notes, links).groupBy("path").agg(F.count("*").alias("in_links"))
    return notes.select("path").join(out, "path", "left").join(into, "path", "left").na.fill(0, ["out_links", "in_links"])


def density(notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: link rows over N(N-1)."""
    n = notes.agg(F.count("*").alias("n"))
    return links.agg(F.count("*").alias("links")).join(F.broadcast(n)).select("n", "links", F.when(F.col("n") > 1, F.col("links") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def unlinked(pairs: DataFrame, linked: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs without a link between them; ``linked`` as from ``edges``."""
    l = linked.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return pairs.join(l, (F.least(a, b) == F.col("__a")) & (F.greatest(a, b) == F.col("__b")), "left_anti")


def sampled(df: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """``count`` rows by the md5 of seed and key: the same in every run and on every engine, whatever ran before."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(count)


def at_rank(partition: str, *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))
