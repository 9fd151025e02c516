"""Markdown as columns: front matter, titles, links, tags, tasks, headings, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed patterns of the note format
LINK = r"(!?)\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
TAG = r"#([a-zA-Z0-9_/-]+)"
FENCE = r"(?s)```.*?```"
INLINE = r"`[^`]+`"
FRONT = r"\A---[ \t]*\n(?s:(.*?)\n)?---[ \t]*(?:\n|\z)"
JOURNAL_DIR = "session journal/"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def front_matter(content: Column) -> Column:
    """The block between the leading ``---`` lines; null if there is none."""
    return F.when(content.rlike(FRONT), F.regexp_extract(content, FRONT, 1))


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONT, "")


def front_value(content: Column, key: str) -> Column:
    """A scalar front-matter value without quotes; null if absent."""
    found = F.regexp_extract(front_matter(content), rf"(?m)^{key}:[ \t]*[\"']?([^\n\"'\[]*?)[\"']?[ \t]*$", 1)
    return F.when(found != "", found)


def front_list(content: Column, key: str) -> Column:
    """A front-matter list, inline ``[a, b]`` or one ``- item`` a line, or a single value."""
    block = front_matter(content)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    dashed = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    single = front_value(content, key)
    raw = F.when(inline != "", F.split(inline, ",")).when(dashed != "", F.split(F.regexp_replace(dashed, r"(?m)^[ \t]*-[ \t]*", ""), "\n")).when(single.isNotNull(), F.array(single))
    clean = F.transform(raw, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast("array<string>"))


def title(content: Column, path: Column) -> Column:
    """Front-matter title, else the first ``# `` line, else the file's stem."""
    heading = F.regexp_extract(body(content), r"(?m)^[ \t]*# +(\S[^\n]*?)[ \t]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(front_value(content, "title"), F.when(heading != "", heading), stem)


def links(content: Column) -> Column:
    """Array of structs (target, display_text, is_embed, block_ref) in order; headings are dropped, empty targets skipped."""

    def parse(m: Column) -> Column:
        raw, shown = F.trim(F.regexp_extract(m, LINK, 2)), F.trim(F.regexp_extract(m, LINK, 3))
        name = F.trim(F.substring_index(F.substring_index(raw, "^", 1), "#", 1))
        block = F.when(F.contains(raw, F.lit("^")), F.regexp_extract(raw, r"\^(.*)$", 1))
        return F.struct(name.alias("target"), F.when(shown != "", shown).alias("display_text"), m.startswith("!").alias("is_embed"), block.alias("block_ref"))

    found = F.transform(F.regexp_extract_all(content, F.lit(LINK), F.lit(0)), parse)
    return F.filter(found, lambda x: x["target"] != "")


def without_code(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, FENCE, ""), INLINE, "")


def tags(content: Column) -> Column:
    """Sorted distinct tags of front matter and text outside code."""
    inline = F.regexp_extract_all(without_code(body(content)), F.lit(TAG), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(front_list(content, "tags"), inline)))


def open_tasks(content: Column) -> Column:
    return F.regexp_count(content, F.lit(r"(?m)^[ \t]*[-*] \[ \]")).cast("long")


def done_tasks(content: Column) -> Column:
    return F.regexp_count(content, F.lit(r"(?m)^[ \t]*[-*] \[[xX]\]")).cast("long")


def words(content: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(content, r"\s+"), lambda x: x != "")


def heading_date(heading: Column) -> Column:
    """The date that a heading states, in any of the known forms; null otherwise. Month names are capitalised."""
    h = F.trim(heading)
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), name)

    def made(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        part = lambda k: F.regexp_extract(h, pattern, k)
        mm = month(part(m)) if named else part(m).try_cast("int")
        text = F.format_string("%04d-%02d-%02d", part(y).try_cast("int"), mm.cast("int"), part(d).try_cast("int"))
        return F.when(h.rlike(pattern) & (mm > 0), text.try_cast("date"))

    names = "([A-Za-z]+)"
    return F.coalesce(
        made(r"^(\d{4})-(\d{2})-(\d{2})(?:[T ].*)?$", 1, 2, 3),
        made(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
        made(r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
        made(rf"(?i)^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),? +{names} +(\d{{1,2}}),? +(\d{{4}})$", 3, 1, 2, True),
        made(rf"(?i)^{names} +(\d{{1,2}}),? +(\d{{4}})$", 3, 1, 2, True),
        made(rf"(?i)^(\d{{4}}) +{names} +(\d{{1,2}})$", 1, 2, 3, True),
    )


def forms(path: Column, name: Column) -> Column:
    """What a link may call a note: its path, its path without extension, its title."""
    return F.array_distinct(F.array(path, F.regexp_replace(path, r"\.[^.]*$", ""), name))


def link_text(name: Column, is_virtual: Column, source_file: Column) -> Column:
    """What a link to a note says: its title, with its journal for an entry of one."""
    return F.when(is_virtual & source_file.isNotNull(), F.concat(F.replace(source_file, F.lit(".md"), F.lit("")), F.lit("#"), name)).otherwise(name)
