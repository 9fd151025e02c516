"""Sentences worth keeping: questions, definitions, claims, hypotheses, quotes, tasks to do, phrases.

Every extractor takes (path, content) and returns (path, position, item): code is removed, items are trimmed, filtered,
and the first of equal ones, whatever their case, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import markdown as M
from driftwell.storage import stash

# fixed patterns of what is extracted
QUESTIONS = (r"[^.!?\n][^.!?]*\?", r"(?m)^\s*[-*+]\s+(.+\?)\s*$")
DEFINITIONS = (r"(?mi)^([^.\n]+?)\s+is\s+(?:defined as|a|an)\s+([^.\n]+\.?)", r"(?m)^\s*[-*+]?\s*\*\*([^:*]+)\*\*:\s*([^.\n]+\.?)", r"(?mi)^([^.\n]+?)\s+means\s+([^.\n]+\.?)", r"(?mi)^([^.\n]+?)\s+refers to\s+([^.\n]+\.?)")
# what stands between a term and its meaning, by pattern
JOINTS = (" is ", ": ", " means ", " refers to ")
CLAIMS = (r"(?i)[^.\n]*?\b(?:shows?|proves?|demonstrates?|establishes?|confirms?)\b[^.\n]+\.", r"(?i)(?:Research|Studies|Evidence|Data)\s+(?:shows?|suggests?|indicates?)[^.\n]+\.", r"(?i)[^.\n]+?\b(?:causes?|leads to|results in)\b[^.\n]+\.")
HYPOTHESES = (r"(?i)If\s+[^.\n]+?,?\s+then\s+[^.\n]+\.", r"(?i)[^.\n]+?\b(?:may|might|could)\b[^.\n]+\.", r"(?i)[^.\n]+?\bwould\b[^.\n]+if[^.\n]+\.")
# The patterns whose match is always a whole run of text up to its full stop, by what the run must hold. Read as they stand they
# try every place of a run again, which is quadratic in a long text without full stops; runs are cut and tested once instead.
RUN = r"[^.\n]++\.?"
CLAIM_RUNS = {0: r"(?i)\b(?:shows?|proves?|demonstrates?|establishes?|confirms?)\b[^.\n]+\.", 2: r"(?i)(?<=[^.\n])\b(?:causes?|leads to|results in)\b[^.\n]+\."}
HYPOTHESIS_RUNS = {1: r"(?i)(?<=[^.\n])\b(?:may|might|could)\b[^.\n]+\.", 2: r"(?i)^(?>[^.\n]+?\bwould\b)[^.\n]+if[^.\n]+\."}
TODO = r"(?i)(TODO|FIXME|HACK|NOTE|XXX):\s*([^.\n]+(?:\.[^\n]+)?)"
PLACEHOLDERS = ("add content", "write this", "fill in", "update")
COMMON = ("the", "and", "but", "with", "from", "this", "that")
STOPS = ("the ", " of ", " and ", " to ", " in ", " is ", " a ")


def _unique(found: DataFrame, shortest: int, longest: int, extra: Column | None = None) -> DataFrame:
    item = F.btrim("item", F.lit(" \t\n\r"))
    d = found.withColumn("item", item).where(F.length("item").between(shortest, longest) & F.col("item").rlike("[a-zA-Z]"))
    d = d if extra is None else d.where(extra)
    return d.groupBy("path", F.lower("item").alias("k")).agg(F.min(F.struct("position", "item")).alias("m")).select("path", "m.position", "m.item")


def _matches(notes: DataFrame, patterns: tuple[str, ...], groups: tuple[int, ...] | None = None, runs: dict[int, str] | None = None) -> DataFrame:
    """(path, position, item): all matches of each pattern in turn; ``runs`` are those that are read run by run."""
    d, runs = notes.select("path", M.without_code(F.col("content")).alias("text")), runs or {}
    whole = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))

    def found(n: int, pattern: str, group: int) -> Column:
        if n not in runs:
            return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return F.filter(whole, lambda r: r.endswith(".") & r.rlike(runs[n]))

    arrays = [found(n, p, k) for n, (p, k) in enumerate(zip(patterns, groups or (0,) * len(patterns), strict=True))]
    return d.select("path", F.posexplode(F.flatten(F.array(*arrays))).alias("position", "item"))


def questions(notes: DataFrame, shortest: int = 10, longest: int = 500) -> DataFrame:
    return _unique(_matches(notes, QUESTIONS, (0, 1)), shortest, longest)


def definitions(notes: DataFrame, shortest: int = 15, longest: int = 300) -> DataFrame:
    """Items read ``term is meaning``, by the pattern that found them."""
    text, parts = M.without_code(F.col("content")), []
    joined = lambda joint: lambda a, b: F.concat(a, F.lit(joint), b)
    for p, joint in zip(DEFINITIONS, JOINTS, strict=True):
        terms, meanings = (F.regexp_extract_all(text, F.lit(p), F.lit(k)) for k in (1, 2))
        parts.append(F.zip_with(terms, meanings, joined(joint)))
    found = notes.select("path", F.posexplode(F.flatten(F.array(*parts))).alias("position", "item"))
    return _unique(found, shortest, longest, ~F.col("item").rlike(r"^(?:This|That|It|There)\b"))


def claims(notes: DataFrame, shortest: int = 20, longest: int = 300) -> DataFrame:
    return _unique(_matches(notes, CLAIMS, runs=CLAIM_RUNS), shortest, longest)


def hypotheses(notes: DataFrame, shortest: int = 20, longest: int = 300) -> DataFrame:
    return _unique(_matches(notes, HYPOTHESES, runs=HYPOTHESIS_RUNS), shortest, longest)


def todos(notes: DataFrame) -> DataFrame:
    """Items read ``MARKER: text``; placeholders are left out."""
    text = M.without_code(F.col("content"))
    marks, rest = (F.regexp_extract_all(text, F.lit(TODO), F.lit(k)) for k in (1, 2))
    d = notes.select("path", F.posexplode(F.arrays_zip(marks.alias("m"), rest.alias("t"))).alias("position", "z")).select("path", "position", F.upper("z.m").alias("marker"), F.btrim("z.t").alias("item"))
    first = F.row_number().over(Window.partitionBy("path", F.lower("item")).orderBy("position"))
    ok = F.length("item").between(5, 300) & F.col("item").rlike("[a-zA-Z]") & ~F.lower("item").isin(*PLACEHOLDERS)
    return d.where(ok).withColumn("__k", first).where("__k = 1").select("path", "position", F.concat("marker", F.lit(": "), "item").alias("item"))


def quotes(notes: DataFrame) -> DataFrame:
    """Consecutive ``>`` lines joined; ten characters and letters at least, cut at 500."""
    lines = notes.select("path", F.posexplode(F.split(M.without_code(F.col("content")), "\n")).alias("line", "text"))
    q = lines.where(F.btrim("text").startswith(">"))
    q = q.withColumn("__g", F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line")))
    said = F.btrim(F.regexp_replace("text", r"^[ \t]*>[ \t]*", ""))
    g = q.groupBy("path", "__g").agg(F.min("line").alias("position"), F.array_sort(F.collect_list(F.struct("line", said.alias("t")))).alias("r"))
    item = F.array_join(F.filter(F.transform("r", lambda x: x["t"]), lambda t: t != ""), " ")
    letters = F.length(F.regexp_replace("item", "[^a-zA-Z]", ""))
    d = g.select("path", "position", item.alias("item")).where((F.length("item") >= 10) & (letters >= 10))
    return d.withColumn("item", F.when(F.length("item") > 500, F.concat(F.substring("item", 1, 497), F.lit("..."))).otherwise(F.col("item")))


def grams(notes: DataFrame, unless: tuple[str, ...]) -> DataFrame:
    """(path, phrase): three words in a row of more than 15 characters without any of ``unless``, tested inside the array."""
    w = notes.select("path", M.words(F.lower("content")).alias("w"))
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))

    def fits(p: Column) -> Column:
        out = F.length(p) > 15
        for s in unless:
            out = out & ~F.contains(p, F.lit(s))
        return out

    return w.where(F.size("w") >= 3).select("path", F.explode(F.filter(three, fits)).alias("phrase"))


def phrases(notes: DataFrame, least: int = 3) -> DataFrame:
    """(phrase, n, notes): three words in a row that recur; short ones and those with a stop word are left out.

    Occurrences are added by note first, so one aggregation by phrase does not carry paths.
    """
    g = grams(notes, STOPS).groupBy("phrase", "path").agg(F.count("*").alias("k"))
    return g.groupBy("phrase").agg(F.sum("k").alias("n"), F.count("*").alias("notes")).where(F.col("n") >= least)


def shared_phrases(notes: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(phrase, n, notes): phrases that stand ``least`` times or more in notes not linked with another note that has them."""
    g = grams(notes, COMMON).groupBy("phrase", "path").agg(F.count("*").alias("k"))
    often = g.groupBy("phrase").agg(F.sum("k").alias("n")).where(F.col("n") >= least).select("phrase")
    g = stash(g.join(often, "phrase", "left_semi"), "phrases")
    p = pairs.select("a", "b")
    one = g.select("phrase", F.col("path").alias("a")).join(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a")
    linked = one.join(g.select("phrase", F.col("path").alias("b")), ["phrase", "b"]).select("phrase", F.col("a").alias("path")).distinct()
    alone = g.join(linked, ["phrase", "path"], "left_anti")
    return alone.groupBy("phrase").agg(F.sum("k").alias("n"), F.count("*").alias("notes")).where(F.col("n") >= least)
