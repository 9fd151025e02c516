"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document's measures are put in ratios (per mille, whole numbers). Per language and source each ratio has a
quantile sketch: counts of documents by the ratio's leading bits, which merge by addition in any order and keep every
quantile within 1/32 of its value. A document is rejected if a ratio lies beyond its group's fence, the upper quartile
plus ``REACH`` times the spread between quartiles; groups of fewer than ``LEAST`` documents use their language's merged
sketch, small languages that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.base import SPACE, let, table, word_array
from driftwell.storage import broadcast_checked, stash

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Fewer documents do not make thresholds of their own.
LEAST = 200
#: Spreads above the upper (below the lower) quartile at which a fence stands.
REACH = 4
#: Ratio: the least spread (per mille), so that a group without variation does not reject the first that differs.
#: The fence on repeats can stand below the base rule's 300; ``stutter`` is the share of words equal to the one before.
RATIOS = {"symbols": 15, "dup_lines": 120, "repeats": 72, "stutter": 40, "capitals": 60, "word_length": 700}
SYMBOLS = r"[#*$%&|<>]"
PREFIX = "__dw_"


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a window found twice or more; ``hashes`` has a window's hash by its start."""

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(starts, j + 2) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def starts(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.try_element_at(s, k)["h"] == F.try_element_at(s, j)["h"], F.lit(False))
        found = F.transform(s, lambda e, j: F.when(((j > 0) & same(j + 1, F.greatest(j, F.lit(1)))) | same(j + 1, j + 2), e["i"]).otherwise(-1))
        return F.sort_array(F.filter(found, lambda i: i >= 0))

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = let(by_hash, lambda s: let(starts(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def measures(docs: DataFrame) -> DataFrame:
    """Add the measures, prefixed, to the columns of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    white = text
    for c in " \t\n\x0b\x0c\r":
        white = F.replace(white, F.lit(c), F.lit(""))
    plain = text
    for c in "#*$%&|<>":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    words = word_array(F.col("text"))
    again = lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.try_element_at(w, F.greatest(i, F.lit(1))))))
    repeats = let(words, lambda w: F.struct(F.size(w).alias("n"), let(windows_of(w), repeated_words).alias("r"), again(w).alias("s")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0), lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("d")))
    out = docs.withColumns({f"{PREFIX}words": repeats, f"{PREFIX}lines": lines, f"{PREFIX}chars": F.length(white).cast("long"), f"{PREFIX}symbols": (F.length(text) - F.length(plain)).cast("long"), f"{PREFIX}capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long")})
    n, r = F.col(f"{PREFIX}words.n").cast("long"), F.col(f"{PREFIX}words.r").cast("long")
    return out.withColumns({f"{PREFIX}n_words": n, f"{PREFIX}n_repeat_words": r, f"{PREFIX}n_stutter": F.col(f"{PREFIX}words.s").cast("long"), f"{PREFIX}n_lines": F.col(f"{PREFIX}lines.n").cast("long"), f"{PREFIX}n_dup_lines": F.col(f"{PREFIX}lines.d").cast("long")}).drop(f"{PREFIX}words", f"{PREFIX}lines")


def windows_of(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return let(hashed, lambda v: F.when(F.size(v) < WINDOW, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(v, i, WINDOW)))))


def per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {PREFIX}{whole} > 0 THEN {PREFIX}{part} * 1000 div {PREFIX}{whole} ELSE 0L END")


def ratios() -> dict[str, Column]:
    """Whole per mille of each measure."""
    return {"symbols": per_mille("symbols", "chars"), "dup_lines": per_mille("n_dup_lines", "n_lines"), "repeats": per_mille("n_repeat_words", "n_words"), "stutter": per_mille("n_stutter", "n_words"), "capitals": per_mille("capitals", "chars"), "word_length": per_mille("chars", "n_words")}


def base_failed() -> Column:
    n = F.col(f"{PREFIX}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{PREFIX}n_repeat_words") > MOST_REPEATED * n)


def bucket(x: Column) -> Column:
    """The value with all but its 6 leading bits cleared."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Quartile fences of the sketches in ``counts`` (keys, ratio, bucket, n)."""
    w = Window.partitionBy(*keys, "ratio")
    c = counts.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    quartile = lambda q: F.min(F.when(4 * F.col("cum") >= q * F.col("all"), F.col("bucket")))
    q = c.groupBy(*keys, "ratio").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("docs"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv]), F.col("ratio"))
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), least.cast("long"))
    return q.withColumn("low", F.col("q1") - spread).withColumn("high", F.col("q3") + spread)


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per language and source, or fewer levels where those are small: (lang, source, low and high of each ratio)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()])
    passed = measured.where(~base_failed()).select("lang", "source", F.inline(pairs))
    fine = stash(passed.groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n")), "quality-sketches")
    by_lang = fine.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    every = by_lang.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    # each group of documents that was measured gets the fences of the first level that has enough documents
    groups = measured.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    a = fences(fine, ["lang", "source"]).where(F.col("docs") >= LEAST).select(F.col("lang").alias("al"), F.col("source").alias("as"), F.col("ratio").alias("ar"), F.struct("low", "high").alias("a"))
    b = fences(by_lang, ["lang"]).where(F.col("docs") >= LEAST).select(F.col("lang").alias("bl"), F.col("ratio").alias("br"), F.struct("low", "high").alias("b"))
    c = fences(every, []).select(F.col("ratio").alias("cr"), F.struct("low", "high").alias("c"))
    names = F.explode(F.array(*map(F.lit, RATIOS)))
    g = groups.select("lang", "source", names.alias("ratio"))
    g = g.join(a, g["lang"].eqNullSafe(F.col("al")) & g["source"].eqNullSafe(F.col("as")) & (g["ratio"] == F.col("ar")), "left")
    g = g.join(b, g["lang"].eqNullSafe(F.col("bl")) & (g["ratio"] == F.col("br")), "left").join(c, g["ratio"] == F.col("cr"), "left")
    f = F.coalesce("a", "b", "c")
    return g.groupBy(F.col("lang").alias(f"{PREFIX}lang"), F.col("source").alias(f"{PREFIX}source")).agg(*[F.max(F.when(F.col("ratio") == k, f[side])).alias(f"{PREFIX}{side}_{k}") for k in RATIOS for side in ("low", "high")])


def verdict(measured: DataFrame) -> DataFrame:
    """What ``measures`` gave, with ``__dw_base_failed`` and ``__dw_kept``. It is read more than once.

    A null text has no words and fails; null languages and sources are groups of their own; repeated rows are judged
    alike; an empty table stays empty. Columns of ``docs`` pass unchanged, whatever their names.
    """
    limits = broadcast_checked(stash(thresholds(measured), "quality-limits"))
    out = measured.join(limits, measured["lang"].eqNullSafe(limits[f"{PREFIX}lang"]) & measured["source"].eqNullSafe(limits[f"{PREFIX}source"]), "left")
    inside = F.lit(True)
    for k, v in ratios().items():
        inside = inside & F.coalesce((v <= F.col(f"{PREFIX}high_{k}")) & (v >= F.col(f"{PREFIX}low_{k}")), F.lit(True))
    return out.withColumn(f"{PREFIX}base_failed", base_failed()).withColumn(f"{PREFIX}kept", ~base_failed() & inside)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns as they are."""
    return verdict(stash(measures(docs), "quality-measures")).where(f"{PREFIX}kept").select(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    narrow = measures(docs).drop("text")
    measured = stash(narrow, "quality-measures")
    out = verdict(measured)
    p = lambda x: F.col(PREFIX + x).alias(x)
    return out.select("doc_id", p("n_words"), F.col(f"{PREFIX}chars").alias("word_chars"), F.col(f"{PREFIX}symbols").alias("n_symbols"), p("n_dup_lines"), p("n_repeat_words"), p("base_failed"), p("kept"))


def _oracle() -> str:
    least = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATIOS.items())
    level = lambda name, keys: f"{name} AS (SELECT {keys}ratio, q1 - {REACH} * greatest(q3 - q1, s) AS low, q3 + {REACH} * greatest(q3 - q1, s) AS high, n FROM (SELECT {keys}ratio, CASE ratio {least} END AS s, min(bucket) FILTER (4 * cum >= n) AS q1, min(bucket) FILTER (4 * cum >= 3 * n) AS q3, max(n) AS n FROM (SELECT *, sum(k) OVER (PARTITION BY {keys}ratio ORDER BY bucket) AS cum, sum(k) OVER (PARTITION BY {keys}ratio) AS n FROM (SELECT {keys}ratio, bucket, count(*) AS k FROM b GROUP BY ALL)) GROUP BY {keys}ratio))"
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE k > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS capitals FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'stutter', 'capitals', 'word_length']) AS ratio, unnest([CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_stutter * 1000 // n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN capitals * 1000 // word_chars ELSE 0 END, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END]) AS x FROM f),
b AS (SELECT lang, source, ratio, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bucket FROM v WHERE NOT base_failed),
{level("a1", "lang, source, ")}, {level("a2", "lang, ")}, {level("a3", "")},
j AS (SELECT v.doc_id, bool_and(coalesce(x >= coalesce(a1.low, a2.low, a3.low) AND x <= coalesce(a1.high, a2.high, a3.high), TRUE)) AS inside FROM v
  LEFT JOIN a1 ON a1.n >= {LEAST} AND a1.lang IS NOT DISTINCT FROM v.lang AND a1.source IS NOT DISTINCT FROM v.source AND a1.ratio = v.ratio
  LEFT JOIN a2 ON a2.n >= {LEAST} AND a2.lang IS NOT DISTINCT FROM v.lang AND a2.ratio = v.ratio LEFT JOIN a3 ON a3.ratio = v.ratio GROUP BY v.doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM f JOIN j ON f.doc_id = j.doc_id
"""


#: The same rows as DuckDB SQL.
ORACLE = _oracle()
