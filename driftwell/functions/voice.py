"""Linguistic features of texts as columns: sentences, tokens, tense, pronouns, hedges, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: hedge phrases
HEDGES = (
    "maybe", "perhaps", "possibly", "probably", "apparently", "seems", "appears", "suggests", "might", "could", "may", "somewhat", "rather", "fairly",
    "roughly", "approximately", "in a way", "sort of", "kind of", "i think", "i believe", "i guess", "i suppose", "it seems", "arguably",
    "presumably",
)
# fixed values: irregular past forms
PAST = (
    "arose", "ate", "awoke", "bade", "beat", "became", "befell", "began", "beheld", "bent", "bet", "bit", "bled", "blew", "bore", "bought", "bound",
    "bred", "broke", "brought", "built", "burnt", "burst", "came", "cast", "caught", "chose", "clung", "cost", "crept", "cut", "dealt", "did", "dove",
    "drank", "drew", "dreamt", "drove", "dug", "fed", "fell", "felt", "fled", "flew", "flung", "forbade", "foresaw", "forgave", "forgot", "fought",
    "found", "froze", "gave", "got", "grew", "ground", "had", "heard", "held", "hid", "hit", "hung", "hurt", "kept", "knelt", "knew", "laid", "lay",
    "leant", "leapt", "learnt", "led", "left", "lent", "let", "lit", "lost", "made", "meant", "met", "mistook", "outgrew", "overcame", "overheard",
    "oversaw", "overthrew", "paid", "partook", "put", "quit", "ran", "rang", "read", "rebuilt", "repaid", "rethought", "rewrote", "rid", "rode",
    "rose", "said", "sang", "sank", "sat", "saw", "sent", "set", "sewed", "shed", "shone", "shook", "shot", "showed", "shrank", "shut", "slept",
    "slew", "slid", "slung", "smelt", "sold", "sought", "sowed", "spat", "sped", "spelt", "spent", "spilt", "split", "spoilt", "spoke", "sprang",
    "spread", "spun", "stank", "stole", "stood", "strode", "strove", "struck", "stuck", "stung", "swam", "swept", "swore", "swung", "taught",
    "thought", "threw", "thrust", "told", "took", "tore", "trod", "undertook", "underwent", "understood", "undid", "unwound", "upheld", "upset",
    "was", "went", "wept", "were", "withdrew", "withheld", "withstood", "woke", "won", "wore", "wound", "wove", "wrote", "wrung",
)
# fixed values: token sets
FUTURE = ("will", "shall", "won't")
PRESENT = ("is", "are", "am", "be", "being", "do", "does", "has")
SINGULAR = ("i", "me", "my", "mine", "myself")
PLURAL = ("we", "us", "our", "ours", "ourselves")
SECOND = ("you", "your", "yours", "yourself", "yourselves")
MODALS = ("might", "could", "may", "would", "should")

HEDGE_LIST = sorted(HEDGES, key=lambda x: (-len(x), x))
PAST_LIST = list(PAST)


def for_analysis(content: Column) -> Column:
    """Text without front matter, fenced and inline code and addresses; each leaves a space."""
    out = F.regexp_replace(content, r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\z)", " ")
    for pattern in (r"(?ms)^(```|~~~).*?^\1", r"`[^`\n]+`", r"(?:https?://|www\.)\S+"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+(?:'\w+)*"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.btrim(s)), lambda s: F.btrim(s, F.lit(" \t\n\r")) != "")


def hedges(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(HEDGE_LIST) + r")\b")).cast("long")


def _in(words: tuple[str, ...] | list[str]):  # noqa: ANN202
    return lambda t: t.isin(*words)


def tense(token: Column) -> Column:
    """past, future, present or null; the first that fits."""
    past = token.isin(*PAST_LIST) | (token.endswith("ed") & (F.length(token) > 3))
    present = token.isin(*PRESENT) | (token.endswith("ing") & (F.length(token) > 4))
    return F.when(past, "past").when(token.isin(*FUTURE), "future").when(present, "present")


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(none))


def voice(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with a struct ``voice`` of 13 measures and an orientation.

    Tenses are shares of the verbs found; pronouns and questions are per 100 words; hedges per sentence.
    """
    text = for_analysis(F.coalesce(F.col(content), F.lit("")))
    d = df.withColumn("__t", text).withColumn("__w", tokens(F.col("__t"))).withColumn("__s", F.transform(sentences(F.col("__t")), lambda s: F.size(tokens(s)).cast("double")))
    kinds = F.transform("__w", tense)
    count = lambda words: F.size(F.filter("__w", _in(words))).cast("double")
    d = d.withColumn("__k", kinds).withColumn("__n", F.size("__w").cast("double"))
    of = lambda name: F.size(F.filter("__k", lambda k: k == name)).cast("double")
    going = F.regexp_count("__t", F.lit(r"(?i)\bgoing to\b|\bgonna\b")).cast("double")
    d = d.withColumn("__p", of("past")).withColumn("__f", of("future") + going).withColumn("__r", of("present"))
    d = d.withColumn("__v", F.col("__p") + F.col("__f") + F.col("__r")).withColumn("__one", count(SINGULAR)).withColumn("__two", count(PLURAL))
    n, v = F.col("__n"), F.col("__v")
    s = F.filter("__s", lambda x: x > 0)
    ns = F.size(s)
    mean = ratio(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), ns)
    d = d.withColumn("__m", mean).withColumn("__ns", ns)
    # from sums, so that no lambda holds an expression over the whole text
    squares = ratio(F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x), F.col("__ns"))
    spread = F.greatest(F.lit(0.0), squares - F.col("__m") * F.col("__m"))
    past, future, present = (ratio(F.col(c), v) for c in ("__p", "__f", "__r"))
    per100 = lambda c: ratio(100 * c, n)
    measures = {
        "past_tense_ratio": past, "present_tense_ratio": present, "future_tense_ratio": future, "first_person_singular_freq": per100(F.col("__one")), "first_person_plural_freq": per100(F.col("__two")), "second_person_freq": per100(count(SECOND)),
        "self_focus_ratio": ratio(F.col("__one"), F.col("__one") + F.col("__two"), 0.5), "hedging_ratio": ratio(hedges(F.col("__t")).cast("double"), F.col("__ns")), "question_density": per100(F.regexp_count("__t", F.lit(r"\?")).cast("double")),
        "modal_freq": per100(count(MODALS)), "mean_sentence_length": F.col("__m"), "sentence_length_variance": spread, "type_token_ratio": ratio(F.size(F.array_distinct("__w")).cast("double"), n),
    }
    orientation = F.when(past > 0.6, "past").when(future > 0.4, "future").when(present > 0.7, "present").otherwise("mixed")
    out = d.withColumn("voice", F.struct(*[x.alias(k) for k, x in measures.items()], orientation.alias("orientation")))
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in df.columns])


def metadata(notes: DataFrame, links: DataFrame | None = None, session: str = "2024-07-01") -> DataFrame:
    """(path, …): counts, ages against the session's date, staleness, tasks, lexical diversity, reading time."""
    from driftwell.functions import markdown as M

    w = M.words(F.col("content"))
    d = notes.withColumn("__w", w)
    n = F.size("__w").cast("long")
    day = F.lit(session).cast("date")
    idle = F.greatest(F.datediff(day, F.col("modified").cast("date")), F.lit(0))
    opened, done = M.open_tasks(F.col("content")), M.done_tasks(F.col("content"))
    return d.select(
        "path", n.alias("word_count"), F.size("links").cast("long").alias("link_count"), F.size("tags").cast("long").alias("tag_count"), F.greatest(F.datediff(day, F.col("created").cast("date")), F.lit(0)).alias("age_days"), idle.alias("days_since_modified"),
        F.round(1 - 1 / (1 + idle / 30), 3).alias("staleness"), (opened + done > 0).alias("has_tasks"), (opened + done).alias("task_count"), done.alias("completed_task_count"),
        F.round(ratio(F.size(F.array_distinct(F.transform("__w", F.lower))).cast("double"), n), 3).alias("lexical_diversity"), F.round(n / 200, 2).alias("reading_time"),
    )


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer").when(m.between(9, 11), "Fall").otherwise("Winter")
