"""A session: corpus functions, every query's suggestions, filters, selection, and what is kept of it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import voice as V
from driftwell.operators import filters as S
from driftwell.operators import knn as K
from driftwell.operators import links as L
from driftwell.plans import discovery
from driftwell.plans.grammars import ready
from driftwell.plans.registry import QUERIES, Corpus
from driftwell.sources import sinks

SHOWN = 3
#: A query that fails so often in a row is not run any more.
FAILURES = 3


def text_of(name: str) -> str:
    return name.replace("_", " ")


def suggest(c: Corpus, name: str, found: DataFrame, seed: str, count: int = SHOWN) -> DataFrame:
    """(text, notes, query_id, title): ``count`` of a query's candidates in the seed's order, as sentences with references."""
    if "a" not in found.columns:
        return found.limit(0).select(F.lit("").alias("text"), F.array().cast("array<string>").alias("notes"), F.lit(name).alias("query_id"), F.lit(None).cast("string").alias("title"))
    other = F.col("b") if "b" in found.columns else F.lit(None).cast("string")
    key = F.concat_ws("|", "a", other)
    top = L.sampled(found.select("a", other.alias("b"), key.alias("key")), "key", count, f"{seed}:{name}")
    names = c.notes.select("path", "title")
    x, y = (names.select(F.col("path").alias(f"p{k}"), F.col("title").alias(f"t{k}")) for k in ("a", "b"))
    d = top.join(x, F.col("a") == F.col("pa")).join(y, F.col("b") == F.col("pb"), "left")
    text = F.when(F.col("tb").isNotNull(), F.format_string("What do [[%s]] and [[%s]] have to say to each other (" + text_of(name) + ")?", "ta", "tb")).otherwise(F.format_string("What if you returned to [[%s]] (" + text_of(name) + ")?", "ta"))
    return d.select(text.alias("text"), F.array_compact(F.array("ta", "tb")).alias("notes"), F.lit(name).alias("query_id"), F.lit(None).cast("string").alias("title"))


def functions(c: Corpus, seed: str = "20240701") -> dict[str, Callable[..., list[str]]]:
    """What grammars may call: names to functions that give references."""

    def refs(df: DataFrame) -> list[str]:
        return [f"[[{r[0]}]]" for r in df.join(c.notes.select("path", "title"), "path").select("title").collect()] if "title" not in df.columns else [f"[[{r['title']}]]" for r in df.collect()]

    def voiced(condition: str, order: str, n: int) -> list[str]:
        d = V.voice(c.own_notes).select("path", "title", "voice.*").where(condition)
        return refs(d.orderBy(F.desc(order), "path").limit(n))

    def clusters(n: int = 2, k: int = 3) -> list[str]:
        seeds = L.sampled(c.vectors, "path", n, f"cluster:{seed}").select("path")
        near = K.best(c.vectors.join(F.broadcast(seeds), "path", "left_semi").select("path", "embedding"), c.vectors, k)
        t = c.notes.select("path", "title")
        rows = near.join(t, "path").join(t.select(F.col("path").alias("neighbour"), F.col("title").alias("other")), "neighbour").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("o")).collect()
        return [f"[[{r['title']}]]|||" + ", ".join(f"[[{o['other']}]]" for o in r["o"]) for r in rows]

    def neighbours(title: str, n: int = 5) -> list[str]:
        one = c.vectors.join(c.notes.where(F.col("title") == title).select("path"), "path", "left_semi").select("path", "embedding")
        return refs(K.best(one, c.vectors, n).orderBy("rank").select(F.col("neighbour").alias("path")))

    def contrarian(title: str, n: int = 3) -> list[str]:
        one = c.vectors.join(c.notes.where(F.col("title") == title).select("path"), "path", "left_semi").select("path", "embedding")
        return refs(K.best(one, c.vectors, n, farthest=True).orderBy("rank").select(F.col("neighbour").alias("path")))

    def shifted(n: int = 5, least: float = 0.7) -> list[str]:
        d = K.neighbour_churn(c.vectors.select("path", "embedding"), c.sessions.where("session_id = 4").select("path", "embedding"))
        return refs(d.where(F.col("churn") >= least).orderBy(F.desc("churn"), "path").limit(n).select("path"))

    return {
        "sample_notes": lambda n=3: refs(L.sampled(c.notes, "path", n, f"{seed}:sample")),
        "random_note_title": lambda: refs(L.sampled(c.notes, "path", 1, f"{seed}:title")),
        "old_notes": lambda n=3: refs(c.notes.orderBy("modified", "path").limit(n)),
        "recent_notes": lambda n=3: refs(c.notes.orderBy(F.desc("modified"), "path").limit(n)),
        "orphans": lambda n=3: refs(L.orphans(c.notes, c.links, n)),
        "hubs": lambda n=3: refs(L.hubs(c.notes, c.links, n)),
        "neighbours": neighbours,
        "contrarian_to": contrarian,
        "semantic_clusters": clusters,
        "past_focused_notes": lambda n=3: voiced("orientation = 'past'", "past_tense_ratio", n),
        "future_focused_notes": lambda n=3: voiced("orientation = 'future'", "future_tense_ratio", n),
        "self_focused_notes": lambda n=3: voiced("self_focus_ratio > 0.8 AND first_person_singular_freq > 0", "self_focus_ratio", n),
        "we_notes": lambda n=3: voiced("first_person_plural_freq > 2.0", "first_person_plural_freq", n),
        "uncertain_notes": lambda n=3: voiced("hedging_ratio > 0.5", "hedging_ratio", n),
        "questioning_notes": lambda n=3: voiced("question_density > 1.0", "question_density", n),
        "surprising_notes": lambda n=3: refs(K.surprisal(c.vectors).orderBy(F.desc("surprisal"), "path").limit(n).select("path")),
        "attention_shifted_notes": shifted,
    }


@dataclass
class Status:
    """Failures in a row by query; a success clears them."""

    failures: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def disabled(self, name: str) -> bool:
        return self.failures.get(name, 0) >= FAILURES

    def record(self, name: str, seconds: float, error: str | None = None) -> None:
        self.seconds[name] = seconds
        self.failures[name] = self.failures.get(name, 0) + 1 if error else 0
        if error:
            self.errors[name] = error

    def reset(self, name: str) -> None:
        self.failures.pop(name, None)
        self.errors.pop(name, None)

    def save(self, spark: SparkSession, root: str) -> None:
        """Replace what ``root`` holds: a row a query."""
        rows = [(k, n, self.disabled(k), self.errors.get(k)) for k, n in sorted(self.failures.items())]
        table = spark.createDataFrame(rows, "query_id string, failure_count int, disabled boolean, last_error string")
        table.withColumn("updated", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(root)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Status:
        rows = spark.read.parquet(root).collect()
        return cls({r["query_id"]: r["failure_count"] for r in rows}, {r["query_id"]: r["last_error"] for r in rows if r["last_error"]})


def run_query(c: Corpus, name: str, f: Callable[[Corpus], DataFrame], seed: str, status: Status, timeout: float = 30.0) -> list | None:
    """A query's suggestions, or none if it fails, is disabled or takes too long; its jobs are cancelled then."""
    if status.disabled(name):
        return None
    sc, began = c.spark.sparkContext, time.time()
    tag = f"query-{name}"
    sc.addJobTag(tag)
    timer = threading.Timer(timeout, sc.cancelJobsWithTag, (tag,))
    timer.start()
    try:
        rows = suggest(c, name, f(c), seed).collect()
        status.record(name, time.time() - began)
        return rows
    except Exception as e:  # noqa: BLE001  whatever a query raises counts against it alone
        status.record(name, time.time() - began, str(e)[:500])
        return None
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def every_query() -> dict[str, Callable[[Corpus], DataFrame]]:
    """The discovery queries by name."""
    return {k: f for k, f in vars(discovery).items() if k in QUERIES and callable(f)}


def invoke(
    c: Corpus, names: list[str] | None = None, session: str = "2024-07-01", count: int = 5, full: bool = False, status: Status | None = None, limits: S.Limits = S.Limits(), timeout: float = 30.0,
    excluded: tuple[str, ...] = (), embed: Callable[[DataFrame], DataFrame] | None = None, grammars: list[str] | None = None, history_root: str | None = None, journal: str | None = None,
) -> DataFrame:
    """Suggestions of the named queries and grammars (all queries and no grammar if none are named), filtered and selected:
    (ord, text, notes, query_id, title).

    ``embed`` gives suggestions (ord, text) their vectors (ord, embedding); novelty and diversity then go by these, and
    without it by equal texts. A step of ``limits.strategies`` that is not known raises. What is selected is appended to
    ``history_root`` and written as a note to the folder ``journal``, if these are given.
    """
    status, seed = status or Status(), session.replace("-", "")
    every = every_query()
    unknown = [k for k in names or () if k not in every]
    if unknown:
        raise ValueError(f"no such queries: {unknown}")
    rows = [tuple(r) for k in names or sorted(every) for r in run_query(c, k, every[k], seed, status, timeout) or ()]
    for g in grammars or ():
        rows += [(text, notes, g, None) for text, notes in ready(g).suggest(functions(c, seed), int(seed))]
    table = [(i, text, list(notes), name, title) for i, (text, notes, name, title) in enumerate(rows)]
    s = c.spark.createDataFrame(table, "ord bigint, text string, notes array<string>, query_id string, title string")

    def novelty(x: DataFrame) -> DataFrame:
        x = S.novelty_text(x, c.history, session, limits)
        if embed is None:
            return x
        past = S.recent(c.history, session, limits.novelty_days).select(F.xxhash64("text").alias("ord"), "text").distinct()
        new, old = (embed(d.select("ord", "text")).select(F.concat(F.lit(k), F.col("ord").cast("string")).alias("path"), "embedding") for k, d in (("", x), ("past ", past)))
        return S.novelty_vectors(x, new, old, limits)

    def diversity(x: DataFrame) -> DataFrame:
        if embed is None:
            first = x.groupBy("text").agg(F.min("ord").alias("ord"))
            return x.join(first.select("ord"), "ord", "left_semi")
        return S.diversity(x.join(embed(x.select("ord", "text")).select("ord", "embedding"), "ord"), limits).drop("embedding")

    steps: dict[str, Callable[[DataFrame], DataFrame]] = {"boundary": lambda x: S.boundary(x, c.notes, excluded), "novelty": novelty, "diversity": diversity, "quality": lambda x: S.quality(x, limits)}
    odd = [k for k in limits.strategies if k not in steps]
    if odd:
        raise ValueError(f"no such filters: {odd}")
    s = S.select(reduce(lambda x, k: steps[k](x), limits.strategies, s), count, seed, full)
    if history_root:
        sinks.append_history(s, history_root, session)
    if journal:
        sinks.write_journal(s, journal, session)
    return s


def trial(c: Corpus, names: list[str] | None = None, session: str = "2024-07-01", timeout: float = 30.0) -> dict[str, tuple[int, float, str | None]]:
    """Each query on its own, without filters: how many suggestions it gives, in how many seconds, and its error."""
    status, out = Status(), {}
    for name, f in every_query().items():
        if names is None or name in names:
            rows = run_query(c, name, f, session.replace("-", ""), status, timeout)
            out[name] = (len(rows or ()), round(status.seconds[name], 3), status.errors.get(name))
    return out
