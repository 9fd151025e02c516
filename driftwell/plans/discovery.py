"""Discovery queries: each finds the notes, or pairs of notes, that a suggestion is about.

A query gives all its candidates as (a, b or others, measures); ``b`` is null where one note is meant. Which of them a
session shows is decided after that, by ``session.suggest``, in an order that depends on the session's date alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import voice as V
from driftwell.operators import clusters as C
from driftwell.operators import extraction as X
from driftwell.operators import graph as G
from driftwell.operators import knn as K
from driftwell.operators import links as L
from driftwell.operators import reach as R
from driftwell.operators import sessions as T
from driftwell.plans.registry import Corpus, query
from driftwell.storage import stash

# ruff: noqa: D103
SESSION = "2024-07-01"
VERY_HIGH, HIGH, MODERATE, WEAK, NOISE = 0.80, 0.65, 0.50, 0.35, 0.15
# fixed values: word lists of the keyword predicates; all are substrings
CLAIMS = ("is", "are", "must", "should", "always", "never", "will", "cannot", "impossible", "necessary", "essential", "fundamental", "critical", "key", "important", "proves")
NEGATIONS = ("not", "no", "never", "contra", "anti", "against", "opposite", "reverse")
CERTAIN = ("obviously", "clearly", "of course", "everyone knows", "it is well known", "naturally", "needless to say", "without a doubt", "certainly", "undoubtedly", "must be", "has to", "necessarily", "always")
DOUBTFUL = ("maybe", "perhaps", "might", "could be", "possibly", "uncertain", "unclear", "debatable", "questionable", "depends", "varies", "sometimes")
CAUSAL = ("because", "therefore", "thus", "hence", "leads to", "results in", "causes", "due to")
ASSERTIONS = ("all ", "never ", "always ", "must ", "should ", "is ", "are ")
POSITIVE = ("always", "all", "must", "should")
NEGATIVE = ("never", "no", "not", "cannot", "but", "however", "except")
ABSTRACT = ("theory", "principle", "concept", "framework", "paradigm", "model", "pattern", "system", "structure", "abstract", "general", "universal", "category", "class")
CONCRETE = ("example", "case", "instance", "specific", "particular", "detail", "concrete", "actual", "practical", "real", "individual", "tangible", "implementation")

META = "m AS (SELECT x.*, (SELECT count(*) FROM backlinks b WHERE b.path = x.path) AS back FROM meta x WHERE path NOT LIKE 'session journal/%') ;; "


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text has, as substrings."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def day(text: str = SESSION) -> Column:
    return F.lit(text).cast("date")


def meta(c: Corpus, own: bool = True) -> DataFrame:
    """Metadata with ``in_links``, outside the journal if ``own``."""
    return V.metadata(c.own_notes if own else c.notes).join(L.degrees(c.notes, c.links).select("path", "in_links"), "path")


def near(c: Corpus, k: int, of_these: DataFrame | None = None) -> DataFrame:
    """(a, b, sim, rank), similarities clipped at 0; of few notes (path) only, if given."""
    rows = c.vectors if of_these is None else c.vectors.join(F.broadcast(of_these.select("path")), "path", "left_semi")
    return K.best(rows, c.vectors, k).select(F.col("path").alias("a"), F.col("neighbour").alias("b"), F.greatest("sim", F.lit(0.0)).alias("sim"), "rank")


def of(c: Corpus, side: str, **columns: Column) -> DataFrame:
    """Columns of notes under a pair's side."""
    text = c.notes.withColumn("text", F.lower("content"))
    return text.select(F.col("path").alias(side), *[x.alias(f"{side}_{k}") for k, x in columns.items()])


def ago(column: str) -> Column:
    return F.datediff(day(), F.col(column).cast("date"))


def pair(df: DataFrame, *more: str) -> DataFrame:
    return df.select("a", "b", *more)


def one(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("path").alias("a"), *more)


# links and metadata


@query(META + "SELECT path AS a, CAST(word_count AS BIGINT) AS word_count, CAST(link_count + back AS BIGINT) AS links FROM m WHERE word_count < 50 AND link_count + back > 0", "meta", "backlinks")
def stub_expander(c: Corpus) -> DataFrame:
    return one(meta(c).withColumn("links", F.col("link_count") + F.col("in_links")).where("word_count < 50 AND links > 0"), "word_count", "links")


@query(META + "SELECT path AS a, CAST(open_ AS BIGINT) AS open_tasks, CAST(days_since_modified AS INT) AS days_since_modified FROM m WHERE open_ > 0 AND days_since_modified > 30", "meta", "backlinks")
def task_archaeology(c: Corpus) -> DataFrame:
    return one(meta(c).withColumn("open_tasks", F.col("task_count") - F.col("completed_task_count")).where("open_tasks > 0 AND days_since_modified > 30"), "open_tasks", "days_since_modified")


@query(META + "SELECT path AS a, CAST(word_count AS BIGINT) AS word_count, CAST(link_count AS BIGINT) AS link_count, CASE WHEN 100 * link_count / word_count > 5 THEN 'many' ELSE 'few' END AS density FROM m WHERE word_count >= 50 AND (100 * link_count / word_count > 5 OR (100 * link_count / word_count < 0.5 AND word_count > 200))", "meta", "backlinks")
def link_density_analyser(c: Corpus) -> DataFrame:
    per = 100 * F.col("link_count") / F.col("word_count")
    d = meta(c).where("word_count >= 50").withColumn("per", per).where("per > 5 OR (per < 0.5 AND word_count > 200)")
    return one(d.withColumn("density", F.when(F.col("per") > 5, "many").otherwise("few")), "word_count", "link_count", "density")


@query("b AS (SELECT x.*, (SELECT count(*) FROM backlinks k WHERE k.path = x.path) AS back, (SELECT count(*) FROM notes) AS n FROM meta x) ;; SELECT path AS a, CAST(word_count AS BIGINT) AS word_count, CASE WHEN (link_count + 2 * back) / n > 0.1 AND word_count < 100 THEN 'thin' ELSE 'long' END AS kind FROM b WHERE ((link_count + 2 * back) / n > 0.1 AND word_count < 100) OR ((link_count + 2 * back) / n < 0.05 AND word_count > 300 AND link_count < 2)", "meta", "backlinks", "notes")
def complexity_mismatch(c: Corpus) -> DataFrame:
    """Importance is (links + 2 backlinks) / N; its bounds are parameters."""
    return complexity(c)


def complexity(c: Corpus, high: float = 0.1, low: float = 0.05) -> DataFrame:
    n = F.broadcast(c.notes.agg(F.count("*").alias("n")))
    d = meta(c, own=False).join(n).withColumn("importance", (F.col("link_count") + 2 * F.col("in_links")) / F.col("n"))
    thin, long = (F.col("importance") > high) & (F.col("word_count") < 100), (F.col("importance") < low) & (F.col("word_count") > 300) & (F.col("link_count") < 2)
    return one(d.where(thin | long).withColumn("kind", F.when(thin, "thin").otherwise("long")), "word_count", "kind")


@query(META.replace(" ;; ", ", ") + "o AS (SELECT *, row_number() OVER (ORDER BY days_since_modified DESC, path) AS k FROM m) ;; SELECT path AS a, CAST(days_since_modified AS INT) AS days_since_modified, CAST(link_count AS BIGINT) AS link_count FROM o WHERE k <= 30 AND round(1 - 1 / (1 + days_since_modified / 30), 3) > 0.7 AND link_count >= 3", "meta", "backlinks")
def temporal_drift(c: Corpus) -> DataFrame:
    old = meta(c).orderBy(F.desc("days_since_modified"), "path").limit(30)
    return one(old.where("staleness > 0.7 AND link_count >= 3"), "days_since_modified", "link_count")


@query("SELECT n.path AS a, title FROM notes n JOIN meta m ON n.path = m.path WHERE title NOT LIKE '%?' AND word_count > 50", "notes", "meta")
def question_generator(c: Corpus) -> DataFrame:
    return one(c.notes.join(V.metadata(c.notes).select("path", "word_count"), "path").where("NOT endswith(title, '?') AND word_count > 50"), "title")


@query(META + "SELECT path AS a, CASE WHEN word_count > 0 AND round(distinct_ / word_count, 3) > 0.6 AND age > 90 THEN 'rich_old' ELSE 'open_old' END AS kind FROM (SELECT *, days_since_modified AS age FROM m) WHERE (word_count > 0 AND round(distinct_ / word_count, 3) > 0.6 AND age > 90) OR (open_ > 0 AND age > 60)", "meta", "backlinks")
def metadata_driven_discovery(c: Corpus) -> DataFrame:
    d = meta(c)
    rich = (F.col("lexical_diversity") > 0.6) & (F.col("days_since_modified") > 90)
    waiting = (F.col("task_count") - F.col("completed_task_count") > 0) & (F.col("days_since_modified") > 60)
    return one(d.where(rich | waiting).withColumn("kind", F.when(rich, "rich_old").otherwise("open_old")), "kind")


@query()
def metadata_outlier_detector(c: Corpus) -> DataFrame:
    m = V.metadata(c.notes).select("path", "word_count")
    s = F.broadcast(m.agg(F.avg("word_count").alias("m"), F.stddev_pop("word_count").alias("s"), F.percentile("word_count", F.lit(0.5)).alias("median")))
    return one(m.join(s).where("s > 1e-10 AND abs((word_count - m) / s) > 2"), F.col("word_count").cast("bigint").alias("word_count"), "median")


def kind_of_text(content: Column) -> Column:
    """task, list, code, prose or mixed, by what share of the lines shows it."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    share = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))) / F.greatest(F.size(lines), F.lit(1))
    fenced = F.regexp_count(content, F.lit("(?m)^```"))
    return F.when(share(r"^\s*[-*] \[[ xX]\]") > 0.2, "task").when(fenced >= 2, "code").when(share(r"^\s*([-*+]|\d+\.) ") > 0.3, "list").when(share(r"^\s*([-*+#>]|\d+\.)") < 0.1, "prose").otherwise("mixed")


@query()
def structure_diversity_checker(c: Corpus) -> DataFrame:
    """A note of another kind than that which dominates the last eight."""
    kinds = c.notes.select("path", "modified", kind_of_text(F.col("content")).alias("kind"))
    last = kinds.orderBy(F.desc("modified"), "path").limit(8)
    top = last.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(1).where("n >= 0.7 * 8").select(F.col("kind").alias("usual"))
    return one(kinds.join(F.broadcast(top)).where("kind <> usual"), "kind", "usual")


# time


@query("SELECT path AS a, CAST(2024 - year(created) AS INT) AS years FROM own WHERE month(created) = 7 AND day(created) = 1 AND year(created) < 2024 ORDER BY created DESC, path LIMIT 3", "own")
def on_this_day_recall(c: Corpus) -> DataFrame:
    d = F.col("created")
    hit = c.own_notes.where((F.month(d) == F.month(day())) & (F.dayofmonth(d) == F.dayofmonth(day())) & (F.year(d) < F.year(day())))
    return one(hit.orderBy(F.desc("created"), "path").limit(3).withColumn("years", F.year(day()) - F.year(d)), "years")


@query("SELECT path AS a FROM own WHERE month(created) BETWEEN 6 AND 8 AND year(created) < 2024 ORDER BY created DESC, path LIMIT 3", "own")
def seasonal_revisit(c: Corpus) -> DataFrame:
    d = F.col("created")
    return one(c.own_notes.where((V.season(d) == V.season(day())) & (F.year(d) < F.year(day()))).orderBy(F.desc("created"), "path").limit(3))


@query("SELECT path AS a, CAST(min(k) AS INT) AS years FROM own, (VALUES (1), (2), (3)) AS t(k) WHERE abs(created - CAST(DATE '2024-07-01' - to_years(CAST(k AS INT)) AS DATE)) <= 7 GROUP BY path", "own")
def this_time_last_year(c: Corpus) -> DataFrame:
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    d = c.own_notes.select("path", "created", k.alias("years")).where(F.abs(F.datediff(F.col("created").cast("date"), F.add_months(day(), -12 * F.col("years")))) <= 7)
    return d.groupBy(F.col("path").alias("a")).agg(F.min("years").alias("years"))


@query("SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS n FROM own GROUP BY created HAVING count(*) >= 3", "own")
def creation_burst(c: Corpus) -> DataFrame:
    return c.own_notes.groupBy(F.date_format("created", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("n >= 3")


@query()
def burst_evolution(c: Corpus) -> DataFrame:
    """Days on which three notes or more began, with how far these have drifted since."""
    d = c.own_notes.select("path", F.date_format("created", "yyyy-MM-dd").alias("day")).join(T.total_drift(c.sessions).select("path", "drift"), "path")
    g = d.groupBy("day").agg(F.count("*").alias("n"), F.avg("drift").alias("drift")).where("n >= 3")
    g = g.withColumn("drift", F.round("drift", 6))
    return g.withColumn("label", F.when(F.col("drift") > 0.45, "transformed").when(F.col("drift") < 0.15, "stable").otherwise("evolving"))


@query("d AS (SELECT path, least((row_number() OVER (ORDER BY created, path) - 1) // greatest(1, (SELECT count(*) FROM own) // 10), 9) AS period FROM own) ;; SELECT CAST(period AS INT) AS period, min(path) AS a, count(*) AS n FROM d GROUP BY period", "own")
def temporal_mirror(c: Corpus) -> DataFrame:
    return T.decile_periods(c.own_notes).groupBy("period").agg(F.min("path").alias("a"), F.count("*").alias("n"))


@query()
def temporal_clustering(c: Corpus) -> DataFrame:
    """90-day bins of five notes or more and how alike their notes are."""
    b = T.quarter_bins(c.own_notes, SESSION)
    v = c.vectors.select("path", "embedding").join(b, "path")
    unit = v.select("bin", "path", F.transform("embedding", lambda x: x / K.norm(F.col("embedding"))).alias("embedding"))
    g = T._elementwise_mean(unit, "bin").join(unit.groupBy("bin").agg(F.count("*").alias("n")), "bin").where("n >= 5")
    # the mean of all pairs follows from the mean vector's length
    return g.select("bin", "n", F.round((F.col("n") * K.dot(F.col("mean"), F.col("mean")) - 1) / (F.col("n") - 1), 6).alias("sim")).where("sim > 0.5")


@query("SELECT CAST(month(created) AS INT) AS month, count(*) AS n, count(DISTINCT year(created)) AS years FROM own GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT year(created)) >= 2", "own")
def seasonal_patterns(c: Corpus) -> DataFrame:
    return c.own_notes.groupBy(F.month("created").alias("month")).agg(F.count("*").alias("n"), F.countDistinct(F.year("created")).alias("years")).where("n >= 5 AND years >= 2")


@query()
def seasonal_topic_analysis(c: Corpus) -> DataFrame:
    """Notes of this season that lie near the season's first note."""
    now = c.own_notes.where(V.season(F.col("created")) == V.season(day())).select("path", "created")
    v = c.vectors.join(now, "path")
    anchor = v.orderBy("created", "path").limit(1).select("path", "embedding")
    return K.anchored(v.select("path", "embedding"), anchor).where("most >= 0.6").select(F.col("path").alias("a"), F.round("most", 6).alias("sim"))


@query()
def anachronism_detector(c: Corpus) -> DataFrame:
    """Recent notes that are nearer to old ones than to their own time."""
    v = c.vectors.select("path", "embedding").join(c.notes.select("path", "created"), "path")
    recent, old = v.where(ago("created") < 90), v.where(ago("created") > 365)
    few = lambda x, s: L.sampled(x, "path", 10, s).select("path", "embedding")
    a = K.anchored(recent.select("path", "embedding"), few(old, "old")).select("path", F.col("most").alias("old"))
    b = K.anchored(recent.select("path", "embedding"), few(recent, "new")).select("path", F.col("mean").alias("now"))
    return one(a.join(b, "path").where("old > now + 0.15"), F.round("old", 6).alias("old"), F.round("now", 6).alias("now"))


@query(META + "SELECT path AS a, neighbour AS b FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank) AS k FROM (SELECT k.* FROM knn k JOIN (SELECT path FROM own ORDER BY modified DESC, path LIMIT 10) r ON r.path = k.path JOIN notes n ON n.path = k.neighbour WHERE DATE '2024-07-01' - n.modified > 60)) WHERE k = 1", "meta", "backlinks", "knn", "own", "notes")
def recent_focus(c: Corpus) -> DataFrame:
    recent = c.own_notes.orderBy(F.desc("modified"), "path").limit(10).select("path")
    old = c.notes.where(ago("modified") > 60).select(F.col("path").alias("b"))
    d = near(c, 10, recent).join(old, "b", "left_semi")
    return d.groupBy("a").agg(F.min_by("b", "rank").alias("b"))


@query()
def blind_spot_detector(c: Corpus) -> DataFrame:
    """For recent notes, the note least like each if it is stale or nobody links to it."""
    recent = L.sampled(c.own_notes.orderBy(F.desc("modified"), "path").limit(10), "path", 5, SESSION)
    v = c.vectors.select("path", "embedding")
    far = K.best(v.join(F.broadcast(recent.select("path")), "path", "left_semi"), v, 1, farthest=True).select(F.col("path").alias("a"), F.col("neighbour").alias("b"))
    m = meta(c, own=False).select(F.col("path").alias("b"), "days_since_modified", "in_links")
    return pair(far.join(m, "b").where("days_since_modified > 180 OR in_links = 0"), F.col("days_since_modified").cast("int").alias("days_since_modified"), F.col("in_links").cast("bigint").alias("in_links"))


# graph and vectors


@query("h AS (SELECT path, count(DISTINCT source_path) AS n FROM backlinks GROUP BY path ORDER BY n DESC, path LIMIT 10) ;; SELECT k.path AS a, k.neighbour AS b FROM knn k JOIN h ON h.path = k.path WHERE k.sim > 0.65 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = least(k.path, k.neighbour) AND e.b = greatest(k.path, k.neighbour))", "backlinks", "knn", "edges")
def bridge_builder(c: Corpus) -> DataFrame:
    return hub_bridges(c)


def hub_bridges(c: Corpus, least: float = HIGH) -> DataFrame:
    """Hubs and near notes that they are not linked with."""
    h = L.find_hubs(c.notes, c.links, 1).orderBy(F.desc("backlinks"), "path").limit(10).select("path")
    return pair(L.unlinked(near(c, 10, h).where(F.col("sim") > least), c.edges))


@query("u AS (SELECT a, b FROM sims s WHERE sim > 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = s.a AND e.b = s.b) ORDER BY round(sim, 12) DESC, a, b LIMIT 20), p AS (SELECT u.a, u.b, x.neighbour AS m1, y.neighbour AS m2, (x.sim + y.sim + list_cosine_similarity(v1.e, v2.e)) / 3 AS s FROM u JOIN knn x ON x.path = u.a JOIN knn y ON y.path = u.b JOIN v v1 ON v1.path = x.neighbour JOIN v v2 ON v2.path = y.neighbour WHERE x.neighbour <> y.neighbour AND x.neighbour <> u.b AND y.neighbour <> u.a) ;; SELECT a, b, round(max(s), 6) AS mean FROM p GROUP BY a, b", "sims", "edges", "knn", "v")
def bridge_hunter(c: Corpus) -> DataFrame:
    """Over the best unlinked pairs: how good the best walk of three steps between them is."""
    u = F.broadcast(K.best_unlinked(c.vectors, c.edges, 0.3, 20).select("a", "b"))
    k = K.nearest(c.vectors, 10)
    x, y = (k.select(F.col("path").alias(s), F.col("neighbour").alias(f"m{s}"), F.col("sim").alias(f"s{s}")) for s in ("a", "b"))
    p = u.join(x, "a").join(y, "b").where("ma <> mb AND ma <> b AND mb <> a")
    p = K.similarity(p, c.vectors, "ma", "mb", clip=False)
    return p.groupBy("a", "b").agg(F.round(F.max((F.col("sa") + F.col("sb") + F.col("sim")) / 3), 6).alias("mean"))


@query()
def load_bearing_bridge(c: Corpus) -> DataFrame:
    return G.bridged_pairs(c.edges, c.vectors, 0.3)


@query("d AS (SELECT n.path, (SELECT count(*) FROM links l WHERE l.source_path = n.path) + (SELECT count(*) FROM backlinks b WHERE b.path = n.path) AS deg FROM notes n), x AS (SELECT a AS path, count(*) AS n FROM cross_ WHERE sim > 0.65 GROUP BY a) ;; SELECT d.path AS a, least(x.n, 30) AS alike, CAST(d.deg AS BIGINT) AS links FROM d JOIN x ON d.path = x.path WHERE x.n > 10 AND d.deg < 5", "notes", "links", "backlinks", "cross_")
def hidden_hub(c: Corpus) -> DataFrame:
    return quiet_hubs(c)


def quiet_hubs(c: Corpus, least: float = HIGH, wide: int = 30) -> DataFrame:
    """Notes that many of their nearest are alike, and few link with."""
    alike = near(c, wide).where(F.col("sim") > least).groupBy("a").agg(F.count("*").alias("alike")).where("alike > 10")
    deg = L.degrees(c.notes, c.links).select(F.col("path").alias("a"), (F.col("out_links") + F.col("in_links")).alias("links"))
    return alike.join(deg, "a").where("links < 5")


@query("h AS (SELECT path, count(*) AS n FROM backlinks GROUP BY path ORDER BY n DESC, path LIMIT 5), g AS (SELECT h.path AS hub, h.path AS member FROM h UNION SELECT h.path, b.source_path FROM h JOIN backlinks b ON b.path = h.path), s AS (SELECT g.hub, y.path AS b, avg(list_cosine_similarity(x.e, y.e)) AS s FROM g JOIN v x ON x.path = g.member, v y WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.hub = g.hub AND o.member = y.path) GROUP BY g.hub, y.path) ;; SELECT hub AS a, arg_max(b, printf('%.9f', s + 1)) AS b, round(max(s), 6) AS sim FROM s GROUP BY hub", "backlinks", "v")
def island_hopper(c: Corpus) -> DataFrame:
    """For each hub with its linking notes, the outsider that is nearest to them on average."""
    h = L.find_hubs(c.notes, c.links, 1).orderBy(F.desc("backlinks"), "path").limit(5).select("path")
    b = L.backlinks(c.notes, c.links).join(F.broadcast(h), "path", "left_semi")
    g = h.select(F.col("path").alias("a"), F.col("path").alias("member")).unionByName(b.select(F.col("path").alias("a"), F.col("source_path").alias("member"))).distinct()
    unit = c.vectors.select("path", F.transform("embedding", lambda x: x / K.norm(F.col("embedding"))).alias("embedding"))
    # the mean cosine to a group is the product with the mean of its unit vectors
    mean = F.broadcast(T._elementwise_mean(g.join(unit, g["member"] == unit["path"]).select("a", "embedding"), "a"))
    s = unit.join(mean).select("a", F.col("path").alias("b"), F.round(K.dot(F.col("embedding"), F.col("mean")), 9).alias("s"))
    s = s.join(g.select("a", F.col("member").alias("b")), ["a", "b"], "left_anti")
    return s.groupBy("a").agg(F.max_by("b", "s").alias("b"), F.round(F.max("s"), 6).alias("sim"))


@query()
def density_inversion(c: Corpus) -> DataFrame:
    """Notes whose neighbours are linked with one another and unlike, or alike and not linked."""
    edges = stash(c.edges, "edges")
    dense = stash(G.neighbourhood_density(edges).where("density > 0.6 OR density < 0.3"), "density")
    n = G.beside(edges, c.vectors).join(dense.select(F.col("path").alias("a")), "a", "left_semi")
    three = n.groupBy("a").agg(F.count("*").alias("n")).where("n >= 3").select("a")
    sem = K.mean_alike(n.join(three, "a", "left_semi")).withColumnRenamed("a", "path")
    d = dense.join(sem, "path").where("(density > 0.6 AND alike < 0.3) OR (density < 0.3 AND alike > 0.6)")
    return one(d, F.round("density", 6).alias("density"), F.round("alike", 6).alias("alike"))


@query("k AS (SELECT path, neighbour, greatest(0, sim) AS sim FROM knn WHERE rank <= 3), s AS (SELECT path, sum(sim) AS s, count(*) AS n FROM k GROUP BY path), q AS (SELECT x.path, sum(greatest(0, list_cosine_similarity(v1.e, v2.e))) AS s FROM k x JOIN k y ON x.path = y.path AND x.neighbour < y.neighbour JOIN v v1 ON v1.path = x.neighbour JOIN v v2 ON v2.path = y.neighbour GROUP BY x.path) ;; SELECT s.path AS a, round((s.s + q.s) / 6, 6) AS sim FROM s JOIN q ON s.path = q.path WHERE (s.s + q.s) / 6 > 0.65", "knn", "v")
def concept_cluster(c: Corpus) -> DataFrame:
    return tight_groups(c)


def tight_groups(c: Corpus, least: float = HIGH) -> DataFrame:
    """A note and its three nearest whose six similarities are high on average."""
    k = K.nearest(c.vectors, 3).withColumn("sim", F.greatest("sim", F.lit(0.0)))
    x, y = (k.select(F.col("path").alias("a"), F.col("neighbour").alias(s)) for s in ("x", "y"))
    q = K.similarity(x.join(y, "a").where("x < y"), c.vectors, "x", "y").groupBy("a").agg(F.sum("sim").alias("q"))
    s = k.groupBy(F.col("path").alias("a")).agg(F.sum("sim").alias("s"))
    return s.join(q, "a").withColumn("sim", (F.col("s") + F.col("q")) / 6).where(F.col("sim") > least).select("a", F.round("sim", 6).alias("sim"))


@query("r AS (SELECT path FROM v ORDER BY md5(concat('2024-07-01:', path)), path LIMIT 20) ;; SELECT s.a, s.b, round(s.sim, 6) AS sim FROM sims s WHERE s.a IN (SELECT path FROM r) AND s.b IN (SELECT path FROM r) AND s.sim > 0.15 AND s.sim < 0.5 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = s.a AND e.b = s.b)", "v", "sims", "edges")
def creative_collision(c: Corpus) -> DataFrame:
    few = L.sampled(c.vectors, "path", 20, SESSION).select("path", "embedding")
    p = K.pairs_above(few, NOISE).where("sim > 0.15 AND sim < 0.5")
    return L.unlinked(p, c.edges).select("a", "b", F.round("sim", 6).alias("sim"))


@query("SELECT a, arg_min(b, printf('%.12f|%s', round(sim, 12) + 2, b)) AS b FROM cross_ GROUP BY a", "cross_")
def dialectic_triad(c: Corpus) -> DataFrame:
    far = K.best(c.vectors, c.vectors, 1, farthest=True)
    return far.select(F.col("path").alias("a"), F.col("neighbour").alias("b"))


@query("o AS (SELECT path, target_path AS b FROM outgoing WHERE position < 3 UNION SELECT path, neighbour FROM knn WHERE rank <= 5) ;; SELECT path AS a, b FROM o WHERE path <> b AND path NOT LIKE 'session journal/%' AND b NOT LIKE 'session journal/%'", "outgoing", "knn")
def method_scrambler(c: Corpus) -> DataFrame:
    out = L.outgoing(c.notes, c.links).where("position < 3").select(F.col("path").alias("a"), F.col("target_path").alias("b"))
    both = out.unionByName(near(c, 5).select("a", "b")).distinct()
    return both.where("a <> b AND a NOT LIKE 'session journal/%' AND b NOT LIKE 'session journal/%'")


@query()
def path_length_anomaly(c: Corpus) -> DataFrame:
    """Alike pairs that no walk of three links joins."""
    return R.unwalked(c.vectors, c.edges, 0.35).withColumn("sim", F.round("sim", 6))


@query()
def attention_shift(c: Corpus) -> DataFrame:
    """The note whose neighbours changed most, if by more than .6 and with arrivals and departures."""
    d = K.neighbour_churn(c.vectors.select("path", "embedding"), c.sessions.where("session_id = 5").select("path", "embedding"))
    hit = d.where("churn > 0.6 AND size(departed) > 0 AND size(arrived) > 0").orderBy(F.round("churn", 9).desc(), "path").limit(1)
    return hit.select(F.col("path").alias("a"), F.col("arrived")[0].alias("b"))


@query("u AS (SELECT path, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v), x AS (SELECT k.path, unnest(u.u) AS x, generate_subscripts(u.u, 1) AS i FROM knn k JOIN u ON u.path = k.neighbour), m AS (SELECT path, list(a ORDER BY i) AS c FROM (SELECT path, i, avg(x) AS a FROM x GROUP BY path, i) GROUP BY path), t AS (SELECT m.path, 1 - list_cosine_similarity(v.e, m.c) AS s FROM m JOIN v ON v.path = m.path ORDER BY round(s, 9) DESC, m.path LIMIT 1) ;; SELECT k.path AS a, k.neighbour AS b, round(t.s, 6) AS surprisal FROM t JOIN knn k ON k.path = t.path WHERE k.rank <= 3", "v", "knn")
def surprisal_peak(c: Corpus) -> DataFrame:
    k = K.nearest(c.vectors, 10)
    top = K.surprisal(c.vectors, 10, k).orderBy(F.round("surprisal", 9).desc(), "path").limit(1)
    return k.where("rank <= 3").join(F.broadcast(top), "path").select(F.col("path").alias("a"), F.col("neighbour").alias("b"), F.round("surprisal", 6).alias("surprisal"))


# words


@query()
def antithesis_generator(c: Corpus) -> DataFrame:
    """Notes with strong claims and the nearest of their 20 that denies; ``b`` is null where none does."""
    a = of(c, "a", n=hits(F.col("text"), CLAIMS)).where("a_n >= 3")
    marked = F.when(F.lower("title").rlike("anti|contra"), 2).otherwise(0)
    b = of(c, "b", n=hits(F.col("text"), NEGATIONS) + marked).where("b_n >= 2")
    d = near(c, 20).join(b, "b").groupBy("a").agg(F.min_by("b", "rank").alias("b"))
    return a.join(d, "a", "left").select("a", "b", F.col("a_n").cast("int").alias("claims"))


@query()
def assumption_challenger(c: Corpus) -> DataFrame:
    text = F.col("text")
    sure = of(c, "a", n=hits(text, CERTAIN)).where("a_n >= 2").select("a")
    unsure = of(c, "b", n=hits(text, DOUBTFUL)).where("b_n >= 2").select("b")
    contrast = near(c, 10).join(sure, "a").join(unsure, "b").groupBy("a").agg(F.min_by("b", "rank").alias("b")).withColumn("kind", F.lit("contrast"))
    causal = of(c, "a", n=hits(text, CAUSAL), links=F.size("links")).where("a_n >= 3 AND a_links < 2").select("a", F.lit(None).cast("string").alias("b"), F.lit("causal").alias("kind"))
    return contrast.unionByName(causal)


@query()
def columbo(c: Corpus) -> DataFrame:
    return contradictions(c)


def contradictions(c: Corpus, least: float = HIGH, many: int = 2) -> DataFrame:
    """Alike notes of which one affirms and the other denies."""
    text = F.col("text")
    side = lambda s: of(c, s, pos=hits(text, POSITIVE), neg=hits(text, NEGATIVE), says=hits(text, ASSERTIONS))
    d = near(c, 5).where(F.col("sim") > least).join(side("a").where("a_says > 0"), "a").join(side("b"), "b")
    return pair(d.where((F.col("a_pos") > many) & (F.col("b_neg") > many) | (F.col("a_neg") > many) & (F.col("b_pos") > many)))


@query()
def scale_shifter(c: Corpus) -> DataFrame:
    text = F.col("text")
    side = lambda s: of(c, s, abs=hits(text, ABSTRACT), con=hits(text, CONCRETE))
    d = near(c, 10).join(side("a"), "a").join(side("b"), "b")
    zoom_in = (F.col("a_abs") >= 3) & (F.col("a_con") <= 1) & (F.col("b_con") >= 2)
    zoom_out = (F.col("a_con") >= 3) & (F.col("a_abs") <= 1) & (F.col("b_abs") >= 2)
    return pair(d.where(zoom_in | zoom_out).withColumn("way", F.when(zoom_in, "in").otherwise("out")), "way")


@query()
def pattern_finder(c: Corpus) -> DataFrame:
    """Phrases that stand three times or more in notes that are not linked with another one that has them."""
    return X.shared_phrases(c.own_notes, c.edges)


@query()
def pattern_groups(c: Corpus) -> DataFrame:
    """Notes with up to four nearest that are very much alike, two at least, none of them linked with another of these."""
    g = near(c, 4).where(F.col("sim") > VERY_HIGH).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("m")).where("size(m) >= 2")
    g = g.select("a", F.concat(F.array("a"), "m").alias("m"))
    x, y = (g.select("a", F.explode("m").alias(k)) for k in ("x", "y"))
    tied = x.join(y, "a").where("x < y").join(c.edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").select("a").distinct()
    return g.join(tied, "a", "left_anti").select("a", F.array_join("m", "|").alias("members"))


def voiced(c: Corpus) -> DataFrame:
    """(path, measures of voice), written once for a corpus: filters must not compute the measures again."""
    if "voiced" not in c.__dict__:
        c.__dict__["voiced"] = stash(V.voice(c.own_notes.select("path", "content")).select("path", "voice.*"), "voice")
    return c.__dict__["voiced"]


@query()
def self_and_other(c: Corpus) -> DataFrame:
    d = voiced(c)
    side = F.when(F.col("self_focus_ratio") > 0.85, "self").when(F.col("first_person_plural_freq") > 2.0, "other")
    return one(d.withColumn("side", side).where("side IS NOT NULL"), "side")


@query()
def sentence_variance(c: Corpus) -> DataFrame:
    d = voiced(c).where("mean_sentence_length > 5")
    s = F.broadcast(d.agg(F.avg("sentence_length_variance").alias("m"), F.stddev_pop("sentence_length_variance").alias("s"), F.count("*").alias("n")))
    return one(d.join(s).where("n >= 10 AND sentence_length_variance > m + 2 * s").orderBy(F.round("sentence_length_variance", 9).desc(), "path").limit(1), F.round("sentence_length_variance", 6).alias("sentence_length_variance"))


@query()
def temporal_voice(c: Corpus) -> DataFrame:
    d = voiced(c)
    past, future = (L.sampled(d.where(F.col("orientation") == k), "path", n, SESSION).select("path") for k, n in (("past", 5), ("future", 20)))
    v = c.vectors.select("path", "embedding")
    k = K.best(v.join(past, "path", "left_semi"), v.join(future, "path", "left_semi"), 1)
    return k.select(F.col("path").alias("a"), F.col("neighbour").alias("b"), F.round("sim", 6).alias("sim"))


@query()
def uncertainty_mapper(c: Corpus) -> DataFrame:
    return one(voiced(c).where("hedging_ratio > 0.3").orderBy(F.round("hedging_ratio", 9).desc(), "path").limit(1), F.round("hedging_ratio", 6).alias("hedging_ratio"))


@query()
def voice_absence(c: Corpus) -> DataFrame:
    """Kinds of voice that few notes speak in."""
    d = voiced(c).agg(F.count("*").alias("n"), F.avg((F.col("orientation") == "future").cast("int")).alias("future"), F.avg((F.col("orientation") == "past").cast("int")).alias("past"), F.avg((F.col("first_person_plural_freq") > 1.0).cast("int")).alias("we"), F.avg((F.col("question_density") > 0.5).cast("int")).alias("questions")).where("n >= 20")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("share"), F.lit(x).alias("least")) for k, x in (("future", 0.05), ("past", 0.05), ("we", 0.05), ("questions", 0.1))])
    return d.select(F.inline(kinds)).where("share < least").select("kind", F.round("share", 6).alias("share"))


def harvested(found: DataFrame) -> DataFrame:
    """What each note has; a session shows one note's."""
    return found.select(F.col("path").alias("a"), "item")


@query()
def question_harvester(c: Corpus) -> DataFrame:
    return harvested(X.questions(c.notes))


@query()
def quote_harvester(c: Corpus) -> DataFrame:
    return harvested(X.quotes(c.notes))


@query()
def todo_harvester(c: Corpus) -> DataFrame:
    return harvested(X.todos(c.notes))


@query()
def claim_harvester(c: Corpus) -> DataFrame:
    return harvested(X.claims(c.notes))


@query()
def definition_harvester(c: Corpus) -> DataFrame:
    return harvested(X.definitions(c.notes))


@query()
def hypothesis_harvester(c: Corpus) -> DataFrame:
    return harvested(X.hypotheses(c.notes))


# sessions


@query("e1 AS (SELECT path, n, 1 - list_cosine_similarity(f, l) AS drift, list_transform(list_zip(l, f), lambda z: z[1] - z[2]) AS d FROM ends), s AS (SELECT k.path AS a, k.neighbour AS b, list_cosine_similarity(v.e, e1.d) AS al, e1.drift FROM e1 JOIN knn k ON k.path = e1.path JOIN v ON v.path = k.neighbour WHERE e1.drift >= 0.2 AND e1.n >= 3 AND k.rank <= 5) ;; SELECT a, arg_max(b, printf('%.9f|%s', al + 2, b)) AS b, round(max(drift), 6) AS drift FROM s GROUP BY a", "ends", "knn", "v")
def concept_drift(c: Corpus) -> DataFrame:
    """Notes that drift, and which of their five nearest they drift towards."""
    d = T.ends(c.sessions, 3).select(F.col("path").alias("a"), (1 - K.cosine(F.col("first"), F.col("last"))).alias("drift"), T.direction(F.col("first"), F.col("last")).alias("way")).where("drift >= 0.2")
    k = near(c, 5).join(d, "a").join(c.vectors.select(F.col("path").alias("b"), "embedding"), "b")
    k = k.withColumn("al", F.struct(F.round(K.cosine(F.col("embedding"), F.col("way")), 9), F.col("b")))
    return k.groupBy("a").agg(F.max_by("b", "al").alias("b"), F.round(F.max("drift"), 6).alias("drift"))


def _near_pairs(c: Corpus, k: int) -> DataFrame:
    return near(c, k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query()
def convergent_evolution(c: Corpus) -> DataFrame:
    p = L.unlinked(_near_pairs(c, 10), c.edges)
    return pair(T.pair_trends(p, c.sessions).where(F.col("trend") > NOISE), F.round("trend", 6).alias("trend"))


@query()
def divergent_evolution(c: Corpus) -> DataFrame:
    p = L.outgoing(c.notes, c.links).where("position < 5").select(F.col("path").alias("a"), F.col("target_path").alias("b")).distinct()
    return pair(T.pair_trends(p, c.sessions).where(F.col("trend") < -NOISE), F.round("trend", 6).alias("trend"))


@query()
def cyclical_thinking(c: Corpus) -> DataFrame:
    return one(T.cycles(c.sessions), "cycles")


@query()
def drift_velocity_anomaly(c: Corpus) -> DataFrame:
    d = T.accelerating(c.sessions).join(near(c, 5).where(F.col("sim") > MODERATE).groupBy(F.col("a").alias("path")).agg(F.min_by("b", "rank").alias("b")), "path")
    return d.select(F.col("path").alias("a"), "b", F.round("gain", 6).alias("gain"))


@query()
def hermeneutic_instability(c: Corpus) -> DataFrame:
    still = c.notes.where(ago("modified") > 60).select("path")
    return one(T.instability(c.sessions).where("instability > 0.2").join(still, "path"), F.round("instability", 6).alias("instability"))


@query("x AS (SELECT path, e, lag(e) OVER (PARTITION BY path ORDER BY date) AS p, session_id FROM sv) ;; SELECT x.path AS a, round(1 - list_cosine_similarity(e, p), 6) AS drift, DATE '2024-07-01' - n.modified > 30 AS untouched FROM x JOIN notes n ON n.path = x.path WHERE session_id = 6 AND 1 - list_cosine_similarity(e, p) > 0.15", "sv", "notes")
def session_drift_notes(c: Corpus) -> DataFrame:
    d = T.session_drift(c.sessions).where("drift > 0.15").join(c.notes, "path")
    return d.select(F.col("path").alias("a"), F.round("drift", 6).alias("drift"), (ago("modified") > 30).alias("untouched"))


@query()
def vocabulary_expansion(c: Corpus) -> DataFrame:
    """How the last two sessions' spread compares with that of the first two."""
    s = T.coverage(c.sessions).where("n >= 10")
    w = Window.orderBy("date")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))
    d = r.agg(F.count("*").alias("n"), (F.avg(F.when(F.col("back") <= 2, F.col("coverage"))) / F.avg(F.when(F.col("k") <= 2, F.col("coverage")))).alias("ratio"))
    return d.where("n >= 3 AND (ratio < 0.8 OR ratio > 1.2)").select("n", F.round("ratio", 6).alias("ratio"))


@query()
def cluster_mirror(c: Corpus) -> DataFrame:
    labels = C.density_clusters(c.vectors)
    return C.representatives(c.vectors.select("path", "embedding"), labels).select(F.col("path").alias("a"), "cluster", "rank")


@query()
def cluster_evolution_tracker(c: Corpus) -> DataFrame:
    """Notes whose cluster of the last session does not hold most of those that shared their cluster before."""
    v = c.sessions
    now, past = (C.density_clusters(v.where(F.col("session_id") == k).select("path", "embedding")).where("cluster >= 0") for k in (6, 4))
    j = now.select("path", F.col("cluster").alias("now")).join(past.select("path", F.col("cluster").alias("past")), "path")
    moves = j.groupBy("past", "now").agg(F.count("*").alias("n"))
    main = moves.groupBy("past").agg(F.max_by("now", F.struct("n", "now")).alias("main"))
    return one(j.join(main, "past").where("now <> main"), "past", "now")
