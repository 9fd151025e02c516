"""Queries over vectors and their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import clusters as C
from driftwell.operators import filters as S
from driftwell.operators import graph as G
from driftwell.operators import knn as K
from driftwell.operators import links as L
from driftwell.operators import sessions as T
from driftwell.plans.registry import Corpus, query

# ruff: noqa: D103
R6 = lambda *names: {n: F.round(n, 6) for n in names}
ANCHORS = "'doc/1.md', 'doc/2.md', 'doc/3.md'"
ANCHORED = f"m AS (SELECT a AS path, min(sim) AS lo, max(sim) AS hi FROM cross_ WHERE b IN ({ANCHORS}) AND a NOT IN ({ANCHORS}) GROUP BY a) ;; "


@query("SELECT path, neighbour, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM knn", "knn")
def knn_top10(c: Corpus) -> DataFrame:
    return K.nearest(c.vectors).withColumns(R6("sim"))


@query(f"SELECT a, b, round(greatest(0, least(1, sim)), 6) AS sim FROM cross_ WHERE a IN ({ANCHORS}) AND b NOT IN ({ANCHORS})", "cross_")
def batch_similarity(c: Corpus) -> DataFrame:
    few = c.vectors.where(f"path IN ({ANCHORS})")
    pairs = K.best(few, c.vectors.where(f"path NOT IN ({ANCHORS})"), 1 << 30).select(F.col("path").alias("a"), F.col("neighbour").alias("b"), "sim")
    return pairs.withColumn("sim", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sim")), 6))


@query("SELECT a AS path, count(*) FILTER (sim >= 0.65) AS above, count(*) FILTER (sim BETWEEN 0.35 AND 0.65) AS in_range, count(*) FILTER (sim >= 0.65) >= 10 AS hub FROM cross_ GROUP BY a", "cross_")
def similarity_profile(c: Corpus) -> DataFrame:
    return K.profile(c.vectors)


def _anchored(c: Corpus) -> DataFrame:
    return K.anchored(c.vectors, c.vectors.where(f"path IN ({ANCHORS})"))


@query(ANCHORED + "SELECT path FROM m WHERE hi >= 0.3", "cross_")
def filter_similar_any(c: Corpus) -> DataFrame:
    return _anchored(c).where("most >= 0.3").select("path")


@query(ANCHORED + "SELECT path FROM m WHERE lo >= 0.0", "cross_")
def filter_similar_all(c: Corpus) -> DataFrame:
    return _anchored(c).where("least >= 0.0").select("path")


@query(ANCHORED + "SELECT path FROM m WHERE hi < 0.1", "cross_")
def filter_dissimilar(c: Corpus) -> DataFrame:
    return _anchored(c).where("most < 0.1").select("path")


@query("SELECT a, b, round(sim, 6) AS sim FROM sims s WHERE sim > 0.5 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = s.a AND e.b = s.b) ORDER BY round(s.sim, 12) DESC, a, b LIMIT 20", "sims", "edges")
def unlinked_pairs(c: Corpus) -> DataFrame:
    return K.best_unlinked(c.vectors, c.edges, 0.5, 20).withColumns(R6("sim"))


@query("SELECT path, neighbour, round(sim, 6) AS sim FROM (SELECT a AS path, b AS neighbour, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12), b) AS k FROM cross_) WHERE k <= 3", "cross_")
def contrarian(c: Corpus) -> DataFrame:
    return K.best(c.vectors, c.vectors, 3, farthest=True).select("path", "neighbour", F.round("sim", 6).alias("sim"))


@query("u AS (SELECT path, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM v), x AS (SELECT k.path, unnest(u.u) AS x, generate_subscripts(u.u, 1) AS i FROM knn k JOIN u ON u.path = k.neighbour), m AS (SELECT path, list(a ORDER BY i) AS c FROM (SELECT path, i, avg(x) AS a FROM x GROUP BY path, i) GROUP BY path) ;; SELECT m.path, round(1 - list_cosine_similarity(v.e, m.c), 6) AS surprisal FROM m JOIN v ON v.path = m.path", "v", "knn")
def surprisal(c: Corpus) -> DataFrame:
    return K.surprisal(c.vectors).withColumns(R6("surprisal"))


@query("p AS (SELECT x.path AS a, y.path AS b, list_cosine_similarity(x.e, y.e) AS sim FROM sv x JOIN sv y ON x.session_id = 4 AND y.session_id = 4 AND x.path <> y.path), b0 AS (SELECT a AS path, list(b ORDER BY b) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS k FROM p) WHERE k <= 10 GROUP BY a), b1 AS (SELECT path, list(neighbour ORDER BY neighbour) AS s FROM knn GROUP BY path) ;; SELECT path, round(1 - len(list_intersect(b0.s, b1.s)) / len(list_distinct(list_concat(b0.s, b1.s))), 6) AS churn, array_to_string(list_filter(b0.s, lambda x: NOT list_contains(b1.s, x)), '|') AS departed, array_to_string(list_filter(b1.s, lambda x: NOT list_contains(b0.s, x)), '|') AS arrived FROM b0 JOIN b1 USING (path)", "sv", "knn")
def neighbour_churn(c: Corpus) -> DataFrame:
    d = K.neighbour_churn(c.vectors.select("path", "embedding"), c.sessions.where("session_id = 4").select("path", "embedding"))
    return d.select("path", F.round("churn", 6).alias("churn"), F.array_join("departed", "|").alias("departed"), F.array_join("arrived", "|").alias("arrived"))


@query("SELECT path, n, round(1 - list_cosine_similarity(f, l), 6) AS drift FROM ends", "ends")
def total_drift(c: Corpus) -> DataFrame:
    return T.total_drift(c.sessions).withColumns(R6("drift"))


@query("SELECT path, strftime(date, '%Y-%m-%d') AS date, round(1 - list_cosine_similarity(e, l), 6) AS rate FROM (SELECT *, lead(e, 2) OVER (PARTITION BY path ORDER BY date) AS l FROM sv) WHERE l IS NOT NULL", "sv")
def windowed_drift(c: Corpus) -> DataFrame:
    return T.windowed_rates(c.sessions).select("path", F.col("date").cast("string").alias("date"), F.round("rate", 6).alias("rate"))


@query("w AS (SELECT path, date, 1 - list_cosine_similarity(e, l) AS rate FROM (SELECT *, lead(e, 2) OVER (PARTITION BY path ORDER BY date) AS l FROM sv) WHERE l IS NOT NULL) ;; SELECT path, round(g, 6) AS gain FROM (SELECT path, arg_max(rate, date) - arg_min(rate, date) AS g FROM w GROUP BY path) WHERE g > 0.1", "sv")
def accelerating(c: Corpus) -> DataFrame:
    return T.accelerating(c.sessions).withColumns(R6("gain"))


@query("x AS (SELECT path, list_cosine_similarity(e, last(e) OVER (PARTITION BY path ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS s, row_number() OVER (PARTITION BY path ORDER BY date) AS k, count(*) OVER (PARTITION BY path) AS n FROM sv) ;; SELECT path, round(avg(s) FILTER (k <= n // 2), 6) AS early, round(avg(s) FILTER (k > n // 2), 6) AS late FROM x GROUP BY path", "sv")
def early_late(c: Corpus) -> DataFrame:
    return T.early_late(c.sessions).withColumns(R6("early", "late"))


@query("p AS (SELECT DISTINCT least(path, neighbour) AS a, greatest(path, neighbour) AS b FROM knn WHERE rank <= 3), t AS (SELECT a, b, x.date, list_cosine_similarity(x.e, y.e) AS s, row_number() OVER (PARTITION BY a, b ORDER BY x.date) AS k, count(*) OVER (PARTITION BY a, b) AS n FROM p JOIN sv x ON x.path = a JOIN sv y ON y.path = b AND y.date = x.date) ;; SELECT a, b, count(*) AS shared, round(avg(s) FILTER (k > n // 2) - avg(s) FILTER (k <= n // 2), 6) AS trend FROM t GROUP BY a, b", "knn", "sv")
def convergence(c: Corpus) -> DataFrame:
    near = K.nearest(c.vectors, 3)
    pairs = near.select(F.least("path", "neighbour").alias("a"), F.greatest("path", "neighbour").alias("b")).distinct()
    return T.pair_trends(pairs, c.sessions).withColumns(R6("trend"))


@query("x AS (SELECT path, date, list_cosine_similarity(e, first(e) OVER (PARTITION BY path ORDER BY date)) > 0.7 AS s FROM sv), y AS (SELECT path, s AND NOT lag(s) OVER (PARTITION BY path ORDER BY date) AS b FROM x) ;; SELECT path, count(*) AS n, count(*) FILTER (b) AS cycles FROM y GROUP BY path HAVING count(*) FILTER (b) >= 2 AND count(*) >= 5", "sv")
def cycling(c: Corpus) -> DataFrame:
    return T.cycles(c.sessions)


@query("x AS (SELECT path, e, lag(e) OVER (PARTITION BY path ORDER BY date) AS p, session_id FROM sv) ;; SELECT path, round(1 - list_cosine_similarity(e, p), 6) AS drift FROM x WHERE session_id = 6 AND 1 - list_cosine_similarity(e, p) > 0.15", "sv")
def session_drift(c: Corpus) -> DataFrame:
    return T.session_drift(c.sessions).where("drift > 0.15").withColumns(R6("drift"))


@query("u AS (SELECT date, vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM sv), m AS (SELECT date, i, avg(x) AS m FROM u GROUP BY date, i), d AS (SELECT date, vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM u JOIN m USING (date, i) GROUP BY date, vec_id) ;; SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS n, round(stddev_pop(d), 6) AS coverage FROM d GROUP BY date", "sv")
def coverage(c: Corpus) -> DataFrame:
    return T.coverage(c.sessions).select(F.col("date").cast("string").alias("date"), "n", F.round("coverage", 6).alias("coverage"))


@query("r AS (SELECT * FROM sv WHERE session_id >= 2), u AS (SELECT path, session_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM r), m AS (SELECT path, i, avg(x) AS m FROM u GROUP BY path, i), d AS (SELECT path, session_id, sqrt(sum((x - m) * (x - m))) AS d FROM u JOIN m USING (path, i) GROUP BY path, session_id) ;; SELECT path, count(*) AS n, round(avg(d), 6) AS instability FROM d GROUP BY path", "sv")
def instability(c: Corpus) -> DataFrame:
    return T.instability(c.sessions).withColumns(R6("instability"))


@query("SELECT CAST(session_id AS INT) AS session_id FROM days WHERE date = DATE '2024-07-01' OR date IN (SELECT date FROM days WHERE date <> DATE '2024-07-01' ORDER BY date DESC LIMIT 2)", "days")
def retention_prune(c: Corpus) -> DataFrame:
    return T.retained(c.sessions.select("session_id", "date").distinct(), 2, "2024-07-01").select(F.col("session_id").cast("int").alias("session_id"))


@query("SELECT strftime(max(date), '%Y-%m-%d') AS date FROM days WHERE date <= DATE '2024-01-03'", "days")
def as_of_session(c: Corpus) -> DataFrame:
    return T.as_of(c.sessions.select("date").distinct(), "2024-01-03").select(F.col("date").cast("string").alias("date"))


@query("SELECT s.a, x.a AS bridge, s.b, round(s.sim, 6) AS sim FROM sims s JOIN twoway x ON x.b = s.a JOIN twoway y ON y.b = s.b AND y.a = x.a WHERE s.sim >= 0.1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = s.a AND e.b = s.b)", "sims", "twoway")
def find_bridges(c: Corpus) -> DataFrame:
    return G.bridges(c.edges, c.vectors, 0.1).withColumns(R6("sim"))


@query("p AS (SELECT label AS component, path FROM v) ;; SELECT s.a, s.b, round(s.sim, 6) AS sim FROM sims s JOIN p x ON x.path = s.a JOIN p y ON y.path = s.b WHERE x.component <> y.component AND s.sim >= 0.35", "sims", "v")
def structural_holes(c: Corpus) -> DataFrame:
    parts = c.vectors.select("path", F.col("label").cast("string").alias("component"))
    return G.structural_holes(parts, c.vectors, 0.35).withColumns(R6("sim"))


@query("u AS (SELECT label AS cluster, path, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT cluster, list(a ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS a FROM u GROUP BY cluster, i) GROUP BY cluster), s AS (SELECT m.cluster, v.path, list_cosine_similarity(v.e, m.c) AS sim FROM v JOIN m ON v.label = m.cluster) ;; SELECT cluster, path, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(sim, 9) DESC, path) AS rank FROM s) WHERE rank <= 3", "v")
def cluster_representatives(c: Corpus) -> DataFrame:
    labels = c.vectors.select("path", F.col("label").alias("cluster"))
    return C.representatives(c.vectors.drop("label"), labels).withColumns(R6("sim"))


@query("x AS (SELECT label, count(*) AS n FROM v GROUP BY label) ;; SELECT round(-sum(n / t * log2(n / t + 1e-10)), 2) AS entropy, count(*) AS clusters FROM x, (SELECT sum(n) AS t FROM x)", "v")
def shannon_entropy(c: Corpus) -> DataFrame:
    return C.entropy(C.sizes(c.vectors.select("path", F.col("label").alias("cluster"))))


@query()
def density_clusters(c: Corpus) -> DataFrame:
    return C.density_clusters(c.vectors)


@query()
def silhouette(c: Corpus) -> DataFrame:
    return C.silhouette(c.vectors.drop("label"), c.vectors.select("path", F.col("label").alias("cluster")))


@query()
def cluster_terms(c: Corpus) -> DataFrame:
    return C.label_words(c.notes, c.vectors.select("path", F.col("label").alias("cluster"))).withColumns(R6("score"))


@query()
def procrustes_drift(c: Corpus) -> DataFrame:
    return T.procrustes_drift(c.vectors, c.sessions.where("session_id = 3")).withColumns(R6("drift"))


@query()
def diversity_filter(c: Corpus) -> DataFrame:
    s = c.vectors.select(F.col("vec_id").alias("ord"), "embedding")
    return S.diversity(s, S.Limits(diversity=0.5)).select("ord")


@query("SELECT path, round(greatest(0, 1 - sim), 6) AS distance FROM (SELECT v.path, list_cosine_similarity(v.e, list_transform(v.e, lambda x, i0: x * (1 + (i0 - 1) % 3))) AS sim FROM v)", "v")
def cosine_function(c: Corpus) -> DataFrame:
    moved = F.transform("embedding", lambda x, i: x * (1 + i % 3))
    return c.vectors.select("path", F.round(F.greatest(F.lit(0.0), 1 - K.cosine(F.col("embedding"), moved)), 6).alias("distance"))
