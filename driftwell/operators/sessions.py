"""Vectors over sessions: snapshots, drift, windows, convergence, cycles, coverage, retention.

Rows are (date, path, embedding), one a note and session; everything is a window or an aggregation by note.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftwell.functions.voice import season
from driftwell.operators.knn import cosine, norm


def by_note() -> WindowSpec:
    return Window.partitionBy("path").orderBy("date")


def whole_note() -> WindowSpec:
    return by_note().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def as_of(sessions: DataFrame, date: str, spare_days: int | None = None) -> DataFrame:
    """The latest session (date) not after ``date``; if there is none, the oldest that is ``spare_days`` before the newest."""
    d = F.lit(date).cast("date")
    pick = F.max(F.when(F.col("date") <= d, F.col("date")))
    if spare_days is not None:
        old = F.min("date")
        pick = F.coalesce(pick, F.when(F.datediff(F.max("date"), old) >= spare_days, old))
    return sessions.agg(pick.alias("date"))


def ends(v: DataFrame, least: int = 2) -> DataFrame:
    """(path, n, first, last): a note's first and last vector."""
    return v.groupBy("path").agg(F.count("*").alias("n"), F.min_by("embedding", "date").alias("first"), F.max_by("embedding", "date").alias("last")).where(F.col("n") >= least)


def total_drift(v: DataFrame, least: int = 2) -> DataFrame:
    """(path, n, drift): 1 - cosine of first and last."""
    return ends(v, least).select("path", "n", (1 - cosine(F.col("first"), F.col("last"))).alias("drift"))


def direction(a: Column, b: Column) -> Column:
    """The unit vector from a to b; zero if they hardly differ."""
    d = F.zip_with(b, a, lambda x, y: x - y)
    n = norm(d)
    return F.when(n < 1e-10, F.transform(d, lambda x: F.lit(0.0))).otherwise(F.transform(d, lambda x: x / n))


def drift_directions(v: DataFrame) -> DataFrame:
    return ends(v).select("path", direction(F.col("first"), F.col("last")).alias("direction"))


def aligned(v: DataFrame, towards: Column, least: float = 0.5) -> DataFrame:
    """Notes whose drift points towards a vector: dot of unit vectors at least so much."""
    return drift_directions(v).withColumn("alignment", cosine(F.col("direction"), towards)).where(F.col("alignment") >= least).select("path", "alignment")


def windowed_rates(v: DataFrame, width: int = 3) -> DataFrame:
    """(path, date, rate): drift over each window of ``width`` sessions, dated by its start."""
    later = F.lead("embedding", width - 1).over(by_note())
    return v.withColumn("__l", later).where("__l IS NOT NULL").select("path", "date", (1 - cosine(F.col("embedding"), F.col("__l"))).alias("rate"))


def accelerating(v: DataFrame, width: int = 3, least: float = 0.1) -> DataFrame:
    """(path, gain): the last window's rate over the first's, above ``least``."""
    r = windowed_rates(v, width).groupBy("path").agg((F.max_by("rate", "date") - F.min_by("rate", "date")).alias("gain"))
    return r.where(F.col("gain") > least)


def halves(n: Column, position: Column) -> Column:
    return F.when(position <= F.floor(n / 2), "early").otherwise("late")


def early_late(v: DataFrame) -> DataFrame:
    """(path, early, late): mean similarity to the last vector in each half; 0 with fewer than four sessions."""
    d = v.withColumn("__c", F.last("embedding").over(whole_note())).withColumn("__n", F.count("*").over(whole_note())).withColumn("__k", F.row_number().over(by_note()))
    sim = cosine(F.col("embedding"), F.col("__c"))
    half = halves(F.col("__n"), F.col("__k"))
    out = d.groupBy("path").agg(F.max("__n").alias("n"), F.avg(F.when(half == "early", sim)).alias("e"), F.avg(F.when(half == "late", sim)).alias("l"))
    return out.select("path", F.when(F.col("n") < 4, 0.0).otherwise(F.col("e")).alias("early"), F.when(F.col("n") < 4, 0.0).otherwise(F.col("l")).alias("late"))


def pair_trajectories(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """(a, b, date, sim) on dates that both notes have."""
    va, vb = (v.select(F.col("path").alias(k), "date", F.col("embedding").alias(f"e{k}")) for k in ("a", "b"))
    return pairs.select("a", "b").join(va, "a").join(vb, ["b", "date"]).select("a", "b", "date", cosine(F.col("ea"), F.col("eb")).alias("sim"))


def pair_trends(pairs: DataFrame, v: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared, trend): mean similarity in the later half less that in the earlier; positive if they converge."""
    w = Window.partitionBy("a", "b")
    t = pair_trajectories(pairs, v).withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy("date")))
    half = halves(F.col("__n"), F.col("__k"))
    trend = F.avg(F.when(half == "late", F.col("sim"))) - F.avg(F.when(half == "early", F.col("sim")))
    return t.groupBy("a", "b").agg(F.count("*").alias("shared"), trend.alias("trend")).where(F.col("shared") >= least)


def cycles(v: DataFrame, least: int = 2, near: float = 0.7) -> DataFrame:
    """(path, n, cycles): returns to the first state; a state is near if its cosine to the first exceeds ``near``."""
    d = v.withColumn("__f", F.first("embedding").over(whole_note())).withColumn("__s", cosine(F.col("embedding"), F.col("__f")) > near)
    back = F.col("__s") & ~F.lag("__s").over(by_note())
    out = d.withColumn("__b", back).groupBy("path").agg(F.count("*").alias("n"), F.count_if("__b").alias("cycles"))
    return out.where((F.col("cycles") >= least) & (F.col("n") >= 2 * least + 1))


def session_drift(v: DataFrame) -> DataFrame:
    """(path, drift) between a note's last two sessions."""
    d = v.withColumn("__p", F.lag("embedding").over(by_note())).groupBy("path").agg(F.max_by("embedding", "date").alias("e"), F.max_by("__p", "date").alias("p"))
    return d.where("p IS NOT NULL").select("path", (1 - cosine(F.col("e"), F.col("p"))).alias("drift"))


def recent_rank(v: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("path").orderBy(F.desc("date")))


def _elementwise_mean(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean): the mean vector of each group, by partial sums of its elements."""
    m = rows.select(*keys, F.posexplode("embedding").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("mean"))


def euclid(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def instability(v: DataFrame, last: int = 5, least: int = 3) -> DataFrame:
    """(path, n, instability): mean distance of the last vectors to their mean."""
    r = v.withColumn("__k", recent_rank(v)).where(F.col("__k") <= last)
    out = r.join(_elementwise_mean(r, "path"), "path").groupBy("path").agg(F.count("*").alias("n"), F.avg(euclid(F.col("embedding"), F.col("mean"))).alias("instability"))
    return out.where(F.col("n") >= least)


def coverage(v: DataFrame) -> DataFrame:
    """(date, n, coverage): spread of a session's distances to its centroid."""
    d = v.join(_elementwise_mean(v, "date"), "date").select("date", euclid(F.col("embedding"), F.col("mean")).alias("d"))
    return d.groupBy("date").agg(F.count("*").alias("n"), F.stddev_pop("d").alias("coverage"))


def retained(sessions: DataFrame, keep: int | None, current: str | None = None) -> DataFrame:
    """Sessions that stay: the current one and the newest ``keep`` others; all if ``keep`` is none or not positive."""
    if keep is None or keep <= 0:
        return sessions
    newest = sessions.where(F.col("date") != F.lit(current).cast("date")) if current else sessions
    top = newest.orderBy(F.desc("date")).limit(keep)
    return top if current is None else top.unionByName(sessions.where(F.col("date") == F.lit(current).cast("date")))


def seasonal_directions(v: DataFrame, least: int = 4) -> DataFrame:
    """(path, season, direction) of notes with enough sessions."""
    n = v.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("path")
    d = v.join(n, "path", "left_semi").withColumn("season", season(F.col("date")))
    g = d.groupBy("path", "season").agg(F.count("*").alias("n"), F.min_by("embedding", "date").alias("f"), F.max_by("embedding", "date").alias("l"))
    return g.where("n >= 2").select("path", "season", direction(F.col("f"), F.col("l")).alias("direction"))


def procrustes_drift(now: DataFrame, past: DataFrame, least: int = 5) -> DataFrame:
    """(path, drift): 1 - cosine after the past is rotated onto the present.

    The d x d cross-covariance is summed by Spark, so only a matrix of the vectors' width reaches the driver.
    """
    spark = now.sparkSession
    j = now.select("path", F.col("embedding").alias("x")).join(past.select("path", F.col("embedding").alias("y")), "path")
    cells = j.select(F.posexplode("x").alias("i", "a"), "y").select("i", "a", F.posexplode("y").alias("k", "b")).groupBy("i", "k").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    if not cells or j.count() < least:
        return spark.createDataFrame([], "path string, drift double")
    d = 1 + max(r["i"] for r in cells)
    m = np.zeros((d, d))
    for r in cells:
        m[r["k"], r["i"]] = r["s"]
    u, _, vt = np.linalg.svd(m)
    turn = F.array(*[F.array(*map(F.lit, row)) for row in (u @ vt).T.tolist()])
    turned = F.transform(turn, lambda row: F.aggregate(F.zip_with(row, F.col("y"), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x))
    return j.select("path", (1 - cosine(F.col("x"), turned)).alias("drift"))


def temporal_features(created: Column, session: Column) -> Column:
    """Age in years, and the sine of the day of year of creation and session."""
    turn = lambda d: F.sin(2 * np.pi * F.dayofyear(d) / 365)
    return F.array(F.datediff(session, created) / 365, turn(created), turn(session))


def temporal_embedding(semantic: Column, created: Column, session: Column, weight: float = 0.9) -> Column:
    return F.concat(F.transform(semantic, lambda x: x * weight), F.transform(temporal_features(created, session), lambda x: x * (1 - weight)))


def decile_periods(notes: DataFrame, periods: int = 10) -> DataFrame:
    """(path, period): notes by creation in parts of equal size, the last with the remainder.

    Places come from counts by day and places within a day, so no task orders all notes.
    """
    day = F.col("created").cast("date")
    days = notes.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"), F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    own = F.row_number().over(Window.partitionBy("day").orderBy("created", "path"))
    place = notes.withColumn("day", day).withColumn("__k", own).join(before, "day").withColumn("__k", F.col("__k") + F.col("before") - 1)
    size = F.greatest(F.lit(1), F.floor(F.col("all") / periods))
    return place.select("path", F.least(F.floor(F.col("__k") / size), F.lit(periods - 1)).cast("int").alias("period"))


def quarter_bins(notes: DataFrame, session: str, bins: int = 8) -> DataFrame:
    """(path, bin): 90-day bins back from the session, 0 the newest."""
    age = F.datediff(F.lit(session).cast("date"), F.col("created").cast("date"))
    return notes.where((age >= 0) & (age < 90 * bins)).select("path", F.floor(age / 90).cast("int").alias("bin"))
