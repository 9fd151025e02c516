"""A corpus's figures in one place, and what they suggest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftwell.operators import clusters as C
from driftwell.operators import graph as G
from driftwell.operators import links as L
from driftwell.plans.registry import Corpus
from driftwell.sources.sinks import recommendations

#: Vectors that the corpus's shape is measured on, at most; by md5 of their paths.
SHAPE = 1_000


def statistics(c: Corpus, session: str = "2024-07-01") -> dict[str, object]:
    """Notes, tags, links, graph, sessions and the shape of the newest vectors."""
    day = F.lit(session).cast("date")
    out: dict[str, object] = c.notes.agg(F.count("*").alias("notes"), F.count_if("is_virtual").alias("virtual"), F.avg(F.datediff(day, F.col("created").cast("date"))).alias("mean_age")).first().asDict()
    n = max(int(out["notes"]), 1)
    out |= c.tags.agg(F.countDistinct("tag").alias("tags"), F.count("*").alias("tag_uses")).first().asDict()
    out |= L.density(c.notes, c.links).drop("n").first().asDict() | L.bidirectional(c.links).first().asDict()
    out["orphans"] = L.raw_orphans(c.notes, c.links).count()
    out["orphan_pct"] = 100 * out["orphans"] / n
    out["hubs"] = L.outgoing_hubs(c.notes, c.links).count()
    out["largest_component"] = G.component_sizes(c.notes, c.edges).agg(F.max("size")).first()[0]
    out |= c.sessions.agg(F.countDistinct("date").alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last")).first().asDict()
    some = L.sampled(c.vectors, "path", SHAPE, session).select("embedding").collect()
    out |= C.shape(np.array([r["embedding"] for r in some], np.float64)) if some else {}
    labels = C.density_clusters(c.vectors)
    out |= C.entropy(C.sizes(labels)).first().asDict()
    noise = labels.agg(F.count_if(F.col("cluster") < 0).alias("gaps"), F.count("*").alias("vectors")).first()
    out["gaps"], out["gap_pct"] = noise["gaps"], 100 * noise["gaps"] / max(noise["vectors"], 1)
    days = c.sessions.select("date").distinct().agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span")).first()
    out["mean_gap_days"] = days["span"] / (days["n"] - 1) if days["n"] > 1 else None
    out |= c.history.agg(F.count("*").alias("suggestions"), (F.count("*") / F.countDistinct("session_date")).alias("suggestions_per_session")).first().asDict()
    out["recommendations"] = recommendations({k: v for k, v in out.items() if isinstance(v, (int, float))})
    return out
