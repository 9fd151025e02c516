"""What sessions write: vectors by date, history, journal notes, metrics, cluster labels."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from datetime import date
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.markdown import MONTHS


def state_hash(notes: DataFrame) -> DataFrame:
    """One row: SHA-256 over a digest of every path and time, in order of the digests' prefix and then of the parts."""
    d = F.sha2(F.concat("path", F.col("modified").cast("string")), 256)
    parts = notes.select(d.alias("d")).groupBy(F.substring("d", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("state_hash"))


def write_session(vectors: DataFrame, root: str, session: str) -> None:
    """Replace one session's vectors; others stay."""
    vectors.withColumn("date", F.lit(session).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def append_history(suggestions: DataFrame, root: str, session: str) -> None:
    """Add a session's suggestions with block ids counted from 1 in their order."""
    block = F.concat(F.lit("g" + session.replace("-", "") + "-"), F.lpad(F.col("ord").cast("string"), 3, "0"))
    suggestions.select(F.lit(session).cast("date").alias("session_date"), "query_id", "text", block.alias("block_id"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(root)


def labelled(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors with their cluster's label; null for noise."""
    return vectors.join(labels.where("cluster >= 0").select("path", F.col("cluster").cast("string").alias("cluster_label")), "path", "left")


def journal_text(suggestions: list[tuple[str, str]], session: date) -> str:
    head = f"# Session – {MONTHS[session.month - 1]} {session.day}, {session.year}\n"
    blocks = [f"## {query} ^g{session:%Y%m%d}-{k:03d}\n{text}\n" for k, (query, text) in enumerate(suggestions, 1)]
    return "\n".join([head, *blocks, f"_{len(suggestions)} suggestions_"]) + "\n"


def write_journal(suggestions: DataFrame, folder: str, session: str) -> str:
    """A session's note; a few rows. A note that is there already is not replaced."""
    path = Path(folder) / f"{session}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [(r["query_id"], r["text"]) for r in suggestions.orderBy("ord").collect()]
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(journal_text(rows, date.fromisoformat(session)))
    return str(path)


@dataclass
class Config:
    """Settings; unknown keys are told apart, and a file that cannot be read gives the defaults."""

    min_sections: int = 2
    date_threshold: float = 0.5
    min_cluster_size: int = 5
    n_terms: int = 4
    novelty_threshold: float = 0.85
    novelty_days: int = 60
    diversity_threshold: float = 0.85
    timeout: int = 30
    max_failures: int = 3
    retention: int = 730
    count: int = 5
    excluded: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> tuple[Config, list[str]]:
        try:
            spec = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
            known = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in spec.items() if k in known}), sorted(set(spec) - known)
        except (OSError, yaml.YAMLError, TypeError, AttributeError):
            return cls(), []

    def save(self, path: str) -> None:
        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False), encoding="utf-8")


def recommendations(stats: dict[str, float]) -> list[str]:
    """What a corpus's figures suggest; always something."""
    rules = [
        (stats.get("orphan_pct", 0) > 10, "Many notes stand alone: link some of them."),
        (stats.get("gap_pct", 0) > 5, "Many notes belong to no cluster: look for themes among them."),
        ("vendi_score" in stats and stats["vendi_score"] < 0.3 * stats.get("notes", 0), "Notes resemble each other: look elsewhere for new ones."),
        ("entropy" in stats and stats["entropy"] < 1.5, "A few themes hold most notes."),
        (stats.get("drift", 0) > 0.5, "The corpus shifts fast."),
        ("drift" in stats and stats["drift"] < 0.05, "The corpus hardly moves."),
        (stats.get("disabled", 0) > 0, "Some queries are disabled: see their last errors."),
    ]
    return [text for holds, text in rules if holds] or ["All is well."]


def stats_json(stats: dict[str, object]) -> str:
    return json.dumps(stats, sort_keys=True, default=str)
