"""A quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Texts are put in a few statistics. Cosines of random projections of these approximate a Gaussian kernel (Rahimi and
Recht, 2007); every partition sums its part of the normal equations, sums are added in a second step, and the driver
solves a system whose size does not depend on the data. Ridge scores become probabilities by isotonic regression on
counts by score bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, table
from driftwell.llm.language_id import remainder
from driftwell.storage import stash

STATISTICS = ("words", "characters", "word_length", "capitals", "digits", "signs", "bars", "marks", "others", "distinct", "common", "lines", "line_length", "repeated_lines", "capital_words", "ends")
FEATURES, WIDTH, RIDGE, SEED = 300, 2.5, 1e-3, 17
#: So many sums are added in a task, level by level, until no more are left for the driver.
FOLD = 32
#: One labelled row in so many is kept from the ridge regression for the calibration.
HELD = 5
BUCKETS = 2000


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


UPPER, DIGIT, SIGNS, BARS, MARKS, ENDS = (_class(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=_+{}[]\\", "|", "!?", ".,;:"))
WHITE = _class(" \t\n\x0b\x0c\r")


def statistics(text: bytes) -> list[float]:
    """The statistics of a text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(int(counts[~WHITE].sum()), 1)
    part = lambda which: float(counts[which].sum()) / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    tops = sorted(seen.values())[-5:]
    m = len(words)
    return [
        float(np.log1p(m)), float(np.log1p(n)), min(n / m, 40.0), part(UPPER), part(DIGIT), part(SIGNS), part(BARS), part(MARKS), float(counts[128:].sum()) / n, len(seen) / m, sum(tops) / m,
        float(np.log1p(len(lines))), float(np.log1p(len(text) / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1), sum(map(bytes.isupper, words)) / m, part(ENDS),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null one counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in byte_rows(batch.column(1))], np.float64).reshape(-1)
            values = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, len(STATISTICS), dtype=np.int32), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(STATISTICS))


class Kernel:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = WIDTH) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / width, (len(STATISTICS), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    one = rows.agg(*[f(F.col("x")[k]) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    return tuple(np.array([v or 0.0 for v in one[i::2]]) for i in (0, 1))


def fit(labelled: DataFrame, kernel: Kernel, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from (x, y)."""
    d = len(kernel.b) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((d, d + 2))
        for batch in batches:
            z, y = kernel(matrix(batch.column(0))), np.asarray(batch.column(1), np.float64)
            a[:, :d] += z.T @ z
            a[:, d] += z.T @ y
            a[0, d + 1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([a.tobytes()], pa.binary())], names=["part", "sums"])

    def added(part: pa.Table) -> pa.Table:
        total = np.zeros(d * (d + 2))
        for b in part["sums"]:
            total += np.frombuffer(b.as_buffer())
        return pa.table({"part": pa.array([part["part"][0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part bigint, sums binary"
    sums = stash(labelled.select("x", "y").mapInArrow(partial, kind), "sums")
    while sums.count() > FOLD:
        sums = stash(sums.withColumn("part", F.expr(f"part div {FOLD}")).groupBy("part").applyInArrow(added, kind), "sums")
    total = sum((np.frombuffer(r["sums"]) for r in sums.collect()), np.zeros(d * (d + 2))).reshape(d, d + 2)
    n = max(total[0, d + 1], 1.0)
    return np.linalg.solve(total[:, :d] / n + ridge * np.eye(d) / d, total[:, d] / n)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the steps' centres and heights, never falling. ``at`` is in order."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at.tolist(), ones.tolist(), n.tolist(), strict=True):
        blocks.append([x * w, y, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def scored(rows: DataFrame, kernel: Kernel, weights: np.ndarray, steps: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``rows`` (…, x) with ``raw``, or the calibrated ``score`` in its place: straight lines between the steps' centres."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        raw = kernel(matrix(x)) @ weights
        if steps is None:
            return pa.array(raw)
        flat = np.interp(raw, *steps) if len(steps[0]) else np.full(len(raw), 0.5)
        return pa.array(np.clip(0.99 * flat + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1))

    return rows.withColumn("raw" if steps is None else "score", score("x"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every document; ``labels`` has doc_id and label 0 or 1, null ones are left out.

    Only the rows of ``labels`` are learned from. Without any, every score is about 0.5. Empty and null texts are scored
    like others, repeated rows alike; extra columns are ignored.
    """
    rows = stash(measured(docs), "statistics")
    known = labels.where("label is not null and doc_id is not null").select(F.col("doc_id").alias("__dw_id"), F.col("label").cast("double").alias("y"))
    labelled = stash(rows.join(known, rows["doc_id"] == known["__dw_id"]).select("x", "y", (F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(HELD)) == 0).alias("held")), "labelled")
    kernel = Kernel(*moments(labelled))
    # the steps are fitted on rows that the weights have not seen; too few labels for that are used for both
    held = labelled.where("held")
    both = labelled.where("held = false").isEmpty() or held.isEmpty()
    weights = fit(labelled if both else labelled.where("held = false"), kernel)
    raw = scored(labelled if both else held, kernel, weights).select(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * (BUCKETS / 3)).alias("bucket"), "y")
    steps = raw.groupBy("bucket").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bucket").collect()
    at, ones, n = (np.array([r[k] for r in steps], np.float64) for k in ("bucket", "ones", "n"))
    centres = isotonic((at + 0.5) / (BUCKETS / 3), ones, n) if len(at) else (at, at)
    return scored(rows, kernel, weights, centres).select("doc_id", "score")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1).select("doc_id", F.col("quality").alias("label"))
    out = classify(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
