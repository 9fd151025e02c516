"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text's letters are read in lower case, runs of anything else as one gap, and its n-grams of one to three characters
are ranked by frequency, equally frequent ones by code point. The distance to a language is the sum, over the text's
``DEPTH`` first n-grams, of how far each stands from its place in the language's profile; one that the profile lacks
counts as ``DEPTH`` places off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.base import table
from driftwell.storage import broadcast_checked

#: N-grams that a profile and a text are ranked to.
DEPTH = 300
#: Documents of each language, at most, that its profile is learned from; fewer languages have more.
SAMPLE = 4_000
BITS = np.uint64(21)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for every code point that is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of one to three characters; none if there is no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.where(is_letter, cp, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    gap = c == 32
    c = c[np.append(True, ~(gap[1:] & gap[:-1]))]
    two = c[:-1] << BITS | c[1:]
    three = two[:-1] << BITS | c[2:]
    # a gap alone, or in the middle, says nothing of a word
    return np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The first ``depth`` codes by count, equal counts by code."""
    if len(codes) > 2 * depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")][:depth]


def learn(docs: DataFrame, sample: int = SAMPLE, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """The profile of every language of ``docs`` (doc_id, text, lang), rows without a language apart.

    At most about ``sample`` documents of a language are read, chosen by a hash of their id. N-grams are counted by task,
    summed by Spark, and only ``depth`` of each language reach the driver: 8 bytes for each, so ten thousand languages are 24 MB.
    """
    docs = docs.where("lang is not null and text is not null")
    sizes = broadcast_checked(docs.groupBy(F.col("lang").alias("l")).agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share")))
    some = docs.join(sizes, docs["lang"] == sizes["l"]).where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
            for lang, parts in held.items():
                codes, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    totals = some.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in totals.withColumn("place", place).where(F.col("place") <= depth).orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Ranker:
    """Distances of texts to every profile."""

    def __init__(self, profiles: dict[str, np.ndarray], depth: int = DEPTH) -> None:
        self.names, self.depth = sorted(profiles), depth
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.names])) if profiles else np.zeros(0, np.uint64)
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name of equally near ones) and how much nearer it is than the next."""
        codes = grams(text) if text else ()
        if not len(codes) or not self.names:
            return "und", 0.0
        mine = ranked(*counted(codes), self.depth)
        at = np.searchsorted(self.codes, mine)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == mine), at, len(self.codes))
        places = self.places[at]
        off = np.where(places < 0, self.depth, np.abs(places - np.arange(len(mine))[:, None])).sum(axis=0)
        order = np.argsort(off, kind="stable")
        best = float(off[order[0]])
        rest = float(off[order[1]]) if len(order) > 1 else float(self.depth * len(mine))
        return self.names[order[0]], (1.0 - best / rest) if rest else 0.5


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], depth: int = DEPTH) -> DataFrame:
    """(doc_id, lang_pred, score) for every document by its whole text.

    ``und`` and 0 for null texts, those without a letter, and if no language was learned; an empty table gives an empty
    result. Repeated rows are judged alike; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Ranker(profiles, depth).judge
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def remainder(modulus: int) -> Column:
    """crc32 of the id as text; a null id has remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(remainder(4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
