"""User functions: queries, corpus functions, metadata columns, and an encoder with a cache, each checked when registered."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.storage import stash

NAME = re.compile(r"[a-z][a-z0-9_]*")


class Registry:
    """Functions by kind and name. A name is taken once; a function must accept what it will be called with."""

    KINDS = {"query": 1, "vault": 1, "metadata": 1}

    def __init__(self, allowed: set[str] | None = None) -> None:
        self.allowed = allowed
        self.functions: dict[str, dict[str, Callable]] = {k: {} for k in self.KINDS}

    def add(self, kind: str, name: str, f: Callable) -> Callable:
        """Register ``f``: a query takes a corpus and gives a table, a vault function a corpus and more, metadata a notes table
        and gives columns by name."""
        if kind not in self.KINDS:
            raise ValueError(f"no such kind: {kind}")
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name")
        if self.allowed is not None and name not in self.allowed:
            raise PermissionError(f"{name} is not on the list of allowed functions")
        if name in self.functions[kind]:
            raise ValueError(f"{kind} {name} is registered already")
        taken = [p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        if len(taken) < self.KINDS[kind]:
            raise TypeError(f"{kind} {name} takes no argument")
        self.functions[kind][name] = f
        return f

    def register(self, kind: str, name: str | None = None) -> Callable[[Callable], Callable]:
        return lambda f: self.add(kind, name or f.__name__, f)

    def query(self, name: str, corpus: object) -> DataFrame:
        """A query's result: a table with a string column ``a`` (and ``b``, if any)."""
        out = self.functions["query"][name](corpus)
        if not isinstance(out, DataFrame):
            raise TypeError(f"{name} gives {type(out).__name__}, not a table")
        for c in ("a", "b"):
            if c in out.columns and not isinstance(out.schema[c].dataType, T.StringType):
                raise TypeError(f"{name}: column {c} is no path")
        if "a" not in out.columns:
            raise TypeError(f"{name}: no column a")
        return out

    def call(self, name: str, corpus: object, *args: object) -> object:
        return self.functions["vault"][name](corpus, *args)

    def metadata(self, notes: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``notes`` with the columns of the named functions; two that give one name raise."""
        taken: dict[str, Column] = {}
        for name in names or sorted(self.functions["metadata"]):
            found = self.functions["metadata"][name](notes)
            clash = set(found) & (set(taken) | set(notes.columns))
            if clash:
                raise ValueError(f"{name}: columns {sorted(clash)} are there already")
            taken |= found
        return notes.withColumns(taken)


def compare(metadata: DataFrame, a: str, b: str) -> DataFrame:
    """(name, a, b, difference) of the numeric columns of two notes; no row for a note that is not there."""
    numbers = [f.name for f in metadata.schema if isinstance(f.dataType, T.NumericType)]
    long = metadata.select("path", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in numbers])))
    x, y = (long.where(F.col("path") == p).select("name", F.col("v").alias(k)) for k, p in (("a", a), ("b", b)))
    return x.join(y, "name").withColumn("difference", F.col("b") - F.col("a"))


def encode(notes: DataFrame, encoder: Callable[[DataFrame], DataFrame], model: str, cache: str | None = None) -> DataFrame:
    """(path, digest, model, embedding) of every note. ``encoder`` takes (digest, text) and gives (digest, embedding).

    Texts are encoded once by digest, and not at all if ``cache``, a folder, has the digest for this model already; what is
    new is appended to it.
    """
    spark = notes.sparkSession
    d = notes.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), F.coalesce("content", F.lit("")).alias("text"))
    texts = d.groupBy("digest").agg(F.first("text").alias("text"))
    known = None
    if cache is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(cache).where(F.col("model") == model).select("digest", "embedding").dropDuplicates(["digest"])
            texts = texts.join(known.select("digest"), "digest", "left_anti")
    new = stash(encoder(texts).select("digest", F.col("embedding").cast("array<double>").alias("embedding")), "encoded")
    if cache is not None:
        new.withColumn("model", F.lit(model)).write.mode("append").parquet(cache)
    every = new if known is None else stash(known.unionByName(new), "encoded")
    return d.select("path", "digest").join(every, "digest").select("path", "digest", F.lit(model).alias("model"), "embedding")
