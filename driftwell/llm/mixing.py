"""Mixing sources to target weights by nested hash-threshold histograms.

Each document hashes to a 60-bit key. A histogram of words by source and the top 12 bits tells which bucket a source's
word budget ends in; only that bucket is counted again by its next 12 bits, until a single key is left. A document is
then taken if its key lies below its source's threshold, so no row is ever sorted and a larger budget keeps all that a
smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.llm.base import WORD, table
from driftwell.storage import broadcast_checked, stash

#: Weights of the sources by code point, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST = 3
BITS, LEVELS = 12, 5
#: Sources at most; the pass that shares the total among them is one task.
SOURCES = 1_000_000
SEED = 20240117


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(*columns: Column) -> Column:
    """60 bits, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 64 - BITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` to ``(…, target, base, budget)``.

    Targets share the total by weight; a source whose share exceeds ``most`` times its size stops there, and the rest is
    shared again until none is above. That fixed point is ``min(most * size, level * weight)`` for one level, found by
    running sums over the sources in order of ``most * size / weight``. The table has one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    upto, from_, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(from_))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    s = s.withColumn("base", F.least(base, F.lit(most)).cast("int"))
    return s.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")).select("source", "source_size", "target", "base", "budget")


def thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """Add to the plan the key below which a source's documents are taken once more.

    ``narrow`` has source, size and key. Each level reads only the bucket in which the budget of its source ends.
    """
    state = plan.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("budget")).withColumn("open", F.col("budget") > 0)
    for level in range(LEVELS):
        up, here = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        live = state.where("open").select(F.col("source").alias("s"), "prefix", "left")
        rows = narrow.withColumn("above", F.shiftright("key", up) if level else F.lit(0).cast("long"))
        rows = rows.join(live, rows["source"].eqNullSafe(live["s"]) & (rows["above"] == live["prefix"]))
        hist = rows.groupBy("source", F.shiftright("key", here).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"), F.first("left").alias("left"))
        cum = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        over = hist.withColumn("before", cum - F.col("n")).where(F.col("before") + F.col("n") > F.col("left"))
        cut = over.groupBy("source").agg(F.min(F.struct("bucket", "before", "n", "docs")).alias("c"))
        cut = cut.select(F.col("source").alias("cs"), F.col("c.bucket").alias("bucket"), F.col("c.before").alias("before"), F.col("c.n").alias("n"), F.col("c.docs").alias("docs"))
        state = state.join(cut, state["source"].eqNullSafe(cut["cs"]), "left")
        left, single = F.col("left") - F.col("before"), (F.col("docs") == 1) | F.lit(level == LEVELS - 1)
        # without a boundary a source gives all: its threshold lies above every key; the last bucket goes in if that comes nearer
        end = (F.col("bucket") + F.when(2 * left >= F.col("n"), 1).otherwise(0)) * F.lit(1 << here)
        prefix = F.when(~F.col("open"), F.col("prefix")).when(F.col("bucket").isNull(), F.lit(1 << BITS * LEVELS)).when(single, end).otherwise(F.col("bucket"))
        state = state.select("source", "source_size", "target", "base", "budget", prefix.cast("long").alias("prefix"), F.coalesce(left, F.lit(0.0)).alias("left"), (F.col("open") & F.coalesce(~single, F.lit(False))).alias("open"))
        state = stash(state, "mix-state")
        if state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "base", F.col("prefix").alias("threshold"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The narrow table (doc_id, source, size, key) and the plan by source."""
    narrow = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_key(F.col("doc_id")).alias("key")), "mix-sizes")
    sizes = stash(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    if sizes.count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: their targets are found in one ordered pass")
    plan = stash(targets(sizes, weights, most), "mix-plan")
    return narrow, broadcast_checked(thresholds(narrow, plan))


def copies() -> Column:
    return F.col("base") + F.when(F.col("key") < F.col("threshold"), 1).otherwise(0)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document what the mix takes of it.

    Null texts have size 0 and null sources are a source of their own; rows that repeat a doc_id are taken alike; an
    empty table gives an empty result. Extra columns are ignored.
    """
    narrow, plan = mix_plan(docs, weights, most)
    plan = plan.withColumnRenamed("source", "s")
    out = narrow.join(plan, narrow["source"].eqNullSafe(plan["s"]), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it; columns as they are."""
    names = docs.columns
    _, plan = mix_plan(docs, weights, most)
    plan = plan.select(F.col("source").alias("__dw_s"), F.col("base").alias("__dw_base"), F.col("threshold").alias("__dw_t"))
    out = docs.withColumn("__dw_key", hash_key(F.col("doc_id"))).join(plan, docs["source"].eqNullSafe(plan["__dw_s"]), "left")
    n = F.col("__dw_base") + F.when(F.col("__dw_key") < F.col("__dw_t"), 1).otherwise(0)
    return out.withColumn("__dw_n", F.explode(F.array_repeat(F.lit(1), n))).select(*[docs[c] for c in names])


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
