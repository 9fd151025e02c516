"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.base import table
from driftwell.llm.mixing import mix_documents
from driftwell.llm.near_copies import drop_near_copies
from driftwell.llm.packing import default_tokenizer, pack
from driftwell.llm.quality_rules import keep_good
from driftwell.llm.suffix_dedup import drop_repeats
from driftwell.storage import stash

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: keep_good(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: drop_near_copies(docs)),
    ("suffix_array_dedup", lambda spark, docs, sf_dir: drop_repeats(docs)),
    ("mixing", lambda spark, docs, sf_dir: mix_documents(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs, default_tokenizer())),
]

#: Similarity search, suffix arrays and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
