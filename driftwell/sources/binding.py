"""The corpus model on plain tables: documents as marked-up notes, vectors as sessions of embeddings, dated suggestions.

The expressions are SQL that Spark and DuckDB read alike, so an oracle can build the same notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import markdown as M

SESSION_DATE = "2024-07-01"
NL = "chr(10)"
#: Markup added to a document's text, from its id alone.
MARKUP = f"""concat(
 '---', {NL}, 'title: Doc ', doc_id, {NL}, 'tags: [topic', doc_id % 7, ', area', doc_id % 3, ']', {NL}, '---', {NL}, coalesce(text, ''), {NL},
 CASE WHEN doc_id % 4 <> 0 THEN concat('See [[Doc ', (doc_id * 7 + 3) % 211, ']] and [[doc/', (doc_id * 13 + 5) % 97, '.md|alias]].', {NL}) ELSE '' END,
 CASE WHEN doc_id % 5 = 1 THEN concat('![[doc/', (doc_id * 3 + 1) % 301, '#part]]', {NL}) ELSE '' END,
 CASE WHEN doc_id % 6 = 2 THEN concat('[[missing', doc_id % 3, '^b1]]', {NL}) ELSE '' END,
 'Kept under #tag', doc_id % 7, ' and #x/y', doc_id % 2, '.', {NL},
 CASE WHEN doc_id % 3 = 0 THEN concat('- [ ] todo ', doc_id, {NL}, '- [x] done ', doc_id, {NL}) ELSE '' END,
 CASE WHEN doc_id % 8 = 1 THEN concat('TODO: check item ', doc_id, {NL}) ELSE '' END,
 CASE WHEN doc_id % 9 = 2 THEN concat('> quoted words from document ', doc_id, {NL}) ELSE '' END,
 CASE WHEN doc_id % 10 = 3 THEN concat('What would happen to item ', doc_id, '?', {NL}) ELSE '' END,
 CASE WHEN doc_id % 11 = 4 THEN concat('I think we might perhaps be going to change my plan. It was said and had gone.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 12 = 5 THEN concat('Research shows that item ', doc_id, ' is important because it will matter.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 13 = 6 THEN concat('Item', doc_id, ' is defined as a thing of number ', doc_id, '.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 3 = 1 THEN concat('Under [[Doc ', doc_id % 5, ']].', {NL}) ELSE '' END,
 CASE WHEN doc_id % 16 = 9 THEN concat('Obviously and clearly, all must always change because of this; it should, and therefore it leads to more, thus it stays. Certainly.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 16 = 13 THEN concat('Maybe and perhaps it might be unclear, but it cannot, and never did, except where no one looks; debatable.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 16 = 5 THEN concat('A general theory of structure, a principle and an abstract framework.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 16 = 1 THEN concat('An actual, practical example of a particular case, in real detail. We will build it, and we shall go on; our plan will hold.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 16 = 2 THEN concat('- Which item, ', doc_id, ', comes first?', {NL}, '**Term', doc_id, '**: the meaning given here.', {NL}, 'If it holds then we would see www.example.org/a in `two', {NL}, 'lines` of code.', {NL}) ELSE '' END,
 CASE WHEN doc_id % 40 = 8 THEN concat('Kin: [[Doc ', doc_id + 12, ']], [[Doc ', doc_id + 24, ']], [[Doc ', doc_id + 36, ']].', {NL}) ELSE '' END,
 CASE WHEN doc_id % 14 = 7 THEN concat('## 2024-01-', 10 + doc_id % 19, {NL}, 'entry one', {NL}, {NL}, '## 2024-02-', 10 + doc_id % 17, {NL}, 'entry two', {NL}) ELSE '' END,
 CASE WHEN doc_id % 15 = 8 THEN concat('```', {NL}, '#notatag code', {NL}, '```', {NL}, '`#alsonot`', {NL}) ELSE '' END)"""
PATH = "concat(CASE WHEN doc_id % 50 = 49 THEN 'session journal/' ELSE 'doc/' END, doc_id, '.md')"
AGE, IDLE = "CASE WHEN doc_id % 60 = 55 THEN doc_id % 83 ELSE doc_id % 12 * 91 + doc_id * 5 % 13 END", "CASE WHEN doc_id % 51 = 0 THEN 0 ELSE 1 + doc_id * 17 % 399 END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with links and tags."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    content = F.col("whole")
    base = docs.selectExpr("doc_id", f"{PATH} AS path", f"{MARKUP} AS whole", f"CAST(date_sub(DATE'{SESSION_DATE}', CAST({AGE} AS INT)) AS TIMESTAMP) AS created", f"CAST(date_sub(DATE'{SESSION_DATE}', CAST({IDLE} AS INT)) AS TIMESTAMP) AS modified")
    return base.select("doc_id", "path", M.title(content, F.col("path")).alias("title"), M.body(content).alias("content"), "created", "modified", F.lit(False).alias("is_virtual"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("date").alias("entry_date"), M.links(content).alias("links"), M.tags(content).alias("tags"))


#: Vectors lean towards one of twelve directions, so that alike notes are as alike as those of a real corpus.
GROUPED = "transform({x}, (x, i) -> CAST(x AS DOUBLE) + 0.35 * ((vec_id % 12 * 31 + i * 17) % 11 - 5) / 5.0D)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, label, embedding) of the current session, in double precision."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.concat(F.lit("doc/"), "vec_id", F.lit(".md")).alias("path"), "vec_id", "label", F.expr(GROUPED.format(x="embedding")).alias("embedding"))


#: Past sessions by number and date; each vector moves by a known step a session.
SESSION_VALUES = ", ".join(f"({k}, DATE'{d}')" for k, d in enumerate(("2023-01-01", "2023-06-01", "2023-10-01", "2024-01-01", "2024-04-01", "2024-07-01"), 1))
#: Element ``i`` of vector ``vec_id`` in session ``s``, from its current value ``x``; all cycle, some drift.
MOVED = "x + CASE WHEN vec_id % 3 = 0 THEN 0.3 * (6 - {s}) * ((vec_id * 31 + i * 17) % 11 - 5) / 5.0 WHEN vec_id % 3 = 1 THEN 0.8 * ({s} % 2) * ((vec_id * 7 + i * 5) % 9 - 4) / 4.0 ELSE 0.01 * (6 - {s}) END"


def session_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, date, path, vec_id, embedding) of every session."""
    days = spark.sql(f"SELECT * FROM VALUES {SESSION_VALUES} AS t(session_id, date)")
    return vectors(spark, sf_dir).join(F.broadcast(days)).selectExpr("session_id", "date", "path", "vec_id", f"transform(embedding, (x, i) -> {MOVED.format(s='session_id')}) AS embedding")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past suggestions (session_date, text): benchmark texts, one a day before the session."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.date_sub(F.lit(SESSION_DATE).cast("date"), F.col("item_id").cast("int")).alias("session_date"), F.lit("bench").alias("query_id"), "text", F.col("item_id").cast("string").alias("block_id"))
