"""Named queries with DuckDB oracles that build the same model from the plain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import markdown as M
from driftwell.operators import links as L
from driftwell.sources import binding as B
from driftwell.sources.vault import link_rows, tag_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Corpus:
    """The relations that queries read; each is a lazy plan built once for a query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def notes(self) -> DataFrame:
        return B.notes(self.spark, self.dir)

    @cached_property
    def own_notes(self) -> DataFrame:
        """Notes outside the journal folder."""
        return self.notes.where(~F.col("path").startswith(M.JOURNAL_DIR))

    @cached_property
    def links(self) -> DataFrame:
        return link_rows(self.notes)

    @cached_property
    def tags(self) -> DataFrame:
        return tag_rows(self.notes)

    @cached_property
    def edges(self) -> DataFrame:
        return L.edges(self.notes, self.links)

    @cached_property
    def directed(self) -> DataFrame:
        return L.outgoing(self.notes, self.links).select(F.col("path").alias("a"), F.col("target_path").alias("b")).where("a <> b").distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        return B.vectors(self.spark, self.dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return B.session_vectors(self.spark, self.dir)

    @cached_property
    def history(self) -> DataFrame:
        return B.history(self.spark, self.dir)


DUCK = {
    "n0": f"SELECT doc_id, {B.PATH} AS path, {B.MARKUP} AS whole, DATE '{B.SESSION_DATE}' - CAST({B.AGE} AS INT) AS created, DATE '{B.SESSION_DATE}' - CAST({B.IDLE} AS INT) AS modified FROM documents",
    "notes": "SELECT doc_id, path, concat('Doc ', doc_id) AS title, substr(whole, length(concat('---', chr(10), 'title: Doc ', doc_id, chr(10), 'tags: [topic', doc_id % 7, ', area', doc_id % 3, ']', chr(10), '---', chr(10))) + 1) AS content, created, modified FROM n0",
    "own": "SELECT * FROM notes WHERE path NOT LIKE 'session journal/%'",
    "l0": r"SELECT path, unnest(x) AS m, generate_subscripts(x, 1) - 1 AS position FROM (SELECT path, regexp_extract_all(content, '!?\[\[[^\]|]+(?:\|[^\]]+)?\]\]') AS x FROM notes)",
    "l1": r"SELECT path, position, m, trim(regexp_extract(m, '\[\[([^\]|]+)', 1)) AS raw, trim(regexp_extract(m, '\|([^\]]+)\]\]', 1)) AS shown FROM l0",
    "links": r"SELECT path AS source_path, position, trim(split_part(split_part(raw, '^', 1), '#', 1)) AS target, CASE WHEN shown <> '' THEN shown END AS display_text, m LIKE '!%' AS is_embed, CASE WHEN raw LIKE '%^%' THEN regexp_extract(raw, '\^(.*)$', 1) END AS block_ref FROM l1 WHERE trim(split_part(split_part(raw, '^', 1), '#', 1)) <> ''",
    "tags": r"SELECT DISTINCT path AS note_path, tag FROM (SELECT path, unnest(list_concat([concat('topic', doc_id % 7), concat('area', doc_id % 3)], regexp_extract_all(regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g'), '#([a-zA-Z0-9_/-]+)', 1))) AS tag FROM notes)",
    "forms": "SELECT DISTINCT path, unnest([path, regexp_replace(path, '\\.[^.]*$', ''), title]) AS form FROM notes",
    "claims": "SELECT path, unnest([1, 2, 3]) AS rank, unnest([path, regexp_replace(path, '\\.md$', ''), title]) AS form FROM notes",
    "resolver": "SELECT form, arg_min(path, printf('%d|%s', rank, path)) AS path FROM claims GROUP BY form",
    "outgoing": "SELECT l.source_path AS path, l.position, r.path AS target_path FROM links l JOIN resolver r ON l.target = r.form",
    "backlinks": "SELECT DISTINCT f.path, l.source_path FROM links l JOIN forms f ON l.target = f.form",
    "edges": "SELECT DISTINCT least(path, target_path) AS a, greatest(path, target_path) AS b FROM outgoing WHERE path <> target_path",
    "directed": "SELECT DISTINCT path AS a, target_path AS b FROM outgoing WHERE path <> target_path",
    "twoway": "SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges",
    "v": "SELECT concat('doc/', vec_id, '.md') AS path, vec_id, label, list_transform(embedding, lambda x, i1: CAST(x AS DOUBLE) + CAST(0.35 AS DOUBLE) * ((vec_id % 12 * 31 + (i1 - 1) * 17) % 11 - 5) / CAST(5.0 AS DOUBLE)) AS e FROM embeddings",
    "cross_": "SELECT x.path AS a, y.path AS b, list_cosine_similarity(x.e, y.e) AS sim FROM v x, v y WHERE x.path <> y.path",
    "sims": "SELECT * FROM cross_ WHERE a < b",
    "knn": "SELECT * FROM (SELECT a AS path, b AS neighbour, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM cross_) WHERE rank <= 10",
    "days": f"SELECT * FROM (VALUES {B.SESSION_VALUES.replace("DATE'", "DATE '")}) AS t(session_id, date)",
    "sv": f"SELECT session_id, date, path, vec_id, list_transform(e, lambda x, i0: {B.MOVED.format(s='session_id').replace('i * ', '(i0 - 1) * ')}) AS e FROM v, days",
    "ends": "SELECT path, count(*) AS n, arg_min(e, date) AS f, arg_max(e, date) AS l FROM sv GROUP BY path",
    "history": f"SELECT DATE '{B.SESSION_DATE}' - CAST(item_id AS INT) AS session_date, text, item_id FROM benchmark",
    "meta": f"SELECT path, len(w) AS word_count, (SELECT count(*) FROM links l WHERE l.source_path = x.path) AS link_count, (SELECT count(*) FROM tags t WHERE t.note_path = x.path) AS tag_count, DATE '{B.SESSION_DATE}' - created AS age_days, DATE '{B.SESSION_DATE}' - modified AS days_since_modified, open_, done_, len(list_distinct(list_transform(w, lambda t: lower(t)))) AS distinct_ FROM (SELECT *, list_filter(string_split_regex(content, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w, len(regexp_extract_all(content, '(?m)^[ \\t]*[-*] \\[ \\]')) AS open_, len(regexp_extract_all(content, '(?m)^[ \\t]*[-*] \\[[xX]\\]')) AS done_ FROM notes) x",
}
NEEDS = {
    "notes": ["n0"], "own": ["notes"], "l0": ["notes"], "l1": ["l0"], "links": ["l1"], "tags": ["notes"], "forms": ["notes"], "claims": ["notes"], "resolver": ["claims"], "outgoing": ["links", "resolver"], "backlinks": ["links", "forms"], "edges": ["outgoing"],
    "directed": ["outgoing"], "twoway": ["edges"], "cross_": ["v"], "sims": ["cross_"], "knn": ["cross_"], "sv": ["v", "days"], "ends": ["sv"], "meta": ["notes", "links", "tags"],
}


def duck(body: str, *names: str) -> str:
    """DuckDB SQL with the relations that ``body`` needs; ``body`` may go on with relations of its own after ``;;``."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    more, _, last = body.rpartition(";;")
    ctes = [f"{n} AS MATERIALIZED ({DUCK[n]})" for n in order] + ([more.strip()] if more.strip() else [])
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + last.strip()


def query(sql: str | None = None, *names: str):  # noqa: ANN201
    """Register a function of a corpus under its own name, with its oracle."""

    def add(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = duck(sql, *names)
        return f

    return add
