"""Queries over notes, links, tags, features and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions import markdown as M
from driftwell.functions import voice as V
from driftwell.operators import extraction as X
from driftwell.operators import filters as S
from driftwell.operators import graph as G
from driftwell.operators import links as L
from driftwell.plans.registry import Corpus, query
from driftwell.sources import vault

SESSION = "2024-07-01"
NJ = "path NOT LIKE 'session journal/%'"
# ruff: noqa: D103


@query("SELECT path, title, sha256(content) AS digest, strftime(created, '%Y-%m-%d') AS created, strftime(modified, '%Y-%m-%d') AS modified FROM notes", "notes")
def parse_notes(c: Corpus) -> DataFrame:
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return c.notes.select("path", "title", F.sha2("content", 256).alias("digest"), day("created"), day("modified"))


@query("SELECT source_path, CAST(position AS BIGINT) AS position, target, display_text, is_embed, block_ref FROM links", "links")
def extract_links(c: Corpus) -> DataFrame:
    return c.links.withColumn("position", F.col("position").cast("bigint"))


@query("SELECT note_path, tag FROM tags", "tags")
def extract_tags(c: Corpus) -> DataFrame:
    return c.tags


@query(r"SELECT path, CAST(open_ AS BIGINT) AS open_tasks, CAST(done_ AS BIGINT) AS done_tasks FROM meta WHERE open_ + done_ > 0", "meta")
def task_counts(c: Corpus) -> DataFrame:
    n = c.notes.select("path", M.open_tasks(F.col("content")).alias("open_tasks"), M.done_tasks(F.col("content")).alias("done_tasks"))
    return n.where(F.col("open_tasks") + F.col("done_tasks") > 0)


@query("SELECT path, strftime(day, '%Y-%m-%d') AS entry_date, txt AS content FROM (SELECT path, make_date(2024, 1, CAST(10 + doc_id % 19 AS INT)) AS day, 'entry one' AS txt, doc_id FROM notes UNION ALL SELECT path, make_date(2024, 2, CAST(10 + doc_id % 17 AS INT)), 'entry two' || CASE WHEN doc_id % 15 = 8 THEN concat(chr(10), '```', chr(10), '#notatag code', chr(10), '```', chr(10), '`#alsonot`') ELSE '' END, doc_id FROM notes) WHERE doc_id % 14 = 7", "notes")
def split_sections(c: Corpus) -> DataFrame:
    return vault.sections(c.notes).select("path", F.col("entry_date").cast("string").alias("entry_date"), "content")


@query("SELECT concat(path, '/', strftime(day, '%Y-%m-%d')) AS path, strftime(day, '%Y-%m-%d') AS title, path AS source_file FROM (SELECT path, make_date(2024, 1, CAST(10 + doc_id % 19 AS INT)) AS day, doc_id FROM notes UNION ALL SELECT path, make_date(2024, 2, CAST(10 + doc_id % 17 AS INT)), doc_id FROM notes) WHERE doc_id % 14 = 7", "notes")
def journal_entries(c: Corpus) -> DataFrame:
    files = c.notes.select("path", "content", F.lit(0.0).alias("file_mtime"), "modified")
    return vault.entries(files.where(vault.is_journal(F.col("content"), F.col("path")))).select("path", "title", "source_file")


@query("SELECT l.source_path, CAST(l.position AS BIGINT) AS position, r.path AS target_path FROM links l LEFT JOIN resolver r ON l.target = r.form", "links", "resolver")
def resolve_links(c: Corpus) -> DataFrame:
    return L.resolve_links(c.notes, c.links).select("source_path", F.col("position").cast("bigint").alias("position"), "target_path")


@query("SELECT path, source_path FROM backlinks", "backlinks")
def backlinks(c: Corpus) -> DataFrame:
    return L.backlinks(c.notes, c.links)


@query("SELECT path, CAST(position AS BIGINT) AS position, target_path FROM outgoing", "outgoing")
def outgoing_links(c: Corpus) -> DataFrame:
    return L.outgoing(c.notes, c.links).withColumn("position", F.col("position").cast("bigint"))


@query("SELECT DISTINCT path, neighbour FROM (SELECT path, target_path AS neighbour FROM outgoing UNION ALL SELECT path, source_path FROM backlinks)", "outgoing", "backlinks")
def graph_neighbours(c: Corpus) -> DataFrame:
    return L.graph_neighbours(c.notes, c.links)


@query("SELECT path, count(DISTINCT source_path) AS link_count FROM notes n JOIN links l ON l.target = n.path OR concat(l.target, '.md') = n.path OR l.target = n.title GROUP BY path ORDER BY 2 DESC, 1 LIMIT 10", "notes", "links")
def hubs(c: Corpus) -> DataFrame:
    return L.hubs(c.notes, c.links)


@query("SELECT path, count(*) AS backlinks FROM backlinks GROUP BY path HAVING count(*) >= 8", "backlinks")
def find_hubs(c: Corpus) -> DataFrame:
    return L.find_hubs(c.notes, c.links, 8)


@query("SELECT n.path, count(*) AS outgoing FROM notes n JOIN links l ON n.path = l.source_path GROUP BY n.path HAVING count(*) >= 3", "notes", "links")
def stats_hubs(c: Corpus) -> DataFrame:
    return L.outgoing_hubs(c.notes, c.links, 3)


@query("SELECT path, o AS outgoing, i AS incoming, o + i AS total FROM (SELECT path, (SELECT count(*) FROM links l WHERE l.source_path = n.path) AS o, (SELECT count(*) FROM links l WHERE l.target = n.path) AS i FROM notes n) ORDER BY total DESC, path LIMIT 10", "notes", "links")
def top_linked(c: Corpus) -> DataFrame:
    return L.top_linked(c.notes, c.links)


@query("SELECT path FROM notes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_path = n.path) AND NOT EXISTS (SELECT 1 FROM links l JOIN forms f ON l.target = f.form WHERE f.path = n.path)", "notes", "links", "forms")
def orphans(c: Corpus) -> DataFrame:
    return L.orphans(c.notes, c.links).select("path")


@query("SELECT path FROM notes n WHERE path NOT IN (SELECT path FROM backlinks) AND path NOT IN (SELECT path FROM outgoing)", "notes", "backlinks", "outgoing")
def find_orphans(c: Corpus) -> DataFrame:
    return L.find_orphans(c.notes, c.links).select("path")


@query("SELECT path FROM notes n WHERE path NOT IN (SELECT source_path FROM links) AND path NOT IN (SELECT target FROM links) AND title NOT IN (SELECT target FROM links)", "notes", "links")
def stats_orphans(c: Corpus) -> DataFrame:
    return L.raw_orphans(c.notes, c.links).select("path")


@query("SELECT count(*) AS bidirectional FROM (SELECT DISTINCT a.source_path, a.target FROM links a JOIN links b ON a.source_path = b.target AND a.target = b.source_path)", "links")
def bidirectional_links(c: Corpus) -> DataFrame:
    return L.bidirectional(c.links)


@query("SELECT n, l AS links, round(l / (n * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM notes) AS n, (SELECT count(*) FROM links) AS l)", "notes", "links")
def graph_density(c: Corpus) -> DataFrame:
    return L.density(c.notes, c.links).withColumn("density", F.round("density", 9))


@query("SELECT CASE WHEN source_path = 'doc/17.md' THEN 0 ELSE 1 END AS direction, CAST(position AS BIGINT) AS position, source_path, target FROM links l JOIN forms f ON l.target = f.form WHERE l.source_path IN ('doc/17.md', 'doc/122.md') AND f.path IN ('doc/17.md', 'doc/122.md') AND f.path <> l.source_path", "links", "forms")
def links_between(c: Corpus) -> DataFrame:
    return L.links_between(c.notes, c.links, "doc/17.md", "doc/122.md").withColumn("position", F.col("position").cast("bigint"))


@query("SELECT path, min(hop) AS hop FROM (SELECT b AS path, 1 AS hop FROM directed WHERE a = 'doc/5.md' UNION ALL SELECT y.b, 2 FROM directed x JOIN directed y ON x.b = y.a WHERE x.a = 'doc/5.md' UNION ALL SELECT z.b, 3 FROM directed x JOIN directed y ON x.b = y.a JOIN directed z ON y.b = z.a WHERE x.a = 'doc/5.md') WHERE path <> 'doc/5.md' GROUP BY path", "directed")
def k_hop(c: Corpus) -> DataFrame:
    return G.k_hop(c.directed, "doc/5.md", 3)


@query()
def shortest_path(c: Corpus) -> DataFrame:
    return G.shortest_path(c.directed, "doc/5.md", "doc/10.md").withColumn("position", F.col("position").cast("bigint"))


@query("SELECT b.path, coalesce(c.component, b.path) AS component FROM notes b LEFT JOIN (SELECT path, min(root) AS component FROM (WITH RECURSIVE r(path, root) AS (SELECT a, a FROM twoway UNION SELECT e.b, r.root FROM r JOIN twoway e ON e.a = r.path WHERE r.root < e.b) SELECT * FROM r) GROUP BY path) c ON b.path = c.path", "notes", "twoway")
def connected_components(c: Corpus) -> DataFrame:
    return G.components(c.notes, c.edges)


@query()
def largest_component(c: Corpus) -> DataFrame:
    return G.component_sizes(c.notes, c.edges).orderBy(F.desc("size"), "component").limit(1)


@query("SELECT path, CAST(d AS BIGINT) AS degree, CAST(coalesce(k, 0) AS BIGINT) AS linked, round(coalesce(k, 0) / (d * (d - 1) / 2), 6) AS density FROM (SELECT a AS path, count(*) AS d FROM twoway GROUP BY a HAVING count(*) >= 3) LEFT JOIN (SELECT x.a AS path, count(*) AS k FROM twoway x JOIN twoway y ON x.a = y.a JOIN edges e ON e.a = x.b AND e.b = y.b GROUP BY x.a) USING (path)", "twoway", "edges")
def neighbourhood_density(c: Corpus) -> DataFrame:
    return G.neighbourhood_density(c.edges).withColumn("density", F.round("density", 6))


@query("SELECT path, CAST(word_count AS BIGINT) AS word_count, link_count, tag_count, CAST(age_days AS BIGINT) AS age_days, CAST(days_since_modified AS BIGINT) AS days_since_modified, round(1 - 1 / (1 + days_since_modified / 30), 3) AS staleness, open_ + done_ > 0 AS has_tasks, CAST(open_ + done_ AS BIGINT) AS task_count, CAST(done_ AS BIGINT) AS completed_task_count, round(CASE WHEN word_count > 0 THEN distinct_ / word_count ELSE 0 END, 3) AS lexical_diversity, round(word_count / 200 + 1e-9, 2) AS reading_time FROM meta", "meta")
def metadata_builtin(c: Corpus) -> DataFrame:
    return V.metadata(c.notes).withColumns({k: F.col(k).cast("bigint") for k in ("age_days", "days_since_modified")})


@query("SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS p, unnest(quantile_cont(word_count, [0.1, 0.25, 0.5, 0.75, 0.9])) AS word_count FROM meta", "meta")
def metadata_distribution(c: Corpus) -> DataFrame:
    ps = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = V.metadata(c.notes).agg(F.percentile("word_count", F.array(*map(F.lit, ps))).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("q").alias("word_count"))).alias("z")).select("z.*")


@query("SELECT path, CAST(word_count AS BIGINT) AS word_count, round((word_count - m) / s, 6) AS z FROM meta, (SELECT avg(word_count) AS m, stddev_pop(word_count) AS s FROM meta) WHERE s > 1e-10 AND abs((word_count - m) / s) > 2", "meta")
def metadata_outliers(c: Corpus) -> DataFrame:
    m = V.metadata(c.notes).select("path", "word_count")
    s = F.broadcast(m.agg(F.avg("word_count").alias("m"), F.stddev_pop("word_count").alias("s")))
    return m.join(s).where("s > 1e-10").withColumn("z", (F.col("word_count") - F.col("m")) / F.col("s")).where("abs(z) > 2").select("path", "word_count", F.round("z", 6).alias("z"))


@query("SELECT path, CASE WHEN word_count >= hi THEN 'high' WHEN word_count <= lo THEN 'low' ELSE 'moderate' END AS level FROM meta, (SELECT quantile_cont(word_count, 0.75) AS hi, quantile_cont(word_count, 0.25) AS lo FROM meta)", "meta")
def metadata_profile(c: Corpus) -> DataFrame:
    m = V.metadata(c.notes).select("path", "word_count")
    q = F.broadcast(m.agg(F.percentile("word_count", F.lit(0.75)).alias("hi"), F.percentile("word_count", F.lit(0.25)).alias("lo")))
    return m.join(q).select("path", F.when(F.col("word_count") >= F.col("hi"), "high").when(F.col("word_count") <= F.col("lo"), "low").otherwise("moderate").alias("level"))


TOK = r"t0 AS (SELECT path, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '(https?://|www\.)\S+', ' ', 'g')), '[\p{L}\p{M}\p{N}_]+(?:''[\p{L}\p{M}\p{N}_]+)*') AS w FROM notes), t AS (SELECT path, len(w) AS n, len(list_filter(w, lambda x: x IN ('i', 'me', 'my', 'mine', 'myself'))) AS one, len(list_filter(w, lambda x: x IN ('we', 'us', 'our', 'ours', 'ourselves'))) AS two, len(list_filter(w, lambda x: x IN ('you', 'your', 'yours', 'yourself', 'yourselves'))) AS you, len(list_filter(w, lambda x: x IN ('might', 'could', 'may', 'would', 'should'))) AS modal, len(list_distinct(w)) AS d FROM t0) ;; "


@query(TOK + "SELECT path, round(CASE WHEN n > 0 THEN 100 * one / n ELSE 0 END, 6) AS singular, round(CASE WHEN n > 0 THEN 100 * two / n ELSE 0 END, 6) AS plural, round(CASE WHEN n > 0 THEN 100 * you / n ELSE 0 END, 6) AS second, round(CASE WHEN n > 0 THEN 100 * modal / n ELSE 0 END, 6) AS modals, round(CASE WHEN one + two > 0 THEN one / (one + two) ELSE 0.5 END, 6) AS self_focus, round(CASE WHEN n > 0 THEN d / n ELSE 0 END, 6) AS variety FROM t", "notes")
def voice_pronouns(c: Corpus) -> DataFrame:
    v = V.voice(c.notes)
    pick = {"singular": "first_person_singular_freq", "plural": "first_person_plural_freq", "second": "second_person_freq", "modals": "modal_freq", "self_focus": "self_focus_ratio", "variety": "type_token_ratio"}
    return v.select("path", *[F.round(f"voice.{x}", 6).alias(k) for k, x in pick.items()])


TENSE = TOK.replace(" ;; ", ", k AS (SELECT path, len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in V.PAST_LIST) + ") OR (x LIKE '%ed' AND length(x) > 3))) AS p, len(list_filter(w, lambda x: x IN ('will', 'shall', 'won''t'))) AS f, len(list_filter(w, lambda x: NOT (x IN (" + ", ".join(f"'{w}'" for w in V.PAST_LIST) + ") OR (x LIKE '%ed' AND length(x) > 3)) AND (x IN ('is', 'are', 'am', 'be', 'being', 'do', 'does', 'has') OR (x LIKE '%ing' AND length(x) > 4)))) AS r FROM t0), g AS (SELECT path, len(regexp_extract_all(lower(content), '\\bgoing to\\b|\\bgonna\\b')) AS g FROM notes) ;; ")


@query(TENSE + "SELECT path, round(CASE WHEN p + f + g + r > 0 THEN p / (p + f + g + r) ELSE 0 END, 6) AS past, round(CASE WHEN p + f + g + r > 0 THEN (f + g) / (p + f + g + r) ELSE 0 END, 6) AS future, round(CASE WHEN p + f + g + r > 0 THEN r / (p + f + g + r) ELSE 0 END, 6) AS present FROM k JOIN g USING (path)", "notes")
def voice_tense(c: Corpus) -> DataFrame:
    return V.voice(c.notes).select("path", *[F.round(f"voice.{k}_tense_ratio", 6).alias(k) for k in ("past", "future", "present")])


@query()
def voice_sentences(c: Corpus) -> DataFrame:
    v = V.voice(c.notes)
    return v.select("path", *[F.round(f"voice.{k}", 6).alias(k) for k in ("mean_sentence_length", "sentence_length_variance", "hedging_ratio", "question_density")], "voice.orientation")


@query("SELECT path FROM notes ORDER BY modified, path LIMIT 10", "notes")
def old_notes(c: Corpus) -> DataFrame:
    return c.notes.orderBy("modified", "path").limit(10).select("path")


@query("SELECT path FROM notes ORDER BY modified DESC, path LIMIT 10", "notes")
def recent_notes(c: Corpus) -> DataFrame:
    return c.notes.orderBy(F.desc("modified"), "path").limit(10).select("path")


@query("SELECT path FROM notes ORDER BY md5(concat('20240701:notes:', path)), path LIMIT 7", "notes")
def sample_md5(c: Corpus) -> DataFrame:
    return L.sampled(c.notes, "path", 7, "20240701:notes").select("path")


@query("SELECT path FROM own", "own")
def notes_outside_journal(c: Corpus) -> DataFrame:
    return c.own_notes.select("path")


@query("SELECT strftime(created, '%Y-%m-%d') AS day, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM notes GROUP BY created HAVING count(*) >= 2", "notes")
def notes_by_day(c: Corpus) -> DataFrame:
    g = c.notes.groupBy(F.date_format("created", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("p"))
    return g.where("n >= 2").select("day", "n", F.array_join("p", "|").alias("paths"))


@query("SELECT path, CAST(2024 - year(created) AS BIGINT) AS years FROM notes WHERE month(created) = 7 AND day(created) = 1 AND year(created) < 2024", "notes")
def on_this_day(c: Corpus) -> DataFrame:
    d = F.col("created")
    return c.notes.where((F.month(d) == 7) & (F.dayofmonth(d) == 1) & (F.year(d) < 2024)).select("path", (2024 - F.year(d)).cast("bigint").alias("years"))


@query("SELECT path, CAST(k AS BIGINT) AS years FROM own, (VALUES (1), (2), (3)) AS t(k) WHERE abs(created - CAST(DATE '2024-07-01' - to_years(CAST(k AS INT)) AS DATE)) <= 7", "own")
def anniversary_window(c: Corpus) -> DataFrame:
    years = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    d = c.own_notes.select("path", F.col("created").cast("date").alias("day"), years.alias("years"))
    return d.where(F.abs(F.datediff("day", F.add_months(F.lit(SESSION).cast("date"), -12 * F.col("years")))) <= 7).select("path", F.col("years").cast("bigint").alias("years"))


@query("SELECT CASE WHEN month(created) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(created) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(created) BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END AS season, count(*) AS n FROM notes WHERE contains(lower(concat(content, title)), 'research') GROUP BY 1", "notes")
def season_counts(c: Corpus) -> DataFrame:
    return c.notes.where(F.contains(F.lower(F.concat("content", "title")), F.lit("research"))).groupBy(V.season(F.col("created")).alias("season")).agg(F.count("*").alias("n"))


@query("SELECT season, tag, n, round(n / t, 6) AS share FROM (SELECT season, tag, count(*) AS n, sum(count(*)) OVER (PARTITION BY tag) AS t FROM (SELECT CASE WHEN month(created) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(created) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(created) BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END AS season, tag FROM notes JOIN tags ON path = note_path) GROUP BY season, tag) WHERE n >= 5", "notes", "tags")
def season_tag_share(c: Corpus) -> DataFrame:
    d = c.notes.select(V.season(F.col("created")).alias("season"), F.explode("tags").alias("tag")).groupBy("season", "tag").agg(F.count("*").alias("n"))
    t = d.groupBy("tag").agg(F.sum("n").alias("t"))
    return d.where("n >= 5").join(t, "tag").select("season", "tag", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("SELECT path, CAST(least((row_number() OVER (ORDER BY created, path) - 1) // greatest(1, (SELECT count(*) FROM notes) // 10), 9) AS INT) AS period FROM notes", "notes")
def deciles(c: Corpus) -> DataFrame:
    from driftwell.operators.sessions import decile_periods

    return decile_periods(c.notes)


@query("SELECT path, CAST((DATE '2024-07-01' - created) // 90 AS INT) AS bin FROM notes WHERE DATE '2024-07-01' - created < 720", "notes")
def quarter_bins(c: Corpus) -> DataFrame:
    from driftwell.operators.sessions import quarter_bins as bins

    return bins(c.notes, SESSION)


def suggestions(c: Corpus) -> DataFrame:
    """Rows to filter: a text with two references for each document, some bad."""
    ref = F.when(F.col("doc_id") % 7 == 0, F.lit("Doc none")).otherwise(F.concat(F.lit("Doc "), (F.col("doc_id") * 3 % 400).cast("string")))
    text = F.when(F.col("doc_id") % 9 == 0, "short").otherwise(F.concat(F.lit("What links this to topic "), (F.col("doc_id") % 300).cast("string"), F.lit("?")))
    return c.table("documents").select(F.col("doc_id").alias("ord"), text.alias("text"), F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), ref)).alias("notes"), F.lit("demo").alias("query_id"))


SUGGESTED = "s AS (SELECT doc_id AS ord, CASE WHEN doc_id % 9 = 0 THEN 'short' ELSE concat('What links this to topic ', doc_id % 300, '?') END AS text, CASE WHEN doc_id % 11 = 0 THEN [] ELSE [concat('Doc ', doc_id), CASE WHEN doc_id % 7 = 0 THEN 'Doc none' ELSE concat('Doc ', doc_id * 3 % 400) END] END AS refs FROM documents) ;; "


@query(SUGGESTED + "SELECT ord, text FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(s.refs) AS ref) u WHERE u.ref NOT IN (SELECT title FROM own))", "own")
def boundary_filter(c: Corpus) -> DataFrame:
    return S.boundary(suggestions(c), c.notes, ("session journal/",)).select("ord", "text")


@query(SUGGESTED + "SELECT min(ord) AS ord, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS k FROM s WHERE length(text) BETWEEN 10 AND 2000) WHERE k = 1 AND len(refs) > 0 GROUP BY text", "own")
def quality_filter(c: Corpus) -> DataFrame:
    return S.quality(suggestions(c)).select("ord", "text")


@query("SELECT item_id AS ord, text FROM benchmark WHERE text NOT IN (SELECT text FROM history WHERE session_date > DATE '2024-06-21')", "history")
def novelty_text(c: Corpus) -> DataFrame:
    s = c.table("benchmark").select(F.col("item_id").alias("ord"), "text")
    return S.novelty_text(s, c.history, SESSION, S.Limits(novelty_days=10)).select("ord", "text")


@query(SUGGESTED + "SELECT ord, text FROM s ORDER BY md5(concat('20240701:', ord)), CAST(ord AS VARCHAR) LIMIT 5", "own")
def select_suggestions(c: Corpus) -> DataFrame:
    return S.select(suggestions(c)).select("ord", "text")


@query("SELECT CAST(count(*) AS BIGINT) AS notes, CAST(count(*) FILTER (path LIKE 'session journal/%') AS BIGINT) AS journal, round(avg(DATE '2024-07-01' - created), 6) AS mean_age, strftime(max(modified), '%Y-%m-%d') AS newest, strftime(min(created), '%Y-%m-%d') AS oldest FROM notes", "notes")
def note_stats(c: Corpus) -> DataFrame:
    age = F.datediff(F.lit(SESSION).cast("date"), F.col("created").cast("date"))
    return c.notes.agg(F.count("*").alias("notes"), F.count_if(F.col("path").startswith("session journal/")).alias("journal"), F.round(F.avg(age), 6).alias("mean_age"), F.date_format(F.max("modified"), "yyyy-MM-dd").alias("newest"), F.date_format(F.min("created"), "yyyy-MM-dd").alias("oldest"))


@query("SELECT count(DISTINCT tag) AS tags, count(*) AS uses, round(count(*) / (SELECT count(*) FROM notes), 6) AS per_note FROM tags", "notes", "tags")
def tag_stats(c: Corpus) -> DataFrame:
    n = F.broadcast(c.notes.agg(F.count("*").alias("n")))
    return c.tags.agg(F.countDistinct("tag").alias("tags"), F.count("*").alias("uses")).join(n).select("tags", "uses", F.round(F.col("uses") / F.col("n"), 6).alias("per_note"))


@query("SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 10", "tags")
def top_tags(c: Corpus) -> DataFrame:
    return c.tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query()
def questions(c: Corpus) -> DataFrame:
    return X.questions(c.notes).select("path", F.col("position").cast("bigint").alias("position"), "item")


@query()
def todos(c: Corpus) -> DataFrame:
    return X.todos(c.notes).select("path", "item")


@query()
def quotes(c: Corpus) -> DataFrame:
    return X.quotes(c.notes).select("path", "item")


@query()
def definitions(c: Corpus) -> DataFrame:
    return X.definitions(c.notes).select("path", F.col("position").cast("bigint").alias("position"), "item")


@query()
def claims(c: Corpus) -> DataFrame:
    return X.claims(c.notes).select("path", F.col("position").cast("bigint").alias("position"), "item")


@query()
def hypotheses(c: Corpus) -> DataFrame:
    return X.hypotheses(c.notes).select("path", F.col("position").cast("bigint").alias("position"), "item")


@query(r"g AS (SELECT path, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) AS phrase FROM (SELECT path, list_filter(string_split_regex(lower(content), '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS w FROM own) WHERE len(w) >= 3) ;; SELECT phrase, count(*) AS n, count(DISTINCT path) AS notes FROM g WHERE length(phrase) > 15 AND NOT (contains(phrase, 'the ') OR contains(phrase, ' of ') OR contains(phrase, ' and ') OR contains(phrase, ' to ') OR contains(phrase, ' in ') OR contains(phrase, ' is ') OR contains(phrase, ' a ')) GROUP BY phrase HAVING count(*) >= 3", "own")
def ngram_phrases(c: Corpus) -> DataFrame:
    return X.phrases(c.own_notes)
