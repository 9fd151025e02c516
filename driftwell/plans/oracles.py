"""DuckDB statements of queries whose SQL is long: extraction, voice, evolution, keyword and graph queries."""

from __future__ import annotations

from driftwell.functions import voice as V
from driftwell.operators import clusters as C
from driftwell.operators import extraction as X
from driftwell.plans import discovery as D
from driftwell.plans.registry import ORACLES, duck

BLANK = "concat(' ', chr(9), chr(10), chr(13))"
DAY = "DATE '2024-07-01'"
CODE = "code AS (SELECT path, regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g') AS t FROM notes)"


def _quoted(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(t, '{pattern}', {group})"


def _items(arrays: str, low: int, high: int, more: str = "") -> str:
    """Items of the arrays in order, trimmed, of a length, with a letter; the first of equal ones."""
    y = f"{CODE}, x AS (SELECT path, list_concat({arrays}) AS xs FROM code), y AS (SELECT path, trim(unnest(xs), {BLANK}) AS item, generate_subscripts(xs, 1) - 1 AS position FROM x)"
    return f"{y} ;; SELECT path, CAST(min(position) AS BIGINT) AS position, arg_min(item, position) AS item FROM y WHERE length(item) BETWEEN {low} AND {high} AND regexp_matches(item, '[a-zA-Z]'){more} GROUP BY path, lower(item)"


def _harvest(sql: str) -> str:
    head, _, last = sql.partition(";;")
    return f"{head};; SELECT path AS a, item FROM ({last})"


_TERMS = [f"list_transform(list_zip({_all(p, 1)}, {_all(p, 2)}), lambda z: concat(z[1], '{j}', z[2]))" for p, j in zip(X.DEFINITIONS, X.JOINTS, strict=True)]
EXTRACTED = {
    "question": _items(f"{_all(X.QUESTIONS[0])}, {_all(X.QUESTIONS[1], 1)}", 10, 500),
    "definition": _items(", ".join(_TERMS), 15, 300, r" AND NOT regexp_matches(item, '^(?:This|That|It|There)\b')"),
    "claim": _items(", ".join(_all(p) for p in X.CLAIMS), 20, 300),
    "hypothesis": _items(", ".join(_all(p) for p in X.HYPOTHESES), 20, 300),
    "todo": f"{CODE}, y AS (SELECT path, upper(unnest({_all(X.TODO, 1)})) AS m, trim(unnest({_all(X.TODO, 2)})) AS item, generate_subscripts({_all(X.TODO, 1)}, 1) AS position FROM code) ;; SELECT path, concat(arg_min(m, position), ': ', arg_min(item, position)) AS item FROM y WHERE length(item) BETWEEN 5 AND 300 AND regexp_matches(item, '[a-zA-Z]') AND lower(item) NOT IN ({_quoted(X.PLACEHOLDERS)}) GROUP BY path, lower(item)",
    "quote": CODE + r", ls AS (SELECT path, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM code), q AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g, trim(regexp_replace(s, '^[ \t]*>[ \t]*', '')) AS said FROM ls WHERE starts_with(trim(s), '>')), i AS (SELECT path, g, coalesce(string_agg(said, ' ' ORDER BY line) FILTER (said <> ''), '') AS item FROM q GROUP BY path, g) ;; SELECT path, CASE WHEN length(item) > 500 THEN concat(substr(item, 1, 497), '...') ELSE item END AS item FROM i WHERE length(item) >= 10 AND length(regexp_replace(item, '[^a-zA-Z]', '', 'g')) >= 10",
}
WORD = r"[\p{L}\p{M}\p{N}_]+(?:''[\p{L}\p{M}\p{N}_]+)*"
_PAST = f"(x IN ({_quoted(V.PAST_LIST)}) OR (x LIKE '%ed' AND length(x) > 3))"
_NOW = f"(x IN ({_quoted(V.PRESENT)}) OR (x LIKE '%ing' AND length(x) > 4))"


def _voice(notes: str) -> str:
    """``voice`` (path, n, past, future, present, one, two, share of one, hedging, questions, mean, variance, orientation)."""
    count = lambda words: f"len(list_filter(w, lambda x: x IN ({_quoted(words)})))"
    return (
        r"vt AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'), '(?:https?://|www\.)\S+', ' ', 'g') AS t FROM " + notes + "), "
        rf"vw AS (SELECT path, t, regexp_extract_all(lower(t), '{WORD}') AS w, list_filter(list_transform(list_filter(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', concat('\1', chr(1)), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda s: trim(s, {BLANK}) <> ''), lambda s: CAST(len(regexp_extract_all(lower(s), '{WORD}')) AS DOUBLE)), lambda k: k > 0) AS s FROM vt), "
        rf"vc AS (SELECT path, len(w) AS n, {count(V.SINGULAR)} AS one, {count(V.PLURAL)} AS two, len(list_filter(w, lambda x: {_PAST})) AS p, len(list_filter(w, lambda x: NOT {_PAST} AND x IN ({_quoted(V.FUTURE)}))) + len(regexp_extract_all(t, '(?i)\bgoing to\b|\bgonna\b')) AS f, len(list_filter(w, lambda x: NOT {_PAST} AND x NOT IN ({_quoted(V.FUTURE)}) AND {_NOW})) AS r, "
        rf"len(s) AS ns, CASE WHEN len(s) > 0 THEN list_avg(s) ELSE 0 END AS mean, CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda k: k * k)) / len(s) ELSE 0 END AS squares, len(regexp_extract_all(lower(t), '\b(?:{'|'.join(V.HEDGE_LIST)})\b')) AS h, len(regexp_extract_all(t, '\?')) AS q FROM vw), "
        "vr AS (SELECT *, CASE WHEN p + f + r > 0 THEN p / (p + f + r) ELSE 0 END AS past, CASE WHEN p + f + r > 0 THEN f / (p + f + r) ELSE 0 END AS future, CASE WHEN p + f + r > 0 THEN r / (p + f + r) ELSE 0 END AS present FROM vc), "
        "voice AS (SELECT path, CASE WHEN one + two > 0 THEN one / (one + two) ELSE 0.5 END AS self_focus_ratio, CASE WHEN n > 0 THEN 100 * two / n ELSE 0 END AS plural, CASE WHEN ns > 0 THEN h / ns ELSE 0 END AS hedging_ratio, CASE WHEN n > 0 THEN 100 * q / n ELSE 0 END AS question_density, mean AS mean_sentence_length, "
        "greatest(0, squares - mean * mean) AS sentence_length_variance, CASE WHEN past > 0.6 THEN 'past' WHEN future > 0.4 THEN 'future' WHEN present > 0.7 THEN 'present' ELSE 'mixed' END AS orientation FROM vr)"
    )


def _hits(words: tuple[str, ...], text: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


LOW = "low AS (SELECT path, lower(content) AS t, title, content FROM notes)"
NEAR = "near AS (SELECT a, b, greatest(sim, 0) AS sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM cross_)"
TREND = "t AS (SELECT p.a, p.b, x.date, list_cosine_similarity(x.e, y.e) AS s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.date) AS k, count(*) OVER (PARTITION BY p.a, p.b) AS n FROM p JOIN sv x ON x.path = p.a JOIN sv y ON y.path = p.b AND y.date = x.date), tr AS (SELECT a, b, count(*) AS n, avg(s) FILTER (k > n // 2) - avg(s) FILTER (k <= n // 2) AS trend FROM t GROUP BY a, b)"
UNLINKED = "NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = {0} AND e.b = {1})"


def _meanvec(rows: str, key: str) -> str:
    """(key, m): the mean vector of rows (key, e)."""
    return f"(SELECT {key}, list(x ORDER BY i) AS m FROM (SELECT {key}, i, avg(x) AS x FROM (SELECT {key}, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {rows}) GROUP BY {key}, i) GROUP BY {key})"


UNIT = "u AS (SELECT path, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"
KIND = r"""CASE WHEN task > 0.2 THEN 'task' WHEN fenced >= 2 THEN 'code' WHEN listed > 0.3 THEN 'list' WHEN marked < 0.1 THEN 'prose' ELSE 'mixed' END"""

_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    **{name: (EXTRACTED[kind], ("notes",)) for name, kind in {"questions": "question", "definitions": "definition", "claims": "claim", "hypotheses": "hypothesis", "todos": "todo", "quotes": "quote"}.items()},
    **{f"{kind}_harvester": (_harvest(sql), ("notes",)) for kind, sql in EXTRACTED.items()},
    "shortest_path": (
        "p AS (SELECT 'doc/5.md' AS path, 0 AS hop UNION SELECT d.b, p.hop + 1 FROM p JOIN directed d ON d.a = p.path WHERE p.hop < 25), dist AS (SELECT path, min(hop) AS hop FROM p GROUP BY path), pre AS (SELECT d.b AS path, min(d.a) AS before FROM directed d JOIN dist x ON x.path = d.a JOIN dist y ON y.path = d.b WHERE y.hop = x.hop + 1 GROUP BY d.b), "
        "w AS (SELECT path, hop FROM dist WHERE path = 'doc/10.md' UNION ALL SELECT pre.before, w.hop - 1 FROM w JOIN pre ON pre.path = w.path WHERE w.hop > 0) ;; SELECT CAST(hop AS BIGINT) AS position, path FROM w",
        ("directed",),
    ),
    "largest_component": ("r AS (SELECT a AS path, a AS root FROM twoway UNION SELECT e.b, r.root FROM r JOIN twoway e ON e.a = r.path WHERE r.root < e.b), m AS (SELECT n.path, coalesce(min(least(r.root, n.path)), n.path) AS component FROM notes n LEFT JOIN r ON r.path = n.path GROUP BY n.path) ;; SELECT component, count(*) AS size FROM m GROUP BY component ORDER BY size DESC, component LIMIT 1", ("notes", "twoway")),
    "voice_sentences": (_voice("notes") + " ;; SELECT path, round(mean_sentence_length, 6) AS mean_sentence_length, round(sentence_length_variance, 6) AS sentence_length_variance, round(hedging_ratio, 6) AS hedging_ratio, round(question_density, 6) AS question_density, orientation FROM voice", ("notes",)),
    "self_and_other": (_voice("own") + " ;; SELECT path AS a, CASE WHEN self_focus_ratio > 0.85 THEN 'self' ELSE 'other' END AS side FROM voice WHERE self_focus_ratio > 0.85 OR plural > 2.0", ("own",)),
    "sentence_variance": (_voice("own") + ", d AS (SELECT * FROM voice WHERE mean_sentence_length > 5), s AS (SELECT avg(sentence_length_variance) AS m, stddev_pop(sentence_length_variance) AS s, count(*) AS n FROM d) ;; SELECT path AS a, round(sentence_length_variance, 6) AS sentence_length_variance FROM d, s WHERE n >= 10 AND sentence_length_variance > m + 2 * s ORDER BY round(sentence_length_variance, 9) DESC, path LIMIT 1", ("own",)),
    "uncertainty_mapper": (_voice("own") + " ;; SELECT path AS a, round(hedging_ratio, 6) AS hedging_ratio FROM voice WHERE hedging_ratio > 0.3 ORDER BY round(hedging_ratio, 9) DESC, path LIMIT 1", ("own",)),
    "voice_absence": (_voice("own") + ", d AS (SELECT count(*) AS n, avg(CAST(orientation = 'future' AS INT)) AS future, avg(CAST(orientation = 'past' AS INT)) AS past, avg(CAST(plural > 1.0 AS INT)) AS we, avg(CAST(question_density > 0.5 AS INT)) AS questions FROM voice), k AS (SELECT n, unnest(['future', 'past', 'we', 'questions']) AS kind, unnest([future, past, we, questions]) AS share, unnest([0.05, 0.05, 0.05, 0.1]) AS least FROM d) ;; SELECT kind, round(share, 6) AS share FROM k WHERE n >= 20 AND share < least", ("own",)),
    "temporal_voice": (
        _voice("own") + ", ps AS (SELECT path FROM voice WHERE orientation = 'past' ORDER BY md5(concat('2024-07-01:', path)), path LIMIT 5), fs AS (SELECT path FROM voice WHERE orientation = 'future' ORDER BY md5(concat('2024-07-01:', path)), path LIMIT 20), k AS (SELECT c.a, c.b, c.sim, row_number() OVER (PARTITION BY c.a ORDER BY round(c.sim, 12) DESC, c.b) AS r FROM cross_ c JOIN ps ON ps.path = c.a JOIN fs ON fs.path = c.b) ;; SELECT a, b, round(sim, 6) AS sim FROM k WHERE r = 1",
        ("own", "cross_"),
    ),
    "metadata_outlier_detector": ("s AS (SELECT avg(word_count) AS m, stddev_pop(word_count) AS s, quantile_cont(word_count, 0.5) AS median FROM meta) ;; SELECT path AS a, CAST(word_count AS BIGINT) AS word_count, median FROM meta, s WHERE s.s > 1e-10 AND abs((word_count - m) / s.s) > 2", ("meta",)),
    "structure_diversity_checker": (
        r"ls AS (SELECT path, modified, content, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS l FROM notes), sh AS (SELECT path, modified, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*] \[[ xX]\]'))) / greatest(len(l), 1) AS task, len(regexp_extract_all(content, '(?m)^```')) AS fenced, len(list_filter(l, lambda x: regexp_matches(x, '^\s*([-*+]|\d+\.) '))) / greatest(len(l), 1) AS listed, len(list_filter(l, lambda x: regexp_matches(x, '^\s*([-*+#>]|\d+\.)'))) / greatest(len(l), 1) AS marked FROM ls), "
        f"k AS (SELECT path, modified, {KIND} AS kind FROM sh), top AS (SELECT kind AS usual, count(*) AS n FROM (SELECT * FROM k ORDER BY modified DESC, path LIMIT 8) GROUP BY kind ORDER BY n DESC, kind LIMIT 1) ;; SELECT path AS a, kind, usual FROM k, top WHERE n >= 0.7 * 8 AND kind <> usual",
        ("notes",),
    ),
    "burst_evolution": ("d AS (SELECT strftime(o.created, '%Y-%m-%d') AS day, 1 - list_cosine_similarity(f, l) AS drift FROM own o JOIN ends ON ends.path = o.path WHERE ends.n >= 2), g AS (SELECT day, count(*) AS n, round(avg(drift), 6) AS drift FROM d GROUP BY day HAVING count(*) >= 3) ;; SELECT day, n, drift, CASE WHEN drift > 0.45 THEN 'transformed' WHEN drift < 0.15 THEN 'stable' ELSE 'evolving' END AS label FROM g", ("own", "ends")),
    "temporal_clustering": (f"b AS (SELECT path, CAST(({DAY} - created) // 90 AS INT) AS bin FROM own WHERE {DAY} - created >= 0 AND {DAY} - created < 720), w AS (SELECT b.bin, v.path, v.e FROM v JOIN b ON b.path = v.path), c AS (SELECT bin, count(*) AS n FROM w GROUP BY bin HAVING count(*) >= 5), s AS (SELECT x.bin, avg(list_cosine_similarity(x.e, y.e)) AS sim FROM w x JOIN w y ON x.bin = y.bin AND x.path < y.path GROUP BY x.bin) ;; SELECT c.bin, c.n, round(sim, 6) AS sim FROM c JOIN s ON s.bin = c.bin WHERE round(sim, 6) > 0.5", ("own", "v")),
    "seasonal_topic_analysis": ("w AS (SELECT v.path, o.created, v.e FROM v JOIN own o ON o.path = v.path WHERE month(o.created) BETWEEN 6 AND 8), f AS (SELECT * FROM w ORDER BY created, path LIMIT 1) ;; SELECT w.path AS a, round(list_cosine_similarity(w.e, f.e), 6) AS sim FROM w, f WHERE w.path <> f.path AND list_cosine_similarity(w.e, f.e) >= 0.6", ("own", "v")),
    "anachronism_detector": (
        f"w AS (SELECT v.path, v.e, {DAY} - n.created AS age FROM v JOIN notes n ON n.path = v.path), o AS (SELECT path, e FROM w WHERE age > 365 ORDER BY md5(concat('old:', path)), path LIMIT 10), c AS (SELECT path, e FROM w WHERE age < 90 ORDER BY md5(concat('new:', path)), path LIMIT 10), x AS (SELECT w.path, max(list_cosine_similarity(w.e, o.e)) AS old FROM w, o WHERE w.age < 90 GROUP BY w.path), y AS (SELECT w.path, avg(list_cosine_similarity(w.e, c.e)) AS now FROM w, c WHERE w.age < 90 AND w.path NOT IN (SELECT path FROM c) GROUP BY w.path) ;; SELECT x.path AS a, round(old, 6) AS old, round(now, 6) AS now FROM x JOIN y ON x.path = y.path WHERE old > now + 0.15",
        ("notes", "v"),
    ),
    "blind_spot_detector": (
        "r AS (SELECT path FROM (SELECT path FROM own ORDER BY modified DESC, path LIMIT 10) ORDER BY md5(concat('2024-07-01:', path)), path LIMIT 5), x AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12), b) AS k FROM cross_ WHERE a IN (SELECT path FROM r)), m AS (SELECT path, days_since_modified, (SELECT count(*) FROM backlinks k WHERE k.path = y.path) AS back FROM meta y) ;; SELECT x.a, x.b, CAST(days_since_modified AS INT) AS days_since_modified, CAST(back AS BIGINT) AS in_links FROM x JOIN m ON m.path = x.b WHERE k = 1 AND (days_since_modified > 180 OR back = 0)",
        ("own", "cross_", "meta", "backlinks"),
    ),
    "load_bearing_bridge": ("h AS (SELECT x.a AS bridge FROM sims s JOIN twoway x ON x.b = s.a JOIN twoway y ON y.b = s.b AND y.a = x.a WHERE s.sim >= 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = s.a AND e.b = s.b)) ;; SELECT bridge AS a, count(*) AS pairs FROM h GROUP BY bridge", ("sims", "twoway", "edges")),
    "density_inversion": (
        "k AS (SELECT t.a, v.path, v.e FROM twoway t JOIN v ON v.path = t.b), s AS (SELECT x.a AS path, avg(greatest(0, list_cosine_similarity(x.e, y.e))) AS alike FROM k x JOIN k y ON x.a = y.a AND x.path < y.path WHERE x.a IN (SELECT a FROM k GROUP BY a HAVING count(*) >= 3) GROUP BY x.a), d AS (SELECT t.path, coalesce(c.k, 0) / (t.d * (t.d - 1) / 2) AS density FROM (SELECT a AS path, count(*) AS d FROM twoway GROUP BY a HAVING count(*) >= 3) t LEFT JOIN (SELECT x.a AS path, count(*) AS k FROM twoway x JOIN twoway y ON x.a = y.a JOIN edges e ON e.a = x.b AND e.b = y.b GROUP BY x.a) c ON c.path = t.path) "
        ";; SELECT d.path AS a, round(density, 6) AS density, round(alike, 6) AS alike FROM d JOIN s ON s.path = d.path WHERE (density > 0.6 AND alike < 0.3) OR (density < 0.3 AND alike > 0.6)",
        ("twoway", "edges", "v"),
    ),
    "path_length_anomaly": (
        "s AS (SELECT a, b, sim FROM sims WHERE sim >= 0.35), two AS (SELECT DISTINCT x.a, y.b FROM twoway x JOIN twoway y ON y.a = x.b), near3 AS (SELECT DISTINCT t.a, z.b FROM two t JOIN twoway z ON z.a = t.b UNION SELECT a, b FROM two UNION SELECT a, b FROM twoway) ;; SELECT s.a, s.b, round(s.sim, 6) AS sim FROM s ANTI JOIN near3 n ON n.a = s.a AND n.b = s.b",
        ("sims", "twoway"),
    ),
    "attention_shift": (
        "p AS (SELECT x.path AS a, y.path AS b, list_cosine_similarity(x.e, y.e) AS sim FROM sv x JOIN sv y ON x.session_id = 5 AND y.session_id = 5 AND x.path <> y.path), b0 AS (SELECT a AS path, list(b ORDER BY b) AS s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS k FROM p) WHERE k <= 10 GROUP BY a), b1 AS (SELECT path, list(neighbour ORDER BY neighbour) AS s FROM knn GROUP BY path), "
        "d AS (SELECT path, 1 - len(list_intersect(b0.s, b1.s)) / len(list_distinct(list_concat(b0.s, b1.s))) AS churn, list_filter(b1.s, lambda x: NOT list_contains(b0.s, x)) AS arrived, list_filter(b0.s, lambda x: NOT list_contains(b1.s, x)) AS departed FROM b0 JOIN b1 USING (path)) ;; SELECT path AS a, arrived[1] AS b FROM d WHERE churn > 0.6 AND len(arrived) > 0 AND len(departed) > 0 ORDER BY round(churn, 9) DESC, path LIMIT 1",
        ("sv", "knn"),
    ),
    "antithesis_generator": (f"{LOW}, {NEAR}, x AS (SELECT path AS a, {_hits(D.CLAIMS)} AS n FROM low), y AS (SELECT path AS b, {_hits(D.NEGATIONS)} + CASE WHEN regexp_matches(lower(title), 'anti|contra') THEN 2 ELSE 0 END AS n FROM low), d AS (SELECT near.a, arg_min(near.b, near.rank) AS b FROM near JOIN y ON y.b = near.b WHERE y.n >= 2 AND near.rank <= 20 GROUP BY near.a) ;; SELECT x.a, d.b, CAST(x.n AS INT) AS claims FROM x LEFT JOIN d ON d.a = x.a WHERE x.n >= 3", ("notes", "cross_")),
    "assumption_challenger": (
        f"{LOW}, {NEAR}, x AS (SELECT path AS a FROM low WHERE {_hits(D.CERTAIN)} >= 2), y AS (SELECT path AS b FROM low WHERE {_hits(D.DOUBTFUL)} >= 2), d AS (SELECT near.a, arg_min(near.b, near.rank) AS b FROM near JOIN x ON x.a = near.a JOIN y ON y.b = near.b WHERE near.rank <= 10 GROUP BY near.a) ;; SELECT a, b, 'contrast' AS kind FROM d UNION ALL SELECT path, NULL, 'causal' FROM low WHERE {_hits(D.CAUSAL)} >= 3 AND (SELECT count(*) FROM links l WHERE l.source_path = low.path) < 2",
        ("notes", "cross_", "links"),
    ),
    "columbo": (f"{LOW}, {NEAR}, k AS (SELECT path, {_hits(D.POSITIVE)} AS pos, {_hits(D.NEGATIVE)} AS neg, {_hits(D.ASSERTIONS)} AS says FROM low) ;; SELECT near.a, near.b FROM near JOIN k x ON x.path = near.a JOIN k y ON y.path = near.b WHERE near.rank <= 5 AND near.sim > 0.65 AND x.says > 0 AND ((x.pos > 2 AND y.neg > 2) OR (x.neg > 2 AND y.pos > 2))", ("notes", "cross_")),
    "scale_shifter": (f"{LOW}, {NEAR}, k AS (SELECT path, {_hits(D.ABSTRACT)} AS ab, {_hits(D.CONCRETE)} AS co FROM low) ;; SELECT near.a, near.b, CASE WHEN x.ab >= 3 AND x.co <= 1 AND y.co >= 2 THEN 'in' ELSE 'out' END AS way FROM near JOIN k x ON x.path = near.a JOIN k y ON y.path = near.b WHERE near.rank <= 10 AND ((x.ab >= 3 AND x.co <= 1 AND y.co >= 2) OR (x.co >= 3 AND x.ab <= 1 AND y.ab >= 2))", ("notes", "cross_")),
    "pattern_finder": (
        r"w AS (SELECT path, list_filter(string_split_regex(lower(content), '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS w FROM own), g0 AS (SELECT path, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) AS phrase FROM w WHERE len(w) >= 3), g AS (SELECT phrase, path, count(*) AS k FROM g0 WHERE length(phrase) > 15"
        + "".join(f" AND NOT contains(phrase, '{x}')" for x in X.COMMON)
        + " GROUP BY phrase, path), o AS (SELECT phrase FROM g GROUP BY phrase HAVING sum(k) >= 3), h AS (SELECT g.* FROM g JOIN o ON o.phrase = g.phrase), tied AS (SELECT DISTINCT x.phrase, x.path FROM h x JOIN twoway t ON t.a = x.path JOIN h y ON y.phrase = x.phrase AND y.path = t.b) ;; SELECT h.phrase, CAST(sum(k) AS BIGINT) AS n, count(*) AS notes FROM h ANTI JOIN tied ON tied.phrase = h.phrase AND tied.path = h.path GROUP BY h.phrase HAVING sum(k) >= 3",
        ("own", "twoway"),
    ),
    "pattern_groups": (f"{NEAR}, g AS (SELECT a, list(b ORDER BY b) AS m FROM near WHERE rank <= 4 AND sim > 0.8 GROUP BY a HAVING count(*) >= 2), m AS (SELECT a, unnest(list_concat([a], m)) AS x FROM g), tied AS (SELECT DISTINCT p.a FROM m p JOIN m q ON p.a = q.a JOIN edges e ON e.a = p.x AND e.b = q.x) ;; SELECT g.a, array_to_string(list_concat([g.a], g.m), '|') AS members FROM g ANTI JOIN tied ON tied.a = g.a", ("cross_", "edges")),
    "convergent_evolution": (f"{NEAR}, p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM near WHERE rank <= 10 AND {UNLINKED.format('least(near.a, near.b)', 'greatest(near.a, near.b)')}), {TREND} ;; SELECT a, b, round(trend, 6) AS trend FROM tr WHERE n >= 3 AND trend > 0.15", ("cross_", "edges", "sv")),
    "divergent_evolution": (f"p AS (SELECT DISTINCT path AS a, target_path AS b FROM outgoing WHERE position < 5), {TREND} ;; SELECT a, b, round(trend, 6) AS trend FROM tr WHERE n >= 3 AND trend < -0.15", ("outgoing", "sv")),
    "cyclical_thinking": ("x AS (SELECT path, date, list_cosine_similarity(e, first(e) OVER (PARTITION BY path ORDER BY date)) > 0.7 AS s FROM sv), y AS (SELECT path, s AND NOT lag(s) OVER (PARTITION BY path ORDER BY date) AS b FROM x) ;; SELECT path AS a, count(*) FILTER (b) AS cycles FROM y GROUP BY path HAVING count(*) FILTER (b) >= 2 AND count(*) >= 5", ("sv",)),
    "drift_velocity_anomaly": (f"{NEAR}, w AS (SELECT path, date, 1 - list_cosine_similarity(e, l) AS rate FROM (SELECT *, lead(e, 2) OVER (PARTITION BY path ORDER BY date) AS l FROM sv) WHERE l IS NOT NULL), g AS (SELECT path, arg_max(rate, date) - arg_min(rate, date) AS gain FROM w GROUP BY path), n AS (SELECT a, arg_min(b, rank) AS b FROM near WHERE rank <= 5 AND sim > 0.5 GROUP BY a) ;; SELECT g.path AS a, n.b, round(gain, 6) AS gain FROM g JOIN n ON n.a = g.path WHERE gain > 0.1", ("cross_", "sv")),
    "hermeneutic_instability": (f"r AS (SELECT * FROM sv WHERE session_id >= 2), m AS {_meanvec('r', 'path')}, d AS (SELECT r.path, count(*) AS n, avg(list_distance(r.e, m.m)) AS i FROM r JOIN m ON m.path = r.path GROUP BY r.path) ;; SELECT d.path AS a, round(i, 6) AS instability FROM d JOIN notes n ON n.path = d.path WHERE d.n >= 3 AND i > 0.2 AND {DAY} - n.modified > 60", ("sv", "notes")),
    "vocabulary_expansion": (
        f"m AS {_meanvec('sv', 'date')}, s AS (SELECT sv.date, count(*) AS n, stddev_pop(list_distance(sv.e, m.m)) AS c FROM sv JOIN m ON m.date = sv.date GROUP BY sv.date HAVING count(*) >= 10), r AS (SELECT c, row_number() OVER (ORDER BY date) AS k, row_number() OVER (ORDER BY date DESC) AS b FROM s), d AS (SELECT count(*) AS n, avg(c) FILTER (b <= 2) / avg(c) FILTER (k <= 2) AS ratio FROM r) ;; SELECT n, round(ratio, 6) AS ratio FROM d WHERE n >= 3 AND (ratio < 0.8 OR ratio > 1.2)",
        ("sv",),
    ),
    "silhouette": (
        "p AS (SELECT x.path, x.label AS own, y.label AS other, sum(list_distance(x.e, y.e)) AS s, count(*) AS n FROM v x, v y GROUP BY x.path, x.label, y.label), a AS (SELECT path, s / greatest(n - 1, 1) AS a, n FROM p WHERE own = other), b AS (SELECT path, min(s / n) AS b FROM p WHERE own <> other GROUP BY path) ;; SELECT round(avg(CASE WHEN a.n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 3) AS silhouette FROM a JOIN b ON a.path = b.path",
        ("v",),
    ),
    "cluster_terms": (
        rf"d AS (SELECT v.label AS cluster, list_filter(regexp_extract_all(lower(concat_ws(' ', n.title, substr(n.content, 1, 200))), '{WORD}'), lambda t: length(t) > 2 AND t NOT IN ({_quoted(C.STOPWORDS)})) AS w FROM v JOIN notes n ON n.path = v.path), t AS (SELECT cluster, term, count(*) AS tf FROM (SELECT cluster, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM d) GROUP BY cluster, term), "
        "f AS (SELECT term, count(*) AS df FROM t GROUP BY term), s AS (SELECT cluster, t.term, tf * (ln((1 + (SELECT count(DISTINCT label) FROM v)) / (1 + df)) + 1) AS score FROM t JOIN f ON f.term = t.term) ;; SELECT cluster, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 8",
        ("v", "notes"),
    ),
    "diversity_filter": (
        "o AS (SELECT vec_id AS ord, e, row_number() OVER (ORDER BY vec_id) AS k FROM v), c AS (SELECT x.k AS a, y.k AS b FROM o x JOIN o y ON x.k < y.k WHERE list_cosine_similarity(x.e, y.e) >= 0.5), near_ AS (SELECT b, list(a) AS before FROM c GROUP BY b), g AS (SELECT 0 AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT g.k + 1, CASE WHEN EXISTS (SELECT 1 FROM near_ n WHERE n.b = g.k + 1 AND len(list_intersect(n.before, g.kept)) > 0) THEN g.kept ELSE list_append(g.kept, g.k + 1) END FROM g WHERE g.k < (SELECT count(*) FROM o)), z AS (SELECT unnest(kept) AS k FROM g WHERE g.k = (SELECT count(*) FROM o)) ;; SELECT o.ord FROM o JOIN z ON z.k = o.k",
        ("v",),
    ),
}
ORACLES.update({name: duck(sql, *names) for name, (sql, names) in _SQL.items()})
