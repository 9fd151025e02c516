"""Known answers on small corpora, differential and property tests."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import markdown as M
from driftwell.functions import voice as V
from driftwell.operators import clusters, extraction, filters, graph, knn, links, sessions
from driftwell.operators.components import connected_components
from driftwell.plans import grammar
from driftwell.sources import sinks, vault

NOTES = {"hub": ["a", "b", "c"], "a": ["b"], "b": [], "c": [], "island1": ["island2"], "island2": ["island1"], "loner": []}


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(f"{k}.md", k.title(), f"text {k}", [(t, None, False, None) for t in v]) for k, v in NOTES.items()]
    n = spark.createDataFrame(rows, "path string, title string, content string, links array<struct<target:string,display_text:string,is_embed:boolean,block_ref:string>>")
    n = n.withColumns({"modified": F.lit("2024-01-01").cast("timestamp"), "is_virtual": F.lit(False), "source_file": F.lit(None).cast("string"), "entry_date": F.lit(None).cast("date")}).cache()
    return n, vault.link_rows(n)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_graph_shapes(linked, spark):
    n, l = linked
    assert paths(links.orphans(n, l)) == ["loner.md"]
    assert paths(links.find_orphans(n, l)) == ["loner.md"]
    assert [(r["path"], r["link_count"]) for r in links.hubs(n, l, 1).collect()] == [("b.md", 2)]
    assert paths(links.backlinks(n, l).where("path = 'b.md'").select(F.col("source_path").alias("path"))) == ["a.md", "hub.md"]
    d = links.outgoing(n, l).select(F.col("path").alias("a"), F.col("target_path").alias("b"))
    assert [r["path"] for r in graph.shortest_path(d, "hub.md", "b.md").orderBy("position").collect()] == ["hub.md", "b.md"]
    assert graph.shortest_path(d, "b.md", "hub.md").count() == 0
    assert [r["path"] for r in graph.shortest_path(d, "b.md", "b.md").collect()] == ["b.md"]
    assert paths(graph.k_hop(d, "hub.md", 2)) == ["a.md", "b.md", "c.md"]
    sizes = sorted(r["size"] for r in graph.component_sizes(n, links.edges(n, l)).collect())
    assert sizes == [1, 2, 4]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_journal_entry_is_named_by_its_stem(spark):
    rows = [("J.md/2025-01-15", "2025-01-15", True, "J.md"), ("J.md", "J", False, None)]
    n = spark.createDataFrame(rows, "path string, title string, is_virtual boolean, source_file string")
    forms = {(r["form"], r["path"]) for r in links.note_forms(n).collect()}
    assert ("J", "J.md/2025-01-15") in forms and ("J", "J.md") in forms
    named = {r["form"]: r["path"] for r in links.resolver(n).collect()}
    assert named["J#2025-01-15"] == "J.md/2025-01-15" and named["J"] == "J.md"


def test_vault_sync(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "one.md").write_text('---\ntitle: "First"\ntags: [x, y]\n---\nSee [[Two|second]] and ![[pic#top]] ^b\n#inline `#no`\n', encoding="utf-8")
    (root / "sub" / "two.md").write_text("# Two\n\n- [ ] open\n- [x] done\n", encoding="utf-8")
    (root / "j.md").write_text("## 2024-01-02\nalpha\n\n## January 3, 2024\nbeta [[Two]]\n## 2024-01-02\ngamma\n## 2024-01-09\n\n", encoding="utf-8")
    notes, n = vault.sync(spark, str(root))
    rows = {r["path"]: r for r in notes.collect()}
    assert n == 3 and sorted(rows) == ["j.md/2024-01-02", "j.md/2024-01-03", "one.md", "sub/two.md"]
    assert rows["one.md"]["title"] == "First" and rows["one.md"]["tags"] == ["inline", "top", "x", "y"]
    assert [(x["target"], x["display_text"], x["is_embed"]) for x in rows["one.md"]["links"]] == [("Two", "second", False), ("pic", None, True)]
    assert rows["j.md/2024-01-02"]["content"] == "alpha\n\ngamma" and rows["j.md/2024-01-03"]["source_file"] == "j.md"
    kept = spark.createDataFrame(notes.collect(), notes.schema)
    (root / "one.md").unlink()
    (root / "sub" / "three.md").write_text("new", encoding="utf-8")
    again, changed = vault.sync(spark, str(root), kept)
    assert changed == 1 and paths(again) == ["j.md/2024-01-02", "j.md/2024-01-03", "sub/three.md", "sub/two.md"]


@pytest.mark.parametrize(("heading", "date"), [("2024-03-15", "2024-03-15"), ("3/5/2024", "2024-03-05"), ("15.3.2024", "2024-03-15"), ("Friday, March 15, 2024", "2024-03-15"), ("March 15 2024", "2024-03-15"), ("2024 March 15", "2024-03-15"), ("2024-03-15T10:00", "2024-03-15"), ("march 15 2024", None), ("2024-13-40", None), ("Notes", None)])
def test_heading_dates(spark, heading, date):
    assert spark.range(1).select(M.heading_date(F.lit(heading)).cast("string")).first()[0] == date


@given(st.lists(st.text("abcXYZ 0123456789", min_size=1, max_size=12).map(str.strip).filter(bool), max_size=5))
@settings(max_examples=8, deadline=None)
def test_links_survive(spark, targets):
    text = " and ".join(f"[[{t}]]" for t in targets)
    got = spark.createDataFrame([(text,)], "t string").select(M.links(F.col("t")).alias("l")).first()["l"]
    assert [x["target"] for x in got] == targets


@pytest.mark.parametrize("seed", [0, 1, 42])
def test_neighbours_match_naive(spark, seed):
    x = np.random.default_rng(seed).normal(size=(64, 16))
    v = spark.createDataFrame([(f"n{i:03d}", row.tolist()) for i, row in enumerate(x)], "path string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in knn.best(v, v, 5, block=20).collect():
        got.setdefault(r["path"], set()).add(r["neighbour"])
    assert got == {f"n{i:03d}": {f"n{j:03d}" for j in np.argsort(-s[i])[:5]} for i in range(64)}
    pairs = {(r["a"], r["b"]) for r in knn.pairs_above(v, 0.3, block=20).collect()}
    assert pairs == {(f"n{i:03d}", f"n{j:03d}") for i in range(64) for j in range(i + 1, 64) if s[i, j] >= 0.3}
    top = np.argsort(-s, axis=1)[:, :5]
    naive = {f"n{i:03d}": 1 - float(u[i] @ u[top[i]].mean(0) / np.linalg.norm(u[top[i]].mean(0))) for i in range(64)}
    for r in knn.surprisal(v, 5).collect():
        assert abs(r["surprisal"] - naive[r["path"]]) < 1e-9


def test_trajectories(spark):
    rows = [(d, p, e) for p, es in {"still": [[1.0, 0.0]] * 5, "turn": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]}.items() for d, e in zip(("2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01"), es)]
    v = spark.createDataFrame(rows, "date string, path string, embedding array<double>").withColumn("date", F.col("date").cast("date"))
    assert {r["path"]: r["cycles"] for r in sessions.cycles(v).collect()} == {"turn": 2}
    assert {r["path"]: round(r["drift"], 6) for r in sessions.session_drift(v).collect()} == {"still": 0.0, "turn": 1.0}
    assert sessions.windowed_rates(v).count() == 6
    assert all(abs(r["drift"]) < 1e-9 for r in sessions.procrustes_drift(v.where("date = '2024-01-01'"), v.where("date = '2024-03-01'"), 1).collect())


def test_filters(spark):
    s = spark.createDataFrame([(1, "a text that is long", ["x"], "q"), (2, "a text that is long", ["x"], "q"), (3, "short", ["x"], "q"), (4, "another text here", [], "q")], "ord bigint, text string, notes array<string>, query_id string")
    assert [r["ord"] for r in filters.quality(s).collect()] == [1]
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0])], "ord bigint, embedding array<double>")
    assert sorted(r["ord"] for r in filters.diversity(e).collect()) == [1, 3]
    old = spark.createDataFrame([("2024-05-02", "a text that is long", "q"), ("2024-05-03", "another text here", "q")], "session_date string, text string, query_id string").withColumn("session_date", F.col("session_date").cast("date"))
    assert sorted(r["ord"] for r in filters.novelty_text(s, old, "2024-07-01").collect()) == [1, 2, 3]
    assert {r["ord"]: r["status"] for r in filters.difference(s, old, "2024-07-01").collect()}[4] == "similar"


def test_voice_and_extraction(spark):
    text = "I went home. Maybe we will go? TODO: call the bank\n> a quoted line of some length\n> and more\nTea is a drink from leaves."
    n = spark.createDataFrame([("p", text)], "path string, content string")
    v = V.voice(n).select("voice.*").first()
    assert v["first_person_singular_freq"] > 0 and v["self_focus_ratio"] == 0.5 and v["question_density"] > 0
    assert [r["item"] for r in extraction.todos(n).collect()] == ["TODO: call the bank"]
    assert [r["item"] for r in extraction.quotes(n).collect()] == ["a quoted line of some length and more"]
    assert [r["item"] for r in extraction.questions(n).collect()] == ["Maybe we will go?"]
    assert any("drink" in r["item"] for r in extraction.definitions(n).collect())
    empty = V.voice(spark.createDataFrame([(None,)], "content string")).select("voice.*").first()
    assert empty["type_token_ratio"] == 0 and empty["orientation"] == "mixed"


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 4)) for c in (0, 3, 6)])
    labels = clusters.density_labels(x)
    assert len({tuple(set(labels[k * 30 : k * 30 + 30]) - {-1}) for k in range(3)}) == 3
    assert (clusters.density_labels(x[:5]) == -1).all()
    assert clusters.diverse_terms(["a b", "a c", "d", "e", "f"], [1, 0.9, 0.8, 0.1, 0.1], count=2) == ["a b", "d"]


def test_grammar():
    g = grammar.Grammar.from_yaml("id: g\ncount: 3\ntracery:\n  origin: ['#thing.s.capitalize# of #note#']\n  thing: [city, fox]\n  note: ['$vault.hubs(1)']\n")
    out = g.suggest({"hubs": lambda n: ["[[H]]"] * n}, 1)
    assert len(out) == 3 and all(t in ("Cities of [[H]]", "Foxes of [[H]]") and r == ["H"] for t, r in out)
    assert out == g.suggest({"hubs": lambda n: ["[[H]]"]}, 1)
    assert g.suggest({"hubs": lambda n: []}, 1) == [] and g.suggest({}, 1) == []
    with pytest.raises(grammar.GrammarError):
        grammar.Grammar.from_yaml("id: g\ntracery:\n  origin: ['$vault.hubs(#n#)']\n")
    with pytest.raises(grammar.GrammarError):
        grammar.Grammar("g", {"origin": ["#origin#"]}).suggest({}, 1)
    assert [grammar.past(w) for w in ("stop", "try", "make", "play", "go", "bake")] == ["stopped", "tried", "made", "played", "went", "baked"]
    assert grammar.article("apple") == "an apple" and grammar.plural("photo") == "photos"


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, "text one", "q")], "ord bigint, text string, query_id string")
    path = sinks.write_journal(s, str(tmp_path / "j"), "2024-07-01")
    assert "## q ^g20240701-001" in open(path, encoding="utf-8").read()
    with pytest.raises(FileExistsError):
        sinks.write_journal(s, str(tmp_path / "j"), "2024-07-01")
    v = spark.createDataFrame([("p", [1.0])], "path string, embedding array<double>")
    for day in ("2024-07-01", "2024-07-02", "2024-07-01"):
        sinks.write_session(v, f"file://{tmp_path}/s", day)
    assert sinks.read_sessions(spark, f"file://{tmp_path}/s").count() == 2
    (tmp_path / "c.yaml").write_text("count: 7\nodd: 1\n")
    config, unknown = sinks.Config.load(str(tmp_path / "c.yaml"))
    assert config.count == 7 and unknown == ["odd"] and sinks.Config.load("/none")[0] == sinks.Config()
    assert sinks.recommendations({}) == ["All is well."]


def test_stream(spark, tmp_path):
    from driftwell.streaming.sync import counted_windows, latest, stream_notes

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("# A\n[[B]]\n")
    q = stream_notes(spark, f"file://{root}", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    got = latest(spark.read.parquet(f"file://{tmp_path}/out").drop("epoch")).collect()
    assert [(r["path"], r["title"]) for r in got] == [("a.md", "A")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert counted_windows(events).first()["n"] == 2


def test_entry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ready_grammars():
    from driftwell.plans.grammars import READY, ready

    def any_function(*args):
        return ["[[A]]|||[[B]], [[C]]"]

    names = "random_note_title hubs sample_notes orphans questioning_notes semantic_clusters past_focused_notes future_focused_notes surprising_notes".split()
    for name in READY:
        g = ready(name)
        out = g.suggest(dict.fromkeys(names, any_function), 3)
        assert len(out) == g.count and all("#" not in t for t, _ in out)


def test_report_and_session(spark):
    from driftwell.plans.registry import Corpus
    from driftwell.plans.report import statistics
    from driftwell.plans.session import Status, functions, invoke

    c = Corpus(spark, "/root/testdata/sf0.001")
    s = statistics(c)
    assert s["notes"] == 200 and s["recommendations"] and s["sessions"] == 6
    status = Status()
    out = invoke(c, ["stub_expander", "task_archaeology"], status=status, full=True, timeout=120)
    assert set(status.failures.values()) == {0} and out.count() > 0
    assert functions(c)["hubs"](2)[0].startswith("[[Doc ")
