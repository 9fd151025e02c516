"""Sessions, stores, user functions, commands, inflection, paths, and numeric operators against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell import commands
from driftwell.functions import registered
from driftwell.operators import extraction as X
from driftwell.operators import filters as S
from driftwell.operators import graph as G
from driftwell.operators import knn as K
from driftwell.operators import sessions as T
from driftwell.plans import session
from driftwell.plans.grammar import past, plural
from driftwell.plans.registry import Corpus
from driftwell.sources import vault
from driftwell.streaming import sync

SF = "/root/testdata/sf0.001"


def embed(d):
    """Vectors that tell suggestions apart by their first reference's digits."""
    n = F.coalesce(F.regexp_extract("text", r"\d+", 0).try_cast("int"), F.lit(0))
    return d.select("ord", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(n * i).cast("double")).alias("embedding"))


def test_a_session_runs_every_query_by_default(spark, tmp_path, monkeypatch):
    some = {k: f for k, f in session.every_query().items() if k in ("stub_expander", "task_archaeology", "question_harvester")}
    assert len(session.every_query()) > 55 and len(some) == 3
    monkeypatch.setattr(session, "every_query", lambda: some)
    c, status = Corpus(spark, SF), session.Status()
    rows = session.invoke(c, full=True, status=status, timeout=120, embed=embed, grammars=["transformation_suggester"], excluded=("session journal/",), history_root=f"{tmp_path}/history", journal=f"{tmp_path}/journal").collect()
    assert {r["query_id"] for r in rows} >= {"stub_expander", "task_archaeology"} and not status.errors
    assert not any("session journal" in n for r in rows for n in r["notes"])
    assert spark.read.parquet(f"{tmp_path}/history").count() == len(rows) and (tmp_path / "journal/2024-07-01.md").exists()
    assert session.invoke(c, ["stub_expander"], count=2, timeout=120).count() == 2
    for bad in ({"names": ["no_such"]}, {"limits": S.Limits(strategies=("quality", "odd"))}):
        with pytest.raises(ValueError):
            session.invoke(c, **({"names": ["stub_expander"]} | bad))
    assert session.trial(c, ["stub_expander"], timeout=120)["stub_expander"][2] is None


def test_status_is_stored(spark, tmp_path):
    s = session.Status()
    for _ in range(3):
        s.record("a", 0.1, "bad")
    s.record("b", 0.2)
    s.save(spark, f"{tmp_path}/status")
    again = session.Status.load(spark, f"{tmp_path}/status")
    assert again.disabled("a") and not again.disabled("b") and again.errors == {"a": "bad"}


def test_registered_functions(spark):
    r = registered.Registry({"mine", "size", "again"})
    r.add("query", "mine", lambda c: spark.createDataFrame([("x",)], "a string"))
    assert r.query("mine", None).count() == 1
    r.functions["query"]["odd"] = lambda c: [1]
    for call, error in ((lambda: r.add("query", "mine", lambda c: c), ValueError), (lambda: r.add("query", "other", lambda c: c), PermissionError), (lambda: r.add("query", "again", lambda: 1), TypeError), (lambda: r.add("query", "9", lambda c: c), ValueError), (lambda: r.query("odd", None), TypeError)):
        with pytest.raises(error):
            call()
    r.register("metadata", "size")(lambda n: {"chars": F.length("content")})
    notes = spark.createDataFrame([("a", "xyz"), ("b", "x")], "path string, content string")
    m = r.metadata(notes)
    assert sorted(x["chars"] for x in m.collect()) == [1, 3]
    r.functions["metadata"]["clash"] = lambda n: {"path": F.lit(1)}
    with pytest.raises(ValueError):
        r.metadata(notes)
    assert registered.compare(m, "a", "b").first()["difference"] == -2
    r.add("vault", "mine", lambda c, n: n + 1)
    assert r.call("mine", None, 4) == 5


def test_encoder_and_its_cache(spark, tmp_path):
    seen = []

    def encoder(d):
        seen.append(d.count())
        return d.select("digest", F.array(F.length("text").cast("double")).alias("embedding"))

    notes = spark.createDataFrame([("a", "xyz"), ("b", "xyz"), ("c", None)], "path string, content string")
    for want in (2, 0):
        out = registered.encode(notes, encoder, "m", f"{tmp_path}/cache")
        assert {r["path"]: r["embedding"] for r in out.collect()} == {"a": [3.0], "b": [3.0], "c": [0.0]} and seen[-1] == want


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.md").write_text("# One\n\nshort [[two]] and\n- [ ] a task\n")
    (tmp_path / "sub/two.md").write_text("---\ntitle: two\n---\nback to [[One]]\n")
    with pytest.raises(FileNotFoundError):
        commands.root_of(str(tmp_path))
    assert commands.main(["init", str(tmp_path)]) == 0 and commands.main(["validate", str(tmp_path)]) == 0
    (tmp_path / ".driftwell/grammars/x.yaml").write_text("id: x\n")
    (tmp_path / ".driftwell/grammars/y.yaml").write_text("id: y\ntracery:\n  origin: hello\n")
    assert commands.main(["validate", str(tmp_path / "sub")]) == 1 and list(commands.grammars(str(tmp_path))) == ["y"]
    c = commands.Folder(spark, str(tmp_path))
    assert c.sync() == 2 and c.sync() == 0 and {r["title"] for r in c.notes.select("title").collect()} == {"One", "two"}
    capsys.readouterr()
    assert commands.main(["invoke", str(tmp_path), "stub_expander", "--full", "--write"]) == 0
    assert "stub_expander" in capsys.readouterr().out
    assert c.history.count() == 2 and (tmp_path / "session journal/2024-07-01.md").exists()


@pytest.mark.parametrize(("word", "many", "was"), [("give", "gives", "gave"), ("Grow", "Grows", "Grew"), ("city", "cities", "citied"), ("box", "boxes", "boxed"), ("photo", "photos", "photoed"), ("hero", "heroes", "heroed"), ("stop", "stops", "stopped"), ("play", "plays", "played"), ("carry", "carries", "carried"), ("enter", "enters", "enterred"), ("", "", ""), ("Man", "Men", "Manned")])
def test_inflection(word, many, was):
    assert (plural(word), past(word)) == (many, was)


def test_extraction_forms(spark):
    text = "- What is the plan here?\nShows that x holds.\nA Term Is a thing of note.\nThis is a thing of note.\n`code\nIf a then b holds.` tail\nOne means many of them."
    notes = spark.createDataFrame([("p", text)], "path string, content string")
    assert "What is the plan here?" in [r["item"] for r in X.questions(notes).collect()]
    assert [r["item"] for r in X.claims(notes, 10).collect()] == ["Shows that x holds."]
    assert {r["item"] for r in X.definitions(notes).collect()} == {"A Term is thing of note.", "One means many of them."}
    assert X.hypotheses(notes, 5).count() == 0


def test_long_chain_has_a_path(spark):
    n = 64
    e = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(n)], "a string, b string")
    assert G.shortest_path(e, "n000", f"n{n:03d}").count() == n + 1
    assert G.shortest_path(e, f"n{n:03d}", "n000").count() == 0


def test_pairs_meet_once_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    v = spark.createDataFrame([(f"p{k:02d}", r.tolist()) for k, r in enumerate(x)], "path string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"p{i:02d}", f"p{j:02d}") for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.3}
    for block in (16, 2048):
        found = [(r["a"], r["b"]) for r in K.pairs_above(v, 0.3, block=block).collect()]
        assert len(found) == len(want) and set(found) == want
    groups = v.withColumn("a", F.lit("g"))
    upper = np.clip(s, 0, 1)[np.triu_indices(90, 1)].mean()
    for block in (16, 1024):
        assert abs(K.mean_alike(groups, block).first()["alike"] - upper) < 1e-9


def test_procrustes_against_a_direct_rotation(spark):
    rng = np.random.default_rng(7)
    past_, turn = rng.normal(size=(30, 5)), np.linalg.qr(rng.normal(size=(5, 5)))[0]
    now = past_ @ turn + 0.05 * rng.normal(size=(30, 5))
    a, b = (spark.createDataFrame([(f"p{k}", r.tolist()) for k, r in enumerate(m)], "path string, embedding array<double>") for m in (now, past_))
    u, _, vt = np.linalg.svd(past_.T @ now)
    y = past_ @ (u @ vt)
    want = 1 - (now * y).sum(1) / (np.linalg.norm(now, axis=1) * np.linalg.norm(y, axis=1))
    got = {r["path"]: r["drift"] for r in T.procrustes_drift(a, b).collect()}
    assert np.allclose([got[f"p{k}"] for k in range(30)], want, atol=1e-9)


def test_stream_keeps_folders_apart(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.md").write_text(f"# {d}\n")
    q = sync.stream_notes(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    assert {r["path"] for r in sync.latest(spark.read.parquet(f"{tmp_path}/out")).collect()} == {"a/x.md", "b/x.md"}


def test_lookups(spark):
    notes = spark.createDataFrame([(f"p{k}", k) for k in range(700)], "path string, k int")
    assert vault.note(notes, "p3").first()["k"] == 3 and vault.note(notes, "zz").count() == 0
    for many in (3, 600):
        assert vault.by_paths(notes, [f"p{k}" for k in range(many)]).count() == many
