"""Commands: ``python -m driftwell.commands init|sync|invoke|test|stats|validate FOLDER``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftwell.plans import report, session
from driftwell.plans.grammar import Grammar, GrammarError
from driftwell.plans.registry import Corpus
from driftwell.sources import sinks, vault

HOME = ".driftwell"


def root_of(folder: str) -> Path:
    """The nearest folder upwards that was initialised."""
    here = Path(folder).resolve()
    for at in (here, *here.parents):
        if (at / HOME).is_dir():
            return at
    raise FileNotFoundError(f"{folder}: no {HOME} here or above; run init")


def init(folder: str) -> Path:
    """Make a folder's settings; those that are there stay."""
    home = Path(folder).resolve() / HOME
    (home / "grammars").mkdir(parents=True, exist_ok=True)
    if not (home / "config.yaml").exists():
        sinks.Config().save(str(home / "config.yaml"))
    return home


class Folder(Corpus):
    """A corpus of a folder's Markdown files. Notes, links and tags are written once by ``sync``; vectors come from ``vectors``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        self.home = root_of(root) / HOME

    @property
    def _stored(self) -> str:
        return f"file://{self.home}/notes"

    def sync(self) -> int:
        """Read changed files; how many."""
        versions = sorted((self.home / "notes").glob("v*")) if (self.home / "notes").is_dir() else []
        old = self.spark.read.parquet(f"file://{versions[-1]}") if versions else None
        notes, n = vault.sync(self.spark, f"file://{self.home.parent}", old)
        notes.write.mode("error").parquet(f"{self._stored}/v{len(versions):06d}")
        return n

    @property
    def notes(self):  # noqa: ANN201
        versions = sorted((self.home / "notes").glob("v*"))
        return self.spark.read.parquet(f"file://{versions[-1]}")

    @property
    def vectors(self):  # noqa: ANN201
        return self.spark.read.parquet(f"file://{self.home}/vectors")

    @property
    def history(self):  # noqa: ANN201
        if (self.home / "history").is_dir():
            return self.spark.read.parquet(f"file://{self.home}/history")
        return self.spark.createDataFrame([], "session_date date, query_id string, text string, block_id string")


def validate(folder: str) -> list[str]:
    """What is wrong with a folder's settings and grammars; nothing if all is in order."""
    home, out = root_of(folder) / HOME, []
    _, odd = sinks.Config.load(str(home / "config.yaml"))
    out += [f"config.yaml: unknown setting {k}" for k in odd]
    names: dict[str, str] = {}
    for path in sorted((home / "grammars").glob("*.y*ml")):
        try:
            g = Grammar.from_yaml(path.read_text(encoding="utf-8"))
            if g.name in names:
                out.append(f"{path.name}: {g.name} is in {names[g.name]} already")
            names[g.name] = path.name
        except (GrammarError, ValueError, OSError) as e:
            out.append(f"{path.name}: {e}")
    return out


def grammars(folder: str) -> dict[str, Grammar]:
    """The folder's own grammars by name; files that are out of order are left out, ``validate`` names them."""
    found = {}
    for path in sorted((root_of(folder) / HOME / "grammars").glob("*.y*ml")):
        try:
            g = Grammar.from_yaml(path.read_text(encoding="utf-8"))
        except (GrammarError, ValueError):
            continue
        found.setdefault(g.name, g)
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="driftwell")
    p.add_argument("command", choices=("init", "sync", "invoke", "test", "stats", "validate"))
    p.add_argument("folder")
    p.add_argument("names", nargs="*")
    p.add_argument("--date", default="2024-07-01")
    p.add_argument("--full", action="store_true")
    p.add_argument("--write", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        print(init(a.folder))
        return 0
    if a.command == "validate":
        wrong = validate(a.folder)
        print("\n".join(wrong) or "All is in order.")
        return 1 if wrong else 0
    c = Folder(SparkSession.builder.appName("driftwell").getOrCreate(), a.folder)
    if a.command == "sync":
        print(c.sync())
    elif a.command == "test":
        found = session.trial(c, a.names or None, a.date)
        print(json.dumps(found, indent=1))
        return 1 if any(e for _, _, e in found.values()) else 0
    elif a.command == "stats":
        print(sinks.stats_json(report.statistics(c, a.date)))
    else:
        config, _ = sinks.Config.load(str(c.home / "config.yaml"))
        store = f"file://{c.home}/status"
        status = session.Status.load(c.spark, store) if (c.home / "status").is_dir() else session.Status()
        out = session.invoke(c, a.names or None, a.date, config.count, a.full, status, timeout=config.timeout, excluded=tuple(config.excluded), history_root=f"file://{c.home}/history" if a.write else None, journal=str(c.home.parent / "session journal") if a.write else None)
        for r in out.orderBy(F.col("ord")).collect():
            print(f"{r['query_id']}: {r['text']}")
        status.save(c.spark, store)
    return 0


if __name__ == "__main__":
    sys.exit(main())
