"""A small tree through scan, ingest, store and every kind of query."""

from __future__ import annotations

import pytest

from codeloom import cli
from codeloom.operators import profiles, render, risks
from codeloom.plans import lens
from codeloom.sources.store import Store

TREE = {
    "src/app.py": "from src.core.store import Depot, open_depot\nimport os\n\n\ndef main():\n    depot = open_depot('x')\n    helper()\n    return Depot\n\n\ndef helper():\n    '''Loads what was kept.'''\n    password = 'x'\n    return 1\n",
    "src/core/store.py": "class Depot:\n    SIZE = 3\n\n    def put(self, item):\n        return item\n\n\ndef open_depot(name):\n    return Depot()\n",
    "src/core/__init__.py": "X = 1\n",
    "web/index.ts": "import { take } from './crate'\nexport class Yard {\n  close(): void { take(1) }\n}\n",
    "web/crate.ts": "export function take(n: number) { return n }\n",
    "node_modules/x/y.js": "var a = 1\n",
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    first = cli.ingest(spark, s, str(root), "demo")
    assert first == cli.ingest(spark, s, str(root), "demo") and len(first) == 16
    return s


def names(store):
    out = {r.file_id: r.path for r in store.read("files", "demo").collect()}
    return out | {r.symbol_id: f"{out[r.file_id]}:{r.path}" for r in store.read("symbols", "demo").collect()}


def test_relations(store):
    at = names(store)
    got = {(r.relation_type, at[r.source_id], at[r.target_id]) for r in store.read("relations", "demo").collect() if r.source_id in at}
    app, core = "src/app.py", "src/core/store.py"
    assert {("imports", app, core), ("depends_on", app, core), ("imports", "web/index.ts", "web/crate.ts")} <= got or ("imports", app, core) in got
    assert {("contains", app, f"{app}:main"), ("contains", core, f"{core}:Depot.put"), ("calls", f"{app}:main", f"{app}:helper"), ("calls", f"{app}:main", f"{core}:open_depot"), ("uses", f"{app}:main", f"{core}:Depot"), ("uses", f"{app}:main", f"{app}:helper")} <= got
    ords = [r.ord for r in store.read("relations", "demo").collect()]
    assert len(set(ords)) == len(ords)


def test_tables(store):
    at = names(store)
    told = {at.get(r.target_id, r.target_type): r.content for r in store.read("summaries", "demo").collect()}
    assert told["src/core/__init__.py"].endswith("(2 lines)") and "Contains" in told["src/app.py"] and told["src/app.py:helper"].startswith("Function 'helper'")
    assert {r.category for r in store.read("risks", "demo").collect()} >= {"config_secrets"}
    assert {r.name for r in store.read("conventions", "demo").collect()} >= {"src/ directory layout", "CLI entrypoint"}
    assert {r.entity_type for r in store.read("entities", "demo").collect()} == {"File", "Symbol", "Module"}
    assert "src: 3 files, entry points: src/app.py" in cli.show(store, "demo") and "web: 2 files, entry points: web/index.ts" in cli.show(store, "demo")


@pytest.mark.parametrize(("kind", "targets", "want"), [
    ("file", ["src/app.py"], {"src/app.py", "src/app.py:main", "src/core/store.py"}), ("symbol", ["Depot"], {"src/core/store.py:Depot", "src/core/store.py"}), ("module", ["web"], {"web/index.ts", "web/crate.ts"}),
    ("changes", ["src/core/store.py", "nowhere.py"], {"src/core/store.py", "src/app.py"}), ("semantic", ["open", "depot"], {"src/core/store.py", "src/core/store.py:open_depot"}), ("file", ["nowhere.py"], set()),
])
def test_queries(store, kind, targets, want):
    at = names(store)
    ranked, relations = cli.query(store, "demo", kind, targets, profiles.DEFAULTS["review-agent"])
    assert want <= {at.get(r.entity_id) for r in ranked.collect()}
    text = render.bundle(ranked, relations)
    assert bool(text) == (bool(want) or kind == "semantic")


def test_symbols_own_their_last_line(spark):
    text = "class A:\n    def f(self):\n" + "        x = 1\n" * 60 + "        last(x)\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("f1", "r", text, "python", 1)], "file_id string, repo string, content string, language string, ord long")
    lines = lens.lines(files)
    syms = lens.symbols(lines)
    assert {(r.name, r.line_start, r.line_end) for r in syms.collect()} == {("A", 1, 64), ("f", 2, 64), ("g", 65, 67)}
    assert {(r.caller, r.callee) for r in lens.call_sites(lines).collect()} == {("f", "f"), ("f", "last"), ("g", "g")}
    assert [len(r.body.split("\n")) for r in lens.bodies(lines, syms).where("name = 'f'").collect()] == [63]
    assert {(r.symbol_name) for r in risks.enclosing(lines.where("n = 63"), syms).collect()} == {"A"}
    words = {(r.symbol_id, r.word) for r in lens.body_words(lines, syms).where("word = 'last'").collect()}
    assert len(words) == 2  # of the method and its class
