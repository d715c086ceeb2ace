from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import files, glossary, profiles, relations, render, risks
from codeloom.parse import extract
from codeloom.sources.scan import scan_repository
from codeloom.sources.store import Store
from codeloom.streaming import incremental


def test_scan(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "tests").mkdir()
    for name, data in {"src/app.py": b"x = 1\r\ny = 2\r\n", "src/node_modules/a.js": b"1", "src/bin": b"1", "src/my.env": b"A=1", "nul.py": b"a\0b", "edge.py": b"a" * 8191 + b"\0", "late.py": b"a" * 8192 + b"\0", "bad.py": b"\xff\xfe", "big.py": b"a" * (1024 * 1024 + 1), "fits.py": b"a" * 1024 * 1024, "tests/t.ts": b"\xef\xbb\xbf", "src/__init__.py": b"", ".env": b"A=1"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in scan_repository(spark, str(tmp_path), "r").collect()}
    assert {p: r.skip_reason for p, r in rows.items() if r.skip_reason} == {"src/node_modules/a.js": "directory", "src/bin": "name", "nul.py": "binary", "edge.py": "binary", "big.py": "size"}
    assert rows["src/app.py"].content == "x = 1\ny = 2\n" and rows["src/app.py"].is_entrypoint and rows["tests/t.ts"].is_test
    assert rows["src/__init__.py"].content == "" and rows["src/__init__.py"].size == 0 and rows[".env"].is_config
    assert [p for p, r in sorted(rows.items(), key=lambda x: x[1].ord)] == sorted(rows) and rows["big.py"].hash is None
    assert {r.path: r.skip_reason for r in scan_repository(spark, str(tmp_path), "r", max_size=10).collect()}["src/app.py"] == "size"
    assert rows["bad.py"].content == "��" and rows["tests/t.ts"].content == "\ufeff"


def test_flags(spark):
    paths = ["a/latest.py", "test_x.py", "x_spec.ts", "src/tests/y.cs", "main.go", "Program.cs", "pyproject.toml", ".env", "noext", "a.min.js"]
    df = spark.createDataFrame([(p, "h", 1, "r") for p in paths], "path string, hash string, size long, repo string")
    rows = {r.path: r for r in files.file_rows(df).collect()}
    assert [p for p in paths if rows[p].is_test] == ["a/latest.py", "test_x.py", "x_spec.ts", "src/tests/y.cs"]
    assert rows["Program.cs"].is_entrypoint and not rows["main.go"].is_entrypoint and rows[".env"].is_config and rows["noext"].language == "unknown"


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("f1", None), ("f2", 3)], "file_id string, n int")
    store.write("r", "one", {"files": df}, "2024-01-01")
    store.write("r", "two", {"files": df.limit(1)}, "2024-01-02")
    assert store.latest("r") == "two" and store.latest("r", "2024-01-01") == "one" and store.read("files", "r", "one").count() == 2
    assert store.read("files", "r", "none") is None and store.read("nothing", "r") is None
    assert store.delete("r", "two") and not store.delete("r", "two") and store.latest("r") == "one"
    store.export_json("r", "one", str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/files")).count() == 2 and '"files": 2' in store.metadata("r")


PY = '''import os, sys as s
from .x import Y, Z
LIMIT = 1
@dec
def top(a, *b, **c) -> int:
    """Doc."""
    def inner(): pass
    return os.path.join(a)
class K:
    MAX = 2
    async def m(self): self.go()
    def __init__(self): pass
'''
TS = '''import d, { a as b, c } from './m';
import * as N from "n";
export class Q<T> extends P { private x = 1; async go(a: string, ...r: number[]): Promise<{ z: 1 }> { this.run(a); } }
export interface I { f(): void }
type Al = { k: 1 };
enum E { A }
const UP = "x", low = (v) => v;
export const arrow = async (p) => { call(`t${p}`); };
'''
CS = '''using System.Text;
namespace A.B;
public sealed class C : Base { public C() { } public int P { get; set; } const string K = "x"; [X] private static async Task<int> Go(int a, List<string> b) { return Run(a); } }
public interface IThing { void No(); }
'''


def test_extractors(spark):
    df = spark.createDataFrame([("p", "python", PY), ("t", "typescript", TS), ("c", "c_sharp", CS), ("bad", "python", "def ("), ("nul", "python", None), ("go", "go", "x")], "file_id string, language string, content string")
    parsed = extract.extract(df).cache()
    errors = {r.file_id: r.error for r in parsed.collect()}
    assert errors["bad"] and not errors["p"] and errors["nul"] is None and "go" not in errors
    got = {(r.file_id, r.path, r.kind) for r in extract.symbol_rows(parsed).collect()}
    assert {("p", "LIMIT", "constant"), ("p", "top", "function"), ("p", "inner", "function"), ("p", "K", "class"), ("p", "K.MAX", "constant"), ("p", "K.m", "method"), ("p", "K.__init__", "method")} == {x for x in got if x[0] == "p"}
    assert {("t", "Q", "class"), ("t", "Q.x", "property"), ("t", "Q.go", "method"), ("t", "I", "interface"), ("t", "Al", "type"), ("t", "E", "enum"), ("t", "UP", "constant"), ("t", "arrow", "function")} <= got
    assert {("c", "C", "class"), ("c", "C.Go", "method"), ("c", "C.P", "property"), ("c", "C.K", "constant"), ("c", "IThing", "interface")} == {x for x in got if x[0] == "c"}
    imports = {(r.file_id, r.module_path, tuple(r.names)) for r in extract.import_rows(parsed).collect()}
    assert {("p", "os", ("os",)), ("p", "sys", ("s",)), ("p", ".x", ("Y", "Z")), ("t", "n", ("* as N",)), ("c", "System.Text", ())} <= imports
    calls = {(r.file_id, r.callee, r.caller_path) for r in extract.call_rows(parsed).collect()}
    assert {("p", "os.path.join", "top"), ("p", "self.go", "K.m"), ("t", "this.run", "Q.go"), ("t", "call", "arrow"), ("c", "Run", "C.Go")} <= calls


def test_imports_first_candidate_wins(spark):
    f = spark.createDataFrame([("r", "a/b.py", "f1", 1), ("r", "a/b/__init__.py", "f2", 2), ("r", "x.ts", "f3", 3), ("r", "a/b.py", "f4", 4)], "repo string, path string, file_id string, ord long")
    rows = spark.createDataFrame([(1, "r", "q", "a.b", True), (2, "r", "q", "./x", True), (3, "r", "q", "gone", False), (4, "r", "q", "../x", True)], "import_id long, repo string, file_id string, module_path string, is_from_import boolean")
    assert sorted(r.target_id for r in relations.imports(rows, f).collect()) == ["f3", "f3", "f4"]


def test_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_id string, target_id string")
    got = {(r.node, r.hops) for r in relations.reach(e, spark.createDataFrame([("a",)], "source string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_risk_severity_and_evidence(spark):
    lines = [(1, "def save(x):"), (2, "  cursor.execute(x)"), (3, "  cache.get(1)"), (9, "redis()"), (10, "PASSWORD = 1")]
    f = spark.createDataFrame([("f", "a.py", 600, "python", "x"), ("g", "package.json", 1, "unknown", "x")], "file_id string, path string, size long, language string, content string")
    ls = spark.createDataFrame([("f", n, x) for n, x in lines], "file_id string, n int, line string")
    sy = spark.createDataFrame([("f", "save", 1, 5, 1), ("f", "late", 2, 5, 2)], "file_id string, name string, line_start int, line_end int, ord long")
    got = {r.category: r for r in risks.risk_areas(risks.eligible(f), ls, sy).collect()}
    assert got["database_write"].symbol_name == "save" and got["database_write"].n_matches == 1 and got["database_write"].severity == "medium"
    assert got["cache"].n_matches == 2 and (got["cache"].line_first, got["cache"].line_last) == (3, 9) and got["cache"].severity == "low"
    assert got["config_secrets"].severity == "high" and got["config_secrets"].symbol_name is None


def test_profiles(tmp_path):
    reg = profiles.Registry(tmp_path)
    reg.save(profiles.Profile("own", max_items=3))
    again = profiles.Registry(tmp_path)
    assert again.get("own").max_items == 3 and again.get("none") is None and again.names() == ["dev-agent", "doc-agent", "own", "review-agent"]
    assert profiles.Profile.of({"name": "x", "unknown": 1, "preferred_entities": ["File"]}).preferred_entities == ("File",)


def test_parse_terms():
    assert render.parse_terms('```json\n{"a": "b", "c": 1, " ": "x"}\n```') == {"a": "b"}
    assert render.parse_terms('text {"a": "b"} text') == {"a": "b"}
    assert render.parse_terms("[1]") == render.parse_terms("{bad") == render.parse_terms(None) == render.parse_terms('{"a": ""}') == {}
    assert len(render.parse_terms(str({f"k{i}": "v" for i in range(20)}).replace("'", '"'))) == 15
    assert render.condense(["", " ", "x" * 600, "y"]) == "x" * 500 + "\n---\ny"


def test_lexicons(spark):
    reg = render.Lexicons()
    reg.register("l", lambda s: s.createDataFrame([("Ramp", "a"), ("none", "b")], "keyword string, description string"))
    f = spark.createDataFrame([("f", "the ramp, RAMP and ramps")], "file_id string, content string")
    assert [(r.keyword, r.n) for r in glossary.lexicon_hits(f, reg.get("l", spark)).collect()] == [("ramp", 2)]
    reg.unregister("l")
    assert reg.names() == []


def test_stream_takes_each_content_once(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a.py", "h", 1, "s", "2024-01-01 00:00:00"), ("./a.py", "H ", 1, "s", "2024-01-01 01:00:00"), ("b.py", "h", 2, "s", "2024-01-01 00:00:00")], "path string, hash string, size long, snapshot_id string, t string").withColumn("ingested_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)
    stream = incremental.new_contents(incremental.file_stream(spark, src, df.schema))
    for _ in range(2):  # a rerun finds nothing new
        incremental.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_index_round_trip(spark, folder, tmp_path):
    from codeloom.operators import search
    from codeloom.sources.store import load_index, save_index

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    tf = search.term_counts(docs)
    idf = search.idf_table(tf, docs.count())
    save_index(tf, idf, search.norms(tf, idf), str(tmp_path / "i"))
    query = "the order of entries, unknownword"
    assert search.search_index(*load_index(spark, str(tmp_path / "i")), query).collect() == search.search(docs, query).collect()
    assert search.search(docs, "unknownword").collect() == []
