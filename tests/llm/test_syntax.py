from __future__ import annotations

import ast
import pathlib
import random
import warnings

import pytest

from codeloom.llm import grammar, syntax
from codeloom.llm.syntax import Map, chunk_map, chunks, compose, valid

JS_GOOD = [
    "", "﻿const a = 1;\n", "let a = b\nlet c = d\n(e)\n", "const f = async ({ a, b: [c], ...d } = {}, e = 1) => { await a?.b?.[c]?.(d) }\n", "export default class extends A { static #p = 1; get x() { return this.#p } static { init() } async *gen() { yield* x } }",
    "for (const [k, v] of Object.entries(o)) if (k) continue; else break\n", "for await (const x of y) {}", "label: for (;;) { break label }", "do x++; while (x < 5)\nfoo()", "const r = /[/\\]]+/g.test(a) ? a / b / c : `x${`y${z}`}`;", "var a = b ? (c, d) : e => ({ f: e })",
    "import a, { b as c, default as d } from './x'\nimport * as n from \"n\"\nimport './y';\nexport * from 'z'; export { a as default, b };", "switch (a) { case 1: case 2: f(); break\n default: g() }", "try { a() } catch { b() } finally { c() }", "const o = { a, b, [c]: 1, 'd': 2, 3: 4, get e() { return 1 }, async *f() {}, ...g, };", "if (a) b(); else if (c) d(); else { e() }",
    "x = a ?? b || c && !d\ny ||= 2n ** 3n; z = typeof a in b", "new Foo\nnew a.B(1)(2)\nnew.target", "return_ = async function* () {}\nasync () => {}", "a\n++b\n", "class A { 'quoted'() {} 1() {} static async = 1; get; set = 2 }", "(function () { 'use strict'; var x = 017 })()", "const {a = 1, ...rest} = b, [c, , d = 2] = e;", "throw new Error(`bad ${x}`)",
]
JS_BAD = [
    "const a = ;", "function (", "let x = {", "foo bar baz", "<<<<<<< HEAD\nconst a = 1;\n=======\n>>>>>>> b\n", "def f(x):\n    return x\n", "using System;\n", "const a: number = 1;", "interface A { b: string }", "const s = 'open\n", "a = `open ${b}", "/* open", "if (a { b() }", "x = [1, 2\n", "export { a from 'b'", "class { }", "<!DOCTYPE html>", "Here is the code, as requested:\n```\nconst a = 1\n```", "const {{ a }} = 3;", "for (const a of b c) {}", "const a = 1 2", "x = 15b562e", "a = /re/hinge",
]
TS_GOOD = [
    "const a: Map<string, Array<number>> = new Map<string, Array<number>>();", "function f<T extends object = {}>(this: Window, a?: T, ...b: string[]): a is T { return a! as unknown as T }", "abstract class A<T> extends B<T> implements C, D { private readonly x?: number = 1; constructor(public a: string, protected b = 2) { super() } abstract m(): void; static s!: string; [k: string]: any; declare z: 1 }",
    "interface I<T> extends J { readonly a: string; b?(x: number): void; new (x: T): I<T>; (y: string): number; [key: string]: unknown; get c(): string }", "type X = { [K in keyof T]?: T[K] } & (A | B)[] | `a${string}` | typeof y | readonly string[]", "type F<T> = T extends (infer U)[] ? U : never\ntype G = (a: number, b?: string) => void", "enum E { A, B = 1 << 2, 'C' = 3 }\nexport const enum F { X }",
    "declare module 'x' { export function f(): void }\nnamespace A.B { export type C = 1 }\ndeclare global { interface Window { a: 1 } }", "import type { A } from './a'; import { type B, C } from './b'; export type { A }; import x = require('y'); export = x", "@Component({ a: 1 })\nexport class K { @Input() a: string; @Traced('b')\n m(@Inject() c: D): void {} }", "let x = <const T,>(a: T) => a; const y = a satisfies B", "function over(a: string): void;\nfunction over(a: number): void;\nfunction over(a: any) {}", "const z = (a: number): string => `${a}`; let t: [a: string, b?: number, ...c: boolean[]]; let u: unique symbol", "let v = a < b && c > d; f<string>(g); let w: A.B<C>['d'][]",
]
TS_BAD = ["const a: = 1;", "interface A { b: string", "type X = ;", "enum E { A B }", "class A { private }}", "let x: Map<string = 1", "function f(a: string, b number) {}"]
CS_GOOD = [
    "", "using System;\nusing static A.B;\nusing L = System.Collections.Generic.List<int>;\nnamespace A.B;\npublic class C { }", "namespace A { public struct S<T> where T : class, new() { public int X { get; private set; } = 1; public event Action E; public int this[int i] => i; public static S<T> operator +(S<T> a, S<T> b) => a; } }", "public record R(int A, string B = \"x\") : Base(A) { public required string C { get; init; } }",
    "class A { public A(int x) : base(x) { } ~A() { } async Task<int> F<T>(ref int a, params string[] b) where T : struct { await foreach (var x in y) { yield return x; } return a switch { > 1 and < 5 => 1, null => 2, { P: 1 } p => 3, (1, _) => 4, _ => throw new E() }; } }", "class A { void F() { if (x is not null && y is string { Length: > 0 } s) { var (a, b) = t; (int c, string d) = u; int[] e = [1, 2, ..f]; var g = new() { H = 1 }; } } }",
    "class A { string s = $\"a {b:N2} {{x}} {(c ? \"d\" : \"e\")}\"; string v = @\"c:\\x\"\"y\"; string r = \"\"\"raw \"q\" text\"\"\"; char c = '\\''; string i = $@\"x{y}\\z\"; }", "[Serializable, Obsolete(\"x\")]\npublic sealed partial class A : B<C>, D { [Route(\"a/{id}\")] internal static List<int> M(DateTime? d, Dictionary<string, List<int>> e) => throw new NotSupportedException(\"f\"); private const string K = \"a\" + \"b\"; readonly int[,] g = new int[2, 3]; }",
    "class A { void F() { using var a = b; using (var c = d) { } lock (e) { f += 1; } for (int i = 0, j = 1; i < 5; i++, j--) ; do { } while (x); switch (g) { case 1 when h: case 2: break; default: goto case 1; } try { } catch (E ex) when (ex.X) { } catch { throw; } finally { } } }", "interface I { int P { get; } void M(int a); }\nenum E : byte { A = 1, [X] B, }\npublic delegate void D<in T>(T a);", "#region x\n#if DEBUG\nclass A { }\n#endif\n#endregion\n", "var x = from a in b where a > 1 orderby a descending select new { a.B, C = a.D };\nConsole.WriteLine(x);", "class A { Func<int, int> f = x => x * 2; Action g = () => { }; object h = (a, b) => (int)a + (double)b; int k = a ? b : c; bool l = d < e && f > g; unsafe void P(int* q) { } }",
]
CS_BAD = ["class A {", "class A { void F() { var x = ; } }", "class A { int x }", "import { a } from './b';", "def f(x):\n    pass", "class A { void F() { return 1 } }", "class A { void F() { Foo(; } }", "class A { string s = \"open; }", "class A { char c = 'ab'; }", "class A { void F() {\n<<<<<<< HEAD\n int a = 1;\n=======\n>>>>>>> x\n } }", "# Title\n\nSome prose here.", "class A { var {{ x }} = 3; }", "class A { void F() { } } }"]
PY_GOOD = ["", "﻿x = 1\n", "def f[T](x: T, /, *, y) -> int:\n    match x:\n        case {'a': [1, *r]}: return f'{x!r:>{y}}'\n"]
PY_BAD = ["def f(:\n", "x = 1\n  y = 2\n", "print 'a'\n", "'''open", "a\0b", "<<<<<<< HEAD\n"]


@pytest.mark.parametrize(("lang", "good", "bad"), [("javascript", JS_GOOD, JS_BAD), ("typescript", JS_GOOD[:-2] + TS_GOOD, TS_BAD + ["using System;\n", "def f(x):\n    return x\n"]), ("c_sharp", CS_GOOD, CS_BAD), ("python", PY_GOOD, PY_BAD)])
def test_grammars(lang, good, bad):
    assert [t for t in good if not valid(t, lang)] == []
    assert [t for t in bad if valid(t, lang)] == []


SHORT = {"typescript": "ts", "javascript": "js", "c_sharp": "cs", "python": "py"}


@pytest.mark.parametrize(("lang", "good", "bad"), [("javascript", JS_GOOD, JS_BAD), ("typescript", TS_GOOD, TS_BAD), ("c_sharp", CS_GOOD, CS_BAD), ("python", PY_GOOD, PY_BAD)])
def test_no_answer_depends_on_time(monkeypatch, lang, good, bad):
    g = grammar.Grammar(SHORT[lang])

    class Slow:
        def match(self, *args, **kwargs):
            raise TimeoutError

    g.rules = Slow()
    monkeypatch.setitem(grammar._grammars, SHORT[lang], g)
    assert [t for t in good if not valid(t, lang)] == []
    assert [t for t in bad if valid(t, lang)] == []


def by_interpreter(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.removeprefix("\ufeff"))
        except (SyntaxError, ValueError):
            return False
    return True


def test_python_equals_the_interpreter():
    rnd = random.Random(11)
    files = [f for f in sorted(pathlib.Path(ast.__file__).parent.glob("*.py")) if f.stat().st_size < 30_000]
    for f in rnd.sample(files, 15):
        text = f.read_text(encoding="utf-8")
        lines = text.split("\n")
        tries = [text]
        for _ in range(6):
            i, j = rnd.randrange(len(text) + 1), rnd.randrange(len(lines))
            tries += [text[:i], text[:i] + text[i + 1 :], text[:i] + rnd.choice("()[]{}:,='\"+ *") + text[i:], "\n".join(lines[:j] + lines[j + 1 :]), "\n".join([*lines[:j], "<<<<<<< HEAD", *lines[j:]]), "\n".join([*lines[:j], " " + lines[j], *lines[j + 1 :]])]
        for t in tries:
            assert valid(t, "python", 700) == by_interpreter(t), (f, t)


def test_exact_takes_long_contents():
    exact = grammar.grammar("c_sharp").exact
    assert exact.fits("P_X", "i" + "+i" * 2000) and not exact.fits("P_X", "i" + "+i" * 2000 + " i")
    assert exact.fits("P_X", "i?i:" * 2000 + "i") and not exact.fits("P_X", "i?i:" * 2000)


def test_no_depth_is_too_deep():
    assert valid("x = " + "-" * 20_000 + "1\n", "python") and not valid("x = " + "-" * 20_000 + "\n", "python")
    assert valid("x = " + "(" * 3000 + "1" + ")" * 3000 + "\n", "python") and not valid("x = " + "(" * 3000 + "1" + ")" * 2999 + "\n", "python")


LONG = {
    "typescript": "const a = `one\n${b}\ntwo ${c(`x\n${d}`)}\nthree`;\n/* com\nment } */\nfunction f() {\n  return [\n    1,\n  ];\n}\nlet x = y\nlet z = w\n",
    "c_sharp": "class A\n{\n    /* com\n    ment { */\n    string v = @\"one\n    two\"\"x\n    \";\n    string r = \"\"\"\n    raw { \"\n    \"\"\";\n    void F()\n    {\n        G(1,\n          2);\n        H($@\"a\n {b + $@\"c {\n d}\"} \n e\");\n    }\n}\n",
    "javascript": "const a = `one\n${b\n / 2}${`x${\n{ c: 1 }.d\n}\n`}`\n  / 3\nlet z = w;\n/re/.test(z)\n",
    "python": 'x = f"""one\n{y[\'a\']:>{w}}\n{\n {"k": [\n1]}\n!r}\n""" + \\\n  \'\'\'a\n\\\'\'\'b\'\'\'\nif x:\n\tdef f(a, /,\n  b=(1,\n2)):\n\t\treturn r\'\'\'\n\\x\'\'\'\nelse: pass\n',
}


@pytest.mark.parametrize("lang", sorted(LONG))
@pytest.mark.parametrize("size", [1, 12, 40])
def test_chunks_compose_to_the_whole(lang, size):
    for text in (LONG[lang], LONG[lang][:-3], LONG[lang].replace("1", "1 2", 1), LONG[lang] * 2):
        assert "".join(chunks(text, size)) == text
        assert valid(text, lang, size) == valid(text, lang, 10**6) and (lang != "python" or valid(text, lang) == by_interpreter(text))
        parts = [chunk_map(c, lang, k == 0) for k, c in enumerate(chunks(text, size))]
        both = lambda a, b: Map(lang, compose(a, b, list(a.found)), a.text + b.text)
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = both(left, p)
        for p in reversed(parts[:-1]):
            right = both(p, right)
        assert left.get("") == right.get("")  # associative
    assert valid(LONG[lang], lang)


def test_no_chunk_size_matters(folder):
    import pyarrow.parquet as pq

    ends = {".py": "python", ".ts": "typescript", ".js": "javascript", ".cs": "c_sharp"}
    paths = dict(zip(*(pq.read_table(f"{folder}/files.parquet")[c].to_pylist() for c in ("file_id", "path"))))
    d = pq.read_table(f"{folder}/documents.parquet")
    seen = 0
    for t, f in zip(d["text"].to_pylist(), d["file_id"].to_pylist()):
        if t and (lang := ends.get((paths.get(f) or "")[-3:])):
            seen += 1
            assert len({valid(t, lang, size) for size in (256, 4096, 65536)}) == 1
    assert seen > 50


def test_verdicts_by_chunks(spark):
    rows, want = [], {}
    for k, (text, lang, ok) in enumerate([(LONG["typescript"] * 3, "typescript", True), (LONG["typescript"] * 3 + "}", "typescript", False), (LONG["c_sharp"] * 2, "c_sharp", True), (LONG["c_sharp"] + "class {", "c_sharp", False), ("x = 1\n" * 50, "python", True), ("x = = 1", "python", False), ("", "javascript", True)]):
        rows.append((k, text, lang))
        want[k] = ok
    rows.append((99, None, "python"))
    df = spark.createDataFrame(rows, "doc_id long, text string, code_language string")
    rows += [(200 + k, LONG[lang] * 2, lang) for k, lang in enumerate(sorted(LONG))] + [(300 + k, LONG[lang] * 2 + "(", lang) for k, lang in enumerate(sorted(LONG))]
    want |= {200 + k: True for k in range(len(LONG))} | {300 + k: False for k in range(len(LONG))}
    df = spark.createDataFrame(rows, "doc_id long, text string, code_language string")
    for size, block in ((10, 3), (30, 1), (4096, 64)):  # with blocks that meet by text, and look again at states that they leave
        assert {r.doc_id: r.ok for r in syntax.verdicts(df, size, block).collect()} == want


def test_joins_of_dirty_ids(spark):
    docs = spark.createDataFrame([(1, "def (", "r", " F1"), (2, "x", "r", "f2"), (3, None, "r", "f1"), (4, "x = 1", None, "f1"), (5, "x", "r", None)], "doc_id long, text string, source string, file_id string")
    files = spark.createDataFrame([("f1 ", ".\\a.PY", "extra"), ("F1", "a.PY", "x"), ("f2", "b.md", "x")], "file_id string, path string, text string")
    assert [r.doc_id for r in syntax.p4_found(docs, files.drop("text")).collect()] == [1]
    rates = {(r.source, r.n_files, r.n_invalid) for r in syntax.p4_rates(docs, files.drop("text")).collect()}
    assert rates == {("r", 1, 1), (None, 1, 0)}
