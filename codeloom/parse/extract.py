"""Symbols, imports and calls of source texts, in one pass of Python workers; everything after is relational."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.parse.definitions import Lines, definitions, matches, parse_python
from codeloom.parse.lexer import CONTEXTUAL, ID, LINE, STR, WORDS, lex

SYMBOL = "array<struct<name: string, kind: string, path: string, line_start: int, line_end: int, hash: string, visibility: string, is_async: boolean, is_static: boolean, parameters: array<string>, return_type: string, docstring: string>>"
IMPORT = "array<struct<module_path: string, names: array<string>, is_from_import: boolean, line: int>>"
CALL = "array<struct<callee: string, line: int>>"
SCHEMA = f"file_id string, symbols {SYMBOL}, imports {IMPORT}, calls {CALL}, error string"
_ARROW = pa.schema([
    ("file_id", pa.string()),
    ("symbols", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("hash", pa.string()), ("visibility", pa.string()), ("is_async", pa.bool_()), ("is_static", pa.bool_()), ("parameters", pa.list_(pa.string())), ("return_type", pa.string()), ("docstring", pa.string())]))),
    ("imports", pa.list_(pa.struct([("module_path", pa.string()), ("names", pa.list_(pa.string())), ("is_from_import", pa.bool_()), ("line", pa.int32())]))),
    ("calls", pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32())]))),
    ("error", pa.string()),
])


def _symbol(text_lines: list[str], name: str, kind: str, path: str, a: int, z: int, **more) -> dict:
    digest = hashlib.sha256("\n".join(text_lines[a - 1 : z]).encode()).hexdigest()[:12]
    return {"name": name, "kind": kind, "path": path, "line_start": a, "line_end": z, "hash": digest, "visibility": "public", "is_async": False, "is_static": False, "parameters": [], "return_type": None, "docstring": None} | more


def _visibility(name: str) -> str:
    return "special" if name.startswith("__") and name.endswith("__") else "protected" if name.startswith("_") else "public"


def extract_python(text: str) -> tuple[list, list, list]:
    """Functions, classes, methods and constants in capitals; imports with their names, relative ones with their dots; calls with the whole callee."""
    tree, rows = parse_python(text), text.split("\n")
    symbols: list[dict] = []

    def constant(node: ast.AST, prefix: str) -> None:
        for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(t, ast.Name) and t.id.isupper():
                symbols.append(_symbol(rows, t.id, "constant", prefix + t.id, node.lineno, node.end_lineno))

    def visit(body: list, prefix: str, owner: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = n.args
                params = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
                static = any(getattr(d, "id", "") == "staticmethod" for d in n.decorator_list)
                symbols.append(_symbol(rows, n.name, "method" if owner == "class" else "function", prefix + n.name, n.lineno, n.end_lineno, visibility=_visibility(n.name), is_async=isinstance(n, ast.AsyncFunctionDef), is_static=static, parameters=params, return_type=ast.unparse(n.returns) if n.returns else None, docstring=ast.get_docstring(n)))
                visit(n.body, "", "function")
            elif isinstance(n, ast.ClassDef):
                symbols.append(_symbol(rows, n.name, "class", prefix + n.name, n.lineno, n.end_lineno, visibility=_visibility(n.name), docstring=ast.get_docstring(n)))
                visit(n.body, f"{prefix}{n.name}.", "class")
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                constant(n, prefix if owner == "class" else "")
            else:
                for part in ("body", "orelse", "finalbody"):
                    if isinstance(inner := getattr(n, part, None), list):
                        visit(inner, prefix, owner)
                for part in ("handlers", "cases"):
                    for inner in getattr(n, part, None) or ():
                        visit(inner.body, prefix, owner)

    visit(tree.body, "", "module")
    imports, calls = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"module_path": x.name, "names": [x.asname or x.name], "is_from_import": False, "line": n.lineno} for x in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append({"module_path": "." * n.level + (n.module or ""), "names": [x.name for x in n.names], "is_from_import": True, "line": n.lineno})
        elif isinstance(n, ast.Call):
            calls.append({"callee": ast.unparse(n.func), "line": n.lineno})
    return symbols, imports, calls


def extract_tokens(text: str, lang: str) -> tuple[list, list, list]:
    """Types, functions, methods and constants; imports or usings; calls. Of a text that ends within a token, what comes before."""
    lexed = lex(text, lang)
    toks, rows, lines = lexed.tokens, text.split("\n"), Lines(text)
    codes = [t[0] for t in toks]
    close, n = matches(codes), len(codes)
    W, names = WORDS["cs" if lang == "c_sharp" else "js"], CONTEXTUAL["cs" if lang == "c_sharp" else "js"] | {ID}
    word = lambda i: text[toks[i][1] : toks[i][2]] if 0 <= i < n else ""
    code = lambda i: codes[i] if 0 <= i < n else ""
    line = lambda i: lines.of(toks[min(i, n - 1)][1])
    kinds = {W[k]: k for k in ("class", "interface", "enum", "struct", "record") if k in W}
    symbols, imports, calls, owners = [], [], [], []
    bodies: dict[int, str] = {}  # openings of class bodies, with the class
    openers: list[int] = []
    sharp = lang == "c_sharp"
    access = {W[k] for k in ("public", "private", "protected", "static", "readonly", "declare", "abstract", "override") if k in W}
    accessors = {W[k] for k in ("get", "set", "init") if k in W}
    for i, c in enumerate(codes):
        if c in ("{", "$"):
            openers.append(i)
        elif c == "}" and openers:
            openers.pop()
        inside = bodies.get(openers[-1]) if openers else None
        if inside and not sharp and code(i - 1) in ("{", ";", "}", LINE) and c not in ("}", ";", LINE):
            j = i
            while code(j) in access and code(j + 1) not in (":", "=", ";", "?", "!", "("):
                j += 1
            k = j + 1 + (code(j + 1) in ("?", "!"))
            if (code(j) in names or code(j) == "#") and code(k) in (":", "=", ";", LINE, "}"):
                symbols.append(_symbol(rows, word(j).lstrip("#"), "property", f"{inside}.{word(j)}", line(i), line(k)))
        elif inside and sharp and c in names and code(i + 1) == "{" and (code(i + 2) in accessors or code(i + 3) in accessors):
            symbols.append(_symbol(rows, word(i), "property", f"{inside}.{word(i)}", line(i), line(close.get(i + 1, i + 1))))
        elif inside and sharp and c == W["const"]:
            j = i + 1
            while j < n and codes[j] not in ("=", ";", "}"):
                j += 1
            if code(j) == "=" and code(j - 1) in names:
                symbols.append(_symbol(rows, word(j - 1), "constant", f"{inside}.{word(j - 1)}", line(i), line(j)))
        after_dot = code(i - 1) in (".", "q", ":", "<", ",")
        if c in kinds and code(i + 1) in names and not after_dot:
            j = i + 2
            while j < n and codes[j] not in ("{", ";"):
                j = close.get(j, j) + 1
            end = close.get(j, j)
            if c in (W["class"], W.get("struct"), W.get("record")):
                bodies[j] = word(i + 1)
            kind = {"record": "class"}.get(kinds[c], kinds[c])
            symbols.append(_symbol(rows, word(i + 1), kind, word(i + 1), line(i), line(end)))
            owners.append((line(i), line(end), word(i + 1)))
        elif not sharp and c == W["type"] and code(i + 1) in names and code(i + 2) in ("=", "<") and not after_dot:
            symbols.append(_symbol(rows, word(i + 1), "type", word(i + 1), line(i), line(i)))
        elif not sharp and c in (W["const"], W["let"], W["var"]) and code(i + 1) in names and code(i + 2) == "=" and (word(i + 1).isupper() or code(i + 3) in ("n", "S", "T")):
            symbols.append(_symbol(rows, word(i + 1), "constant", word(i + 1), line(i), line(i)))
        elif not sharp and c == W["import"] and code(i - 1) not in (".", "="):
            j, found = i + 1, []
            while j < n and codes[j] not in (STR, ";", "(", "="):
                if codes[j] in names and code(j - 1) != W["as"] and word(j) not in ("from", "type", "as") or code(j - 1) == W["as"] and code(j - 2) == "*":
                    found.append(("* as " if code(j - 2) == "*" else "") + word(j))
                j += 1
            if code(j) == STR:
                imports.append({"module_path": word(j)[1:-1], "names": found, "is_from_import": True, "line": line(i)})
        elif sharp and c == W["using"] and code(i + 1) in names and code(i - 1) in ("", ";", "{"):
            j = i + 1
            while j < n and codes[j] != ";":
                j += 1
            imports.append({"module_path": "".join(word(x) for x in range(i + 1, j)).split("=")[-1], "names": [], "is_from_import": False, "line": line(i)})
        elif c == "(" and code(i - 1) in names:
            j = i - 1
            while code(j - 1) == "." and (code(j - 2) in names or word(j - 2) == "this"):
                j -= 2
            calls.append({"callee": "".join(word(x) for x in range(j, i)), "line": line(i)})
    found = definitions(text, lang, lexed, lines)
    heads = {(d.line, d.name) for d in found}
    for d in found:
        owner = next((o for a, z, o in sorted(owners, key=lambda o: o[1] - o[0]) if a <= d.line <= z), None) if d.kind == "method" else None
        first = rows[d.line - 1] if d.line <= len(rows) else ""
        seen = next((v for v in ("public", "private", "protected", "internal") if f"{v} " in first), "private" if lang == "c_sharp" else "public")
        symbols.append(_symbol(rows, d.name, d.kind, f"{owner}.{d.name}" if owner else d.name, d.line, d.end, visibility=seen, is_async="async " in first, is_static="static " in first, parameters=d.parameters))
    calls = [c for c in calls if (c["line"], c["callee"]) not in heads]
    return sorted(symbols, key=lambda s: (s["line_start"], -s["line_end"])), imports, calls


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, t, lang in zip(*(b.column(c).to_pylist() for c in ("file_id", "content", "language"))):
            try:
                s, m, c = extract_python(t or "") if lang == "python" else extract_tokens(t or "", lang)
                out.append({"file_id": i, "symbols": s, "imports": m, "calls": c, "error": None})
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                out.append({"file_id": i, "symbols": [], "imports": [], "calls": [], "error": str(e)[:200]})
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def extract(files: DataFrame) -> DataFrame:
    """(file_id, symbols, imports, calls, error) of files (file_id, language, content) in python, typescript, javascript or c_sharp. A text that cannot be parsed keeps its row with the error; a null text is empty."""
    return files.where(F.col("language").isin("python", "typescript", "javascript", "c_sharp")).select("file_id", "content", "language").mapInArrow(_run, SCHEMA)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    """A row for each symbol, with its place among the file's (ordinal). Symbols with one path and hash in a file count once."""
    rows = parsed.select("file_id", F.posexplode("symbols").alias("ordinal", "s")).select("file_id", "ordinal", "s.*")
    return rows.groupBy("file_id", "path", "hash").agg(F.min("ordinal").alias("ordinal"), *[F.min_by(c, "ordinal").alias(c) for c in rows.columns if c not in ("file_id", "path", "hash", "ordinal")])


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*")


#: Lines of one bucket, when calls meet the symbols around them.
BUCKET = 64


def call_rows(parsed: DataFrame) -> DataFrame:
    """(file_id, callee, line, caller_path): calls with the innermost function or method whose lines hold them."""
    calls = parsed.select("file_id", F.explode("calls").alias("c")).select("file_id", "c.*")
    s = symbol_rows(parsed).where("kind in ('function', 'method')").select("file_id", "path", "line_start", "line_end")
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))
    at = calls.select("file_id", "line").distinct().withColumn("bucket", F.floor(F.col("line") / BUCKET))
    inner = at.join(s, ["file_id", "bucket"]).where("line between line_start and line_end").groupBy("file_id", "line").agg(F.max_by("path", "line_start").alias("caller_path"))
    return calls.join(inner, ["file_id", "line"], "left")
