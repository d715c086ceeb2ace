"""Functions and methods of source texts: names, kinds, places and parameters."""

from __future__ import annotations

import ast
import warnings
from bisect import bisect_right
from typing import NamedTuple

from codeloom.parse.lexer import ARROW, CONTEXTUAL, HOLE, ID, LINE, PRIV, WORDS, Lexed

_JS, _CS = WORDS["js"], WORDS["cs"]
_JS_ID, _CS_ID = CONTEXTUAL["js"] | {ID}, CONTEXTUAL["cs"] | {ID}
_JS_MODS = {_JS[w] for w in "public private protected static readonly abstract override declare accessor".split()}
_CS_MODS = {_CS[w] for w in "public private protected internal static abstract sealed virtual override readonly extern new partial async unsafe volatile required file".split()}
_CS_PREDEF = {_CS[w] for w in "bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split()}
_PAIRS = {"(": ")", "[": "]", "{": "}", HOLE: "}"}


class Definition(NamedTuple):
    name: str
    kind: str  # function or method
    line: int  # on which the definition itself begins
    head: int  # on which its decorators or attributes begin
    end: int
    parameters: list[str]
    docstring: str | None  # of python
    depth: int


def parse_python(text: str) -> ast.Module:
    """The syntax tree; raises SyntaxError or ValueError where the text breaks the grammar. A leading byte order mark is no part of it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text[1:] if text[:1] == "﻿" else text)


def python_definitions(tree: ast.Module) -> list[Definition]:
    out: list[Definition] = []

    def visit(body: list, owner: str, depth: int) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = {d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", "") for d in node.decorator_list}
                if not marks & {"property", "cached_property", "setter", "getter", "deleter"}:
                    a = node.args
                    params = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
                    head = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    out.append(Definition(node.name, "method" if owner == "class" else "function", node.lineno, head, node.end_lineno, params, ast.get_docstring(node, clean=False), depth))
                visit(node.body, "function", depth + 1)
            elif isinstance(node, ast.ClassDef):
                visit(node.body, "class", depth + 1)
            else:
                for part in ("body", "orelse", "finalbody"):
                    if isinstance(inner := getattr(node, part, None), list):
                        visit(inner, owner, depth)
                for part in ("handlers", "cases"):
                    for inner in getattr(node, part, None) or ():
                        visit(inner.body, owner, depth)

    visit(tree.body, "module", 0)
    return out


def matches(codes: list[str]) -> dict[int, int]:
    """The closing place of each opening bracket."""
    out, stack = {}, []
    for i, c in enumerate(codes):
        if c in _PAIRS:
            stack.append(i)
        elif c in ")]}" and stack:
            out[stack.pop()] = i
    return out


class Lines:
    def __init__(self, text: str):
        self.at = _newlines(text)

    def of(self, pos: int) -> int:
        return bisect_right(self.at, pos - 1) + 1


def _newlines(text: str) -> list[int]:
    out, i = [], text.find("\n")
    while i >= 0:
        out.append(i)
        i = text.find("\n", i + 1)
    return out


def definitions(text: str, lang: str, lexed: Lexed, lines: Lines) -> list[Definition]:
    """Of a valid typescript, javascript or c_sharp text. Constructors, accessors and properties are none, nor are signatures without a body (but abstract methods are)."""
    return (_cs if lang == "c_sharp" else _js)(text, lexed.tokens, lines)


def _params(text: str, toks: list, a: int, z: int, last: bool) -> list[str]:
    """Names of the parameters between the brackets at a and z: the first name of each, or the last before any default."""
    out, depth, name, done = [], 0, None, False
    for code, s, e in toks[a + 1 : z]:
        if code in "([{$<":
            depth += 1
        elif code in ")]}>":
            depth -= 1
        elif depth == 0 and code == ",":
            out += [name] if name else []
            name, done = None, False
        elif depth == 0 and code in ("=", ":"):
            done = True
        elif depth == 0 and not done and (code in _CS_ID or code in _JS_ID) and (last or name is None):
            name = text[s:e]
    return out + ([name] if name else [])


def _js(text: str, toks: list, lines: Lines) -> list[Definition]:
    codes = [t[0] for t in toks]
    close, n = matches(codes), len(codes)
    at = lambda i: codes[i] if 0 <= i < n else ""
    out: list[Definition] = []
    classes = set()  # openings of class bodies
    W = _JS

    def add(name_at: int, kind: str, first: int, head: int, args: int | None, end: int, depth: int) -> None:
        params = _params(text, toks, args, close[args], False) if args in close else []
        out.append(Definition(text[toks[name_at][1] : toks[name_at][2]].lstrip("#"), kind, lines.of(toks[first][1]), lines.of(toks[head][1]), lines.of(toks[min(end, n - 1)][1]), params, None, depth))

    def skip_type(i: int, stops: str) -> int:
        """The place of the first of stops outside of brackets, from i."""
        while i < n and at(i) not in stops and at(i) not in (";", LINE, ")", "]", "}"):
            i = close.get(i, i) + 1
        return i

    def skip_angles(i: int) -> int:
        depth = 0
        while i < n:
            depth += (codes[i] == "<") - (codes[i] == ">")
            i = close.get(i, i) + 1
            if not depth:
                return i
        return i

    def function_value(i: int) -> tuple[int, int] | None:
        """(opening of the parameters or -1, end) of an arrow function or function expression at i."""
        if at(i) == W["async"] and at(i + 1) not in (ARROW, ",", ";"):
            i += 1
        if at(i) == W["function"]:
            while at(i) not in ("(", ""):
                i += 1
            body = skip_type(close[i] + 1, "{")
            return i, close.get(body, body)
        if at(i) in _JS_ID and at(i + 1) == ARROW:
            return -1, body_end(i + 2)
        if at(i) == "<":
            i = skip_angles(i)
        if at(i) == "(" and i in close:
            j = close[i] + 1
            if at(j) == ":":
                j = skip_type(j + 1, ARROW)
            if at(j) == ARROW:
                return i, body_end(j + 1)
        return None

    def body_end(i: int) -> int:
        return close.get(i, i) if at(i) == "{" else skip_type(i, ",")

    depth = 0
    openers: list[int] = []
    for i, c in enumerate(codes):
        if c in ("{", HOLE):
            openers.append(i)
        elif c == "}" and openers:
            openers.pop()
        depth = len(openers)
        if c == W["class"] and at(i - 1) not in (".", "q"):
            j = i + 1
            while j < n and codes[j] != "{":
                j = close.get(j, j) + 1
            classes.add(j)
        elif c == W["function"] and at(i - 1) not in (".", "q"):
            j = i + 1 + (at(i + 1) == "*")
            if at(j) in _JS_ID:
                k = j + 1
                if at(k) == "<":
                    k = skip_angles(k)
                if at(k) == "(" and k in close:
                    body = skip_type(close[k] + 1, "{")
                    if at(body) == ":":
                        body = skip_type(body + 1, "{")
                    if at(body) == "{":
                        first = i
                        while at(first - 1) in (W["async"], W["export"], W["default"], W["declare"]):
                            first -= 1
                        if at(first - 1) != "=":
                            add(j, "function", first, first, k, close.get(body, body), depth)
        elif c in (W["const"], W["let"], W["var"]) and at(i + 1) in _JS_ID:
            j = skip_type(i + 2, "=") if at(i + 2) in (":", "!") else i + 2
            if at(j) == "=" and (f := function_value(j + 1)):
                first = i - 1 if at(i - 1) == W["export"] else i
                add(i + 1, "function", first, first, f[0], f[1], depth)
        if openers and openers[-1] in classes and (i - 1 == openers[-1] or at(i - 1) in (";", LINE, "}")) and c not in ("}", ";", LINE):
            head = j = i
            while at(j) == "@":
                j += 1
                while at(j + 1) == ".":
                    j += 2
                j = close.get(j + 1, j) + 1 if at(j + 1) == "(" or at(j) == "(" else j + 1
                if at(j) == LINE:
                    j += 1
            first = j
            while (at(j) in _JS_MODS or at(j) == W["async"]) and at(j + 1) not in ("(", "=", ":", "?", "!", ";", "<", LINE, "}"):
                j += 1
            abstract = W["abstract"] in codes[first:j]
            if at(j) in (W["get"], W["set"]) and at(j + 1) not in ("(", "=", ":", "?", "!", ";", "<", LINE, "}"):
                continue
            j += at(j) == "*"
            if not (at(j) in W.values() or at(j) in (ID, PRIV)):
                continue
            name, k = j, j + 1 + (at(j + 1) in ("?", "!"))
            if at(k) == "<":
                k = skip_angles(k)
            if at(k) == "(" and k in close:
                body = skip_type(close[k] + 1, "{") if at(close[k] + 1) != ":" else _after_type(codes, close, close[k] + 2)
                if text[toks[name][1] : toks[name][2]] != "constructor" and (at(body) == "{" or abstract):
                    add(name, "method", first, head, k, close.get(body, body), depth)
            else:
                k = skip_type(k, "=") if at(k) == ":" else k
                if at(k) == "=" and (f := function_value(k + 1)):
                    add(name, "method", first, head, f[0], f[1], depth)
    return out


def _after_type(codes: list[str], close: dict[int, int], i: int) -> int:
    """The place of the body after a return type at i; a brace at the beginning of a type is a type."""
    fresh = True
    while i < len(codes):
        c = codes[i]
        if c == "{" and not fresh:
            return i
        if c in (";", LINE, "}"):
            return i
        fresh = c in ("&", "|", ARROW, "<", ",") or c in (_JS["extends"], _JS["is"])
        i = close.get(i, i) + 1
    return i


def _cs(text: str, toks: list, lines: Lines) -> list[Definition]:
    codes = [t[0] for t in toks]
    close, n = matches(codes), len(codes)
    at = lambda i: codes[i] if 0 <= i < n else ""
    W = _CS
    kinds: dict[int, str] = {}  # what opens at a brace
    types = {W["class"]: "class", W["struct"]: "class", W["record"]: "class", W["interface"]: "interface"}
    out: list[Definition] = []
    openers: list[int] = []
    for i, c in enumerate(codes):
        if c in ("{", HOLE):
            openers.append(i)
        elif c == "}" and openers:
            openers.pop()
        if (c in types and at(i + 1) in _CS_ID or c == W["namespace"]) and at(i - 1) not in (":", ",", "."):
            j = i + 1
            while j < n and codes[j] not in ("{", ";"):
                j = close.get(j, j) + 1
            if at(j) == "{":
                kinds.setdefault(j, types.get(c, "namespace"))
        where = kinds.get(openers[-1], "block") if openers else "top"
        if where in ("interface", "namespace") or at(i - 1) not in ("{", "}", ";", "") or c in ("}", ";", "{"):
            continue
        head = j = i
        while at(j) == "[" and j in close:
            j = close[j] + 1
        first = j
        while at(j) in _CS_MODS and at(j + 1) not in ("(", "=", ";", "."):
            j += 1
        begin = j
        if at(j) == "(" and j in close:
            j = close[j] + 1
        while j < n and (codes[j] in _CS_ID or codes[j] in _CS_PREDEF or codes[j] in (".", ",", "<", ">", "?", "[", "*", W["ref"], W["readonly"])):
            j = close.get(j, j) + 1
        if at(j) != "(" or j not in close or j == begin:
            continue
        k = j - 1
        if at(k) == ">":
            depth = 0
            while k > begin:
                depth += (codes[k] == ">") - (codes[k] == "<")
                k -= 1
                if not depth:
                    break
        if at(k) not in _CS_ID or k == begin or at(k - 1) in (",", "<", "["):
            continue
        p = k
        while at(p - 1) == ".":  # the name of an interface
            p -= 2
        if p <= begin:
            continue
        body = close[j] + 1
        while body < n and codes[body] not in ("{", ";", ARROW, "}"):
            body = close.get(body, body) + 1
        if at(body) in ("{", ARROW) or at(body) == ";" and where == "class":
            end = close.get(body, body) if at(body) == "{" else body
            while at(end) not in (";", "}", "") and at(body) == ARROW:
                end = close.get(end, end) + 1
            out.append(Definition(text[toks[k][1] : toks[k][2]], "method" if where == "class" else "function", lines.of(toks[first][1]), lines.of(toks[head][1]), lines.of(toks[min(end, n - 1)][1]), _params(text, toks, j, close[j], True), None, len(openers)))
    return out
