"""Tokens of typescript, javascript, c_sharp and python texts, from any state in which a piece of a text may begin.

A token is (code, start, end): code is one character naming its kind, so that a token sequence is a string. Words that matter to a grammar have a code of
their own, brackets and single-character operators stand for themselves. A hole in a template or interpolated string opens with $ and closes as a brace does. N is a line end between two tokens that cannot stand on one line
(javascript ends statements there). Of python, each line begins with MARK and its indentation. Comments are kept apart.

A state is a mode and, after a bar, what is open around it from the outside in: of each hole the number of braces open in it (c_sharp: with v where its string is verbatim), of python the strings and
holes that nest. Modes: "" code, "/" code after a value (a slash divides), "c" a comment, "t" a template before its first hole, "m" after one, "v" a verbatim string, "i" an interpolated verbatim one,
"r3" a raw one of so many quotes, "s" and quotes and flags a python string, "x" the text or format of a python f-string, "error" what no state leads out of.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from unicodedata import lookup

# Reserved words, and words with a meaning in certain places (they are identifiers elsewhere).
JS_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let static yield await implements interface package private protected public".split()
JS_CONTEXTUAL = "async of get set from as type namespace module declare abstract readonly keyof infer is satisfies override accessor unique asserts global using out".split()
CS_RESERVED = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
CS_CONTEXTUAL = "add alias and ascending async await by descending equals file from get global group init into join let not on or orderby partial record remove required scoped select set unmanaged var when where with yield".split()

PY_RESERVED = "None True False and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PY_CONTEXTUAL = "match case type".split()

#: A line of python begins: followed by two characters that tell its indentation, with tabs up to the next eighth column and with tabs as one.
MARK = "\ue010"
ID, NUM, STR, REGEX, TEMPLATE, PRIV, BIN, ASSIGN, ARROW, INC, DOTS, NULLDOT, LINE, HOLE = "inSrT#baAIdqN$"


def _codes(words: list[str]) -> dict[str, str]:
    return {w: chr(0x4E00 + k) for k, w in enumerate(sorted(words))}


WORDS = {"js": _codes(JS_RESERVED + JS_CONTEXTUAL), "cs": _codes(CS_RESERVED + CS_CONTEXTUAL), "py": _codes(PY_RESERVED + PY_CONTEXTUAL)}
# words that no grammar tells apart share a code
WORDS["js"] |= dict.fromkeys("null true false".split(), WORDS["js"]["null"])
WORDS["cs"] |= dict.fromkeys("bool byte char decimal double float int long object sbyte short string uint ulong ushort".split(), WORDS["cs"]["int"])
WORDS["cs"] |= dict.fromkeys("public private protected internal abstract sealed virtual override volatile".split(), WORDS["cs"]["public"])
WORDS["cs"] |= dict.fromkeys("null true false".split(), WORDS["cs"]["null"])
WORDS["py"] |= dict.fromkeys("None True False".split(), WORDS["py"]["None"])
WORDS["ts"] = WORDS["js"]
CONTEXTUAL = {"js": {WORDS["js"][w] for w in JS_CONTEXTUAL}, "cs": {WORDS["cs"][w] for w in CS_CONTEXTUAL}, "py": {WORDS["py"][w] for w in PY_CONTEXTUAL}}
CONTEXTUAL["ts"] = CONTEXTUAL["js"]

_NAME = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|[‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_JS = re.compile(
    rf"""[ \t]*+(?:(?P<skip>[\s﻿]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/|(?<![\s\S])\#!.*)
    |(?P<id>{_NAME})|(?P<priv>\#{_NAME})
    |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<op>=>|\.\.\.|\?\.(?!\d)|\+\+|--|===?|!==?|<=|>=(?!=)|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\*\*=|\*\*|<<=|<<|[-+*%&|^]=|[-+*%&|^<>=!~?:;,.@()\[\]{{}}])|(?P<slash>/)|(?P<tick>`)|(?P<eof>\Z))""",
    re.X,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[dgimsuvy]*(?![\w$])")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JS_OPS = {"=>": ARROW, "...": DOTS, "?.": NULLDOT, "++": INC, "--": INC, "-": "+", "~": "~", "%": BIN, "^": BIN} | {o: BIN for o in "== === != !== <= >= && || ?? ** <<".split()} | {o: ASSIGN for o in "&&= ||= ??= **= <<= -= += *= %= &= |= ^= /=".split()}

_CS = re.compile(
    r"""[ \t]*+(?:(?P<skip>[\s﻿]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|(?<!\S)\#[ \t]*(?:if|elif|else|endif|define|undef|region|endregion|pragma|nullable|line|error|warning)\b[^\n]*)
    |(?P<raw>\$*\"{3,})|(?P<verb>@"(?:[^"]|"")*+"(?:u8)?)|(?P<interp>\$@"|@\$"|\$")
    |(?P<id>@?[^\W\d]\w*)
    |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uUlLfFdDmM]{0,2})(?!\w))
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"(?:u8)?|'(?:\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|[^\n\r])|[^'\\\n\r])')
    |(?P<op>=>|\?\?=|\?\?|\+\+|--|->|::|\.\.|==|!=|<=|>=|&&|\|\||<<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!~?:;,.()\[\]{}])|(?P<eof>\Z))""",
    re.X,
)
_CS_HOLE_TEXT = {False: re.compile(r'(?:[^"\\{}\n\r]|\\.|\{\{|\}\})*'), True: re.compile(r'(?:[^"{}]|""|\{\{|\}\})*')}
_CS_VERBATIM = re.compile(r'(?:[^"]|"")*+"(?:u8)?')
_CS_OPS = {"=>": ARROW, "-": "+", "++": INC, "--": INC, "->": ".", "::": ".", "..": DOTS, "/": BIN, "%": BIN, "??": BIN, "==": BIN, "!=": BIN, "&&": BIN, "||": BIN, "<=": BIN, ">=": BIN, "<<": BIN} | {o: ASSIGN for o in "??= <<= -= += *= /= %= &= |= ^=".split()}

_JSW = WORDS["js"]
#: Kinds after which a value has ended, so that a slash divides.
_ENDS = {ID, NUM, STR, REGEX, TEMPLATE, PRIV, ")", "]", "}", INC} | {_JSW[w] for w in "this super null true false".split()} | CONTEXTUAL["js"]
_LINE_ENDS = _ENDS | {_JSW[w] for w in "break continue debugger return".split()}
_LINE_STARTS = {ID, NUM, STR, PRIV, "@", "!", "~", INC} | (set(_JSW.values()) - {_JSW[w] for w in "in instanceof of as is extends implements satisfies from else catch finally".split()})


class Lexed(NamedTuple):
    tokens: list[tuple[str, int, int]]
    comments: list[tuple[int, int]]
    state: str  # in which the text ends

    @property
    def error(self) -> bool:
        return self.state not in ("", "/")


def lex(text: str, lang: str, state: str = "") -> Lexed:
    """The tokens of a text, or of a piece of one that begins in a state."""
    mode, _, around = state.partition("|")
    stack = around.split(",") if around else []
    return {"c_sharp": _lex_cs, "python": _lex_py}.get(lang, _lex_js)(text, mode, stack)


def joined(mode: str, stack: list[str]) -> str:
    return f"{mode}|{','.join(stack)}" if stack else mode


def _counts(depth: int, holes: list[int]) -> list[int]:
    """The braces open in each hole, from the depths at which holes opened and the present one."""
    return [(holes[k + 1] - 1 if k + 1 < len(holes) else depth) - h for k, h in enumerate(holes)]


def _lex_js(text: str, mode: str, stack: list[str]) -> Lexed:
    tokens: list[tuple[str, int, int]] = []
    comments: list[tuple[int, int]] = []
    holes: list[int] = []  # depths of braces at which template holes opened
    depth = pos = 0
    for c in stack:
        holes.append(depth + 1)
        depth += 1 + int(c)
    prev, newline = ID if mode == "/" else "", False
    n, add, match, words = len(text), tokens.append, _JS.match, _JSW

    def ends(mode: str) -> Lexed:
        return Lexed(tokens, comments, mode if mode == "error" else joined(mode, [str(c) for c in _counts(depth, holes)]))

    if mode == "c":
        if (pos := text.find("*/") + 2) < 2:
            return ends("c")
        comments.append((0, pos))
        newline = "\n" in text[:pos]
    elif mode in ("t", "m"):
        end = _JS_TEMPLATE.match(text).end()
        if end >= n:
            return ends(mode)
        if text[end] == "`":
            add((TEMPLATE if mode == "t" else "`", 0, end + 1))
            pos, prev = end + 1, TEMPLATE
        else:
            if mode == "t":
                add(("`", 0, end))
            depth += 1
            holes.append(depth)
            add((HOLE, end, end + 2))
            pos, prev = end + 2, "{"
    while pos < n:
        m = match(text, pos)
        if m is None:
            return ends("error")
        kind = m.lastgroup
        pos, end = m.span(kind)
        if kind == "eof":
            break
        if kind == "skip":
            if text[pos] == "/":
                comments.append((pos, end))
                newline = newline or text[pos + 1] == "*" and "\n" in text[pos:end]
            elif "\n" in text[pos:end] or "\r" in text[pos:end]:
                newline = True
            pos = end
            continue
        if kind == "id":
            code = words.get(m[kind], ID)
        elif kind == "op":
            o = m[kind]
            code = _JS_OPS.get(o, o)
            if o == "{":
                depth += 1
            elif o == "}":
                if holes and holes[-1] == depth:  # back in the template
                    holes.pop()
                    add(("}", pos, end))
                    depth -= 1
                    pos = _JS_TEMPLATE.match(text, end).end()
                    if pos >= n:
                        return ends("m")
                    if text[pos] == "`":
                        add(("`", end, pos + 1))
                        pos, prev = pos + 1, TEMPLATE
                    else:
                        depth += 1
                        holes.append(depth)
                        add((HOLE, pos, pos + 2))
                        pos, prev = pos + 2, "{"
                    newline = False
                    continue
                depth -= 1
        elif kind == "num":
            code = NUM
        elif kind == "str":
            code = STR
        elif kind == "priv":
            code = PRIV
        elif kind == "slash":
            if text.startswith("/*", pos):
                return ends("c")
            if prev in _ENDS:
                code = BIN
                if text[end : end + 1] == "=":
                    code, end = ASSIGN, end + 1
            else:
                r = _JS_REGEX.match(text, pos)
                if r is None:
                    return ends("error")
                code, end = REGEX, r.end()
        else:  # a template begins
            end = _JS_TEMPLATE.match(text, pos + 1).end()
            if end >= n:
                return ends("t")
            newline = False
            if text[end] == "`":
                add((TEMPLATE, pos, end + 1))
                pos, prev = end + 1, TEMPLATE
            else:
                add(("`", pos, end))
                depth += 1
                holes.append(depth)
                add((HOLE, end, end + 2))
                pos, prev = end + 2, "{"
            continue
        if newline:
            if code in _LINE_STARTS and prev in _LINE_ENDS:
                add((LINE, pos, pos))
            newline = False
        add((code, pos, end))
        prev, pos = code, end
    return ends("/" if prev in _ENDS else "")


def _lex_cs(text: str, mode: str, stack: list[str]) -> Lexed:
    tokens: list[tuple[str, int, int]] = []
    comments: list[tuple[int, int]] = []
    holes: list[tuple[int, bool]] = []
    depth = pos = 0
    for c in stack:
        holes.append((depth + 1, c.endswith("v")))
        depth += 1 + int(c.rstrip("v"))
    n, add, match, words = len(text), tokens.append, _CS.match, WORDS["cs"]

    def ends(mode: str) -> Lexed:
        if mode == "error":
            return Lexed(tokens, comments, mode)
        return Lexed(tokens, comments, joined(mode, [f"{c}{'v' if v else ''}" for c, (_, v) in zip(_counts(depth, [h for h, _ in holes]), holes)]))

    def string_on(at: int, verbatim: bool) -> int:
        """Adds what follows the text of an interpolated string at `at`; -1 where it never ends, -2 where it may in what follows."""
        nonlocal depth
        end = _CS_HOLE_TEXT[verbatim].match(text, at).end()
        if end >= n and verbatim:
            return -2
        if end >= n or text[end] in "}\n\r":
            return -1
        if text[end] == '"':
            add(("`", end, end + 1))
            return end + 1
        depth += 1
        holes.append((depth, verbatim))
        add((HOLE, end, end + 1))
        return end + 1

    if mode == "c":
        if (pos := text.find("*/") + 2) < 2:
            return ends("c")
        comments.append((0, pos))
    elif mode == "v":
        if not (m := _CS_VERBATIM.match(text)):
            return ends("v")
        pos = m.end()
        add((STR, 0, pos))
    elif mode[:1] == "r":
        quotes = '"' * int(mode[1:])
        if (pos := text.find(quotes)) < 0:
            return ends(mode)
        pos += len(quotes)
        while text[pos : pos + 1] == '"':
            pos += 1
        add((STR, 0, pos))
    elif mode == "i" and (pos := string_on(0, True)) < 0:
        return ends("i" if pos == -2 else "error")
    while pos < n:
        m = match(text, pos)
        if m is None:
            return ends("v" if text[pos:].lstrip(" \t").startswith('@"') else "error")
        kind = m.lastgroup
        pos, end = m.span(kind)
        if kind == "eof":
            break
        if kind == "skip":
            if text[pos] == "/":
                comments.append((pos, end))
            pos = end
            continue
        if kind == "id":
            code = words.get(m[kind], ID)
        elif kind == "op":
            if text.startswith("/*", pos):
                return ends("c")
            o = m[kind]
            code = _CS_OPS.get(o, o)
            if o in "([{":
                depth += 1
            elif o in ")]}" or o == ":":
                if holes and holes[-1][0] == depth and o in "}:" and not (o == ":" and text[end : end + 1] == ":"):
                    d, verbatim = holes[-1]
                    if o == ":":  # a format, up to the end of the hole
                        close = text.find("}", end)
                        if close < 0:
                            return ends("error")
                        end, pos = close + 1, close
                    holes.pop()
                    depth -= 1
                    add(("}", pos, end))
                    pos = string_on(end, verbatim)
                    if pos < 0:
                        return ends("i" if pos == -2 else "error")
                    continue
                if o != ":":
                    depth -= 1
        elif kind == "num":
            code = NUM
        elif kind in ("str", "verb"):
            code = STR
        elif kind == "raw":
            quotes = m[kind].lstrip("$")
            close = text.find(quotes, end)
            if close < 0:
                return ends(f"r{len(quotes)}")
            end = close + len(quotes)
            while text[end : end + 1] == '"':
                end += 1
            code = STR
        else:
            add(("`", pos, end))
            pos = string_on(end, "@" in m[kind])
            if pos < 0:
                return ends("i" if pos == -2 else "error")
            continue
        add((code, pos, end))
        pos = end
    return ends("")


_DIGITS = r"\d(?:_?\d)*"
_PY = re.compile(
    rf"""[ \t\f]*+(?:(?P<skip>\\(?:\r\n|\r|\n))|(?P<line>(?:\#[^\n\r]*)?(?:\r\n|\r|\n)|\#[^\n\r]*)
    |(?P<str>(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"|\'\'\'|"|'))|(?P<id>(?:[^\W\d]|[^\x00-\x7f])(?:\w|[^\x00-\x7f])*)
    |(?P<num>(?>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_DIGITS})?\.{_DIGITS}(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}\.(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}(?:[eE][+-]?{_DIGITS}[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b)))
    |(?P<op>\.\.\.|->|:=|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|[-+*/%&|^@]=|==|!=|<=|>=|[-+*/%&|^@<>~=:;,.()\[\]{{}}!])|(?P<eof>\Z))""",
    re.X,
)
_PY_OPS = {"...": DOTS, "->": ARROW, ":=": "w", "**": "X", "-": "+"} | {o: ASSIGN for o in "**= //= <<= >>= -= += *= /= %= &= |= ^= @=".split()} | {o: BIN for o in "// << >> % & ^".split()} | {o: "c" for o in "== != <= >= < >".split()}
_PY_INDENT = re.compile(r"(?:[ \t\f]*(?:\#[^\n\r]*)?(?:\r\n|\r|\n))*(?:[ \t\f]*\#[^\n\r]*\Z)?([ \t\f]*)(?=[^\n\r#]|\Z)")
#: The rest of a string by its quotes: up to them, over escapes.
_PY_REST = {q: re.compile(rf"(?:[^\\{q[0]}{chr(10) + chr(13) if len(q) == 1 else ''}]|\\(?:\r\n|[\s\S])" + (rf"|{q[0]}(?!{q[0]}{{2}})" if len(q) == 3 else "") + rf")*+{q}") for q in ('"', "'", '"""', "'''")}
_PY_BAD_ESCAPE = re.compile(r"\\(?:\\|x(?![0-9a-fA-F]{2})(?P<x>)|u(?![0-9a-fA-F]{4})(?P<u>)|U(?!(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})(?P<w>)|N(?:\{(?P<name>[^}]*)\}|(?P<n>)))?")
_WIDE = 60_000


def _py_escapes(body: str, raw: bool, is_bytes: bool) -> bool:
    """Whether the escapes and characters of a string are ones that the language has."""
    if is_bytes and not body.isascii():
        return False
    if raw or "\\" not in body:
        return True
    for m in _PY_BAD_ESCAPE.finditer(body):
        if m["x"] is not None or not is_bytes and (m["u"] is not None or m["w"] is not None or m["n"] is not None):
            return False
        if m["name"] is not None and not is_bytes:
            try:
                lookup(m["name"])
            except KeyError:
                return False
    return True


@lru_cache(4096)
def _mark(space: str) -> str:
    col = alt = 0
    for c in space:
        col, alt = (0, 0) if c == "\f" else (col // 8 * 8 + 8, alt + 1) if c == "\t" else (col + 1, alt + 1)
    return MARK + chr(0xF0000 + min(col, _WIDE)) + chr(0xF0000 + min(alt, _WIDE))


def _lex_py(text: str, mode: str, stack: list[str]) -> Lexed:
    """Frames nest: an f-string (its quotes and r where it is raw), a hole in it with the brackets open there, p the format of a hole."""
    tokens: list[tuple[str, int, int]] = []
    comments: list[tuple[int, int]] = []
    frames: list[str | int] = [int(x) if x.isdigit() else x for x in stack]
    n, add, match, words, pos = len(text), tokens.append, _PY.match, WORDS["py"], 0

    def ends(mode: str) -> Lexed:
        return Lexed(tokens, comments, mode if mode == "error" else joined(mode, [str(x) for x in frames]))

    def line_at(pos: int) -> int:
        m = _PY_INDENT.match(text, pos)
        if m.end() < n:
            add((_mark(m[1]), m.start(1), m.end()))
        return m.end()

    if "\0" in text:
        return ends("error")
    if mode[:1] == "s":
        q, flags = (mode[1:4], mode[4:]) if mode[1:4] in _PY_REST else (mode[1:2], mode[2:])
        m = _PY_REST[q].match(text)
        body = text if m is None else m[0][: -len(q)]
        if not _py_escapes(body, "r" in flags, "b" in flags):
            return ends("error")
        if m is None:
            return ends(mode)
        pos = m.end()
        add(("y" if "b" in flags else STR, 0, pos))
    elif mode != "x":
        pos = line_at(0)
    while pos < n or frames and isinstance(frames[-1], str):
        if frames and isinstance(frames[-1], str):  # the text of an f-string, or the format of a hole
            spec = frames[-1] == "p"
            own = next(x for x in reversed(frames) if isinstance(x, str) and x != "p")
            raw, q = own.endswith("r"), own.rstrip("r")
            start = pos
            while True:
                if pos >= n:
                    return ends("x") if len(q) == 3 and _py_escapes(text[start:], raw, False) else ends("error")
                c = text[pos]
                if c == "\\":
                    if not raw and text.startswith("N{", pos + 1):
                        pos = text.find("}", pos)
                        if pos < 0:
                            return ends("error")
                        pos += 1
                    else:
                        pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 2
                elif c in "\n\r" and len(q) == 1:
                    return ends("error")
                elif not spec and c == q[0] and text.startswith(q, pos):
                    if not _py_escapes(text[start:pos], raw, False):
                        return ends("error")
                    frames.pop()
                    add(("`", pos, pos + len(q)))
                    pos += len(q)
                    break
                elif spec and c == q[0] and text.startswith(q, pos):
                    return ends("error")
                elif c == "{":
                    if not spec and text.startswith("{{", pos):
                        pos += 2
                        continue
                    add((HOLE, pos, pos + 1))
                    frames.append(0)
                    pos += 1
                    break
                elif c == "}":
                    if spec:
                        frames.pop()
                        frames.pop()
                        add(("}", pos, pos + 1))
                        pos += 1
                        break
                    if not text.startswith("}}", pos):
                        return ends("error")
                    pos += 2
                else:
                    pos += 1
            continue
        m = match(text, pos)
        if m is None:
            return ends("error")
        kind = m.lastgroup
        pos, end = m.span(kind)
        if kind == "id":
            word = m[kind]
            if not word.isascii() and not word.isidentifier():
                return ends("error")
            add((words.get(word, ID), pos, end))
            pos = end
        elif kind == "line":
            if text[pos] == "#":
                comments.append((pos, end))
            pos = line_at(end)
        elif kind == "op":
            o = m[kind]
            if frames:  # in a hole
                if o in "([{":
                    frames[-1] += 1
                elif o in ")]}":
                    if frames[-1] == 0:
                        if o != "}":
                            return ends("error")
                        frames.pop()
                        add(("}", pos, end))
                        pos = end
                        continue
                    frames[-1] -= 1
                elif frames[-1] == 0 and o in (":", ":="):
                    add((":", pos, pos + 1))
                    frames.append("p")
                    pos += 1
                    continue
                elif frames[-1] == 0 and o == "!":
                    if not (c := _PY_CONVERSION.match(text, end)):
                        return ends("error")
                    add(("!", pos, c.end()))
                    pos = c.end()
                    continue
            if o == "!":
                return ends("error")
            add((_PY_OPS.get(o, o), pos, end))
            pos = end
        elif kind == "num":
            add((NUM, pos, end))
            pos = end
        elif kind != "str":  # a joined line, or the end
            pos = end
        else:
            prefix = m[kind].rstrip("\"'").lower()
            q = m[kind][len(prefix) :]
            if len(q) == 1 and text.startswith(q, end) and "f" not in prefix:  # an empty one
                add(("y" if "b" in prefix else STR, pos, end + 1))
                pos = end + 1
            elif "f" in prefix:
                add(("`", pos, end))
                frames.append(q + ("r" if "r" in prefix else ""))
                pos = end
            else:
                rest = _PY_REST[q].match(text, end)
                body = text[end : rest.end() - len(q)] if rest else text[end:]
                if not _py_escapes(body, "r" in prefix, "b" in prefix) or not rest and len(q) == 1:
                    return ends("error")
                if not rest:
                    return ends(f"s{q}{prefix.replace('u', '')}")
                add(("y" if "b" in prefix else STR, pos, rest.end()))
                pos = rest.end()
    return ends("")


_PY_CONVERSION = re.compile(r"[sra](?=[ \t]*[:}])")
