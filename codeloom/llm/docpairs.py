"""Functions paired with their documentation (problem 1).

In a text, a comment is a candidate for the definitions that follow within a few lines and for the one whose body it opens. Links are scored by distance, by the parameters that tags name (theirs or others') and by
names, and assigned one to one so that the sum of scores is greatest; links that score nothing are implausible and dropped. Docstrings, and the documentation of parsed symbols, are candidates of one
definition and pass the same score. What tells nothing is dropped. p1_pairs gives all links, p1_found those of documentation that ends right above its definition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id
from codeloom.llm.grammar import grammar
from codeloom.llm.syntax import whole
from codeloom.parse.definitions import Lines, definitions, parse_python, python_definitions
from codeloom.parse.lexer import lex
from codeloom.tables import source_documents

#: Lines between the end of a comment and a definition for which the comment is a candidate.
REACH = 4
#: Scores: a comment right above, each line between, each tag (of two at most) that names a parameter, each that names another word, the definition's name in the text, and a comment within the body.
NEAR, LINE_BETWEEN, OWN_TAG, OTHER_TAG, NAMED, WITHIN = 10, 4, 3, 3, 1, 4

# Words that say nothing about a function beside its name.
FILLER = frozenset(
    "the a an this that these those it its function functions method methods procedure routine helper will to of for is are be and or in on with by from as does do performs perform implements implementation"
    " used use uses which given returns return gets get sets set def class called here later yet documentation doc docs docstring documented undocumented describe description write add goes comment comments summary"
    " value values parameter parameters param params argument arguments arg args input inputs optional required string str int integer bool boolean list dict number object any float map array type none null void self cls"
    " funktion methode diese der die das den ein eine von für und fonction méthode cette la le les un une des du de et función método esta el los las y функция метод эта этот hàm phương thức này".split()
)
# Lines that stand in for text still to be written, and remarks to tools (matched in lower case from the start of a line).
STAND_IN = re.compile(
    r"\W*(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*"
    r"|\W*(?:n/?a|none|undocumented|placeholder|description|docstring|summary|coming soon|lorem ipsum.*)\W*"
    r"|\W*(?:no|missing|needs?|add|write|insert|to be)\s+(?:description|docs?|documentation|docstring|comments?|written|documented|done|determined|completed|added|defined)\b.*"
    r"|\W*(?:documentation|docs?|description|comment)\s+(?:goes here|here|missing|pending|to follow|to come|tbd)\W*"
    r"|\W*(?:à (?:compléter|documenter|faire|rédiger)|beschreibung (?:fehlt|folgt|ergänzen)|noch (?:zu dokumentieren|offen)|por (?:completar|documentar|hacer)|sin (?:documentar|descripción)|pendiente|описание (?:отсутствует|появится позже)|нет описания|дописать|chưa có (?:mô tả|tài liệu))\W*"
    r"|\W*(?:eslint|tslint|jshint|jscs|prettier|stylelint|biome|deno|istanbul|c8|v8|sonar|nosonar|resharper|noqa|pylint|flake8|ruff|mypy|pyright|fmt|isort|black|nosec|nolint|type:\s*ignore|pragma|@ts-\w+|@ts|@vite|webpack|#?__pure__|region|endregion|spell-?checker|cspell|codespell|coverage)\b.*"
)
_MARKS = re.compile(r"^[ \t]*(?:/\*+|\*+(?!/)|/{2,}!?|\#+)?|\*+/[ \t]*$")
_XML_PARAM = re.compile(r"<(?:type)?param(?:ref)?\s+name\s*=\s*[\"'](\w+)[\"']\s*/?>(.*?)(?:</(?:type)?param>|$)", re.S)
_TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|prop|property|returns?|throws|template)|:(?:param|parameter|arg|type|returns?|rtype|raises))\b\s*(?:\{[^}]*\})?\s*(.*)$")
_HEADS = re.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|attributes)\s*:?$")
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


@lru_cache(100_000)
def name_words(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _HUMP.findall(name))


def _about(word: str, names: frozenset[str]) -> bool:
    """Whether a word is one of the names, perhaps inflected."""
    return word in names or any(abs(len(word) - len(n)) <= 3 and word[: max(3, len(n) - 1)] == n[: max(3, len(n) - 1)] for n in names if len(n) > 2)


def _tells(line: str, names: frozenset[str]) -> bool:
    low = line.strip().lower()
    if not low or STAND_IN.fullmatch(low):
        return False
    return any(len(w) > 0 and w not in FILLER and not _about(w, names) for w in _WORD.findall(low))


def telling(doc: str | None, name: str, parameters: list[str] | None = None) -> bool:
    """Whether documentation says more than the signature does."""
    if not doc:
        return False
    names = name_words(name)
    params = {p.lstrip("*") for p in parameters or () if p}

    def param(m: re.Match) -> str:
        return f"\n@param {m[1]} {' '.join(m[2].split())}\n"

    doc = _XML_PARAM.sub(param, "\n".join(_MARKS.sub("", x) for x in doc.split("\n")))
    doc = re.sub(r"</?[A-Za-z][^<>\n]*>", " ", doc)
    listed = False
    for raw in doc.split("\n"):
        line = raw.strip()
        if _HEADS.match(line.lower()):
            listed = True
            continue
        if not line:
            continue
        if m := _TAG.match(line):
            rest = re.match(r"\[?([\w$.]*)(?:=[^\]]*)?\]?\s*:?\s*(?:-\s*)?(.*)", m[1])
            first, text = rest[1], rest[2]
            if re.match(r"[@\\:](?:returns?|throws|raises|rtype)", line):
                first, text = "", m[1]
            if _tells(text, names | name_words(first)):
                return True
            continue
        if m := re.match(r"[*`]*([\w$]+)[`*]*\s*(?:\([^)]*\))?\s*(?::|--?|–)\s*(.*)", line):
            if listed or m[1] in params:
                if _tells(m[2], names | name_words(m[1])):
                    return True
                continue
        if _tells(line, names):
            return True
    return False


def comment_blocks(text: str, comments: list[tuple[int, int]], lines: Lines) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of comments that have their lines to themselves; comments to the line end on adjacent lines are one."""
    out: list[tuple[int, int, str]] = []
    joined = False
    for a, z in comments:
        before = text[text.rfind("\n", 0, a) + 1 : a]
        end = text.find("\n", z)
        if before.strip(" \t﻿") or text[z : end if end >= 0 else None].strip():
            joined = False
            continue
        first, last, single = lines.of(a), lines.of(z - 1), text.startswith("//", a)
        if single and joined and out and out[-1][1] == first - 1:
            out[-1] = (out[-1][0], last, out[-1][2] + "\n" + text[a:z])
        else:
            out.append((first, last, text[a:z]))
        joined = single
    return out


_TAGGED = re.compile(r"[@\\](?:param|arg|argument)\s+(?:\{[^}]*\}\s*)?\[?([\w$]+)|<param\s+name\s*=\s*[\"']([\w$]+)|:param\s+(?:[\w\[\], ]+\s)?([\w$]+):")


def score(doc: str, name: str, parameters: list[str] | None, base: int) -> int:
    """How well documentation fits a definition; base is what its place is worth."""
    tags = {t for m in _TAGGED.finditer(doc) for t in m.groups() if t} if "param" in doc or "arg" in doc else set()
    own = tags & {p.lstrip("*") for p in parameters or () if p}
    return base + OWN_TAG * min(len(own), 2) - OTHER_TAG * min(len(tags) - len(own), 2) + NAMED * (name in doc)


def best_links(scores: dict[tuple[int, int], int]) -> dict[int, int]:
    """Of scored links (a, b), all above zero, the assignment one to one with the greatest sum: the b of each a. Ties go to the smaller numbers."""
    near: dict[int, list[int]] = {}
    for a, b in scores:
        near.setdefault(a, []).append(b)
        near.setdefault(~b, []).append(a)
    out: dict[int, int] = {}
    seen: set[int] = set()
    for start in sorted(a for a in near if a >= 0):
        if start in seen:
            continue
        part, todo = set(), [start]
        while todo:  # what hangs together is assigned together
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += [~b for b in near[x]] if x >= 0 else near[x]
        seen |= part
        left, right = sorted(x for x in part if x >= 0), sorted(~x for x in part if x < 0)
        if len(left) == 1 or len(right) == 1:
            _, a, b = max((scores[a, b], -a, -b) for a in left for b in right if (a, b) in scores)
            out[-a] = -b
        else:
            out |= _hungarian(left, right, scores)
    return out


def _hungarian(left: list[int], right: list[int], scores: dict[tuple[int, int], int]) -> dict[int, int]:
    """The assignment of greatest sum by shortest augmenting paths; each of left may stay without."""
    n, m = len(left), len(right) + len(left)
    cost = [[-scores.get((a, b), 0) for b in right] + [0] * n for a in left]
    u, v, match = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0, way = i, 0, [0] * (m + 1)
        low, used = [10**9] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], 10**9, 0
            for j in range(1, m + 1):
                if not used[j]:
                    if (c := cost[i0 - 1][j - 1] - u[i0] - v[j]) < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return {left[i - 1]: right[j - 1] for j, i in enumerate(match) if j and i and j <= len(right) and (left[i - 1], right[j - 1]) in scores}


def assign(defs: list, blocks: list[tuple[int, int, str]]) -> dict[int, tuple[str, int, int]]:
    """(documentation, gap, score) by the place of its definition in defs; gap is the number of lines between, -1 for a comment within the body."""
    by_end = {b[1]: k for k, b in enumerate(blocks)}
    by_start = {b[0]: k for k, b in enumerate(blocks)}
    scores: dict[tuple[int, int], int] = {}
    gaps: dict[tuple[int, int], int] = {}

    def link(i: int, k: int, gap: int, base: int) -> None:
        worth = score(blocks[k][2], defs[i].name, defs[i].parameters, base)
        if worth > 0 and worth > scores.get((i, k), 0):
            scores[i, k], gaps[i, k] = worth, gap

    for i, d in enumerate(defs):
        for gap in range(REACH):
            if (k := by_end.get(d.head - 1 - gap)) is not None:
                link(i, k, gap, NEAR - LINE_BETWEEN * gap)
        if (k := by_start.get(d.line + 1)) is not None and blocks[k][1] < d.end:
            link(i, k, -1, WITHIN)
    return {i: (blocks[k][2], gaps[i, k], scores[i, k]) for i, k in best_links(scores).items()}


def pairs_of(text: str, lang: str) -> list[tuple]:
    """(name, kind, line, parameters, documentation, gap, score) of the documented functions of a text; none where it breaks the grammar."""
    if lang == "python":
        try:
            defs = python_definitions(parse_python(text))
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return []
        found = [(d, d.docstring, 0, score(d.docstring, d.name, d.parameters, NEAR)) for d in defs if d.docstring]
    else:
        lexed = lex(text, lang)
        if lexed.error or not whole("".join([t[0] for t in lexed.tokens]), lang, grammar(lang).rich(text)):
            return []
        lines = Lines(text)
        defs = definitions(text, lang, lexed, lines)
        docs = assign(defs, comment_blocks(text, lexed.comments, lines)) if defs else {}
        found = [(defs[i], *link) for i, link in sorted(docs.items())]
    return [(d.name, d.kind, d.line, d.parameters, doc, gap, worth) for d, doc, gap, worth in found if worth > 0 and telling(doc, d.name, d.parameters)]


_COLUMNS = "owner_id string, name string, kind string, line_start int, parameters array<string>, documentation string, gap int, score int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for b in batches:
        rows = []
        for i, t, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("code_language").to_pylist()):
            rows += [(str(i), *p) for p in pairs_of(t, lang)]
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _telling_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        lists = [list(p) if p is not None else [] for p in pdf["parameters"]]
        worth = [score(d, n or "", p, NEAR) for d, n, p in zip(pdf["documentation"], pdf["name"], lists)]
        pdf = pdf.assign(gap=0, score=worth)
        yield pdf[[w > 0 and telling(d, n or "", p) for w, d, n, p in zip(worth, pdf["documentation"], pdf["name"], lists)]]


def p1_pairs(documents: DataFrame, files: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    """(origin, owner_id, name, kind, line_start, parameters, documentation, gap, score) of functions and methods with telling documentation, wherever near them it stands.

    Texts that are null, empty or break their language's grammar give none; parsed rows without owner, name or documentation neither. Rows repeat where the input repeats.
    """
    src = source_documents(documents.select("doc_id", "file_id", "text"), files).select("doc_id", "text", "code_language")
    texts = src.mapInArrow(_pairs, _COLUMNS).select(F.lit("documents").alias("origin"), "*")
    rows = parsed_symbols.where(norm_id("kind").isin("function", "method") & F.col("docstring").isNotNull() & F.col("file_id").isNotNull()).select(
        F.col("file_id").alias("owner_id"), F.regexp_replace("name", "^#", "").alias("name"), norm_id("kind").alias("kind"), F.col("line_start").cast("int").alias("line_start"), "parameters", F.col("docstring").alias("documentation")
    )
    parsed = rows.mapInPandas(_telling_rows, _COLUMNS).select(F.lit("parsed_symbols").alias("origin"), "*")
    return texts.unionByName(parsed)


def p1_found(documents: DataFrame, files: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    return p1_pairs(documents, files, parsed_symbols).where("gap = 0").select("origin", "owner_id", "name", "line_start").distinct()
