"""Generated, minified or vendored source files (problem 6).

Layout statistics are held against thresholds tuned per language: maximum and mean line length, shares of white space, alphanumerics and digits, long encoded runs, and the
share of lines that two line shapes cover. They find what was generated, minified or is mere data. Copies of other people's code look like any code; what they are shows in evidence of their origin: a
banner in the comments they open with, or a package's name in the path, where the repository has no directory of that name of its own. Directories alone, and texts that merely mention
generated files, make no difference.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id
from codeloom.tables import file_paths, source_documents

#: Thresholds by extension, halfway between the most that hand-written files of the language show and the least that others do. Minified: longest and mean line at least, white space at most, alphanumerics
#: at least. Data: digits or encoded runs at least. Generated: lines with a word, and share of two line shapes at least.
LIMITS = {
    "py": {"max_line": 420, "mean_line": 160, "space": 0.12, "alnum": 0.45, "digits": 0.38, "encoded": 0.7, "shape_lines": 8, "shapes": 0.79},
    "ts": {"max_line": 400, "mean_line": 150, "space": 0.11, "alnum": 0.45, "digits": 0.36, "encoded": 0.68, "shape_lines": 8, "shapes": 0.8},
    "js": {"max_line": 400, "mean_line": 150, "space": 0.1, "alnum": 0.45, "digits": 0.36, "encoded": 0.68, "shape_lines": 8, "shapes": 0.8},
    "cs": {"max_line": 420, "mean_line": 160, "space": 0.12, "alnum": 0.45, "digits": 0.32, "encoded": 0.68, "shape_lines": 8, "shapes": 0.66},
}
# How tools sign what they write (at the start of a comment line).
GENERATED = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated\b(?!_)|code generated by\b|machine[- ]generated"
    r"|(?:this|the) (?:file|code|module|source|class)\b.{0,20}\b(?:was|is|has been) (?:automatically |auto-?)?(?:generated|produced|created|written|built)\b.{0,10}\b(?:by|from|with|using|automatically)\b"
    r"|(?:automatically )?(?:generated|produced|created|built) (?:automatically )?(?:by|from|with|using) (?:the )?[\w@/.+-]+(?: (?:compiler|generator|tool|version))*(?: v?\d[\w.]*)?\s*(?:[;,.:(-]|$)"
    r"|automatisch (?:erzeugt|generiert|erstellt)\b|diese datei wurde\b.{0,30}\b(?:erzeugt|generiert)"
    r"|(?:ce )?fichier (?:a été )?(?:produit|généré|créé)\b|généré (?:automatiquement )?par\b"
    r"|(?:este )?archivo (?:fue )?(?:generado|producido|creado)\b|generado (?:automáticamente )?(?:por|con)\b"
    r"|(?:этот )?файл (?:создан|сгенерирован|получен)\b|(?:автоматически )?(?:сгенерировано|создано) (?:автоматически|программой|с помощью)"
    r"|(?:tệp|tập tin|mã) (?:này )?(?:được|do) (?:tạo|sinh)\b|được (?:tạo|sinh) (?:tự động|bởi)"
    r"|(?:do not|don't) (?:edit|modify|change)(?: (?:this file|by hand|manually|directly))*\s*(?:[.!;,:*/-]|$)",
    re.I,
)
# How kept copies of third-party code name their origin.
VENDORED = re.compile(
    r"(?:copied|taken|vendored|imported|adapted)(?: verbatim| unchanged| unmodified)? from [\w@./-]+ (?:version |release )?v?\d+(?:\.\d+)+"
    r"|[\w@./-]+ v?\d+(?:\.\d+)+ \| (?:\(c\)|©|copyright|licen[cs]e)"
    r"|upstream: ?https?://|local copy,? do not modify|send patches upstream|vendored (?:copy|from|version)\b",
    re.I,
)
_NAME_VERSION = re.compile(r"[@\w][\w@./-]* v?\d+\.\d+(?:\.\d+)*(?:[-+][\w.]+)?$", re.I)
_LICENCE = re.compile(r"copyright|\(c\)|©|licen[cs]ed? |released under|spdx-license", re.I)
# Directories in which package managers and people keep copies of packages.
PACKAGE_PATH = (
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|thirdparty|vendor|deps|externals?|extern|Libs|Pods|Carthage)/(?:@[\w.-]+/)?([\w.-]+)/"
    r"|(?:^|/)packages/([\w.-]*?[\w-])\.\d+\.\d+(?:\.\d+)*[\w.-]*/"
)
#: A comment (a block, or a line) and the white space before it; a string that stands alone.
_OPENING = re.compile(r"(?P<s>[\s\ufeff]*+)(?P<c>/\*(?:[\s\S]*?\*/|[\s\S]*)|<!--(?:[\s\S]*?-->|[\s\S]*)|(?:#|//|--)[^\n]*)")
_DOCSTRING = re.compile(r"(?P<s>[\s\ufeff]*+)[rRuU]?(?P<q>\"\"\"|'''|[\"'](?![\"']))(?P<c>(?:\\[\s\S]|(?!(?P=q))[^\\])*+)(?P=q)(?=[ \t\r]*(?:[;#\n]|\Z))")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_WORD = re.compile(r"[^\W\d]\w*")
_VALUE = re.compile(r"\d+|\"[^\"\n]*\"|'[^'\n]*'")


def head(text: str, ext: str = "") -> list[str]:
    """The lines of all comments that a text opens with, up to its first code; of a python text, its docstring is one."""
    out: list[str] = []
    at, docstring = 0, ext == "py"
    while m := _OPENING.match(text, at) or docstring and _DOCSTRING.match(text, at):
        docstring = docstring and m.re is _OPENING
        lines = m["c"].split("\n")
        start = text.rfind("\n", 0, m.start("c")) + 1
        end = text.find("\n", start)
        if lines[0][:4] == "/*! " and len(text[start : end if end >= 0 else len(text)].strip()) >= 300:
            lines = lines[1:]
        out += [""] * (m["s"].count("\n") - 1) + [x.strip() for x in lines]
        at = m.end()
    return out


def banner(text: str, ext: str = "") -> str | None:
    lines = [x.lstrip("#/*!;-< \t").rstrip("*/>- \t") if not x.lstrip("#/*!;- \t").startswith("<") else x.lstrip("#/*!;- \t") for x in head(text, ext)]
    for k, x in enumerate(lines):
        if VENDORED.match(x) or _NAME_VERSION.match(x) and any(_LICENCE.search(y) for y in lines[k + 1 : k + 4]):
            return "vendored"
        if GENERATED.match(x):
            return "generated"
    return None


def repetition(text: str) -> tuple[int, float]:
    """Lines with a word, and the share of them that the two most frequent shapes cover; shapes without code punctuation count for nothing."""
    shapes = Counter(x.strip() for x in _VALUE.sub("0", _WORD.sub("w", text)).split("\n"))
    n = sum(k for x, k in shapes.items() if "w" in x or "0" in x)
    top = sum(k for x, k in shapes.most_common(6) if ("w" in x or "0" in x) and ("=" in x or "(" in x))
    if top < 0.5 * n:
        return n, 0.0
    two = sum(sorted((k for x, k in shapes.items() if ("w" in x or "0" in x) and ("=" in x or "(" in x)), reverse=True)[:2])
    return n, two / n


def layout(text: str, ext: str) -> str | None:
    """generated, minified or data by the statistics of a text's layout; None where they are those of hand-written code."""
    limit = LIMITS[ext]
    raw = text.encode()
    n = len(raw)
    lines = raw.split(b"\n")
    longest = max(map(len, lines))
    space = (n - len(raw.translate(None, b" \t\r\n"))) / n
    if longest >= limit["max_line"] and n / len(lines) >= limit["mean_line"] and space <= limit["space"]:
        letters = (n - len(raw.translate(None, b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / n
        if letters >= limit["alnum"]:  # long lines of other scripts are prose
            return "minified"
    if (n - len(raw.translate(None, b"0123456789"))) / n >= limit["digits"]:
        return "data"
    if sum(map(len, _ENCODED.findall(text))) / n >= limit["encoded"]:
        return "data"
    count, share = repetition(text)
    return "generated" if count >= limit["shape_lines"] and share >= limit["shapes"] else None


def verdict(text: str, ext: str, package: bool = False) -> tuple[str | None, str | None]:
    """(reason, evidence): generated, minified, vendored or data, by layout, banner or package; None for what someone wrote by hand for the repository. package: whether the path names a kept copy of one."""
    if (by_layout := layout(text, ext)) is not None:
        return by_layout, "layout"
    if (signed := banner(text, ext)) is not None:
        return signed, "banner"
    return ("vendored", "package") if package else (None, None)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [verdict(t, e, k) for t, e, k in zip(*(b.column(c).to_pylist() for c in ("text", "ext", "package")))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["doc_id", "path", "reason", "evidence"])


def packages(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(fid): files under a directory for packages, in one whose name no directory of the repository's own code has. Only ids, repositories and paths are read."""
    at = documents.select(norm_id("file_id").alias("fid"), "source").distinct().join(file_paths(files), "fid")
    name = F.concat(F.regexp_extract("path", PACKAGE_PATH, 1), F.regexp_extract("path", PACKAGE_PATH, 2))
    kept = at.where(F.col("path").rlike(PACKAGE_PATH)).select("fid", "source", name.alias("name"))
    own = at.where(~F.col("path").rlike(PACKAGE_PATH)).select("source", F.explode(F.array_distinct(F.split("path", "/"))).alias("name")).distinct()
    strange = kept.join(own, kept["source"].eqNullSafe(own["source"]) & (kept["name"] == own["name"]), "left_anti")
    return strange.select("fid").distinct()


def classified(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path, reason, evidence) of source documents (doc_id, file_id, text, source) with a text; reason is null for hand-written ones. Null and empty texts are nobody's work and left out.

    Repeated rows are judged each; a null source is a repository of its own. Empty tables give none.
    """
    src = source_documents(documents.select("doc_id", "file_id", "text"), files).where("text <> ''")
    known = packages(documents, files).withColumn("known", F.lit(True))
    rows = src.join(known, "fid", "left").select("doc_id", "path", "ext", "text", F.coalesce("known", F.lit(False)).alias("package"))
    return rows.mapInArrow(_verdicts, "doc_id bigint, path string, reason string, evidence string")


def p6_found(documents: DataFrame, files: DataFrame) -> DataFrame:
    return classified(documents, files).where("reason is not null").select("doc_id").distinct()


def p6_reasons(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Numbers of source files by reason and what shows it (both null: hand-written)."""
    return classified(documents, files).groupBy("reason", "evidence").agg(F.count("*").alias("n_files"))
