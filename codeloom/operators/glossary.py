"""Glossary terms from capitals, symbol names and paths, and lookups of a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.files import stem

# Technical acronyms, other words in capitals, and path segments that are no terms.
ACRONYMS = "API URL HTTP HTTPS REST JSON XML HTML CSS SQL ORM CRUD JWT TLS SSL DNS TCP UDP SSH FTP CSV PDF PNG JPEG SVG GIT SVN CI CD CDN SDK IDE OS UI UX IO CPU GPU RAM ROM DB NPM YARN ESLINT TS JS TSX JSX ENV LOG ERR WARN DEBUG INFO TODO FIXME HACK NOTE VIP EOF UUID GUID POST GET PUT DELETE PATCH HEAD OPTIONS UTC ISO UTF ASCII MIME".split()
NOISE = "TRUE FALSE NULL UNDEFINED NONE NAN INF DEFAULT EXPORT IMPORT RETURN THROW NEW DELETE CLASS FUNCTION CONST LET VAR TYPE INTERFACE MODULE PACKAGE PRIVATE PUBLIC PROTECTED STATIC FINAL ABSTRACT EXTENDS IMPLEMENTS REQUIRE FROM ERROR SUCCESS FAILURE PENDING ACTIVE DISABLED ENABLED HIDDEN VISIBLE SELECTED LOADING OPEN CLOSED LEFT RIGHT TOP BOTTOM CENTER START END BEGIN FINISH FIRST LAST NEXT PREV UP DOWN IN OUT ON OFF YES NO".split()
COMMON_SEGMENTS = "src lib app test tests components utils services api types models hooks screens views pages index.ts index.tsx index.js".split()


CAPITALS = r"(?<![\p{L}\p{N}\p{M}_])([A-Z]{2,}(?:_[A-Z]+)*)(?![\p{L}\p{N}\p{M}_])"


def _top(occurrences: DataFrame, n: int, least: int) -> DataFrame:
    """Of occurrences (repo, term, ord), the n most frequent terms of a repository (ties by first occurrence, then by term), and of these the ones that occur at least so often."""
    g = occurrences.groupBy("repo", "term").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "first", "term")
    return g.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= n) & (F.col("n") >= least))


def caps(files: DataFrame) -> DataFrame:
    """Identifiers in capitals, without well-known acronyms and words: the 20 most frequent with two or more occurrences.

    The pattern stands on word boundaries of any alphabet: letters and digits of all scripts count as parts of words.
    """
    words = F.regexp_extract_all("content", F.lit(CAPITALS), F.lit(1))
    t = files.select("repo", "ord", F.explode(words).alias("term"))
    return _top(t.where(~F.substring_index("term", "_", 1).isin(ACRONYMS + NOISE)), 20, 2)


def pascal(symbols: DataFrame) -> DataFrame:
    """Capitalised words of symbol names of more than three letters: the 15 most frequent with three or more occurrences."""
    t = symbols.select("repo", "ord", F.explode(F.regexp_extract_all("name", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("term"))
    return _top(t.where(F.length("term") > 3), 15, 3)


def paths(files: DataFrame) -> DataFrame:
    """Stems of path segments of more than three characters, without common ones: the 10 most frequent with two or more occurrences."""
    t = files.select("repo", "ord", F.explode(F.split("path", "/")).alias("part")).where(~F.col("part").isin(COMMON_SEGMENTS))
    t = t.select("repo", "ord", F.lower(stem(F.col("part"))).alias("term"))
    return _top(t.where(F.length("term") > 3), 10, 2)


def caps_contexts(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(repo, term, contexts): the paths of the first three occurrences of terms (repo, term) in capitals."""
    words = F.regexp_extract_all("content", F.lit(CAPITALS), F.lit(1))
    t = files.select("repo", "ord", "path", F.posexplode(words).alias("pos", "term")).join(terms.select("repo", "term"), ["repo", "term"], "left_semi")
    w = Window.partitionBy("repo", "term").orderBy("ord", "pos")
    first = t.withColumn("k", F.row_number().over(w)).where("k <= 3")
    return first.groupBy("repo", "term").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("contexts"))


def entries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, glossary_id, term, definition, category, contexts, confidence, source): terms of all three stages, the most frequent first; a term of an earlier stage is no term of a later one."""
    a = caps(files)
    b = pascal(symbols).join(a.select("repo", "term"), ["repo", "term"], "left_anti")
    c = paths(files).join(a.select("repo", "term").unionByName(b.select("repo", "term")), ["repo", "term"], "left_anti")
    none = F.array().cast("array<string>")
    a = a.join(caps_contexts(files, a), ["repo", "term"], "left").select("repo", "term", F.concat(F.lit("Acronym/constant used in "), F.size("contexts").cast("string"), F.lit(" files")).alias("definition"), F.lit("acronym").alias("category"), "contexts", F.lit(0.6).alias("confidence"))
    b = b.select("repo", "term", F.concat(F.lit("Domain concept (found in "), F.col("n").cast("string"), F.lit(" symbols)")).alias("definition"), F.lit("domain").alias("category"), none.alias("contexts"), F.lit(0.5).alias("confidence"))
    title = F.initcap(F.translate("term", "_-", "  "))
    c = c.select("repo", title.alias("term"), F.concat(F.lit("Module/directory concept (in "), F.col("n").cast("string"), F.lit(" paths)")).alias("definition"), F.lit("domain").alias("category"), none.alias("contexts"), F.lit(0.4).alias("confidence"))
    every = a.unionByName(b).unionByName(c)
    return every.select("repo", F.left(F.sha2(F.concat_ws(":", "term", "category"), 256), F.lit(12)).alias("glossary_id"), "term", "definition", "category", "contexts", "confidence", F.lit("heuristic").alias("source"))


def lookup(glossary: DataFrame, asked: DataFrame) -> DataFrame:
    """Entries whose term is one of those asked for (term), in any letter case."""
    return glossary.join(asked.select(F.lower("term").alias("low")).distinct(), F.lower("term") == F.col("low")).drop("low")


def lexicon_hits(files: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(file_id, keyword, n): occurrences of the lexicon's keywords (one word each, in any letter case) in texts. Words meet keywords by equality, not by one expression a keyword."""
    words = files.select("file_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("keyword"))
    return words.groupBy("file_id", "keyword").agg(F.count("*").alias("n")).join(lexicon.select(F.lower("keyword").alias("keyword")).distinct(), "keyword")
