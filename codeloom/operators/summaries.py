"""Heuristic summaries of files, symbols and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.files import base_name


def kind_parts(symbols: DataFrame) -> DataFrame:
    """(file_id, parts): for each kind, in the order in which kinds first occur, its first three names and the number of more."""
    w = Window.partitionBy("file_id", "kind").orderBy("ord")
    top = symbols.withColumn("k", F.row_number().over(w))
    g = top.groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "name")))).alias("names"))
    text = F.concat(F.col("kind"), F.lit("(s): "), F.array_join(F.transform("names", lambda s: s["name"]), ", "), F.when(F.col("n") > 3, F.concat(F.lit(" +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return g.withColumn("text", text).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda s: s["text"]), "; ").alias("parts"))


def file_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, content): what a file is, which symbols it holds and how many lines it has."""
    lines = F.regexp_count("content", F.lit("\n")) + 1
    parts = files.join(kind_parts(symbols), "file_id", "left")
    head = F.concat(F.lit("File '"), base_name(F.col("path")), F.lit("' ("), F.col("language"), F.lit(")"))
    return parts.select("file_id", F.concat_ws(". ", head, F.concat(F.lit("Contains "), F.col("parts")), F.concat(F.lit("("), lines.cast("string"), F.lit(" lines)"))).alias("content"))


def symbol_summaries(symbols: DataFrame) -> DataFrame:
    """(symbol_id, content) of symbols (kind, name, line_start, body)."""
    lines = F.split("body", "\n")
    n = F.concat(F.lit("("), F.size(lines).cast("string"), F.lit(" lines)"))
    head = F.concat(F.initcap("kind"), F.lit(" '"), F.col("name"), F.lit("'"))
    methods = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("def ")))
    first = F.element_at(lines, 1)
    with_methods = F.when((F.col("kind") == "class") & (methods > 0), F.concat(F.lit("with "), methods.cast("string"), F.lit(" method(s)")))
    defined = F.when(F.col("kind").isin("function", "method") & F.contains(first, F.lit("(")) & F.contains(first, F.lit(")")), F.concat(F.lit("defined at line "), F.col("line_start").cast("string")))
    return symbols.select("symbol_id", F.concat_ws(". ", head, with_methods, defined, n).alias("content"))


def module_summaries(members: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, content): the number of files of a module and the first five by ord."""
    m = members.join(files.select("file_id", "path"), "file_id")
    w = Window.partitionBy("module_id").orderBy("ord")
    top = m.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("module_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda s: s["path"]), ", ").alias("paths"))
    n = m.groupBy("module_id", "name").agg(F.count("*").alias("n"))
    return n.join(top, "module_id").select("module_id", F.concat_ws(". ", F.concat(F.lit("Module '"), F.col("name"), F.lit("'")), F.concat(F.lit("contains "), F.col("n").cast("string"), F.lit(" file(s)")), F.concat(F.lit("Files include: "), F.col("paths"))).alias("content"))


def last_by_target(summaries: DataFrame) -> DataFrame:
    """(target_id, content): the last summary by (ingested_at, ord) of each target."""
    return summaries.where("target_id is not null").groupBy("target_id").agg(F.max_by("content", F.struct("ingested_at", "ord")).alias("content"))
