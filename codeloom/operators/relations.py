"""Edges between files, modules and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = ("contains", "imports", "calls", "depends_on", "uses")


def edges(df: DataFrame, kind: str, source: str, target: str, confidence: float, evidence) -> DataFrame:
    return df.select(
        F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("relation_type"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")
    )


def contains(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules contain files, files contain symbols."""
    a = edges(members, "contains", "module_id", "file_id", 1.0, F.col("name"))
    return a.unionByName(edges(symbols, "contains", "file_id", "symbol_id", 1.0, F.col("name")))


def import_candidates(module_path, from_import):
    """Paths that an import may mean, in the order in which they are tried."""
    dotted, bare = F.replace(module_path, F.lit("."), F.lit("/")), F.regexp_replace(module_path, r"^[./]+", "")
    of_from = F.array(
        F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(dotted, F.lit(".ts")), F.concat(dotted, F.lit(".tsx")),
        F.concat(module_path, F.lit(".py")), F.concat(module_path, F.lit(".ts")), bare, F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")),
    )
    of_bare = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")), F.concat(dotted, F.lit(".ts")), F.concat(dotted, F.lit(".cs")), bare)
    return F.when(from_import, of_from).otherwise(of_bare)


def imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges of rows (import_id, repo, file_id, module_path, is_from_import) to files (repo, path, file_id, ord): of the candidate paths the first that exists.

    Candidates become an equi-join on (repo, path) and a min_by over at most nine rows an import. Of files with one path the last by ord counts.
    """
    by_path = files.groupBy("repo", "path").agg(F.max_by("file_id", "ord").alias("target_id"))
    c = rows.select("import_id", "repo", "file_id", "module_path", F.posexplode(import_candidates(F.col("module_path"), F.col("is_from_import"))).alias("pos", "path"))
    hit = c.join(by_path, ["repo", "path"]).groupBy("import_id").agg(F.min_by(F.struct("file_id", "target_id", "module_path"), "pos").alias("h")).select("h.*")
    return edges(hit, "imports", "file_id", "target_id", 0.9, F.concat(F.lit("import "), F.col("module_path")))


def first_by_name(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "name").agg(F.min_by("symbol_id", "ord").alias("symbol_id"))


def last_by_path(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "path").agg(F.max_by("symbol_id", "ord").alias("symbol_id"))


def calls(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges of rows (repo, caller, callee, line): a callee is looked up by name (first symbol), else by qualified path (last); a caller by name. One edge a call site."""
    names = first_by_name(symbols)
    r = rows.join(names.select("repo", F.col("name").alias("caller"), F.col("symbol_id").alias("source_id")), ["repo", "caller"])
    r = r.join(names.select("repo", F.col("name").alias("callee"), F.col("symbol_id").alias("by_name")), ["repo", "callee"], "left")
    r = r.join(last_by_path(symbols).select("repo", F.col("path").alias("callee"), F.col("symbol_id").alias("by_path")), ["repo", "callee"], "left")
    r = r.withColumn("target_id", F.coalesce("by_name", "by_path")).where("target_id is not null")
    return edges(r, "calls", "source_id", "target_id", 0.7, F.concat(F.col("callee"), F.lit(" at line "), F.col("line").cast("string")))


def depends_on(import_edges: DataFrame) -> DataFrame:
    """One edge for each pair of files with imports, with the first evidence."""
    g = import_edges.groupBy("source_id", "target_id").agg(F.min("evidence").alias("first"))
    return edges(g, "depends_on", "source_id", "target_id", 0.8, F.col("first"))


def uses(symbols: DataFrame, words: DataFrame, imported: DataFrame) -> DataFrame:
    """Pairs of symbols of which one's body names the other, (source_id, target_id, confidence): imported names 0.75, names of the same file 0.6; a pair counts once, the imported one first.

    symbols (repo, file_id, symbol_id, name); words (symbol_id, word): the distinct identifiers of each body, so that a hash join replaces a regular expression a pair;
    imported (file_id, name): names that a file imports.
    """
    w = symbols.select("repo", "file_id", "symbol_id").join(words, "symbol_id")
    by_import = w.join(imported.select("file_id", F.col("name").alias("word")).distinct(), ["file_id", "word"])
    all_names = symbols.select("repo", F.col("name").alias("word"), F.col("symbol_id").alias("target_id"))
    a = by_import.join(all_names, ["repo", "word"]).where("symbol_id <> target_id").select(F.col("symbol_id").alias("source_id"), "target_id", F.lit(0.75).alias("confidence"))
    own = symbols.select("file_id", F.col("name").alias("word"), F.col("symbol_id").alias("target_id"))
    b = w.join(own, ["file_id", "word"]).where("symbol_id <> target_id").select(F.col("symbol_id").alias("source_id"), "target_id", F.lit(0.6).alias("confidence"))
    return a.unionByName(b).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))


def parser_usages(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses edges of rows (repo, source_symbol, target_name) that a parser reports, by first names on both sides."""
    names = first_by_name(symbols)
    r = rows.join(names.select("repo", F.col("name").alias("source_symbol"), F.col("symbol_id").alias("source_id")), ["repo", "source_symbol"])
    r = r.join(names.select("repo", F.col("name").alias("target_name"), F.col("symbol_id").alias("target_id")), ["repo", "target_name"]).where("source_id <> target_id")
    return edges(r, "uses", "source_id", "target_id", 0.8, F.col("target_name")).distinct()


def all_relations(parts: dict[str, DataFrame]) -> DataFrame:
    """The families one after another, in their order (family_ord)."""
    known = [parts[k].withColumn("family_ord", F.lit(i)) for i, k in enumerate(FAMILIES) if k in parts]
    return reduce(DataFrame.unionByName, known)


def dedup(relations: DataFrame) -> DataFrame:
    """The first row by ord of each (source, type, target)."""
    w = Window.partitionBy("source_id", "relation_type", "target_id").orderBy("ord")
    return relations.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def touching(relations: DataFrame, targets: DataFrame, types: list[str]) -> DataFrame:
    """Relations of the wanted types with a target (target) at either end. The disjunction becomes two equi-joins."""
    r = relations.where(F.col("relation_type").isin(types))
    t = targets.select("target").distinct()
    out = r.join(t, F.col("source_id") == F.col("target"))
    back = r.where("source_id <> target_id").join(t, F.col("target_id") == F.col("target"))
    return out.unionByName(back)


def neighbours(relations: DataFrame, targets: DataFrame, types: list[str]) -> DataFrame:
    """(target, other, reason, ord): the other ends of the relations of each target, undirected, the first relation by ord for each other end."""
    r = relations.where(F.col("relation_type").isin(types))
    t = targets.select("target").distinct()
    out = r.join(t, F.col("source_id") == F.col("target")).select("target", F.col("target_id").alias("other"), F.concat("relation_type", F.lit(" → target")).alias("reason"), "ord")
    back = r.where("source_id <> target_id").join(t, F.col("target_id") == F.col("target")).select("target", F.col("source_id").alias("other"), F.concat("relation_type", F.lit(" ← source")).alias("reason"), "ord")
    return out.unionByName(back).where("other is not null").groupBy("target", "other").agg(F.min(F.struct("ord", "reason")).alias("m")).select("target", "other", "m.reason", "m.ord")


def reach(relations: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, hops): nodes within a number of hops along relations, with the fewest hops (an extension)."""
    from codeloom.lineage import cut

    e = relations.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    seen = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, hops + 1):
        front = cut(front.join(e, "node").select("source", F.col("next").alias("node"), F.lit(k).alias("hops")).distinct().join(seen, ["source", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen
