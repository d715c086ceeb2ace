"""Context queries over stored knowledge: for each target the items that matter, scored, ranked and cut by a profile.

Every query takes a table of targets and answers all of them in one plan; a single target is a table of one row. Items carry emit_ord, the order in which a
reader would list them, so that ties are stable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.profiles import Profile
from codeloom.operators.relations import neighbours, touching

COLUMNS = ["target", "entity_type", "entity_id", "relevance_score", "reason", "emit_ord"]


def items(df: DataFrame, kind: str, entity: str, score: float, reason, stage: int, order) -> DataFrame:
    """Rows of COLUMNS; stage and order give emit_ord."""
    return df.select("target", F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"), F.lit(score).alias("relevance_score"), reason.alias("reason"), F.struct(F.lit(stage).alias("stage"), order.cast("bigint").alias("ord"), F.col(entity).alias("id")).alias("emit_ord"))


def rank(all_items: DataFrame, profile: Profile) -> DataFrame:
    """The first max_items of each target, with their rank. breadth_first ranks by the order of preferred entity types first; the other modes by score alone."""
    keys = [F.desc("relevance_score"), "emit_ord"]
    if profile.ranking_mode == "breadth_first":
        place = reduce(lambda a, kv: F.when(F.col("entity_type") == kv[1], kv[0]).otherwise(a), reversed(list(enumerate(profile.preferred_entities))), F.lit(99))
        keys = [place, *keys]
    w = Window.partitionBy("target").orderBy(*keys)
    return all_items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= profile.max_items).drop("emit_ord")


def _related(relations: DataFrame, files: DataFrame, targets: DataFrame, profile: Profile, score: float, stage: int) -> DataFrame:
    n = neighbours(relations, targets, list(profile.preferred_relations)).join(files.select(F.col("file_id").alias("other")), "other")
    return items(n, "File", "other", score, F.col("reason"), stage, F.col("ord"))


def file_context(files: DataFrame, symbols: DataFrame, relations: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """targets (target): file ids. The file (1.0), its symbols (0.95) and files one relation away (0.7). Unknown targets give nothing."""
    t = targets.select("target").distinct().join(files.select(F.col("file_id").alias("target"), "path", "ord"), "target")
    parts = [items(t, "File", "target", 1.0, F.lit("Primary target file"), 0, F.col("ord"))]
    if "Symbol" in profile.preferred_entities:
        s = symbols.select(F.col("file_id").alias("target"), "symbol_id", F.col("ord").alias("s_ord")).join(t.select("target", "path"), "target")
        parts.append(items(s, "Symbol", "symbol_id", 0.95, F.concat(F.lit("Defined in "), F.col("path")), 1, F.col("s_ord")))
    if profile.include_related_files:
        parts.append(_related(relations, files, t, profile, 0.7, 2))
    return rank(reduce(DataFrame.unionByName, parts), profile)


def symbol_context(files: DataFrame, symbols: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """targets (target): references to symbols, the first symbol of that name, else the one of that id. The symbol (1.0), its file (0.9) and its siblings (0.6)."""
    t = targets.select("target").distinct()
    by_name = symbols.groupBy(F.col("name").alias("target")).agg(F.min_by("symbol_id", "ord").alias("by_name"))
    found = t.join(by_name, "target", "left").join(symbols.select(F.col("symbol_id").alias("target"), F.col("symbol_id").alias("by_id")), "target", "left")
    found = found.withColumn("symbol_id", F.coalesce("by_name", "by_id")).where("symbol_id is not null").select("target", "symbol_id").join(symbols.select("symbol_id", "file_id", "name", "ord"), "symbol_id")
    parts = [items(found, "Symbol", "symbol_id", 1.0, F.lit("Primary target symbol"), 0, F.col("ord"))]
    f = found.join(files.select("file_id"), "file_id")
    parts.append(items(f, "File", "file_id", 0.9, F.concat(F.lit("Contains symbol '"), F.col("name"), F.lit("'")), 1, F.col("ord")))
    if "Symbol" in profile.preferred_entities:
        sib = f.select("target", "file_id", F.col("symbol_id").alias("self")).join(symbols.select("file_id", "symbol_id", "ord"), "file_id").where("symbol_id <> self")
        parts.append(items(sib, "Symbol", "symbol_id", 0.6, F.lit("Sibling symbol in same file"), 2, F.col("ord")))
    return rank(reduce(DataFrame.unionByName, parts), profile)


def module_context(members: DataFrame, symbols: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """targets (target): names or ids of modules. The module (1.0), its files (0.9), each followed by its symbols (0.7)."""
    m = members.select("module_id", "name", "file_id", "ord")
    t = targets.select("target").distinct()
    ids = m.select("module_id", "name").distinct()
    found = t.join(ids.groupBy(F.col("name").alias("target")).agg(F.min("module_id").alias("by_name")), "target", "left").join(ids.select(F.col("module_id").alias("target"), F.col("module_id").alias("by_id")), "target", "left")
    found = found.withColumn("module_id", F.coalesce("by_name", "by_id")).where("module_id is not null").select("target", "module_id").join(ids, "module_id")
    parts = [items(found, "Module", "module_id", 1.0, F.lit("Primary target module"), 0, F.lit(0))]
    f = found.join(m.drop("name"), "module_id")
    parts.append(items(f, "File", "file_id", 0.9, F.concat(F.lit("Part of module '"), F.col("name"), F.lit("'")), 1, F.col("ord")))
    if "Symbol" in profile.preferred_entities:
        s = f.select("target", "name", "file_id").join(symbols.select("file_id", "symbol_id", "ord"), "file_id")
        parts.append(items(s, "Symbol", "symbol_id", 0.7, F.concat(F.lit("Symbol in module '"), F.col("name"), F.lit("'")), 1, F.col("ord")))
    return rank(reduce(DataFrame.unionByName, parts), profile)


def change_context(files: DataFrame, symbols: DataFrame, relations: DataFrame, changes: DataFrame, profile: Profile) -> DataFrame:
    """changes (target, path, place): the changed paths of each change set, in their order. Per path the file (1.0), its symbols (0.9) and related files (0.49).

    An entity counts once in a change set, where it is listed first; so a changed file that an earlier one relates to keeps the lower score. Missing paths are ignored.
    """
    by_path = files.groupBy("path").agg(F.max_by("file_id", "ord").alias("file_id"))
    c = changes.join(by_path, "path").select("target", "path", "place", "file_id")
    parts = [c.select("target", F.lit("File").alias("entity_type"), F.col("file_id").alias("entity_id"), F.lit(1.0).alias("relevance_score"), F.lit("Changed file").alias("reason"), F.struct(F.col("place"), F.lit(0).alias("stage"), F.lit(0).cast("bigint").alias("ord"), F.col("file_id").alias("id")).alias("emit_ord"))]
    if "Symbol" in profile.preferred_entities:
        s = c.join(symbols.select("file_id", "symbol_id", "ord"), "file_id")
        parts.append(s.select("target", F.lit("Symbol").alias("entity_type"), F.col("symbol_id").alias("entity_id"), F.lit(0.9).alias("relevance_score"), F.concat(F.lit("Symbol in changed file '"), F.col("path"), F.lit("'")).alias("reason"), F.struct("place", F.lit(1).alias("stage"), F.col("ord").cast("bigint").alias("ord"), F.col("symbol_id").alias("id")).alias("emit_ord")))
    if profile.include_related_files:
        n = neighbours(relations, c.select(F.col("file_id").alias("target")), list(profile.preferred_relations)).withColumnRenamed("target", "file_id")
        n = c.join(n, "file_id").join(files.select(F.col("file_id").alias("other")), "other")
        parts.append(n.select("target", F.lit("File").alias("entity_type"), F.col("other").alias("entity_id"), F.lit(0.49).alias("relevance_score"), F.col("reason"), F.struct("place", F.lit(2).alias("stage"), F.col("ord").cast("bigint").alias("ord"), F.col("other").alias("id")).alias("emit_ord")))
    w = Window.partitionBy("target", "entity_id").orderBy("emit_ord")
    once = reduce(DataFrame.unionByName, parts).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return rank(once, profile)


def relations_of(relations: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """The first max_items relations by ord at either end of each target."""
    t = touching(relations, targets, list(profile.preferred_relations))
    w = Window.partitionBy("target").orderBy("ord", "source_id", "target_id")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= profile.max_items)


def relation_totals(relations: DataFrame, targets: DataFrame, profile: Profile) -> DataFrame:
    """(target, total_relations): the relations at either end of each target, before any cut; targets without one have 0."""
    n = touching(relations, targets, list(profile.preferred_relations)).groupBy("target").agg(F.count("*").alias("n"))
    return targets.select("target").distinct().join(n, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("total_relations"))


def totals(ranked: DataFrame) -> DataFrame:
    """Numbers of items by type, after the cut."""
    c = lambda k: F.count_if(F.col("entity_type") == k)
    return ranked.groupBy("target").agg(c("File").alias("total_files"), c("Symbol").alias("total_symbols"), c("Module").alias("total_modules"))


def semantic_items(hits: DataFrame, risks: DataFrame, conventions: DataFrame, query: str, profile: Profile) -> DataFrame:
    """hits (id, score, rank) of a search as items, with conventions (0.5) and risks (0.6 where high, else 0.3) if the profile wants them, ranked together."""
    kind = F.col("entity_type") if "entity_type" in hits.columns else F.lit("File")
    parts = [hits.select(F.lit(query).alias("target"), kind.alias("entity_type"), F.col("id").alias("entity_id"), F.col("score").alias("relevance_score"), F.lit(f"Semantic match for '{query}'").alias("reason"), F.struct(F.lit(0).alias("stage"), F.col("rank").cast("bigint").alias("ord"), F.col("id").alias("id")).alias("emit_ord"))]
    if profile.include_conventions:
        parts.append(conventions.select(F.lit(query).alias("target"), F.lit("Convention").alias("entity_type"), F.col("convention_id").alias("entity_id"), F.lit(0.5).alias("relevance_score"), F.lit("Detected convention").alias("reason"), F.struct(F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("ord"), F.col("convention_id").alias("id")).alias("emit_ord")))
    if profile.include_risks:
        parts.append(risks.select(F.lit(query).alias("target"), F.lit("Risk").alias("entity_type"), F.col("risk_id").alias("entity_id"), F.when(F.col("severity") == "high", 0.6).otherwise(0.3).alias("relevance_score"), F.concat(F.lit("Risk area: "), F.col("category")).alias("reason"), F.struct(F.lit(2).alias("stage"), F.lit(0).cast("bigint").alias("ord"), F.col("risk_id").alias("id")).alias("emit_ord")))
    return rank(reduce(DataFrame.unionByName, parts), profile)
