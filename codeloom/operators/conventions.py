"""Conventions that the files and symbols of a repository follow, by ratios, counts and occurrences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import extension, short_sha
from codeloom.operators.files import base_name

# Keywords of architectural roles and of configuration files, looked for in lower-case paths and symbol names.
ROLES = {"service": ["service", "handler", "manager"], "repository": ["repository", "repo", "store", "storage", "dal"], "controller": ["controller", "router", "endpoint", "api", "resource"], "model": ["model", "entity", "schema", "domain"]}
CONFIG_WORDS = ["config", "settings", ".env", "pyproject.toml", "setup.py", "setup.cfg", "dockerfile", "docker-compose"]


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(c), F.lit(w)) for w in words])


def detect(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, convention_id, convention_type, name, confidence, n_hits) of files (repo, path, language, is_entrypoint, content) and symbols (repo, name, kind).

    All rules are conditions on one row of counts per repository, so that files and symbols are read once. Null contents count as having none of the words. A repository without
    files or without symbols follows the rules of what it has.
    """
    p, name = F.col("path"), F.col("name")
    py = F.col("language") == "python"
    tried = (extension(p) == "py") & (F.contains("content", F.lit("try:")) | F.contains("content", F.lit("except ")))
    of_files = {
        "n": F.lit(True), "py": py, "py_snake": py & base_name(p).rlike(r"^[a-z_][a-z0-9_]*\.py$"), "src": p.startswith("src/"), "init": p.endswith("__init__.py"), "main": p.endswith("__main__.py"), "entry": F.col("is_entrypoint"),
        "config": any_of(p, CONFIG_WORDS), "cli": F.contains(p, F.lit("/cli/")), "models": F.contains(p, F.lit("/models/")), "ingest": F.contains(p, F.lit("/ingest/")), "tried": F.coalesce(tried, F.lit(False)), **{f"f_{r}": any_of(p, w) for r, w in ROLES.items()},
    }
    of_symbols = {
        "class": F.col("kind") == "class", "pascal": (F.col("kind") == "class") & name.rlike("^[A-Z][a-zA-Z0-9]*$"), "func": F.col("kind") == "function", "snake": (F.col("kind") == "function") & name.rlike("^[a-z_][a-z0-9_]*$"),
        "error": any_of(name, ["error", "exception"]), **{f"s_{r}": any_of(name, w) for r, w in ROLES.items()},
    }
    f = files.groupBy("repo").agg(*[F.count_if(c).alias(k) for k, c in of_files.items()])
    s = symbols.groupBy("repo").agg(*[F.count_if(c).alias(k) for k, c in of_symbols.items()])
    both = f.join(s, "repo", "full_outer").na.fill(0)
    n = F.col
    share = lambda hits, of: n(hits) / F.greatest(n(of), F.lit(1))
    most = lambda hits, of, least: (share(hits, of) >= least) & (n(hits) > 0)
    layers = n("cli") + n("models") + n("ingest")
    rules = [
        ("naming:python_snake_case", "naming_pattern", "Python snake_case file naming", most("py_snake", "py", 0.7), share("py_snake", "py"), n("py_snake")),
        ("naming:pascal_class", "naming_pattern", "PascalCase class naming", most("pascal", "class", 0.7), share("pascal", "class"), n("pascal")),
        ("naming:snake_func", "naming_pattern", "snake_case function naming", most("snake", "func", 0.7), share("snake", "func"), n("snake")),
        ("module:src_layout", "module_structure", "src/ directory layout", most("src", "n", 0.5), F.lit(0.9), n("src")),
        ("module:python_packages", "module_structure", "Python package modules", n("init") >= 3, F.lit(0.9), n("init")),
        ("config:organization", "config_organization", "Centralized configuration", n("config") >= 1, F.lit(0.9), n("config")),
        ("entrypoint:cli", "entrypoint_pattern", "CLI entrypoint", n("entry") >= 1, F.lit(0.95), n("entry")),
        ("entrypoint:main_module", "entrypoint_pattern", "__main__.py entrypoint pattern", n("main") >= 1, F.lit(0.9), n("main")),
        ("layer:cli_models_ingest", "layered_architecture", "Layered architecture", (n("cli") > 0) & (n("models") > 0) & (n("ingest") > 0), F.lit(0.8), layers),
        *[(f"pattern:{r}", "service_repository_pattern", f"{r.capitalize()} pattern", n(f"f_{r}") + n(f"s_{r}") > 0, F.when(n(f"f_{r}") > 0, 0.8).otherwise(0.6), n(f"f_{r}") + n(f"s_{r}")) for r in ROLES],
        ("error:custom_exceptions", "error_handling", "Custom exception classes", n("error") >= 1, F.lit(0.9), n("error")),
        ("error:try_except", "error_handling", "Explicit try/except error handling", n("tried") >= 3, F.lit(0.8), n("tried")),
    ]
    found = F.array(*[
        F.when(holds, F.struct(short_sha(16, F.lit(key)).alias("convention_id"), F.lit(kind).alias("convention_type"), F.lit(label).alias("name"), F.round(F.least(F.lit(1.0), confidence), 6).alias("confidence"), hits.cast("bigint").alias("n_hits")))
        for key, kind, label, holds, confidence, hits in rules
    ])
    return both.select("repo", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("repo", "c.*")


def evidence(df: DataFrame, hit: Column, value: str, k: int) -> DataFrame:
    """(repo, evidence): the first k values by ord of the rows that hit; the window keeps k rows a group before it shuffles."""
    w = Window.partitionBy("repo").orderBy("ord")
    return df.where(hit).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value]).alias("evidence"))
