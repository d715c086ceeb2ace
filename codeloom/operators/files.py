"""File rows, scan filters, modules and histograms."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import extension, short_sha

# Names that a scan skips, as patterns on the base name of files and directories.
SKIP_PATTERNS = "node_modules .git __pycache__ .venv venv env dist build eggs *.egg-info .tox .mypy_cache .pytest_cache .ruff_cache bin obj .idea .vscode *.min.js *.min.css package-lock.json yarn.lock pnpm-lock.yaml .DS_Store Thumbs.db".split()
MAX_FILE_SIZE = 1024 * 1024
# Languages by extension.
LANGUAGES = {"py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cs": "c_sharp", "csx": "c_sharp", "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala"}
# Base names of entry points by language, directories and names of tests, and names of configuration files.
ENTRYPOINTS = {
    "python": "main.py app.py manage.py wsgi.py asgi.py __main__.py run.py server.py".split(),
    "typescript": "main.ts index.ts app.ts server.ts main.tsx index.tsx app.tsx".split(),
    "javascript": "main.js index.js app.js server.js main.jsx index.jsx app.jsx".split(),
    "c_sharp": "program.cs startup.cs".split(),
}
TEST_DIRECTORIES = "tests test __tests__ spec specs".split()
TEST_NAME = r"^(?:tests?|specs?)_|_(?:test|spec)s?$|(?:tests?|spec)$"
CONFIG_NAMES = "pyproject.toml setup.py setup.cfg tox.ini requirements.txt pip.conf .env .env.local tsconfig.json package.json .eslintrc .prettierrc web.config app.config appsettings.json nuget.config .editorconfig dockerfile docker-compose.yml docker-compose.yaml makefile cmakelists.txt".split()


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A base name without its last suffix; a name that begins with its only dot is its own stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    return F.coalesce(_map(LANGUAGES)[extension(path)], F.lit("unknown"))


def is_entrypoint(path: Column, lang: Column) -> Column:
    name = F.lower(base_name(path))
    hit = F.lit(False)
    for k, names in ENTRYPOINTS.items():
        hit = hit | ((lang == k) & name.isin(names))
    return hit


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, TEST_DIRECTORIES))) | stem(base_name(low)).rlike(TEST_NAME)


def is_config(path: Column) -> Column:
    return F.lower(base_name(path)).isin(CONFIG_NAMES)


def skip_regex(patterns: list[str] | None = None) -> str:
    """One expression for a base name; no or empty patterns mean the defaults."""
    return "^(?:" + "|".join(f"(?:{fnmatch.translate(p)})" for p in (patterns or SKIP_PATTERNS)) + ")"


def skip_reason(path: Column, size: Column, has_nul: Column, patterns: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> Column:
    """directory, name, size or binary; null for files that a scan keeps. The cheap checks come first."""
    rx = skip_regex(patterns)
    parts = F.split(path, "/")
    in_dir = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.rlike(rx))
    return F.when(in_dir, "directory").when(base_name(path).rlike(rx), "name").when(size > max_size, "size").when(has_nul, "binary")


def file_rows(files: DataFrame) -> DataFrame:
    """File rows of (repo, path, hash, size): ids and the flags that the path decides. Null paths give no row."""
    lang = language(F.col("path"))
    return files.where("path is not null").select(
        short_sha(16, "repo", "path", "hash").alias("file_id"), "repo", "path", lang.alias("language"), "hash", F.col("size").cast("bigint").alias("size"),
        is_entrypoint(F.col("path"), lang).alias("is_entrypoint"), is_test(F.col("path")).alias("is_test"), is_config(F.col("path")).alias("is_config"),
    )


def module_name(path: Column) -> Column:
    """The first segment of a path, or root for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def module_members(files: DataFrame) -> DataFrame:
    """(module_id, repo, name, path_pattern, file_id, ord): a row per file and its module. Membership is a relation, as a module has no bound on its files."""
    name = module_name(F.col("path"))
    return files.select(short_sha(16, F.col("repo"), F.lit("module"), name).alias("module_id"), "repo", name.alias("name"), F.concat(name, F.lit("/")).alias("path_pattern"), "file_id", "ord")


def modules(files: DataFrame, shown: int = 15) -> DataFrame:
    """(module_id, repo, name, path_pattern, n_files, files): numbers of files, and the first by ord."""
    m = module_members(files)
    key = ["module_id", "repo", "name", "path_pattern"]
    counts = m.groupBy(*key).agg(F.count("*").alias("n_files"))
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("module_id").orderBy("ord"))).where(F.col("k") <= shown)
    lists = first.groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "file_id"))), lambda s: s["file_id"]).alias("files"))
    return counts.join(lists, "module_id")


def module_entrypoints(files: DataFrame, shown: int = 5) -> DataFrame:
    """(module_id, repo, name, n_files, n_entrypoints, entrypoints): files and entry points of each module, the first entry points by ord."""
    m = module_members(files).join(files.select("file_id", "path", "is_entrypoint"), "file_id")
    counts = m.groupBy("module_id", "repo", "name").agg(F.count("*").alias("n_files"), F.count_if("is_entrypoint").alias("n_entrypoints"))
    first = m.where("is_entrypoint").withColumn("k", F.row_number().over(Window.partitionBy("module_id").orderBy("ord"))).where(F.col("k") <= shown)
    lists = first.groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda s: s["path"]).alias("entrypoints"))
    return counts.join(lists, "module_id", "left").withColumn("entrypoints", F.coalesce("entrypoints", F.array().cast("array<string>")))


def histogram(df: DataFrame, by: list[str], column: Column, k: int | None = None) -> DataFrame:
    """Counts of a column's values within groups, the k most frequent where k is given (ties by value)."""
    g = df.groupBy(*by, column.alias("value")).agg(F.count("*").alias("n"))
    if k is None:
        return g
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
