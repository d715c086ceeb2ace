"""Risk areas: lines that match a category's patterns, with their enclosing symbols, reduced to one row per file and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import extension, short_sha
from codeloom.operators.files import base_name

# The patterns of each category; a line belongs to a category if any of them occurs in it, in any letter case.
PATTERNS = {
    "authentication": [r"authenticate|login|logout|sign_in|sign_out|verify_password|check_password|jwt|token", r"session|cookie|oauth|auth_"],
    "authorization": [r"authorize|permission|role|access_control|is_admin|has_role|check_access", r"rbac|acl|guard|policy"],
    "database_write": [r"insert|update|delete|drop|create_table|alter_table|execute_sql", r"\.(save|create|update|delete|remove|bulk_create|bulk_update)\(", r"cursor|execute|commit|rollback"],
    "external_api": [r"requests\.(get|post|put|delete|patch)|httpx|aiohttp|fetch|urllib", r"api_url|endpoint|webhook|http_client|rest_client", r"send_request|call_api|invoke_api|api_call"],
    "file_system_write": [r"""open\(.*['"]w|write\(|writelines|os\.remove|os\.rename|shutil\.""", r"pathlib.*write_|mkdir|rmtree|copy2|move"],
    "config_secrets": [r"(password|secret|api_key|access_key|private_key|token)\s*=", r"getenv|environ|os\.environ|dotenv|\.env", r"credential|certificate|ssl_context"],
    "cache": [r"cache|redis|memcached|lru_cache|functools\.cache", r"cache_set|cache_get|cache_delete|invalidate"],
}
# Extensions and base names of files that are not scanned.
SKIP_EXTENSIONS = "json yaml yml toml ini cfg conf xml svg html css scss less md txt rst lock map png jpg jpeg gif ico webp ttf woff woff2 env example sample".split()
SKIP_NAMES = "package.json package-lock.json tsconfig.json jsconfig.json app.json metro.config.js babel.config.js webpack.config.js eslint.config.js .eslintrc .eslintrc.js .eslintrc.json .prettierrc .prettierrc.js .prettierrc.json .prettierignore .editorconfig .gitignore .gitattributes dockerfile docker-compose.yml docker-compose.yaml makefile cmakelists.txt pyproject.toml setup.py setup.cfg tox.ini requirements.txt constraints.txt .env .env.local .env.production .env.development app.config web.config nuget.config declarations.d.ts global.d.ts".split()


def pattern(category: str) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in PATTERNS[category])


def eligible(files: DataFrame) -> DataFrame:
    """Files (path, language, content) that are scanned: source code with a text."""
    name = F.lower(base_name(F.col("path")))
    return files.where(~name.isin(SKIP_NAMES) & ~extension(F.col("path")).isin(SKIP_EXTENSIONS) & (F.coalesce(F.col("language"), F.lit("unknown")) != "unknown") & (F.length("content") > 0))


#: Lines of one bucket, when lines meet the symbols around them.
BUCKET = 64


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """lines (file_id, n, …) with symbol_name: the first symbol by ord of the file whose range holds the line, else null. Ranges are cut into buckets of lines, so that a line is not compared with all symbols of its file."""
    s = symbols.select("file_id", "line_start", "line_end", F.col("name").alias("symbol_name"), F.col("ord").alias("symbol_ord"))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))
    keyed = lines.select("file_id", "n").distinct().withColumn("bucket", F.floor(F.col("n") / BUCKET))
    hit = keyed.join(s, ["file_id", "bucket"]).where("n between line_start and line_end").groupBy("file_id", "n").agg(F.min_by("symbol_name", "symbol_ord").alias("symbol_name"))
    return lines.join(hit, ["file_id", "n"], "left")


def matches(lines: DataFrame) -> DataFrame:
    """(…, category) for each line (…, line) and category with a match."""
    cats = F.filter(F.array(*[F.when(F.col("line").rlike(pattern(c)), F.lit(c)) for c in PATTERNS]), lambda c: c.isNotNull())
    return lines.withColumn("category", F.explode(cats))


def severity(category: Column, n: Column) -> Column:
    return (
        F.when(category.isin("authentication", "authorization", "config_secrets"), "high")
        .when(category.isin("database_write", "external_api", "file_system_write"), F.when(n <= 5, "medium").otherwise("high"))
        .otherwise(F.when(n <= 3, "low").otherwise("medium"))
    )


def risk_areas(files: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per file and category of eligible files (file_id, path, size), their lines (file_id, n, line) and symbols.

    Within a file and category, matches count once per symbol, or per stripped line of at most 100 characters where no symbol holds them; the first by line counts. Evidence holds the
    first five, the range runs from the first to the last that counts, and the symbol is the first that is known.
    """
    found = enclosing(matches(lines), symbols).withColumn("evidence", F.left(F.btrim("line", F.lit(" \t")), F.lit(100)))
    keyed = found.withColumn("key", F.coalesce(F.nullif("symbol_name", F.lit("")), "evidence"))
    unique = keyed.groupBy("file_id", "category", "key").agg(F.min(F.struct("n", "evidence", "symbol_name")).alias("m")).select("file_id", "category", "m.*")
    w = Window.partitionBy("file_id", "category").orderBy("n", "evidence")
    g = unique.withColumn("k", F.row_number().over(w)).groupBy("file_id", "category").agg(
        F.count("*").alias("n_matches"), F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("symbol_name", F.when(F.col("symbol_name").isNotNull(), F.col("k"))).alias("symbol_name"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "evidence")))).alias("e"),
    )
    r = g.join(files.select("file_id", "path", "size"), "file_id")
    n = F.col("n_matches")
    confidence = F.least(F.lit(0.95), F.lit(0.7) + F.when(F.col("symbol_name").isNotNull(), 0.1).otherwise(0.0) + F.when(n >= 3, 0.1).otherwise(0.0) + F.when(F.col("size") > 500, 0.05).otherwise(0.0))
    return r.select(
        short_sha(16, F.col("category"), F.col("file_id"), F.col("first").cast("string")).alias("risk_id"), "category",
        F.concat(F.initcap(F.replace("category", F.lit("_"), F.lit(" "))), F.lit(" in "), F.col("path")).alias("name"), F.col("path").alias("file_path"), "symbol_name",
        F.col("first").cast("int").alias("line_first"), F.col("last").cast("int").alias("line_last"), F.transform("e", lambda s: s["evidence"]).alias("evidence"), "n_matches",
        F.round(confidence, 2).alias("confidence"), severity(F.col("category"), n).alias("severity"),
    )
