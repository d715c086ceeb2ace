"""Queries of the knowledge operators on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import conventions, files, glossary, relations, retrieval, risks, search, summaries
from codeloom.functions.keys import norm_id
from codeloom.lineage import cut
from codeloom.operators.profiles import DEFAULTS
from codeloom.parse import extract
from codeloom.plans import lens
from codeloom.tables import table

QUERY = "rounding follows the envelope sheet of the orchard"
REVIEW, DEV, DOC = DEFAULTS["review-agent"], DEFAULTS["dev-agent"], DEFAULTS["doc-agent"]


class Knowledge:
    """The lens tables of one folder. Shared: written once for a query that reads them often."""

    def __init__(self, spark: SparkSession, folder: str, shared: bool = False):
        keep = cut if shared else lambda df: df
        self.files = keep(lens.content_files(spark, folder))
        self.sources = lens.source_files(self.files)
        self.lines = lens.lines(self.sources)
        self.symbols = keep(lens.symbols(self.lines))

    def imports(self) -> DataFrame:
        return relations.imports(lens.own_imports(self.lines), self.files)

    def calls(self) -> DataFrame:
        return relations.calls(lens.call_sites(self.lines), self.symbols)

    def uses(self) -> DataFrame:
        names = lens.import_lines(self.lines).select("file_id", F.explode("names").alias("name"))
        return relations.uses(self.symbols, lens.body_words(self.lines, self.symbols), names)

    def risks(self) -> DataFrame:
        ok = risks.eligible(self.files)
        return risks.risk_areas(ok, lens.lines(ok), self.symbols)

    def members(self) -> DataFrame:
        return files.module_members(self.files)

    def conventions(self) -> DataFrame:
        return conventions.detect(self.files, self.symbols)


def _lens(f, shared: bool = False):
    return lambda spark, folder: f(Knowledge(spark, folder, shared))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")


def _stored(f):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(lens.stored_files(spark, folder), lens.stored_symbols(spark, folder), lens.stored_relations(spark, folder))

    return run


def _every(df: DataFrame, column: str) -> DataFrame:
    """The stated query set: rows whose ord is divisible by 100."""
    return df.where("ord % 100 = 0").select(F.col(column).alias("target"))


def _scan_skips(spark: SparkSession, folder: str) -> DataFrame:
    d = lens.content_files(spark, folder)
    reason = files.skip_reason(F.col("path"), F.col("size"), F.contains(F.left("content", F.lit(8192)), F.lit("\0")))
    return d.groupBy("repo", reason.alias("skip_reason")).agg(F.count("*").alias("n_files"))


def _snapshot_counts(k: Knowledge) -> DataFrame:
    f = k.files.groupBy("repo").agg(F.count("*").alias("n_files"))
    s = k.symbols.groupBy("repo").agg(F.count("*").alias("n_symbols"))
    return f.join(s, "repo", "left").select("repo", "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def _all_relations(k: Knowledge) -> DataFrame:
    i = k.imports()
    parts = {"contains": relations.contains(k.members(), k.symbols), "imports": i, "calls": k.calls(), "depends_on": relations.depends_on(i), "uses": k.uses().select("source_id", "target_id", F.lit("uses").alias("relation_type"), "confidence", F.lit("").alias("evidence"))}
    return relations.all_relations(parts).groupBy("family_ord", "relation_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _import_resolution(k: Knowledge) -> DataFrame:
    """Imports of a repository, the modules they name, and how many name one of its files."""
    own = lens.own_imports(k.lines).groupBy("repo").agg(F.count("*").alias("n_imports"), F.countDistinct("module_path").alias("n_modules"))
    hits = k.imports().join(k.files.select(F.col("file_id").alias("source_id"), "repo"), "source_id").groupBy("repo").agg(F.count("*").alias("n_resolved"))
    return own.join(hits, "repo", "left").select("repo", "n_imports", "n_modules", F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"))


def _stored_imports(spark: SparkSession, folder: str) -> DataFrame:
    """The stored relations of type imports, as edges with evidence."""
    r = table(spark, folder, "relations").where("relation_type = 'imports'").select(norm_id("source_id").alias("source_id"), norm_id("target_id").alias("target_id"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    return r.where("source_id is not null and target_id is not null")


def _change_sets(f: DataFrame) -> DataFrame:
    c = f.where("ord % 100 < 2")
    return c.select(F.floor(F.col("ord") / 100).cast("bigint").alias("target"), "path", F.col("ord").alias("place"))


def _stored_members(f: DataFrame) -> DataFrame:
    return files.module_members(f.withColumn("repo", F.lit("stored")))


def _module_targets(f: DataFrame) -> DataFrame:
    return f.select(files.module_name(F.col("path")).alias("target")).distinct()


def _semantic(spark: SparkSession, folder: str) -> DataFrame:
    k = Knowledge(spark, folder, shared=True)
    docs = k.files.select(F.col("file_id").alias("id"), F.col("content").alias("text"))
    return retrieval.semantic_items(search.search(docs, QUERY, 10), k.risks(), k.conventions(), QUERY, REVIEW)


def _neighbours(f: DataFrame, s: DataFrame, r: DataFrame) -> DataFrame:
    return relations.neighbours(r, _every(f, "file_id"), ["imports", "depends_on", "uses"]).select("target", "other", "reason")


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours in the graph of suppliers and parts that lineitem spans."""
    li = table(spark, folder, "lineitem")
    g = li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_id"), F.lit("ships").alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    t = table(spark, folder, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("target"))
    return relations.neighbours(g, t, ["ships"]).select("target", "other", "reason", "ord")


QUERIES = {
    "semantic_topk": lambda s, d: search.search(_docs(s, d), QUERY, 10),
    "semantic_topk_filtered": lambda s, d: search.search(_docs(s, d), QUERY, 10, table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))),
    "tokenize_counts": lambda s, d: search.term_counts(_docs(s, d)).groupBy("id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms")),
    "idf_table": lambda s, d: search.idf_table(search.term_counts(_docs(s, d)), _docs(s, d).count()).select("term", "df", F.round("idf", 6).alias("idf")),
    "doc_norms": lambda s, d: search.norms(search.term_counts(_docs(s, d)), search.idf_table(search.term_counts(_docs(s, d)), _docs(s, d).count())).select("id", F.round("norm", 4).alias("norm")),
    "scan_file_rows": lambda s, d: files.file_rows(lens.file_row_input(s, d)),
    "scan_skip_filters": _scan_skips,
    "module_groups": _lens(lambda k: files.modules(k.files)),
    "module_entrypoints": _lens(lambda k: files.module_entrypoints(k.files)),
    "snapshot_counts": _lens(_snapshot_counts),
    "ext_histogram": _lens(lambda k: files.histogram(k.files, ["repo"], F.regexp_extract("path", r"\.([^./]*)$", 1), 5)),
    "kind_histogram": lambda s, d: files.histogram(table(s, d, "symbols"), [], F.col("kind"), None),
    "line_symbols": _lens(lambda k: k.symbols.select("symbol_id", "file_id", "name", "kind", "line_start", "line_end")),
    "contains_edges": _lens(lambda k: relations.contains(k.members(), k.symbols)),
    "import_edges": _lens(lambda k: k.imports()),
    "depends_on_edges": lambda s, d: relations.depends_on(_stored_imports(s, d)),
    "call_edges": _lens(lambda k: k.calls()),
    "uses_edges": _lens(lambda k: k.uses()),
    "uses_parser": lambda s, d: relations.parser_usages(
        table(s, d, "parsed_symbols").where("return_type is not null").select(F.col("file_id").alias("repo"), F.col("name").alias("source_symbol"), F.element_at(F.split(F.try_element_at("children", F.lit(1)), r"\."), -1).alias("target_name")),
        table(s, d, "parsed_symbols").select(F.col("file_id").alias("repo"), "name", F.concat_ws(":", "file_id", "path").alias("symbol_id"), "ord"),
    ),
    "relation_families": _lens(_all_relations, shared=True),
    "import_resolution": _lens(_import_resolution),
    "risk_areas": _lens(lambda k: k.risks()),
    "risk_severity_counts": _lens(lambda k: k.risks().groupBy("category", "severity").agg(F.count("*").alias("n_areas"), F.sum("n_matches").alias("n_matches"))),
    "conventions": _lens(lambda k: k.conventions()),
    "convention_evidence": _lens(lambda k: conventions.evidence(k.files, F.col("path").startswith("src/"), "path", 5)),
    "file_summaries": _lens(lambda k: summaries.file_summaries(k.files, k.symbols)),
    "symbol_summaries": _lens(lambda k: summaries.symbol_summaries(lens.bodies(k.lines, k.symbols))),
    "module_summaries": _lens(lambda k: summaries.module_summaries(k.members(), k.files)),
    "summary_lookup_last_wins": lambda s, d: summaries.last_by_target(table(s, d, "summaries").withColumn("target_id", F.nullif(F.lower(F.trim("target_id")), F.lit("")))),
    "glossary_caps": _lens(lambda k: glossary.caps(k.files)),
    "glossary_pascal": _lens(lambda k: glossary.pascal(k.symbols)),
    "glossary_paths": _lens(lambda k: glossary.paths(k.files)),
    "glossary_entries": _lens(lambda k: glossary.entries(k.files, k.symbols)),
    "glossary_lookup": _lens(lambda k: glossary.lookup(glossary.entries(k.files, k.symbols), k.files.select(F.element_at(F.split("path", "/"), 2).alias("term")))),
    "lexicon_hits": _lens(lambda k: glossary.lexicon_hits(k.files, k.files.select(F.element_at(F.split("path", "/"), 2).alias("keyword")).where("keyword rlike '^[a-z]{3,}$'").distinct())),
    "file_context": _stored(lambda f, s, r: retrieval.file_context(f, s, r, _every(f, "file_id"), REVIEW)),
    "file_context_dev": _stored(lambda f, s, r: retrieval.file_context(f, s, r, _every(f, "file_id"), DEV)),
    "symbol_context": _stored(lambda f, s, r: retrieval.symbol_context(f, s, _every(s, "name").unionByName(_every(s, "symbol_id")), DOC)),
    "module_context": _stored(lambda f, s, r: retrieval.module_context(_stored_members(f), s, _module_targets(f), DEV)),
    "change_context": _stored(lambda f, s, r: retrieval.change_context(f, s, r, _change_sets(f), REVIEW)),
    "context_totals": _stored(lambda f, s, r: retrieval.totals(retrieval.file_context(f, s, r, _every(f, "file_id"), REVIEW))),
    "context_relations": _stored(lambda f, s, r: retrieval.relations_of(r, _every(f, "file_id"), REVIEW).select("target", "source_id", "relation_type", "target_id", "rank")),
    "context_relation_totals": _stored(lambda f, s, r: retrieval.relation_totals(r, _every(f, "file_id"), REVIEW)),
    "semantic_context": _semantic,
    "neighbour_expand": _stored(_neighbours),
    "neighbour_graph": _graph,
    "relation_dedup": lambda s, d: relations.dedup(table(s, d, "relations").select("source_id", "relation_type", "target_id", "ord", "confidence")),
    "extracted_symbols": _lens(lambda k: extract.symbol_rows(extract.extract(k.sources)).select("file_id", "path", "hash", "ordinal", "name", "kind", "line_start", "line_end", "visibility", "parameters")),
    "extracted_imports": _lens(lambda k: extract.import_rows(extract.extract(k.sources))),
    "extracted_calls": _lens(lambda k: extract.call_rows(extract.extract(k.sources))),
    "ext_dense_topk": lambda s, d: search.dense_search(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 100 = 0")),
}


# ---- SQL -------------------------------------------------------------------------------------------------------------------------------------


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_ID = "nullif(lower(trim({0})), '')".format
_PATH = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_STEM = lambda e: rf"case when {e} like '_%.%' and regexp_matches({e}, '.\.[^.]*$') then regexp_replace({e}, '\.[^.]*$', '') else {e} end"
_EXT = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"
_BASE = "split_part(path, '/', -1)"
_LANG = "case " + " ".join(f"when {_EXT} = '{e}' then '{v}'" for e, v in files.LANGUAGES.items()) + " else 'unknown' end"
_ENTRY = "(" + " or ".join(f"({_LANG} = '{k}' and lower({_BASE}) in {_in(v)})" for k, v in files.ENTRYPOINTS.items()) + ")"
_DEF = lens.DEFINITION.replace("'", "''")
_MODULE = "case when path like '%/%' then split_part(path, '/', 1) else 'root' end"

_CONTENT = rf"""
fp as (select fid, min(path) path from (select {_ID('file_id')} fid, {_PATH} as path from files where path is not null) where fid is not null group by 1),
cf0 as (select doc_id ord, source repo, path, {_LANG} as language, sha256(text) hash, strlen(text) size, {_ENTRY} as is_entrypoint, regexp_replace(text, '\r\n?', chr(10), 'g') as content
  from documents join fp on {_ID('file_id')} = fid where text is not null),
cf1 as (select *, left(sha256(repo || ':' || path || ':' || hash), 16) file_id from cf0),
cf as (select * from cf1 qualify row_number() over (partition by file_id order by ord) = 1),
ls0 as (select repo, file_id, ord file_ord, string_split(content, chr(10)) l, language from cf),
lsall as (select repo, file_id, file_ord, len(l) n_lines, unnest(range(1, len(l) + 1)) n, unnest(l) line, language from ls0),
ls as (select * from lsall where language in ('python', 'typescript', 'javascript', 'c_sharp')),
sy0 as (select *, regexp_extract(line, '{_DEF}', 1) w, regexp_extract(line, '{_DEF}', 2) name from ls where regexp_matches(line, '{_DEF}')),
sy1 as (select *, case when w in ('def', 'function') then case when regexp_matches(line, '^\s') then 'method' else 'function' end else w end kind from sy0),
sy2 as (select *, length(regexp_extract(line, '^\s*')) ind from sy1),
sy as (select left(sha256(repo || ':' || file_id || ':' || name || ':' || n), 16) symbol_id, repo, file_id, name, kind || '.' || name as path, kind, n line_start, coalesce((select min(t.n) from sy2 t where t.file_id = s.file_id and t.n > s.n and t.ind <= s.ind) - 1, n_lines) line_end, file_ord * 4294967296 + n ord from sy2 s)
"""
_C = "with " + _CONTENT
_MEMBERS = f", mm as (select left(sha256(repo || ':module:' || {_MODULE}), 16) module_id, repo, {_MODULE} as name, {_MODULE} || '/' path_pattern, file_id, ord from cf)"
_PY_FROM, _TS_FROM = lens.PY_FROM, lens.TS_FROM.replace("'", "''")
_IMPORTS = rf""", im as (select file_id || ':' || n import_id, repo, file_id, case when regexp_matches(line, '{_PY_FROM}') then regexp_extract(line, '{_PY_FROM}', 1) else regexp_extract(line, '{_TS_FROM}', 2) end m, true is_from from ls where regexp_matches(line, '{_PY_FROM}') or regexp_matches(line, '{_TS_FROM}')),
ca0 as (select *, replace(m, '.', '/') d, regexp_replace(m, '^[./]+', '') b from im),
ca1 as (select *, case when is_from then [d || '.py', d || '/__init__.py', d || '.ts', d || '.tsx', m || '.py', m || '.ts', b, b || '.ts', b || '.tsx'] else [d || '.py', d || '/__init__.py', d || '.ts', d || '.cs', b] end c from ca0),
ca as (select import_id, repo, file_id, m, unnest(range(0, len(c))) pos, unnest(c) path from ca1),
bp as (select repo, path, arg_max(file_id, ord) target_id from cf group by all),
ie as (select ca.file_id source_id, bp.target_id, 'imports' relation_type, 0.9::double confidence, 'import ' || m evidence from ca join bp using (repo, path) qualify row_number() over (partition by import_id order by pos) = 1)"""
_CALLS = r""", cs0 as (select repo, file_id, n, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) callee from ls),
cs as (select c.repo, c.callee, c.n, c.file_id, (select arg_max(s.name, s.line_start) from sy s where s.file_id = c.file_id and c.n between s.line_start and s.line_end) caller from cs0 c),
fn as (select repo, name, arg_min(symbol_id, ord) symbol_id from sy group by all),
lp as (select repo, path, arg_max(symbol_id, ord) symbol_id from sy group by all),
ce as (select a.symbol_id source_id, coalesce(b.symbol_id, p.symbol_id) target_id, 'calls' relation_type, 0.7::double confidence, callee || ' at line ' || n evidence from cs join fn a on a.repo = cs.repo and a.name = cs.caller
  left join fn b on b.repo = cs.repo and b.name = cs.callee left join lp p on p.repo = cs.repo and p.path = cs.callee where coalesce(b.symbol_id, p.symbol_id) is not null)"""
_USES = rf""", bw as (select distinct s.symbol_id, w.word from (select file_id, n, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) word from ls) w join sy s on s.file_id = w.file_id and w.n between s.line_start and s.line_end),
il as (select file_id, trim(unnest(string_split(case when regexp_matches(line, '{lens.PY_FROM}') then regexp_extract(line, '{lens.PY_FROM}', 2) else regexp_extract(line, '{lens.TS_FROM.replace("'", "''")}', 1) end, ','))) name from ls where regexp_matches(line, '{lens.PY_FROM}') or regexp_matches(line, '{lens.TS_FROM.replace("'", "''")}')),
us as (select source_id, target_id, max(confidence)::double confidence from (
  select s.symbol_id source_id, t.symbol_id target_id, 0.75 confidence from sy s join bw using (symbol_id) join (select distinct * from il) il on il.file_id = s.file_id and il.name = bw.word join sy t on t.repo = s.repo and t.name = bw.word where s.symbol_id <> t.symbol_id
  union all select s.symbol_id, t.symbol_id, 0.6 from sy s join bw using (symbol_id) join sy t on t.file_id = s.file_id and t.name = bw.word where s.symbol_id <> t.symbol_id) group by all)"""
_RISKS = rf""", el as (select * from cf where lower({_BASE}) not in {_in(risks.SKIP_NAMES)} and {_EXT} not in {_in(risks.SKIP_EXTENSIONS)} and language <> 'unknown' and length(content) > 0),
rm as (""" + " union all ".join(f"select l.file_id, n, line, '{c}' category from lsall l join el using (file_id) where regexp_matches(line, '{risks.pattern(c).replace(chr(39), chr(39) * 2)}')" for c in risks.PATTERNS) + r"""),
rs as (select r.*, (select arg_min(s.name, s.ord) from sy s where s.file_id = r.file_id and r.n between s.line_start and s.line_end) symbol_name, left(trim(line, chr(32) || chr(9)), 100) ev from rm r),
ru as (select * from (select *, coalesce(nullif(symbol_name, ''), ev) key from rs) qualify row_number() over (partition by file_id, category, key order by n, ev) = 1),
rk as (select *, row_number() over (partition by file_id, category order by n, ev) k from ru),
rg as (select file_id, category, count(*) n_matches, min(n) f, max(n) l, arg_min(symbol_name, k) filter (symbol_name is not null) symbol_name, list(ev order by k) filter (k <= 5) evidence from rk group by all),
ra as (select left(sha256(category || ':' || file_id || ':' || f), 16) risk_id, category, array_to_string(list_transform(string_split(category, '_'), lambda x: upper(x[1]) || x[2:]), ' ') || ' in ' || path as name, path file_path, symbol_name, f line_first, l line_last, evidence, n_matches,
  round(least(0.95, 0.7 + case when symbol_name is not null then 0.1 else 0 end + case when n_matches >= 3 then 0.1 else 0 end + case when size > 500 then 0.05 else 0 end), 2)::double confidence,
  case when category in ('authentication', 'authorization', 'config_secrets') then 'high' when category = 'cache' then case when n_matches <= 3 then 'low' else 'medium' end when n_matches <= 5 then 'medium' else 'high' end severity
  from rg join cf using (file_id))"""


_GLOSSARY = rf""", wk0 as (select repo, ord, path, regexp_extract_all(content, '[\pL\pN\pM_]+') w from cf), wk as (select repo, ord, path, unnest(range(len(w))) pos, unnest(w) term from wk0),
ak as (select * from wk where regexp_full_match(term, '[A-Z]{{2,}}(?:_[A-Z]+)*') and split_part(term, '_', 1) not in {_in(glossary.ACRONYMS + glossary.NOISE)}),
ag as (select * from (select repo, term, count(*) n, min(ord) "first" from ak group by all) qualify row_number() over (partition by repo order by n desc, "first", term) <= 20 and n >= 2),
ac as (select repo, term, list(path order by ord, pos)[:3] contexts from ak semi join ag using (repo, term) group by all),
bk as (select repo, ord, unnest(regexp_extract_all(name, '[A-Z][a-z]+')) term from sy),
bg as (select * from (select repo, term, count(*) n, min(ord) "first" from bk where length(term) > 3 group by all) qualify row_number() over (partition by repo order by n desc, "first", term) <= 15 and n >= 3),
ck0 as (select repo, ord, unnest(string_split(path, '/')) part from cf), ck as (select repo, ord, lower({_STEM('part')}) term from ck0 where part not in {_in(glossary.COMMON_SEGMENTS)}),
cg as (select * from (select repo, term, count(*) n, min(ord) "first" from ck where length(term) > 3 group by all) qualify row_number() over (partition by repo order by n desc, "first", term) <= 10 and n >= 2),
bx as (select * from bg anti join ag using (repo, term)), cx as (select * from cg anti join ag using (repo, term) anti join bx using (repo, term)),
gu as (
  select repo, term, 'Acronym/constant used in ' || len(contexts) || ' files' definition, 'acronym' category, contexts, 0.6::double confidence from ag join ac using (repo, term)
  union all select repo, term, 'Domain concept (found in ' || n || ' symbols)', 'domain', [], 0.5 from bx
  union all select repo, array_to_string(list_transform(string_split(translate(term, '_-', '  '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), 'Module/directory concept (in ' || n || ' paths)', 'domain', [], 0.4 from cx),
ge as (select repo, left(sha256(term || ':' || category), 12) glossary_id, term, definition, category, contexts, confidence, 'heuristic' source from gu)"""


def _conv(parts: tuple[str, str], kind: str, name: str, confidence: str, hits: str, frm: str, having: str) -> str:
    return f"select repo, left(sha256('{parts[0]}:{parts[1]}'), 16) convention_id, '{kind}' convention_type, '{name}' as name, round({confidence}, 6)::double confidence, ({hits})::bigint n_hits from {frm} group by repo having {having}"


def _any(e: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({e}), '{w}')" for w in words) + ")"


def _ratio_sql(frm: str, hit: str, least: float, parts, kind: str, name: str, fixed: str = "") -> str:
    h = f"count(*) filter ({hit})"
    return _conv(parts, kind, name, fixed or f"least(1.0, {h}::double / count(*))", h, frm, f"{h}::double / count(*) >= {least} and {h} > 0")


def _least_sql(frm: str, hit: str, k: int, parts, kind: str, name: str, confidence: float) -> str:
    h = f"count(*) filter ({hit})"
    return _conv(parts, kind, name, str(confidence), h, frm, f"{h} >= {k}")


_CONVENTIONS = ", cv as (" + " union all ".join([
    _ratio_sql("(select * from cf where language = 'python')", rf"regexp_matches({_BASE}, '^[a-z_][a-z0-9_]*\.py$')", 0.7, ("naming", "python_snake_case"), "naming_pattern", "Python snake_case file naming"),
    _ratio_sql("(select * from sy where kind = 'class')", "regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')", 0.7, ("naming", "pascal_class"), "naming_pattern", "PascalCase class naming"),
    _ratio_sql("(select * from sy where kind = 'function')", "regexp_matches(name, '^[a-z_][a-z0-9_]*$')", 0.7, ("naming", "snake_func"), "naming_pattern", "snake_case function naming"),
    _ratio_sql("cf", "starts_with(path, 'src/')", 0.5, ("module", "src_layout"), "module_structure", "src/ directory layout", "0.9"),
    _least_sql("cf", "suffix(path, '__init__.py')", 3, ("module", "python_packages"), "module_structure", "Python package modules", 0.9),
    _least_sql("cf", _any("path", conventions.CONFIG_WORDS), 1, ("config", "organization"), "config_organization", "Centralized configuration", 0.9),
    _least_sql("cf", "is_entrypoint", 1, ("entrypoint", "cli"), "entrypoint_pattern", "CLI entrypoint", 0.95),
    _least_sql("cf", "suffix(path, '__main__.py')", 1, ("entrypoint", "main_module"), "entrypoint_pattern", "__main__.py entrypoint pattern", 0.9),
    _conv(("layer", "cli_models_ingest"), "layered_architecture", "Layered architecture", "0.8", "count(*) filter (contains(path, '/cli/')) + count(*) filter (contains(path, '/models/')) + count(*) filter (contains(path, '/ingest/'))", "cf", "count(*) filter (contains(path, '/cli/')) > 0 and count(*) filter (contains(path, '/models/')) > 0 and count(*) filter (contains(path, '/ingest/')) > 0"),
    *[_conv(("pattern", r), "service_repository_pattern", f"{r.capitalize()} pattern", "case when sum(f) > 0 then 0.8 else 0.6 end", "sum(f) + sum(s)", f"(select repo, {_any('path', w)}::int f, 0 s from cf union all select repo, 0, {_any('name', w)}::int from sy)", "sum(f) + sum(s) > 0") for r, w in conventions.ROLES.items()],
    _least_sql("sy", _any("name", ["error", "exception"]), 1, ("error", "custom_exceptions"), "error_handling", "Custom exception classes", 0.9),
    _least_sql("cf", f"{_EXT} = 'py' and (contains(content, 'try:') or contains(content, 'except '))", 3, ("error", "try_except"), "error_handling", "Explicit try/except error handling", 0.8),
]) + ")"


def _tf(source: str) -> str:
    return rf"""dc as (select * from ({source})),
tk as (select id, unnest(regexp_extract_all(regexp_replace(lower(text), '[_\-./\\]', ' ', 'g'), '[a-z0-9]{{2,}}')) term from dc),
tf as (select id, term, count(*) tf from tk group by all),
idf as (select term, count(*) df, ln(((select count(*) from dc) + 1)::double / (count(*) + 1)) + 1 idf from tf group by all),
nm as (select id, sqrt(sum(pow(tf * idf, 2))) norm from tf join idf using (term) group by all)"""


def _top(source: str, query: str = QUERY, kept: str = "") -> str:
    words = search.query_tokens(query)
    q = " union all ".join(f"select '{w}' term, {words.count(w)} n" for w in dict.fromkeys(words))
    return _tf(source) + f""",
qv as (select term, n * idf w, idf from ({q}) join idf using (term)),
sc as (select id, round(sum(tf * idf * w) / (any_value(norm) * (select sqrt(sum(w * w)) from qv)), 6) score from tf join qv using (term) join nm using (id) {kept} group by id),
tp as (select id, score, row_number() over (order by score desc, id) rank from sc where score > 0 qualify rank <= 10)"""


_DOCS = "select doc_id id, text from documents where text is not null"
_STORED = f"""with sf as (select {_ID('file_id')} file_id, {_PATH} as path, hash, size, ord from files where {_ID('file_id')} is not null and path is not null qualify row_number() over (partition by {_ID('file_id')} order by ingested_at desc, ord desc) = 1),
ss as (select {_ID('symbol_id')} symbol_id, {_ID('file_id')} file_id, name, kind, ord from symbols where {_ID('symbol_id')} is not null qualify row_number() over (partition by {_ID('symbol_id')} order by ingested_at desc, ord desc) = 1),
sr as (select {_ID('source_id')} source_id, relation_type, {_ID('target_id')} target_id, min(ord) ord from relations where {_ID('source_id')} is not null and {_ID('target_id')} is not null group by all)"""


def _near(types, targets: str) -> str:
    return f"""ng0 as (select t.target, r.target_id other, relation_type || ' → target' reason, ord from sr r join ({targets}) t on r.source_id = t.target where relation_type in {_in(types)}
  union all select t.target, r.source_id, relation_type || ' ← source', ord from sr r join ({targets}) t on r.target_id = t.target where r.source_id <> r.target_id and relation_type in {_in(types)}),
ng as (select * from ng0 qualify row_number() over (partition by target, other order by ord, reason) = 1)"""


def _ranked(profile, source: str = "it") -> str:
    place = "case entity_type " + " ".join(f"when '{e}' then {i}" for i, e in enumerate(profile.preferred_entities)) + " else 99 end, " if profile.ranking_mode == "breadth_first" else ""
    return f"select target, entity_type, entity_id, relevance_score::double relevance_score, reason, row_number() over (partition by target order by {place}relevance_score desc, a, b, c, entity_id) rank from {source} qualify rank <= {profile.max_items}"


def _file_context(profile) -> str:
    t = "select file_id target from sf where ord % 100 = 0"
    return f"""{_STORED}, {_near(profile.preferred_relations, t)},
it as (select file_id target, 'File' entity_type, file_id entity_id, 1.0 relevance_score, 'Primary target file' reason, 0 a, 0 b, ord c from sf where ord % 100 = 0
  union all select f.file_id, 'Symbol', symbol_id, 0.95, 'Defined in ' || path, 0, 1, s.ord from sf f join ss s using (file_id) where f.ord % 100 = 0
  union all select ng.target, 'File', other, 0.7, reason, 0, 2, ng.ord from ng join sf on sf.file_id = other)
"""


SQL = {
    "semantic_topk": f"with {_top(_DOCS)} select * from tp",
    "semantic_topk_filtered": f"""with {_top(_DOCS, kept="where id in (select doc_id from documents where lang = 'en')")} select * from tp""",
    "tokenize_counts": f"with {_tf(_DOCS)} select id, sum(tf)::bigint n_tokens, count(*) n_terms from tf group by id",
    "idf_table": f"with {_tf(_DOCS)} select term, df, round(idf, 6) idf from idf",
    "doc_norms": f"with {_tf(_DOCS)} select id, round(norm, 4) norm from nm",
    "scan_file_rows": rf"""with sn as (select {_ID('snapshot_id')} snap, min({_ID('repo_id')}) repo from snapshots group by 1),
f as (select repo, {_PATH} as path, lower(hash) hash, max(size) size from files join sn on {_ID('snapshot_id')} = snap where path is not null group by all)
select left(sha256(repo || ':' || path || ':' || hash), 16) file_id, repo, path, {_LANG} as language, hash, size::bigint size, {_ENTRY} is_entrypoint,
 (list_has_any(string_split(lower(path), '/'), {list(files.TEST_DIRECTORIES)}) or regexp_matches({_STEM(f'lower({_BASE})')}, '{files.TEST_NAME}')) is_test, lower({_BASE}) in {_in(files.CONFIG_NAMES)} is_config from f""",
    "scan_skip_filters": rf"""{_C}, sk as (select repo, path, size, content, string_split(path, '/') p from cf)
select repo, case when len(list_filter(p[:-2], lambda x: regexp_matches(x, '^(node_modules|\.git|__pycache__|\.venv|venv|env|dist|build|eggs|.*\.egg-info|\.tox|\.mypy_cache|\.pytest_cache|\.ruff_cache|bin|obj|\.idea|\.vscode|.*\.min\.js|.*\.min\.css|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|\.DS_Store|Thumbs\.db)$'))) > 0 then 'directory'
 when regexp_matches(p[-1], '^(node_modules|\.git|__pycache__|\.venv|venv|env|dist|build|eggs|.*\.egg-info|\.tox|\.mypy_cache|\.pytest_cache|\.ruff_cache|bin|obj|\.idea|\.vscode|.*\.min\.js|.*\.min\.css|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|\.DS_Store|Thumbs\.db)$') then 'name' when size > 1048576 then 'size' when contains(left(content, 8192), chr(0)) then 'binary' end skip_reason, count(*) n_files from sk group by all""",
    "module_groups": f"{_C}{_MEMBERS} select module_id, repo, name, path_pattern, count(*) n_files, list(file_id order by ord)[:15] files from mm group by all",
    "snapshot_counts": f"{_C} select repo, n_files, coalesce(n_symbols, 0) n_symbols from (select repo, count(*) n_files from cf group by 1) left join (select repo, count(*) n_symbols from sy group by 1) using (repo)",
    "ext_histogram": rf"{_C} select * from (select *, row_number() over (partition by repo order by n desc, value) rank from (select repo, regexp_extract(path, '\.([^./]*)$', 1) as value, count(*) n from cf group by all)) where rank <= 5",
    "kind_histogram": "select kind as value, count(*) n from symbols group by all",
    "line_symbols": f"{_C} select symbol_id, file_id, name, kind, line_start::int line_start, line_end::int line_end from sy",
    "contains_edges": f"{_C}{_MEMBERS} select module_id source_id, file_id target_id, 'contains' relation_type, 1.0::double confidence, name evidence from mm union all select file_id, symbol_id, 'contains', 1.0, name from sy",
    "import_edges": f"{_C}{_IMPORTS} select * from ie",
    "depends_on_edges": f"select {_ID('source_id')} source_id, {_ID('target_id')} target_id, 'depends_on' relation_type, 0.8::double confidence, min(coalesce(evidence, '')) evidence from relations where relation_type = 'imports' and {_ID('source_id')} is not null and {_ID('target_id')} is not null group by 1, 2",
    "import_resolution": f"{_C}{_IMPORTS} select repo, n_imports, n_modules, coalesce(n_resolved, 0) n_resolved from (select repo, count(*) n_imports, count(distinct m) n_modules from im group by 1) left join (select c.repo, count(*) n_resolved from ie join cf c on c.file_id = ie.source_id group by 1) using (repo)",
    "call_edges": f"{_C}{_CALLS} select * from ce",
    "uses_edges": f"{_C}{_USES} select * from us",
    "uses_parser": """with ps as (select file_id repo, name, file_id || ':' || path symbol_id, ord from parsed_symbols), fn as (select repo, name, arg_min(symbol_id, ord) symbol_id from ps group by all),
u as (select file_id repo, name s, split_part(children[1], '.', -1) t from parsed_symbols where return_type is not null)
select distinct a.symbol_id source_id, b.symbol_id target_id, 'uses' relation_type, 0.8::double confidence, t evidence from u join fn a on a.repo = u.repo and a.name = s join fn b on b.repo = u.repo and b.name = t where a.symbol_id <> b.symbol_id""",
    "relation_families": f"""{_C}{_MEMBERS}{_IMPORTS}{_CALLS}{_USES} select family_ord, relation_type, count(*) n, round(avg(confidence), 6) confidence from (
select 0 family_ord, 'contains' relation_type, 1.0::double confidence from mm union all select 0, 'contains', 1.0 from sy union all select 1, 'imports', confidence from ie union all select 2, 'calls', confidence from ce
union all select 3, 'depends_on', 0.8 from (select distinct source_id, target_id from ie) union all select 4, 'uses', confidence from us) group by all""",
    "risk_areas": f"{_C}{_RISKS} select * replace (line_first::int as line_first, line_last::int as line_last) from ra",
    "risk_severity_counts": f"{_C}{_RISKS} select category, severity, count(*) n_areas, sum(n_matches)::bigint n_matches from ra group by all",
    "conventions": f"{_C}{_CONVENTIONS} select * from cv",
    "convention_evidence": f"{_C} select repo, list(path order by ord)[:5] evidence from cf where starts_with(path, 'src/') group by repo",
    "file_summaries": f"""{_C}, kn as (select file_id, kind, min(ord) f, count(*) n, list(name order by ord)[:3] names from sy group by all),
kp as (select file_id, string_agg(kind || '(s): ' || array_to_string(names, ', ') || case when n > 3 then ' +' || (n - 3) || ' more' else '' end, '; ' order by f) parts from kn group by all)
select file_id, concat_ws('. ', 'File ''' || {_BASE} || ''' (' || language || ')', 'Contains ' || parts, '(' || (length(content) - length(replace(content, chr(10), '')) + 1) || ' lines)') as content from cf left join kp using (file_id)""",
    "symbol_summaries": rf"""{_C}, bo as (select symbol_id, kind, name, line_start, list(line order by n) b from (select s.symbol_id, s.kind, s.name, s.line_start, n, line from sy s join ls l on l.file_id = s.file_id and l.n between s.line_start and s.line_end) group by all),
bm as (select *, len(list_filter(b, lambda x: starts_with(ltrim(x), 'def '))) m from bo)
select symbol_id, concat_ws('. ', upper(kind[1]) || kind[2:] || ' ''' || name || '''', case when kind = 'class' and m > 0 then 'with ' || m || ' method(s)' end, case when kind in ('function', 'method') and contains(b[1], '(') and contains(b[1], ')') then 'defined at line ' || line_start end, '(' || len(b) || ' lines)') as content from bm""",
    "module_summaries": f"{_C}{_MEMBERS} select module_id, concat_ws('. ', 'Module ''' || mm.name || '''', 'contains ' || count(*) || ' file(s)', 'Files include: ' || array_to_string(list(path order by mm.ord)[:5], ', ')) as content from mm join cf using (file_id) group by module_id, mm.name",
    "summary_lookup_last_wins": f"select {_ID('target_id')} target_id, content from summaries where {_ID('target_id')} is not null qualify row_number() over (partition by {_ID('target_id')} order by ingested_at desc, ord desc) = 1",
    "glossary_pascal": f"{_C}, oc as (select repo, ord, unnest(regexp_extract_all(name, '[A-Z][a-z]+')) term from sy), og as (select repo, term, count(*) n, min(ord) \"first\" from oc where length(term) > 3 group by all) select *, row_number() over (partition by repo order by n desc, \"first\", term) rank from og qualify rank <= 15 and n >= 3",
    "glossary_paths": f"{_C}, pt as (select repo, ord, unnest(string_split(path, '/')) part from cf), oc as (select repo, ord, lower({_STEM('part')}) term from pt where part not in {_in(glossary.COMMON_SEGMENTS)}), og as (select repo, term, count(*) n, min(ord) \"first\" from oc where length(term) > 3 group by all) select *, row_number() over (partition by repo order by n desc, \"first\", term) rank from og qualify rank <= 10 and n >= 2",
    "glossary_caps": rf"""{_C}, ok as (select * from (select repo, ord, unnest(regexp_extract_all(content, '[\pL\pN\pM_]+')) term from cf) where regexp_full_match(term, '[A-Z]{{2,}}(?:_[A-Z]+)*')),
oh as (select * from ok where split_part(term, '_', 1) not in {_in(glossary.ACRONYMS + glossary.NOISE)}), og as (select repo, term, count(*) n, min(ord) "first" from oh group by all) select *, row_number() over (partition by repo order by n desc, "first", term) rank from og qualify rank <= 20 and n >= 2""",
    "glossary_entries": f"{_C}{_GLOSSARY} select * from ge",
    "glossary_lookup": f"{_C}{_GLOSSARY} select * from ge where lower(term) in (select lower(split_part(path, '/', 2)) from cf where split_part(path, '/', 2) <> '')",
    "module_entrypoints": f"{_C}{_MEMBERS} select module_id, mm.repo, name, count(*) n_files, count(*) filter (is_entrypoint) n_entrypoints, coalesce(list(path order by mm.ord) filter (is_entrypoint), [])[:5] entrypoints from mm join cf using (file_id) group by module_id, mm.repo, name",
    "context_relation_totals": f"{_STORED}, t as (select file_id target from sf where ord % 100 = 0) select target, count(r.ord) total_relations from t left join sr r on (r.source_id = t.target or r.target_id = t.target) and relation_type in {_in(REVIEW.preferred_relations)} group by target",
    "lexicon_hits": f"{_C}, lx as (select distinct split_part(path, '/', 2) keyword from cf where regexp_full_match(split_part(path, '/', 2), '[a-z]{{3,}}')), wd as (select file_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) keyword from cf) select file_id, keyword, count(*) n from wd join lx using (keyword) group by all",
    "file_context": _file_context(REVIEW) + _ranked(REVIEW),
    "file_context_dev": _file_context(DEV) + _ranked(DEV),
    "symbol_context": f"""{_STORED}, t as (select name target from ss where ord % 100 = 0 union select symbol_id from ss where ord % 100 = 0),
fd as (select target, coalesce((select arg_min(symbol_id, ord) from ss where name = target), (select symbol_id from ss where symbol_id = target)) symbol_id from t),
fs as (select target, ss.* from fd join ss using (symbol_id)),
it as (select target, 'Symbol' entity_type, symbol_id entity_id, 1.0 relevance_score, 'Primary target symbol' reason, 0 a, 0 b, ord c from fs
  union all select target, 'File', fs.file_id, 0.9, 'Contains symbol ''' || name || '''', 0, 1, fs.ord from fs join sf using (file_id)
  union all select target, 'Symbol', s.symbol_id, 0.6, 'Sibling symbol in same file', 0, 2, s.ord from fs join sf using (file_id) join ss s on s.file_id = fs.file_id and s.symbol_id <> fs.symbol_id) {_ranked(DOC)}""",
    "module_context": f"""{_STORED}, mm as (select left(sha256('stored:module:' || {_MODULE}), 16) module_id, {_MODULE} as name, file_id, ord from sf),
it as (select distinct name target, 'Module' entity_type, module_id entity_id, 1.0 relevance_score, 'Primary target module' reason, 0 a, 0 b, 0 c from mm
  union all select name, 'File', file_id, 0.9, 'Part of module ''' || name || '''', 0, 1, ord from mm
  union all select mm.name, 'Symbol', symbol_id, 0.7, 'Symbol in module ''' || mm.name || '''', 0, 1, ss.ord from mm join ss using (file_id)) {_ranked(DEV)}""",
    "change_context": f"""{_STORED}, bp as (select path, arg_max(file_id, ord) file_id from sf group by 1), ch as (select ord // 100 target, path, ord place, bp.file_id from (select path, ord from sf where ord % 100 < 2) join bp using (path)),
{_near(REVIEW.preferred_relations, "select distinct file_id target from ch")},
i0 as (select target, 'File' entity_type, file_id entity_id, 1.0 relevance_score, 'Changed file' reason, place a, 0 b, 0 c from ch
  union all select target, 'Symbol', symbol_id, 0.9, 'Symbol in changed file ''' || path || '''', place, 1, s.ord from ch join ss s using (file_id)
  union all select ch.target, 'File', other, 0.49, reason, place, 2, ng.ord from ch join ng on ng.target = ch.file_id join sf on sf.file_id = other),
it as (select * from i0 qualify row_number() over (partition by target, entity_id order by a, b, c) = 1) {_ranked(REVIEW)}""",
    "context_totals": f"{_file_context(REVIEW)}, rk as ({_ranked(REVIEW)}) select target, count(*) filter (entity_type = 'File') total_files, count(*) filter (entity_type = 'Symbol') total_symbols, count(*) filter (entity_type = 'Module') total_modules from rk group by 1",
    "context_relations": f"""{_STORED}, t as (select file_id target from sf where ord % 100 = 0), x as (select t.target, r.* from sr r join t on r.source_id = t.target or r.target_id = t.target where relation_type in {_in(REVIEW.preferred_relations)})
select target, source_id, relation_type, target_id, row_number() over (partition by target order by ord, source_id, target_id) rank from x qualify rank <= {REVIEW.max_items}""",
    "semantic_context": f"""{_C}{_RISKS}{_CONVENTIONS}, {_top("select file_id id, content as text from cf")},
it as (select '{QUERY}' target, 'File' entity_type, id entity_id, score relevance_score, 'Semantic match for ''{QUERY}''' reason, 0 a, 0 b, rank c from tp union all select '{QUERY}', 'Convention', convention_id, 0.5, 'Detected convention', 0, 1, 0 from cv
  union all select '{QUERY}', 'Risk', risk_id, case severity when 'high' then 0.6 else 0.3 end, 'Risk area: ' || category, 0, 2, 0 from ra) {_ranked(REVIEW)}""",
    "neighbour_expand": f"{_STORED}, {_near(['imports', 'depends_on', 'uses'], 'select file_id target from sf where ord % 100 = 0')} select target, other, reason from ng",
    "neighbour_graph": """select 'p' || l_partkey target, 's' || l_suppkey other, 'ships ← source' reason, min(l_orderkey * 10 + l_linenumber) ord from lineitem where l_partkey % 100 = 0 group by all""",
    "relation_dedup": "select source_id, relation_type, target_id, ord, confidence from relations qualify row_number() over (partition by source_id, relation_type, target_id order by ord) = 1",
    "ext_dense_topk": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) l from v),
s as (select q.vec_id query_id, d.vec_id, round(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) / (q.l * d.l), 6) score from n q join n d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from s qualify rank <= 10""",
}
