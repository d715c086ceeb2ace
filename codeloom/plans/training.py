"""Queries of the general training-data problems (2, 3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import hierarchy, references, snapshots
from codeloom.tables import table


def _with(f, *names):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(*[table(spark, folder, n) for n in names])

    return run


QUERIES = {
    "p2_found": _with(hierarchy.p2_found, "relations", "parsed_symbols"),
    "p2_hierarchy": _with(hierarchy.p2_hierarchy, "relations", "parsed_symbols"),
    "p2_descendants": _with(hierarchy.p2_descendants, "relations", "parsed_symbols"),
    "p3_found": _with(references.p3_found, "files", "symbols", "relations", "summaries"),
    "p3_report": _with(references.p3_report, "files", "symbols", "relations", "summaries"),
    "p5_found": _with(snapshots.p5_found, "snapshots", "files", "symbols"),
    "p5_summary": _with(snapshots.p5_summary, "snapshots", "files", "symbols"),
}

_ID = "nullif(lower(trim({0})), '')".format
_PATH = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"

_LINKS = f"""
links as (
  select tree, node, min(parent) parent from (
    select {_ID('snapshot_id')} tree, coalesce({_ID('target_id')}, {_ID('source_id')}) node, case when {_ID('target_id')} is not null then {_ID('source_id')} end parent from relations where relation_type = 'contains'
    union all select {_ID('snapshot_id')}, {_ID('source_id')}, null from relations where relation_type = 'contains'
    union all select {_ID('file_id')}, nullif(path, ''), null from parsed_symbols
    union all select {_ID('file_id')}, nullif(child, ''), nullif(path, '') from (select file_id, path, unnest(children) child from parsed_symbols)
  ) where tree is not null and node is not null group by all),
"""

_TREES = f"""
with recursive {_LINKS}
down as (
  select tree, node, node root, 0 depth, node path from links where parent is null
  union all
  select l.tree, l.node, d.root, d.depth + 1, d.path || '/' || l.node from down d join links l on l.tree = d.tree and l.parent = d.node),
stuck as (select l.* from links l anti join down d on d.tree = l.tree and d.node = l.node),
up as (
  select tree, node, parent a from stuck
  union
  select u.tree, u.node, s.parent from up u join stuck s on s.tree = u.tree and s.node = u.a),
ring as (select tree, node from up where node = a),
low as (select u.tree, u.node, min(r.node) root from up u join ring r on r.tree = u.tree and r.node = u.a group by all)
"""

_SIZES = """,
above as (
  select tree, node, node a from down
  union all
  select a.tree, a.node, l.parent from above a join links l on l.tree = a.tree and l.node = a.a where l.parent is not null),
sizes as (select tree, a node, count(*) size from above group by all),
kids as (
  select l.*, s.size, row_number() over w = 1 heavy, 1 + coalesce(sum(s.size) over (w rows between unbounded preceding and 1 preceding), 0) off
  from links l join sizes s using (tree, node) where l.parent is not null window w as (partition by l.tree, l.parent order by s.size desc, l.node desc)),
placed as (
  select l.tree, l.node, l.parent, l.node root, 0 depth, l.node path, l.node chain, 0 pos, s.size, 0::hugeint a from links l join sizes s using (tree, node) where l.parent is null
  union all
  select k.tree, k.node, k.parent, p.root, p.depth + 1, p.path || '/' || k.node, case when k.heavy then p.chain else k.node end, case when k.heavy then p.pos + 1 else 0 end, k.size, p.a + k.off
  from placed p join kids k on k.tree = p.tree and k.parent = p.node)
"""

_P3 = f"""
with refs as (
  select 'symbols' table_name, 'file_id' ref_field, ord, 'file' kind, {_ID('file_id')} id, {_ID('snapshot_id')} snap, ingested_at seen from symbols
  union all select 'relations', 'source_id', ord, case when lower(trim(source_type)) in ('file', 'symbol') then lower(trim(source_type)) end, {_ID('source_id')}, {_ID('snapshot_id')}, ingested_at from relations
  union all select 'relations', 'target_id', ord, case when lower(trim(target_type)) in ('file', 'symbol') then lower(trim(target_type)) end, {_ID('target_id')}, {_ID('snapshot_id')}, ingested_at from relations
  union all select 'summaries', 'target_id', ord, case when lower(trim(target_type)) in ('file', 'symbol') then lower(trim(target_type)) end, {_ID('target_id')}, {_ID('snapshot_id')}, ingested_at from summaries),
recs as (
  select kind, id, snap, min(came) came from (
    select 'file' kind, {_ID('file_id')} id, {_ID('snapshot_id')} snap, ingested_at came from files
    union all select 'symbol', {_ID('symbol_id')}, {_ID('snapshot_id')}, ingested_at from symbols) group by all),
alln as (select * from recs union all select 'any', id, snap, min(came) from recs group by all),
ids as (select distinct kind, id from alln),
bad as (
  select r.*, case when i.id is null then 'missing' when b.id is null then 'deleted' when b.came > r.seen then 'late' end reason
  from refs r left join alln b on b.kind = coalesce(r.kind, 'any') and b.id = r.id and b.snap = r.snap
  left join ids i on i.kind = coalesce(r.kind, 'any') and i.id = r.id
  where r.id is not null)
"""

_P5 = f"""
with snaps as (
  select {_ID('snapshot_id')} snap, min({_ID('repo_id')}) repo, min(trim(branch)) branch, min(created_at::timestamptz) tm from snapshots where lower(trim(status)) = 'complete' group by 1),
pairs as (select * from (select snap, lag(snap) over (partition by repo, branch order by tm, snap) prev from snaps) where prev is not null),
recs as (
  select snap, record_type, key, arg_max(h, tm) h from (
    select {_ID('snapshot_id')} snap, 'file' record_type, {_PATH} as key, {_ID('hash')} h, ingested_at tm from files
    union all select {_ID('snapshot_id')}, 'symbol', {_ID('symbol_id')}, '', ingested_at from symbols) where snap is not null and key is not null and key <> '' group by all),
found as (
  select p.snap snapshot_id, c.record_type, c.key record_key, case when o.key is null then 'added' else 'changed' end change
  from pairs p join recs c on c.snap = p.snap left join recs o on o.snap = p.prev and o.record_type = c.record_type and o.key = c.key
  where o.key is null or o.h is distinct from c.h
  union all
  select p.snap, o.record_type, o.key, 'removed' from pairs p join recs o on o.snap = p.prev
  left join recs c on c.snap = p.snap and c.record_type = o.record_type and c.key = o.key where c.key is null)
"""

SQL = {
    "p2_found": _TREES + "select tree tree_id, node node_id, root root_id, depth::int depth from down union all select tree, node, root, -1 from low",
    "p2_hierarchy": _TREES + _SIZES + """select tree tree_id, node node_id, parent parent_id, root root_id, depth::int depth, path, chain chain_id, pos::bigint chain_pos, size::bigint subtree_size, a::bigint as "first", (a + size - 1)::bigint as "last" from placed
union all select w.tree, w.node, l.parent, w.root, -1, null, null, null, null, null, null from low w join links l using (tree, node)""",
    "p2_descendants": f"""with recursive {_LINKS} asked as (
  select {_ID('snapshot_id')} tree, {_ID('source_id')} node from relations where relation_type = 'contains' and ord % 100 = 0 union select {_ID('file_id')}, nullif(path, '') from parsed_symbols where ord % 100 = 0),
safe as (select tree, node from links where parent is null union all select l.tree, l.node from safe s join links l on l.tree = s.tree and l.parent = s.node),
under as (
  select tree, node q, node, 0 distance from asked join safe using (tree, node)
  union all
  select u.tree, u.q, l.node, u.distance + 1 from under u join links l on l.tree = u.tree and l.parent = u.node)
select tree tree_id, q node_id, node descendant_id, distance::int distance from under where distance > 0""",
    "p3_found": _P3 + "select distinct table_name, ref_field, ord, reason from bad where reason is not null",
    "p3_report": _P3 + "select table_name, ref_field, strftime(seen, '%Y-%m') as month, reason, count(*) n_refs from bad where reason is not null group by all",
    "p5_found": _P5 + "select * from found",
    "p5_summary": _P5 + "select snapshot_id, record_type, change, count(*) n_records from found group by all",
}
