"""codeloom ingest | list | show | query | context | profiles | version"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import functions as F

import codeloom
from codeloom import ingest as ingestion
from codeloom.lineage import clear, cut
from codeloom.operators import files, profiles, render, retrieval, search
from codeloom.session import local_session
from codeloom.sources.scan import scan_repository
from codeloom.sources.store import Store


def ingest(spark, store: Store, root: str, repo: str) -> str:
    """Scans a folder and writes all that is known of it as one snapshot; gives the snapshot's id."""
    scanned = cut(scan_repository(spark, root, repo).where("skip_reason is null"))
    snapshot = ingestion.snapshot_key(scanned)
    store.write(repo, snapshot, ingestion.build(scanned), datetime.now(UTC).strftime("%Y-%m-%d"))
    clear(spark)
    return snapshot


def query(store: Store, repo: str, kind: str, targets: list[str], profile: profiles.Profile, top_k: int = 10):
    """(ranked items, relations or None) for a file's path, a symbol's name or id, a module's name, changed paths or words to search for."""
    spark, read = store.spark, lambda name: store.read(name, repo)
    f, s, r = read("files"), read("symbols"), read("relations")
    asked = spark.createDataFrame([(x, k) for k, x in enumerate(targets)], "target string, place long")
    if kind == "file":
        ids = f.join(asked.withColumnRenamed("target", "path"), "path").select(F.col("file_id").alias("target"))
        return retrieval.file_context(f, s, r, ids, profile), retrieval.relations_of(r, ids, profile)
    if kind == "symbol":
        return retrieval.symbol_context(f, s, asked, profile), None
    if kind == "module":
        return retrieval.module_context(read("modules"), s, asked, profile), None
    if kind == "changes":
        changes = asked.select(F.lit("change").alias("target"), F.col("target").alias("path"), "place")
        return retrieval.change_context(f, s, r, changes, profile), None
    words = " ".join(targets)
    hits = search.search_index(read("postings"), read("idf"), read("norms"), words, top_k).join(read("entities"), "id")
    return retrieval.semantic_items(hits, read("risks"), read("conventions"), words, profile), None


def show(store: Store, repo: str) -> str:
    """Counts, modules and entry points of the latest snapshot."""
    f = store.read("files", repo).withColumn("repo", F.lit(repo))
    out = [store.metadata(repo)]
    out += [f"{m['name']}: {m['n_files']} files, entry points: {', '.join(m['entrypoints']) or 'none'}" for m in files.module_entrypoints(f).orderBy("name").toLocalIterator()]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codeloom")
    p.add_argument("--store", default="codeloom-store")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("root")
    a.add_argument("--repo", required=True)
    sub.add_parser("list")
    for name in ("show", "context", "query"):
        a = sub.add_parser(name)
        a.add_argument("--repo", required=True)
        if name == "query":
            a.add_argument("kind", choices=("file", "symbol", "module", "changes", "semantic"))
        if name != "show":
            a.add_argument("targets", nargs="+")
            a.add_argument("--profile", default="review-agent", choices=sorted(profiles.DEFAULTS))
            a.add_argument("--top-k", type=int, default=10)
    sub.add_parser("profiles")
    sub.add_parser("version")
    args = p.parse_args(argv)
    if args.what == "version":
        return print(codeloom.__version__)
    if args.what == "profiles":
        return print("\n".join(f"{x.name}: {x.description} (at most {x.max_items}, {x.ranking_mode})" for x in profiles.DEFAULTS.values()))
    spark = local_session()
    store = Store(spark, args.store)
    if args.what == "ingest":
        print(ingest(spark, store, args.root, args.repo))
    elif args.what == "list":
        store.manifest().show(truncate=False)
    elif args.what == "show":
        print(show(store, args.repo))
    else:
        print(render.bundle(*query(store, args.repo, getattr(args, "kind", "changes"), args.targets, profiles.DEFAULTS[args.profile], args.top_k)))


if __name__ == "__main__":
    main()
