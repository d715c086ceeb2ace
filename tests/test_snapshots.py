from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeloom.operators import snapshots as S


def make(spark, seed=1, n=6, keys=60):
    rnd = random.Random(seed)
    snaps, files, syms = [], [], []
    state = {f"p{i}": "h0" for i in range(keys)}
    for s in range(n):
        for _ in range(8):
            k = f"p{rnd.randrange(keys + 20)}"
            state.pop(k) if k in state and rnd.random() < 0.4 else state.__setitem__(k, rnd.choice("ABC"))
        status = "failed" if s == 3 else " Complete"
        when = datetime(2024, 1, 1) + timedelta(days=s)
        snaps += [(f"s{s}", "r", "main", f"{when:%Y-%m-%dT%H:%M:%S}{rnd.choice(['Z', '+05:30', '-08:00'])}", status)] * 2
        for k, h in state.items():
            files += [(f"S{s} ", rnd.choice(["", "./"]) + k, rnd.choice([h, h.lower()]), when)] * rnd.choice([1, 2])
            syms.append((f"s{s}", "y" + k, when))
    return (
        spark.createDataFrame(snaps, "snapshot_id string, repo_id string, branch string, created_at string, status string"),
        spark.createDataFrame(files, "snapshot_id string, path string, hash string, ingested_at timestamp"),
        spark.createDataFrame(syms, "snapshot_id string, symbol_id string, ingested_at timestamp"),
    ), (snaps, files, syms)


def brute(snaps, files, syms):
    clean = lambda x: x.strip().lower()
    order = sorted({(datetime.fromisoformat(s[3]), s[0]) for s in snaps if clean(s[4]) == "complete"})
    f, y = {}, {}
    for s, p, h, _ in files:
        f.setdefault(clean(s), {})[p.removeprefix("./")] = clean(h)
    for s, k, _ in syms:
        y.setdefault(clean(s), set()).add(k)
    out = set()
    for (_, a), (_, b) in zip(order, order[1:]):
        for k in f[a].keys() | f[b].keys():
            if f[a].get(k) != f[b].get(k):
                out.add((b, "file", k, "added" if k not in f[a] else "removed" if k not in f[b] else "changed"))
        out |= {(b, "symbol", k, "added") for k in y[b] - y[a]} | {(b, "symbol", k, "removed") for k in y[a] - y[b]}
    return out


def test_equals_brute_force(spark):
    dfs, raw = make(spark)
    assert {tuple(r) for r in S.p5_found(*dfs).collect()} == brute(*raw)


def test_many_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_KEYS", 7)
    dfs, raw = make(spark, seed=2)
    assert {tuple(r) for r in S.p5_found(*dfs).collect()} == brute(*raw)


def test_ordinals_persist(spark):
    key = lambda ks: spark.createDataFrame([("b", "file", k) for k in ks], "branch_key string, record_type string, key string")
    one = S.assign_ordinals(key("abc"))
    two = S.assign_ordinals(key("abcde"), one)
    old = {r.key: (r.bucket, r.ordinal) for r in one.collect()}
    new = {r.key: (r.bucket, r.ordinal) for r in two.collect()}
    assert {k: new[k] for k in old} == old and len(set(new.values())) == 5


def test_containers_beyond_one_bitmap(spark):
    rows = spark.range(1, 40_000).select(F.lit("b").alias("branch_key"), F.lit("file").alias("record_type"), F.lit("s").alias("snap"), F.lit(0).cast("bigint").alias("bucket"), F.col("id").alias("ordinal"), (F.col("id") * 3).alias("h"))
    got = S.containers(rows).collect()
    assert sorted(r.part for r in got) == [1, 2] and sum(len(r.vec) for r in got) == 39_999
