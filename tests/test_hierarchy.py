from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.operators.hierarchy import descendants, hierarchy, links_of

SCHEMA = "tree string, node string, parent string"


def brute(links):
    up = {}
    for t, n, p in links:
        if t is None or n is None:
            continue
        for node, parent in ((n, p), (p, None)):
            if node is not None:
                old = up.get((t, node))
                up[t, node] = min(x for x in (old, parent) if x is not None) if old or parent else None
    out = {}
    for t, n in up:
        seen, x = [n], n
        while (x := up[t, x]) is not None and x not in seen:
            seen.append(x)
        if x is None:
            out[t, n] = (seen[-1], len(seen) - 1, "/".join(reversed(seen)))
        else:
            out[t, n] = (min(seen[seen.index(x) :]), -1, None)
    return out, up


def check(spark, links, hot=100_000):
    want, up = brute(links)
    got = hierarchy(spark.createDataFrame(links, SCHEMA), hot).collect()
    assert {(r.tree_id, r.node_id): (r.root_id, r.depth, r.path) for r in got} == want
    good = [r for r in got if r.depth >= 0]
    for r in good:  # intervals hold exactly the nodes whose paths go on from here
        inside = {x.node_id for x in good if (x.tree_id, x.root_id) == (r.tree_id, r.root_id) and r.first < x.first <= r.last}
        assert inside == {x.node_id for x in good if x.tree_id == r.tree_id and x.path.startswith(r.path + "/")}
        assert r.subtree_size == len(inside) + 1
        if r.depth and r.chain_pos:  # a chain goes on in the largest child, next to its parent
            p = next(x for x in good if (x.tree_id, x.node_id) == (r.tree_id, r.parent_id))
            assert (p.chain_id, p.chain_pos + 1, p.first + 1) == (r.chain_id, r.chain_pos, r.first)
            assert r.subtree_size == max(x.subtree_size for x in good if (x.tree_id, x.parent_id) == (r.tree_id, r.parent_id))


def test_small_trees_and_cycles(spark):
    check(spark, [("t", "b", "a"), ("t", "c", "a"), ("t", "d", "b"), ("t", "e", "d"), ("t", "e", "d"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x"), ("t", "s", "s"), ("u", "a", None), (None, "q", "r"), ("u", None, "a")])


def test_deep_chain_and_wide_node(spark):
    deep = [("d", f"n{i:04}", f"n{i - 1:04}") for i in range(1, 70)]
    wide = [("w", f"c{i:04}", "hub") for i in range(300)] + [("w", f"g{i}", f"c{i:04}") for i in range(5)]
    check(spark, deep + wide)
    check(spark, wide, hot=40)  # the hub's children in groups


def test_bush_on_a_deep_chain(spark):
    deep = [("d", f"n{i:04}", f"n{i - 1:04}") for i in range(1, 40)]
    bush = [("d", f"b{i}", "n0010") for i in range(60)] + [("d", f"b{i}x", f"b{i}") for i in range(60)]
    loop = [("d", "x", "z"), ("d", "y", "x"), ("d", "z", "y"), *[("d", f"l{i}", "y") for i in range(5)], ("d", "l0a", "l0")]
    check(spark, deep + bush + loop)


def test_random_forests(spark):
    rnd = random.Random(7)
    links = [(f"t{rnd.randrange(3)}", f"n{i}", rnd.choice([None, f"n{rnd.randrange(40)}"])) for i in range(40)]
    check(spark, links)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.just("t"), st.sampled_from("abcdef"), st.sampled_from([None, *"abcdef"])), max_size=8))
def test_any_links(spark, links):
    check(spark, links)


def test_descendants(spark):
    tree = hierarchy(spark.createDataFrame([("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a")], SCHEMA))
    asked = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "none")], "tree_id string, node_id string")
    for bucket in (1, 2, 256):
        got = sorted((r.node_id, r.descendant_id, r.distance) for r in descendants(tree, asked, bucket).collect())
        assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]


def test_links_of_dirty_rows(spark):
    rel = spark.createDataFrame([(" S1 ", "A", "b ", "contains", 1), ("s1", "a", None, "contains", 2), ("s1", "a", "c", "calls", 3)], "snapshot_id string, source_id string, target_id string, relation_type string, tree string")
    ps = spark.createDataFrame([("F", "P", ["P.q", "", None]), ("f", None, None)], "file_id string, path string, children array<string>")
    got = {tuple(r) for r in links_of(rel, ps).where("node is not null").collect()}
    assert got == {("s1", "b", "a"), ("s1", "a", None), ("f", "P", None), ("f", "P.q", "P")}
