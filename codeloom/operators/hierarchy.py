"""Parent-child links to full hierarchies (problem 2), by heavy-path decomposition.

From below, nodes without children are taken off layer by layer, each passing its subtree's size to its parent, as long as a layer takes a good part of what is left; so wide and shallow forests, the usual
kind, take few joins over ever fewer rows. What remains (deep trees, cycles and what leads to them) is walked by pointer doubling, in rounds that grow with the logarithm of the
depth; nodes that never reach a root are on a cycle or below one and are separated there. With all sizes known, each parent's largest child is its heavy one; heavy links form
chains, and any path meets at most log2(n) of them. From above, a node continues its parent's chain or begins one of its own: paths are concatenated from the segments of chains, and heavy-first preorder
numbers make each chain, and each subtree, one interval. No tree, and no parent's children, are ever held by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id
from codeloom.lineage import cut

SEPARATOR = "/"
#: Children of a parent that one task orders; those of a parent with more are dealt into groups of about so many.
HOT = 100_000
#: Layers are taken off from below until one leaves more than this share of the nodes.
KEPT = 2 / 3
#: Preorder numbers of one bucket, when intervals meet the nodes within them.
BUCKET = 256

KEY = ["tree", "node"]
BIG = "bigint"


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0).cast(BIG))


def _joined(prefix: str, name: str) -> Column:
    return F.concat_ws(SEPARATOR, prefix, name)


def climb(nodes: DataFrame, weights: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Doubles the pointers of nodes (node, up, costs, label, weight) until all that reach the end of their walk have; node and up are numbers.

    Gives (node, root, totals, trail, weight): root is the last node of the walk, totals the sums of costs (an array) and trail the joined labels over the walk without the
    root's own; with weights, weight is that of the node and of all below it. Second come the nodes that never reach an end (node, up, anc), None where there are none.
    """
    ended = F.col("up").isNull()
    state = cut(
        nodes.select(
            "node", "up", F.col("up").alias("anc"), F.when(ended, F.col("node")).alias("root"), F.when(ended, F.transform("costs", lambda x: F.lit(0).cast(BIG))).otherwise(F.col("costs")).alias("totals"),
            F.when(~ended, F.col("label")).alias("trail"), "weight",
        )
    )
    left = state.where("anc is not null").count()
    while left:
        far = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("root").alias("root2"), F.col("totals").alias("totals2"), F.col("trail").alias("trail2"))
        moved = state.join(far, "anc", "left").select(
            "node", "up", F.col("anc2").alias("anc"), F.coalesce("root", "root2").alias("root"), F.coalesce(F.zip_with("totals", "totals2", lambda x, y: x + y), "totals").alias("totals"),
            F.when(F.col("trail").isNotNull(), _joined("trail2", "trail")).alias("trail"), "weight",
        )
        if weights:
            sums = state.where("anc is not null").groupBy(F.col("anc").alias("node")).agg(F.sum("weight").alias("more"))
            moved = moved.join(sums, "node", "left").withColumn("weight", F.col("weight") + _zero("more")).drop("more")
        state = cut(moved)
        now = state.where("anc is not null").count()
        if now == left:  # every depth up to the largest occurs, so a round without an arrival is the last
            break
        left = now
    return state.where("anc is null").select("node", "root", "totals", "trail", "weight"), state.where("anc is not null").select("node", "up", "anc") if left else None


def cycle_roots(stuck: DataFrame, names: DataFrame) -> DataFrame:
    """(node, root) with the smallest name on the cycle that the walk of (node, up, anc) ends in; names (node, name)."""
    size = -1
    while True:  # the images of ever longer walks shrink to the nodes on cycles
        ends = stuck.select("anc").distinct().count()
        if ends == size:
            break
        size = ends
        stuck = cut(stuck.join(stuck.select(F.col("node").alias("anc"), F.col("anc").alias("anc2")), "anc").select("node", "up", F.col("anc2").alias("anc")))
    ring = stuck.join(stuck.select(F.col("anc").alias("node")).distinct(), "node").join(names, "node").select("node", F.col("up").alias("ptr"), F.col("name").alias("low"))
    while True:
        nxt = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        ring = cut(ring.join(nxt, "ptr").select("node", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        if not ring.where("changed").count():
            break
        ring = ring.drop("changed")
    return stuck.join(ring.select(F.col("node").alias("anc"), F.col("low").alias("root")), "anc").select("node", "root")


def layers_of(named: DataFrame, hot: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Of (tree, node, parent): layers of nodes with their subtree's size, each without children but in earlier layers; what remains, with the weight of a node and of all below it in layers;
    and the parents (tree, parent, n) of more than `hot` children."""
    kids = named.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    state = cut(named.join(kids, KEY, "left").select(*KEY, "parent", _zero("n").alias("n"), F.lit(1).cast(BIG).alias("weight")))
    many = state.where(F.col("n") > hot).select("tree", F.col("node").alias("parent"), "n")
    layers, left, now = [], state.count(), 0
    hub = None if many.isEmpty() else many
    while left:
        leaves = state.where("n = 0")
        gone = leaves.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("gone"), F.sum("weight").alias("more"))
        state = cut(state.where("n > 0").join(gone, KEY, "left").select(*KEY, "parent", (F.col("n") - _zero("gone")).alias("n"), (F.col("weight") + _zero("more")).alias("weight")))
        layers.append(leaves.select(*KEY, "parent", F.col("weight").alias("size")))
        now = state.count()
        if now > KEPT * left:
            break
        left = now
    return layers, state.select(*KEY, "parent", "weight") if now else None, hub


def ordered(rows: DataFrame, many: DataFrame | None, hot: int = HOT) -> DataFrame:
    """rows (tree, node, parent, size, …) with heavy, whether a node is its parent's largest child, and offset, its distance in preorder from its parent (0 for roots).

    Siblings come by descending size. The children of the parents (tree, parent, n) with very many of them are ordered within groups, which follow each other behind the heavy child.
    """
    key = ["tree", "parent"]
    roots = rows.where("parent is null").withColumns({"heavy": F.lit(False), "offset": F.lit(0).cast(BIG)})
    kids = rows.where("parent is not null")
    few = kids if many is None else kids.join(many, key, "left_anti")
    by_size = [F.desc("size"), F.desc("node")]
    w = Window.partitionBy(*key).orderBy(*by_size)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = roots.unionByName(few.withColumns({"heavy": F.row_number().over(w) == 1, "offset": 1 + before}))
    if many is None:
        return out
    theirs = kids.join(many, key)
    first = theirs.groupBy(*key).agg(F.max(F.struct("size", "node")).alias("h"))
    dealt = theirs.join(first, key).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / hot)))
    heavy = dealt.where("node = h.node").withColumns({"heavy": F.lit(True), "offset": F.lit(1).cast(BIG)})
    light = dealt.where("node <> h.node")
    sums = light.groupBy(*key, "salt").agg(F.sum("size").alias("sum"))
    base = F.coalesce(F.sum("sum").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy(*key, "salt").orderBy(*by_size).rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("own", F.coalesce(F.sum("size").over(w), F.lit(0))).join(sums.withColumn("base", base).drop("sum"), [*key, "salt"])
    light = light.withColumns({"heavy": F.lit(False), "offset": 1 + F.col("h.size") + F.col("base") + F.col("own")})
    return out.unionByName(heavy.select(*out.columns)).unionByName(light.select(*out.columns))


#: What is known of a node from above: of those on or below a cycle only the root, with depth -1.
FOUND = [*KEY, "parent", "root", "depth", "path", "chain", "pos", "size", "first"]


def _core_found(core: DataFrame, stuck: DataFrame | None, rows: DataFrame) -> DataFrame:
    """FOUND of the nodes that doubling walks. core (id, up, tree, node, parent); rows their ordered ones."""
    names = core.select(F.col("id").alias("node"), F.col("node").alias("name"))
    one = F.lit(1).cast(BIG)
    r = cut(rows.join(core.select("id", "up", *KEY), KEY))
    # chains: position and segment of each node below the head of its chain
    chained, _ = climb(r.select(F.col("id").alias("node"), F.when(F.col("heavy"), F.col("up")).alias("up"), F.array(one).alias("costs"), F.col("node").alias("label"), one.alias("weight")))
    placed = chained.select(F.col("node").alias("id"), F.col("root").alias("head"), F.col("totals")[0].alias("pos"), "trail")
    placed = placed.join(names.select(F.col("node").alias("head"), F.col("name").alias("chain")), "head").withColumn("segment", _joined("chain", "trail")).drop("trail")
    r = cut(r.join(placed, "id"))
    # chains of chains: each hangs by its head's parent from another
    at = r.select(F.col("id").alias("up"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"), F.col("segment").alias("up_segment"))
    heads = r.where("id = head").select("id", "up", "offset").join(at, "up", "left")
    costs = F.array(F.col("up_pos") + F.col("offset"), F.col("up_pos") + 1)  # in preorder, and in depth
    pre, _ = climb(heads.select(F.col("id").alias("node"), F.col("up_head").alias("up"), costs.alias("costs"), F.col("up_segment").alias("label"), one.alias("weight")))
    of_chain = pre.select(F.col("node").alias("head"), F.col("root").alias("tree_root"), F.col("totals")[0].alias("head_first"), F.col("totals")[1].alias("head_depth"), "trail")
    good = r.join(of_chain, "head").join(names.select(F.col("node").alias("tree_root"), F.col("name").alias("root")), "tree_root")
    out = good.select(*KEY, "parent", "root", (F.col("head_depth") + F.col("pos")).cast("int").alias("depth"), _joined("trail", "segment").alias("path"), "chain", "pos", "size", (F.col("head_first") + F.col("pos")).alias("first"))
    if stuck is None:
        return out
    bad = cycle_roots(stuck, names).withColumnRenamed("node", "id").join(core, "id").select(*KEY, "parent", "root", F.lit(-1).alias("depth"))
    return out.unionByName(bad, allowMissingColumns=True)


def hierarchy(links: DataFrame, hot: int = HOT) -> DataFrame:
    """Of links (tree, node, parent; parent null where only the node is known): a row for every node or parent.

    Columns tree_id, node_id, parent_id, root_id, depth, path, chain_id, chain_pos, subtree_size, first, last. The descendants of a node are the nodes of the same
    tree and root whose `first` lies in (first, last]. Nodes on or below a cycle: depth -1, root_id the smallest node of the cycle, no path,
    chain or interval. Repeated links count once; of several parents the smallest counts; rows without tree or node are dropped;
    a node that is its own parent is a cycle of one. An empty table gives none.
    """
    links = links.where("tree is not null and node is not null")
    both = F.array(F.struct("node", "parent"), F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))))
    every = links.select("tree", F.explode(both).alias("x")).where("x is not null").select("tree", "x.node", "x.parent")
    layers, rest, many = layers_of(every.groupBy(*KEY).agg(F.min("parent").alias("parent")), hot)
    sized = [x.withColumn("layer", F.lit(k)) for k, x in enumerate(layers)]
    top, core, stuck = len(layers), None, None
    if rest is not None:
        core = cut(rest.withColumn("id", F.monotonically_increasing_id()))
        core = cut(core.join(core.select("tree", F.col("node").alias("parent"), F.col("id").alias("up")), ["tree", "parent"], "left"))
        whole, stuck = climb(core.select(F.col("id").alias("node"), "up", F.array().cast("array<bigint>").alias("costs"), F.lit(None).cast("string").alias("label"), "weight"), weights=True)
        sized.append(whole.select(F.col("node").alias("id"), F.col("weight").alias("size")).join(core, "id").select(*KEY, "parent", "size", F.lit(top).alias("layer")))
    if not sized:
        return _columns(links.sparkSession.createDataFrame([], "tree string, node string, parent string, root string, depth int, path string, chain string, pos bigint, size bigint, first bigint"))
    rows = cut(ordered(reduce(DataFrame.unionByName, sized), many, hot))
    found = [] if core is None else [cut(_core_found(core, stuck, rows.where(F.col("layer") == top).drop("layer")))]
    for k in reversed(range(top)):
        r = rows.where(F.col("layer") == k)
        roots = r.where("parent is null").select(*KEY, "parent", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").alias("path"), F.col("node").alias("chain"), F.lit(0).cast(BIG).alias("pos"), "size", F.lit(0).cast(BIG).alias("first"))
        step = roots
        if found:
            above = reduce(DataFrame.unionByName, found).select("tree", F.col("node").alias("parent"), "root", "depth", F.col("path").alias("over"), F.col("chain").alias("over_chain"), F.col("pos").alias("over_pos"), F.col("first").alias("over_first"))
            good = F.col("depth") >= 0
            below = r.where("parent is not null").join(above, ["tree", "parent"]).select(
                *KEY, "parent", "root", F.when(good, F.col("depth") + 1).otherwise(-1).alias("depth"), F.when(good, _joined("over", "node")).alias("path"), F.when(good, F.when(F.col("heavy"), F.col("over_chain")).otherwise(F.col("node"))).alias("chain"),
                F.when(good, F.when(F.col("heavy"), F.col("over_pos") + 1).otherwise(0)).alias("pos"), F.when(good, F.col("size")).alias("size"), F.when(good, F.col("over_first") + F.col("offset")).alias("first"),
            )
            step = roots.unionByName(below)
        found.append(cut(step) if k else step)
    return _columns(reduce(DataFrame.unionByName, found))


def _columns(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("tree").alias("tree_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "path", F.col("chain").alias("chain_id"),
        F.col("pos").alias("chain_pos"), F.col("size").alias("subtree_size"), "first", (F.col("first") + F.col("size") - 1).alias("last"),
    )


def descendants(tree: DataFrame, queries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(tree_id, node_id, descendant_id, distance) of all descendants of the nodes (tree_id, node_id) asked for, by their intervals; nodes on or below cycles, and unknown ones, give none.

    Intervals and preorder numbers meet by buckets: an interval is cut at the bounds of buckets, so that a node asked for is compared with no more than its descendants and two buckets of others,
    however large its tree.
    """
    good = tree.where("depth >= 0")
    asked = good.where("last > first").join(queries.select("tree_id", "node_id").distinct(), ["tree_id", "node_id"]).select("tree_id", "root_id", "node_id", F.col("first").alias("a"), F.col("last").alias("z"), F.col("depth").alias("d"))
    pieces = asked.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("a") + 1) / bucket), F.floor(F.col("z") / bucket))))
    below = good.select("tree_id", "root_id", F.col("node_id").alias("descendant_id"), "first", "depth", F.floor(F.col("first") / bucket).alias("bucket"))
    return below.join(pieces, ["tree_id", "root_id", "bucket"]).where("first > a and first <= z").select("tree_id", "node_id", "descendant_id", (F.col("depth") - F.col("d")).alias("distance"))


def links_of(relations: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    """Links of the `contains` rows of relations within each snapshot and of parsed_symbols.children within each file."""
    r = relations.where("relation_type = 'contains'").select(norm_id("snapshot_id").alias("tree"), norm_id("source_id").alias("s"), norm_id("target_id").alias("t"))
    rel = r.select("tree", F.coalesce("t", "s").alias("node"), F.when(F.col("t").isNotNull(), F.col("s")).alias("parent"))
    p = parsed_symbols.select(norm_id("file_id").alias("tree"), F.nullif("path", F.lit("")).alias("path"), "children")
    own = p.select("tree", F.col("path").alias("node"), F.lit(None).cast("string").alias("parent"))
    kids = p.select("tree", F.explode("children").alias("child"), "path").select("tree", F.nullif("child", F.lit("")).alias("node"), F.col("path").alias("parent"))
    return rel.unionByName(own).unionByName(kids)


def asked_nodes(relations: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    """The stated query set: sources of `contains` rows, and parsed symbols, whose ord is divisible by 100."""
    r = relations.where("relation_type = 'contains' and ord % 100 = 0").select(norm_id("snapshot_id").alias("tree_id"), norm_id("source_id").alias("node_id"))
    p = parsed_symbols.where("ord % 100 = 0").select(norm_id("file_id").alias("tree_id"), F.nullif("path", F.lit("")).alias("node_id"))
    return r.unionByName(p).where("tree_id is not null and node_id is not null").distinct()


def p2_hierarchy(relations: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    return hierarchy(links_of(relations, parsed_symbols))


def p2_descendants(relations: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    return descendants(cut(p2_hierarchy(relations, parsed_symbols)), asked_nodes(relations, parsed_symbols))


def p2_found(relations: DataFrame, parsed_symbols: DataFrame) -> DataFrame:
    return p2_hierarchy(relations, parsed_symbols).select("tree_id", "node_id", "root_id", "depth")
