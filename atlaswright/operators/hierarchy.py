"""Parent-child links to full hierarchies by tree contraction."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlaswright.functions.readings import category_reading
from atlaswright.operators.neighbors import dense_ids
from atlaswright.session import cut, forget


def category_links(subcategories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and distinct (parent, child) links of category replies, by their readings.

    A row with a null or empty list still names its category; names without a reading do not count.
    """
    rows = subcategories.select(category_reading(F.col("category")).alias("parent"), F.col("subcategories").alias("kids"))
    links = rows.select("parent", F.explode("kids").alias("kid")).select("parent", category_reading(F.col("kid")).alias("child"))
    links = links.where("child is not null")
    nodes = rows.select(F.col("parent").alias("node")).unionByName(links.select(F.col("child").alias("node"))).where("node is not null").distinct()
    return nodes, links.where("parent is not null").distinct()


VIA = "array<bigint>"
MERGE = "merge"  # so many small joins would leave as many broadcast tables in the driver
LINKS = f"parent bigint, child bigint, steps bigint, via {VIA}"
STATE = f"node bigint, root bigint, depth bigint, path {VIA}"
LOOP = -1  # root and depth of what hangs from a loop


def _contract(live: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (links of raked leaves, upward links of bypassed nodes, links that are left)."""
    inner = live.select(F.col("parent").alias("child")).distinct().withColumn("keep", F.lit(True))
    marked, _ = cut(live.join(inner.hint(MERGE), "child", "left"), "rake")
    raked, left = marked.where("keep is null").drop("keep"), marked.where("keep").drop("keep")
    # nodes whose links up times links down are few; of neighbouring ones that with the largest number of this round goes
    number = lambda c: F.struct(F.xxhash64(c, F.lit(k)), F.col(c))
    ends = left.select(F.col("child").alias("node"), F.col("parent").alias("other"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(left.select(F.col("parent").alias("node"), F.col("child").alias("other"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    few = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where(f"up > 0 and (up * down <= up + down or up * down <= {most})")
    few = few.select("node", number("node").alias("n"))
    ends = ends.join(few.hint(MERGE), "node").join(few.select(F.col("node").alias("other"), F.col("n").alias("m")).hint(MERGE), "other", "left")
    # a node that stands above and below the same other node lies on a loop and stays
    chosen = ends.groupBy("node", "n", "other").agg(F.max("m").alias("m"), F.count_distinct("up").alias("sides")).groupBy("node").agg(F.max("sides").alias("sides"), F.min(F.coalesce(F.col("n") > F.col("m"), F.lit(True))).alias("first"))
    chosen = chosen.where("sides = 1 and first").select("node", F.lit(True).alias("gone"))
    split, _ = cut(
        left.join(chosen.withColumnRenamed("node", "child").withColumnRenamed("gone", "into").hint(MERGE), "child", "left").join(chosen.withColumnRenamed("node", "parent").withColumnRenamed("gone", "out").hint(MERGE), "parent", "left"), "split"
    )
    into, out = split.where("into").drop("into", "out"), split.where("out").drop("into", "out")
    over = into.select(F.col("child").alias("node"), "parent", F.col("steps").alias("s"), F.col("via").alias("v")).join(out.select(F.col("parent").alias("node"), "child", "steps", "via").hint(MERGE), "node")
    over = over.select("parent", "child", (F.col("s") + F.col("steps")).alias("steps"), _chained("v", "node", "via").alias("via"))
    # of two ways between the same ends the longer one counts
    nxt = split.where("into is null and out is null").drop("into", "out").unionByName(over).groupBy("parent", "child").agg(F.min_by(F.struct("steps", "via"), F.struct(-F.col("steps"), F.col("via"))).alias("l"))
    nxt, _ = cut(nxt.select("parent", "child", "l.steps", "l.via"), "links")
    return raked, into, nxt


def _chained(first: str, node: str, then: str) -> Column:
    """The nodes of two joined links, if these are kept (null ways are not)."""
    return F.concat(F.col(first), F.array(node), F.col(then))


def contract_in_task(links: list[tuple], paths: bool) -> list[tuple]:
    """(node, root, depth, path) of all nodes of some links (parent, child, steps, via), by the same contraction in one task.

    Leaves are raked until none is left, and recorded; the core that remains is peeled from above; what cannot
    be peeled has a way upward into a loop. Then the records are undone in reverse.
    """
    up: dict[int, list[tuple]] = {}
    below: dict[int, list[int]] = {}
    for parent, child, steps, via in links:
        up.setdefault(child, []).append((parent, steps, via))
        up.setdefault(parent, [])
        below.setdefault(parent, []).append(child)
    open_down = {v: len(below.get(v, ())) for v in up}
    raked = [v for v, n in open_down.items() if not n]
    for v in raked:  # grows while it is read
        for parent, _, _ in up[v]:
            open_down[parent] -= 1
            if not open_down[parent]:
                raked.append(parent)
    gone = set(raked)
    open_up = {v: len(up[v]) for v in up if v not in gone}
    peeled = [v for v, n in open_up.items() if not n]
    for v in peeled:
        for child in below[v]:
            if child in open_up:
                open_up[child] -= 1
                if not open_up[child]:
                    peeled.append(child)
    state: dict[int, tuple] = {}
    for v in peeled + raked[::-1]:
        if not up[v]:
            state[v] = (v, 0, [v] if paths else None)
            continue
        best = None
        for parent, steps, via in up[v]:
            root, depth, path = state.get(parent, (LOOP, LOOP, None))
            if depth < 0:
                best = (LOOP, LOOP, None)
                break
            way = [*path, *(via or []), v] if paths else None
            key = (-(depth + steps), root, way or [])
            if best is None or key < best[0]:
                best = (key, root, depth + steps, way)
        state[v] = best[-3:]
    return [(v, *state.get(v, (LOOP, LOOP, None))) for v in up]


def _rest(links: DataFrame, paths: bool) -> DataFrame:
    """States of all nodes of what is left; a bounded number of links."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        cols = list(zip(*contract_in_task(rows, paths))) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "root", "depth", "path"])

    return links.select("parent", "child", "steps", "via").repartition(1).mapInArrow(work, STATE)


def _settle(removed: DataFrame, known: DataFrame) -> DataFrame:
    """States of removed nodes from those of their recorded parents."""
    got = removed.join(known.select(F.col("node").alias("parent"), "root", "depth", "path").hint(MERGE), "parent")
    deep, way = F.col("depth") + F.col("steps"), F.concat("path", "via", F.array("child"))
    best = got.groupBy(F.col("child").alias("node")).agg(
        F.bool_or(F.col("depth") < 0).alias("bad"), F.min_by(F.struct("root", deep.alias("depth"), way.alias("path")), F.struct(-deep, "root", way)).alias("b")
    )
    bad = lambda c: F.when(F.col("bad"), F.lit(LOOP).cast("bigint")).otherwise(F.col(f"b.{c}")).alias(c)
    return best.select("node", bad("root"), bad("depth"), F.when(~F.col("bad"), F.col("b.path")).alias("path"))


def hierarchies(nodes: DataFrame, links: DataFrame, paths: bool = False, finish: int = 5_000) -> DataFrame:
    """Root and depth of every node: ``node, root, depth`` (and ``path``, root first, if asked for).

    Tree contraction on numbers for names: every round first rakes the leaves, then bypasses an independent set of nodes, those with one
    parent, one child, or two of each (and, while that removes too little, of up to eight each), so that a chain of n nodes, and layers of several nodes linked
    to several of the next, take O(log n) rounds, not n. What goes is recorded with its upward links and their lengths. What is left,
    once that is at most ``finish`` links, is contracted by the same rules in one task. If a round can remove nothing more (large meshes and loops), nodes
    whose parents are all known are peeled from above; the core that then remains is made of loops and of what hangs from them.
    Then the recorded contractions are undone in reverse: each removed node takes its root, depth and path
    from its recorded parents.

    A node with a way upward into a loop (a node that is its own parent is one) has the empty root, depth -1 and a null
    path. A node with several parents and no loop above takes the longest way, ties by the smaller root, then by the smaller path.
    Null names do not count; repeated links count once; a link's ends are nodes even if not listed; a node
    without links is its own root at depth 0; empty tables give an empty result. Every round's tables are written to
    the scratch folder, so lost executors cost no earlier round.
    """
    links = links.where("parent is not null and child is not null").select("parent", "child").distinct()
    ends = links.select(F.explode(F.array("parent", "child")).alias("node"))
    ids, _ = cut(dense_ids(nodes.select("node").unionByName(ends), "node"), "nodes")
    by = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    none = (F.array() if paths else F.lit(None)).cast(VIA)
    live = links.join(by("parent"), "parent").join(by("child"), "child").select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"), F.lit(1).cast("bigint").alias("steps"), none.alias("via"))
    live, _ = cut(live, "links")
    root = ids.select(F.col("id").alias("node")).join(live.select(F.col("child").alias("node")), "node", "left_anti")
    start = root.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), (F.array("node") if paths else none).alias("path"))
    known, known_at = cut(start, "state")

    # what each round took away, to be undone in reverse: links to nodes whose parents are settled by then
    undo: list[tuple[DataFrame, DataFrame]] = []
    n, k, most = live.count(), 0, 4
    while n > finish:
        raked, bypassed, nxt = _contract(live, k, most)
        before, n, k = n, nxt.count(), k + 1
        undo.append((raked, bypassed))
        live = nxt
        if n > 0.9 * before:
            if most < 64:
                most *= 4
            elif n >= before:
                break
    if n > finish:  # a large mesh or loops, in which every node keeps links up and down
        while True:
            ready = live.join(known.select(F.col("node").alias("parent"), F.lit(True).alias("done")).hint(MERGE), "parent", "left")
            ready = ready.groupBy("child").agg(F.min(F.coalesce("done", F.lit(False))).alias("all")).where("all").select("child")
            off, _ = cut(_settle(live.join(ready, "child", "left_semi"), known), "peeled")
            if off.isEmpty():
                break
            known, known_at = _grown(known, known_at, [off])
            live, _ = cut(live.join(off.select(F.col("node").alias("child")), "child", "left_anti"), "links")
        loops = live.select(F.col("child").alias("node")).distinct()
        known, known_at = _grown(known, known_at, [loops.select("node", F.lit(LOOP).cast("bigint").alias("root"), F.lit(LOOP).cast("bigint").alias("depth"), F.lit(None).cast(VIA).alias("path"))])
    elif n:
        known, known_at = _grown(known, known_at, [_rest(live, paths).where("root <> node")])
    for raked, bypassed in reversed(undo):
        passed = _settle(bypassed, known)
        known, known_at = _grown(known, known_at, [passed, _settle(raked, known.unionByName(passed))])

    found = known.join(ids.select(F.col("id").alias("node"), F.col("node").alias("name")), "node")
    found = found.join(ids.select(F.col("id").alias("root"), F.col("node").alias("root_name")), "root", "left")
    out = found.select("node", "name", F.coalesce("root_name", F.lit("")).alias("root"), "depth", "path")
    if not paths:
        return out.select(F.col("name").alias("node"), "root", "depth")
    steps = known.select("node", F.posexplode("path").alias("at", "id")).join(ids.select("id", F.col("node").alias("name")), "id")
    named = steps.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("path"))
    return out.drop("path").join(named, "node", "left").select(F.col("name").alias("node"), "root", "depth", "path")


def _grown(known: DataFrame, at: str, new: list[DataFrame]) -> tuple[DataFrame, str]:
    """One table of all states so far. The tables grow geometrically, so writing each anew costs little more than the last."""
    for d in new:
        known = known.unionByName(d)
    table, path = cut(known, "state")
    forget(known.sparkSession, at)
    return table, path


def category_hierarchy(subcategories: DataFrame, paths: bool = False) -> DataFrame:
    """``category, tree_root, tree_depth`` (and ``path``) of every category named in the replies."""
    nodes, links = category_links(subcategories)
    tree = hierarchies(nodes, links, paths)
    return tree.select(F.col("node").alias("category"), F.col("root").alias("tree_root"), F.col("depth").alias("tree_depth"), *(["path"] if paths else []))


def descendants(tree: DataFrame) -> DataFrame:
    """``category, descendant, steps`` from a hierarchy with paths; the size is inherent to the result."""
    up = tree.where("path is not null").select(F.col("category").alias("descendant"), "tree_depth", F.posexplode("path").alias("at", "category"))
    return up.where("category <> descendant").select("category", "descendant", (F.col("tree_depth") - F.col("at")).alias("steps"))
