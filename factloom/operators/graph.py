"""Operators over edges: coupling, dependencies, closure, cycles, components, hierarchies, impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import Chains, Rounds, fixpoint, stars, written


def coupling(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Afferent and efferent coupling and instability of each node.

    ``nodes``: node; ``edges``: src, dst, repeats and loops allowed.  Both
    counts are of distinct other nodes.  Instability is ce / (ca + ce), and 0
    for an isolated node.
    """
    distinct = edges.select("src", "dst").filter("src <> dst").distinct()
    ce = distinct.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    ca = distinct.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    both = nodes.select("node").join(ca, "node", "left").join(ce, "node", "left").fillna(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    out = both.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.col("ce") / total))
    kind = F.when(total == 0, "isolated").when(F.col("instability") < 0.3, "stable").when(F.col("instability") > 0.7, "unstable").otherwise("balanced")
    out = out.withColumn("classification", kind)
    return out.orderBy(F.desc("instability"), F.desc("ce"), "node").limit(limit) if limit else out


def dependency_edges(uses: DataFrame) -> DataFrame:
    """Weighted edges (src, dst, weight) of a table of uses; loops go."""
    return uses.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def dependency_nodes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the number of their members; ends of edges without members count 0."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    counted = members.groupBy("node").agg(F.count("*").alias("members"))
    return ends.join(counted, "node", "full").select("node", F.coalesce("members", F.lit(0)).cast("long").alias("members"))


#: Rounds of single steps before chains are walked by powers of two.
SINGLE_STEPS = 8


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Pairs (src, dst) such that a path of one edge or more leads from src to dst; cycles are no problem.

    Of all nodes, pairs are joined with pairs, so that the rounds grow with
    the logarithm of the longest path; the result has a row for each pair.
    With ``starts`` only what they lead to is looked at.
    """
    e = written(edges.select("src", "dst").distinct(), "closure-edges")
    if starts is not None:
        return _reached(e, e.join(starts.toDF("src").distinct(), "src", "left_semi"))

    def grow(frontier: DataFrame, seen: DataFrame) -> DataFrame:
        def then(x: DataFrame, y: DataFrame) -> DataFrame:
            return x.toDF("a", "b").join(y.toDF("c", "d"), F.col("b") == F.col("c")).select("a", "d")

        return then(frontier, seen).union(then(seen, frontier))

    return fixpoint(e, grow, "closure")


def _reached(e: DataFrame, begin: DataFrame) -> DataFrame:
    """Pairs (src, dst) that single steps from given pairs lead to; long chains are walked by powers of two."""
    rounds, state = Rounds(e.sparkSession, "reached"), {"round": 0}

    def grow(frontier: DataFrame, seen: DataFrame) -> DataFrame:
        step = frontier.toDF("start", "at").join(e.toDF("c", "node"), F.col("at") == F.col("c")).select("start", "node")
        state["round"] += 1
        if state["round"] <= SINGLE_STEPS:
            return step
        state.setdefault("chains", Chains(e, rounds))
        return state["chains"].along(step)

    return fixpoint(begin, grow, "closure")


#: Edges below which components are finished on the driver: at most so many rows, whatever the graph was.
DRIVER_EDGES = 100_000


def cycles(edges: DataFrame) -> DataFrame:
    """Members of cycles (component, node, size): nodes that reach each other, named by their least node.

    A canonical definition: it doesn't depend on the order of a traversal.
    Nodes that no cycle can pass through are trimmed, and paths of nodes with
    one edge in and one out become one edge, by doubling, so long chains cost
    few rounds.  What is left under ``DRIVER_EDGES`` is finished on the driver;
    of more, the greatest node that leads to each goes forwards as a colour,
    and what leads back to the node of its own colour is a component.  All
    tables are as long as the nodes or edges.  Null ends are no edges.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    rounds = Rounds(edges.sparkSession, "cycles")
    live = rounds.keep(e.filter("src <> dst"))
    n, found, stages = live.count(), [], []
    while n:
        while n > DRIVER_EDGES:
            before = n
            live, n = _trimmed(live, n, rounds)
            live, n, whole, stage = _contracted(live, n, rounds)
            found.append(whole)
            stages.append(stage)
            if n > 0.9 * before:
                break
        if n <= DRIVER_EDGES:
            found.append(_on_driver(live))
            break
        colours = _coloured(live, rounds)
        same = rounds.keep(
            live.join(colours.toDF("src", "a"), "src").join(colours.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("colour"))
        )
        back = fixpoint(
            colours.filter("node = colour"),
            lambda frontier, seen, same=same: frontier.toDF("dst", "c").join(same, "dst").filter("c = colour").select("src", "colour"),
            "cycles-back",
        )
        found.append(rounds.keep(back.join(back.groupBy("colour").count().filter("count > 1").select("colour"), "colour", "left_semi").select("node", "colour")))
        rest = same.join(back.select(F.col("node").alias("k")), F.col("src") == F.col("k"), "left_anti").join(back.select(F.col("node").alias("k")), F.col("dst") == F.col("k"), "left_anti")
        live = rounds.keep(rest.select("src", "dst"))
        n = live.count()
    members = reduce(DataFrame.union, found) if found else live.select(F.col("src").alias("node"), F.col("src").alias("colour"))
    for inner, loops in reversed(stages):
        more = loops.join(members.select("node"), "node", "left_anti").select("node", F.col("node").alias("colour"))
        members = rounds.keep(members.union(more))
        at = members.toDF("from", "a"), members.toDF("to", "b")
        members = rounds.keep(members.union(inner.join(at[0], "from").join(at[1], "to").filter("a = b").select("node", "a")))
    named = members.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    inner = members.join(named, "colour").select("component", "node", "size")
    loops = e.filter("src = dst").select(F.col("src").alias("node")).join(inner.select("node"), "node", "left_anti")
    return inner.unionByName(loops.select(F.col("node").alias("component"), "node", F.lit(1).cast("long").alias("size")))


def _trimmed(live: DataFrame, n: int, rounds: Rounds) -> tuple[DataFrame, int]:
    """Edges without nodes that nothing leads to or from, for some rounds or until there are none."""
    for _ in range(SINGLE_STEPS):
        kept = live.join(live.select(F.col("src").alias("k")).distinct(), F.col("dst") == F.col("k"), "left_semi")
        kept = kept.join(live.select(F.col("dst").alias("k")).distinct(), F.col("src") == F.col("k"), "left_semi")
        live = rounds.keep(kept)
        before, n = n, live.count()
        if n == before:
            break
    return live, n


def _contracted(live: DataFrame, n: int, rounds: Rounds) -> tuple[DataFrame, int, DataFrame, tuple[DataFrame, DataFrame]]:
    """Edges in which each path of nodes with one edge in and one out is one edge.

    Also: (node, colour) of cycles made of such nodes only; and, to be read
    once the rest is known, (node, from, to) of nodes within such paths, and
    nodes whose path led back to them.
    """
    out = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("next")).filter("n = 1").select("node", "next")
    come = live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select("node")
    mid = rounds.keep(out.join(come, "node"))
    inner = mid.select(F.col("node").alias("k"))
    step = mid.join(inner, F.col("next") == F.col("k"), "left")
    now = rounds.keep(step.select("node", F.col("k").alias("at"), F.col("node").alias("last"), F.col("node").alias("low")))
    for _ in range(mid.count().bit_length() + 1):
        moving = now.filter("at is not null")
        if moving.isEmpty():
            break
        far = now.select(F.col("node").alias("k"), F.col("at").alias("at2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        moved = moving.join(far, F.col("at") == F.col("k")).select("node", F.col("at2").alias("at"), F.col("last2").alias("last"), F.least("low", "low2").alias("low"))
        now = rounds.keep(now.filter("at is null").unionByName(moved))
    # What still moves after as many steps as there are nodes goes round; the least node was seen by all.
    whole = now.filter("at is not null").select("node", F.col("low").alias("colour"))
    ends = now.filter("at is null").select("node", "last")
    begins = live.join(inner, F.col("src") == F.col("k"), "left_anti").join(ends, F.col("dst") == F.col("node")).select("last", F.col("src").alias("from"))
    paths = rounds.keep(begins.join(mid.toDF("last", "to"), "last"))
    inside = rounds.keep(ends.join(paths, "last").select("node", "from", "to"))
    others = live.join(inner, F.col("src") == F.col("k"), "left_anti").join(inner, F.col("dst") == F.col("k"), "left_anti")
    fewer = rounds.keep(others.union(paths.filter(F.col("from") != F.col("to")).select("from", "to")).distinct())
    return fewer, fewer.count(), whole, (inside, paths.filter(F.col("from") == F.col("to")).select(F.col("from").alias("node")).distinct())


def _on_driver(live: DataFrame) -> DataFrame:
    """Rows (node, colour) of components of two nodes or more, over a bounded number of edges: depth first, without recursion."""
    onward: dict = {}
    for r in live.collect():
        onward.setdefault(r["src"], []).append(r["dst"])
    index, low, stack, on, rows = {}, {}, [], set(), []
    for start in onward:
        if start in index:
            continue
        work = [(start, iter(onward[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, ways = work[-1]
            for way in ways:
                if way not in index:
                    index[way] = low[way] = len(index)
                    stack.append(way)
                    on.add(way)
                    work.append((way, iter(onward.get(way, ()))))
                    break
                if way in on:
                    low[node] = min(low[node], index[way])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                    on.difference_update(group)
                    if len(group) > 1:
                        rows += [(x, group[0]) for x in group]
    kind = live.schema["src"].dataType.simpleString()
    return live.sparkSession.createDataFrame(rows, f"node {kind}, colour {kind}")


def _coloured(live: DataFrame, rounds: Rounds) -> DataFrame:
    """Rows (node, colour): the greatest node from which each can be reached, or itself."""
    nodes = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
    path, now = rounds.write(nodes.select("node", F.col("node").alias("colour")))
    moved = now
    while True:
        came = moved.join(live, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.max("colour").alias("more"))
        new = now.join(came, F.col("node") == F.col("to"), "left").select("node", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("up"))
        new_path, new = rounds.write(new)
        rounds.drop(path)
        path, now, moved = new_path, new.select("node", "colour"), new.filter("up").select("node", "colour")
        if moved.isEmpty():
            return now


def circular_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (component, src, dst) whose ends are members of one cycle; ``members`` as of ``cycles``."""
    one, two = members.select("component", F.col("node").alias("src")), members.select(F.col("component").alias("c2"), F.col("node").alias("dst"))
    return edges.select("src", "dst").distinct().join(one, "src").join(two, "dst").filter("component = c2").select("component", "src", "dst")


def cycle_paths(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One shortest closed path of each component, from its least node and back (component, length, path); loops are none.

    Breadth first from the least nodes of all components at once, each within
    its component; a node's way back is its least predecessor among those one
    step nearer, so ties have one result.  Rounds are as many as the longest of
    these paths has steps.  ``path`` joins the nodes by `` > ``.
    """
    rounds = Rounds(edges.sparkSession, "cycle-paths")
    inner = rounds.keep(circular_edges(edges.filter("src <> dst"), cycles(edges) if members is None else members))
    steps = [rounds.keep(inner.filter("src = component").select("component", F.col("dst").alias("node"), F.col("src").alias("came"), F.lit(1).alias("dist")))]
    closed = []
    while True:
        front = steps[-1]
        done = front.filter("node = component")
        closed.append(done)
        open_ = front.join(done.select("component"), "component", "left_anti")
        if open_.isEmpty():
            break
        seen = reduce(DataFrame.union, (s.select("component", "node") for s in steps))
        ways = open_.select("component", F.col("node").alias("src"), "dist").join(inner, ["component", "src"])
        fresh = ways.groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("came"), (F.min("dist") + 1).cast("int").alias("dist"))
        steps.append(rounds.keep(fresh.join(seen, ["component", "node"], "left_anti").select("component", "node", "came", "dist")))
    ends = rounds.keep(reduce(DataFrame.union, closed))
    # Back from the end of each path, one step of all of them at a time; the last is the least node again.
    at = ends.select("component", "came", F.col("dist").alias("length"), "dist", F.array(F.col("node")).alias("nodes"))
    for known in reversed(steps[:-1]):
        before = known.select("component", F.col("node").alias("came"), F.col("came").alias("earlier"), (F.col("dist") + 1).alias("dist"))
        back = at.join(before, ["component", "came", "dist"], "left")
        moved = F.col("earlier").isNotNull()
        at = rounds.keep(back.select(
            "component", F.coalesce("earlier", "came").alias("came"), "length", F.when(moved, F.col("dist") - 1).otherwise(F.col("dist")).alias("dist"),
            F.when(moved, F.concat(F.array("came"), F.col("nodes"))).otherwise(F.col("nodes")).alias("nodes"),
        ))
    path = F.array_join(F.transform(F.concat(F.array("came"), F.col("nodes")), lambda x: x.cast("string")), " > ")
    return at.select("component", F.col("length").cast("long").alias("length"), path.alias("path"))


def dependency_graph(members: DataFrame, uses: DataFrame, circular_only: bool = False) -> DataFrame:
    """Nodes, weighted edges and a path of each cycle as one table (part, a, b, n, circular).

    ``node``: a node and its members; ``edge``: both ends and the uses between
    them; ``cycle``: the least node of a component, its shortest closed path
    as ``b``, and the length of that.  ``circular``: whether a node is in a cycle, or an
    edge within one; ``circular_only`` leaves out what isn't.  ``members``:
    node; ``uses``: src, dst, of which those from a node to itself count not.
    """
    edges = written(dependency_edges(uses).select("src", "dst", "weight"), "dependency-edges")
    found = written(cycles(edges), "dependency-cycles")
    within = circular_edges(edges, found).select("src", "dst", F.lit(True).alias("c"))
    text = [F.col(x).cast("string") for x in ("node", "src", "dst", "component")]
    nodes = dependency_nodes(members, edges).join(found.select("node", F.lit(True).alias("c")), "node", "left")
    nodes = nodes.select(F.lit("node").alias("part"), text[0].alias("a"), F.lit(None).cast("string").alias("b"), F.col("members").alias("n"), F.col("c").isNotNull().alias("circular"))
    lines = edges.join(within, ["src", "dst"], "left").select(F.lit("edge").alias("part"), text[1].alias("a"), text[2].alias("b"), F.col("weight").alias("n"), F.col("c").isNotNull().alias("circular"))
    paths = cycle_paths(edges, found).select(F.lit("cycle").alias("part"), text[3].alias("a"), F.col("path").alias("b"), F.col("length").alias("n"), F.lit(True).alias("circular"))
    out = nodes.unionByName(lines).unionByName(paths)
    return out.filter("circular") if circular_only else out


def overrides(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The virtual roots of many members at once (start, root), and all that overrides each root (root, node).

    ``edges``: member, overridden, a row for each declaration that a member
    overrides or implements; ``starts``: member.  A member that overrides
    nothing is its own root, and one below several has each of them.  Roots are
    gone down from once each, however many members lead to them.
    """
    up = written(edges.select(F.col("member").alias("src"), F.col("overridden").alias("dst")).filter("src is not null and dst is not null").distinct(), "overrides")
    begin = written(starts.select(F.col("member").alias("src")).filter("src is not null").distinct(), "overrides-starts")
    reached = closure(up, begin).union(begin.select("src", F.col("src").alias("dst")))
    roots = written(reached.join(up.select(F.col("src").alias("k")).distinct(), F.col("dst") == F.col("k"), "left_anti").distinct().toDF("start", "root"), "overrides-roots")
    down = closure(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots.select("root").distinct())
    return roots, down.toDF("root", "node")


def clusters(items: DataFrame, access: DataFrame, interfaces: DataFrame | None = None, least_items: int = 2) -> DataFrame:
    """Groups of a type's methods that hang together, by fields or by private helpers (scope, type_kind, methods, fields, lcom4, cluster, members, shared_fields).

    ``items``: scope, item, all methods; ``access``: scope, item, member, kind,
    where a ``call`` of a helper links methods as a ``field`` does, but only
    fields are shown and counted.  One row for each cluster, named by its least
    method; methods that reach nothing are clusters of their own.
    ``interfaces``: scope, item; each has one row, whose lcom4 is its methods.
    Types of fewer than ``least_items`` methods have none.
    """
    own = written(items.select("scope", "item").filter("scope is not null and item is not null").distinct(), "clusters-items")
    used = written(access.select("scope", "item", "member", "kind").filter("member is not null").distinct().join(own, ["scope", "item"], "left_semi"), "clusters-access")
    linked = shared_components(used.select("scope", "item", F.struct("kind", "member").alias("member")))
    label = own.join(linked, ["scope", "item"], "left").select("scope", "item", F.coalesce("label", "item").alias("cluster"))
    label = written(label, "clusters-labels")
    fields = used.filter("kind = 'field'")

    def listed(c: str):
        return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")

    shown = fields.join(label, ["scope", "item"]).groupBy("scope", "cluster").agg(listed("member").alias("shared_fields"))
    of_scope = label.groupBy("scope").agg(F.count("*").alias("methods"), F.countDistinct("cluster").alias("lcom4")).filter(F.col("methods") >= least_items)
    n_fields = fields.groupBy("scope").agg(F.countDistinct("member").alias("fields"))
    out = label.groupBy("scope", "cluster").agg(listed("item").alias("members")).join(shown, ["scope", "cluster"], "left").join(of_scope, "scope").join(n_fields, "scope", "left")
    columns = ["scope", "type_kind", "methods", "fields", "lcom4", "cluster", "members", "shared_fields"]
    out = out.withColumn("type_kind", F.lit("Class")).na.fill(0, ["fields"]).na.fill("", ["shared_fields"]).select(columns)
    if interfaces is None:
        return out
    n = interfaces.groupBy("scope").agg(F.countDistinct("item").alias("methods"))
    none = F.lit(None).cast(own.schema["item"].dataType)
    return out.unionByName(n.select("scope", F.lit("Interface").alias("type_kind"), "methods", F.lit(0).cast("long").alias("fields"), F.col("methods").alias("lcom4"), none.alias("cluster"), F.lit("").alias("members"), F.lit("").alias("shared_fields")))


def control_flow(steps: DataFrame, region: DataFrame, kinds: DataFrame, first) -> DataFrame:
    """Points of a region of statements (point, node): where it is entered, left and returned from, and what is never reached.

    ``steps``: src, dst; ``region``: node; ``kinds``: node, kind.  ``entry``: a
    node with a step from outside; ``exit``: one with a step to the outside;
    ``return``: of kind return; ``unreachable``: one that no steps within the
    region lead to from its ``first`` node.
    """
    own = written(region.select("node").filter("node is not null").distinct(), "region")
    sides = steps.select("src", "dst").distinct().join(own.toDF("src").withColumn("from_in", F.lit(True)), "src", "left").join(own.toDF("dst").withColumn("to_in", F.lit(True)), "dst", "left")
    sides = written(sides, "region-steps")
    entry = sides.filter("to_in and from_in is null").select(F.lit("entry").alias("point"), F.col("dst").alias("node"))
    leave = sides.filter("from_in and to_in is null").select(F.lit("exit").alias("point"), F.col("src").alias("node"))
    back = kinds.filter("kind = 'return'").join(own, "node", "left_semi").select(F.lit("return").alias("point"), "node")
    start = own.filter(F.col("node") == first)
    reached = closure(sides.filter("from_in and to_in").select("src", "dst"), start).select(F.col("dst").alias("node")).union(start)
    never = own.join(reached, "node", "left_anti").select(F.lit("unreachable").alias("point"), "node")
    return entry.unionByName(leave).unionByName(back).unionByName(never).distinct()


def shared_components(access: DataFrame) -> DataFrame:
    """Least reachable ``item`` of each (scope, item) over shared members, within each scope.

    ``access``: scope, item, member; a null scope, item or member links
    nothing and has no row.  Items of a member are linked with its least one,
    so items that share a member are never paired, and members that one item
    has alone are out before the first round.
    """
    whole = written(access.select("scope", "item", "member").filter("scope is not null and item is not null and member is not null").distinct(), "components-access")
    least = whole.groupBy("scope", "member").agg(F.min("item").alias("least"), F.max("item").alias("most")).filter("least <> most").drop("most")
    links = whole.join(least, ["scope", "member"]).filter("item <> least")
    found = stars(links.select(F.struct("scope", "item").alias("a"), F.struct("scope", F.col("least").alias("item")).alias("b")), "components")
    roots = found.select("node.scope", "node.item", F.col("root.item").alias("root"))
    return whole.select("scope", "item").distinct().join(roots, ["scope", "item"], "left").select("scope", "item", F.coalesce("root", "item").alias("label"))


def cohesion(access: DataFrame, least_items: int = 2) -> DataFrame:
    """LCOM4 of each scope: how many groups of items don't share any member (scope, items, members, lcom4).

    Scopes of fewer than ``least_items`` items have no row.
    """
    sizes = access.groupBy("scope").agg(F.countDistinct("item").alias("items"), F.countDistinct("member").alias("members"))
    groups = shared_components(access).groupBy("scope").agg(F.countDistinct("label").alias("lcom4"))
    return sizes.filter(F.col("items") >= least_items).join(groups, "scope")


def shared_members(access: DataFrame, least: int = 2) -> DataFrame:
    """Members used by ``least`` items or more (member, users)."""
    return access.groupBy("member").agg(F.countDistinct("item").alias("users")).filter(F.col("users") >= least)


def hierarchy(edges: DataFrame, root, most_depth: int | None = None) -> DataFrame:
    """All nodes below a root with their depth (node, parent, depth); ``edges``: child, parent, without cycles.

    A node below the root on several ways has a row for each of its parents
    and depths.  ``most_depth``: how far to look, or no end.  A cycle below
    the root is an error.
    """
    e = written(edges.select("child", "parent").distinct(), "hierarchy-edges")
    down = e.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    rounds, state = Rounds(e.sparkSession, "hierarchy"), {"round": 0}

    def grow(frontier: DataFrame, seen: DataFrame) -> DataFrame:
        step = frontier.join(down, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("depth") + 1)
        step = step.toDF("node", "depth")
        state["round"] += 1
        if state["round"] > SINGLE_STEPS:
            state.setdefault("chains", Chains(down, rounds))
            state.setdefault("longest", e.count())
            step = state["chains"].along(step, "depth")
            if not step.filter(F.col("depth") > state["longest"]).isEmpty():
                raise ValueError("the hierarchy has a cycle")
        return step if most_depth is None else step.filter(F.col("depth") < most_depth)

    begin = e.sparkSession.range(1).select(F.lit(root).cast(e.schema["parent"].dataType).alias("node"), F.lit(0).alias("depth"))
    above = fixpoint(begin, grow, "hierarchy")
    below = above.join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "parent", (F.col("depth") + 1).alias("depth"))
    return below.distinct()


def ancestors(edges: DataFrame, node, most_depth: int | None = None) -> DataFrame:
    """All nodes above a node with their depth (node, depth), once for each depth."""
    up = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return hierarchy(up, node, most_depth).select("node", "depth").distinct()


def callers_callees(calls: DataFrame, symbol, limit: int = 100) -> DataFrame:
    """Sites that call a symbol, and what it calls once each (direction, other, site).

    ``calls``: caller, callee, site.  Callers keep a row for each site.
    """
    callers = calls.filter(F.col("callee") == symbol).select(F.lit("caller").alias("direction"), F.col("caller").alias("other"), "site")
    callees = calls.filter(F.col("caller") == symbol).groupBy(F.col("callee").alias("other")).agg(F.min("site").alias("site"))
    callees = callees.select(F.lit("callee").alias("direction"), "other", "site")
    return callers.orderBy("other", "site").limit(limit).unionByName(callees.orderBy("other", "site").limit(limit))


def impact(parts: dict[str, DataFrame]) -> DataFrame:
    """How many distinct rows of each kind a change touches (kind, affected); each frame has a column ``id``."""
    one = [df.agg(F.countDistinct("id").alias("affected")).select(F.lit(kind).alias("kind"), "affected") for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, one)


def neighbours(edges: DataFrame) -> DataFrame:
    """Each node with its sorted distinct targets, joined by commas, and their number (node, targets, n)."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set(F.col("dst").cast("string"))).alias("t")).select("node", F.array_join("t", ",").alias("targets"), F.size("t").cast("long").alias("n"))


def sweep(parts: dict[str, DataFrame], most: int) -> DataFrame:
    """Places of each category in order, at most some of each, beside totals from before that cut (category, id, total); each frame has a column ``id``."""
    from pyspark.sql.window import Window

    rows = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("category"), "id") for k, df in parts.items()))
    n = rows.groupBy("category").agg(F.count("*").alias("total"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("id"))).filter(F.col("rn") <= most).drop("rn")
    return first.join(F.broadcast(n), "category")


def impact_rows(parts: dict[str, DataFrame], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the places of each kind that a change touches (kind, id, total), with how many there are; each frame has a column ``id``.

    Places are distinct and in order; ``total`` is from before the page.  Ids
    of all kinds are shown as text, in the order of their own type.
    """
    from pyspark.sql.window import Window

    out = []
    for kind, df in parts.items():
        one = df.select("id").distinct()
        n = one.agg(F.count("*").alias("total"))  # one row
        place = F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy("id"))
        page = one.withColumn("rn", place).filter(F.col("rn") <= offset + limit).filter(F.col("rn") > offset)
        out.append(page.crossJoin(F.broadcast(n)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "total"))
    return reduce(DataFrame.unionByName, out)


def subtree(edges: DataFrame, root, kinds: DataFrame, most_depth: int) -> DataFrame:
    """The nodes below a root to some depth, the root too, as rows that give the tree again (node, parent, depth, kind).

    ``edges``: child, parent; ``kinds``: node, kind.
    """
    below = hierarchy(edges, root, most_depth)
    top = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["child"].dataType).alias("node"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), F.lit(0).alias("depth"))
    return below.unionByName(top).join(kinds.select("node", "kind"), "node", "left").select("node", "parent", "depth", "kind")


def outline(edges: DataFrame, root, most_depth: int) -> DataFrame:
    """What is below a root to some depth, by kind of depth (depth, nodes, first, last)."""
    return hierarchy(edges, root, most_depth).groupBy("depth").agg(F.countDistinct("node").alias("nodes"), F.min("node").alias("first"), F.max("node").alias("last"))
