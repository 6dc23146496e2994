"""Connected components by iterated joins on written tables.

Weak components alternate the published large-star and small-star steps, which
need a number of rounds that grows with the logarithm of the node count. Strong
components trim nodes that lie on no cycle, contract chains by pointer jumping in
rounds that grow with the logarithm of their length, and then colour forward and
collect backward, as in the published colouring method; what is left takes rounds
by the path length between branching nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tracewright.operators.joins import lookup
from tracewright.session import discard, materialize


def _pairs(edges: DataFrame, source: str, destination: str) -> DataFrame:
    return (
        edges.select(F.col(source).alias("a"), F.col(destination).alias("b"))
        .filter("a <> b").distinct()
    )


def _signature(pairs: DataFrame) -> tuple:
    """Row count and an order-free fingerprint."""
    mix = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(mix)).first())


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) plus the smallest ``b`` of each ``a``. A hub's pairs are spread over tasks."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return lookup(pairs, least, ["a"], ["b"], "inner")


def weak_components(
    nodes: DataFrame, edges: DataFrame,
    source: str = "source_node_id", destination: str = "destination_node_id",
) -> DataFrame:
    """``component`` of every node: the smallest node id it is connected with, direction ignored."""
    current = materialize(_pairs(edges, source, destination), "weak")
    seen = _signature(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node hang on the smallest neighbour, or on the node itself.
        large = (
            _to_minimum(both).filter("b > a")
            .select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b"))
            .filter("a <> b").distinct()
        )
        large = materialize(large, "weak")
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        marked = _to_minimum(down)
        small = marked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            marked.select("a", F.col("m").alias("b"))
        )
        fresh = materialize(small.filter("a <> b").distinct(), "weak")
        discard(current, large)
        current = fresh
        found = _signature(current)
        if found == seen:
            break
        seen = found
    roots = current.select(F.col("a").alias("node_id"), F.col("b").alias("component"))
    return nodes.select("node_id").join(roots, "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def _trim(pairs: DataFrame) -> DataFrame:
    """Drop edges at nodes without an incoming or an outgoing edge, once."""
    starts = pairs.select(F.col("a").alias("n")).distinct()
    ends = pairs.select(F.col("b").alias("n")).distinct()
    inner = starts.join(ends, "n", "left_semi")
    kept = lookup(pairs, inner.select(F.col("n").alias("a")), ["a"], ["b"], "inner")
    kept = lookup(kept, inner.select(F.col("n").alias("b")), ["b"], ["a"], "inner", count_on=pairs)
    return materialize(kept.select("a", "b"), "trim")


def _links(pairs: DataFrame) -> DataFrame:
    """Nodes ``n`` with one way in and one way out: the nodes before (``head``) and behind (``tail``)."""
    out = pairs.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("k"), F.min("b").alias("tail")).filter("k = 1")
    into = pairs.groupBy(F.col("b").alias("n")).agg(F.count("*").alias("k"), F.min("a").alias("head")).filter("k = 1")
    return out.drop("k").join(into.drop("k"), "n")


def _jumped(links: DataFrame) -> DataFrame:
    """``head`` and ``tail`` moved to the first nodes that are no links; a ring's ``least`` node instead.

    Every round doubles the stretch that a link sees. As long as a chain is left, a round brings
    some link to its tail and some to its head; when none does and no minimum falls, the rest are rings.
    """
    known = links.select("n", "head", "tail", F.col("n").alias("least"))
    now, seen = materialize(known, "links"), None
    while True:
        ahead = now.select(F.col("n").alias("tail"), F.col("tail").alias("t2"), F.col("least").alias("l2"))
        behind = now.select(F.col("n").alias("head"), F.col("head").alias("h2"))
        both = lookup(lookup(now, ahead, ["tail"], ["n"]), behind, ["head"], ["n"], count_on=now)
        fresh = materialize(
            both.select(
                "n", F.coalesce("h2", "head").alias("head"), F.coalesce("t2", "tail").alias("tail"),
                F.least("least", "l2").alias("least"), F.col("t2").isNotNull().alias("open"), F.col("h2").isNotNull().alias("started"),
            ),
            "links",
        )
        discard(now)
        now = fresh
        lowest = F.sum(F.when(F.col("open"), F.col("least")).cast("decimal(38,0)"))
        found = tuple(now.agg(F.count_if("open"), F.count_if("started"), lowest).first())
        if not found[0] + found[1] or found == seen:
            return now
        seen = found


def _contract(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with an edge from head to tail in place of each chain, and the links.

    A chain lies on a cycle exactly when its head and its tail are in one component.
    """
    links = _jumped(_links(pairs))
    ids = links.select(F.col("n").alias("a"), F.lit(True).alias("linked"))
    from_others = lookup(pairs, ids, ["a"], ["b"]).filter("linked is null").select("a", "b")
    ends = links.filter("not open").select(F.col("n").alias("b"), "tail")
    led = lookup(from_others, ends, ["b"], ["a"], count_on=pairs).select("a", F.coalesce("tail", "b").alias("b"))
    return materialize(led.filter("a <> b").distinct(), "contracted"), links


def _resolved(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """``assigned`` with the links that lie on cycles."""
    ends = links.filter("not open").select("n", "head", "tail")
    of = lambda name, root: assigned.select(F.col("n").alias(name), F.col("c").alias(root))
    found = lookup(ends, of("head", "ch"), ["head"], ["n"])
    found = lookup(found, of("tail", "ct"), ["tail"], ["n"], count_on=ends)
    rooted = found.select("n", F.coalesce("ch", "head").alias("c"), F.coalesce("ct", "tail").alias("ct"))
    # A chain from a node back to it puts that node on a cycle, alone or with others.
    chains = rooted.filter("c = ct").select("n", "c")
    rings = links.filter("open").select("n", F.col("least").alias("c"))
    roots = chains.select(F.col("c").alias("n"), "c")
    return assigned.unionByName(chains).unionByName(rings).unionByName(roots).distinct()


def _spread_minimum(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """Each node takes the smallest id that reaches it along the pairs."""
    best = None
    while True:
        sent = lookup(
            pairs, colours.select(F.col("n").alias("a"), F.col("c")), ["a"], ["b"], "inner"
        ).groupBy(F.col("b").alias("n")).agg(F.min("c").alias("c"))
        fresh = materialize(
            colours.join(sent.withColumnRenamed("c", "s"), "n", "left")
            .select("n", F.least("c", "s").alias("c"), F.coalesce(F.col("s") < F.col("c"), F.lit(False)).alias("moved")),
            "colour",
        )
        if best is not None:
            discard(best)
        best = fresh
        colours = best.select("n", "c")
        if best.filter("moved").isEmpty():
            return colours


def _collect_backward(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """Nodes that reach the root of their colour inside that colour."""
    inside = lookup(
        pairs, colours.select(F.col("n").alias("a"), F.col("c").alias("ca")), ["a"], ["b"], "inner"
    )
    inside = lookup(
        inside, colours.select(F.col("n").alias("b"), F.col("c").alias("cb")), ["b"], ["a"], "inner", count_on=pairs
    )
    inside = materialize(inside.filter("ca = cb").select("a", "b"), "inside")
    reached = materialize(colours.filter("n = c").select("n"), "reached")
    front = reached
    while True:
        step = lookup(inside, front.select(F.col("n").alias("b")), ["b"], ["a"], "inner")
        front = materialize(
            step.select(F.col("a").alias("n")).distinct().join(reached, "n", "left_anti"), "front"
        )
        if front.isEmpty():
            return colours.join(reached, "n", "left_semi").select("n", "c")
        reached = materialize(reached.unionByName(front), "reached")


def strong_components(
    nodes: DataFrame, edges: DataFrame,
    source: str = "source_node_id", destination: str = "destination_node_id",
) -> DataFrame:
    """``component`` of every node: the smallest node id it shares a directed cycle with."""
    pairs = materialize(_pairs(edges, source, destination), "strong")
    rows, parts, chains = pairs.count(), [], []
    while rows:
        trimmed = _trim(pairs)
        discard(pairs)
        left = trimmed.count()
        if 2 * left < rows:
            pairs, rows = trimmed, left
            continue
        pairs, links = _contract(trimmed)
        discard(trimmed)
        chains.append((len(parts), links))
        left = pairs.count()
        if left < rows:
            rows = left
            continue
        ids = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        colours = _spread_minimum(pairs, materialize(ids.withColumn("c", F.col("n")), "colour"))
        found = materialize(_collect_backward(pairs, colours), "found")
        parts.append(found)
        gone = found.select("n")
        before = pairs
        pairs = materialize(
            before.join(gone.withColumnRenamed("n", "a"), "a", "left_anti")
            .join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b"),
            "strong",
        )
        discard(before)
        rows = pairs.count()
    assigned = pairs.select(F.col("a").alias("n"), F.col("a").alias("c")).limit(0)  # no pair is left
    # The last contraction first: the ends of a chain may be links of a later one.
    for done, links in reversed(chains):
        if parts[done:]:
            assigned = reduce(DataFrame.unionByName, parts[done:], assigned)
            parts = parts[:done]
        if not links.isEmpty():
            assigned = materialize(_resolved(assigned, links), "resolved")
    least = assigned.groupBy("c").agg(F.min("n").alias("component"))
    members = lookup(assigned, least, ["c"], ["n"]).select(F.col("n").alias("node_id"), "component")
    return nodes.select("node_id").join(members, "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def component_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("component").agg(F.count("*").alias("size"))


def largest_sizes(assigned: DataFrame, k: int = 10) -> DataFrame:
    return component_sizes(assigned).orderBy(F.desc("size"), "component").limit(k)


def component_summary(assigned: DataFrame, kind: str) -> DataFrame:
    """Count, largest, smallest and the share of all nodes in the largest; zeros without nodes."""
    zero = F.lit(0).cast("bigint")
    return component_sizes(assigned).agg(
        F.lit(kind).alias("kind"), F.count("*").alias("component_count"),
        F.coalesce(F.max("size"), zero).alias("largest_component_size"),
        F.coalesce(F.min("size"), zero).alias("smallest_component_size"),
        F.coalesce(F.max("size") / F.sum("size"), F.lit(0.0)).alias("largest_component_ratio"),
    )
