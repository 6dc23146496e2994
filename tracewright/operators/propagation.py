"""Neighbourhood aggregation on node feature tables.

Feature tables are wide: ``node_id`` and one double column per dimension. Parallel
edges are merged into weighted pairs first, normalisation is folded into the node
side, and every aggregate has a map-side part, so a hub costs one partial row per
task instead of all its edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.columns import leaky_relu
from tracewright.operators.joins import lookup
from tracewright.session import materialize


def weighted_pairs(edges: DataFrame, undirected: bool = False, dedupe: bool = True) -> DataFrame:
    """(src, dst, n): distinct pairs; ``n`` counts repeats unless ``dedupe``."""
    pairs = edges.select(
        F.col("source_node_id").alias("src"), F.col("destination_node_id").alias("dst")
    )
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if undirected and dedupe:
        # Either direction is shuffled once, as the one with the smaller end first (a null one before others).
        turned = F.coalesce(F.col("dst") < F.col("src"), F.col("dst").isNull() & F.col("src").isNotNull())
        low, high = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
        once = pairs.select(low.alias("src"), high.alias("dst")).distinct()
        return once.select(F.inline(F.array_distinct(both))).withColumn("n", F.lit(1).cast("bigint"))
    if undirected:
        pairs = pairs.select(F.inline(both))
    n = F.lit(1).cast("bigint") if dedupe else F.count("*")
    return pairs.groupBy("src", "dst").agg(n.alias("n"))


def _sent(pairs: DataFrame, sender: DataFrame) -> DataFrame:
    """Each pair with its sender's columns."""
    return lookup(pairs, sender.withColumnRenamed("node_id", "src"), ["src"], ["dst"], "inner")


def _onto(nodes: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """All nodes; the zero vector where nothing arrived."""
    return nodes.select("node_id").join(found, "node_id", "left").select(
        "node_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]
    )


def normalized_propagation(
    features: DataFrame, edges: DataFrame, columns: list[str],
    undirected: bool = True, dedupe: bool = True,
) -> DataFrame:
    """One step of ``D^-1/2 (A + I) D^-1/2 X``; the degree counts incoming pairs and the self-loop."""
    pairs = weighted_pairs(edges, undirected, dedupe).filter("src <> dst")
    degree = pairs.groupBy(F.col("dst").alias("node_id")).agg((F.sum("n") + 1).cast("double").alias("_deg"))
    nodes = features.select("node_id", *columns).join(degree, "node_id", "left").withColumn(
        "_root", F.sqrt(F.coalesce("_deg", F.lit(1.0)))
    )
    sender = nodes.select("node_id", *[(F.col(c) / F.col("_root")).alias(c) for c in columns])
    arrived = _sent(pairs, sender).groupBy(F.col("dst").alias("node_id")).agg(
        *[F.sum(F.col("n") * F.col(c)).alias(f"_in_{c}") for c in columns]
    )
    return nodes.join(arrived, "node_id", "left").select(
        "node_id",
        *[
            ((F.coalesce(f"_in_{c}", F.lit(0.0)) + F.col(c) / F.col("_root")) / F.col("_root")).alias(c)
            for c in columns
        ],
    )


def adjacency_weights(nodes: DataFrame, edges: DataFrame, undirected: bool = True) -> DataFrame:
    """Entries (src, dst, weight) of the normalised adjacency, self-loops included."""
    pairs = weighted_pairs(edges, undirected).filter("src <> dst").unionByName(
        nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1).cast("bigint").alias("n"))
    )
    degree = pairs.groupBy(F.col("dst").alias("node_id")).agg(F.sum("n").alias("d"))
    left = lookup(pairs, degree.select(F.col("node_id").alias("src"), F.col("d").alias("ds")), ["src"], ["dst"], "inner")
    both = lookup(
        left, degree.select(F.col("node_id").alias("dst"), F.col("d").alias("dd")), ["dst"], ["src"], "inner",
        count_on=pairs,
    )
    return both.select("src", "dst", (F.col("n") / F.sqrt(F.col("ds").cast("double") * F.col("dd"))).alias("weight"))


def neighbour_aggregate(
    features: DataFrame, edges: DataFrame, columns: list[str], how: str = "mean",
    undirected: bool = False, dedupe: bool = True,
) -> DataFrame:
    """Mean, sum or max over the nodes that point at each node; zeros without any."""
    pairs = _sent(weighted_pairs(edges, undirected, dedupe), features.select("node_id", *columns))
    rules = {
        "mean": lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n"),
        "sum": lambda c: F.sum(F.col("n") * F.col(c)),
        "max": lambda c: F.max(c),
    }
    if how not in rules:
        raise ValueError(f"unknown aggregate {how!r}")
    found = pairs.groupBy(F.col("dst").alias("node_id")).agg(*[rules[how](c).alias(c) for c in columns])
    return _onto(features, found, columns)


def linear(columns: list[str], weights: list[list[float]], prefix: str = "z") -> dict[str, Column]:
    """``x W`` as expressions; ``weights`` has one row per input column."""
    out = {}
    for j in range(len(weights[0])):
        terms = [F.col(c) * F.lit(float(w[j])) for c, w in zip(columns, weights, strict=True)]
        out[f"{prefix}{j}"] = reduce(lambda a, b: a + b, terms)
    return out


def self_and_neighbours(
    features: DataFrame, edges: DataFrame, columns: list[str],
    self_weights: list[list[float]], neighbour_weights: list[list[float]],
    how: str = "mean", undirected: bool = False,
) -> DataFrame:
    """``x Ws + mean(neighbours) Wn`` per node."""
    features = materialize(features.select("node_id", *columns), "features")  # read three times
    around = neighbour_aggregate(features, edges, columns, how, undirected)
    renamed = around.select("node_id", *[F.col(c).alias(f"_n_{c}") for c in columns])
    own = linear(columns, self_weights)
    other = linear([f"_n_{c}" for c in columns], neighbour_weights)
    return features.join(renamed, "node_id").select(
        "node_id", *[(own[z] + other[z]).alias(z) for z in own]
    )


def relation_means(features: DataFrame, relations: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over senders for every (relation, receiver)."""
    pairs = relations.select(
        "source_type", "relation", "destination_type",
        F.col("source_node_id").alias("src"), F.col("destination_node_id").alias("dst"),
    )
    sent = lookup(
        pairs, features.select(F.col("node_id").alias("src"), *columns), ["src"], ["dst", "relation"], "inner"
    )
    return sent.groupBy(
        "source_type", "relation", "destination_type", F.col("dst").alias("node_id")
    ).agg(*[F.avg(c).alias(c) for c in columns])


def relation_sum(features: DataFrame, relations: DataFrame, columns: list[str]) -> DataFrame:
    """Per node, the relation-wise means summed over its incoming relations."""
    found = relation_means(features, relations, columns).groupBy("node_id").agg(
        *[F.sum(c).alias(c) for c in columns]
    )
    return _onto(features, found, columns)


def attention(
    features: DataFrame, edges: DataFrame, columns: list[str],
    weights: list[list[float]], vector: list[float],
    slope: float = 0.2, add_self_loops: bool = False, dedupe: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(edge weights, new node vectors) of one attention head.

    The score of an edge is ``LeakyReLU(a . [z_receiver | z_sender])``. Both halves of
    the product are computed once per node; the softmax per receiver takes a maximum
    and a sum, both aggregates with a map-side part.
    """
    z = linear(columns, weights)
    names = list(z)
    if len(vector) != 2 * len(names):
        raise ValueError("the attention vector must cover receiver and sender")

    def half(values: list[float]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(n) * F.lit(float(v)) for n, v in zip(names, values)])

    nodes = features.select("node_id", *[e.alias(n) for n, e in z.items()]).withColumns({
        "_recv": half(vector[: len(names)]), "_send": half(vector[len(names):]),
    })
    pairs = weighted_pairs(edges, dedupe=dedupe)
    if add_self_loops:
        own = features.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1).cast("bigint").alias("n"))
        pairs = pairs.filter("src <> dst").unionByName(own)
    sent = _sent(pairs, nodes.select("node_id", "_send", *names))
    scored = lookup(
        sent, nodes.select(F.col("node_id").alias("dst"), "_recv"), ["dst"], ["src"], "inner", count_on=pairs
    ).withColumn("_score", leaky_relu(F.col("_recv") + F.col("_send"), slope))
    peak = scored.groupBy("dst").agg(F.max("_score").alias("_peak"))
    lifted = lookup(scored, peak, ["dst"], ["src"], "inner", count_on=pairs).withColumn(
        "_e", F.col("n") * F.exp(F.col("_score") - F.col("_peak"))
    )
    sums = lifted.groupBy("dst").agg(
        F.sum("_e").alias("_total"), *[F.sum(F.col("_e") * F.col(n)).alias(n) for n in names]
    )
    shares = lookup(
        lifted.select("src", "dst", "n", "_score", "_e"), sums.select("dst", "_total"), ["dst"], ["src"], "inner",
        count_on=pairs,
    ).select("src", "dst", F.col("_score").alias("score"), (F.col("_e") / F.col("_total")).alias("weight"))
    fresh = sums.select(
        F.col("dst").alias("node_id"), *[(F.col(n) / F.col("_total")).alias(n) for n in names]
    )
    return shares, _onto(features, fresh, names)


def multi_head_attention(
    features: DataFrame, edges: DataFrame, columns: list[str],
    heads: list[tuple[list[list[float]], list[float]]], **options,
) -> DataFrame:
    """Concatenated heads, columns ``h<head>_z<dim>``."""
    out = features.select("node_id")
    for k, (weights, vector) in enumerate(heads):
        _, fresh = attention(features, edges, columns, weights, vector, **options)
        renamed = fresh.select(
            "node_id", *[F.col(c).alias(f"h{k}_{c}") for c in fresh.columns if c != "node_id"]
        )
        out = out.join(renamed, "node_id")
    return out


def k_hop_features(
    features: DataFrame, edges: DataFrame, columns: list[str], hops: int = 2,
    undirected: bool = True, keep_all: bool = True,
) -> DataFrame:
    """Features after 0..``hops`` propagation steps (simplified graph convolution).

    Each step is written out, so the plan of the next one starts from a table.
    """
    pairs = materialize(
        weighted_pairs(edges, undirected).select(
            F.col("src").alias("source_node_id"), F.col("dst").alias("destination_node_id")
        ), "pairs",
    )
    current = materialize(features.select("node_id", *columns), "features")
    out = current
    for k in range(1, hops + 1):
        current = materialize(normalized_propagation(current, pairs, columns, undirected=False), "hop")
        renamed = current.select("node_id", *[F.col(c).alias(f"{c}_hop{k}") for c in columns])
        out = out.join(renamed, "node_id") if keep_all else renamed
    return out
