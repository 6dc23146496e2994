"""Link prediction: pair splits, negative pairs and reconstruction metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from tracewright.functions.columns import dot, draw, sigmoid
from tracewright.operators.evaluation import ranking_metrics
from tracewright.operators.joins import lookup_as, undirected_pair
from tracewright.operators.leakage import without_self_loops
from tracewright.operators.ordered import dense_index
from tracewright.operators.propagation import k_hop_features
from tracewright.operators.sampling import hashed_split
from tracewright.schemas import TableCheckError, require_no_rows
from tracewright.session import materialize

PAIR = ["a", "b"]


def link_graph(edges: DataFrame) -> DataFrame:
    """Symmetric, distinct (source, destination) pairs without self-loops."""
    pairs = without_self_loops(edges).select("source_node_id", "destination_node_id").distinct()
    back = pairs.select(
        F.col("destination_node_id").alias("source_node_id"),
        F.col("source_node_id").alias("destination_node_id"),
    )
    return pairs.unionByName(back).distinct()


def link_graph_report(edges: DataFrame) -> DataFrame:
    """One row: events, self-loops removed, duplicates removed, reverse pairs added, pairs left."""
    plain = without_self_loops(edges)
    directed = plain.select("source_node_id", "destination_node_id").distinct().agg(F.count("*"))
    pairs = link_graph(edges).agg(F.count("*"))
    return edges.agg(
        F.count("*").alias("event_edges"),
        F.count_if(F.col("source_node_id") == F.col("destination_node_id")).alias("self_loops"),
    ).select(
        "event_edges", "self_loops",
        (F.col("event_edges") - F.col("self_loops") - directed.scalar()).alias("duplicates"),
        (pairs.scalar() - directed.scalar()).alias("reverse_pairs_added"),
        pairs.scalar().alias("symmetric_pairs"),
    )


def asymmetric_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose reverse is absent."""
    back = pairs.select(
        F.col("destination_node_id").alias("source_node_id"),
        F.col("source_node_id").alias("destination_node_id"),
    )
    return pairs.join(back, ["source_node_id", "destination_node_id"], "left_anti")


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    a, b = undirected_pair("source_node_id", "destination_node_id")
    return edges.select(a.alias("a"), b.alias("b")).filter("a < b").distinct()


def split_pairs(
    pairs: DataFrame, validation: float = 0.15, test: float = 0.15, seed: int = 42
) -> DataFrame:
    """``split`` per undirected pair, so both directions stay together."""
    def cuts(n: int) -> list[int]:
        held = int(n * validation) + int(n * test)
        return [n - held, n - int(n * test)]

    # Written first, for finding the cuts and splitting read them several times.
    return hashed_split(materialize(pairs, "pairs"), PAIR, [], ["train", "validation", "test"], cuts, seed)


def context_pairs(split: DataFrame, evaluated: str) -> DataFrame:
    """Pairs messages may use when ``evaluated`` is scored: only earlier splits."""
    earlier = {"train": ["train"], "validation": ["train"], "test": ["train", "validation"]}[evaluated]
    return split.filter(F.col("split").isin(earlier)).select(*PAIR)


def negative_pairs(
    known: DataFrame, nodes: int, wanted: int, seed: int | str = 42, epoch: int = 0
) -> DataFrame:
    """Exactly ``wanted`` distinct node pairs that are no known edge (fewer only if none are left).

    Endpoints are hashed from a draw number and accepted pairs are taken in draw
    order, so the result does not depend on how many draws are made at a time.
    Node ids must be 0..nodes-1.
    """
    spark = known.sparkSession
    taken = known.count()
    free = nodes * (nodes - 1) // 2 - taken
    target = min(wanted, free)
    if target <= 0:
        raise TableCheckError("no free pairs to draw from")
    tag = f"{seed}|{epoch}"
    # Chance that a draw is free; each draw hits an ordered pair.
    draws = int(target * 1.3 * nodes * nodes / (2 * free)) + 64
    while True:
        a, b = undirected_pair(draw(f"{tag}|from", nodes, "id"), draw(f"{tag}|to", nodes, "id"))
        drawn = (
            spark.range(draws).select("id", a.alias("a"), b.alias("b")).filter("a < b")
            .groupBy("a", "b").agg(F.min("id").alias("draw"))
            .join(known.select(*PAIR), PAIR, "left_anti")
        )
        ranked = materialize(dense_index(drawn, ["draw"], "_rank"), "negatives")
        if ranked.count() >= target:
            return ranked.filter(F.col("_rank") < target).select(*PAIR)
        draws *= 2


def link_targets(split: DataFrame, nodes: int, evaluated: str, seed: int = 42) -> DataFrame:
    """(a, b, label): the split's pairs and as many fixed negatives. Negatives avoid every known pair."""
    positives = split.filter(F.col("split") == evaluated).select(*PAIR)
    n = positives.count()
    if n == 0:
        raise TableCheckError(f"split {evaluated} has no pairs")
    negatives = negative_pairs(split.select(*PAIR), nodes, n, f"{seed}|{evaluated}")
    return positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))


def leaked_pairs(targets: DataFrame, context: DataFrame) -> DataFrame:
    """Held-out positive pairs that the context already shows."""
    return targets.filter("label = 1").select(*PAIR).join(context, PAIR, "left_semi")


def require_no_leaked_pairs(targets: DataFrame, context: DataFrame) -> DataFrame:
    require_no_rows(leaked_pairs(targets, context), "held-out pairs are part of the context")
    return targets


def decode(pairs: DataFrame, embeddings: DataFrame, vector: str = "embedding", key: str = "node_id") -> DataFrame:
    """Pair probability ``sigmoid(z_a . z_b)`` and anomaly score ``1 - p``."""
    out = pairs
    for end in PAIR:
        out = lookup_as(out, embeddings, end, key, {vector: f"_{end}"}, PAIR, "inner", count_on=pairs)
    p = sigmoid(dot("_a", "_b"))
    return out.withColumn("probability", p).withColumn("anomaly_score", 1.0 - F.col("probability")).drop("_a", "_b")


def reconstruction_report(decoded: DataFrame) -> DataFrame:
    """One row of loss, ranking metrics and mean probabilities on labelled, decoded pairs."""
    tiny = F.lit(1e-15)
    # Written once: the ranks and the means read it.
    decoded = materialize(decoded.select("label", "probability"), "decoded")
    is_edge = F.col("label") == 1
    rank = ranking_metrics(decoded.select("label", F.col("probability").alias("score")), on_single_class="error")
    yes = F.avg(F.when(is_edge, F.col("probability")))
    return decoded.agg(
        (
            F.avg(F.when(is_edge, -F.log(F.col("probability") + tiny)))
            + F.avg(F.when(~is_edge, -F.log(1.0 - F.col("probability") + tiny)))
        ).alias("loss"),
        F.count_if(is_edge).alias("positive_edges"), F.count_if(~is_edge).alias("negative_edges"),
        yes.alias("mean_positive_probability"),
        F.avg(F.when(~is_edge, F.col("probability"))).alias("mean_negative_probability"),
        (1.0 - yes).alias("mean_positive_anomaly_score"),
    ).withColumns({
        "roc_auc": rank.select("roc_auc").scalar(),
        "average_precision": rank.select("average_precision").scalar(),
    })


def safe_embeddings(
    features: DataFrame, context: DataFrame, columns: list[str], hops: int = 2
) -> DataFrame:
    """(node_id, embedding) from features propagated over context pairs only."""
    edges = context.select(F.col("a").alias("source_node_id"), F.col("b").alias("destination_node_id"))
    wide = k_hop_features(features, edges, columns, hops)
    names = [c for c in wide.columns if c != "node_id"]
    return wide.select("node_id", F.array(*names).alias("embedding"))


def trained_embeddings(
    context: DataFrame, rank: int = 16, rounds: int = 10, strength: float = 0.1, weight: float = 10.0, seed: int = 42,
) -> DataFrame:
    """(node_id, sender, receiver) factors of the context pairs by alternating least squares.

    Every context pair counts in both directions with confidence ``1 + weight``, every other pair of
    nodes as a zero of confidence 1; no draw of negatives is needed, for their sum is one small matrix
    that all blocks share. Nodes and pairs are dealt to blocks, and each half round solves the nodes of
    one side. Node ids must be whole numbers below 2 ** 31.
    """
    both = context.unionByName(context.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("seen", F.lit(1.0))
    blocks = max(1, int(context.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    model = ALS(
        rank=rank, maxIter=rounds, regParam=strength, implicitPrefs=True, alpha=weight, userCol="a", itemCol="b", ratingCol="seen",
        numUserBlocks=blocks, numItemBlocks=blocks, seed=seed, checkpointInterval=-1,
    ).fit(materialize(both, "context"))
    sender = model.userFactors.select(F.col("id").alias("node_id"), F.col("features").cast("array<double>").alias("sender"))
    receiver = model.itemFactors.select(F.col("id").alias("node_id"), F.col("features").cast("array<double>").alias("receiver"))
    return sender.join(receiver, "node_id")


def affinity(pairs: DataFrame, factors: DataFrame) -> DataFrame:
    """``pairs`` with the ``affinity`` of their ends, the mean of both directions; 0 for a node without factors."""
    out = pairs
    for end in PAIR:
        out = lookup_as(out, factors, end, "node_id", {"sender": f"_{end}_s", "receiver": f"_{end}_r"}, PAIR, "left", count_on=pairs)
    found = (dot("_a_s", "_b_r") + dot("_b_s", "_a_r")) / 2
    return out.withColumn("affinity", F.coalesce(found, F.lit(0.0))).drop("_a_s", "_a_r", "_b_s", "_b_r")


def calibrated(fit: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``probability`` and ``anomaly_score`` from affinities, by a logistic curve through labelled ``fit`` pairs."""
    gather = VectorAssembler(inputCols=["affinity"], outputCol="_x")
    curve = LogisticRegression(featuresCol="_x", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(gather.transform(fit))
    p = vector_to_array("_p")[1]
    out = curve.transform(gather.transform(pairs)).withColumn("probability", p)
    return out.withColumn("anomaly_score", 1.0 - F.col("probability")).drop("_x", "_p", "_r", "_c")


def trained_scores(split: DataFrame, targets: DataFrame, nodes: int, seed: int = 42, **settings) -> DataFrame:
    """``targets`` of the test split with their probabilities.

    The curve is fitted on validation pairs scored with factors of the training pairs; the test pairs
    are scored with factors of what is earlier than they are. Neither sees a pair it is asked about.
    """
    held = link_targets(split, nodes, "validation", seed)
    seen = context_pairs(split, "validation")
    fit = affinity(require_no_leaked_pairs(held, seen), trained_embeddings(seen, seed=seed, **settings))
    seen = context_pairs(split, "test")
    found = affinity(require_no_leaked_pairs(targets, seen), trained_embeddings(seen, seed=seed, **settings))
    return calibrated(materialize(fit, "fit"), materialize(found, "found"))
