"""Queries on neighbourhood aggregation and link prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import features, graph, leakage, links, propagation
from tracewright.plans.metrics import rounded
from tracewright.plans.reference_sql import cte, sql
from tracewright.plans.registry import query
from tracewright.session import materialize
from tracewright.sources import testbed

COLUMNS = ["log_outgoing_event_count", "log_incoming_event_count", "normalized_last_seen"]

cte("x", """
SELECT node_id, ln(1 + outgoing_count) AS log_outgoing_event_count, ln(1 + incoming_count) AS log_incoming_event_count,
       last_seen / (SELECT CAST(greatest(max("timestamp"), 1) AS DOUBLE) FROM safe_edge_table) AS normalized_last_seen
FROM safe_stats
""")

cte("both_ways", """
SELECT source_node_id AS src, destination_node_id AS dst FROM safe_edge_table
UNION SELECT destination_node_id, source_node_id FROM safe_edge_table
""")

cte("adjacency", """
SELECT src, dst FROM both_ways WHERE src <> dst UNION ALL SELECT node_id, node_id FROM x
""")

cte("degree_of", "SELECT dst AS node_id, CAST(count(*) AS DOUBLE) AS d FROM adjacency GROUP BY dst")

cte("weights", """
SELECT src, dst, 1 / sqrt(a.d * b.d) AS weight FROM adjacency
JOIN degree_of a ON a.node_id = src JOIN degree_of b ON b.node_id = dst
""")


def _hop(name: str, before: str) -> None:
    cte(name, "SELECT dst AS node_id, " + ", ".join(f"sum(weight * {c}) AS {c}" for c in COLUMNS)
        + f" FROM weights JOIN {before} ON node_id = src GROUP BY dst")


_hop("hop_one", "x")
_hop("hop_two", "hop_one")
LIST = ", ".join(f"round({c}, 5) AS {c}" for c in COLUMNS)


def _shown(df, digits: int = 5):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def _features(spark, sf_dir):
    table = features.safe_node_features(testbed.enriched_nodes(spark, sf_dir), testbed.edges(spark, sf_dir))
    return table.select("node_id", *COLUMNS)


def _safe(spark, sf_dir):
    return leakage.safe_edges(testbed.edges(spark, sf_dir))


@query("adjacency_weights", sql("SELECT src, dst, round(weight, 6) AS weight FROM weights"))
def adjacency_weights(spark, sf_dir):
    return rounded(propagation.adjacency_weights(testbed.nodes(spark, sf_dir), _safe(spark, sf_dir)))


@query("normalized_propagation", sql(f"SELECT node_id, {LIST} FROM hop_one"))
def normalized_propagation(spark, sf_dir):
    return _shown(propagation.normalized_propagation(_features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS))


@query("directed_multigraph_propagation", sql("""
, counted AS (SELECT source_node_id AS src, destination_node_id AS dst, count(*) AS n FROM safe_edge_table
              WHERE source_node_id <> destination_node_id GROUP BY 1, 2
              UNION ALL SELECT node_id, node_id, 1 FROM x),
deg AS (SELECT dst AS node_id, CAST(sum(n) AS DOUBLE) AS d FROM counted GROUP BY 1)
SELECT dst AS node_id, """ + ", ".join(f"round(sum(n * {c} / sqrt(a.d * b.d)), 5) AS {c}" for c in COLUMNS) + """
FROM counted JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst JOIN x ON x.node_id = src
GROUP BY dst"""))
def directed_multigraph_propagation(spark, sf_dir):
    """Degree by incoming events, repeats counted, as the library layer does on a multigraph."""
    return _shown(propagation.normalized_propagation(
        _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS, undirected=False, dedupe=False
    ))


@query("k_hop_features", sql("SELECT x.node_id, " + ", ".join(
    f"round(x.{c}, 5) AS {c}, round(p.{c}, 5) AS {c}_hop1, round(q.{c}, 5) AS {c}_hop2" for c in COLUMNS
) + " FROM x JOIN hop_one p ON p.node_id = x.node_id JOIN hop_two q ON q.node_id = x.node_id"))
def k_hop_features(spark, sf_dir):
    return _shown(propagation.k_hop_features(_features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS))


def _neighbour_sql(rule: str) -> str:
    return sql("SELECT n.node_id, " + ", ".join(
        f"round(coalesce({rule.format(c)}, 0), 5) AS {c}" for c in COLUMNS
    ) + " FROM x n LEFT JOIN (SELECT dst, s.* FROM both_ways JOIN x s ON s.node_id = src) m ON m.dst = n.node_id"
        " GROUP BY n.node_id")


def _register_neighbours(how: str, rule: str) -> None:
    @query(f"neighbour_{how}", _neighbour_sql(rule))
    def aggregate(spark, sf_dir):
        return _shown(propagation.neighbour_aggregate(
            _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS, how, undirected=True
        ))


for _how, _rule in (("mean", "avg(m.{})"), ("sum", "sum(m.{})"), ("max", "max(m.{})")):
    _register_neighbours(_how, _rule)

SELF = [[1.0, 0.5], [0.0, -0.25], [2.0, 1.0]]
OTHER = [[0.5, 0.0], [0.25, 1.0], [-1.0, 0.5]]


def _combined(weights, source: str, j: int) -> str:
    return " + ".join(f"{w[j]!r}::DOUBLE * {source}.{c}" for c, w in zip(COLUMNS, weights))


@query("self_and_neighbours", sql("""
, around AS (SELECT n.node_id, """ + ", ".join(f"coalesce(avg(m.{c}), 0) AS {c}" for c in COLUMNS) + """
  FROM x n LEFT JOIN (SELECT dst, s.* FROM both_ways JOIN x s ON s.node_id = src) m ON m.dst = n.node_id
  GROUP BY n.node_id)
SELECT x.node_id, """ + ", ".join(
    f"round({_combined(SELF, 'x', j)} + {_combined(OTHER, 'around', j)}, 5) AS z{j}" for j in range(2)
) + " FROM x JOIN around ON around.node_id = x.node_id"))
def self_and_neighbours(spark, sf_dir):
    return _shown(propagation.self_and_neighbours(
        _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS, SELF, OTHER, undirected=True
    ))


cte("relation_mean", """
SELECT source_type, relation, destination_type, destination_node_id AS node_id, """ + ", ".join(
    f"avg({c}) AS {c}" for c in COLUMNS
) + " FROM relation_table JOIN x ON x.node_id = source_node_id GROUP BY 1, 2, 3, 4")


@query("relation_means", sql(f"SELECT source_type, relation, destination_type, node_id, {LIST} FROM relation_mean"))
def relation_means(spark, sf_dir):
    relations = graph.typed_relations(_safe(spark, sf_dir))
    return _shown(propagation.relation_means(_features(spark, sf_dir), relations, COLUMNS))


@query("relation_sum", sql("SELECT x.node_id, " + ", ".join(
    f"round(coalesce(sum(m.{c}), 0), 5) AS {c}" for c in COLUMNS
) + " FROM x LEFT JOIN relation_mean m ON m.node_id = x.node_id GROUP BY x.node_id"))
def relation_sum(spark, sf_dir):
    relations = graph.typed_relations(_safe(spark, sf_dir))
    return _shown(propagation.relation_sum(_features(spark, sf_dir), relations, COLUMNS))


PROJECT = [[0.5, -0.25], [0.25, 0.5], [1.0, 1.0]]
ATTEND = [0.5, -0.25, 0.125, 0.375]


def _attention_ctes(prefix: str, project, attend) -> None:
    z = [" + ".join(f"{w[j]!r}::DOUBLE * {c}" for c, w in zip(COLUMNS, project)) for j in range(2)]
    cte(f"{prefix}_z", f"SELECT node_id, {z[0]} AS z0, {z[1]} AS z1 FROM x")
    raw = " + ".join(
        f"{v!r}::DOUBLE * {side}" for v, side in zip(attend, ["r.z0", "r.z1", "s.z0", "s.z1"])
    )
    cte(f"{prefix}_scores", f"""
SELECT src, dst, CASE WHEN v > 0 THEN v ELSE v * 0.2::DOUBLE END AS score, z0, z1 FROM (
  SELECT src, dst, {raw} AS v, s.z0, s.z1
  FROM (SELECT src, dst FROM one_way WHERE src <> dst UNION ALL SELECT node_id, node_id FROM x)
  JOIN {prefix}_z r ON r.node_id = dst JOIN {prefix}_z s ON s.node_id = src)
""")
    cte(f"{prefix}_shares", f"""
SELECT *, exp(score - max(score) OVER (PARTITION BY dst))
          / sum(exp(score)) OVER (PARTITION BY dst) * exp(max(score) OVER (PARTITION BY dst)) AS weight
FROM {prefix}_scores
""")


cte("one_way", "SELECT DISTINCT source_node_id AS src, destination_node_id AS dst FROM safe_edge_table")
_attention_ctes("first", PROJECT, ATTEND)
PROJECT_TWO, ATTEND_TWO = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]], [0.25, 0.25, -0.125, 0.5]
_attention_ctes("second", PROJECT_TWO, ATTEND_TWO)


@query("attention_weights", sql("""
SELECT src, dst, round(score, 5) AS score, round(weight, 5) AS weight FROM first_shares"""))
def attention_weights(spark, sf_dir):
    shares, _ = propagation.attention(
        _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS, PROJECT, ATTEND, add_self_loops=True
    )
    return _shown(shares)


@query("attention_vectors", sql("""
SELECT dst AS node_id, round(sum(weight * z0), 5) AS z0, round(sum(weight * z1), 5) AS z1
FROM first_shares GROUP BY dst"""))
def attention_vectors(spark, sf_dir):
    _, fresh = propagation.attention(
        _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS, PROJECT, ATTEND, add_self_loops=True
    )
    return _shown(fresh)


@query("multi_head_attention", sql("""
SELECT node_id, h0_z0, h0_z1, h1_z0, h1_z1 FROM
 (SELECT dst AS node_id, round(sum(weight * z0), 5) AS h0_z0, round(sum(weight * z1), 5) AS h0_z1
  FROM first_shares GROUP BY dst)
 JOIN (SELECT dst AS node_id, round(sum(weight * z0), 5) AS h1_z0, round(sum(weight * z1), 5) AS h1_z1
  FROM second_shares GROUP BY dst) USING (node_id)"""))
def multi_head_attention(spark, sf_dir):
    return _shown(propagation.multi_head_attention(
        _features(spark, sf_dir), _safe(spark, sf_dir), COLUMNS,
        [(PROJECT, ATTEND), (PROJECT_TWO, ATTEND_TWO)], add_self_loops=True,
    ))


# ---------------------------------------------------------------- link prediction

cte("symmetric_table", """
SELECT source_node_id, destination_node_id FROM edge_table WHERE source_node_id <> destination_node_id
UNION SELECT destination_node_id, source_node_id FROM edge_table WHERE source_node_id <> destination_node_id
""")

cte("pair_table", """
SELECT DISTINCT least(source_node_id, destination_node_id) AS a, greatest(source_node_id, destination_node_id) AS b
FROM edge_table WHERE source_node_id <> destination_node_id
""")

cte("pair_split", """
SELECT a, b, CASE WHEN r <= n - 2 * held THEN 'train' WHEN r <= n - held THEN 'validation' ELSE 'test' END AS split
FROM (SELECT a, b, row_number() OVER (ORDER BY md5('42|' || a || '|' || b)) AS r, count(*) OVER () AS n,
             CAST(floor((count(*) OVER ()) * CAST(0.15 AS DOUBLE)) AS BIGINT) AS held FROM pair_table)
""")


def _negative_cte(name: str, tag: str) -> None:
    def end(part: str) -> str:
        return f"CAST('0x' || substr(md5('{tag}|{part}|' || range), 1, 12) AS BIGINT) % n"

    cte(name, f"""
SELECT a, b FROM (
  SELECT a, b, min(draw) AS draw FROM (
    SELECT least(s, t) AS a, greatest(s, t) AS b, range AS draw
    FROM (SELECT range, {end('from')} AS s, {end('to')} AS t
          FROM range(60000), (SELECT count(*) AS n FROM node_table)) WHERE s <> t)
  WHERE (a, b) NOT IN (SELECT (a, b) FROM pair_table) GROUP BY a, b
  ORDER BY draw LIMIT (SELECT count(*) FROM pair_split WHERE split = 'test'))
""")


_negative_cte("test_negatives", "42|test|0")

cte("test_targets", """
SELECT a, b, CAST(1 AS INTEGER) AS label FROM pair_split WHERE split = 'test'
UNION ALL SELECT a, b, 0 FROM test_negatives
""")


def _pairs(spark, sf_dir):
    return links.undirected_pairs(testbed.edges(spark, sf_dir))


def _targets(spark, sf_dir):
    split = materialize(links.split_pairs(_pairs(spark, sf_dir)), "split")
    return split, links.link_targets(split, testbed.nodes(spark, sf_dir).count(), "test")


@query("distinct_directed_pairs", sql("SELECT DISTINCT source_node_id, destination_node_id FROM edge_table"))
def distinct_directed_pairs(spark, sf_dir):
    return testbed.edges(spark, sf_dir).select("source_node_id", "destination_node_id").distinct()


@query("symmetric_pairs", sql("SELECT * FROM symmetric_table"))
def symmetric_pairs(spark, sf_dir):
    return links.link_graph(testbed.edges(spark, sf_dir))


@query("asymmetric_pairs", sql("""
SELECT DISTINCT source_node_id, destination_node_id FROM edge_table e
WHERE NOT EXISTS (SELECT 1 FROM edge_table r WHERE r.source_node_id = e.destination_node_id
                  AND r.destination_node_id = e.source_node_id)"""))
def asymmetric_pairs(spark, sf_dir):
    return links.asymmetric_pairs(distinct_directed_pairs(spark, sf_dir))


@query("undirected_pairs", sql("SELECT * FROM pair_table"))
def undirected_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("link_graph_report", sql("""
SELECT event_edges, self_loops, event_edges - self_loops - directed AS duplicates,
       sym - directed AS reverse_pairs_added, sym AS symmetric_pairs
FROM (SELECT (SELECT count(*) FROM edge_table) AS event_edges,
             (SELECT count(*) FROM edge_table WHERE source_node_id = destination_node_id) AS self_loops,
             (SELECT count(*) FROM (SELECT DISTINCT source_node_id, destination_node_id FROM edge_table
                                    WHERE source_node_id <> destination_node_id)) AS directed,
             (SELECT count(*) FROM symmetric_table) AS sym)"""))
def link_graph_report(spark, sf_dir):
    return links.link_graph_report(testbed.edges(spark, sf_dir))


@query("link_split", sql("SELECT * FROM pair_split"))
def link_split(spark, sf_dir):
    return links.split_pairs(_pairs(spark, sf_dir))


@query("link_context_pairs", sql("SELECT a, b FROM pair_split WHERE split <> 'test'"))
def link_context_pairs(spark, sf_dir):
    return links.context_pairs(links.split_pairs(_pairs(spark, sf_dir)), "test")


@query("negative_pairs", sql("SELECT a, b FROM test_negatives"))
def negative_pairs(spark, sf_dir):
    return _targets(spark, sf_dir)[1].filter("label = 0").select("a", "b")


@query("link_targets", sql("SELECT * FROM test_targets"))
def link_targets(spark, sf_dir):
    split, targets = _targets(spark, sf_dir)
    return links.require_no_leaked_pairs(targets, links.context_pairs(split, "test"))


@query("leaked_pairs", sql("""
SELECT a, b FROM test_targets WHERE label = 1 AND (a + b) % 4 = 0"""))
def leaked_pairs(spark, sf_dir):
    """A quarter of the test pairs is put back into the context, where it must be found."""
    split, targets = _targets(spark, sf_dir)
    back = targets.filter("label = 1 and (a + b) % 4 = 0").select("a", "b")
    return links.leaked_pairs(targets, links.context_pairs(split, "test").select("a", "b").unionByName(back))


cte("decoded", """
SELECT a, b, label, 1 / (1 + exp(-list_sum(list_transform(range(1, len(va) + 1), lambda i: va[i]::DOUBLE * vb[i]::DOUBLE)))) AS probability
FROM (SELECT t.*, p.embedding AS va, q.embedding AS vb FROM test_targets t
      JOIN embeddings p ON p.vec_id = a JOIN embeddings q ON q.vec_id = b)
""")


def _decoded(spark, sf_dir):
    vectors = testbed.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return links.decode(_targets(spark, sf_dir)[1], vectors, key="vec_id")


@query("pair_probabilities", sql("""
SELECT a, b, label, round(probability, 6) AS probability, round(1 - probability, 6) AS anomaly_score FROM decoded"""))
def pair_probabilities(spark, sf_dir):
    return rounded(_decoded(spark, sf_dir))


@query("reconstruction_report", sql("""
, grouped AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
              FROM decoded GROUP BY 1),
runs AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM grouped WINDOW w AS (ORDER BY probability DESC)),
plain AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n,
  avg(CASE WHEN label = 1 THEN -ln(probability + 1e-15) END) + avg(CASE WHEN label = 0 THEN -ln(1 - probability + 1e-15) END) AS loss,
  avg(CASE WHEN label = 1 THEN probability END) AS yes, avg(CASE WHEN label = 0 THEN probability END) AS no FROM decoded)
SELECT round(loss, 6) AS loss, p AS positive_edges, n AS negative_edges, round(yes, 6) AS mean_positive_probability,
       round(no, 6) AS mean_negative_probability, round(1 - yes, 6) AS mean_positive_anomaly_score,
       (SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / CAST(p * n AS DOUBLE), 6) FROM runs) AS roc_auc,
       (SELECT round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / p, 6) FROM runs) AS average_precision
FROM plain"""))
def reconstruction_report(spark, sf_dir):
    return rounded(links.reconstruction_report(_decoded(spark, sf_dir)))


@query("held_out_link_report")
def held_out_link_report(spark, sf_dir):
    """Held-out pairs scored with features propagated over context pairs only."""
    split, targets = _targets(spark, sf_dir)
    nodes = features.standardized(_features(spark, sf_dir), COLUMNS, F.lit(True))
    vectors = links.safe_embeddings(nodes, links.context_pairs(split, "test"), COLUMNS)
    return links.reconstruction_report(links.decode(targets, vectors))


@query("trained_link_report")
def trained_link_report(spark, sf_dir):
    """The same held-out pairs scored with factors that were trained on the context pairs."""
    split, targets = _targets(spark, sf_dir)
    targets = materialize(targets, "targets")
    return links.reconstruction_report(links.trained_scores(split, targets, testbed.nodes(spark, sf_dir).count()))
