import gzip
import random

import pytest
from conftest import rows
from fixtures import EVENTS, RAW_LINES, TYPED_EDGE_SCHEMA, TYPED_EDGES, TYPED_NODE_SCHEMA, TYPED_NODES
from pyspark.sql import functions as F

from tracewright.functions import columns as c
from tracewright.operators import components, features, graph, leakage, normalize, profile, splits
from tracewright.schemas import EDGE_SCHEMA, EVENT_SCHEMA, FAMILIES, NODE_SCHEMA, TableCheckError
from tracewright.session import materialize
from tracewright.sources import raw_logs, tables


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for kind, lines in RAW_LINES.items():
        with gzip.open(folder / f"{kind}.txt.gz", "wt") as out:
            out.write("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def landed(spark, raw_dir):
    return {k: raw_logs.land(spark, f"{raw_dir}/{k}.txt.gz", k) for k in RAW_LINES}


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, EVENT_SCHEMA)


@pytest.fixture(scope="module")
def typed(spark):
    nodes = spark.createDataFrame(TYPED_NODES, TYPED_NODE_SCHEMA)
    edges = spark.createDataFrame(TYPED_EDGES, TYPED_EDGE_SCHEMA).withColumn(
        "edge_type", c.edge_type("event_family", "event_type"))
    return nodes, edges


def test_landing_adds_metadata(landed):
    auth = landed["auth"]
    assert auth.columns[0] == "row_number" and auth.columns[-2:] == ["source_file", "event_family"]
    assert rows(auth, "row_number", "source_file", "event_family") == [
        (0, "auth.txt.gz", "authentication"), (1, "auth.txt.gz", "authentication")]
    assert all(df.count() == 2 for df in landed.values())


def test_landing_limits_and_switches(spark, raw_dir):
    path = f"{raw_dir}/dns.txt.gz"
    assert raw_logs.land(spark, path, "dns", max_rows=1).count() == 1
    bare = raw_logs.land(spark, path, "dns", None, False, False, False)
    assert bare.columns == ["timestamp", "source_host", "resolved_host"]
    with pytest.raises(ValueError):
        raw_logs.land(spark, path, "dns", max_rows=0)
    with pytest.raises(TableCheckError):
        raw_logs.land(spark, path, "auth")


def test_landing_checks_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,h1,h2\n")
    (tmp_path / "b.csv").write_text("2,h1,h2\n3,h1\n")
    with pytest.raises(TableCheckError):
        raw_logs.land(spark, str(tmp_path), "dns")
    (tmp_path / "b.csv").write_text('2,"h1,quoted",h2\n')
    assert raw_logs.land(spark, str(tmp_path), "dns").count() == 2


def test_landing_keeps_all_rows_when_the_scan_is_cut_anew(spark, tmp_path):
    (tmp_path / "dns.csv").write_text("".join(f"{i},host{i % 7},name{i}\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        table = raw_logs.land(spark, str(tmp_path), "dns")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "170k")
        got = table.select("row_number", "timestamp").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_number"], int(r["timestamp"])) for r in got) == [(i, i) for i in range(60_000)]


def test_row_numbers_across_splits_and_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3000)):
        (tmp_path / name).write_text("".join(f"{i},H{i},D{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = raw_logs.land(spark, str(tmp_path / "*.txt"), "dns", max_rows=4000)
        assert df.filter("row_number <> cast(timestamp as bigint)").count() == 0
        assert rows(df.groupBy("source_file").count()) == [("a.txt", 4000), ("b.txt", 3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_land_all_writes_manifest(spark, raw_dir, tmp_path):
    files = {k: f"{k}.txt.gz" for k in RAW_LINES}
    manifest = raw_logs.land_all(spark, raw_dir, str(tmp_path), files)
    assert manifest.count() == 5
    assert {r["row_count"] for r in manifest.collect()} == {2}
    with pytest.raises(FileNotFoundError):
        raw_logs.landing_plan(spark, raw_dir, str(tmp_path), {"auth": "absent.gz"})


def test_unified_events(landed):
    out = normalize.unify(landed)
    assert out.schema.fieldNames() == EVENT_SCHEMA.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in EVENT_SCHEMA]
    assert rows(out.groupBy("event_family").count()) == sorted((f, 2) for f in FAMILIES.values())
    assert rows(out.groupBy("label").count()) == [(0, 8), (1, 2)]
    truth = out.filter("event_family = 'redteam_ground_truth'")
    assert rows(truth, "event_id", "event_result", "label") == [
        ("lanl_redteam_0", "confirmed_redteam", 1), ("lanl_redteam_1", "confirmed_redteam", 1)]
    first = normalize.in_total_order(out).first()
    assert (first["timestamp"], first["event_id"]) == (1, "lanl_authentication_0")


def test_flow_measures_and_ports(landed):
    flow = normalize.network_flow(landed["flows"]).filter("row_number = 0").first()
    assert (flow["duration"], flow["byte_count"], flow["destination_port"]) == (10.0, 4096.0, "443")


def test_text_and_number_cleaning(spark):
    df = spark.createDataFrame(
        [("\t x ",), ("  ",), (None,), ("7.9",), ("1d",), ("9007199254740993",), ("inf",)], "s string")
    out = df.select(c.norm("s"), c.to_long_or("s", -1), c.to_double_or("s")).collect()
    assert [r[0] for r in out] == ["x", "unknown", "unknown", "7.9", "1d", "9007199254740993", "inf"]
    assert [r[1] for r in out] == [-1, -1, -1, 7, -1, 9007199254740993, -1]
    assert out[3][2] == 7.9 and out[4][2] == 0.0


def test_nodes_edges_and_enrichment(events):
    nodes = graph.build_nodes(events)
    assert nodes.schema.fieldNames() == NODE_SCHEMA.fieldNames()
    assert rows(nodes, "node_id", "node_key") == [
        (0, "host::C001"), (1, "host::C002"), (2, "host_or_domain::corp.example"),
        (3, "process::powershell.exe"), (4, "user::U001"), (5, "user::U999")]
    edges = graph.require_matched(graph.build_edges(events, nodes))
    assert edges.schema.fieldNames() == EDGE_SCHEMA.fieldNames() and edges.count() == 5
    assert edges.filter("label = 1").first()["edge_type"] == "redteam_ground_truth:redteam_activity"
    rich = {r["node_key"]: r for r in graph.enrich_nodes(nodes, edges).collect()}
    assert (rich["host::C001"]["event_count"], rich["host::C001"]["first_seen_timestamp"],
            rich["host::C001"]["last_seen_timestamp"]) == (3, 1, 3)
    assert rich["user::U999"]["label"] == 1 and rich["host::C002"]["label"] == 1
    assert rows(graph.validation_report(nodes, edges, ["event_count"]).filter("violations <> 0")) == []


def test_invalid_edges_and_policy(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "node_id bigint")
    edges = spark.createDataFrame(
        [("e1", 0, 1), ("e2", 0, 1), ("e3", 1, 2), ("e4", 3, 1), ("bad", 999, 1)],
        "edge_id string, source_node_id bigint, destination_node_id bigint")
    assert rows(graph.invalid_edges(edges, nodes), "edge_id") == [("bad",)]
    assert graph.apply_edge_policy(edges, nodes).count() == 4
    with pytest.raises(TableCheckError):
        graph.apply_edge_policy(edges, nodes, "fail")


def test_homogeneous_features(spark):
    nodes = spark.createDataFrame(
        [(0, "user", 1, 20, 2, 0), (1, "host", 1, 40, 4, 1), (2, "host_or_domain", 30, 30, 1, 0),
         (3, "user", 40, 40, 1, 1)],
        "node_id bigint, entity_type string, first_seen_timestamp bigint, last_seen_timestamp bigint, "
        "event_count bigint, label bigint")
    out = {r["node_id"]: r for r in features.node_features(nodes).collect()}
    assert [round(out[i]["event_count"], 6) for i in range(4)] == [0.333333, 1.0, 0.0, 0.0]
    assert [round(out[i]["active_span"], 6) for i in range(4)] == [round(19 / 39, 6), 1.0, 0.0, 0.0]
    edges = spark.createDataFrame(
        [("e1", 0, 1, "authentication", "authentication:auth_logon", 1, 0),
         ("e2", 0, 1, "authentication", "authentication:auth_logon", 20, 0),
         ("e3", 1, 2, "dns", "dns:dns_resolution", 30, 0),
         ("e4", 3, 1, "redteam_ground_truth", "redteam_ground_truth:redteam_activity", 40, 1)],
        "edge_id string, source_node_id bigint, destination_node_id bigint, event_family string, "
        "edge_type string, timestamp bigint, label bigint")
    table = features.edge_features(edges)
    assert not [x for x in table.columns if "ground_truth" in x]
    times = [round(r["timestamp_scaled"], 6) for r in table.orderBy("edge_id").collect()]
    assert times == [0.0, round(19 / 39, 6), round(29 / 39, 6), 1.0]


def test_leakage_filter_and_typed_graph(typed):
    nodes, edges = typed
    safe = leakage.require_no_leak(leakage.safe_edges(edges))
    assert safe.count() == 5
    with pytest.raises(TableCheckError):
        leakage.require_no_leak(edges)
    triples = {tuple(r)[:3] for r in graph.relation_counts(graph.typed_relations(safe)).collect()}
    assert {("user", "auth_logon", "host"), ("host", "rev_auth_logon", "user"),
            ("process", "rev_process_start", "user")} <= triples
    graph.require_no_ground_truth_relation(graph.typed_relations(safe))


def test_safe_statistics_by_hand(typed):
    stats = {r["node_id"]: r for r in features.safe_statistics(*typed).collect()}
    pick = lambda i: tuple(stats[i][k] for k in (
        "outgoing_count", "incoming_count", "unique_neighbor_count", "first_seen", "last_seen"))
    assert pick(0) == (2, 0, 2, 100, 120)
    assert pick(4) == (2, 1, 3, 100, 140)
    assert stats[5]["unique_neighbor_count"] == 2
    assert all(pick(i) == (0, 0, 0, 0, 0) for i in (2, 3, 6, 7))


def test_typed_split_is_complete(typed):
    out = splits.typed_node_split(typed[0])
    assert out.count() == 8 and out.select("node_id").distinct().count() == 8
    with pytest.raises(ValueError):
        splits.typed_node_split(typed[0], 0.5, 0.5, 0.5)


def test_degree_counts_self_loop_twice(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_id bigint")
    edges = spark.createDataFrame([(0, 0), (0, 1)], "source_node_id bigint, destination_node_id bigint")
    out = graph.degree_table(nodes, edges)
    assert rows(out) == [(0, 1, 2, 3), (1, 1, 0, 1), (2, 0, 0, 0)]
    assert rows(profile.isolated_nodes(nodes, edges)) == [(2,)]


def test_components_on_small_shapes(spark):
    nodes = spark.range(14).withColumnRenamed("id", "node_id")
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 6), (6, 7), (7, 8), (8, 9), (11, 10), (12, 12)]
    edges = spark.createDataFrame(pairs, "source_node_id bigint, destination_node_id bigint")
    weak = dict(tuple(r) for r in components.weak_components(nodes, edges).collect())
    assert weak == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5), 10: 10, 11: 10, 12: 12, 13: 13}
    strong = dict(tuple(r) for r in components.strong_components(nodes, edges).collect())
    assert strong == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, **{i: i for i in range(5, 14)}}
    summary = components.component_summary(components.weak_components(nodes, edges), "weak").first()
    assert (summary["component_count"], summary["largest_component_size"]) == (5, 5)


def plain_strong(n, pairs):
    """Smallest node that each node reaches and is reached by, from sets."""
    ahead = [set() for _ in range(n)]
    for a, b in pairs:
        ahead[a].add(b)
    reach = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for b in ahead[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        reach.append(seen)
    return {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}


@pytest.mark.parametrize("n,edges,seed", [(60, 66, 1), (60, 75, 2), (40, 44, 3), (50, 120, 4)])
def test_strong_components_of_random_graphs(spark, n, edges, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)]
    # Two rings, a chain from a node back to it, a chain within a cycle and one out of it.
    for stretch in ([7, 23, 5, 31, 7], [2, n, n + 1, n + 2, 2], [3, n + 3, n + 4, 9, 3], [9, n + 5, n + 6, 1], [n + 9, n + 8, n + 7, n + 9]):
        pairs += list(zip(stretch, stretch[1:]))
    frame = spark.createDataFrame(pairs, "source_node_id bigint, destination_node_id bigint")
    nodes = spark.range(n + 10).withColumnRenamed("id", "node_id")
    assert dict(tuple(r) for r in components.strong_components(nodes, frame).collect()) == plain_strong(n + 10, pairs)


@pytest.mark.parametrize("closed", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, closed):
    n, written = 5000, []
    monkeypatch.setattr(components, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    order = random.Random(0).sample(range(n), n)
    pairs = list(zip(order, order[1:])) + [(order[-1], order[0])] * closed
    frame = spark.createDataFrame(pairs, "source_node_id bigint, destination_node_id bigint")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    found = components.strong_components(nodes, frame).collect()
    assert len(found) == n and all(r.component == (0 if closed else r.node_id) for r in found)
    assert len(written) <= 40


def test_long_path_is_one_weak_component(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)], "source_node_id bigint, destination_node_id bigint")
    nodes = spark.range(n + 1).withColumnRenamed("id", "node_id")
    assert components.weak_components(nodes, edges).filter("component <> 0").count() == 0


def test_flow_files_and_tabular_features(spark, tmp_path):
    header = " Destination Port, Protocol, Flow Bytes/s, Fwd PSH Flags, Label"
    (tmp_path / "a.csv").write_text(header + "\n80,6,1.5,0,BENIGN\n443,6,Infinity,1,DDoS\n")
    (tmp_path / "b.csv").write_text(" Destination Port, Label\n22,PortScan\n22,\n")
    df = tables.read_flow_csvs(spark, tables.csv_files(spark, str(tmp_path)))
    out = features.tabular_features(df)
    assert out.columns == ["destination_port", "protocol", "flow_bytes_per_s", "fwd_psh_flags", "target"]
    assert out.agg(F.sum("target")).first()[0] == 3
    groups = features.feature_groups(out).first()
    assert tuple(groups) == (4, 2, 1, 1)
    with pytest.raises(FileNotFoundError):
        tables.csv_files(spark, str(tmp_path / "none"))


def test_flow_folder_may_hold_a_part_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").mkdir()
    (tmp_path / "a.csv" / "part-0.csv").write_text("Destination Port,Label\n")
    (tmp_path / "a.csv" / "part-1.csv").write_text("Destination Port,Label\n80,BENIGN\n22,DDoS\n")
    df = tables.read_flow_csvs(spark, tables.csv_files(spark, str(tmp_path)))
    assert sorted(r["Destination Port"] for r in df.collect()) == [22, 80]
    (tmp_path / "b.csv").write_text("Destination Port,Label\n")
    with pytest.raises(TableCheckError):
        tables.read_flow_csvs(spark, tables.csv_files(spark, str(tmp_path)))


def test_documents_are_quarantined(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"f1": 0.5}')
    (tmp_path / "bad.json").write_text('1{"f1": 0.5}')
    good, bad = tables.read_documents(spark, [str(tmp_path / "*.json")])
    assert good.count() == 1 and bad.count() == 1


def test_registration_and_zones(spark, tmp_path):
    record = dict(name="x", source="s", uri="u", zone="silver", format="parquet", description="d")
    tables.register_dataset(spark, str(tmp_path), **record)
    tables.register_dataset(spark, str(tmp_path), **record)
    assert spark.read.json(tables.zone_path(str(tmp_path), "metadata", "manifests")).count() == 2
    with pytest.raises(ValueError):
        tables.zone_path("/x", "lead")
