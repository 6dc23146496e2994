"""Common table expressions for the SQL side of the checks, in DuckDB's dialect.

``sql(body)`` puts every expression the body names, and what those name in turn,
in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _used(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [name for name in CTES if name in words]


def sql(body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _used(CTES[name]):
            if other != name and other not in order:
                visit(other)
        if name not in order:
            order.append(name)

    for name in _used(body):
        visit(name)
    if not order:
        return body.strip()
    head = ",\n".join(f"{name} AS MATERIALIZED (\n{CTES[name]}\n)" for name in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body.strip()}"


cte("base_events", """
SELECT event_id AS row_number,
       CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS "timestamp",
       user_id, event_type, value, regexp_extract(props, '(\\d+)', 1) AS k
FROM events
""")

cte("raw_auth", """
SELECT row_number, "timestamp", 'U' || user_id AS source_user, 'U' || user_id AS destination_user,
       'C' || (user_id % 100) AS source_host, 'C' || k AS destination_host,
       'Kerberos' AS auth_type, 'Network' AS logon_type, event_type AS auth_orientation,
       CASE WHEN value >= 20 THEN 'Success' ELSE 'Failure' END AS result,
       'auth.txt.gz' AS source_file, 'authentication' AS event_family
FROM base_events WHERE event_type IN ('click', 'view')
""")

cte("raw_proc", """
SELECT row_number, "timestamp", 'U' || user_id AS source_user, 'C' || k AS host,
       'P' || (row_number % 23) AS process_name, event_type AS process_event,
       'proc.txt.gz' AS source_file, 'process' AS event_family
FROM base_events WHERE event_type IN ('purchase', 'signup')
""")

cte("raw_dns", """
SELECT row_number, "timestamp", 'C' || k AS source_host, 'D' || (user_id % 40) AS resolved_host,
       'dns.txt.gz' AS source_file, 'dns' AS event_family
FROM base_events WHERE event_type = 'error' AND value <= 60
""")

cte("raw_redteam", """
SELECT row_number, "timestamp", 'U' || user_id AS source_user, 'C' || (user_id % 100) AS source_host,
       'C' || k AS destination_host,
       'redteam.txt.gz' AS source_file, 'redteam_ground_truth' AS event_family
FROM base_events WHERE event_type = 'error' AND value > 60
""")

cte("raw_flows", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                                   l_extendedprice, l_shipdate, l_returnflag) - 1 AS row_number,
       CAST(1704067200 + (l_orderkey * 13 + l_linenumber * 7919) % 2592000 AS VARCHAR) AS "timestamp",
       CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS duration,
       'C' || (l_suppkey % 100) AS source_host, CAST(l_partkey AS VARCHAR) AS source_port,
       'C' || (l_partkey % 100) AS destination_host, CAST(l_linenumber AS VARCHAR) AS destination_port,
       l_returnflag AS protocol, CAST(l_linenumber AS VARCHAR) AS packet_count,
       CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) AS byte_count,
       'flows.txt.gz' AS source_file, 'network_flow' AS event_family
FROM lineitem
""")

cte("norm_auth", """
SELECT 'lanl_authentication_' || row_number AS event_id, CAST("timestamp" AS BIGINT) AS "timestamp",
       'authentication' AS event_family, 'auth_' || lower(auth_orientation) AS event_type,
       source_user AS source_entity, destination_host AS destination_entity,
       'user' AS source_entity_type, 'host' AS destination_entity_type, lower(result) AS event_result,
       CAST(0 AS BIGINT) AS label, source_file, row_number,
       source_user, destination_user, source_host, destination_host
FROM raw_auth
""")

cte("norm_dns", """
SELECT 'lanl_dns_' || row_number AS event_id, CAST("timestamp" AS BIGINT) AS "timestamp",
       'dns' AS event_family, 'dns_resolution' AS event_type,
       source_host AS source_entity, resolved_host AS destination_entity,
       'host' AS source_entity_type, 'host_or_domain' AS destination_entity_type,
       'unknown' AS event_result, CAST(0 AS BIGINT) AS label, source_file, row_number,
       source_host, resolved_host
FROM raw_dns
""")

cte("norm_flows", """
SELECT 'lanl_network_flow_' || row_number AS event_id, CAST("timestamp" AS BIGINT) AS "timestamp",
       'network_flow' AS event_family, 'network_flow' AS event_type,
       source_host AS source_entity, destination_host AS destination_entity,
       'host' AS source_entity_type, 'host' AS destination_entity_type,
       'observed' AS event_result, CAST(0 AS BIGINT) AS label, source_file, row_number,
       source_host, destination_host, source_port, destination_port, protocol,
       CAST(duration AS DOUBLE) AS duration, CAST(packet_count AS DOUBLE) AS packet_count,
       CAST(byte_count AS DOUBLE) AS byte_count
FROM raw_flows
""")

cte("norm_proc", """
SELECT 'lanl_process_' || row_number AS event_id, CAST("timestamp" AS BIGINT) AS "timestamp",
       'process' AS event_family, 'process_' || lower(process_event) AS event_type,
       source_user AS source_entity, process_name AS destination_entity,
       'user' AS source_entity_type, 'process' AS destination_entity_type,
       lower(process_event) AS event_result, CAST(0 AS BIGINT) AS label, source_file, row_number,
       source_user, host, process_name, process_event
FROM raw_proc
""")

cte("norm_redteam", """
SELECT 'lanl_redteam_' || row_number AS event_id, CAST("timestamp" AS BIGINT) AS "timestamp",
       'redteam_ground_truth' AS event_family, 'redteam_activity' AS event_type,
       source_user AS source_entity, destination_host AS destination_entity,
       'user' AS source_entity_type, 'host' AS destination_entity_type,
       'confirmed_redteam' AS event_result, CAST(1 AS BIGINT) AS label, source_file, row_number,
       source_user, source_host, destination_host
FROM raw_redteam
""")

EVENT_LIST = """event_id, "timestamp", event_family, event_type, source_entity, destination_entity,
       source_entity_type, destination_entity_type, event_result, label, source_file, row_number"""

cte("unified", "\nUNION ALL\n".join(
    f"SELECT {EVENT_LIST} FROM norm_{kind}" for kind in ("auth", "dns", "flows", "proc", "redteam")
))

cte("node_table", """
SELECT row_number() OVER (ORDER BY entity_type, entity_name) - 1 AS node_id,
       entity_type, entity_name, entity_type || '::' || entity_name AS node_key
FROM (SELECT source_entity_type AS entity_type, source_entity AS entity_name FROM unified
      UNION SELECT destination_entity_type, destination_entity FROM unified)
""")

cte("edge_table", """
SELECT u.event_id AS edge_id, s.node_id AS source_node_id, d.node_id AS destination_node_id,
       source_entity, destination_entity, source_entity_type, destination_entity_type,
       event_family || ':' || event_type AS edge_type, event_family, event_type, "timestamp",
       event_result, label, source_file, row_number
FROM unified u
LEFT JOIN node_table s ON s.node_key = u.source_entity_type || '::' || u.source_entity
LEFT JOIN node_table d ON d.node_key = u.destination_entity_type || '::' || u.destination_entity
""")

cte("roles", """
SELECT source_node_id AS node_id, "timestamp", label FROM edge_table
UNION ALL SELECT destination_node_id, "timestamp", label FROM edge_table
""")

cte("enriched", """
SELECT n.node_id, entity_type, entity_name, node_key,
       coalesce(min(r."timestamp"), -1) AS first_seen_timestamp,
       coalesce(max(r."timestamp"), -1) AS last_seen_timestamp,
       count(r.node_id) AS event_count, coalesce(max(r.label), 0) AS label
FROM node_table n LEFT JOIN roles r ON r.node_id = n.node_id
GROUP BY n.node_id, entity_type, entity_name, node_key
""")

cte("degrees", """
SELECT e.node_id, node_key, entity_type, label,
       coalesce(i.n, 0) + coalesce(o.n, 0) AS total_degree,
       coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree
FROM enriched e
LEFT JOIN (SELECT destination_node_id AS node_id, count(*) AS n FROM edge_table GROUP BY 1) i USING (node_id)
LEFT JOIN (SELECT source_node_id AS node_id, count(*) AS n FROM edge_table GROUP BY 1) o USING (node_id)
""")

cte("safe_edge_table", """
SELECT * FROM edge_table
WHERE NOT (label = 1 OR event_family = 'redteam_ground_truth' OR event_type = 'redteam_activity'
           OR event_result = 'confirmed_redteam' OR starts_with(edge_type, 'redteam_ground_truth')
           OR contains(lower(source_file), 'redteam'))
""")

cte("local_ids", """
SELECT node_id, row_number() OVER (PARTITION BY entity_type ORDER BY node_id) - 1 AS local_id
FROM node_table
""")

cte("checked_edges", """
SELECT e.edge_id, source_node_id, destination_node_id,
       s.entity_type IN ('user', 'host') AND d.entity_type IN ('user', 'host') AS ok
FROM edge_table e JOIN node_table s ON s.node_id = source_node_id
JOIN node_table d ON d.node_id = destination_node_id
""")

cte("relation_table", """
SELECT DISTINCT source_entity_type AS source_type, event_type AS relation,
       destination_entity_type AS destination_type, source_node_id, destination_node_id
FROM safe_edge_table
UNION ALL
SELECT DISTINCT destination_entity_type, 'rev_' || event_type, source_entity_type,
       destination_node_id, source_node_id
FROM safe_edge_table
""")
