"""Small tables with results known by hand."""

RAW_LINES = {
    "auth": ["1,U001,U001,C001,C002,Kerberos,Network,LogOn,Success",
             "2,U002,U002,C003,C004,NTLM,RemoteInteractive,LogOn,Failure"],
    "dns": ["1,C001,corp.example", "2,C002,login.example"],
    "flows": ["1,10,C001,12345,C002,443,TCP,12,4096", "2,5,C003,23456,C004,80,TCP,7,2048"],
    "proc": ["1,U001,C001,powershell.exe,Start", "2,U002,C003,cmd.exe,Start"],
    "redteam": ["2,U002,C003,C004", "5,U009,C010,C011"],
}

EVENTS = [
    ("lanl_authentication_0", 1, "authentication", "auth_logon", "U001", "C001", "user", "host", "success", 0, "auth.txt.gz", 0),
    ("lanl_dns_0", 2, "dns", "dns_resolution", "C001", "corp.example", "host", "host_or_domain", "unknown", 0, "dns.txt.gz", 0),
    ("lanl_network_flow_0", 3, "network_flow", "network_flow", "C001", "C002", "host", "host", "observed", 0, "flows.txt.gz", 0),
    ("lanl_process_0", 4, "process", "process_start", "U001", "powershell.exe", "user", "process", "start", 0, "proc.txt.gz", 0),
    ("lanl_redteam_0", 5, "redteam_ground_truth", "redteam_activity", "U999", "C002", "user", "host", "confirmed_redteam", 1, "redteam.txt.gz", 0),
]

TYPED_NODES = [
    (0, "user", "n0", 1), (1, "user", "n1", 0), (2, "user", "n2", 0), (3, "user", "n3", 1), (4, "host", "n4", 1),
    (5, "host", "n5", 0), (6, "host", "n6", 0), (7, "host", "n7", 1), (8, "process", "n8", 0),
    (9, "host_or_domain", "n9", 0),
]
TYPED_NODE_SCHEMA = "node_id bigint, entity_type string, entity_name string, label bigint"

TYPED_EDGES = [
    ("t0", 0, 4, "user", "host", "authentication", "auth_logon", 100, "success", 0, "auth.txt.gz"),
    ("t1", 1, 5, "user", "host", "authentication", "auth_logon", 110, "success", 0, "auth.txt.gz"),
    ("t2", 0, 8, "user", "process", "process", "process_start", 120, "start", 0, "proc.txt.gz"),
    ("t3", 4, 9, "host", "host_or_domain", "dns", "dns_resolution", 130, "unknown", 0, "dns.txt.gz"),
    ("t4", 4, 5, "host", "host", "network_flow", "network_flow", 140, "observed", 0, "flows.txt.gz"),
    ("t5", 0, 4, "user", "host", "redteam_ground_truth", "redteam_activity", 150, "confirmed_redteam", 1, "redteam.txt.gz"),
]
TYPED_EDGE_SCHEMA = (
    "edge_id string, source_node_id bigint, destination_node_id bigint, source_entity_type string, "
    "destination_entity_type string, event_family string, event_type string, timestamp bigint, "
    "event_result string, label bigint, source_file string"
)

TOY_FEATURES = [(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 1.0, 0.0)]
TOY_EDGES = [(0, 1), (1, 2), (1, 3)]
