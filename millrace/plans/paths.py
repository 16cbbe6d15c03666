"""Traffic paths over a network that is laid out from the given tables.

The layout is SQL that Spark and DuckDB both read, so that query and SQL see the same network; what
they make of it shares nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, netpaths
from ..sources.tables import table

_K = "(SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)"
_SPOT = "(SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS spot, count(*) OVER (PARTITION BY s_nationkey) AS spots FROM supplier)"

#: table of the network -> SQL. Suppliers are subnets, nations VPCs, customers interfaces and load balancers, orders listeners, lineitems targets.
LAYOUT = {
    "subnets": "SELECT 'subnet-' || s_suppkey AS subnet, 'vpc-' || s_nationkey AS vpc, '10.' || s_nationkey || '.' || (s_suppkey % 256) || '.0/24' AS cidr FROM supplier",
    "explicit_tables": "SELECT 'subnet-' || s_suppkey AS subnet, 'rtb-' || s_nationkey || '-' || (1 + s_suppkey % 4) AS rtb FROM supplier WHERE s_acctbal > 3000",
    "main_tables": "SELECT 'vpc-' || n_nationkey AS vpc, 'rtb-' || n_nationkey || '-0' AS rtb FROM nation WHERE n_nationkey <> 7",
    "routes": f"""
        SELECT 'rtb-' || n_nationkey || '-' || k AS rtb, '10.' || n_nationkey || '.0.0/16' AS cidr, 'local' AS kind, 'local' AS target FROM nation CROSS JOIN {_K}
        UNION ALL SELECT 'rtb-' || n_nationkey || '-1', '0.0.0.0/0', 'igw', 'igw-' || n_nationkey FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-2', '0.0.0.0/0', 'nat', 'nat-' || n_nationkey FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-3', '0.0.0.0/0', 'tgw', 'tgw-1' FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-4', '0.0.0.0/0', 'vpce', 'vpce-' || n_nationkey FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-0', '0.0.0.0/0', 'tgw', 'tgw-1' FROM nation WHERE n_regionkey < 2
        UNION ALL SELECT 'rtb-' || n_nationkey || '-' || k, '10.' || ((n_nationkey + 1) % 25) || '.0.0/16', 'tgw', 'tgw-1' FROM nation CROSS JOIN {_K} WHERE k IN (0, 2, 3)
        UNION ALL SELECT 'rtb-' || n_nationkey || '-1', '10.' || ((n_nationkey + 2) % 25) || '.0.0/16', 'pcx', 'pcx-' || n_nationkey FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-2', '172.16.0.0/12', 'tgw', 'tgw-1' FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-4', '192.168.0.0/16', 'vgw', 'vgw-1' FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-0', 'pl-1', 'tgw', 'tgw-1' FROM nation
        UNION ALL SELECT 'rtb-' || n_nationkey || '-3', '198.51.100.0/24', 'blackhole', 'tgw-1' FROM nation WHERE n_regionkey = 3""",
    "subnet_acls": "SELECT 'subnet-' || s_suppkey AS subnet, 'acl-' || s_nationkey || '-' || (s_suppkey % 3) AS acl FROM supplier WHERE s_acctbal > 0",
    "acl_rules": """
        SELECT 'acl-' || n_nationkey || '-0' AS acl, 'in' AS direction, 100 AS number, 'all' AS protocol, 'all' AS ports, '0.0.0.0/0' AS cidr, 'allow' AS action FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-0', 'out', 100, '-1', 'all', '0.0.0.0/0', 'allow' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-1', 'in', 100, 'tcp', '80', '10.0.0.0/8', 'deny' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-1', 'in', 200, '6', '1-65535', '0.0.0.0/0', 'allow' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-1', 'out', 100, 'tcp', '1024-65535', '0.0.0.0/0', 'allow' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-1', 'out', 200, 'tcp', '443', '0.0.0.0/0', 'allow' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-2', 'in', 100, 'tcp', '443', '0.0.0.0/0', 'allow' FROM nation
        UNION ALL SELECT 'acl-' || n_nationkey || '-2', 'in', 110, 'udp', 'all', '0.0.0.0/0', 'allow' FROM nation""",
    "groups": f"SELECT 'sg-' || n_nationkey || '-' || k AS \"group\" FROM nation CROSS JOIN {_K} WHERE k < 4",
    "group_rules": """
        SELECT 'sg-' || n_nationkey || '-0' AS "group", 'in' AS direction, 0 AS place, 'tcp' AS protocol, '443' AS ports, 'cidr' AS peer_type, '0.0.0.0/0' AS peer FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-0', 'out', 0, 'all', 'all', 'cidr', '0.0.0.0/0' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-1', 'in', 0, 'tcp', '80-8443', 'cidr', '10.0.0.0/8' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-1', 'out', 0, 'tcp', '443', 'cidr', '10.' || n_nationkey || '.0.0/16' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-2', 'in', 0, 'all', 'all', 'group', 'account-1/sg-' || n_nationkey || '-0' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-2', 'in', 1, 'udp', '53', 'cidr', '0.0.0.0/0' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-2', 'out', 0, '6', '1-65535', 'group', 'sg-' || n_nationkey || '-1' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-3', 'in', 0, 'tcp', '443', 'prefix list', 'pl-1' FROM nation
        UNION ALL SELECT 'sg-' || n_nationkey || '-3', 'in', 1, 'tcp', 'all', 'cidr', '10.0.0.0/9' FROM nation WHERE n_regionkey = 1""",
    "interfaces": f"""
        SELECT 'eni-' || c_custkey AS interface, '10.' || c_nationkey || '.' || (c_custkey % 7) || '.' || (c_custkey % 250) AS ip, 'subnet-' || s_suppkey AS subnet, 'vpc-' || c_nationkey AS vpc,
          CAST(c_nationkey % 5 AS VARCHAR(9)) AS account, CASE WHEN c_custkey % 2 = 0 THEN 'i-' || c_custkey END AS instance
        FROM customer JOIN {_SPOT} p ON s_nationkey = c_nationkey AND spot = c_custkey % spots""",
    "interface_groups": "SELECT 'eni-' || c_custkey AS interface, 0 AS place, 'sg-' || c_nationkey || '-' || (c_custkey % 4) AS \"group\" FROM customer UNION ALL SELECT 'eni-' || c_custkey, 1, 'sg-' || c_nationkey || '-' || ((c_custkey + 2) % 5) FROM customer WHERE c_acctbal > 5000",
    "balancers": """
        SELECT 'lb-' || c_custkey AS lb, 'LB-' || c_custkey || '.Example.ORG.' AS dns, 'vpc-' || c_nationkey AS vpc, CAST(c_nationkey % 5 AS VARCHAR(9)) AS account,
          CASE WHEN c_acctbal > 4000 THEN 'internet-facing' ELSE 'internal' END AS scheme, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'network' ELSE 'application' END AS kind FROM customer""",
    "balancer_subnets": f"""
        SELECT 'lb-' || c_custkey AS lb, CASE WHEN spot = c_custkey % spots THEN 0 ELSE 1 END AS place, 'subnet-' || s_suppkey AS subnet
        FROM customer JOIN {_SPOT} p ON s_nationkey = c_nationkey AND (spot = c_custkey % spots OR spot = (c_custkey + 1) % spots)""",
    "balancer_groups": """
        SELECT 'lb-' || c_custkey AS lb, 0 AS place, 'sg-' || c_nationkey || '-' || (c_custkey % 5) AS "group" FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT 'lb-' || c_custkey, 1, 'sg-' || c_nationkey || '-' || ((c_custkey + 1) % 5) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal < 7000""",
    "listeners": "SELECT 'lb-' || o_custkey AS lb, 'lis-' || o_orderkey AS listener, CASE WHEN o_orderpriority LIKE '1%' THEN 443 WHEN o_orderpriority LIKE '2%' THEN 80 WHEN o_orderpriority LIKE '3%' THEN 8443 END AS port, 'tg-' || o_orderkey AS target_group FROM orders WHERE o_orderstatus <> 'P'",
    "targets": """
        SELECT 'tg-' || l_orderkey AS target_group, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place,
          CASE WHEN l_partkey % 8 < 3 THEN 'i-' || l_suppkey * 14 WHEN l_partkey % 8 = 3 THEN '10.99.0.' || (l_partkey % 250) ELSE '10.' || c_nationkey || '.' || (c_custkey % 7) || '.' || (c_custkey % 250) END AS target,
          CASE WHEN l_linenumber % 2 = 0 THEN 8080 END AS port
        FROM lineitem JOIN customer ON c_custkey = 1 + (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM customer)""",
    "attachments": """
        SELECT 'att-' || n_nationkey AS attachment, 'vpc-' || n_nationkey AS vpc, 'vpc' AS kind, 'vpc-' || n_nationkey AS resource, subnet
        FROM nation LEFT JOIN (SELECT s_nationkey, 'subnet-' || max(s_suppkey) AS subnet FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey WHERE n_nationkey <> 11
        UNION ALL SELECT 'att-vpn-' || r_regionkey, NULL, 'vpn', 'vpn-' || r_regionkey, NULL FROM region""",
    "attachment_tables": "SELECT 'att-' || n_nationkey AS attachment, 'trt-' || n_regionkey AS transit_table FROM nation WHERE n_nationkey <> 12",
    "transit_routes": """
        SELECT 'trt-' || r_regionkey AS transit_table, '10.' || n_nationkey || '.0.0/16' AS cidr, 'att-' || n_nationkey AS attachment, 'active' AS state FROM region CROSS JOIN nation WHERE (n_nationkey + r_regionkey) % 4 <> 0
        UNION ALL SELECT 'trt-' || r_regionkey, '0.0.0.0/0', 'att-' || n_nationkey, CASE WHEN r_regionkey = 4 THEN 'blackhole' ELSE 'active' END
          FROM region JOIN (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey) n ON n_regionkey = (r_regionkey + 1) % 5
        UNION ALL SELECT 'trt-' || r_regionkey, '172.16.0.0/12', 'att-vpn-' || r_regionkey, 'active' FROM region
        UNION ALL SELECT 'trt-' || r_regionkey, '10.8.0.0/13', 'att-gone', 'active' FROM region WHERE r_regionkey = 2""",
    "nats": "SELECT 'nat-' || s_nationkey AS nat, 'subnet-' || min(s_suppkey) AS subnet, CASE WHEN s_nationkey % 6 = 0 THEN 'private' ELSE 'public' END AS connectivity FROM supplier WHERE s_nationkey <> 5 GROUP BY s_nationkey",
    "firewalls": "SELECT 'vpce-' || s_nationkey AS endpoint, 'fw-' || s_nationkey AS firewall, CASE WHEN s_nationkey % 5 > 0 THEN 'subnet-' || min(s_suppkey) END AS subnet FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY s_nationkey",
}
CLUSTERS = "SELECT 'cluster-' || s_nationkey || '-' || (s_suppkey % 2) AS cluster, 'subnet-' || s_suppkey AS subnet, 'sg-' || s_nationkey || '-' || (s_suppkey % 5) AS \"group\" FROM supplier"
BASE = ("region", "nation", "supplier", "customer", "orders", "lineitem")


def network(spark, sf, *names: str):
    """The laid-out network; tables that are not named stay empty frames of the same columns."""
    given = {t: table(spark, sf, t) for t in BASE}
    lay = lambda sql: spark.sql(_named(sql).replace('"', "`"), **{t: given[t] for t in BASE if f"{{{t}}}" in _named(sql)})
    n = netpaths.Network(**{name: lay(sql) for name, sql in LAYOUT.items()})
    clusters = lay(CLUSTERS).groupBy("cluster", "subnet").agg(F.array("cluster").alias("x"), F.collect_set("group").alias("groups")).drop("x")
    return n, clusters


def _named(sql: str, tables: tuple[str, ...] = BASE) -> str:
    """Given tables as parameters of spark.sql."""
    for t in tables:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t})", f"{word} {{{t}}})").replace(f"{word} {t}\n", f"{word} {{{t}}}\n")
            if sql.endswith(f"{word} {t}"):
                sql = sql[: -len(t)] + f"{{{t}}}"
    return sql


def _text(hops) -> F.Column:
    return F.array_join(F.transform(hops, lambda h: F.concat_ws(" ", h["what"], h["verdict"], h["evidence"])), " > ")


#: Addresses of customers and routes of parts, both kinds mixed.
MIXED_IPS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '10.' || (c_custkey % 60) || '.' || (c_custkey % 251) || '.7' WHEN c_custkey % 3 = 1 THEN 'fd00:' || hex(c_custkey % 60) || '::' || hex(c_custkey % 4096)
  ELSE '2001:db8:0:' || hex(c_custkey % 16) || ':0:0:a:' || hex(c_custkey % 4096) END AS ip FROM customer"""
MIXED_ROUTES = """SELECT CASE WHEN p_partkey % 7 = 0 THEN '10.' || (p_partkey % 50) || '.0.0/16' WHEN p_partkey % 7 = 1 THEN 'fd00:' || hex(p_partkey % 50) || '::/32' WHEN p_partkey % 7 = 2 THEN '2001:db8::' || '/' || (32 + p_partkey % 3)
  WHEN p_partkey % 7 = 3 THEN '2001:db8:0:' || hex(p_partkey % 16) || '::/64' WHEN p_partkey % 7 = 4 THEN 'fd00:' || hex(p_partkey % 60) || '::' || hex(p_partkey % 4096) || '/128' WHEN p_partkey % 7 = 5 THEN 'fd00::/8' ELSE '10.0.0.0/' || (8 + p_partkey % 4) END AS cidr,
  min(p_partkey) AS target FROM part GROUP BY 1"""


def mixed_prefixes(spark, sf):
    """IPv4 and IPv6 addresses with their longest route and the number of all routes that hold them."""
    ips, routes = (spark.sql(_named(sql, ("customer", "part")), **{t: table(spark, sf, t)}) for sql, t in ((MIXED_IPS, "customer"), (MIXED_ROUTES, "part")))
    n = joins.join_cidr(ips, routes, "ip", "cidr").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    best = joins.longest_prefix(routes, ips.select("ip").distinct(), "ip", "cidr")
    return ips.join(n, "c_custkey").join(best, "ip").select("c_custkey", "ip", "n", "cidr", "prefix")


def network_links(spark, sf):
    return netpaths.network_links(network(spark, sf)[0])


def _shown(paths):
    targets = F.array_join(F.transform("targets", lambda t: F.concat_ws(" ", t["place"].cast("string"), t["target"], F.coalesce(t["interface"], F.lit("?")), t["verdict"], F.sha2(_text(t["hops"]), 256))), ", ")
    return paths.withColumns({"hops": _text(F.col("hops")), "targets": targets})


def inbound_paths(spark, sf):
    """Targets as place, name, interface, verdict and a hash of their hops."""
    return _shown(netpaths.inbound_paths(network(spark, sf)[0]))


def transit_paths(spark, sf):
    return _shown(netpaths.transit_paths(network(spark, sf)[0]))


def egress_paths(spark, sf):
    n, clusters = network(spark, sf)
    return netpaths.egress_paths(n, clusters).withColumn("hops", _text(F.col("hops")))


def open_places(spark, sf):
    """What is open to the internet; customers with much money have public addresses, suppliers' clusters public endpoints."""
    n, _ = network(spark, sf)
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    instances = c.select(F.concat(F.lit("i-"), F.col("c_custkey").cast("string")).alias("instance"), F.when(F.col("c_acctbal") > 9000, F.concat(F.lit("203.0.113."), (F.col("c_custkey") % 250).cast("string"))).alias("public_ip"))
    cidrs = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("0.0.0.0/0"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("10.0.0.0/8")))
    clusters = s.select(F.concat(F.lit("c-"), F.col("s_suppkey").cast("string")).alias("cluster"), (F.col("s_acctbal") > 0).alias("public"), cidrs.alias("cidrs"))
    return netpaths.open_to_internet(n, clusters, instances)


QUERIES = {f.__name__: f for f in (open_places, mixed_prefixes, network_links, inbound_paths, transit_paths, egress_paths)}


# The SQL side: every hop is a row, asks are answered by scans of the rules, text is put together at the end.


def _number(ip: str) -> str:
    return "(" + " + ".join(f"TRY_CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"


def _length(cidr: str) -> str:
    return f"TRY_CAST(split_part({cidr}, '/', 2) AS INT)"


def _holds(cidr: str, ip: str) -> str:
    return f"({_number(f'split_part({cidr}, chr(47), 1)')} >> (32 - {_length(cidr)})) = ({_number(ip)} >> (32 - {_length(cidr)}))"


def _address(cidr: str) -> str:
    n = f"({_number(f'split_part({cidr}, chr(47), 1)')} + least(10, (1::BIGINT << (32 - {_length(cidr)})) - 1))"
    return "(" + " || '.' || ".join(f"(({n} >> {s}) & 255)" for s in (24, 16, 8, 0)) + ")"


_COVERS = "(r.protocol IN ('all', '-1', 'tcp', '6') AND (ports = 'all' OR port BETWEEN TRY_CAST(split_part(ports, '-', 1) AS INT) AND TRY_CAST(split_part(ports, '-', -1) AS INT)))"
_ROUTE_TEXT = "coalesce(rtb, '?') || ': ' || coalesce(cidr || ' -> ' || target, 'no route')"
_LINKS = """
subnet_tables AS (SELECT s.subnet, vpc, coalesce(e.rtb, m.rtb) AS rtb, CASE WHEN e.rtb IS NULL THEN 'main' ELSE 'explicit' END AS how FROM subnets s LEFT JOIN explicit_tables e USING (subnet) LEFT JOIN main_tables m USING (vpc))"""


def _routed(asked: str, name: str, tables: str = "subnet_tables", routes: str = "routes", by: str = "subnet") -> str:
    """Longest prefix by a scan of all routes of the table."""
    return f"""{name} AS (SELECT q.{by}, q.ip, t.rtb, best.cidr, best.kind, best.target FROM (SELECT DISTINCT {by}, ip FROM {asked}) q LEFT JOIN {tables} t USING ({by}) LEFT JOIN (
  SELECT q.{by}, q.ip, unnest(arg_max({{'cidr': cidr, 'kind': kind, 'target': target}}, {_length("cidr")})) FROM (SELECT DISTINCT {by}, ip FROM {asked}) q JOIN {tables} USING ({by}) JOIN {routes} r USING (rtb)
  WHERE {_holds("cidr", "q.ip")} GROUP BY q.{by}, q.ip) best ON best.{by} = q.{by} AND best.ip = q.ip)"""


def _answered(h: str) -> str:
    """CTEs from hops `h` (path, place, n, what, verdict, evidence, kind, groups, subnet, direction, port, ip, callers) to `told` (path, place, hops, verdict)."""
    return f"""
asks AS (SELECT *, row(kind, "groups", subnet, direction, port, ip, callers)::VARCHAR AS ask FROM {h}),
group_asks AS (SELECT DISTINCT ask, "groups", direction, port, ip, callers FROM asks WHERE kind = 'group'),
group_rows AS (SELECT *, unnest(CASE WHEN len("groups") > 0 THEN "groups" ELSE [NULL] END) AS "group", unnest(range(greatest(len("groups"), 1))) AS i FROM group_asks),
ranked AS (SELECT g.ask, g."group", i, place, g."group" || ' ' || r.protocol || ' ' || ports || ' ' || peer AS said, k."group" IS NOT NULL AS known,
  CASE WHEN {_COVERS} AND ((peer_type = 'cidr' AND {_holds("peer", "ip")}) OR (peer_type = 'group' AND list_contains(callers, split_part(peer, '/', -1)))) THEN 0 WHEN {_COVERS} AND peer_type = 'prefix list' THEN 1 END AS rank
  FROM group_rows g LEFT JOIN groups k ON k."group" = g."group" LEFT JOIN group_rules r ON r."group" = k."group" AND r.direction = g.direction),
group_told AS (SELECT ask, CASE WHEN min(rank) = 0 THEN 'PASS' WHEN min(rank) = 1 OR NOT bool_or(known) THEN 'UNKNOWN' ELSE 'FAIL' END AS verdict,
  coalesce(arg_min(said, [rank, i, place]) FILTER (rank IS NOT NULL), CASE WHEN count("group") = 0 THEN 'no group' WHEN NOT bool_or(known) THEN 'unknown groups' ELSE 'no rule' END) AS evidence FROM ranked GROUP BY ask),
acl_told AS (SELECT ask, CASE WHEN acl IS NULL THEN 'UNKNOWN' WHEN action = 'allow' THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN acl IS NULL THEN '' ELSE acl || ' ' || coalesce(number::VARCHAR, 'default') END AS evidence FROM (
  SELECT ask, any_value(a.acl) AS acl, min(number) AS number, arg_min(action, number) AS action FROM (SELECT DISTINCT ask, subnet, direction, port, ip FROM asks WHERE kind = 'acl') q
  LEFT JOIN subnet_acls a USING (subnet) LEFT JOIN acl_rules r ON r.acl = a.acl AND r.direction = q.direction AND {_COVERS} AND {_holds("cidr", "q.ip")} GROUP BY ask)),
route_asks AS (SELECT DISTINCT ask, subnet, ip FROM asks WHERE kind = 'route'),
{_routed("route_asks", "ask_routes")},
route_told AS (SELECT ask, CASE WHEN kind IN ('local', 'tgw', 'pcx') THEN 'PASS' ELSE 'FAIL' END AS verdict, {_ROUTE_TEXT} AS evidence FROM route_asks JOIN ask_routes USING (subnet, ip)),
answers AS (SELECT * FROM group_told UNION ALL SELECT * FROM acl_told UNION ALL SELECT * FROM route_told),
told AS (SELECT path, place, string_agg(what || ' ' || v || CASE WHEN e IS NULL THEN '' ELSE ' ' || e END, ' > ' ORDER BY n) AS hops, CASE WHEN bool_or(v = 'FAIL') THEN 'FAIL' WHEN bool_or(v = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM (
  SELECT path, place, n, what, coalesce(h.verdict, a.verdict) AS v, coalesce(h.evidence, a.evidence) AS e FROM asks h LEFT JOIN answers a ON a.ask = h.ask) GROUP BY path, place)"""


def _with(*parts: str, names=tuple(LAYOUT), recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([*(f'{k} AS ({LAYOUT[k]})' for k in names), *parts])


_HOP = 'path, place, n, what, verdict, evidence, kind, "groups", subnet, direction, port, ip, callers'
_NO_ASK = "NULL::VARCHAR, NULL::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::INT, NULL::VARCHAR, NULL::VARCHAR[]"
_LB = """
lb_subnets AS (SELECT lb, list(subnet ORDER BY place) AS subnets FROM balancer_subnets GROUP BY lb),
lb_groups AS (SELECT lb, list("group" ORDER BY place) AS "groups" FROM balancer_groups GROUP BY lb),
eni_groups AS (SELECT interface, list("group" ORDER BY place) AS "groups" FROM interface_groups GROUP BY interface)"""


def _acl_rows(path: str, place: str, n: int, where: str, direction: str, subnet: str, port: str, ip: str, source: str) -> str:
    back = "in" if direction == "out" else "out"
    row = lambda n, what, d, p: f"SELECT {path}, {place}, {n}, '{where}: network ACL {what}', NULL, NULL, 'acl', NULL::VARCHAR[], {subnet}, '{d}', {p}::INT, {ip}, NULL::VARCHAR[] FROM {source}"
    return f"{row(n, direction, direction, port)} UNION ALL {row(n + 1, f'{back} for replies', back, '32768')}"


def _target_rows(most: int) -> str:
    """CTEs from `legs` (path, lb, target_group, port, client, subnet, lb_ip, groups, vpc, account, kind) to `reached` and `target_hops`."""
    return f"""
near AS (SELECT l.*, t.target, t.place AS t_place, coalesce(t.port, l.port)::INT AS t_port FROM legs l JOIN (SELECT *, row_number() OVER (PARTITION BY target_group ORDER BY place, target) AS nth FROM targets) t USING (target_group) WHERE nth <= {most}),
reached AS (SELECT n.*, CASE WHEN n.target LIKE 'i-%' THEN (SELECT min(interface) FROM interfaces i WHERE i.instance = n.target) ELSE coalesce(
    (SELECT min(interface) FROM interfaces i WHERE i.ip = n.target AND i.vpc = n.vpc), (SELECT min(interface) FROM interfaces i WHERE i.ip = n.target AND i.account = n.account),
    (SELECT CASE WHEN count(*) = 1 THEN min(interface) END FROM interfaces i WHERE i.ip = n.target)) END AS interface FROM near n),
known AS (SELECT r.*, i.ip AS t_ip, i.subnet AS t_subnet, coalesce(g."groups", []) AS t_groups, kind = 'network' AND len(r."groups") = 0 AND target LIKE 'i-%' AS through FROM reached r JOIN interfaces i USING (interface) LEFT JOIN eni_groups g USING (interface)),
target_hops AS (
  SELECT path, t_place AS place, 0 AS n, 'target found' AS what, 'UNKNOWN' AS verdict, target AS evidence, {_NO_ASK} FROM reached WHERE interface IS NULL
  UNION ALL SELECT path, t_place, 0, 'balancer group out to the target', NULL, NULL, 'group', "groups", NULL, 'out', t_port, t_ip, t_groups FROM known WHERE len("groups") > 0
  UNION ALL SELECT path, t_place, 1, 'target group in from the balancer', NULL, NULL, 'group', t_groups, NULL, 'in', t_port, CASE WHEN through THEN client ELSE lb_ip END, CASE WHEN through THEN [] ELSE "groups" END FROM known
  UNION ALL SELECT path, t_place, 2, 'route to the target', NULL, NULL, 'route', NULL, subnet, NULL, NULL, t_ip, NULL FROM known WHERE subnet IS NOT NULL
  UNION ALL {_acl_rows("path", "t_place", 3, "balancer subnet", "out", "subnet", "t_port", "t_ip", "known WHERE subnet IS NOT NULL")}
  UNION ALL {_acl_rows("path", "t_place", 5, "target subnet", "in", "t_subnet", "t_port", "lb_ip", "known WHERE subnet IS NOT NULL")}),
no_target AS (SELECT path, -1 AS place, 99 AS n, 'targets' AS what, 'UNKNOWN' AS verdict, coalesce(target_group, 'no listener') AS evidence, {_NO_ASK} FROM legs WHERE path NOT IN (SELECT path FROM reached))"""


_ROLLED = """
rolled AS (SELECT r.path, string_agg(t_place || ' ' || r.target || ' ' || coalesce(r.interface, '?') || ' ' || t.verdict || ' ' || sha256(t.hops), ', ' ORDER BY t_place) AS targets, bool_or(t.verdict = 'FAIL') AS fail, bool_or(t.verdict = 'UNKNOWN') AS unsure
  FROM reached r JOIN told t ON t.path = r.path AND t.place = r.t_place GROUP BY r.path)"""
_VERDICT = "CASE WHEN fail OR t.verdict = 'FAIL' THEN 'FAIL' WHEN unsure OR t.verdict = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PASS' END AS verdict"


def _own_rows(client: str, said: str) -> str:
    """CTE `hops` of the balancer's own hops after two that need no check."""
    return f"""hops AS ({said}
  UNION ALL {_acl_rows("path", "-1", 2, "balancer subnet", "in", "subnet", "port", "client", "legs WHERE subnet IS NOT NULL")}
  UNION ALL SELECT path, -1, 4, 'balancer group in from the {client}', NULL, NULL, 'group', "groups", NULL, 'in', port, client, []::VARCHAR[] FROM legs WHERE len("groups") > 0
  UNION ALL SELECT * FROM no_target UNION ALL SELECT * FROM target_hops),
named({_HOP}) AS (SELECT * FROM hops)"""


_INBOUND = _with(
    _LINKS.strip(), _LB.strip(),
    "facing AS (SELECT b.*, s.subnets, coalesce(g.\"groups\", []) AS \"groups\", s.subnets[1] AS subnet FROM balancers b LEFT JOIN lb_subnets s USING (lb) LEFT JOIN lb_groups g USING (lb) WHERE scheme = 'internet-facing')",
    f"gate_asks AS (SELECT b.lb, b.place, b.subnet, '{netpaths.INTERNET}' AS ip FROM facing JOIN balancer_subnets b USING (lb))",
    _routed("gate_asks", "gate_routes"),
    f"gates AS (SELECT lb, string_agg(subnet || ' ' || {_ROUTE_TEXT}, '; ' ORDER BY place) FILTER (kind IS DISTINCT FROM 'igw') AS closed FROM gate_asks JOIN gate_routes USING (subnet, ip) GROUP BY lb)",
    f"legs AS (SELECT row(f.lb, listener, target_group)::VARCHAR AS path, f.lb, listener, target_group, coalesce(l.port, 443)::INT AS port, '{netpaths.INTERNET}' AS client, f.subnet, {_address('n.cidr')} AS lb_ip, \"groups\", f.vpc, account, kind, closed FROM facing f LEFT JOIN listeners l USING (lb) LEFT JOIN gates USING (lb) LEFT JOIN subnets n ON n.subnet = f.subnet)",
    _target_rows(3).strip(),
    _own_rows("internet", f"SELECT path, -1 AS place, 0 AS n, 'faces the internet' AS what, 'PASS' AS verdict, 'internet-facing' AS evidence, {_NO_ASK} FROM legs UNION ALL SELECT path, -1, 1, 'subnets route to an internet gateway', CASE WHEN closed IS NULL THEN 'PASS' ELSE 'FAIL' END, coalesce(closed, ''), {_NO_ASK} FROM legs"),
    _answered("named").strip(), _ROLLED.strip(),
) + f"\nSELECT lb, listener, target_group, port, hops, coalesce(targets, '') AS targets, {_VERDICT} FROM legs l JOIN told t ON t.path = l.path AND t.place = -1 LEFT JOIN rolled r ON r.path = l.path"

_TRANSIT = _with(
    _LINKS.strip(), _LB.strip(),
    f"inside AS (SELECT b.*, coalesce(g.\"groups\", []) AS \"groups\", s.subnets[1] AS subnet, {_address('n.cidr')} AS lb_ip, attachment FROM balancers b JOIN lb_subnets s USING (lb) LEFT JOIN lb_groups g USING (lb) LEFT JOIN subnets n ON n.subnet = s.subnets[1] LEFT JOIN (SELECT vpc, min(attachment) AS attachment FROM attachments GROUP BY vpc) a ON a.vpc = b.vpc WHERE scheme = 'internal')",
    f"calls AS (SELECT i.*, t.rtb, r.cidr AS caller, r.target AS gateway, {_address('r.cidr')} AS client, (SELECT string_agg(transit_table, ', ' ORDER BY transit_table) FROM (SELECT DISTINCT transit_table FROM transit_routes x WHERE x.attachment = i.attachment AND {_holds('x.cidr', 'i.lb_ip')})) AS sent FROM inside i JOIN subnet_tables t USING (subnet) JOIN routes r ON r.rtb = t.rtb AND r.kind = 'tgw')",
    "legs AS (SELECT row(c.lb, caller, listener, target_group)::VARCHAR AS path, c.lb, caller, listener, target_group, coalesce(l.port, 443)::INT AS port, client, subnet, lb_ip, \"groups\", vpc, account, kind, rtb, gateway, sent, attachment FROM calls c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lb ORDER BY listener, target_group) AS nth FROM listeners) l ON l.lb = c.lb AND nth <= 3 WHERE client IS NOT NULL)",
    _target_rows(2).strip(),
    _own_rows("callers", f"SELECT path, -1 AS place, 0 AS n, 'reply route to the callers' AS what, 'PASS' AS verdict, rtb || ': ' || caller || ' -> ' || gateway AS evidence, {_NO_ASK} FROM legs UNION ALL SELECT path, -1, 1, 'transit route to the VPC', CASE WHEN attachment IS NULL THEN 'UNKNOWN' WHEN sent IS NULL THEN 'FAIL' ELSE 'PASS' END, coalesce(sent, attachment, 'no attachment'), {_NO_ASK} FROM legs"),
    _answered("named").strip(), _ROLLED.strip(),
) + f"\nSELECT lb, caller, listener, target_group, port, hops, coalesce(targets, '') AS targets, {_VERDICT} FROM legs l JOIN told t ON t.path = l.path AND t.place = -1 LEFT JOIN rolled r ON r.path = l.path"

_EGRESS = _with(
    _LINKS.strip(),
    f"clusters AS (SELECT cluster, subnet, list(\"group\") AS \"groups\" FROM ({CLUSTERS}) GROUP BY cluster, subnet)",
    f"ways AS (SELECT cluster, subnet, \"groups\", 'internet' AS \"to\", '{netpaths.INTERNET}' AS ip, unnest([443, 80])::INT AS port FROM clusters UNION ALL SELECT DISTINCT cluster, subnet, \"groups\", cidr, {_address('cidr')}, 443 FROM clusters JOIN subnet_tables USING (subnet) JOIN routes USING (rtb) WHERE kind IN ('tgw', 'vgw', 'pcx') AND cidr <> '0.0.0.0/0')",
    "starts AS (SELECT DISTINCT subnet, ip FROM ways WHERE ip IS NOT NULL)",
    "everywhere AS (SELECT s.subnet, a.ip FROM subnets s CROSS JOIN (SELECT DISTINCT ip FROM starts) a)",
    _routed("everywhere", "all_routes"),
    "transit_tables AS (SELECT attachment, min(transit_table) AS rtb FROM attachment_tables GROUP BY attachment)",
    "transit AS (SELECT transit_table AS rtb, cidr, state AS kind, attachment AS target FROM transit_routes)",
    "transit_asks AS (SELECT attachment, ip FROM transit_tables CROSS JOIN (SELECT DISTINCT ip FROM starts) a)",
    _routed("transit_asks", "hops_on", "transit_tables", "transit", "attachment"),
    f"""facts AS (SELECT r.subnet, r.ip, r.kind, r.target, r.rtb, said, nat, n.subnet AS nat_subnet, connectivity, firewall, f.subnet AS fw_subnet, s.vpc, a.attachment, tt, h.cidr AS t_cidr, h.kind AS t_state, h.target AS t_att, x.kind AS n_kind, x.resource, x.subnet AS n_subnet, coalesce(x.vpc, x.resource) AS n_vpc
  FROM (SELECT *, {_ROUTE_TEXT} AS said FROM all_routes) r JOIN subnets s ON s.subnet = r.subnet LEFT JOIN nats n ON nat = r.target LEFT JOIN firewalls f ON endpoint = r.target LEFT JOIN (SELECT vpc, min(attachment) AS attachment FROM attachments GROUP BY vpc) a ON a.vpc = s.vpc
  LEFT JOIN (SELECT attachment, rtb AS tt FROM transit_tables) tt ON tt.attachment = a.attachment LEFT JOIN (SELECT attachment, ip, cidr, kind, target FROM hops_on) h ON h.attachment = a.attachment AND h.ip = r.ip LEFT JOIN attachments x ON x.attachment = h.target)""",
    """moves AS (SELECT subnet, ip, CASE
    WHEN rtb IS NULL THEN {'t': 'route table UNKNOWN ' || subnet, 'v': 1, 'k': NULL, 'x': NULL, 'next': NULL, 'nat': NULL}
    WHEN kind = 'igw' THEN {'t': 'routes to the internet gateway PASS ' || said, 'v': 0, 'k': 'internet gateway', 'x': target, 'next': NULL, 'nat': NULL}
    WHEN kind = 'nat' AND nat IS NULL THEN {'t': 'routes to the NAT gateway UNKNOWN ' || said || ' > NAT gateway known UNKNOWN ' || target, 'v': 1, 'k': 'NAT gateway', 'x': target, 'next': NULL, 'nat': NULL}
    WHEN kind = 'nat' AND connectivity = 'private' THEN {'t': 'routes to the NAT gateway PASS ' || said || ' > private NAT gateway PASS ' || target, 'v': 0, 'k': NULL, 'x': NULL, 'next': nat_subnet, 'nat': NULL}
    WHEN kind = 'nat' THEN {'t': 'routes to the NAT gateway PASS ' || said, 'v': 0, 'k': NULL, 'x': NULL, 'next': nat_subnet, 'nat': nat}
    WHEN kind = 'tgw' AND attachment IS NULL THEN {'t': 'routes to the transit gateway PASS ' || said || ' > attachment of the VPC UNKNOWN ' || vpc, 'v': 1, 'k': 'transit gateway', 'x': target, 'next': NULL, 'nat': NULL}
    WHEN kind = 'tgw' AND tt IS NULL THEN {'t': 'routes to the transit gateway PASS ' || said || ' > transit table of the attachment UNKNOWN ' || attachment, 'v': 1, 'k': 'transit gateway', 'x': target, 'next': NULL, 'nat': NULL}
    WHEN kind = 'tgw' AND (t_cidr IS NULL OR t_state = 'blackhole') THEN {'t': 'routes to the transit gateway PASS ' || said || ' > transit route FAIL ' || tt || ': ' || coalesce(t_cidr || ' blackhole', 'no route'), 'v': 2, 'k': NULL, 'x': NULL, 'next': NULL, 'nat': NULL}
    WHEN kind = 'tgw' THEN {'t': 'routes to the transit gateway PASS ' || said || ' > transit route PASS ' || tt || ': ' || t_cidr || ' -> ' || t_att || CASE WHEN n_kind IS NULL THEN ' > next attachment UNKNOWN ' || t_att WHEN n_kind = 'vpn' THEN ' > leaves through PASS vpn ' || resource WHEN n_subnet IS NULL THEN ' > into the VPC UNKNOWN ' || n_vpc ELSE ' > into the VPC PASS ' || n_vpc || ' ' || t_att END,
      'v': CASE WHEN n_kind = 'vpn' OR n_subnet IS NOT NULL THEN 0 ELSE 1 END, 'k': CASE WHEN n_kind = 'vpn' THEN 'vpn' WHEN n_subnet IS NULL THEN 'transit gateway' END, 'x': CASE WHEN n_kind = 'vpn' THEN resource WHEN n_subnet IS NULL THEN target END, 'next': CASE WHEN n_kind <> 'vpn' THEN n_subnet END, 'nat': NULL}
    WHEN kind = 'vpce' AND firewall IS NULL THEN {'t': 'routes to the endpoint PASS ' || said, 'v': 0, 'k': 'endpoint', 'x': target, 'next': NULL, 'nat': NULL}
    WHEN kind = 'vpce' THEN {'t': 'routes to the firewall PASS ' || said || ' > inspected by the firewall UNKNOWN ' || firewall, 'v': 1, 'k': CASE WHEN fw_subnet IS NULL THEN 'endpoint' END, 'x': CASE WHEN fw_subnet IS NULL THEN target END, 'next': fw_subnet, 'nat': NULL}
    WHEN kind IN ('pcx', 'vgw', 'eni', 'eigw') THEN {'t': 'leaves the VPC PASS ' || said, 'v': 0, 'k': kind, 'x': target, 'next': NULL, 'nat': NULL}
    ELSE {'t': 'route FAIL ' || said, 'v': 2, 'k': NULL, 'x': NULL, 'next': NULL, 'nat': NULL} END AS m FROM facts)""",
    """walk AS (
  SELECT s.subnet AS start, s.subnet AS at, s.ip, 0 AS depth, [s.subnet] AS seen, m.t::VARCHAR AS hops, m.v::INT AS v, m.k::VARCHAR AS k, m.x::VARCHAR AS x, m.next::VARCHAR AS next, m.nat::VARCHAR AS nat FROM starts s JOIN moves USING (subnet, ip)
  UNION ALL
  SELECT start, w.next, w.ip, depth + 1, list_append(seen, w.next), CASE WHEN stop THEN hops || ' > following the route UNKNOWN loops or goes too deep' ELSE hops || ' > ' || m.t END, CASE WHEN stop THEN greatest(v, 1) ELSE greatest(v, m.v) END, CASE WHEN NOT stop THEN m.k END, CASE WHEN NOT stop THEN m.x END, CASE WHEN NOT stop THEN m.next END, CASE WHEN stop THEN nat ELSE coalesce(m.nat, nat) END
  FROM (SELECT *, list_contains(seen, next) OR depth >= 6 AS stop FROM walk WHERE next IS NOT NULL) w JOIN moves mv ON mv.subnet = w.next AND mv.ip = w.ip)""",
    "ended AS (SELECT start AS subnet, ip, hops, v, CASE WHEN k = 'internet gateway' AND nat IS NOT NULL THEN 'NAT gateway' ELSE k END AS exit_kind, CASE WHEN k = 'internet gateway' AND nat IS NOT NULL THEN nat ELSE x END AS exit FROM walk WHERE next IS NULL)",
    "paths AS (SELECT row(cluster, w.subnet, \"to\", port)::VARCHAR AS path, w.* FROM ways w WHERE ip IS NOT NULL)",
    f"hops AS (SELECT path, 0 AS place, 0 AS n, 'node groups out' AS what, NULL AS verdict, NULL AS evidence, 'group' AS kind, \"groups\", NULL AS subnet, 'out' AS direction, port, ip, []::VARCHAR[] AS callers FROM paths UNION ALL {_acl_rows('path', '0', 1, 'node subnet', 'out', 'subnet', 'port', 'ip', 'paths')})",
    f"named({_HOP}) AS (SELECT * FROM hops)",
    _answered("named").strip(),
    recursive=True,
) + """
SELECT cluster, p.subnet, "to", port, t.hops || ' > ' || e.hops AS hops, exit_kind, exit, CASE WHEN exit_kind IS NULL OR t.verdict = 'FAIL' OR v = 2 THEN 'FAIL' WHEN t.verdict = 'UNKNOWN' OR v = 1 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict
FROM paths p JOIN told t USING (path) JOIN ended e ON e.subnet = p.subnet AND e.ip = p.ip"""  # fmt: skip



def _bits(ip: str) -> str:
    """128 characters 0 and 1 of an IPv6 address."""
    side = lambda n: f"list_filter(string_split(split_part({ip}, '::', {n}), ':'), lambda g: g <> '')"
    groups = f"list_concat({side(1)}, list_transform(range(8 - len({side(1)}) - len({side(2)})), lambda i: '0'), {side(2)})"
    return f"array_to_string(list_transform({groups}, lambda g: lpad(bin(CAST('0x' || g AS BIGINT)), 16, '0')), '')"


_MIXED_HOLDS = f"""CASE WHEN contains(ip, ':') <> contains(cidr, ':') THEN false WHEN contains(ip, ':') THEN left({_bits("ip")}, {_length("cidr")}) = left({_bits("split_part(cidr, '/', 1)")}, {_length("cidr")}) ELSE {_holds("cidr", "ip")} END"""

ORACLE = {
    "open_places": _with("web AS (SELECT DISTINCT \"group\" FROM balancers JOIN balancer_groups USING (lb) WHERE scheme = 'internet-facing')") + """
SELECT 'security group open to the internet' || CASE WHEN w."group" IS NOT NULL AND ports IN ('80', '443') THEN ' (internet-facing load balancer)' ELSE '' END AS kind,
  CASE WHEN w."group" IS NOT NULL AND ports IN ('80', '443') THEN 'info' WHEN ports IN ('all', '22', '3389') THEN 'high' ELSE 'medium' END AS severity, r."group" AS place, protocol || '/' || ports || ' from ' || peer AS detail
FROM group_rules r LEFT JOIN web w ON w."group" = r."group" WHERE direction = 'in' AND peer = '0.0.0.0/0' AND r."group" IN (SELECT "group" FROM groups)
UNION ALL SELECT 'network ACL allows everything in', 'low', acl, 'rule ' || number FROM (SELECT * FROM acl_rules WHERE direction = 'in' QUALIFY row_number() OVER (PARTITION BY acl ORDER BY number) = 1) WHERE action = 'allow' AND cidr = '0.0.0.0/0' AND ports = 'all'
UNION ALL SELECT 'cluster endpoint open to the internet', 'high', 'c-' || s_suppkey, 'public access from 0.0.0.0/0' FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 <> 1
UNION ALL SELECT 'instance with a public IP', 'medium', 'i-' || c_custkey, '203.0.113.' || c_custkey % 250 FROM customer WHERE c_acctbal > 9000""",
    "mixed_prefixes": f"SELECT c_custkey, ip, count(*) AS n, arg_max(cidr, {_length('cidr')}) AS cidr, max({_length('cidr')}) AS prefix FROM ({MIXED_IPS}) i JOIN ({MIXED_ROUTES}) r ON {_MIXED_HOLDS} GROUP BY c_custkey, ip",
    "network_links": _with(_LINKS.strip()) + """
SELECT 'subnet table' AS kind, subnet AS source, rtb AS target, how FROM subnet_tables WHERE rtb IS NOT NULL
UNION ALL SELECT 'subnet acl', subnet, acl, 'explicit' FROM subnet_acls UNION ALL SELECT 'vpc attachment', vpc, min(attachment), 'explicit' FROM attachments WHERE vpc IS NOT NULL GROUP BY vpc
UNION ALL SELECT 'attachment table', attachment, min(transit_table), 'explicit' FROM attachment_tables GROUP BY attachment UNION ALL SELECT 'host balancer', lower(rtrim(dns, '.')), lb, 'host name' FROM balancers""",
    "inbound_paths": _INBOUND,
    "transit_paths": _TRANSIT,
    "egress_paths": _EGRESS,
}
