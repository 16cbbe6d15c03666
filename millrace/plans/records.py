"""Records of JSON documents, rules, links and checks, and function families over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cloud, json, values
from ..operators import network, pairing, records
from ..operators.compare import clean_name
from ..sources.tables import table


def _versions(spark, sf):
    """Two versions of every order as JSON: status, tags, flags and lines with ids of their own."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("l"), F.array_sort(F.collect_set("f")).alias("flags"))
    o = table(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    item = lambda x, more: F.struct(F.concat(F.lit("L"), x["l_linenumber"]).alias("id"), (x["q"] + more).alias("quantity"))

    def doc(status, priority, flags, items):
        tags = F.array(F.struct(F.lit("priority").alias("Key"), priority.alias("Value")))
        return o.select(k, json.parse(F.to_json(F.struct(status.alias("status"), tags.alias("Tags"), flags.alias("flags"), items.alias("items")))).alias("j"))

    l, status, priority = F.col("l"), F.col("o_orderstatus"), F.col("o_orderpriority")
    before = doc(status, priority, F.col("flags"), F.transform(l, lambda x: item(x, F.lit(0))))
    kept = F.filter(l, lambda x: (k % 5 > 0) | (x["l_linenumber"] != 2))
    after = doc(
        F.when(k % 3 == 0, "X").otherwise(status), F.when(k % 4 == 0, "none").otherwise(priority), F.array_except("flags", F.array(F.lit("A"))),
        F.transform(kept, lambda x: item(x, F.when((x["l_linenumber"] == 1) & (k % 2 == 0), 1).otherwise(0))),
    )
    return before, after


def record_diff(spark, sf):
    before, after = _versions(spark, sf)
    return records.record_diff(before, after, ["o_orderkey"], "j")


def node_children(spark, sf):
    before, _ = _versions(spark, sf)
    return records.children(before, ["o_orderkey"], "j", "$.items", 1, 2).drop("pos")


def _part_records(spark, sf):
    k, text = F.col("p_partkey"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    s = k.cast("string")
    forms = F.element_at(
        F.array(
            text('{"InstanceId": "i-', s, '", "InstanceType": "m", "VpcId": "v"}'), text('{"Name": "b', s, '", "CreationDate": "2024"}'), text('{"apiVersion": "v1", "kind": "Pod", "metadata": {"namespace": "n", "name": "p', s, '"}}'),
            text('{"VpcId": "vpc-', s, '", "CidrBlock": "10.0.0.0/16", "Tags": [{"Key": "Owner", "Value": "', F.col("p_brand"), '"}]}'), text('{"terraform_version": "1", "values": {}}'), text('{"id": "/subscriptions/', s, '", "name": "z"}'), text('{"arn": "arn:aws:s3:::', s, '"}'), F.lit("[1]"),
        ), (k % 8 + 1).cast("int"),
    )
    return table(spark, sf, "part").select("p_partkey", json.parse(forms).alias("j"))


def record_keys(spark, sf):
    return _part_records(spark, sf).select("p_partkey", cloud.record_key("j").alias("r")).select("p_partkey", F.col("r.key").alias("key"), F.col("r.id").alias("id"))


def record_majority(spark, sf):
    return records.majority_key(_part_records(spark, sf), "j")


def document_sources(spark, sf):
    j = F.col("j")
    return _part_records(spark, sf).groupBy(cloud.detect_source(j).alias("source"), cloud.table_template(j).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def pseudo_cells(spark, sf):
    j, k = F.col("j"), F.col("p_partkey")
    return _part_records(spark, sf).select(k, cloud.cell(j, "@key", k).alias("key"), cloud.cell(j, "@tag:Owner").alias("owner"), cloud.cell(j, "@name").alias("name"), cloud.cell(j, "VpcId").alias("vpc"), cloud.cell(j, "@parent", parent=k % 8).alias("parent"))


def _inventory(spark, sf):
    """Nations as networks, suppliers as clusters in them, parts as node groups of the clusters."""
    row = lambda df, kind, id_, **f: df.select(F.lit("env").alias("label"), F.lit(kind).alias("type"), id_.alias("rid"), json.parse(F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))).alias("j"))
    tags = lambda c: F.array(F.struct(F.lit("Name").alias("Key"), c.alias("Value")))
    vpc = lambda c: F.concat(F.lit("vpc-"), F.lpad(c.cast("string"), 8, "0"))
    cluster = lambda c: F.concat(F.lit("c-"), F.lpad(c.cast("string"), 8, "0"))
    n, s, p = (table(spark, sf, t) for t in ("nation", "supplier", "part"))
    nets = row(n, "vpc", vpc(F.col("n_nationkey")), Tags=tags(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name"))), IsDefault=F.col("n_nationkey") == 5)
    clusters = row(s, "cluster", cluster(F.col("s_suppkey")), name=F.when(F.col("s_suppkey") % 7 > 0, F.col("s_name")), VpcId=vpc(F.col("s_nationkey")))
    groups = row(p, "group", F.concat(F.lit("g-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")), GroupName=F.col("p_name"), _parent_id=cluster(F.col("p_size")))
    return nets.union(clusters).union(groups)


def descriptions(spark, sf):
    out = records.describe(_inventory(spark, sf), "rid", "j", ["label", "type"])
    return out.select("type", "id", "name", "default", "vpc", "parent", F.array_join("own", ",").alias("own"))


def identity_paths(spark, sf):
    entries = records.describe(_inventory(spark, sf), "rid", "j", ["label", "type"])
    return records.identities(entries, {"group": "cluster"}).select("type", "id", "identity")


#: What pairs the unnamed records of each type (2.17); `loop` names its like.
PAIR_BY = {
    "ec2/vpcs": ["default"], "ec2/subnets": ["cidr_in_vpc"], "ec2/route_tables": ["main", "ref:Associations.SubnetId"],
    "ec2/network_interfaces": ["InterfaceType", "Description", "ref:SubnetId", "ref:Attachment.InstanceId"], "ec2/internet_gateways": ["=internet-gateway"], "loop": ["Kind", "ref:Other.Id"],
}
#: Records as JSON text, in SQL that Spark reads: nations are VPCs, suppliers subnets, parts route tables, customers interfaces, nations once more flow logs in loops.
PAIRED = """
    SELECT 'ec2/vpcs' AS type, 'vpc-' || lpad(n_nationkey, 8, '0') AS rid, '{"Tags": [{"Key": "Name", "Value": "' || CASE WHEN n_nationkey % 3 > 0 THEN n_name || '-Dev' ELSE '' END || '"}], "IsDefault": ' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "CidrBlock": "10.' || n_nationkey || '.0.0/16"}' AS text FROM {nation}
    UNION ALL SELECT 'ec2/subnets', 'subnet-' || lpad(s_suppkey, 8, '0'), '{"VpcId": "vpc-' || lpad(s_nationkey, 8, '0') || '", "CidrBlock": "10.' || CASE WHEN s_acctbal < 0 THEN 77 ELSE s_nationkey END || '.' || (s_suppkey % 256) || '.0/24"}' FROM {supplier}
    UNION ALL SELECT 'ec2/route_tables', 'rtb-' || lpad(p_partkey, 8, '0'), '{"VpcId": "vpc-' || lpad(p_partkey % 27, 8, '0') || '", "Associations": [{"Main": ' || CASE WHEN p_size < 10 THEN 'true' ELSE 'false' END || '}, {"SubnetId": "subnet-' || lpad(1 + p_partkey % (SELECT count(*) FROM {supplier}), 8, '0') || '"}, {"SubnetId": "subnet-' || lpad(p_size, 8, '0') || '"}]}' FROM {part}
    UNION ALL SELECT 'ec2/network_interfaces', 'eni-' || lpad(c_custkey, 8, '0'), '{"InterfaceType": "Interface", "Description": "' || c_mktsegment || ' dev i-00000000' || lpad(c_nationkey, 2, '0') || ' 0123456789abcdef", "SubnetId": "subnet-' || lpad(1 + c_custkey % 60, 8, '0') || '", "Attachment": {"InstanceId": "i-' || lpad(c_custkey, 8, '0') || '"}, "Nested": {"Deep": [{"vpcId": "vpc-' || lpad(c_nationkey, 8, '0') || '"}]}}' FROM {customer}
    UNION ALL SELECT 'loop', 'fl-' || lpad(n_nationkey, 8, '0'), '{"Kind": "ALL", "Other": [{"Id": "' || CASE WHEN n_nationkey % 4 = 1 THEN 'fl-' || lpad(n_nationkey + 2, 8, '0') WHEN n_nationkey % 4 = 3 THEN 'fl-' || lpad(n_nationkey - 2, 8, '0') WHEN n_nationkey % 4 = 2 THEN 'fl-' || lpad(1, 8, '0') ELSE 'vpc-' || lpad(n_nationkey, 8, '0') END || '"}]}' FROM {nation}"""


def pair_by_identities(spark, sf):
    """Records without names, paired by what they are attached to; cleaned of the word `dev`."""
    sql = PAIRED.replace("{", "{{").replace("}", "}}")
    for t in ("nation", "supplier", "part", "customer"):
        sql = sql.replace(f"{{{{{t}}}}}", f"{{{t}}}")
    rows = spark.sql(sql, **{t: table(spark, sf, t) for t in ("nation", "supplier", "part", "customer")}).select(F.lit("env").alias("label"), "type", "rid", json.parse("text").alias("j"))
    parts = pairing.rule_parts(F.col("type"), F.col("j"), PAIR_BY)
    entries = records.describe(rows.withColumn("parts", parts), "rid", "j", ["label", "type", "parts"], vpc_types=("ec2/vpcs",))
    return pairing.paired_identities(entries, {}, clean=lambda c: clean_name(c, ["dev"])).select("type", "id", "identity")


def acl_rows(spark, sf):
    entry = F.struct(
        F.col("p_size").alias("number"), (F.col("p_partkey") % 2 == 0).alias("egress"), F.when(F.col("p_partkey") % 3 == 0, "deny").otherwise("allow").alias("action"),
        F.when(F.col("p_partkey") % 5 == 0, "-1").otherwise("6").alias("protocol"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("from_port"), (F.col("p_size") + F.col("p_partkey") % 2).alias("to_port"),
        F.when(F.col("p_partkey") % 7 > 0, "10.0.0.0/8").alias("cidr"), F.lit("::/0").alias("cidr6"),
    )
    acls = table(spark, sf, "part").groupBy("p_partkey", F.col("p_brand").alias("brand")).agg(F.collect_list(entry).alias("entries"))
    merged = acls.select((F.col("p_partkey") % 50).alias("acl"), F.explode("entries").alias("e")).groupBy("acl", F.col("e.number").alias("n"), F.col("e.egress").alias("g")).agg(F.min_by("e", F.struct("e.action", "e.protocol", "e.from_port", "e.to_port", "e.cidr")).alias("e"))
    return network.acl_rules(merged.groupBy("acl").agg(F.collect_list("e").alias("entries")), "acl", "entries").drop("number")


def vendor_rules(spark, sf):
    k = F.col("p_partkey")
    cidr = F.when(k % 4 == 0, "0.0.0.0/0").otherwise("10.0.0.0/8")
    text = F.concat(F.lit('{"IpPermissions": [{"IpProtocol": "tcp", "FromPort": '), F.col("p_size").cast("string"), F.lit(', "ToPort": 60, "IpRanges": [{"CidrIp": "'), cidr, F.lit('"}], "UserIdGroupPairs": [{"GroupId": "sg-1", "GroupName": "web"}]}], "IpPermissionsEgress": [{"IpProtocol": "-1"}]}'))
    other = F.concat(F.lit('{"securityRules": [{"name": "late", "priority": 200, "protocol": "*", "sourceAddressPrefix": "Internet", "access": "Deny"}, {"name": "soon", "properties": {"priority": 100, "protocol": "Tcp", "destinationPortRange": "'), F.col("p_size").cast("string"), F.lit('", "sourceAddressPrefix": "*", "direction": "Inbound"}}]}'))
    docs = table(spark, sf, "part").select("p_partkey", json.parse(F.when(k % 2 == 0, text).otherwise(other)).alias("j"))
    return network.rule_rows(docs, "p_partkey", "j")


def resource_links(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"), F.sort_array(F.collect_set("l_partkey")).alias("p"))
    ids = lambda c: F.transform(c, lambda x: F.struct(x.cast("string").alias("id")))
    net = F.struct(ids("s").alias("security_groups"), ids("p").alias("subnets"))
    docs = items.select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, "ec2/vpcs").otherwise("ec2/instances").alias("type"), json.parse(F.to_json(F.struct(net.alias("_network"), F.concat(F.lit("vpc-"), (F.col("l_orderkey") % 9).cast("string")).alias("VpcId")))).alias("j"))
    return network.resource_links(docs, "l_orderkey", "type", "j")


def dns_rows(spark, sf):
    c = table(spark, sf, "customer")
    record = F.struct(F.col("c_name").alias("Name"), F.lit("A").alias("Type"), F.when(F.col("c_custkey") % 2 == 0, 60).alias("TTL"), F.array(F.struct(F.col("c_mktsegment").alias("Value"))).alias("ResourceRecords"), F.struct(F.when(F.col("c_custkey") % 2 > 0, "lb.example").alias("DNSName")).alias("AliasTarget"), F.struct(F.when(F.col("c_acctbal") > 0, "ok").otherwise("NXDOMAIN").alias("status")).alias("_lookup"))
    zones = c.groupBy("c_nationkey").agg(F.collect_list(record).alias("Records"))
    docs = zones.select("c_nationkey", json.parse(F.to_json(F.struct(F.concat(F.lit("z"), "c_nationkey").alias("Name"), F.struct((F.col("c_nationkey") % 2 == 0).alias("PrivateZone")).alias("Config"), F.struct("Records").alias("_details")))).alias("j"))
    return network.dns_records(docs, "c_nationkey", "j").withColumns({"values": F.array_join("values", ","), "addresses": F.size("addresses")})


def transit_neighbours(spark, sf):
    i = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("table"), F.col("l_partkey").alias("att"), "l_returnflag")
    pick = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("att")))
    tables = i.groupBy("table").agg(pick("A").alias("associations"), pick("N").alias("propagations"), pick("R").alias("targets"))
    own = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("attachment"))
    return network.next_attachments(tables, own).groupBy("table", "why").agg(F.count(F.lit(1)).alias("n"), F.sum("attachment").alias("total"))


def endpoint_reach(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    clusters = s.select(F.col("s_suppkey").alias("cluster"), F.col("s_nationkey").alias("vpc"), F.array(F.col("s_suppkey") % 6).alias("subnets"), F.concat(F.lit("10."), (F.col("s_suppkey") % 8).cast("string"), F.lit(".0.9")).alias("ip"))
    k = F.col("p_partkey")
    endpoints = p.select(k.alias("endpoint"), (k % 25).cast("int").alias("vpc"), F.lit("com.amazonaws.eu-west-1.s3").alias("service"), F.when(k % 2 == 0, "Gateway").otherwise("Interface").alias("type"), F.array(k % 5).alias("route_tables"), F.array(k % 7).alias("groups"))
    routes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("subnet"), F.col("r_regionkey").cast("long").alias("table"))
    rules = table(spark, sf, "nation").where("n_nationkey < 6").select(F.col("n_nationkey").cast("long").alias("group"), F.when(F.col("n_nationkey") % 2 == 0, "443").otherwise("80").alias("ports"), F.lit("tcp").alias("protocol"), F.lit("cidr").alias("peer_type"), F.concat(F.lit("10."), "n_nationkey", F.lit(".0.0/16")).alias("peer"))
    return network.endpoint_counts(clusters, endpoints, routes, rules)


def type_names(spark, sf):
    ours = table(spark, sf, "part").select(F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("s")).alias("ours"))
    theirs = table(spark, sf, "part").select(F.element_at(F.split("p_name", " "), -1).alias("theirs"))
    return records.type_matches(ours, theirs)


def _changes(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), (F.col("o_custkey") % 10).alias("account"), F.lit("eu").alias("region"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "added").otherwise("modified").alias("action"))


def change_fields(spark, sf):
    changes = _changes(spark, sf)
    diffs = changes.where("action = 'modified'").join(table(spark, sf, "lineitem"), F.col("id") == F.col("l_orderkey")).select("run", "account", "region", "type", "id", F.lit("changed").alias("op"), F.concat(F.lit("lines."), "l_linenumber").alias("path"), F.col("l_quantity").alias("old"), F.col("l_extendedprice").alias("new"))
    return records.change_fields(changes, diffs).drop("region")


def runs_known(spark, sf):
    changes = _changes(spark, sf)
    runs = changes.where("month(to_date(run || '-01')) > 3").groupBy("run").agg(F.count(F.lit(1)).alias("changed"))
    return records.runs_with_changes(runs, changes)


def previous_texts(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("page_id"), F.length("text").alias("version"), "text", F.when(F.col("doc_id") % 5 == 0, "timeout").alias("error"))
    out = records.previous_text(d.select(F.col("doc_id").alias("page_id")), stored)
    return out.select("page_id", "previous_version", F.sha2("previous_text", 256).alias("previous_sha256"))


def library_stats(spark, sf):
    e = table(spark, sf, "events")
    docs = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("opens"))
    return records.library_stats(docs, "opens", e.where("value > 90"), {"repos": table(spark, sf, "nation"), "projects": table(spark, sf, "region")})


def function_maps(spark, sf):
    """Maps: keys, values, merge, entries, with_entries (§2.16)."""
    m = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q")).groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "q")))).alias("m"))
    one = F.create_map(F.lit(1), F.lit(-1.0))
    merged, shifted = values.merge(F.col("m"), one), values.with_entries(F.col("m"), lambda e: F.struct((e["key"] + 10).alias("key"), (e["value"] * 2).alias("value")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return m.select("l_orderkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("ks"), total(F.map_values("m")).alias("vs"), total(F.map_values(merged)).alias("merged"), F.array_min(F.map_keys(shifted)).alias("least_key"), total(F.map_values(shifted)).alias("doubled"))


def function_order(spark, sf):
    """Order: sort_by, min_by, max_by, nth, first, last, limit, until, transpose, combinations (§2.16)."""
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("a"))
    lines, q = lambda c: F.array_join(F.transform(c, lambda x: x["l_linenumber"].cast("string")), ","), lambda x: x["q"]
    c = F.col("a")
    quantities = F.transform(c, q)
    pairs = values.combinations(F.array(quantities, F.array(F.lit(1.0), F.lit(2.0))))
    return a.select(
        "l_orderkey", lines(values.sort_by(c, q)).alias("sorted"), values.min_by(c, q)["l_linenumber"].alias("least"), values.max_by(c, q)["l_linenumber"].alias("most"), values.nth(c, 1)["l_linenumber"].alias("second"), values.nth(c, -1)["l_linenumber"].alias("last"),
        lines(values.limit(c, 2)).alias("two"), lines(values.until(c, lambda x: x["q"] > 30)).alias("before"), F.size(values.transpose(F.array(quantities, F.array(F.lit(0.0))))).alias("wide"), F.size(pairs).alias("pairs"), F.aggregate(F.flatten(pairs), F.lit(0.0), lambda x, y: x + y).alias("pair_total"),
    )


def function_paths(spark, sf):
    """JSON: selectors, set, delete and update of members, alternative and not_null (§2.16)."""
    e = table(spark, sf, "events").select("event_id", json.parse("props").alias("j"), F.col("event_id").alias("n"))
    k = lambda v: F.try_variant_get(v, "$.k", "long")
    j = F.col("j")
    mixed = F.try_variant_get(json.parse(F.concat(F.lit('[1, "a", null, {}, [], true, '), F.col("n").cast("string"), F.lit("]"))), "$", "array<variant>")
    up = values.update_member(j, "k", lambda v: json.parse((F.try_variant_get(v, "$", "long") + 1).cast("string")))
    put = values.set_member(j, "m", json.parse(F.col("n").cast("string")))
    return e.select(
        "event_id", F.size(values.select_type(mixed, "number")).alias("numbers"), F.size(values.select_type(mixed, "object", "array")).alias("iterables"), k(up).alias("raised"), F.try_variant_get(put, "$.m", "long").alias("put"), k(put).alias("kept"), F.to_json(values.delete_members(put, "k")).alias("cut"),
        values.alternative(F.col("n") % 2 == 0, F.lit(None).cast("boolean")).alias("even"), values.not_null(F.when(F.col("n") % 3 == 0, F.col("n")), F.lit(-1).cast("long")).alias("third"),
    )


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__}

LINES = "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INT) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2"
FORM = "p_partkey % 8"
INVENTORY = """nets AS (SELECT 'vpc-' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS id, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS name, n_nationkey = 5 AS d FROM nation),
  clusters AS (SELECT 'c-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name, 'vpc-' || lpad(CAST(s_nationkey AS VARCHAR), 8, '0') AS vpc FROM supplier),
  parts AS (SELECT 'g-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_name AS name, 'c-' || lpad(CAST(p_size AS VARCHAR), 8, '0') AS parent FROM part)"""
ITEMS = "(SELECT l_orderkey, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
MEMBERS = """m AS (SELECT DISTINCT l_suppkey % 40 AS t, l_partkey AS a, l_returnflag AS f FROM lineitem), own AS (SELECT p_partkey AS a FROM part WHERE p_size = 1),
  has AS (SELECT DISTINCT t, f FROM m WHERE a IN (SELECT a FROM own))"""
ORACLE = {
    "record_diff": f"""WITH l AS ({LINES}), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l))
      SELECT o_orderkey, 'status' AS path, o_orderstatus AS "old", 'X' AS "new" FROM o WHERE o_orderkey % 3 = 0
      UNION ALL SELECT o_orderkey, 'Tags.priority', o_orderpriority, 'none' FROM o WHERE o_orderkey % 4 = 0
      UNION ALL SELECT DISTINCT l_orderkey, 'flags[-]', 'A', '' FROM l WHERE f = 'A'
      UNION ALL SELECT l_orderkey, 'items[-]', 'L2', '' FROM l WHERE l_linenumber = 2 AND l_orderkey % 5 = 0
      UNION ALL SELECT l_orderkey, 'items[L1].quantity', CAST(q AS VARCHAR), CAST(q + 1 AS VARCHAR) FROM l WHERE l_linenumber = 1 AND l_orderkey % 2 = 0""",
    "node_children": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS c FROM ({LINES}))
      SELECT l_orderkey AS o_orderkey, CAST(i AS VARCHAR) AS key, 'object' AS type, '{{"id":"L' || l_linenumber || '","quantity":' || q || '}}' AS preview, CAST(2 AS INT) AS count, CAST(c AS INT) AS total FROM l WHERE i IN (1, 2)""",
    "record_keys": f"""SELECT p_partkey, ['InstanceId', 'Name', 'metadata.name', 'VpcId', NULL, 'id', 'arn', NULL][{FORM} + 1] AS key,
      ['i-' || p_partkey, 'b' || p_partkey, 'n/p' || p_partkey, 'vpc-' || p_partkey, NULL, '/subscriptions/' || p_partkey, 'arn:aws:s3:::' || p_partkey, NULL][{FORM} + 1] AS id FROM part""",
    "record_majority": f"SELECT ['InstanceId', 'Name', 'metadata.name', 'VpcId', NULL, 'id', 'arn', NULL][{FORM} + 1] AS id_key, count(*) AS n FROM part WHERE {FORM} NOT IN (4, 7) GROUP BY 1 ORDER BY n DESC, id_key LIMIT 1",
    "document_sources": f"""SELECT ['aws', 'aws', 'kubectl', 'aws', 'terraform', 'azure', 'aws', 'unknown'][{FORM} + 1] AS source,
      ['EC2 instances', NULL, 'Kubernetes objects', 'VPCs', NULL, 'Azure resources', NULL, NULL][{FORM} + 1] AS template, count(*) AS n FROM part GROUP BY 1, 2""",
    "pseudo_cells": f"""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, CASE WHEN {FORM} = 3 THEN p_brand ELSE '' END AS owner,
      ['i-' || p_partkey, 'b' || p_partkey, 'p' || p_partkey, 'vpc-' || p_partkey, '', 'z', '', ''][{FORM} + 1] AS name, CASE {FORM} WHEN 0 THEN 'v' WHEN 3 THEN 'vpc-' || p_partkey ELSE '' END AS vpc, CAST({FORM} AS VARCHAR) AS parent FROM part""",
    "descriptions": f"""WITH {INVENTORY} SELECT 'vpc' AS type, id, name, d AS "default", NULL AS vpc, NULL AS parent, id AS own FROM nets UNION ALL SELECT 'cluster', id, name, false, vpc, NULL, id FROM clusters UNION ALL SELECT 'group', id, name, false, NULL, parent, id FROM parts""",
    "identity_paths": f"""WITH {INVENTORY}, n AS (SELECT id, coalesce(lower(name), CASE WHEN d THEN 'default' END) AS i FROM nets),
      c AS (SELECT c.id, coalesce(n.i, 'vpc?') || '/' || lower(c.name) AS i FROM clusters c LEFT JOIN n ON n.id = c.vpc)
      SELECT 'vpc' AS type, id, i AS identity FROM n UNION ALL SELECT 'cluster', id, i FROM c UNION ALL SELECT 'group', p.id, c.i || '/' || lower(p.name) FROM parts p LEFT JOIN c ON c.id = p.parent""",
    "pair_by_identities": """WITH v AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) || '-<env>' WHEN n_nationkey % 2 = 0 THEN 'default' END AS i FROM nation),
      s AS (SELECT s_suppkey AS s, coalesce(i, 'vpc?') || '/' || CASE WHEN s_acctbal < 0 THEN 'outside-vpc' ELSE 'block1+' || (s_suppkey % 256) * 256 || '/24' END AS i FROM supplier LEFT JOIN v ON n = s_nationkey),
      r AS (SELECT p_partkey AS p, coalesce(v.i, 'vpc?') || '/' || CASE WHEN p_size < 10 THEN 'main|' ELSE '' END || array_to_string(list_sort([coalesce(a.i, '?'), coalesce(b.i, '?')]), '+') AS i FROM part LEFT JOIN v ON n = p_partkey % 27 LEFT JOIN s a ON a.s = 1 + p_partkey % (SELECT count(*) FROM supplier) LEFT JOIN s b ON b.s = p_size),
      e AS (SELECT c_custkey AS c, coalesce(v.i, 'vpc?') || '/interface|' || lower(c_mktsegment) || ' <env> * *|' || coalesce(s.i, '?') || '|?' AS i FROM customer LEFT JOIN v ON n = c_nationkey LEFT JOIN s ON s = 1 + c_custkey % 60)
      SELECT 'ec2/vpcs' AS type, 'vpc-' || lpad(n::VARCHAR, 8, '0') AS id, i AS identity FROM v UNION ALL SELECT 'ec2/subnets', 'subnet-' || lpad(s::VARCHAR, 8, '0'), i FROM s UNION ALL SELECT 'ec2/route_tables', 'rtb-' || lpad(p::VARCHAR, 8, '0'), i FROM r
      UNION ALL SELECT 'ec2/network_interfaces', 'eni-' || lpad(c::VARCHAR, 8, '0'), i FROM e
      UNION ALL SELECT 'loop', 'fl-' || lpad(n::VARCHAR, 8, '0'), 'all|' || CASE n % 4 WHEN 0 THEN coalesce(i, '?') WHEN 2 THEN 'all|?' ELSE '?' END FROM v""",
    "acl_rows": """WITH e AS (SELECT p_partkey % 50 AS acl, p_size AS number, CASE WHEN p_partkey % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE WHEN p_partkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS action, CASE WHEN p_partkey % 5 = 0 THEN 'all' ELSE '6' END AS protocol, CASE WHEN p_partkey % 5 = 0 THEN '-1' ELSE '6' END AS raw,
        CASE WHEN p_partkey % 4 > 0 THEN p_size END AS f, p_size + p_partkey % 2 AS t, CASE WHEN p_partkey % 7 > 0 THEN '10.0.0.0/8' END AS c FROM part),
      x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY acl, number, direction ORDER BY action, raw, f NULLS FIRST, t, c NULLS FIRST) = 1)
      SELECT acl, direction, CAST(row_number() OVER (PARTITION BY acl, direction ORDER BY number) AS INT) AS place, action, protocol, CASE WHEN f IS NULL THEN 'all' WHEN f = t THEN CAST(f AS VARCHAR) ELSE f || '-' || t END AS ports, coalesce(c, '::/0') AS cidr FROM x""",
    "vendor_rules": """WITH p AS (SELECT p_partkey AS id, p_size, CASE WHEN p_partkey % 4 = 0 THEN '0.0.0.0/0' ELSE '10.0.0.0/8' END AS cidr, CASE WHEN p_size = 60 THEN '60' ELSE p_size || '–60' END AS ports FROM part)
      SELECT id, 'Inbound' AS direction, CAST(1 AS INT) AS place, 'Allow' AS access, 'TCP' AS protocol, ports, cidr AS source, '' AS description, cidr LIKE '0%' AS open FROM p WHERE id % 2 = 0
      UNION ALL SELECT id, 'Inbound', 2, 'Allow', 'TCP', ports, 'sg-1 (web)', '', false FROM p WHERE id % 2 = 0
      UNION ALL SELECT id, 'Outbound', 1, 'Allow', 'All', 'All', '—', '', false FROM p WHERE id % 2 = 0
      UNION ALL SELECT id, 'Inbound', 1, 'Allow', 'TCP', CAST(p_size AS VARCHAR), '*', 'soon · priority 100', true FROM p WHERE id % 2 = 1
      UNION ALL SELECT id, 'Inbound', 2, 'Deny', '*', 'All', 'Internet', 'late · priority 200', false FROM p WHERE id % 2 = 1""",
    "resource_links": """SELECT DISTINCT l_orderkey AS id, 'security_group' AS kind, CAST(l_suppkey AS VARCHAR) AS target FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'subnet', CAST(l_partkey AS VARCHAR) FROM lineitem
      UNION ALL SELECT DISTINCT l_orderkey, 'vpc', 'vpc-' || l_orderkey % 9 FROM lineitem WHERE l_orderkey % 3 > 0""",
    "dns_rows": """SELECT c_nationkey AS id, 'z' || c_nationkey AS zone, c_nationkey % 2 = 0 AS private, c_name AS name, 'A' AS type, CAST(CASE WHEN c_custkey % 2 = 0 THEN 60 END AS INT) AS ttl, c_mktsegment AS values, CASE WHEN c_custkey % 2 > 0 THEN 'lb.example' END AS alias, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'NXDOMAIN' END AS status, CAST(0 AS INT) AS addresses FROM customer""",
    "transit_neighbours": f"""WITH {MEMBERS}, r AS (SELECT t, 'sent to' AS why, a FROM m WHERE f = 'R' AND t IN (SELECT t FROM has WHERE f = 'A') AND a NOT IN (SELECT a FROM own)
        UNION ALL SELECT t, 'caller', a FROM m WHERE f = 'A' AND t IN (SELECT t FROM has WHERE f = 'R') AND a NOT IN (SELECT a FROM own))
      SELECT t AS "table", why, count(*) AS n, CAST(sum(a) AS BIGINT) AS total FROM r GROUP BY 1, 2""",
    "endpoint_reach": """WITH m AS (SELECT s_suppkey AS s, p_partkey AS p FROM supplier JOIN part ON s_nationkey = p_partkey % 25),
      v AS (SELECT p, CASE WHEN p % 2 = 0 THEN 'Gateway' ELSE 'Interface' END AS type, CASE WHEN p % 2 = 0 THEN CASE WHEN s % 6 = p % 5 THEN 'PASS' ELSE 'FAIL' END WHEN p % 7 > 5 THEN 'UNKNOWN' WHEN p % 7 % 2 = 0 AND s % 8 = p % 7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m)
      SELECT 's3' AS service, type, verdict, count(*) AS n, CAST(sum(p) AS BIGINT) AS total FROM v GROUP BY ALL""",
    "type_names": """WITH o AS (SELECT DISTINCT replace(p_name, ' ', '_') || 's' AS ours FROM part), t AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS theirs FROM part),
      n AS (SELECT ours, regexp_replace(lower(ours), '[^a-z0-9]', '', 'g') AS n FROM o), f AS (SELECT ours, unnest([n, n[:-2], CASE WHEN n LIKE '%es' THEN n[:-3] END, CASE WHEN n LIKE '%ies' THEN n[:-4] || 'y' END]) AS f FROM n)
      SELECT DISTINCT ours, theirs FROM f, (SELECT theirs, regexp_replace(lower(theirs), '[^a-z0-9]', '', 'g') AS x FROM t) WHERE f <> '' AND x <> '' AND (ends_with(f, x) OR ends_with(x, f))""",
    "change_fields": """SELECT strftime(o_orderdate, '%Y-%m') AS run, o_custkey % 10 AS account, o_orderpriority AS type, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'added' ELSE 'modified' END AS action, CASE WHEN l_orderkey IS NOT NULL THEN 'changed' END AS op, 'lines.' || l_linenumber AS path, l_quantity AS "old", l_extendedprice AS "new"
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderstatus <> 'O'""",
    "runs_known": "SELECT strftime(o_orderdate, '%Y-%m') AS run, CASE WHEN min(month(o_orderdate)) > 3 THEN count(*) END AS changed FROM orders GROUP BY 1",
    "previous_texts": "SELECT doc_id AS page_id, CAST(CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN length(text) END AS INT) AS previous_version, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN sha256(text) END AS previous_sha256 FROM documents",
    "library_stats": "SELECT count(DISTINCT user_id) AS documents, count(*) AS opens, count(*) FILTER (value > 90) AS failed, (SELECT count(*) FROM nation) AS repos, (SELECT count(*) FROM region) AS projects FROM events",
    "function_maps": f"SELECT l_orderkey, string_agg(n, ',' ORDER BY n) AS ks, sum(q) AS vs, CAST(coalesce(sum(q) FILTER (n <> 1), 0) - 1 AS DOUBLE) AS merged, min(n) + 10 AS least_key, sum(q) * 2 AS doubled FROM {ITEMS} GROUP BY 1",
    "function_order": f"""WITH g AS (SELECT l_orderkey, list(n ORDER BY n) AS l, list(q ORDER BY n) AS k, string_agg(n, ',' ORDER BY q, n) AS sorted, arg_min(n, (q, n)) AS least, arg_max(n, (q, -n)) AS most, max(n) AS last, count(*) AS c, sum(q) AS total, min(n) FILTER (q > 30) AS stop FROM {ITEMS} GROUP BY 1)
      SELECT l_orderkey, sorted, least, most, l[2] AS second, last, array_to_string(l[1:2], ',') AS two, array_to_string(list_filter(l, lambda x: stop IS NULL OR x < stop), ',') AS before, CAST(c AS INT) AS wide, CAST(2 * c AS INT) AS pairs, 2 * total + 3.0 * c AS pair_total FROM g""",
    "function_paths": """SELECT event_id, CAST(2 AS INT) AS numbers, CAST(2 AS INT) AS iterables, k + 1 AS raised, event_id AS put, k AS kept, '{"m":' || event_id || '}' AS cut, CASE WHEN event_id % 2 = 0 THEN true END AS even, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS third
      FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
}
