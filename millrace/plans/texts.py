"""Leaves of nested documents as text, inventory filters, kinds of routes, custom secret rules, the order of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, json, secrets
from ..operators import network, search
from ..sources.documents import leaves
from ..sources.tables import table


def _documents(spark, sf):
    """(o_orderkey, j): {"a": status, "b": {"c": priority, "d": [key, customer]}}."""
    o = table(spark, sf, "orders")
    inner = F.struct(F.col("o_orderpriority").alias("c"), F.array("o_orderkey", "o_custkey").alias("d"))
    return o.select("o_orderkey", json.parse(F.to_json(F.struct(F.col("o_orderstatus").alias("a"), inner.alias("b")))).alias("j"))


def leaf_texts(spark, sf):
    """Every order's leaves, one a line."""
    out = search.search_long_text(leaves(_documents(spark, sf), ["o_orderkey"], "j"), ["o_orderkey"])
    return out.select("o_orderkey", F.sha2("text", 256).alias("digest"))


def leaf_matches(spark, sf):
    """Where orders hold a word: at most two leaves each."""
    return search.matched_paths(leaves(_documents(spark, sf), ["o_orderkey"], "j"), ["o_orderkey"], ["urgent", "77"], k=2, width=6)


def inventory_rows(spark, sf):
    """Suppliers as an inventory: an account by number and by profile, a kind as service and as type, in a region."""
    s = table(spark, sf, "supplier")
    rows = s.select(
        "s_suppkey", F.concat(F.lit("team-"), (F.col("s_suppkey") % 7).cast("string")).alias("profile"), F.lpad((F.col("s_suppkey") % 5).cast("string"), 12, "1").alias("account"),
        F.concat(F.element_at(F.array(F.lit("ec2/"), F.lit("rds/")), (F.col("s_suppkey") % 2 + 1).cast("int")), (F.col("s_nationkey") % 3).cast("string")).alias("type"),
        F.element_at(F.array(F.lit("ec2"), F.lit("rds")), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("service"), F.when(F.col("s_nationkey") > 4, F.concat(F.lit("r"), (F.col("s_nationkey") % 2).cast("string"))).alias("region"),
    )
    asked = {"number": ("1111-1111-1113", None, None), "profile": ("team-3", "rds", "r1"), "type": (None, "ec2/2", None), "all": (None, None, None), "none": ("team-x", None, None)}
    return rows.select("s_suppkey", *[filters.inventory_filter(*a).alias(k) for k, a in asked.items()])


def route_kinds(spark, sf):
    """Kinds of routes by their targets."""
    targets = F.array(*[F.lit(t) for t in ("local", "igw-1", "nat-2", "tgw-3", "vpce-fw-4", "vpce-5", "pcx-6", "vgw-7", "eni-8", "zzz", None)])
    routes = table(spark, sf, "part").select("p_partkey", F.element_at(targets, (F.col("p_partkey") % 11 + 1).cast("int")).alias("target"))
    return network.route_kinds(routes).select("p_partkey", "target_kind")


def custom_secrets(spark, sf):
    """Rules of one's own before the built-in ones, over customers' names and segments."""
    c = table(spark, sf, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, "Internal-Code").otherwise("note")
    rules = {"segment code": ("^internal_code$", "^(BUILDING|MACHINERY)$"), "customer": ("note", "[05]$")}
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", secrets.secret_kind(key, value, rules).alias("kind"))


def relevance_page(spark, sf):
    """The first results of a search: by tier, score, then source and id."""
    docs = table(spark, sf, "documents").withColumn("title", F.col("source"))
    rows, lengths = search.term_rows(docs, "doc_id", ["text", "title"], ["license", "the"])
    found = search.ranked_matches(rows, "doc_id", "license", lengths=lengths).withColumn("score", F.round("score", 4))
    return search.by_relevance(found, docs, "doc_id", "source", k=12)


QUERIES = {f.__name__: f for f in (leaf_texts, leaf_matches, inventory_rows, route_kinds, custom_secrets, relevance_page)}

_WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ORACLE = {
    "leaf_texts": "SELECT o_orderkey, sha256(o_orderstatus || chr(10) || o_orderpriority || chr(10) || o_orderkey || chr(10) || o_custkey) AS digest FROM orders",
    "leaf_matches": """WITH l AS (SELECT o_orderkey, unnest(['.a', '.b.c', '.b.d[0]', '.b.d[1]']) AS path, unnest([o_orderstatus, o_orderpriority, o_orderkey::VARCHAR, o_custkey::VARCHAR]) AS t FROM orders)
      SELECT o_orderkey, path, left(t, 6) AS value FROM l WHERE contains(lower(t), 'urgent') OR contains(t, '77') QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY path) <= 2""",
    "inventory_rows": """SELECT s_suppkey, s_suppkey % 5 = 3 AS number, s_suppkey % 7 = 3 AND s_suppkey % 2 = 1 AND s_nationkey > 4 AND s_nationkey % 2 = 1 AS profile, s_suppkey % 2 = 0 AND s_nationkey % 3 = 2 AS type, true AS "all", false AS none FROM supplier""",
    "route_kinds": "SELECT p_partkey, ['local', 'internet', 'nat', 'transit', 'firewall', 'endpoint', 'peering', 'vpn', 'interface', 'other', 'none'][p_partkey % 11 + 1] AS target_kind FROM part",
    "custom_secrets": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'segment code' WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 AND right(c_name, 1) IN ('0', '5') THEN 'customer' END AS kind FROM customer""",
    "relevance_page": rf"""WITH i AS (SELECT doc_id, source, {_WORDS.format(t='text')} AS a, {_WORDS.format(t='source')} AS b FROM documents),
      n AS (SELECT doc_id, source, len(a) + len(b) AS len, len(list_filter(a, lambda x: x = 'license')) + len(list_filter(b, lambda x: x = 'license')) AS tf FROM i), m AS (SELECT * FROM n WHERE len > 0),
      s AS (SELECT doc_id, source, round(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 4) AS score FROM m, (SELECT count(*) AS docs, avg(len) AS avg_len, count(*) FILTER (tf > 0) AS df FROM m) WHERE tf > 0)
      SELECT doc_id, CAST(3 AS INT) AS tier, score, source, CAST(row_number() OVER (ORDER BY score DESC, source, doc_id) AS INT) AS place FROM s QUALIFY place <= 12""",
}
