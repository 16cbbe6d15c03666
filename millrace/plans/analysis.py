"""Search, text comparison, environment comparison, networks, trees and secrets over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters, network, secrets
from ..operators import compare, hierarchy, postings, search, textdiff
from ..operators import network as net
from ..operators.cut import shared_folder
from ..operators.joins import attach_rules, join_cidr, pair_sides
from ..operators.joins import longest_prefix as longest
from ..sources.tables import table


def _index(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return search.build_index(rows, "doc_id", ["title", "text"])


def token_index(spark, sf):
    return _index(spark, sf).groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def simple_search(spark, sf):
    index = _index(spark, sf)
    return search.having_terms(index, "doc_id", ["license", "apache"]).withColumn("form", F.lit("all")).union(
        search.having_terms(index, "doc_id", ["license", "reserved"], all_of=False).withColumn("form", F.lit("any"))
    )


def phrase_search(spark, sf):
    return search.having_phrase(_index(spark, sf), "doc_id", ["all", "rights", "reserved"])


def near_tier(spark, sf):
    return search.tightest(_index(spark, sf), "doc_id", ["the", "license"])


def bm25_top(spark, sf):
    scored = search.bm25(_index(spark, sf), "doc_id", ["license", "apache", "rights"], {"title": 10.0, "text": 1.0})
    return scored.select("doc_id", F.round("score", 6).alias("score"))


def ranked_search(spark, sf):
    docs = table(spark, sf, "documents").withColumn("title", F.col("source"))
    rows, lengths = search.term_rows(docs, "doc_id", ["text", "title"], ["apache", "license", "reserved"])
    found = search.ranked_matches(rows, "doc_id", "apache license", excluded="reserved", lengths=lengths)
    return found.select("doc_id", "tier", F.round("score", 6).alias("score"))


def stored_search(spark, sf):
    """The ranked search over a stored index, a third of whose documents were written again and a fifth deleted and added."""
    docs = table(spark, sf, "documents").withColumn("title", F.col("source"))
    index = postings.PostingIndex(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", "doc_id", ["text", "title"])
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("apache license old "), "text")).otherwise(F.col("text"))
    index.write(docs.where("doc_id % 5 > 0").withColumn("text", old))
    index.refresh(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 10 = 1").select("doc_id"))
    index.refresh(docs.where("doc_id % 10 = 1 OR doc_id % 5 = 0"))
    rows, lengths = index.select(["apache", "license", "reserved"])
    found = search.ranked_matches(rows, "doc_id", "apache license", excluded="reserved", lengths=lengths)
    return found.select("doc_id", "tier", F.round("score", 6).alias("score"))


def substring_search(spark, sf):
    return search.search_text(table(spark, sf, "documents"), "doc_id", "text", "licens version")


def keyword_hits(spark, sf):
    return search.keyword_hits(table(spark, sf, "documents"), "doc_id", "text", ["license", "reserved", "example"], "source", 3)


def relevance_rank(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("body"), (F.col("page_id") % 7).alias("views"), F.date_sub(F.lit("2024-01-20").cast("date"), (F.col("page_id") % 40).cast("int")).cast("timestamp").alias("viewed"))
    found = search.relevance(rows, "page_id", {"url": 3.0, "body": 1.0}, "example page", "views", "viewed", "2024-01-20")
    return found.select("page_id", "tier", F.round("score", 6).alias("score"), "matched")


def snippets(spark, sf):
    rows = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return rows.select("doc_id", search.snippet(F.col("text"), ["license"]).alias("snippet"))


def field_match(spark, sf):
    rows = table(spark, sf, "part")
    return rows.where(filters.match_fields([F.col("p_name"), F.col("p_brand")], "red ring")).select("p_partkey", filters.match_fields([F.col("p_name")], "small_ring", together=True).alias("phrase"))


def page_identity(spark, sf):
    return table(spark, sf, "pages").select("page_id", filters.page_identity(F.col("url")).alias("identity"), filters.belongs_to(F.col("url"), "https://example.org/en").alias("inside"))


def ignored_paths(spark, sf):
    paths = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.lit("items"), F.col("l_returnflag"), F.when(F.col("l_linestatus") == "F", "price").otherwise("meta.time")).alias("path"))
    return paths.select("l_orderkey", "l_linenumber", "path", filters.ignored(F.col("path"), ["time", "items.R.*"]).alias("ignored"))


def line_changes(spark, sf):
    turns = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.select("conv_id", "turn", before.alias("original"), F.col("text").alias("modified")).where("original IS NOT NULL")
    return textdiff.diff_summary(textdiff.line_changes(pairs, ["conv_id", "turn"]), ["conv_id", "turn"])


def version_changes(spark, sf):
    pages = table(spark, sf, "documents").select((F.col("doc_id") / 4).cast("int").alias("page"), "doc_id", "text")
    return textdiff.version_changes(pages, "page", "doc_id", "text")


def edited_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    words = F.split(F.regexp_replace("text", "\n", " \n "), " ")
    changed = F.array_join(F.transform(words, lambda w, i: F.when((i % 17 == 5) & (w != "\n"), F.lit("edited")).otherwise(w)), " ")
    pairs = d.select("doc_id", F.regexp_replace("text", "\n", " \n ").alias("original"), changed.alias("modified"))
    found = textdiff.edited_lines(textdiff.line_changes(pairs, ["doc_id"]), ["doc_id"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edited"))


def changed_words(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat_ws(" ", "p_name", "p_brand").alias("b"))
    return textdiff.changed_words(p, ["p_partkey"], "a", "b")


WORDS = ["dev", "prod", "test"]


def _sides(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = lambda env, token: F.concat_ws("-", F.lit("App"), F.lit(env), F.concat(F.lit("svc"), k % 7), F.when(k % 5 == 0, token), F.format_string("n%03d", k))
    row = lambda env, token: s.select("s_suppkey", "s_nationkey", "s_acctbal", name(env, F.lit(token)).alias("raw"))
    source = row("dev", "blue").where("s_suppkey % 11 <> 0")
    target = row("prod", "green").where("s_suppkey % 13 <> 0").withColumn("s_acctbal", F.when(k % 4 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    clean = compare.clean_name(F.col("raw"), WORDS)
    return source.withColumn("name", clean), target.withColumn("name", clean)


def clean_names(spark, sf):
    return _sides(spark, sf)[0].select("s_suppkey", "name")


def sides_paired(spark, sf):
    source, target = _sides(spark, sf)
    unlisted = spark.range(1).select(F.lit(3).cast("int").alias("s_nationkey"))
    return pair_sides(source, target, ["s_nationkey", "name"], "s_suppkey", unlisted)


def suffix_aliases(spark, sf):
    return compare.suffix_aliases(*_sides(spark, sf), "name")


def _pairs(spark, sf):
    a, b = _sides(spark, sf)
    a = a.select("s_suppkey", F.col("s_acctbal").alias("s_balance"), F.col("raw").alias("s_raw"))
    return a.join(b.select("s_suppkey", F.col("s_acctbal").alias("t_balance"), F.col("raw").alias("t_raw")), "s_suppkey")


def compare_report(spark, sf):
    return compare.compare_fields(_pairs(spark, sf), ["s_suppkey"], ["balance", "raw"], ["raw"]).select("s_suppkey", "field", "expected")


def compare_counts(spark, sf):
    pairs = _pairs(spark, sf)
    return compare.compare_counts(pairs, compare.compare_fields(pairs, ["s_suppkey"], ["balance", "raw"], ["raw"]), ["s_suppkey"])


def normalised_refs(spark, sf):
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("sg-"), F.lpad(F.hex("l_suppkey"), 8, "0")).alias("value"))
    links = links.withColumn("value", F.lower("value"))
    refs = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lower(F.concat(F.lit("sg-"), F.lpad(F.hex("s_suppkey"), 8, "0"))).alias("id"), F.lit("group").alias("type"), F.lower("s_name").alias("identity"))
    return compare.normalise_refs(links, "value", refs).select("l_orderkey", "l_linenumber", "normal")


def blind_spots(spark, sf):
    a, b = _sides(spark, sf)
    return compare.blind_spots(a.where("s_nationkey < 20"), b.where("s_nationkey > 3").withColumn("raw", F.when(F.col("s_suppkey") % 9 > 0, F.col("raw"))), "s_nationkey", "raw")


def _routes(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    net_ = F.concat(F.lit("10."), k % 50, F.lit("."), F.when(k % 3 == 0, k % 16 * 16).otherwise(0), F.lit(".0/"), F.when(k % 3 == 0, 20).otherwise(16))
    return p.select(net_.alias("cidr"), F.concat(F.lit("t"), k % 5).alias("target")).groupBy("cidr").agg(F.min("target").alias("target"))


def _ips(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws(".", F.lit("10"), k % 60, k % 251, k % 13).alias("ip"))


def longest_prefix(spark, sf):
    return longest(_routes(spark, sf), _ips(spark, sf), "ip", "cidr").select("ip", "cidr", "prefix").distinct()


def cidr_join(spark, sf):
    return join_cidr(_ips(spark, sf), _routes(spark, sf), "ip", "cidr").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


def address_facts(spark, sf):
    r = _routes(spark, sf)
    block = F.array(F.lit("10.0.0.0/12"), F.lit("10.16.0.0/12"), F.lit("10.32.0.0/11"))
    return r.select("cidr", network.address_in(F.col("cidr")).alias("address"), network.cidr_in_parent(F.col("cidr"), block).alias("place"), network.ports_cover(F.lit("80-443"), F.lit(100)).alias("covered"), network.protocol_ok(F.lit("6"), F.lit("tcp")).alias("protocol"))


def _rules(spark, sf):
    k = F.col("p_partkey")
    cidrs = F.when(k % 4 == 0, F.array(F.lit("0.0.0.0/0"))).otherwise(F.array(F.concat(F.lit("10."), k % 60, F.lit(".0.0/16"))))
    perm = F.struct(F.when(k % 6 == 0, "-1").otherwise("tcp").alias("protocol"), F.col("p_size").alias("from_port"), (F.col("p_size") + k % 3).alias("to_port"), cidrs.alias("cidrs"), F.when(k % 5 == 0, F.array(F.concat(F.lit("sg-"), k % 7))).alias("groups"), F.when(k % 11 == 0, F.array(F.lit("pl-1"))).alias("prefixes"))
    return net.sg_rules(table(spark, sf, "part").select((k % 40).alias("group"), F.array(perm).alias("perms")), "group", "perms", "in")


def rule_rows(spark, sf):
    return _rules(spark, sf).groupBy("group", "protocol", "peer_type").agg(F.count(F.lit(1)).alias("n"))


def open_to_world(spark, sf):
    rules = _rules(spark, sf).withColumn("action", F.when(F.col("group") % 3 == 0, "deny"))
    return net.open_to_world(rules).select("group", "ports", "protocol")


def _flows(spark, sf):
    k = F.col("c_custkey")
    return _ips(spark, sf).select(k.alias("flow"), (k % 45).alias("group"), (k % 9).alias("acl"), F.col("ip").alias("peer_ip"), (k % 50).cast("int").alias("port"), F.lit("tcp").alias("protocol"))


def group_check(spark, sf):
    callers = F.array(F.concat(F.lit("sg-"), F.col("flow") % 7))
    return net.sg_check(_flows(spark, sf).withColumn("callers", callers), _rules(spark, sf))


def acl_first_match(spark, sf):
    k = F.col("s_suppkey")
    acl = table(spark, sf, "supplier").select((k % 9).alias("acl"), k.alias("number"), F.when(k % 4 == 0, "udp").otherwise("all").alias("protocol"), F.concat_ws("-", k % 20, k % 20 + 15).alias("ports"), F.concat(F.lit("10."), k % 8 * 8, F.lit(".0.0/13")).alias("cidr"), F.when(k % 3 == 0, "deny").otherwise("allow").alias("action"))
    return net.acl_first_match(_flows(spark, sf), acl)


def follow_routes(spark, sf):
    n = F.col("n_nationkey")
    routes = table(spark, sf, "nation").select(F.concat(F.lit("t"), n).alias("table"), F.lit("10.0.0.0/8").alias("cidr"), F.when(n % 5 == 4, "igw-1").when(n == 0, "t0").otherwise(F.concat(F.lit("t"), n + 1)).alias("target"))
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("start"), F.lit("10.1.2.3").alias("ip"), F.concat(F.lit("t"), "s_nationkey").alias("table"))
    return net.follow_routes(starts, routes)


def hop_paths(spark, sf):
    hops = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")).alias("n"), F.col("l_suppkey").cast("string").alias("hop"), F.element_at(F.create_map(F.lit("A"), F.lit("PASS"), F.lit("N"), F.lit("UNKNOWN"), F.lit("R"), F.lit("FAIL")), F.col("l_returnflag")).alias("verdict"))
    return net.paths(hops)


def worst_verdict(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(network.worst(F.when(F.col("l_quantity") > 49, "FAIL").when(F.col("l_quantity") > 30, "UNKNOWN").otherwise("PASS")).alias("worst"))


def dns_order(spark, sf):
    n = table(spark, sf, "nation")
    zones = n.select(F.col("n_regionkey").alias("vpc"), F.concat(F.lower("n_name"), F.lit(".corp.example")).alias("domain"))
    forwards = n.where("n_nationkey % 3 = 0").select(F.col("n_regionkey").alias("vpc"), F.concat(F.lower("n_name"), F.lit(".corp.example")).alias("domain"))
    return net.dns_order(zones, forwards)


def graph_edges(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return net.graph_edges(rows, [("region", "n_regionkey", "nation", "n_nationkey"), ("nation", "n_nationkey", "customer", "c_custkey")])


def open_findings(spark, sf):
    c = table(spark, sf, "customer")
    known = c.where("c_custkey % 50 = 0").select("c_custkey", F.lit("negative").alias("finding"))
    return net.findings([("negative", "high", c.where("c_acctbal < 0")), ("rich", "low", c.where("c_acctbal > 9000"))], "c_custkey", known)


def entry_points(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return net.entry_points({"customer": c.select(F.col("c_nationkey").alias("where")), "supplier": s.select(F.col("s_nationkey").alias("where"))}, ["where"])


def attached_rules(spark, sf):
    rules = table(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("group"), "p_size")
    res = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("uses part-"), F.col("l_partkey"), F.lit(" and part-"), F.col("l_suppkey")).alias("text"))
    return attach_rules(res, "text", r"part-\d+", rules, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("title"))
    return r.union(n).union(c)


def tree_numbers(spark, sf):
    return hierarchy.tree_numbers(_tree(spark, sf), "id", "parent", [F.col("title"), F.col("id")])


def descendants(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return hierarchy.descendants(_tree(spark, sf), "id", "parent", roots)


def top_most(spark, sf):
    return hierarchy.top_most(_tree(spark, sf), "id", "parent")


def page_layout(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    step = lambda i, t: F.struct(i.alias("page_id"), t.alias("title"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    pages = c.select(F.col("c_custkey").alias("page_id"), F.array(step(F.concat(F.lit("r"), "n_regionkey"), F.lit("old")), step(F.concat(F.lit("n"), "n_nationkey"), F.col("n_name"))).alias("ancestors"))
    return hierarchy.page_layout(pages, r.select(F.concat(F.lit("r"), "r_regionkey").alias("page_id"), F.col("r_name").alias("title")))


def extended_numbers(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    numbered = c.where("c_custkey % 2 = 0").withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    return hierarchy.extend_numbers(numbered, c.where("c_custkey % 2 = 1"), "c_nationkey", "c_custkey")


def branch_context(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws("/", F.col("c_nationkey") % 5, "c_nationkey", "c_custkey").alias("path"))
    return hierarchy.branch_context(rows, "path", rows.where("c_custkey % 400 = 7")).select("c_custkey")


def secret_scan(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("kind", secrets.line_secret(F.col("line"))).where("kind IS NOT NULL").select("doc_id", "n", "kind")


def redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(secrets.redact_text(F.col("text")), 256).alias("digest"))


def masked(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", secrets.mask(F.col("c_name")).alias("name"), secrets.mask(F.col("c_mktsegment")).alias("segment"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__}

TOK = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
INDEX = f"""(SELECT doc_id, 'text' AS field, unnest({TOK.format(t='text')}) AS token, unnest(range(len({TOK.format(t='text')}))) AS pos FROM documents
  UNION ALL SELECT doc_id, 'title', unnest({TOK.format(t='source')}), unnest(range(len({TOK.format(t='source')}))) FROM documents)"""


def _bm25(terms: str, weight: str) -> str:
    return f"""i AS (SELECT * FROM {INDEX}), l AS (SELECT doc_id, count(*) AS len FROM i GROUP BY 1), g AS (SELECT count(*) AS docs, avg(len) AS a FROM l),
      h AS (SELECT doc_id, token, sum({weight}) AS tf FROM i WHERE token IN ({terms}) GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM h GROUP BY 1),
      s AS (SELECT doc_id, sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a))) AS score FROM h JOIN f USING (token) JOIN l USING (doc_id), g GROUP BY 1)"""


NET = "(SELECT c_custkey, c_custkey % 60 AS b, c_custkey % 251 AS c, c_custkey % 13 AS d, '10.' || c_custkey % 60 || '.' || c_custkey % 251 || '.' || c_custkey % 13 AS ip FROM customer)"
ROUTES = "(SELECT p_partkey % 50 AS b, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 16 * 16 ELSE 0 END AS c, CASE WHEN p_partkey % 3 = 0 THEN 20 ELSE 16 END AS len, '10.' || p_partkey % 50 || '.' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 16 * 16 ELSE 0 END || '.0/' || CASE WHEN p_partkey % 3 = 0 THEN 20 ELSE 16 END AS cidr FROM part GROUP BY ALL)"
RULES = "(SELECT p_partkey % 40 AS \"group\", CASE WHEN p_partkey % 6 = 0 THEN '-1' ELSE 'tcp' END AS protocol, CASE WHEN p_partkey % 6 = 0 THEN 'all' WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '-' || (p_size + p_partkey % 3) END AS ports, p_size AS lo, p_size + p_partkey % 3 AS hi, p_partkey AS k FROM part)"
SIDE = "(SELECT s_suppkey, s_nationkey, s_acctbal + CASE WHEN s_suppkey % 4 = 0 THEN {add} ELSE 0 END AS bal, 'app-<env>-svc' || s_suppkey % 7 || CASE WHEN s_suppkey % 5 = 0 THEN '-{token}' ELSE '' END || '-n' || printf('%03d', s_suppkey) AS name FROM supplier WHERE s_suppkey % {skip} <> 0)"
A, B = SIDE.format(add=0, token="blue", skip=11), SIDE.format(add=1, token="green", skip=13)
TREE = "(SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"


def _line_diff(pairs: str, keys: str) -> str:
    s = lambda c: f"SELECT {keys}, line, row_number() OVER (PARTITION BY {keys}, line) AS nth FROM (SELECT {keys}, unnest(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM p)"
    return f"""WITH p AS ({pairs}), a AS ({s('original')}), b AS ({s('modified')}),
      k AS (SELECT {keys}, coalesce(ax, 0) AS ax, coalesce(bx, 0) AS bx FROM (SELECT *, 1 AS ax FROM a) a FULL JOIN (SELECT *, 1 AS bx FROM b) b USING ({keys}, line, nth))
      SELECT {keys}, count(*) FILTER (ax = 1 AND bx = 1) AS same, count(*) FILTER (ax = 0) AS added, count(*) FILTER (bx = 0) AS removed, count(*) FILTER (ax = 0 OR bx = 0) = 0 AS identical FROM k GROUP BY ALL"""


ORACLE = {
    "token_index": f"SELECT field, token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {INDEX} GROUP BY ALL",
    "simple_search": f"SELECT doc_id, 'all' AS form FROM {INDEX} WHERE token IN ('license', 'apache') GROUP BY doc_id HAVING count(DISTINCT token) = 2 UNION ALL SELECT DISTINCT doc_id, 'any' FROM {INDEX} WHERE token IN ('license', 'reserved')",
    "phrase_search": f"WITH i AS (SELECT * FROM {INDEX}) SELECT DISTINCT a.doc_id FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 AND b.token = 'rights' JOIN i c ON a.doc_id = c.doc_id AND a.field = c.field AND c.pos = a.pos + 2 AND c.token = 'reserved' WHERE a.token = 'all'",
    "near_tier": f"WITH i AS (SELECT * FROM {INDEX} WHERE token IN ('the', 'license')) SELECT a.doc_id, min(abs(a.pos - b.pos) + 1) AS width FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.field = b.field WHERE a.token = 'the' AND b.token = 'license' GROUP BY 1",
    "bm25_top": f"WITH {_bm25(repr('license') + ', ' + repr('apache') + ', ' + repr('rights'), 'CASE field WHEN ' + repr('title') + ' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END')} SELECT doc_id, round(score, 6) AS score FROM s",
    "ranked_search": f"""WITH {_bm25("'license', 'apache'", "1.0::DOUBLE")}, w AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(*) = 2), x AS (SELECT doc_id FROM i WHERE token = 'reserved'),
      n AS (SELECT a.doc_id, bool_or(b.pos = a.pos + 1) AS p, min(abs(a.pos - b.pos)) AS d FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.field = b.field WHERE a.token = 'apache' AND b.token = 'license' GROUP BY 1)
      SELECT doc_id, CASE WHEN p THEN 3 WHEN d <= 10 THEN 2 ELSE 1 END::INT AS tier, round(score, 6) AS score FROM w JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM x)""",
    "substring_search": "SELECT doc_id, CAST((length(t) - length(replace(t, 'licens', ''))) / 6 + (length(t) - length(replace(t, 'version', ''))) / 7 AS INT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'licens') AND contains(t, 'version')",
    "keyword_hits": "SELECT source, word, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, word ORDER BY doc_id) AS n FROM (SELECT source, doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'reserved') THEN 'reserved' WHEN contains(lower(text), 'example') THEN 'example' END AS word FROM documents) WHERE word IS NOT NULL) WHERE n <= 3",
    "snippets": "SELECT doc_id, regexp_replace(substring(text, greatest(instr(lower(text), 'license') - 40, 1), 120), '(license)', '«\\1»', 'gi') AS snippet FROM documents WHERE contains(lower(text), 'license')",
    "field_match": "SELECT p_partkey, contains(p_name, 'small ring') AS phrase FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'red') OR contains(lower(p_brand), 'ring')",
    "ignored_paths": "SELECT l_orderkey, l_linenumber, path, l_linestatus <> 'F' OR l_returnflag = 'R' AS ignored FROM (SELECT *, 'items.' || l_returnflag || CASE WHEN l_linestatus = 'F' THEN '.price' ELSE '.meta.time' END AS path FROM lineitem)",
    "line_changes": _line_diff("SELECT * FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS original, text AS modified FROM conversations) WHERE original IS NOT NULL", "conv_id, turn"),
    "version_changes": _line_diff("SELECT * FROM (SELECT CAST(doc_id // 4 AS INT) AS page, doc_id, lag(text) OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS original, text AS modified FROM documents) WHERE original IS NOT NULL", "page, doc_id"),
    "changed_words": "SELECT p_partkey, p_type AS removed, replace(p_brand, '#', ' # ') AS added FROM part",
    "clean_names": f"SELECT s_suppkey, name FROM {A}",
    "sides_paired": f"""SELECT coalesce(a.s_nationkey, b.s_nationkey) AS s_nationkey, coalesce(a.name, b.name) AS name, a.s_suppkey AS source_id, b.s_suppkey AS target_id,
      CASE WHEN coalesce(a.s_nationkey, b.s_nationkey) = 3 THEN 'not compared' WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' ELSE 'paired' END AS status
      FROM {A} a FULL JOIN {B} b ON a.name = b.name AND a.s_nationkey = b.s_nationkey""",
    "suffix_aliases": "SELECT 'blue' AS a, 'green' AS b, count(*) AS votes FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 HAVING count(*) >= 2",
    "compare_report": "SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['balance', 'raw'] ELSE ['raw'] END) AS field, unnest(CASE WHEN s_suppkey % 4 = 0 THEN [false, true] ELSE [true] END) AS expected FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0",
    "compare_counts": "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'different' ELSE 'expected' END AS verdict, count(*) AS n FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 GROUP BY 1",
    "normalised_refs": "SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NULL THEN '<unpaired id>' ELSE '<group:' || lower(s_name) || '>' END AS normal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey",
    "blind_spots": f"""WITH a AS (SELECT * FROM {A} WHERE s_nationkey < 20), b AS (SELECT * FROM {B} WHERE s_nationkey > 3)
      SELECT 'unnamed' AS why, 'source' AS side, 0::BIGINT AS n UNION ALL SELECT 'unnamed', 'target', count(*) FROM b WHERE s_suppkey % 9 = 0
      UNION ALL SELECT 'group on one side', 'source', count(DISTINCT s_nationkey) FROM a WHERE s_nationkey NOT IN (SELECT s_nationkey FROM b) UNION ALL SELECT 'group on one side', 'target', count(DISTINCT s_nationkey) FROM b WHERE s_nationkey NOT IN (SELECT s_nationkey FROM a)""",
    "longest_prefix": f"SELECT ip, arg_max(cidr, len) AS cidr, CAST(max(len) AS INT) AS prefix FROM {NET} n JOIN {ROUTES} r ON n.b = r.b AND (len = 16 OR n.c // 16 = r.c // 16) GROUP BY ip",
    "cidr_join": f"SELECT c_custkey, count(*) AS n FROM {NET} n JOIN {ROUTES} r ON n.b = r.b AND (len = 16 OR n.c // 16 = r.c // 16) GROUP BY 1",
    "address_facts": f"SELECT cidr, '10.' || b || '.' || c || '.10' AS address, 'block' || CASE WHEN b < 16 THEN 1 WHEN b < 32 THEN 2 ELSE 3 END || '+' || ((b - CASE WHEN b < 16 THEN 0 WHEN b < 32 THEN 16 ELSE 32 END) * 65536 + c * 256) || '/' || len AS place, true AS covered, true AS protocol FROM {ROUTES}",
    "rule_rows": f"SELECT \"group\", protocol, 'cidr' AS peer_type, count(*) AS n FROM {RULES} GROUP BY ALL UNION ALL SELECT \"group\", protocol, 'group', count(*) FROM {RULES} WHERE k % 5 = 0 GROUP BY ALL UNION ALL SELECT \"group\", protocol, 'prefix list', count(*) FROM {RULES} WHERE k % 11 = 0 GROUP BY ALL",
    "open_to_world": f"SELECT \"group\", ports, protocol FROM {RULES} WHERE k % 4 = 0 AND \"group\" % 3 <> 0",
    "group_check": f"""WITH f AS (SELECT c_custkey AS flow, c_custkey % 45 AS g, c_custkey % 50 AS port, b FROM {NET}),
      m AS (SELECT flow, r.k, (protocol = '-1' OR (port >= lo AND port <= hi)) AS c, k % 4 = 0 OR k % 60 = b OR (k % 5 = 0 AND k % 7 = flow % 7) AS inside FROM f LEFT JOIN {RULES} r ON r."group" = g)
      SELECT flow, CASE WHEN bool_or(c AND inside) THEN 'PASS' WHEN bool_or(k IS NULL OR (c AND k % 11 = 0)) THEN 'UNKNOWN' ELSE 'FAIL' END AS verdict FROM m GROUP BY 1""",
    "acl_first_match": f"""WITH f AS (SELECT c_custkey AS flow, c_custkey % 9 AS acl, c_custkey % 50 AS port, b FROM {NET}),
      m AS (SELECT flow, s_suppkey AS n, CASE WHEN s_suppkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS a FROM f JOIN supplier ON s_suppkey % 9 = acl AND s_suppkey % 4 <> 0 AND port BETWEEN s_suppkey % 20 AND s_suppkey % 20 + 15 AND b // 8 = s_suppkey % 8)
      SELECT c_custkey AS flow, min(n) AS rule, coalesce(arg_min(a, n), 'deny') AS action FROM customer LEFT JOIN m ON flow = c_custkey GROUP BY 1""",
    "follow_routes": """SELECT s_suppkey AS start, '10.1.2.3' AS ip, CASE WHEN s_nationkey = 0 THEN 1 ELSE 5 - s_nationkey % 5 END::INT AS hops, CASE WHEN s_nationkey = 0 THEN 'UNKNOWN' ELSE 'igw-1' END AS "end" FROM supplier""",
    "hop_paths": "SELECT l_orderkey AS path, string_agg(CAST(l_suppkey AS VARCHAR), ' > ' ORDER BY l_partkey, l_suppkey, l_linenumber) AS hops, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FAIL' WHEN bool_or(l_returnflag = 'N') THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM lineitem GROUP BY 1",
    "worst_verdict": "SELECT l_suppkey, CASE WHEN max(l_quantity) > 49 THEN 'FAIL' WHEN max(l_quantity) > 30 THEN 'UNKNOWN' ELSE 'PASS' END AS worst FROM lineitem GROUP BY 1",
    "dns_order": """WITH r AS (SELECT n_regionkey AS vpc, lower(n_name) || '.corp.example' AS domain, 'zone' AS kind, 2 AS o FROM nation UNION ALL SELECT n_regionkey, lower(n_name) || '.corp.example', 'forward', 1 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT DISTINCT n_regionkey, '.', 'public', 3 FROM nation)
      SELECT vpc, CAST(row_number() OVER (PARTITION BY vpc ORDER BY domain = '.', o, domain) AS INT) AS place, domain, kind FROM r""",
    "graph_edges": "SELECT DISTINCT 'region' AS source_type, CAST(n_regionkey AS VARCHAR) AS source, 'nation' AS target_type, CAST(n_nationkey AS VARCHAR) AS target FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR) FROM customer",
    "open_findings": "SELECT c_custkey, 'negative' AS finding, 'high' AS severity, c_custkey % 50 = 0 AS expected FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'rich', 'low', false FROM customer WHERE c_acctbal > 9000",
    "entry_points": "SELECT DISTINCT 'customer' AS kind, c_nationkey AS \"where\" FROM customer UNION ALL SELECT DISTINCT 'supplier', s_nationkey FROM supplier",
    "attached_rules": "WITH x AS (SELECT l_orderkey, l_partkey AS p FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey) SELECT l_orderkey, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM x JOIN part ON p = p_partkey GROUP BY 1",
    "tree_numbers": f"WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY title, id) AS n FROM {TREE}), t AS (SELECT id, CAST(n AS VARCHAR) AS number FROM r WHERE parent IS NULL UNION ALL SELECT r.id, t.number || '.' || r.n FROM t JOIN r ON r.parent = t.id) SELECT id, number FROM t",
    "descendants": "SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "top_most": "SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS top FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "page_layout": "SELECT c_custkey AS page_id, r_name || ' / ' || n_name AS path, r_name AS section FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "extended_numbers": "SELECT c_custkey, c_nationkey, CAST((SELECT count(*) FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey % 2 = 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS place FROM customer a WHERE c_custkey % 2 = 1",
    "branch_context": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 400 = 7)",
    "masked": "SELECT c_custkey, '********' || right(c_name, 4) AS name, '********' AS segment FROM customer",
}
ORACLE["stored_search"] = ORACLE["ranked_search"]
