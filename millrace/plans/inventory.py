"""Joins, statistics, calendar and change capture over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.json import id_forms, parse
from ..operators import changes, joins, stats
from ..operators import tables as ops
from ..sources.tables import table

TODAY = "2024-01-20"


def counts_by_group(spark, sf):
    return stats.counts_by(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


def facets(spark, sf):
    return stats.facets(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def left_join_names(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.with_names(orders, table(spark, sf, "customer").where("c_acctbal > 0"), ["c_custkey"], "c_name")


def uses_used_by(spark, sf):
    return joins.used_by(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


def links_out(spark, sf):
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.uses(links, table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_suppkey", "s_name"), "l_orderkey", "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber", "s_name")


def wanted_not_excluded(spark, sf):
    t = table(spark, sf, "events")
    key = lambda kind: t.where(F.col("event_type") == kind).select("user_id").distinct()
    users = t.select("user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    return joins.only_matching(users, key("purchase"), t.where("value > 200").select("user_id").distinct(), "user_id")


def people_roles(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 50).alias("creator"), F.col("user_id").alias("author"))
    return stats.role_counts(rows, {"written": "creator", "updated": "author"})


def people(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("event_id") % 50).alias("creator"), F.col("user_id").alias("author"), F.col("event_id").alias("commit"))
    return stats.people(rows, "event_type", "creator", "author", "commit")


def people_identity(spark, sf):
    return stats.people_by_identity(people(spark, sf), "event_type")


def contributors(spark, sf):
    return stats.contributors(table(spark, sf, "events"), "user_id")


def overview(spark, sf):
    res = table(spark, sf, "customer").select(F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("region"))
    log = table(spark, sf, "events").select((F.col("user_id") % 25).cast("int").alias("account"), F.element_at(F.create_map(F.lit("view"), F.lit("added"), F.lit("click"), F.lit("modified"), F.lit("error"), F.lit("removed")), F.col("event_type")).alias("action"))
    denied = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("account"), (F.col("s_suppkey") % 5).alias("type"))
    return stats.overview(res, log, denied)


def change_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("run"), F.col("event_type").alias("action"), (F.col("user_id") % 10).alias("account"))
    return stats.change_counts(rows, "run", "20240110")


def sidebar(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("p"), "r_name")
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("p"), F.col("n_nationkey").alias("repo"))
    docs = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("repo"), F.col("s_acctbal").alias("at"))
    return joins.sidebar(regions, nations, docs, "p", "repo", "at").select("r_name", "repo", "documents", "last")


def bookmark_stats(spark, sf):
    rows = table(spark, sf, "pages").select("url", (F.col("page_id") % 4).alias("views"), F.date_sub(F.lit(TODAY).cast("date"), (F.col("page_id") % 90).cast("int")).alias("added"))
    return stats.bookmark_stats(rows, TODAY)


def activity(spark, sf):
    return stats.activity(table(spark, sf, "events"), "user_id", "ts", "2024-01-05", "2024-01-15")


def env_words(spark, sf):
    name = F.concat_ws("-", F.lit("app"), F.element_at(F.array(F.lit("dev"), F.lit("prod"), F.lit("test"), F.lit("x")), (F.col("s_suppkey") % 4 + 1).cast("int")), F.col("s_suppkey"))
    return stats.env_words(table(spark, sf, "supplier").select(name.alias("name")), "name", ["dev", "prod", "test", "uat"])


def name_category(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.element_at(F.array(F.lit("audit-prod"), F.lit("dns-dev"), F.lit("lake"), F.lit("other")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"))
    return rows.select("p_partkey", stats.environment(F.col("name"))["name"].alias("environment"), stats.category(F.col("name")).alias("category"))


def common_roles(spark, sf):
    return stats.common_roles(table(spark, sf, "part"), "p_name")


def mean_durations(spark, sf):
    return stats.mean_durations(table(spark, sf, "events"), "event_type", "value")


def unread(spark, sf):
    pages = table(spark, sf, "pages").select("page_id")
    log = table(spark, sf, "events").select((F.col("event_id") % 300).alias("page_id"), (F.col("value") > 50).alias("reviewed"))
    return stats.unread(log, pages, "page_id")


def run_summary(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    return stats.run_summary(rows, "event_id", 500, ["view", "click", "error"], rows)


def impact_counts(spark, sf):
    ids = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    users = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    return stats.impact_counts(ids, {"orders": orders, "events": users}, "k")


def stored_bytes(spark, sf):
    return stats.stored_bytes(table(spark, sf, "documents"), "source", "text")


def failed_items(spark, sf):
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    named = failed.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ops.top_k(named, 25, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "c_name", "n_name")


def item_history(spark, sf):
    return table(spark, sf, "events").where("user_id = 7").select("event_id", "event_type").orderBy(F.desc("event_id"))


def coverage_gaps(spark, sf):
    listed = table(spark, sf, "part").select(F.concat(F.lit("arn:x:y:z:1:part/"), "p_partkey").alias("id"), F.col("p_brand").alias("type"))
    tokens = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("token")).distinct()
    return joins.coverage_gaps(listed, tokens, "id", id_forms(F.col("id")), "type")


def type_matches(spark, sf):
    a = table(spark, sf, "part").select(F.split("p_name", " ")[1].alias("a")).distinct()
    b = a.select(F.concat("a", F.lit("s")).alias("b"))
    return joins.type_matches(a, b, "a", "b")


def placed(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("own"))
    cand = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("place"))
    parents = rows.select("id", (F.col("id") - 1).alias("parent")).where("id % 3 > 0")
    return joins.place(rows, "id", "own", cand, parents)


def resolved(spark, sf):
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    owners = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal")
    return joins.resolve(asked, owners, "k", [(F.col("s_acctbal") > 9000, False), (F.col("s_acctbal") > 0, True)], "s_suppkey").select("k", "s_suppkey", "tier")


def first_reason(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    parts = [("rich", c.where("c_acctbal > 8000")), ("big order", c.join(o.where("o_totalprice > 400000"), "c_custkey", "left_semi")), ("building", c.where("c_mktsegment = 'BUILDING'"))]
    return joins.first_reason(parts, "c_custkey")


def keyword_accounts(spark, sf):
    return joins.by_keyword(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "ring", ["widget"]).select("p_partkey", "kind")


def twin_names(spark, sf):
    rows = table(spark, sf, "supplier").select(F.concat_ws("-", F.lit("app"), F.element_at(F.array(F.lit("dev"), F.lit("prod")), (F.col("s_suppkey") % 2 + 1).cast("int")), (F.col("s_suppkey") / 2).cast("int")).alias("name"))
    return joins.twins(rows, "name", ["dev", "prod"])


def pr_trace(spark, sf):
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    commits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("commit"), F.col("l_orderkey").alias("pr"))
    pulls = o.select(F.col("o_orderkey").alias("pr"), F.col("o_orderpriority").alias("title"))
    acts = e.select((F.col("event_id") % 500).alias("pr"), F.when(F.col("event_type") == "purchase", "MERGED").otherwise("APPROVED").alias("action"), F.col("event_id").alias("at"), F.col("user_id").alias("person"))
    return joins.pr_trace(commits, pulls, acts)


def weekday_histogram(spark, sf):
    return calendar.weekday_commits(table(spark, sf, "events"), ["event_id"], "ts", "2024-01-03", "2024-01-24", "Europe/Dublin")


def period_counts(spark, sf):
    return calendar.period_counts(table(spark, sf, "events"), "ts", TODAY)


def order_periods(spark, sf):
    return calendar.period_counts(table(spark, sf, "orders"), "o_orderdate", "1998-06-15")


def timeline_bucket(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate")).alias("at"))
    return rows.select("o_orderkey", calendar.timeline_bucket(F.col("at"), "1998-06-15").alias("bucket"))


def inactive_groups(spark, sf):
    return calendar.inactive(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "2001-10-01")


def _customers(spark, sf):
    """Two snapshots: balances of every 7th customer changed, every 11th gone, every 13th there under a new key."""
    before = table(spark, sf, "customer")
    k = F.col("c_custkey")
    after = before.where(k % 11 != 0).withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return before, after.unionByName(before.where(k % 13 == 0).withColumn("c_custkey", k + 10_000_000))


AFTER = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 13 = 0)"


def snapshot_diff(spark, sf):
    return changes.snapshot_diff(*_customers(spark, sf), ["c_custkey"], ["c_name", "c_acctbal", "c_mktsegment"])


def upsert_plan(spark, sf):
    digest = changes.content_hash(["c_name", "c_acctbal", "c_mktsegment"])
    before, after = (d.select("c_custkey", digest.alias("hash")) for d in _customers(spark, sf))
    return changes.upsert_plan(before, after, ["c_custkey"])


def change_log(spark, sf):
    digest = changes.content_hash(["c_name", "c_acctbal", "c_nationkey"])
    before, after = (d.select("c_custkey", "c_mktsegment", digest.alias("hash")) for d in _customers(spark, sf))
    failed = spark.range(1).select(F.lit("BUILDING").alias("c_mktsegment"))
    return changes.detect_changes(before, after, ["c_custkey", "c_mktsegment"], "c_mktsegment", failed)


def field_diff(spark, sf):
    doc = lambda d: d.select("c_custkey", parse(F.to_json(F.struct("c_name", "c_acctbal", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("seg")))).alias("j"))
    before, after = (doc(d) for d in _customers(spark, sf))
    return changes.field_diff(before, after, ["c_custkey"], "j").select("c_custkey", "path", "op")


def document_hash(spark, sf):
    rows = table(spark, sf, "events").select("event_id", parse("props").alias("j"))
    return changes.document_hash(rows, ["event_id"], "j")


def log_append(spark, sf):
    log = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("run"))
    return changes.append_since(log, log.where("run <= '20240115'"), "run")


def changed_since(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("run"), F.when(F.col("event_type") == "click", "modified").otherwise("removed").alias("action"))
    return changes.changed_since(rows, ["user_id"], "run", "20240128")


def page_changes(spark, sf):
    o = table(spark, sf, "orders")
    version = F.size(F.array_repeat(F.lit(1), (F.col("o_orderkey") % 4).cast("int")))
    pages = o.select(F.col("o_orderkey").alias("page_id"), version.alias("version"), F.col("o_orderdate").alias("created"), F.date_add("o_orderdate", 10).cast("timestamp").alias("updated"))
    stored = pages.where("page_id % 3 > 0").select("page_id", F.when(F.col("page_id") % 5 == 0, F.lit(0)).otherwise(F.col("version")).alias("version"), "updated")
    return changes.detect_page_changes(stored, pages, "2000-01-01")


def purge_pages(spark, sf):
    return changes.purge(table(spark, sf, "orders"), "o_orderkey", "o_orderdate", "2001-08-01").select("o_orderkey")


def file_plan(spark, sf):
    e = table(spark, sf, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "ADD"), ("click", "MODIFY"), ("error", "DELETE"), ("purchase", "MOVE"), ("signup", "COPY")) for x in p]), F.col("event_type"))
    rows = e.select(kind.alias("type"), F.concat(F.lit("f"), F.col("event_id") % 9000).alias("path"), F.concat(F.lit("f"), F.col("event_id") % 7000 + 100).alias("src_path"))
    return changes.plan_file_changes(rows)


def refresh_documents(spark, sf):
    before, after = _customers(spark, sf)
    digest = changes.content_hash(["c_name", "c_acctbal"])
    side = lambda d, commit: d.select("c_custkey", commit.alias("commit_id"), digest.alias("hash"), F.col("c_mktsegment").alias("notes"))
    return changes.refresh_documents(side(before, F.lit(1)), side(after, F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(2)), ["c_custkey"], ["notes"])


def failures(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    stored = c.where("k % 3 = 0").select("k", (F.col("k") % 5).cast("int").alias("attempts"), F.lit("old").alias("error"))
    return changes.record_failures(stored, c.where("k % 2 = 0").withColumn("error", F.lit("new")), c.where("k % 7 = 0"), "k")


def refresh_candidates(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("type"), (F.col("p_size") == 1).alias("always"), F.when(F.col("p_size") > 40, 0).otherwise(F.col("p_size") - 10).alias("rows"), (F.col("p_size") == 2).alias("failed"), (F.col("p_size") == 20).alias("blocked"))
    hints = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("type"))
    parents = p.where("type % 4 = 3").select("type", (F.col("type") - 1).alias("parent"))
    return changes.refresh_candidates(p, hints, parents, 1)


def merged_fields(spark, sf):
    before, after = _customers(spark, sf)
    return changes.merge_fields(before, after, "c_custkey", ["c_mktsegment"], ["c_name", "c_acctbal"])


def mirrored(spark, sf):
    before, after = _customers(spark, sf)
    return changes.mirror(before, after, table(spark, sf, "customer").where("c_custkey % 22 = 0").select("c_custkey"), "c_custkey").select("c_custkey", "c_acctbal")


def stale_keys(spark, sf):
    o = table(spark, sf, "orders")
    stored = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    return changes.stale(stored, o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("at")), "o_custkey", "at")


def only_in_source(spark, sf):
    before, after = _customers(spark, sf)
    return changes.only_in(before, after, ["c_custkey"])


def list_changes(spark, sf):
    brands = table(spark, sf, "part").groupBy("p_size").agg(F.collect_set(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("a"), F.collect_set(F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand"))).alias("b"))
    return brands.select("p_size", F.array_join(changes.list_changes(F.col("a"), F.col("b")), "; ").alias("changes"))


def work_list(spark, sf):
    o = table(spark, sf, "orders")
    return changes.work_list([o.where("o_orderstatus = 'P'"), o.where("o_totalprice > 300000")], o.where("o_orderpriority = '5-LOW'"), "o_orderkey")


def visit_counts(spark, sf):
    return changes.count_events(table(spark, sf, "events"), "user_id", "ts")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__}

_DAY = f"DATE '{TODAY}'"


def _periods(day: str, source: str, ts: str) -> str:
    m, w, y = f"date_trunc('month', {day})", f"date_trunc('week', {day})", f"date_trunc('year', {day})"
    spans = {
        "today": (day, f"{day} + 1"), "yesterday": (f"{day} - 1", day), "this_week": (w, f"{w} + INTERVAL 7 DAY"), "last_week": (f"{w} - INTERVAL 7 DAY", w),
        "this_month": (m, f"{m} + INTERVAL 1 MONTH"), "last_month": (f"{m} - INTERVAL 1 MONTH", m), "last_3_months": (f"{day} - INTERVAL 3 MONTH", f"{day} + 1"),
        "last_6_months": (f"{day} - INTERVAL 6 MONTH", f"{day} + 1"), "this_year": (y, f"{y} + INTERVAL 1 YEAR"), "last_year": (f"{y} - INTERVAL 1 YEAR", y),
        "last_12_months": (f"{day} - INTERVAL 12 MONTH", f"{day} + 1"), "last_2_years": (f"{day} - INTERVAL 24 MONTH", f"{day} + 1"), "last_3_years": (f"{day} - INTERVAL 36 MONTH", f"{day} + 1"),
    }
    parts = [f"SELECT '{k}' AS period, count(*) AS n FROM s WHERE d >= {a} AND d < {b}" for k, (a, b) in spans.items()]
    parts += ["SELECT strftime(d, '%Y'), count(*) FROM s GROUP BY 1", "SELECT strftime(d, '%Y-%m'), count(*) FROM s GROUP BY 1"]
    return f"WITH s AS (SELECT CAST({ts} AS DATE) AS d FROM {source}) SELECT period, n FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def _bucket(day: str) -> str:
    m, w, y = f"date_trunc('month', {day})", f"date_trunc('week', {day})", f"date_trunc('year', {day})"
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN d = {day} THEN 'today' WHEN d = {day} - 1 THEN 'yesterday'
      WHEN d >= {w} AND d < {w} + INTERVAL 7 DAY THEN 'this_week' WHEN d >= {w} - INTERVAL 7 DAY AND d < {w} THEN 'last_week' WHEN d >= {m} AND d < {m} + INTERVAL 1 MONTH THEN 'this_month'
      WHEN d >= {m} - INTERVAL 1 MONTH AND d < {m} THEN 'last_month' WHEN d >= {day} - INTERVAL 3 MONTH AND d <= {day} THEN 'last_3_months' WHEN d >= {day} - INTERVAL 6 MONTH AND d <= {day} THEN 'last_6_months'
      WHEN d >= {y} AND d < {y} + INTERVAL 1 YEAR THEN 'this_year' WHEN d >= {y} - INTERVAL 1 YEAR AND d < {y} THEN 'last_year' WHEN d >= {day} - INTERVAL 12 MONTH AND d <= {day} THEN 'last_12_months'
      WHEN d >= {day} - INTERVAL 24 MONTH AND d <= {day} THEN 'last_2_years' WHEN d >= {day} - INTERVAL 36 MONTH AND d <= {day} THEN 'last_3_years' ELSE strftime(d, '%Y-%m') END AS bucket
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""


PEOPLE = "SELECT event_type, person, count(*) AS files, count(DISTINCT c) AS commits FROM (SELECT event_type, event_id AS c, event_id % 50 AS person FROM events UNION ALL SELECT event_type, event_id, user_id FROM events WHERE user_id <> event_id % 50) WHERE person IS NOT NULL GROUP BY ALL"

ORACLE = {
    "counts_by_group": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL",
    "facets": "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "left_join_names": "SELECT o_custkey AS c_custkey, o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "uses_used_by": "SELECT l_partkey, count(DISTINCT l_suppkey) AS used_by, min(l_suppkey) AS first FROM lineitem GROUP BY 1",
    "links_out": "SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON l_suppkey = s_suppkey",
    "wanted_not_excluded": "SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND user_id NOT IN (SELECT user_id FROM events WHERE value > 200)",
    "people_roles": "SELECT person, count(*) FILTER (r = 'w') AS written, count(*) FILTER (r = 'u') AS updated FROM (SELECT event_id % 50 AS person, 'w' AS r FROM events UNION ALL SELECT user_id, 'u' FROM events) GROUP BY 1",
    "people": PEOPLE,
    "people_identity": f"SELECT CAST(person AS VARCHAR) AS identity, count(DISTINCT event_type) AS repos, CAST(sum(files) AS BIGINT) AS files FROM ({PEOPLE}) GROUP BY 1",
    "contributors": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20",
    "overview": """SELECT c_nationkey AS account, count(*) AS resources, count(DISTINCT c_mktsegment) AS regions, coalesce(any_value(a), 0) AS added, coalesce(any_value(m), 0) AS modified, coalesce(any_value(r), 0) AS removed, coalesce(any_value(d), 0) AS denied_types
      FROM customer LEFT JOIN (SELECT user_id % 25 AS k, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'error') AS r FROM events GROUP BY 1) e ON e.k = c_nationkey
      LEFT JOIN (SELECT s_nationkey AS k, count(DISTINCT s_suppkey % 5) AS d FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON s.k = c_nationkey GROUP BY 1""",
    "change_counts": """SELECT action, account, CASE WHEN action IS NOT NULL THEN 1 WHEN account IS NOT NULL THEN 2 ELSE 3 END::BIGINT AS level, n FROM (
      SELECT event_type AS action, user_id % 10 AS account, count(*) AS n FROM events WHERE strftime(ts, '%Y%m%d') = '20240110' GROUP BY GROUPING SETS ((event_type), (user_id % 10), ()))""",
    "sidebar": "SELECT r_name, n_nationkey AS repo, coalesce(c, 0) AS documents, l AS last FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS c, max(s_acctbal) AS l FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey",
    "bookmark_stats": f"""SELECT count(*) AS total, count(DISTINCT regexp_extract(url, '^\\w+://([^/:?#]+)', 1)) AS domains, CAST(sum(page_id % 4) AS BIGINT) AS opens, count(*) FILTER (page_id % 4 = 0) AS never_viewed,
      count(*) FILTER (strftime(d, '%Y-%m') = '2024-01') AS this_month, count(*) FILTER (strftime(d, '%Y-%m') = '2023-12') AS last_month FROM (SELECT *, {_DAY} - CAST(page_id % 90 AS INT) AS d FROM pages)""",
    "activity": "SELECT user_id, count(*) AS n, max(CAST(ts AS DATE)) AS last_day FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-15' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "env_words": """WITH s AS (SELECT 'app-' || ['dev','prod','test','x'][s_suppkey % 4 + 1] || '-' || s_suppkey AS name, ['dev','prod','test','x'][s_suppkey % 4 + 1] AS word FROM supplier),
      c AS (SELECT word, count(*) AS n, min(name) AS example FROM s WHERE word <> 'x' GROUP BY 1) SELECT *, n >= greatest(2, max(n) OVER () * 0.2) AS main FROM c""",
    "name_category": "SELECT p_partkey, ['Prod', 'Dev', 'Other', 'Other'][p_partkey % 4 + 1] AS environment, ['Security & Privacy', 'Networking', 'Data & Analytics', 'Other accounts'][p_partkey % 4 + 1] AS category FROM part",
    "common_roles": "SELECT p_name, n, rank FROM (SELECT p_name, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_name) AS INT) AS rank FROM part GROUP BY 1) WHERE rank = 1 OR n > 1",
    "mean_durations": "SELECT event_type, count(*) AS runs, avg(value) AS mean FROM events GROUP BY 1",
    "unread": "SELECT page_id, coalesce(n, 0) AS n FROM pages LEFT JOIN (SELECT event_id % 300 AS p, count(*) AS n FROM events WHERE NOT value > 50 GROUP BY 1) ON p = page_id",
    "run_summary": "SELECT v AS view, c AS click, e AS error, (SELECT count(*) FROM events) - v - c - e AS unchanged FROM (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events WHERE event_id > 500)",
    "impact_counts": "SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "stored_bytes": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY 1",
    "failed_items": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
    "item_history": "SELECT event_id, event_type FROM events WHERE user_id = 7",
    "coverage_gaps": """WITH g AS (SELECT p_brand AS type, 'arn:x:y:z:1:part/' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)),
      r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS k FROM g) SELECT type, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (k <= 10) AS examples FROM r GROUP BY 1""",
    "type_matches": "SELECT DISTINCT string_split(p_name, ' ')[2] AS a, string_split(p_name, ' ')[2] || 's' AS b FROM part",
    "placed": """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS own FROM orders), c AS (SELECT l_orderkey AS id, min(l_returnflag) AS f FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1),
      a AS (SELECT r.id, coalesce(own, f) AS place FROM r LEFT JOIN c USING (id)), b AS (SELECT a.id, coalesce(a.place, u.place) AS place FROM a LEFT JOIN a u ON u.id = a.id - 1 AND a.id % 3 > 0)
      SELECT b.id, coalesce(b.place, u.place) AS place FROM b LEFT JOIN b u ON u.id = b.id - 1 AND b.id % 3 > 0""",
    "resolved": """WITH s AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier), t AS (SELECT s_nationkey AS k, s_suppkey, CASE WHEN s_acctbal > 9000 THEN 0 WHEN s_acctbal > 0 AND c = 1 THEN 1 END AS tier FROM s)
      SELECT k, s_suppkey, CAST(tier AS INT) AS tier FROM t JOIN nation ON k = n_nationkey WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, s_suppkey) = 1""",
    "first_reason": "SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'rich' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'big order' ELSE 'building' END AS reason FROM customer WHERE c_acctbal > 8000 OR c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "keyword_accounts": "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'project' ELSE 'shared' END AS kind FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%widget%'",
    "twin_names": "SELECT 'app-dev-' || (s_suppkey // 2) AS a, 'app-prod-' || (s_suppkey // 2) AS b FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)",
    "pr_trace": """WITH c AS (SELECT DISTINCT l_partkey AS commit, l_orderkey AS pr FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
      m AS (SELECT event_id % 500 AS pr, max(event_id) AS merged FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT event_id % 500 AS pr, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS reviewers FROM events WHERE event_type <> 'purchase' GROUP BY 1)
      SELECT commit, pr, merged, coalesce(reviewers, '') AS reviewers FROM c LEFT JOIN m USING (pr) LEFT JOIN r USING (pr)""",
    "weekday_histogram": "SELECT CAST(d + 1 AS INT) AS weekday, (SELECT count(*) FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-24' AND dayofweek(ts) = d) AS n FROM range(0, 7) t(d)",
    "period_counts": _periods(_DAY, "events", "ts"),
    "order_periods": _periods("DATE '1998-06-15'", "orders", "o_orderdate"),
    "timeline_bucket": _bucket("DATE '1998-06-15'"),
    "inactive_groups": "SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY 1 HAVING max(o_orderdate) < DATE '2001-07-01'",
    "snapshot_diff": f"""SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal <> b.c_acctbal THEN 'changed' ELSE 'unchanged' END AS status,
      CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' ELSE '' END AS changed FROM customer b FULL JOIN {AFTER} a ON a.c_custkey = b.c_custkey""",
    "upsert_plan": f"SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN a.c_custkey IS NULL THEN 'delete' WHEN a.c_acctbal <> b.c_acctbal THEN 'update' ELSE 'keep' END AS action FROM customer b FULL JOIN {AFTER} a ON a.c_custkey = b.c_custkey",
    "change_log": f"""SELECT * FROM (SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_mktsegment, a.c_mktsegment) AS c_mktsegment, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal <> b.c_acctbal THEN 'modified' END AS action
      FROM customer b FULL JOIN {AFTER} a ON a.c_custkey = b.c_custkey) WHERE action IS NOT NULL AND NOT (action = 'removed' AND c_mktsegment = 'BUILDING')""",
    "field_diff": """WITH b AS (SELECT c_custkey AS k, c_acctbal AS x, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS y, c_custkey % 11 = 0 AS gone FROM customer)
      SELECT k AS c_custkey, '.c_name' AS path, 'removed' AS op FROM b WHERE gone UNION ALL SELECT k, '.c_acctbal', CASE WHEN gone THEN 'removed' ELSE 'changed' END FROM b WHERE gone OR x <> y
      UNION ALL SELECT k, '.seg', CASE WHEN gone OR y <= 5000 THEN 'removed' ELSE 'added' END FROM b WHERE (gone AND x > 5000) OR (NOT gone AND (x > 5000) <> (y > 5000))
      UNION ALL SELECT c_custkey + 10000000, unnest(CASE WHEN c_acctbal > 5000 THEN ['.c_name', '.c_acctbal', '.seg'] ELSE ['.c_name', '.c_acctbal'] END), 'added' FROM customer WHERE c_custkey % 13 = 0""",
    "document_hash": "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS hash FROM events",
    "log_append": "SELECT event_id, strftime(ts, '%Y%m%d') AS run FROM events WHERE strftime(ts, '%Y%m%d') > '20240115'",
    "changed_since": "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND strftime(ts, '%Y%m%d') >= '20240128'",
    "page_changes": """WITH p AS (SELECT o_orderkey AS page_id, CAST(o_orderkey % 4 AS INT) AS version, o_orderdate AS c, o_orderdate + INTERVAL 10 DAY AS u FROM orders)
      SELECT page_id, CASE WHEN page_id % 3 = 0 AND c >= '2000-01-01' THEN 'new' ELSE 'updated' END AS kind, version FROM p WHERE u >= '2000-01-01' AND (page_id % 3 = 0 OR (page_id % 5 = 0 AND version > 0))""",
    "purge_pages": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 183 DAY",
    "file_plan": """WITH r AS (SELECT DISTINCT 'f' || (event_id % 9000) AS path FROM events WHERE event_type <> 'error'),
      d AS (SELECT 'f' || (event_id % 9000) AS path FROM events WHERE event_type = 'error' UNION SELECT 'f' || (event_id % 7000 + 100) FROM events WHERE event_type = 'purchase')
      SELECT path, 'refresh' AS action FROM r UNION ALL SELECT path, 'drop' FROM d WHERE path NOT IN (SELECT path FROM r)""",
    "refresh_documents": f"""SELECT a.c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'new' WHEN a.c_custkey % 2 = 0 OR a.c_acctbal = b.c_acctbal THEN 'unchanged' ELSE 'updated' END AS outcome, b.c_mktsegment AS notes FROM {AFTER} a LEFT JOIN customer b ON a.c_custkey = b.c_custkey""",
    "failures": """SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS error
      FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 2 = 0) AND c_custkey % 7 <> 0""",
    "refresh_candidates": """WITH p AS (SELECT p_partkey AS t, p_size AS s FROM part), o AS (SELECT t FROM p WHERE s = 20 UNION SELECT t FROM p WHERE t % 4 = 3 AND t - 1 IN (SELECT t FROM p WHERE s = 20)),
      d AS (SELECT t FROM p WHERE (s IN (1, 2) OR (s <= 40 AND s > 10) OR t IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) AND t NOT IN (SELECT t FROM o))
      SELECT t AS type FROM d UNION SELECT t - 1 FROM d WHERE t % 4 = 3""",
    "merged_fields": f"SELECT b.c_custkey, b.c_mktsegment, coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.c_acctbal, b.c_acctbal) AS c_acctbal FROM customer b LEFT JOIN {AFTER} a ON a.c_custkey = b.c_custkey",
    "mirrored": f"SELECT c_custkey, c_acctbal FROM {AFTER} UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 22 = 0",
    "stale_keys": "SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS a, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS b FROM orders GROUP BY 1) WHERE b IS NULL OR a > b",
    "only_in_source": "SELECT c_custkey, 'source' AS side FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey + 10000000, 'target' FROM customer WHERE c_custkey % 13 = 0",
    "list_changes": """WITH a AS (SELECT p_size, p_brand, bool_or(p_partkey % 2 = 0) AS a, bool_or(p_partkey % 2 = 1) AS b FROM part GROUP BY ALL)
      SELECT p_size, coalesce(string_agg(CASE WHEN b THEN '[+] ' ELSE '[-] ' END || p_brand, '; ' ORDER BY a, p_brand) FILTER (a <> b), '') AS changes FROM a GROUP BY 1""",
    "work_list": "SELECT DISTINCT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice > 300000) AND o_orderpriority <> '5-LOW'",
    "visit_counts": "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1",
}
