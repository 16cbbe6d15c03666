"""JSON tables: documents, filters, search, summaries, order and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import filters, json
from ..operators import tables as ops
from ..sources import documents as docs
from ..sources.tables import filtered_table, table


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, doc): one JSON document an order, its lines in `items`."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"))).alias("items")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    joined = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "items")).alias("doc"))


def exploded_lines(spark: SparkSession, sf: str) -> DataFrame:
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    rows = docs.explode_variant(parsed, "variant_get(d.j, '$.items', 'variant')", ["o_orderkey", "j"])
    get = lambda v, p, t: F.try_variant_get(v, f"$.{p}", t)
    return rows.select(
        (F.col("o_orderkey") * 100 + F.col("pos")).alias("seen"), "o_orderkey", get("j", "o_orderpriority", "string").alias("o_orderpriority"),
        *[get("value", c, "string").alias(c) for c in ("l_returnflag", "l_linestatus")], get("value", "l_quantity", "double").alias("l_quantity"),
    )


def doc_summary(spark, sf):
    return ops.summary(exploded_lines(spark, sf), ["l_linestatus", "o_orderpriority"], "seen", {"l_returnflag": "=R", "l_quantity": ">10"})


def filter_range(spark, sf):
    return ops.filter_rows(table(spark, sf, "part"), {"p_size": "10..20", "p_retailprice": ">=950"}).select("p_partkey", "p_size")


def filter_contains(spark, sf):
    return ops.filter_rows(table(spark, sf, "part"), {"p_type": "ECON", "p_brand": "!=Brand#11"}).select("p_partkey", "p_type")


def filter_empty(spark, sf):
    rows = table(spark, sf, "part").withColumn("note", F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_name")))
    return ops.filter_rows(rows, {"note": "empty"}).select("p_partkey").withColumn("kind", F.lit("empty")).union(
        ops.filter_rows(rows, {"note": "!empty"}).select("p_partkey").withColumn("kind", F.lit("filled"))
    )


def text_match(spark, sf):
    rows = table(spark, sf, "documents")
    tests = {"plain": filters.matches(F.col("text"), "license"), "case": filters.matches(F.col("text"), "License", case=True), "word": filters.matches(F.col("text"), "the", word=True), "regex": filters.matches(F.col("text"), r"\d{3}-\d{4}", regex=True)}
    return rows.select("doc_id", *[t.alias(k) for k, t in tests.items()])


def multi_sort_page(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ops.page(rows, [("l_shipdate", "desc"), ("l_quantity", "asc")], "pos", 20, 50, {"l_returnflag": "=A"}).select("l_orderkey", "l_linenumber", "total", "unfiltered")


def keyset_page(spark, sf):
    return ops.keyset_page(table(spark, sf, "orders"), "o_orderkey", 5000, 40).select("o_orderkey", "o_totalprice", "has_more")


def table_page(spark, sf):
    return filtered_table(spark, sf, "customer", {"c_mktsegment": "BUILDING"}, limit=30, offset=10, order=[F.col("c_custkey")]).select("c_custkey", "c_name")


def event_docs(spark, sf):
    return table(spark, sf, "events").select("event_id", json.parse("props").alias("j"))


def walk_paths(spark, sf):
    return docs.walk(event_docs(spark, sf), ["event_id"], "j").where("depth > 0").select("event_id", "path", json.cell_text(F.col("v")).alias("text"))


def walk_leaves(spark, sf):
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    found = docs.leaves(parsed, ["o_orderkey"], "j").withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]"))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("different"))


def search_values(spark, sf):
    return ops.search_paths(event_docs(spark, sf), ["event_id"], "j", lambda c: filters.matches(c, "7"), "values", None)


def search_keys(spark, sf):
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    found = ops.search_paths(parsed, ["o_orderkey"], "j", lambda c: filters.matches(c, "price"), "keys", None)
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def column_keys(spark, sf):
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    return ops.column_keys(ops.flatten_keys(parsed, ["o_orderkey"], "j"), "o_orderkey").select("key", "n")


def cell_types(spark, sf):
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    f = lambda k: json.field(F.col("j"), k)
    return parsed.select(
        "o_orderkey", json.json_type(f("items")).alias("items_type"), json.json_type(f("o_orderpriority")).alias("priority_type"),
        json.cell_text(f("items")).alias("items_text"), json.cell_text(f("items.length")).alias("n_items"),
        json.cell_text(f("items.0.l_returnflag")).alias("first_flag"), json.cell_text(f("nothing")).alias("missing"),
        json.preview(f("o_orderpriority"), 5).alias("preview"), json.display_name(F.col("j")).alias("name"),
    )


def explode_list(spark, sf):
    parsed = order_documents(spark, sf).select("o_orderkey", json.parse("doc").alias("j"))
    rows = docs.explode_variant(parsed, "variant_get(d.j, '$.items', 'variant')", ["o_orderkey"])
    return rows.select("o_orderkey", F.col("pos").cast("long").alias("inner"), F.concat(F.lit("items["), "pos", F.lit("]")).alias("path"), F.try_variant_get("value", "$.l_quantity", "double").alias("quantity"))


def json_documents(spark, sf):
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    regions = table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    text = regions.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), "nations")).alias("t"))
    return docs.document_rows(text, "t", ["r_regionkey"]).select("r_regionkey", "key", "pos", json.cell_text(F.col("value")).alias("text"))


def bad_lines(spark, sf):
    good, bad = docs.split_json_lines(table(spark, sf, "documents").withColumn("text", F.concat(F.lit('{"n": 1}\n'), "text")), "text", ["doc_id"])
    counted = good.groupBy("doc_id").agg(F.count(F.lit(1)).alias("good"))
    return counted.join(bad.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bad"), F.min("line_no").alias("first_bad")), "doc_id", "left")


def formats(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "a.ndjson").otherwise("a.txt").alias("name"), F.when(F.col("event_id") % 2 == 0, F.concat("props", F.lit("\n"), "props")).otherwise(F.col("props")).alias("text"))
    return rows.select("event_id", docs.detect_format(F.col("name"), F.col("text")).alias("format"))


def noise(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("Signed in.\nusing profile x\n"), "props").alias("text"))
    return rows.select("event_id", docs.strip_noise(F.col("text")).alias("text"))


def unwrap(spark, sf):
    parts = table(spark, sf, "part").groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey"))).alias("items"))
    text = parts.select("p_size", F.to_json(F.struct("items", F.lit("t").alias("NextToken"))).alias("t"))
    return docs.unwrap_records(text, "t", ["p_size"]).select("p_size", "path", F.try_variant_get("value", "$.p_partkey", "long").alias("p_partkey"))


def merge_pages(spark, sf):
    parts = table(spark, sf, "part").withColumn("page", F.col("p_partkey") % 3).groupBy("p_size", "page").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    text = parts.select("p_size", "page", F.to_json(F.struct("keys", F.concat(F.lit("p"), "page").alias("name"))).alias("t"))
    merged = docs.merge_pages(text, ["p_size"], "page", "t")
    return merged.select("p_size", "key", F.array_join("elements", ",").alias("elements"), "value")


def csv_rows(spark, sf):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(', "x"'))).otherwise(F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", docs.csv_row([F.col("n_nationkey").cast("string"), name]).alias("line"))


def json_rows(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", docs.html_to_text(F.col("html")).alias("text"))


def string_kinds(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("url").alias("s"))
    days = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("s"))
    ips = table(spark, sf, "part").select(F.concat(F.lit("10.0."), F.col("p_size"), F.lit(".1")).alias("s"))
    return urls.union(days).union(names).union(ips).groupBy(json.string_kind(F.col("s")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _state():
    """The order codes of the tables as status words."""
    return F.element_at(F.create_map(F.lit("F"), F.lit("Completed"), F.lit("P"), F.lit("pending"), F.lit("O"), F.lit("failed")), F.col("o_orderstatus"))


def status_tones(spark, sf):
    return table(spark, sf, "orders").groupBy(json.status_tone(F.lit("orderStatus"), _state()).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


def found_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(json.find_ids(F.col("text"), r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), " ").alias("ids"))


def snapshots(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.create_map(F.lit("lang"), "lang").alias("labels"))
    return docs.store_snapshot(rows).select("doc_id", "sha256", "n_bytes", "n_chars")


def nested_accounts(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("account_id"), F.col("c_mktsegment").alias("region"), F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("resource_id"), F.to_json(F.struct("c_name")).alias("data"))
    doc = docs.nest_account(rows)
    return doc.select("account_id", F.size(F.json_object_keys("doc")).cast("long").alias("regions"))


def natural_order(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Item "), F.col("p_size"), F.lit("-"), F.col("p_partkey") % 13).alias("name"))
    w = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 7).orderBy(*ops.natural_key(F.col("name")), "p_partkey"))
    return rows.select("p_partkey", w.alias("place"))


def grouped_rows(spark, sf):
    return ops.grouped_rows(table(spark, sf, "part"), "p_brand", "p_partkey").select("p_partkey", "p_brand", "group_size")


def same_values(spark, sf):
    return ops.same_values(table(spark, sf, "orders"), "o_orderpriority")


def tag_coverage(spark, sf):
    tags = F.map_filter(F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.when(F.col("p_size") > 25, "big"), F.lit("Owner"), F.when(F.col("p_size") < 5, "x")), lambda k, v: v.isNotNull())
    return ops.tag_coverage(table(spark, sf, "part").withColumn("tags", tags), "p_partkey", "tags")


def dashboard(spark, sf):
    rows = table(spark, sf, "orders").withColumn("none", F.lit(None).cast("string"))
    return ops.dashboard(rows, {"state": ["none", "o_orderstatus"], "kind": ["o_orderpriority"]}, json.status_tone(F.lit("status"), _state()))


def newest_n(spark, sf):
    return ops.newest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", 2)


def numbered_duplicates(spark, sf):
    return ops.number_duplicates(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "identity")


def first_per_key(spark, sf):
    return ops.first_per_key(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def block_runs(spark, sf):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return ops.islands(table(spark, sf, "lineitem").withColumn("place", place), ["l_orderkey"], "place", F.col("l_returnflag") == "N")


def apportion_bytes(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    return ops.apportion(sizes, "n_bytes", 1000, "source").select("source", "share")


ITEMS = "(SELECT l.*, o.o_orderpriority, o_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS seen FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"
LOW = "lower(coalesce(text, ''))"

QUERIES = {f.__name__: f for f in (
    doc_summary, filter_range, filter_contains, filter_empty, text_match, multi_sort_page, keyset_page, table_page, walk_paths, walk_leaves, search_values,
    search_keys, column_keys, cell_types, explode_list, json_documents, bad_lines, formats, noise, unwrap, merge_pages, csv_rows, json_rows, html_text,
    string_kinds, status_tones, found_ids, snapshots, nested_accounts, natural_order, grouped_rows, same_values, tag_coverage, dashboard, newest_n,
    numbered_duplicates, first_per_key, block_runs, apportion_bytes,
)}

ORACLE = {
    "doc_summary": f"""WITH r AS (SELECT * FROM {ITEMS} WHERE l_returnflag = 'R' AND l_quantity > 10),
      u AS (SELECT 'l_linestatus' AS field, l_linestatus AS value, seen FROM r UNION ALL SELECT 'o_orderpriority', o_orderpriority, seen FROM r),
      c AS (SELECT field, value, count(*) AS n, min(seen) AS first FROM u GROUP BY ALL)
      SELECT field, value, n, CAST(sum(n) OVER (PARTITION BY field) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS INT) AS rank FROM c""",
    "filter_range": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice >= 950",
    "filter_contains": "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%econ%' AND lower(p_brand) <> 'brand#11'",
    "filter_empty": "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'filled' ELSE 'empty' END AS kind FROM part",
    "text_match": r"SELECT doc_id, text ILIKE '%license%' AS plain, contains(text, 'License') AS \"case\", regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AS word, regexp_matches(text, '\d{3}-\d{4}') AS regex FROM documents".replace('\\"', '"'),
    "multi_sort_page": """SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS total, (SELECT count(*) FROM lineitem) AS unfiltered
      FROM lineitem WHERE l_returnflag = 'A' ORDER BY l_shipdate DESC, l_quantity, l_orderkey * 10 + l_linenumber LIMIT 50 OFFSET 20""",
    "keyset_page": "SELECT o_orderkey, o_totalprice, (SELECT count(*) > 40 FROM orders WHERE o_orderkey < 5000) AS has_more FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 40",
    "table_page": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30 OFFSET 10",
    "walk_paths": "SELECT event_id, '.' || k AS path, json_extract_string(props, '$.' || k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "walk_leaves": "".join([
        "WITH i AS (SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) ",
        " UNION ALL ".join(f"SELECT '.items[].{c}' AS path, count(*) AS n, count(DISTINCT {c}) AS different FROM i" for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")),
        " UNION ALL ", " UNION ALL ".join(f"SELECT '.{c}', count(*), count(DISTINCT {c}) FROM o" for c in ("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")),
    ]),
    "search_values": "SELECT event_id, '.' || k AS path, 'value' AS kind, v AS text FROM (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)) WHERE contains(v, '7')",
    "search_keys": "SELECT 'l_extendedprice' AS text, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'o_totalprice', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "column_keys": "SELECT unnest(['o_orderkey','o_orderpriority','o_orderstatus','o_totalprice','items']) AS key, (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS n",
    "cell_types": """SELECT o_orderkey, 'array' AS items_type, 'string' AS priority_type, '[' || count(*) || ' items]' AS items_text, CAST(count(*) AS VARCHAR) AS n_items,
      (list(l_returnflag ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus))[1] AS first_flag, '' AS missing, CASE WHEN length(any_value(o_orderpriority)) > 5 THEN any_value(o_orderpriority)[1:5] || '…' ELSE any_value(o_orderpriority) END AS preview,
      CAST(NULL AS VARCHAR) AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "explode_list": f"SELECT l_orderkey AS o_orderkey, seen - l_orderkey * 100 AS \"inner\", 'items[' || (seen - l_orderkey * 100) || ']' AS path, l_quantity AS quantity FROM {ITEMS}",
    "json_documents": """SELECT r_regionkey, 'name' AS key, 0::BIGINT AS pos, r_name AS text FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
      UNION ALL SELECT n_regionkey, 'nations', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1, n_name FROM nation""",
    "bad_lines": """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace('{"n": 1}' || chr(10) || text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace('{"n": 1}' || chr(10) || text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS n FROM documents)
      SELECT doc_id, count(*) FILTER (json_valid(line)) AS good, nullif(count(*) FILTER (NOT json_valid(line)), 0) AS bad, min(n) FILTER (NOT json_valid(line)) AS first_bad FROM l WHERE trim(line, ' ') <> '' GROUP BY doc_id""",
    "formats": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 2 = 0 THEN 'jsonl' ELSE 'json' END AS format FROM events",
    "noise": "SELECT event_id, props AS text FROM events",
    "unwrap": "SELECT p_size, 'items[' || (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) || ']' AS path, p_partkey FROM part",
    "merge_pages": """WITH p AS (SELECT p_size, p_partkey % 3 AS page, p_partkey FROM part)
      SELECT p_size, 'keys' AS key, string_agg(p_partkey, ',' ORDER BY page, p_partkey) AS elements, NULL AS value FROM p GROUP BY p_size
      UNION ALL SELECT p_size, 'name', NULL, '"p' || min(page) || '"' FROM p GROUP BY p_size""",
    "csv_rows": """SELECT n_nationkey, n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || ', ' || repeat('"', 2) || 'x' || repeat('"', 3) ELSE n_name END AS line FROM nation""",
    "json_rows": """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS line FROM region""",
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS t FROM pages),
      b AS (SELECT page_id, regexp_replace(t, '(?i)</(td|th)\s*>', chr(9), 'g') AS t FROM a),
      c AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|pre|blockquote)\b[^>]*>', chr(10), 'g') AS t FROM b),
      d AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM c),
      e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM d)
      SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS text FROM e""",
    "string_kinds": r"""WITH s AS (SELECT url AS s FROM pages UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT s_name FROM supplier UNION ALL SELECT '10.0.' || p_size || '.1' FROM part)
      SELECT CASE WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}') THEN 'date' WHEN regexp_full_match(s, 'https?://\S+') THEN 'url' WHEN regexp_full_match(s, '\d{1,3}(\.\d{1,3}){3}') THEN 'ip' ELSE 'string' END AS kind, count(*) AS n FROM s GROUP BY 1""",
    "status_tones": "SELECT CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'P' THEN 'warn' WHEN 'O' THEN 'bad' END AS tone, count(*) AS n FROM orders GROUP BY 1",
    "found_ids": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') AS a FROM documents)
      SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS ids FROM e""",
    "snapshots": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "nested_accounts": "SELECT CAST(c_nationkey AS VARCHAR) AS account_id, count(DISTINCT c_mktsegment) AS regions FROM customer GROUP BY 1",
    "natural_order": "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_size, p_partkey % 13, p_partkey) AS INT) AS place FROM part",
    "grouped_rows": "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS group_size FROM part",
    "same_values": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 6",
    "tag_coverage": """WITH t AS (SELECT 'brand' AS tag, count(*) AS rows FROM part UNION ALL SELECT 'size', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'Owner', count(*) FROM part WHERE p_size < 5)
      SELECT tag, rows, (SELECT count(*) FROM part) - rows AS missing, tag = 'Owner' AS chosen FROM t WHERE rows > 0""",
    "dashboard": """SELECT 'state' AS part, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'kind', o_orderpriority, count(*) FROM orders GROUP BY 2
      UNION ALL SELECT 'tone', CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'P' THEN 'warn' ELSE 'bad' END, count(*) FROM orders GROUP BY 2""",
    "newest_n": "SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2",
    "numbered_duplicates": "SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || ' #' || n ELSE p_brand END AS identity FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)",
    "first_per_key": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "block_runs": """WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS INT) AS place FROM lineitem),
      a AS (SELECT *, l_returnflag = 'N' AS c, lag(l_returnflag = 'N', 1, false) OVER w AS p FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
      b AS (SELECT *, sum(CASE WHEN c AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY place) AS block FROM a)
      SELECT l_orderkey, CAST(block AS BIGINT) AS block, min(place) AS first, max(place) AS last, count(*) AS n FROM b WHERE c GROUP BY l_orderkey, block""",
    "apportion_bytes": """WITH s AS (SELECT source, sum(strlen(text)) AS b FROM documents GROUP BY 1), e AS (SELECT source, b * 1000 / sum(b) OVER () AS e FROM s),
      f AS (SELECT source, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, source) AS p, 1000 - sum(floor(e)) OVER () AS l FROM e)
      SELECT source, CAST(f + CASE WHEN p <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
}
