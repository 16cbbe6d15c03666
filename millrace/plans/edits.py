"""Edits of nested documents: customers with their orders and lines, six steps deep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json
from ..operators import rebuild
from ..sources.tables import table


def _documents(spark, sf):
    """(c_custkey, j): {"a": {"orders": [{"key", "lines": [{"password", "q"}]}]}}, orders by key, lines by number."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).alias("x"))
    line = lambda x: F.struct(F.concat(F.lit("pw-"), x["l_partkey"].cast("string")).alias("password"), x["q"].alias("q"))
    lines = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), line).alias("lines"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    docs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), "lines"))).alias("orders"))
    return docs.select("c_custkey", json.parse(F.to_json(F.struct(F.struct("orders").alias("a")))).alias("j"))


def _digest(df):
    return df.select("c_custkey", F.sha2(F.to_json("j"), 256).alias("digest"))


def _steps(path: str):
    return json.parse_path(F.lit(path))


def deep_edits(spark, sf):
    """The last line's quantity of the first order set, the first line of the last order deleted, a list made with the customer's key."""
    docs = _documents(spark, sf)
    edits = F.array(
        rebuild.edit(F.array(*map(F.lit, (".a", ".orders", "[0]", ".lines", "[-1]", ".q"))), "set", F.parse_json(F.lit("-1"))), rebuild.edit(F.array(*map(F.lit, (".a", ".orders", "[-1]", ".lines", "[0]"))), "delete"),
        rebuild.edit(_steps("extra.list[1]"), "set", json.parse(F.col("c_custkey").cast("string"))),
    )
    return _digest(rebuild.apply_edits(docs, ["c_custkey"], "j", edits))


def deep_update(spark, sf):
    """Every quantity over 40 becomes ten times itself, wherever it is."""
    q = lambda v: F.try_variant_get(v, "$", "int")
    return _digest(rebuild.update_where(_documents(spark, sf), ["c_custkey"], "j", lambda steps, key, v: (key == "q") & (q(v) > 40), lambda steps, key, v: q(v) * 10))


def deep_redact(spark, sf):
    return _digest(rebuild.redact(_documents(spark, sf), ["c_custkey"], "j"))


def parsed_paths(spark, sf):
    n = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit("a.b["), n, F.lit("]")), F.concat(F.lit("$.a['x-"), n, F.lit("'].c")), F.concat(F.lit('.a."q '), n, F.lit('"')), F.concat(F.lit("a."), n), F.concat(F.lit("a["), n)]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 5).cast("int") + 1)
    return table(spark, sf, "part").select("p_partkey", F.array_join(json.parse_path(text), " ").alias("steps"))


QUERIES = {f.__name__: f for f in (deep_edits, deep_update, deep_redact, parsed_paths)}


def _docs(q: str = "q", password: str = "'pw-' || l_partkey") -> str:
    return f"""lines AS (SELECT l_orderkey, list({{'password': {password}, 'q': {q}}} ORDER BY l_linenumber, l_partkey, l_suppkey, q) AS lines FROM (SELECT *, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem) GROUP BY l_orderkey),
    docs AS (SELECT o_custkey AS c_custkey, list({{'key': o_orderkey, 'lines': lines}} ORDER BY o_orderkey) AS orders FROM orders JOIN lines ON l_orderkey = o_orderkey GROUP BY o_custkey)"""


_SHOW = "SELECT c_custkey, sha256(CAST(to_json({'a': {'orders': orders}}) AS VARCHAR)) AS digest FROM docs"
ORACLE = {
    "deep_edits": f"""WITH {_docs()},
    one AS (SELECT c_custkey, list_transform(orders, lambda o, i: {{'key': o.key, 'lines': CASE WHEN i = 1 THEN list_transform(o.lines, lambda l, k: {{'password': l.password, 'q': CASE WHEN k = len(o.lines) THEN -1 ELSE l.q END}}) ELSE o.lines END}}) AS orders FROM docs),
    two AS (SELECT c_custkey, list_transform(orders, lambda o, i: {{'key': o.key, 'lines': CASE WHEN i = len(orders) THEN o.lines[2:] ELSE o.lines END}}) AS orders FROM one)
    SELECT c_custkey, sha256(CAST(to_json({{'a': {{'orders': orders}}, 'extra': {{'list': [NULL, c_custkey]}}}}) AS VARCHAR)) AS digest FROM two""",
    "deep_update": f"WITH {_docs(q='CASE WHEN q > 40 THEN q * 10 ELSE q END')} {_SHOW}",
    "deep_redact": f"""WITH {_docs(password="'[REDACTED password]'")} {_SHOW}""",
    "parsed_paths": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.a .b [' || p_partkey || ']' WHEN 1 THEN '.a .x-' || p_partkey || ' .c' WHEN 2 THEN '.a .q ' || p_partkey WHEN 3 THEN '.a [' || p_partkey || ']' END AS steps FROM part""",
}
