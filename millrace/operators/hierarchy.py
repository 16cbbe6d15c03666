"""Trees by parent columns: numbers, closures, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cut import written


def tree_numbers(df: DataFrame, id_col: str, parent: str, order: list[Column]) -> DataFrame:
    """(id, number): hierarchical numbers 1.2.3; siblings in the given order."""
    ranked = df.select(F.col(id_col).alias("id"), F.col(parent).alias("parent"), F.row_number().over(Window.partitionBy(parent).orderBy(*order)).alias("n"))
    df.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return df.sparkSession.sql(
        """WITH RECURSIVE t(id, number) AS (
             SELECT id, CAST(n AS STRING) FROM {r} WHERE parent IS NULL
             UNION ALL SELECT r.id, t.number || '.' || r.n FROM t JOIN {r} r ON r.parent = t.id)
           SELECT id, number FROM t""",
        r=ranked,
    )


def extend_numbers(numbered: DataFrame, added: DataFrame, parent: str, order: str) -> DataFrame:
    """Added rows numbered after the largest place of their parent (W6). numbered: parent, place."""
    last = numbered.groupBy(parent).agg(F.max("place").alias("_m"))
    n = F.row_number().over(Window.partitionBy(parent).orderBy(order))
    return added.join(last, parent, "left").withColumn("place", F.coalesce("_m", F.lit(0)) + n).drop("_m")


def descendants(df: DataFrame, id_col: str, parent: str, roots: DataFrame) -> DataFrame:
    """(root, id, depth): every root with all that lies below it; cycles end (N22). roots: root.

    A tree deeper than `spark.sql.cteRecursionLevelLimit` raises an error; set that higher for one.
    """
    df.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    edges = df.select(F.col(id_col).alias("id"), F.col(parent).alias("parent"))
    found = df.sparkSession.sql(
        f"""WITH RECURSIVE t(root, id, depth, seen) AS (
             SELECT root, root, 0, array(root) FROM {{r}}
             UNION ALL SELECT t.root, e.id, t.depth + 1, concat(t.seen, array(e.id)) FROM t JOIN {{e}} e ON e.parent = t.id
             WHERE NOT array_contains(t.seen, e.id))
           SELECT root, id, depth FROM t""",
        r=roots, e=edges,
    )
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def top_most(df: DataFrame, id_col: str, parent: str) -> DataFrame:
    """(id, top): the highest ancestor of every node, by pointer doubling.

    The rounds grow with the logarithm of the depth, each from a written table. A parent that is no node
    is a top. Nodes on a cycle and below one have no top: null.
    """
    i, p = F.col(id_col), F.col(parent)
    up = written(df.select(i.alias("id"), F.coalesce(p, i).alias("top"), p.isNull().alias("done")))
    waiting = -1
    while (left := up.where("NOT done").count()) not in (0, waiting):
        waiting = left
        above = up.select(F.col("id").alias("_i"), F.col("top").alias("_t"), F.col("done").alias("_d"))
        both = up.join(above, F.col("top") == F.col("_i"), "left")
        # A top that is done stands for itself; the top's own row then says the same.
        up = written(both.select("id", F.when(F.col("done"), F.col("top")).otherwise(F.coalesce("_t", "top")).alias("top"), (F.col("done") | F.coalesce("_d", F.lit(True))).alias("done")))
    return up.select("id", F.when(F.col("done"), F.col("top")).alias("top"))


def page_layout(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(page_id, section, path): section and path from the ancestor list, current titles winning over stored ones.

    pages: page_id, ancestors array<struct<page_id, title>>; titles: page_id, title.
    """
    parts = pages.select("page_id", F.posexplode_outer("ancestors").alias("p", "a"))
    now = titles.select(F.col("page_id").alias("_a"), F.col("title").alias("_t"))
    named = parts.join(now, F.col("a.page_id") == F.col("_a"), "left").select("page_id", "p", F.coalesce("_t", "a.title").alias("t"))
    return named.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("p", "t")))), lambda x: x["t"]), " / ").alias("path"), F.min_by("t", "p").alias("section"))


def branch_context(df: DataFrame, path: str, matches: DataFrame) -> DataFrame:
    """Rows in a folder, or below one, that holds a match (M11). Paths are a/b/c; a row's folder is its path without the last step."""
    folder = F.regexp_replace(F.col(path), "/[^/]*$", "")
    hit = matches.select(folder.alias("_f")).distinct()
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return df.withColumn("_f", F.explode(prefixes)).join(hit, "_f", "left_semi").drop("_f").distinct()
