"""Text comparison for a whole table of pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_changes(pairs: DataFrame, keys: list[str], left: str = "original", right: str = "modified", trim: bool = False, skip_blank: bool = False) -> DataFrame:
    """(keys..., kind, line, left_no, right_no): same, removed and added lines by occurrence (L1)."""

    def side(column: str, number: str) -> DataFrame:
        text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\r\n?", "\n")
        rows = pairs.select(*keys, F.posexplode(F.split(text, "\n")).alias("p", "line"))
        shown = F.trim("line") if trim else F.col("line")
        rows = rows.select(*keys, (F.col("p") + 1).alias(number), shown.alias("line"))
        rows = rows.where(F.trim("line") != "") if skip_blank else rows
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "line").orderBy(number)))

    both = side(left, "left_no").join(side(right, "right_no"), [*keys, "line", "nth"], "full_outer")
    kind = F.when(F.col("left_no").isNull(), "added").when(F.col("right_no").isNull(), "removed").otherwise("same")
    return both.select(*keys, kind.alias("kind"), "line", "left_no", "right_no")


def edited_lines(changes: DataFrame, keys: list[str], ahead: int = 20, least: float = 0.5) -> DataFrame:
    """(keys..., left_no, right_no, similarity): removed lines with their most similar added line, one to one (L2)."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    a = changes.where("kind = 'removed'").select(*keys, "left_no", tokens.alias("x"))
    b = changes.where("kind = 'added'").select(*keys, "right_no", tokens.alias("y"))
    # A range join by blocks of `ahead` line numbers: each line meets its own block and the next ones only.
    a = a.withColumn("_b", F.explode(F.sequence(F.floor((F.col("left_no") - ahead) / ahead), F.floor((F.col("left_no") + ahead) / ahead))))
    b = b.withColumn("_b", F.floor(F.col("right_no") / ahead))
    met = a.join(b, [*keys, "_b"]).where(F.abs(F.col("right_no") - F.col("left_no")) <= ahead)
    met = met.withColumn("similarity", 2 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))).where(F.col("similarity") >= least)
    best_left = F.row_number().over(Window.partitionBy(*keys, "left_no").orderBy(F.desc("similarity"), "right_no"))
    best_right = F.row_number().over(Window.partitionBy(*keys, "right_no").orderBy(F.desc("similarity"), "left_no"))
    return met.withColumns({"_l": best_left, "_r": best_right}).where("_l = 1 AND _r = 1").select(*keys, "left_no", "right_no", "similarity")


def changed_words(edited: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys..., removed, added): words of an edited line that only one side has (L3)."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1)
    return edited.select(*keys, F.array_join(F.array_except(tokens(F.col(left)), tokens(F.col(right))), " ").alias("removed"), F.array_join(F.array_except(tokens(F.col(right)), tokens(F.col(left))), " ").alias("added"))


def diff_summary(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., same, added, removed, identical) (L4)."""
    out = changes.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "added", "removed")])
    return out.withColumn("identical", (F.col("added") == 0) & (F.col("removed") == 0))


def diff_view(changes: DataFrame, view: str) -> DataFrame:
    """all, differences or similarities (L4)."""
    return {"all": changes, "differences": changes.where("kind <> 'same'"), "similarities": changes.where("kind = 'same'")}[view]


def version_changes(pages: DataFrame, key: str, version: str, text: str) -> DataFrame:
    """(key, version, same, added, removed): every version against the one before."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(version))
    pairs = pages.select(key, version, before.alias("original"), F.col(text).alias("modified")).where("original IS NOT NULL")
    return diff_summary(line_changes(pairs, [key, version]), [key, version])
