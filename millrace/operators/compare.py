"""Environment-to-environment comparison with cleaned names and learnt aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_name(c: Column, words: list[str], aliases: list[str] = ()) -> Column:
    """Lower case; account numbers, environment words and learnt suffixes become placeholders (K2)."""
    out = F.regexp_replace(F.lower(c), r"\b\d{12}\b", "<account>")
    out = F.regexp_replace(out, r"(?<![a-z0-9])(" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?![a-z0-9])", "<env>")
    return F.regexp_replace(out, r"(?<![a-z0-9])(" + "|".join(map(re.escape, aliases)) + r")(?![a-z0-9])", "<id>") if aliases else out


def identities(df: DataFrame, name: Column, parent: Column) -> DataFrame:
    """Identity: the cleaned name inside its parent's (K3, one level; apply per depth for deeper trees)."""
    return df.withColumn("identity", F.concat_ws("/", parent, name))


def suffix_aliases(source: DataFrame, target: DataFrame, name: str, votes: int = 2) -> DataFrame:
    """(a, b, votes): tokens that stand for each other on the two sides (K4).

    Names without an equal on the other side that differ in one token vote for the pair; a token
    that the other side knows, or a pair that is not one to one, is left out.
    """
    a, b = source.select(name).distinct(), target.select(name).distinct()
    left, right = a.join(b, name, "left_anti"), b.join(a, name, "left_anti")

    def masked(df: DataFrame, token: str, raw: str) -> DataFrame:
        parts = F.split(F.col(name), r"[^a-z0-9<>]+")
        long = df.select(F.col(name).alias(raw), parts.alias("p"), F.posexplode(parts).alias("i", token))
        mask = F.array_join(F.transform("p", lambda x, i: F.when(i == F.col("i"), "*").otherwise(x)), "-")
        rows = long.select(raw, token, mask.alias("mask"))
        alone = rows.groupBy("mask").agg(F.count_distinct(token).alias("k")).where("k = 1").select("mask")
        return rows.join(alone, "mask")

    def vocabulary(df: DataFrame, token: str) -> DataFrame:
        return df.select(F.explode(F.split(F.col(name), r"[^a-z0-9<>]+")).alias(token)).distinct()

    met = masked(left, "a", "x").join(masked(right, "b", "y"), "mask").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= votes)
    met = met.join(vocabulary(b, "a"), "a", "left_anti").join(vocabulary(a, "b"), "b", "left_anti")
    one = met.withColumn("_a", F.count(F.lit(1)).over(Window.partitionBy("a"))).withColumn("_b", F.count(F.lit(1)).over(Window.partitionBy("b")))
    return one.where("_a = 1 AND _b = 1").select("a", "b", "votes")


def normalise_refs(df: DataFrame, value: str, refs: DataFrame) -> DataFrame:
    """Ids that a pair explains become <type:identity>, other ids <unpaired id> (K5). refs: id, type, identity."""
    named = refs.select(F.col("id").alias(value), F.concat(F.lit("<"), "type", F.lit(":"), "identity", F.lit(">")).alias("_r"))
    out = df.join(named, value, "left")
    id_like = F.col(value).rlike(r"^[a-z]{1,12}-[0-9a-f]{8,17}$")
    return out.withColumn("normal", F.coalesce("_r", F.when(id_like, "<unpaired id>"), value)).drop("_r")


def compare_fields(pairs: DataFrame, keys: list[str], columns: list[str], expected: list[str] = ()) -> DataFrame:
    """(keys..., field, source, target, expected): fields that differ between the sides s_x and t_x of a pair (K6, K7)."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"s_{c}").cast("string").alias("source"), F.col(f"t_{c}").cast("string").alias("target")) for c in columns])
    long = pairs.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.*")
    return long.where(~F.col("source").eqNullSafe(F.col("target"))).withColumn("expected", F.col("field").isin(*expected) if expected else F.lit(False))


def compare_counts(pairs: DataFrame, differences: DataFrame, keys: list[str]) -> DataFrame:
    """(verdict, n): pairs that are the same, differ as expected, or differ (K7)."""
    per = differences.groupBy(*keys).agg(F.min("expected").alias("_e"))
    verdict = F.when(F.col("_e").isNull(), "same").when(F.col("_e"), "expected").otherwise("different")
    return pairs.join(per, keys, "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def blind_spots(source: DataFrame, target: DataFrame, group: str, name: str) -> DataFrame:
    """(why, side, n): unnamed rows, and groups that one side alone has (K8)."""
    unnamed = [d.where(F.trim(F.coalesce(F.col(name), F.lit(""))) == "").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unnamed").alias("why"), F.lit(s).alias("side"), "n") for s, d in (("source", source), ("target", target))]
    a, b = source.select(group).distinct(), target.select(group).distinct()
    alone = [x.join(y, group, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("group on one side").alias("why"), F.lit(s).alias("side"), "n") for s, x, y in (("source", a, b), ("target", b, a))]
    out = unnamed[0]
    for d in [*unnamed[1:], *alone]:
        out = out.union(d)
    return out
