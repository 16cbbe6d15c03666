"""Mixing sources to target weights by subset-sum budget fitting.

Targets: the budget is shared by weight over the sources; a source stops at `most` times its size
and its excess is shared again by weight, until no source is above. Taking: every document is taken
as often as its source's size fits whole into the target. For the remaining budget the documents
are counted by exact token length; each length gives its proportional number, rounded down, longest
lengths fill up what is missing but the last few thousand tokens, and bounded-knapsack dynamic
programming over bit sets fits those. Which documents of a length are taken is decided by a seeded
hash of the id. Only counts by (source, length, hash bucket) are grouped; a third of all rows in one
source or length is spread over the buckets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from .common import durable, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # times the size of all documents
MOST = 2.0  # times a source's size
SEED = 7
BUCKETS = 256
EXACT = 8192  # tokens that dynamic programming fits

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(key, source_size, target) from one row (key, place, source_size) a source.

    `place` orders the sources for the weights. With caps c and weights w, a source is capped where
    c / w is at most the level that the rest then gets for each unit of weight; the others get the
    level times their weight. The windows run over the table of sources, one row each.
    """
    rank = F.row_number().over(Window.orderBy("place")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("key", "place", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    rows = rows.select(
        "*",
        ((F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(everything)
    target = F.when(F.col("level") >= F.col("ratio"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return rows.select("key", "source_size", target.alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT) -> list[int]:
    """How many documents of each length to take so that their tokens come as near below `budget` as can be.

    Proportional numbers first, up to `exact` tokens short of the budget, then whole documents of the
    longest lengths, then an exact fit of at most about `exact` tokens.
    """
    total = sum(n * m for n, m in zip(lengths, counts, strict=True))
    budget = max(0, min(budget, total))
    if not total:
        return [0] * len(lengths)
    taken = [m * max(0, budget - exact) // total for m in counts]
    rest = budget - sum(n * m for n, m in zip(lengths, taken, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        if rest > exact:
            more = min(counts[i] - taken[i], -(-(rest - exact) // lengths[i]), rest // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    # Bounded knapsack: bit s of `reach` says that s tokens can be made of the layers so far.
    reach, window, layers = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        left, size = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left and not reach >> rest & 1:
            part = min(size, left)
            layers.append((i, part, reach))
            reach |= (reach << part * lengths[i]) & window
            left, size = left - part, size * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, part, earlier in reversed(layers):
        if not earlier >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def _fit(pdf: pd.DataFrame, exact: int) -> pd.DataFrame:
    """The documents of one source taken more than `passes` times, by size."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    pdf = pdf.sort_values("size")
    extra = fit_lengths(pdf["size"].tolist(), pdf["n"].tolist(), round(target - passes * size), exact)
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "source_size": size, "target": target, "passes": passes, "extra": extra})


def mix_sources(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED, kept_prefix: str = "", exact: int = EXACT,
) -> DataFrame:
    """The columns `keep` of every row of `docs` (their names after `kept_prefix`) with size, source_size, target and taken.

    A document's size is its number of words (runs of other than white space); null texts have 0. Null is
    a source of its own, after all others. `taken` is a whole multiple of the size. Rows with the
    same id are separate documents, told apart by a hash of their text and kept columns. The last
    `exact` tokens of a source's remaining budget are fitted exactly, longest documents first; so a
    source whose remaining budget is below `exact` takes no proportional part of each length. Texts are
    counted whole. An empty table gives no rows; sources without words get target 0.
    """
    key = F.coalesce(F.concat(F.lit("="), source_col), F.lit("-"))
    place = F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(source_col, F.lit("")))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.col(id_col), F.lit(seed))
    own = [F.col(c).alias(f"_kept_{c}") for c in keep]
    plain = [c for c in keep if not isinstance(docs.schema[c].dataType, MapType)]
    tie = F.xxhash64(text_col, *plain).alias("tie")
    rows = docs.select(key.alias("key"), place.alias("place"), size.alias("size"), draw.alias("draw"), tie, *own)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("draw", 56).cast("int") % BUCKETS)
    counts = durable(rows.groupBy("key", "place", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sources = counts.groupBy("key", "place").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    fitted = (
        lengths.join(source_targets(sources, weights, budget, most), "key")
        .groupBy("key")
        .applyInPandas(lambda pdf: _fit(pdf, exact), "key string, size long, source_size long, target double, passes long, extra long")
    )
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = counts.select("key", "size", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")).join(fitted, ["key", "size"])
    share = share.select(
        "key", "size", "bucket", "source_size", "target", "passes",
        F.least("n", F.greatest(F.lit(0), F.col("extra") - F.col("earlier"))).alias("extra"),
    )
    place_in_bucket = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "tie"))
    ranked = rows.drop("place").withColumn("nth", place_in_bucket).join(share, ["key", "size", "bucket"])
    taken = F.col("size") * (F.col("passes") + (F.col("nth") <= F.col("extra")).cast("long"))
    return ranked.select(*[F.col(f"_kept_{c}").alias(kept_prefix + c) for c in keep], "size", "source_size", "target", taken.alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLE: dict[str, str] = {}
