"""Table operators over rows of JSON or plain columns: columns, summaries, order, pages, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import filter_rows
from ..functions.json import cell_text, json_type
from ..sources.documents import explode_variant, walk

DEPTH, KEYS = 3, 40


def flatten_keys(df: DataFrame, id_cols: list[str], value_col: str, depth: int = DEPTH, most: int = KEYS) -> DataFrame:
    """(id..., key, v): dotted keys of nested objects down to `depth`; lists, empty objects and objects with over `most` keys stay whole."""
    out, open_ = None, explode_variant(df, f"d.`{value_col}`", id_cols).where("key IS NOT NULL").select(*id_cols, "key", F.col("value").alias("v"))
    for level in range(1, depth + 1):
        size = F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
        deeper = (json_type(F.col("v")) == "object") & size.between(1, most) & F.lit(level < depth)
        done = open_.where(~F.coalesce(deeper, F.lit(False)))
        out = done if out is None else out.unionByName(done)
        if level < depth:
            below = explode_variant(open_.where(deeper).withColumnRenamed("key", "k"), "d.v", [*id_cols, "k"])
            open_ = below.select(*id_cols, F.concat("k", F.lit("."), F.col("key")).alias("key"), F.col("value").alias("v"))
    return out


def column_keys(flat: DataFrame, row: str, pos: str | None = None) -> DataFrame:
    """(key, n, rank): keys by frequency, ties by the first row that has them."""
    first = F.min(pos or row)
    counts = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first", "key")))


def summary(df: DataFrame, fields: list[str], pos: str, filters: dict[str, str] | None = None, k: int = 20) -> DataFrame:
    """(field, value, n, total, rank): the k most frequent texts of each field after the filters, ties by first seen."""
    rows = filter_rows(df, filters or {})
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields]))
    counts = rows.select(pos, pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    total = F.sum("n").over(Window.partitionBy("field"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first"))
    return counts.select("field", "value", "n", total.alias("total"), rank.alias("rank")).where(F.col("rank") <= k)


def natural_key(c: Column) -> list[Column]:
    """Sort columns of the natural order: empties last, numbers by value, digit runs in text as numbers, no case or accents."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    chunks = F.transform(
        F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1),
        lambda x: F.struct(
            F.when(x.rlike(r"^\d"), 0).otherwise(1).alias("k"),
            F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n"),
            F.collate(F.when(x.rlike(r"^\d"), "").otherwise(F.lower(x)), "UNICODE_CI_AI").alias("t"),
        ),
    )
    first = F.get(chunks, 0)
    return [text == "", first["k"], F.coalesce(text.try_cast("double"), first["n"].cast("double")), chunks]


def natural_sort(df: DataFrame, column: str, pos: str, descending: bool = False) -> DataFrame:
    keys = natural_key(F.col(column))
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys], pos)


def multi_sort(df: DataFrame, keys: list[tuple[str, str]], pos: str) -> DataFrame:
    """Stable sort by several keys and directions."""
    return df.orderBy(*[F.col(k).desc() if d == "desc" else F.col(k).asc() for k, d in keys], pos)


def page(df: DataFrame, keys: list[tuple[str, str]], pos: str, offset: int, limit: int, filters: dict[str, str] | None = None) -> DataFrame:
    """One page of the sorted, filtered rows with total and unfiltered total (D3)."""
    kept = filter_rows(df, filters or {})
    totals = df.agg(F.count(F.lit(1)).alias("unfiltered")).crossJoin(kept.agg(F.count(F.lit(1)).alias("total")))  # one row each
    return multi_sort(kept, keys, pos).offset(offset).limit(limit).crossJoin(F.broadcast(totals))


def keyset_page(df: DataFrame, key: str, before, limit: int) -> DataFrame:
    """The `limit` rows below a key, newest first, and whether more follow."""
    rows = df.where(F.col(key) < before).orderBy(F.desc(key)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc(key)))  # over limit + 1 rows
    more = F.max(F.when(F.col("_n") > limit, 1).otherwise(0)).over(Window.partitionBy()) == 1
    return rows.withColumn("_n", place).withColumn("has_more", more).where(F.col("_n") <= limit).drop("_n")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def by_severity(c: Column, order: tuple[str, ...] = ("high", "medium", "low", "info")) -> Column:
    """Place in the severity order."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


def folded(c: Column) -> list[Column]:
    """Case-folded path order, then exact."""
    return [F.lower(c), c]


def grouped_rows(df: DataFrame, group: str, pos: str) -> DataFrame:
    """Rows with the size of their group, in display order: larger groups first, then by name."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("group_size", n).orderBy(F.desc("group_size"), group, pos)


def same_values(df: DataFrame, column: str, k: int = 6) -> DataFrame:
    """The k most frequent values."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def tag_coverage(df: DataFrame, id_col: str, tags: str, prefer: str = "Owner") -> DataFrame:
    """(tag, rows, missing, chosen): coverage of every tag key; chosen is `prefer`, else the rarest (E5)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    keys = df.select(id_col, F.explode(F.map_keys(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy((F.col("tag") != prefer), "rows", "tag")
    return keys.crossJoin(F.broadcast(total)).select("tag", "rows", (F.col("total") - F.col("rows")).alias("missing"), (F.row_number().over(order) == 1).alias("chosen"))


def dashboard(df: DataFrame, choices: dict[str, list[str]], tone: Column | None = None) -> DataFrame:
    """(part, value, n): breakdown on the first field of each part that has a value."""
    parts = [F.struct(F.lit(part).alias("part"), F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value")) for part, cols in choices.items()]
    if tone is not None:
        parts.append(F.struct(F.lit("tone").alias("part"), tone.alias("value")))
    long = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("value IS NOT NULL")
    return long.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def search_paths(df: DataFrame, id_cols: list[str], value_col: str, test, scope: str = "both", limit: int | None = 100_000) -> DataFrame:
    """(id..., path, kind, text): keys and/or scalar values that pass `test`, a function of a text column (C4)."""
    w = walk(df, id_cols, value_col)
    keys = w.where(F.col("key").isNotNull() & test(F.col("key"))).select(*id_cols, "path", F.lit("key").alias("kind"), F.col("key").alias("text"))
    scalar = w.where(~json_type(F.col("v")).isin("object", "array")).withColumn("t", cell_text(F.col("v")))
    values = scalar.where(test(F.col("t"))).select(*id_cols, "path", F.lit("value").alias("kind"), F.col("t").alias("text"))
    out = {"keys": keys, "values": values, "both": keys.unionByName(values)}[scope]
    return out if limit is None else out.orderBy(*id_cols, "path", "kind").limit(limit)


def newest(df: DataFrame, group: list[str], ts: str, n: int, since: Column | None = None) -> DataFrame:
    """The newest n rows of each group, or those not older than `since`."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(ts), *[c for c in df.columns if c not in (*group, ts)][:1]))
    keep = F.col("_n") <= n
    return df.withColumn("_n", place).where(keep if since is None else keep | (F.col(ts) >= since)).drop("_n")


def number_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated keys get #2, #3 in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("identity", F.when(n > 1, F.concat(F.col(key), F.lit(" #"), n.cast("string"))).otherwise(F.col(key)))


def first_per_key(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def islands(df: DataFrame, group: list[str], pos: str, changed: Column) -> DataFrame:
    """(group..., block, first, last, n): runs of consecutive rows that pass `changed`."""
    w = Window.partitionBy(*group).orderBy(pos)
    marked = df.withColumn("_c", F.coalesce(changed, F.lit(False)))
    starts = F.when(F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("_s", starts).withColumn("block", F.sum("_s").over(w)).where("_c")
    return runs.groupBy(*group, "block").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"))


def apportion(df: DataFrame, value: str, total: int, order: str) -> DataFrame:
    """Whole-number shares that add up to `total`, by largest remainder."""
    everything = Window.partitionBy()
    exact = F.col(value) * total / F.sum(value).over(everything)
    rows = df.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    left = total - F.sum("_f").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_e") - F.col("_f")), order))
    return rows.withColumns({"_l": left, "_p": place}).withColumn("share", (F.col("_f") + (F.col("_p") <= F.col("_l")).cast("long")).cast("long")).drop("_e", "_f", "_l", "_p")
