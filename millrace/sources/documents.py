"""JSON documents, JSON Lines, text files, pages, envelopes and the walk over nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json import json_type, parse, parse_whole


def walk(df: DataFrame, id_cols: list[str], value_col: str) -> DataFrame:
    """Every value below each row's VARIANT: id columns, path, key, depth, v; the root has path ''.

    A recursive query: one step a level, all rows of a level at once. Object members extend the
    path by `.key`, list elements by `[n]`.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default counts rows of the whole walk
    ids = ", ".join(f"`{c}`" for c in id_cols)
    own = ", ".join(f"w.`{c}`" for c in id_cols)
    return spark.sql(
        f"""
        WITH RECURSIVE w({ids}, path, key, depth, v) AS (
          SELECT {ids}, '', CAST(NULL AS STRING), 0, `{value_col}` FROM {{df}}
          UNION ALL
          SELECT {own}, w.path || coalesce('.' || e.key, '[' || e.pos || ']'), e.key, w.depth + 1, e.value
          FROM w, LATERAL variant_explode(w.v) e)
        SELECT * FROM w""",
        df=df,
    )


def leaves(df: DataFrame, id_cols: list[str], value_col: str) -> DataFrame:
    """The scalars of the walk, with their text."""
    w = walk(df, id_cols, value_col).where("v IS NOT NULL")
    return w.where(~json_type(F.col("v")).isin("object", "array")).withColumn("text", F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("null")))


def explode_variant(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, key, value): the members of an object or the elements of a list; others give no row."""
    own = "".join(f"d.`{c}`, " for c in keep)
    return df.sparkSession.sql(f"SELECT {own}e.pos, e.key, e.value FROM {{d}} d, LATERAL variant_explode({value}) e", d=df)


def document_rows(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., key, pos, value) of JSON documents held as text (A1).

    An array root gives a row for each element; an object root a row for each key, and lists below
    a key are split into their elements; a scalar root gives one row.
    """
    docs = df.select(*keep, parse(text_col).alias("j"))
    top = explode_variant(docs, "d.j", keep).select(*keep, F.col("key"), F.col("pos").cast("long").alias("pos"), "value")
    lists = json_type(F.col("value")) == "array"
    whole = top.where(F.col("key").isNull() | ~lists)
    whole = whole.withColumn("pos", F.when(F.col("key").isNull(), F.col("pos")).otherwise(F.lit(0).cast("long")))
    parts = top.where(F.col("key").isNotNull() & lists).withColumnsRenamed({"key": "outer", "pos": "at"})
    split = explode_variant(parts, "d.value", [*keep, "outer"]).select(*keep, F.col("outer").alias("key"), F.col("pos").cast("long").alias("pos"), "value")
    scalar = docs.where(F.col("j").isNotNull() & ~json_type(F.col("j")).isin("array", "object"))
    scalar = scalar.select(*keep, F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("pos"), F.col("j").alias("value"))
    return whole.unionByName(split).unionByName(scalar)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """A1 for files: one document a file, gzip by its extension (A4)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), strip_noise(F.regexp_replace("value", "^﻿", "")).alias("text"))
    return document_rows(files, "text", ["file"])


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with comments, single quotes, unquoted keys and NaN."""
    options = {"allowComments": True, "allowUnquotedFieldNames": True, "allowSingleQuotes": True, "allowNonNumericNumbers": True, "multiLine": True}
    return spark.read.options(**options).schema(schema).json(path)


def numbered_lines(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., line_no from 1, line) of whole texts."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    rows = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    return rows.select(*keep, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def split_json_lines(df: DataFrame, text_col: str, keep: list[str], shown: int | None = None, width: int = 120) -> tuple[DataFrame, DataFrame]:
    """Good lines (keep..., line_no, value) and bad ones (keep..., line_no, excerpt) of JSON Lines texts (A2).

    Blank lines are skipped; a line that goes on after its value is bad; of the bad lines of a text the
    first `shown` are listed (None: all).
    """
    lines = numbered_lines(df, text_col, keep).where(F.trim("line") != "").withColumn("value", parse_whole("line"))
    good = lines.where("value IS NOT NULL").select(*keep, "line_no", "value")
    bad = lines.where("value IS NULL")
    if shown is not None:
        nth = F.row_number().over(Window.partitionBy(*keep).orderBy("line_no"))
        bad = bad.withColumn("nth", nth).where(F.col("nth") <= shown)
    return good, bad.select(*keep, "line_no", F.substring("line", 1, width).alias("excerpt"))


def detect_format(name: Column, text: Column) -> Column:
    """jsonl by the name, or where the first non-empty line is a whole JSON value and another line follows; else json (A3)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    whole = parse_whole(F.get(lines, 0)).isNotNull() & (F.size(lines) > 1)
    return F.when(F.lower(name).rlike(r"\.(jsonl|ndjson)(\.gz)?$") | F.coalesce(whole, F.lit(False)), "jsonl").otherwise("json")


def strip_noise(text: Column) -> Column:
    """Text from the first line that starts with a bracket; unchanged if there is none (A5)."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*[\[{][\s\S]*", 0)
    return F.when(found != "", found).otherwise(text)


# Keys that stand beside a page of records.
PAGING_KEYS = ("NextToken", "nextToken", "NextMarker", "Marker", "nextLink", "@odata.nextLink", "IsTruncated", "ResponseMetadata", "kind", "apiVersion", "metadata")


def unwrap_records(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., path, value): the records in a CLI envelope.

    Reservations[].Instances[], value[], items[], a bare list, or the one list beside paging keys.
    """
    docs = df.select(*keep, parse(text_col).alias("j"))
    top = explode_variant(docs, "d.j", keep).withColumnsRenamed({"key": "k", "pos": "i", "value": "v"})
    bare = top.where("k IS NULL").select(*keep, F.concat(F.lit("["), F.col("i"), F.lit("]")).alias("path"), F.col("v").alias("value"))
    named = top.where(F.col("k").isNotNull() & ~F.col("k").isin(*PAGING_KEYS))
    lists = named.where(json_type(F.col("v")) == "array")
    inner = explode_variant(lists, "d.v", [*keep, "k"]).withColumnRenamed("value", "v2")
    nested = inner.where(F.col("k") == "Reservations")
    deep = explode_variant(nested.drop("key").withColumnRenamed("pos", "i"), "variant_get(d.v2, '$.Instances', 'variant')", [*keep, "i"])
    deep = deep.select(*keep, F.concat(F.lit("Reservations["), F.col("i"), F.lit("].Instances["), F.col("pos"), F.lit("]")).alias("path"), "value")
    flat = inner.where(F.col("k") != "Reservations").select(*keep, F.concat("k", F.lit("["), F.col("pos"), F.lit("]")).alias("path"), F.col("v2").alias("value"))
    return bare.unionByName(deep).unionByName(flat)


def merge_pages(df: DataFrame, doc: list[str], page: str, text_col: str) -> DataFrame:
    """(doc..., key, elements, value): pages of one document merged.

    Lists of one key are joined in page order (elements, as JSON texts); other keys keep the first
    page's value; paging keys are dropped; a key that is a list on one page and not on another raises.
    """
    top = explode_variant(df.select(*doc, page, parse(text_col).alias("j")), "d.j", [*doc, page])
    top = top.where(~F.col("key").isin(*PAGING_KEYS)).withColumn("is_list", json_type(F.col("value")) == "array")
    items = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.to_json(x))
    parts = top.select(*doc, page, "key", "is_list", items.alias("items"), F.to_json("value").alias("text"))
    merged = parts.groupBy(*doc, "key").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_list"), F.struct(page, "items")))).alias("lists"),
        F.min_by("text", page).alias("first"), F.min("is_list").alias("all_lists"), F.max("is_list").alias("any_list"),
    )
    mixed = F.raise_error(F.concat(F.lit("list and other value under key "), F.col("key")))
    elements = F.when(F.col("all_lists") != F.col("any_list"), mixed.cast("array<string>")).when(F.col("any_list"), F.flatten(F.transform("lists", lambda x: x["items"])))
    return merged.select(*doc, "key", elements.alias("elements"), F.when(~F.col("any_list"), F.col("first")).alias("value"))


# Names of README files.
READMES = ("readme.md", "readme.txt", "readme.rst", "readme", "readme.adoc", "readme.markdown")


def library_kind(path: Column) -> Column:
    """pdf, yaml, json or readme by file name, case ignored; NULL for other files."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.isin(*READMES), "readme").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.ya?ml$"), "yaml").when(name.endswith(".json"), "json")


def read_library(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, modified, text, n_lines) of a repository's files of one kind; binary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(library_kind(F.col("path")) == kind)
    return files.select("path", F.col("modificationTime").alias("modified"), decode_text(F.col("content")).alias("text")).where("text IS NOT NULL").withColumn("n_lines", line_count(F.col("text")))


def decode_text(content: Column) -> Column:
    """UTF-8, or UTF-16 by its byte order mark; NULL for binary content, which holds a NUL (A4, A10)."""
    head = F.hex(F.substring(content, 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    text = F.regexp_replace(text, "^﻿", "")
    return F.when(F.instr(text, "\0") == 0, text)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))).cast("long")


# Block elements of pages.
BLOCKS = "p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|section|article|header|footer|pre|blockquote"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, blocks on lines, cells apart by tabs, no blank lines."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)</(td|th)\s*>", "\t")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, value in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(value))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def import_records(new: DataFrame, existing: DataFrame, url: str = "url", order: str = "pos") -> DataFrame:
    """New records with a plain http(s) URL, first of equal ones, that are not there yet."""
    host = F.parse_url(F.col(url), F.lit("HOST"))
    user = F.parse_url(F.col(url), F.lit("USERINFO"))
    valid = new.where(F.col(url).rlike("^https?://[^\\s]+$")).where(host.isNotNull() & user.isNull())
    same = F.lower(F.rtrim(F.split(F.col(url), "#")[0], F.lit("/")))
    valid = valid.withColumn("_same", same)
    first = F.row_number().over(Window.partitionBy("_same").orderBy(order))
    known = existing.select(same.alias("_same"))
    return valid.withColumn("_n", first).where("_n = 1").join(known, "_same", "left_anti").drop("_n", "_same")


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(account_id, region, type, resource_id, data) of root/account/region/type/id.json files.

    Every file holds `_meta` and `resource`.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(f"{root}", wholetext=True, pathGlobFilter="*.json")
    path = F.col("_metadata.file_path")
    part = lambda n: F.element_at(F.split(path, "/"), n)
    rows = files.select(part(-4).alias("account_id"), part(-3).alias("region"), part(-2).alias("type"), F.regexp_replace(part(-1), r"\.json$", "").alias("resource_id"), parse("value").alias("j"))
    return rows.select("account_id", "region", "type", "resource_id", F.try_variant_get("j", "$.resource", "variant").alias("data"))


def csv_cell(text: Column) -> Column:
    """A cell as CSV: quoted if it holds a quote, comma, line end or edge space."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]|^\\s|\\s$'), quoted).otherwise(text)


def csv_row(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.coalesce(c, F.lit(""))) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CRLF rows with a header, one file a partition."""
    df.select(*columns).write.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON rows, minified."""
    df.write.json(path)


def pretty_json(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true"})


def nest_account(df: DataFrame) -> DataFrame:
    """(account_id, doc): one JSON document an account, region by region, type by type.

    df: account_id, region, type, resource_id, data (JSON text).
    """
    per_type = df.groupBy("account_id", "region", "type").agg(F.array_sort(F.collect_list(F.struct("resource_id", "data"))).alias("items"))
    per_region = per_type.groupBy("account_id", "region").agg(F.array_sort(F.collect_list(F.struct("type", "items"))).alias("types"))
    parts = F.array_sort(F.collect_list(F.struct("region", F.to_json(F.map_from_entries("types")).alias("j"))))
    member = lambda x: F.concat(F.lit('"'), x["region"], F.lit('":'), x["j"])
    nested = per_region.groupBy("account_id").agg(parts.alias("r"))
    return nested.select("account_id", F.concat(F.lit("{"), F.array_join(F.transform("r", member), ","), F.lit("}")).alias("doc"))


def store_snapshot(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    """Snapshots with digest and sizes; more than 20 labels or a label over 200 characters raises."""
    bad = (F.size(labels) > 20) | F.exists(F.map_values(labels), lambda v: F.char_length(v) > 200)
    checked = F.when(bad, F.raise_error(F.lit("labels: at most 20, of at most 200 characters")).cast("map<string,string>")).otherwise(F.col(labels))
    return df.withColumns({labels: checked, "sha256": F.sha2(text, 256), "n_bytes": F.octet_length(text).cast("long"), "n_chars": F.char_length(text).cast("long")})
