"""Edits of nested JSON values at any depth: set, delete, update assignment and redaction (§2.16, O4).

A value is opened from the root only along the paths of its edits, one level a step, each row carrying
the edits that remain below it; everything else stays a closed piece of JSON text. Then the pieces are
put together again from the deepest level upwards, one grouping by parent a level. Steps of a path are
strings: `.key` for a member, `[n]` for an element, from the end if n is negative.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_type
from ..functions.secrets import kind_by, plain_key
from .cut import written

#: A function of steps, key, the nearest key from here to the root and value that gives the value's new text.
Change = Callable[[Column, Column, Column, Column], Column]
# Fixed value: levels of a document that are rewritten inside its row; deeper ones are opened into rows.
LEVELS = 8

EDIT = "struct<steps:array<string>,op:string,value:variant>"


def edit(steps: Column, op: str, value: Column | None = None) -> Column:
    """One edit: op is `set` or `delete`."""
    return F.struct(steps.cast("array<string>").alias("steps"), F.lit(op).alias("op"), (F.lit(None) if value is None else value).cast("variant").alias("value"))


def _json_string(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def _place(step: Column) -> Column:
    """n of a step `[n]`."""
    return F.regexp_extract(step, r"^\[(-?\d+)\]$", 1).try_cast("int")


def _opened(rows: DataFrame) -> DataFrame:
    """Rows (path, v, edits) with their exact edits done, and `deeper`, the edits that remain, places from the end resolved."""
    exact = F.filter("edits", lambda e: F.size(e["steps"]) == 0)
    last = F.try_element_at(exact, F.lit(-1))
    rows = rows.withColumns({"v": F.when(last["op"] == "set", last["value"]).otherwise(F.col("v")), "gone": F.coalesce(last["op"] == "delete", F.lit(False)), "deeper": F.filter("edits", lambda e: F.size(e["steps"]) > 0)})
    kind = F.when(F.col("v").isNull() | F.is_variant_null("v"), "null").otherwise(json_type(F.col("v")))
    rows = rows.withColumn("kind", kind).withColumn("n", F.when(kind == "array", F.array_size(F.try_variant_get("v", "$", "array<variant>"))).otherwise(0))
    first = lambda e: F.element_at(e["steps"], 1)
    number = lambda e: F.when(_place(first(e)) < 0, _place(first(e)) + F.col("n")).otherwise(_place(first(e)))
    is_key = lambda e: first(e).startswith(".")
    wrong = lambda e: F.when(is_key(e), ~F.col("kind").isin("object", "null")).otherwise(~F.col("kind").isin("array", "null") | _place(first(e)).isNull() | ((e["op"] == "set") & (number(e) < 0)))
    some = F.exists("deeper", lambda e: (e["op"] == "set") & is_key(e)) & F.exists("deeper", lambda e: (e["op"] == "set") & ~is_key(e))
    rows = rows.withColumn("bad", ~F.col("gone") & (F.exists("deeper", wrong) | (some & (F.col("kind") == "null"))))
    resolved = F.transform("deeper", lambda e: F.struct(F.when(is_key(e), e["steps"]).otherwise(F.concat(F.array(F.concat(F.lit("["), number(e).cast("string"), F.lit("]"))), F.slice(e["steps"], F.lit(2), F.size(e["steps"])))).alias("steps"), e["op"].alias("op"), e["value"].alias("value")))
    # A deletion below nothing does nothing.
    useful = F.filter(resolved, lambda e: (e["op"] == "set") | (F.col("kind") != "null"))
    deeper = F.when(F.col("gone") | F.col("bad"), F.array().cast(f"array<{EDIT}>")).otherwise(useful)
    return rows.withColumn("deeper", deeper)


def apply_edits(df: DataFrame, ids: list[str], value_col: str, edits: Column) -> DataFrame:
    """(ids, value) of every row with its edits applied; edits: array of `edit`, null or empty for none.

    All paths are those of the value as given, so deletions do not move each other's places. Of edits
    of one path the last counts; below a set value, deeper edits apply to what was set. A set path is
    made where it is missing: members, and elements with nulls before them. Deleting what is missing
    changes nothing. An edit that does not fit (a member of a list, a place before the first) makes
    the row's value NULL. A missing value counts as null. Rows stay apart whatever their ids.
    """
    base = df.select(*ids, F.col(value_col).alias("v"), F.coalesce(edits.cast(f"array<{EDIT}>"), F.array().cast(f"array<{EDIT}>")).alias("edits"))
    depth = base.agg(F.max(F.aggregate("edits", F.lit(0), lambda m, e: F.greatest(m, F.size(e["steps"]))))).first()[0] or 0
    level = base.select(F.monotonically_increasing_id().alias("_row"), F.struct(*ids).alias("ids"), F.array().cast("array<string>").alias("path"), "v", "edits")
    keep = ["_row", "ids", "path"]
    pieces: list[list[DataFrame]] = [[] for _ in range(depth + 2)]  # by length of path
    first = lambda e: F.element_at(e["steps"], 1)
    none = F.array().cast("array<struct<step:string,v:variant>>")
    for d in range(depth + 1):
        level = written(_opened(level).select(*keep, "v", "kind", "gone", "bad", "deeper"))
        closed = level.where(F.size("deeper") == 0)
        pieces[d].append(closed.select(*keep, F.when(~F.col("gone"), F.coalesce(F.to_json("v"), F.lit("null"))).alias("text"), "bad"))
        opened = level.where(F.size("deeper") > 0)
        # The mark of a container, which stays even if nothing is left in it.
        mark = F.when(F.exists("deeper", lambda e: first(e).startswith(".")), "{").otherwise("[")
        pieces[d + 1].append(opened.select("_row", "ids", F.concat("path", F.array(F.lit(""))).alias("path"), mark.alias("text"), F.lit(False).alias("bad")))
        members = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda m: F.struct(F.concat(F.lit("."), m["key"]).alias("step"), m["value"].alias("v")))
        elements = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), x.alias("v")))
        present = F.coalesce(F.when(F.col("kind") == "object", members).when(F.col("kind") == "array", elements), none)
        asked = F.array_distinct(F.transform(F.filter("deeper", lambda e: e["op"] == "set"), first))
        made = F.transform(F.array_except(asked, F.transform("present", lambda c: c["step"])), lambda s: F.struct(s.alias("step"), F.lit(None).cast("variant").alias("v")))
        children = opened.withColumn("present", present).withColumn("child", F.explode(F.concat("present", made)))
        below = F.transform(F.filter("deeper", lambda e: first(e) == F.col("child.step")), lambda e: F.struct(F.slice(e["steps"], F.lit(2), F.size(e["steps"])).alias("steps"), e["op"].alias("op"), e["value"].alias("value")))
        level = children.select("_row", "ids", F.concat("path", F.array("child.step")).alias("path"), F.col("child.v").alias("v"), below.alias("edits"))
    up = None
    for d in range(depth, -1, -1):
        here = reduce(DataFrame.union, pieces[d] + ([up] if up is not None else []))
        if d == 0:
            up = here
            break
        piece = F.struct(_place(F.element_at("path", -1)).alias("n"), F.element_at("path", -1).alias("step"), "text")
        together = here.groupBy("_row", F.slice("path", 1, d - 1).alias("path")).agg(F.first("ids").alias("ids"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("bad").alias("bad"))
        named = F.filter("pieces", lambda p: (p["step"] != "") & p["text"].isNotNull())
        body = F.array_join(F.transform(named, lambda p: F.concat(_json_string(F.substring(p["step"], F.lit(2), F.char_length(p["step"]))), F.lit(":"), p["text"])), ",")
        places = F.map_from_entries(F.transform(F.filter("pieces", lambda p: p["n"].isNotNull()), lambda p: F.struct(p["n"], F.coalesce(p["text"], F.lit("")))))
        top = F.array_max(F.transform("pieces", lambda p: p["n"]))
        listed = F.when(top.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.sequence(F.lit(0), top), lambda i: F.coalesce(F.try_element_at(places, i), F.lit("null"))), lambda t: t != ""))
        is_object = F.exists("pieces", lambda p: (p["step"] == "") & (p["text"] == "{"))
        text = F.when(is_object, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
        up = together.select("_row", "ids", "path", text.alias("text"), "bad")
    value = F.when(~F.col("bad"), F.try_parse_json(F.coalesce("text", F.lit("null"))))
    return up.select("ids.*", value.alias(value_col))


def _found(df: DataFrame, value_col: str) -> DataFrame:
    """Every value below the rows' VARIANT with its steps: (_id, steps, key, v)."""
    df.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default counts rows of the whole walk
    return df.sparkSession.sql(
        f"""
        WITH RECURSIVE w(_id, steps, key, v) AS (
          SELECT _id, CAST(array() AS ARRAY<STRING>), CAST(NULL AS STRING), `{value_col}` FROM {{df}}
          UNION ALL
          SELECT w._id, array_append(w.steps, coalesce('.' || e.key, '[' || e.pos || ']')), e.key, e.value FROM w, LATERAL variant_explode(w.v) e)
        SELECT * FROM w""",
        df=df,
    )


def _with_edits(df: DataFrame, ids: list[str], value_col: str, edits) -> DataFrame:
    """Edits found by `edits`, a function from the walk to (_id, edit), applied to each row."""
    named = df.select(*ids, value_col, F.struct(*ids).alias("_id"))
    own = edits(_found(named.select("_id", value_col), value_col)).groupBy("_id").agg(F.collect_list("edit").alias("_edits"))
    return apply_edits(named.join(own, "_id", "left"), ids, value_col, F.col("_edits"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rewritten(v: Column, steps: Column, key: Column, near: Column, change: Change, leaves: bool, left: int) -> Column:
    """JSON text of a value with `change` done at every value in it, inside the row; '' if it goes.

    change, over steps, key, near and v: NULL for no change, '' to delete, else the new text; leaves: it
    concerns scalars alone. NULL where lists and objects go on below `left` levels, or one is itself
    given another value.
    """
    text = F.lit(None).cast("string")
    child = lambda place, key, v: F.struct(place.alias("place"), key.alias("key"), v.alias("v"))
    entries = lambda m: F.struct(F.lit(True).alias("named"), F.transform(F.map_entries(m), lambda e, i: child(i, e["key"], e["value"])).alias("c"))
    elements = lambda a: F.struct(F.lit(False).alias("named"), F.transform(a, lambda x, i: child(i, text, x)).alias("c"))
    listed = _let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.when(a.isNotNull(), elements(a)))
    opened = _let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.when(m.isNotNull(), entries(m)).otherwise(listed))

    def joined(named: Column, parts: Column) -> Column:
        kept = F.filter(parts, lambda x: x["text"] != "")
        plain = lambda x: F.when(x["key"].rlike(r"^[\w-]*$"), F.concat(F.lit('"'), x["key"], F.lit('"'))).otherwise(_json_string(x["key"]))
        members = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda x: F.concat(plain(x), F.lit(":"), x["text"])), ","), F.lit("}"))
        return F.when(F.exists(parts, lambda x: x["text"].isNull()), None).when(named, members).otherwise(F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x["text"]), ","), F.lit("]")))

    def container(o: Column) -> Column:
        if left:
            below = lambda c: _rewritten(c["v"], F.concat(steps, F.array(F.coalesce(F.concat(F.lit("."), c["key"]), F.concat(F.lit("["), c["place"].cast("string"), F.lit("]"))))), c["key"], F.coalesce(c["key"], near), change, leaves, left - 1)
            out = _let(F.transform(o["c"], lambda c: F.struct(c["key"].alias("key"), below(c).alias("text"))), lambda parts: joined(o["named"], parts))
        else:
            out = F.when(F.size(o["c"]) == 0, F.when(o["named"], "{}").otherwise("[]"))
        return out if leaves else _let(change(steps, key, near, v), lambda new: F.when(new.isNull(), out).when(new == "", ""))

    scalar = F.coalesce(change(steps, key, near, v), F.to_json(v), F.lit("null"))
    return _let(opened, lambda o: F.when(o.isNull(), scalar).otherwise(container(o))).cast("string")


def _everywhere(df: DataFrame, ids: list[str], value_col: str, change: Change, leaves: bool, other: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row's value with `change` done inside the row; rows that this leaves open go through `other`."""
    spark, limit = df.sparkSession, "spark.sql.analyzer.maxIterations"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "2000")  # functions within functions are resolved one by one
    try:
        text = _rewritten(F.col("_v"), F.array().cast("array<string>"), *[F.lit(None).cast("string")] * 2, change, leaves, LEVELS)
        rows = df.select(*ids, F.col(value_col).alias("_v")).withColumn("_text", text)
    finally:
        spark.conf.set(limit, usual)
    done = written(rows.withColumn("_v", F.when(F.col("_text").isNull(), F.col("_v"))))
    out = done.where("_text IS NOT NULL").select(*ids, F.try_parse_json(F.when(F.col("_text") == "", "null").otherwise(F.col("_text"))).alias(value_col))
    rest = done.where("_text IS NULL").select(*ids, F.col("_v").alias(value_col))
    return out if rest.isEmpty() else out.union(other(rest))


def update_where(df: DataFrame, ids: list[str], value_col: str, where: Column | Callable, new: Column | Callable | None) -> DataFrame:
    """Update assignment at every value that `where` (over steps, key and v of the walk) holds for (§2.16).

    new: the new value, a VARIANT or scalar made of the same columns; None deletes the values. The ids
    must name the rows, without nulls. where and new are columns, or functions of (steps, key, v), which
    are done inside the rows, without a row for every value.
    """
    if callable(where):
        to = (lambda *x: F.lit("")) if new is None else lambda *x: F.coalesce(F.to_json(new(*x).cast("variant")), F.lit("null"))
        named = [F.col(c) for c in ("steps", "key", "v")]
        return _everywhere(df, ids, value_col, lambda steps, key, near, v: F.when(where(steps, key, v), to(steps, key, v)), False, lambda rest: update_where(rest, ids, value_col, where(*named), None if new is None else new(*named)))
    of = edit(F.col("steps"), "delete") if new is None else edit(F.col("steps"), "set", new)
    return _with_edits(df, ids, value_col, lambda w: w.where(where).select("_id", of.alias("edit")))


def redact(df: DataFrame, ids: list[str], value_col: str, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Documents whose secret strings at any depth read [REDACTED kind]; everything else as it was.

    An element of a list goes by the key of the list. The ids must name the rows, without nulls.
    """

    def change(steps: Column, key: Column, near: Column, v: Column) -> Column:
        text = F.when(F.schema_of_variant(v) == "STRING", F.struct(plain_key(near).alias("key"), F.try_variant_get(v, "$", "string").alias("text")))
        kind = _let(text, lambda x: F.when(x.isNotNull(), kind_by(x["key"], x["text"], rules)))
        return _let(kind, lambda k: F.when(k.isNotNull(), _json_string(F.concat(F.lit("[REDACTED "), k, F.lit("]")))))

    def other(rest: DataFrame) -> DataFrame:
        near = F.try_element_at(F.filter("steps", lambda s: s.startswith(".")), F.lit(-1))
        said = change(F.col("steps"), F.col("key"), F.substring(near, F.lit(2), F.char_length(near)), F.col("v"))
        return _with_edits(rest, ids, value_col, lambda w: w.withColumn("_said", said).where("_said IS NOT NULL").select("_id", edit(F.col("steps"), "set", F.try_parse_json("_said")).alias("edit")))

    return _everywhere(df, ids, value_col, change, True, other)
