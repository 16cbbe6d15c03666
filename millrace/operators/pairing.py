"""Identities of unnamed records by what they are attached to, from a dictionary of rules (K3, 2.17).

An identity may name other records' identities, which name others again. All references are looked up
once, as an edge table; then each round settles the records whose references are settled. Records
that wait for each other in a loop are settled together, with `?` for what they wait for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_type
from ..functions.network import cidr_in_parent
from .cut import written

# Ids inside other text, and long hexadecimal numbers.
EMBEDDED_ID = (
    r"\b(?:sg|subnet|vpc|rtb|acl|igw|eigw|nat|eni|vpce|vpce-svc|tgw|tgw-attach|tgw-rtb|pcx|i|vol|snap|ami|eipalloc|eipassoc|lt|cvpn-endpoint|vgw|cgw|vpn|dopt|fl|pl|sgr|rtbassoc|aclassoc|lb|tg)-[0-9a-f]{8,17}\b"
)
HEX = r"(?<![0-9a-z])[0-9a-f]{8,}(?![0-9a-z])"

PART = "struct<kind:string,values:array<string>>"


def values_at_steps(v: Column, path: str) -> Column:
    """The scalars at a dotted path of a VARIANT as text, lists on the way gone through; nulls and empty text left out."""
    listed = lambda n: F.when(json_type(n) == "array", F.try_variant_get(n, "$", "array<variant>")).otherwise(F.array(n))
    found = F.array(v)
    for step in path.split("."):
        quoted = step.replace("'", "\\'")
        found = F.array_compact(F.flatten(F.transform(found, lambda n: F.transform(listed(n), lambda x: F.try_variant_get(x, f"$['{quoted}']", "variant")))))  # noqa: B023
    flat = F.flatten(F.transform(found, listed))
    plain = F.filter(flat, lambda x: json_type(x).isin("string", "number", "boolean"))
    return F.filter(F.transform(plain, lambda x: F.try_variant_get(x, "$", "string")), lambda t: t != "")


def _part(v: Column, part: str) -> Column:
    """One part of a rule as (kind, values)."""
    one = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    kind, values = "text", None
    if part == "main":
        values = one(F.exists(F.try_variant_get(v, "$.Associations", "array<struct<Main:boolean>>"), lambda a: a["Main"]), "main")
    elif part == "default":
        values = one(F.try_variant_get(v, "$.IsDefault", "boolean"), "default")
    elif part.startswith("="):
        values = F.array(F.lit(part[1:]))
    elif part == "cidr_in_vpc":
        kind, values = "cidr", values_at_steps(v, "CidrBlock")
    elif part.startswith("ref:"):
        kind, values = "ref", values_at_steps(v, part[4:])
    else:
        values = values_at_steps(v, part)
    return F.struct(F.lit(kind).alias("kind"), values.alias("values")).cast(PART)


def rule_parts(kind: Column, v: Column, rules: dict[str, list[str]]) -> Column:
    """The parts that pair an unnamed record of a type, compiled from the rules; NULL for types without a rule.

    rules: type -> parts: a field (dots go into lists), `ref:` and a field that holds another record's
    id, `main` or `default`, `cidr_in_vpc`, or `=` and a text.
    """
    out = F.lit(None).cast(f"array<{PART}>")
    for name, parts in rules.items():
        if parts:
            out = F.when(kind == name, F.array(*[_part(v, p) for p in parts])).otherwise(out)
    return out


def paired_identities(entries: DataFrame, parents: dict[str, str], vpc_type: str = "ec2/vpcs", clean: Callable[[Column], Column] = F.lower) -> DataFrame:
    """`entries` and `identity`, one that does not depend on generated ids (K3).

    entries: label, type, id, name, fields, default, vpc, parent, own, cidrs as of `describe`, and parts
    as of `rule_parts`. A record goes by its cleaned name; else, if it has parts, by those alone; else
    by its key fields, or `default`. parents names the parent type of a type: a record with a parent
    lies inside its identity and has none if that has none; any other record with a VPC lies inside
    the VPC's identity, or `vpc?`. A part that refers to an unknown record, to one without an identity
    or to the record itself reads `?`; so does every reference inside a loop. Ids shared by several
    records of a label mean the smallest (type, id). Repeated rows get the same identity.
    """
    key = F.to_json(F.struct("label", "type", "id"))
    columns = ["name", "fields", "default", "vpc", "parent", "own", "cidrs", "parts"]
    e = entries.withColumn("key", key)
    rows = e.groupBy("key").agg(*[F.first(c).alias(c) for c in ("label", "type", "id", *columns)])
    named = F.col("name").isNotNull() & (F.col("name") != "")
    rows = written(rows.withColumn("parts", F.when(~named & (F.size("parts") > 0), F.col("parts"))))
    upper = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv]) if parents else F.create_map(F.lit("").cast("string"), F.lit("").cast("string"))
    place = F.struct("type", "id", "key").alias("place")
    by_own = rows.select("label", F.explode("own").alias("value"), place).groupBy("label", "value").agg(F.min("place")["key"].alias("dep"))
    refs = rows.select("key", "label", F.posexplode("parts").alias("slot", "part")).where("part.kind = 'ref'").select("key", "label", "slot", F.posexplode("part.values").alias("n", "value"))
    refs = refs.join(by_own, ["label", "value"]).where("dep <> key").select("key", "slot", "n", "dep")
    at = rows.select("label", F.col("type").alias("_type"), F.col("id").alias("_id"), F.col("key").alias("dep"))
    has_parent = F.try_element_at(upper, F.col("type")).isNotNull() & F.col("parent").isNotNull()
    to_parent = rows.where(has_parent).select("key", "label", F.try_element_at(upper, F.col("type")).alias("_type"), F.col("parent").alias("_id")).join(at, ["label", "_type", "_id"]).select("key", F.lit(-1).alias("slot"), F.lit(0).alias("n"), "dep")
    to_vpc = rows.where(F.col("vpc").isNotNull()).select("key", "label", F.lit(vpc_type).alias("_type"), F.col("vpc").alias("_id")).join(at, ["label", "_type", "_id"]).where("dep <> key").select("key", F.lit(-2).alias("slot"), F.lit(0).alias("n"), "dep")
    edges = written(refs.union(to_parent).union(to_vpc))
    blocks = rows.where(F.col("type") == vpc_type).select("label", F.col("id").alias("vpc"), F.col("cidrs").alias("_blocks"))
    joined = lambda names: F.array_join(F.array_sort(names), "+")
    text = lambda p: joined(F.transform(p["values"], lambda t: F.regexp_replace(F.regexp_replace(clean(t), EMBEDDED_ID, "*"), HEX, "*")))
    cidr = lambda p: F.array_join(F.transform(p["values"], lambda t: F.coalesce(cidr_in_parent(t, F.col("_blocks")), F.lit("outside-vpc"))), "|")
    # What does not wait for other records is made once; a round then puts in references only.
    known = F.transform("parts", lambda p: F.struct(F.when(p["kind"] == "cidr", cidr(p)).when(p["kind"] == "text", text(p)).alias("said"), F.when(p["kind"] == "ref", F.size(p["values"])).alias("refs")))
    base = F.when(F.col("name").isNotNull() & (F.col("name") != ""), clean(F.col("name"))).when(F.col("parts").isNull(), F.coalesce("fields", F.when(F.col("default"), "default")))
    rows = rows.join(blocks, ["label", "vpc"], "left").select("key", base.alias("base"), known.alias("known"), has_parent.alias("child"), F.col("vpc").isNotNull().alias("inside"))
    rows = written(rows)
    found_type = "array<struct<slot:int,n:int,identity:string>>"

    def settle(ready: DataFrame, settled: DataFrame | None) -> DataFrame:
        """(key, identity) of `ready` (key)."""
        own = rows.join(ready, "key", "left_semi")
        if settled is None:
            own = own.withColumn("found", F.array().cast(found_type))
        else:
            met = edges.join(ready, "key", "left_semi").join(settled.withColumnRenamed("key", "dep"), "dep").groupBy("key").agg(F.collect_list(F.struct("slot", "n", "identity")).alias("found"))
            own = own.join(met, "key", "left").withColumn("found", F.coalesce("found", F.array().cast(found_type)))
        of = lambda slot, n: F.get(F.filter("found", lambda x: (x["slot"] == slot) & (x["n"] == n)), 0)["identity"]
        # refs is null for other parts and 0 where the field is missing
        numbers = lambda p: F.when(p["refs"] > 0, F.sequence(F.lit(0), p["refs"] - 1)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform("known", lambda p, i: F.coalesce(p["said"], joined(F.transform(numbers(p), lambda n: F.coalesce(of(i, n), F.lit("?"))))))
        by_parts = F.nullif(F.array_join(F.filter(pieces, lambda t: t != ""), "|"), F.lit(""))
        name = F.coalesce("base", by_parts)
        identity = F.when(F.col("child"), F.concat(of(-1, 0), F.lit("/"), name)).when(F.col("inside"), F.concat(F.coalesce(of(-2, 0), F.lit("vpc?")), F.lit("/"), name)).otherwise(name)
        return own.select("key", identity.alias("identity"))

    waiting, settled = rows.select("key"), None
    while not waiting.isEmpty():
        blocked = edges.join(waiting.withColumnRenamed("key", "dep"), "dep", "left_semi").select("key").distinct()
        ready = written(waiting.join(blocked, "key", "left_anti"))
        if ready.isEmpty():
            # Only loops and what hangs on them wait: take the core that others in it wait for.
            ready, before = waiting, -1
            while (size := ready.count()) != before:
                before = size
                asked = edges.join(ready, "key", "left_semi").select(F.col("dep").alias("key")).distinct()
                ready = written(ready.join(asked, "key", "left_semi"))
        new = settle(ready, settled)
        settled = written(new if settled is None else settled.union(new))
        waiting = written(waiting.join(ready, "key", "left_anti"))
    out = e.join(settled, "key", "left") if settled is not None else e.withColumn("identity", F.lit(None).cast("string"))
    return out.select(*entries.columns, "identity")
