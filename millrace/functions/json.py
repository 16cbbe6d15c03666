"""Cell semantics of JSON values held as VARIANT columns.

A missing value is SQL NULL; a JSON null is a variant null. Both are kept apart throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column | str) -> Column:
    return F.try_parse_json(text)


def parse_whole(text: Column | str) -> Column:
    """The value of a text that holds one JSON value and nothing else; `parse` stops after the first.

    In a list, a text that goes on has a second element or closes the list itself; the latter does not
    fit into an object.
    """
    text = F.col(text) if isinstance(text, str) else text
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & member.isNotNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def json_type(v: Column) -> Column:
    """string, number, boolean, null, array or object; NULL where the value is missing."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(F.is_variant_null(v), "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def get_path(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a JSON path such as $.a[0].b; NULL where there is none."""
    return F.try_variant_get(v, path, kind)


def field(v: Column, key: str) -> Column:
    """A literal key wins over a dotted path; `x.length` of a list is its size (B1)."""
    quoted = key.replace("'", "\\'")
    out = [F.try_variant_get(v, f"$['{quoted}']", "variant")]
    parts = key.split(".")
    if len(parts) > 1:
        path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)
        out.append(F.try_variant_get(v, path, "variant"))
        if parts[-1] == "length":
            head = "$" + "".join(f"['{p}']" for p in parts[:-1])
            size = F.array_size(F.try_variant_get(v, head, "array<variant>"))
            out.append(F.try_parse_json(size.cast("string")))
    return F.coalesce(*out)


def number_text(text: Column) -> Column:
    """Numbers as JavaScript prints them: no trailing .0, exponents from 1e21 and below 1e-6."""
    n = text.try_cast("double")
    exponent = F.regexp_replace(F.regexp_replace(F.upper(n.cast("string")), r"\.0E", "E"), r"E(\d)", "E+$1")
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("decimal(20,0)").cast("string"))
    shown = F.when((F.abs(n) >= 1e21) | ((F.abs(n) < 1e-6) & (n != 0)), F.lower(exponent))
    decimal = n.cast("decimal(38,17)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(decimal, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(shown, whole, F.when(n.cast("string").contains("E"), trimmed), n.cast("string"), text)


def cell_text(v: Column) -> Column:
    """Text of a table cell: missing is empty, null is `null`, lists of scalars are joined by `, `,
    lists with containers are counted, objects are compact JSON (B5)."""
    kind = json_type(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    scalar = lambda x: F.coalesce(
        F.when(F.is_variant_null(x), "null"), F.when(json_type(x) == "number", number_text(F.to_json(x))), F.try_variant_get(x, "$", "string")
    )
    nested = F.exists(items, lambda x: json_type(x).isin("array", "object"))
    listed = F.when(nested, F.concat(F.lit("["), F.array_size(items).cast("string"), F.lit(" items]"))).otherwise(F.array_join(F.transform(items, scalar), ", "))
    return (
        F.when(v.isNull(), "")
        .when(kind == "null", "null")
        .when(kind == "object", F.to_json(v))
        .when(kind == "array", listed)
        .when(kind == "number", number_text(F.to_json(v)))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def preview(v: Column, size: int = 120) -> Column:
    """One line of a value, cut at `size` characters with an ellipsis."""
    text = F.regexp_replace(cell_text(v), r"\s+", " ")
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def tags_map(v: Column) -> Column:
    """Tags as a map, from [{Key, Value}] lists or objects under the usual names."""
    lists = [F.try_variant_get(v, f"$.{k}", "array<struct<Key:string,Value:string>>") for k in ("Tags", "TagSet", "tags")]
    as_map = [F.map_from_entries(F.filter(x, lambda e: e["Key"].isNotNull())) for x in lists]
    objects = [F.try_variant_get(v, f"$.{k}", "map<string,string>") for k in ("Tags", "tags", "metadata.labels", "labels")]
    return F.coalesce(*as_map, *objects, F.create_map().cast("map<string,string>"))


# Keys that name a thing, in order.
NAME_KEYS = ("Name", "name", "displayName")
ID_KEYS = (
    "InstanceId", "VpcId", "SubnetId", "GroupId", "VolumeId", "SnapshotId", "ImageId", "NetworkInterfaceId",
    "DBInstanceIdentifier", "FunctionName", "BucketName", "ClusterName", "LoadBalancerName", "Arn", "id", "Id",
)


def display_name(v: Column) -> Column:
    """Name tag, name keys, metadata.name, id keys in order, else any key that ends in Id, Arn or Name."""
    text = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    direct = [text(f"$.{k}") for k in NAME_KEYS] + [text("$.metadata.name")] + [text(f"$.{k}") for k in ID_KEYS]
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = F.filter(entries, lambda e: e["key"].rlike("(Id|Arn|Name)$") & (json_type(e["value"]) == "string"))
    other = F.try_variant_get(F.get(F.transform(named, lambda e: e["value"]), 0), "$", "string")
    return F.coalesce(F.nullif(F.element_at(tags_map(v), "Name"), F.lit("")), *direct, F.nullif(other, F.lit("")))


def string_kind(c: Column) -> Column:
    """date, url, arn, resource id, ip or string; longer than 2048 characters is a string."""
    return (
        F.when(c.isNull(), None)
        .when(F.char_length(c) > 2048, "string")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), "date")
        .when(c.rlike(r"^https?://\S+$"), "url")
        .when(c.rlike(r"^arn:[\w-]*:"), "arn")
        .when(c.rlike(r"^[a-z]{1,12}-[0-9a-f]{8,17}$"), "resource id")
        .when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$"), "ip")
        .otherwise("string")
    )


# Status words.
GOOD = ("running", "succeeded", "success", "successful", "available", "active", "ready", "healthy", "ok", "in-use", "in_use", "enabled", "completed", "complete", "bound", "true",
        "online", "attached", "associated", "issued", "create_complete", "update_complete", "deployed", "passing", "vm running")
WARN = ("stopped", "stopping", "pending", "creating", "updating", "deleting", "starting", "rebooting", "modifying", "deallocated", "deallocating", "provisioning", "in_progress",
        "in-progress", "warning", "degraded", "impaired", "inactive", "shutting-down", "unknown", "detaching", "attaching", "vm deallocated", "vm stopped")
BAD = ("terminated", "failed", "failure", "error", "errored", "deleted", "unhealthy", "disabled", "critical", "rejected", "crashloopbackoff", "create_failed", "rollback_complete",
       "lost", "evicted", "offline")


def status_tone(key: Column, value: Column) -> Column:
    """good, warn or bad for the values of status-like keys; NULL otherwise."""
    like = F.lower(key).rlike("(status|state|health|phase)$")
    v = F.lower(value)
    return F.when(like & v.isin(*GOOD), "good").when(like & v.isin(*WARN), "warn").when(like & v.isin(*BAD), "bad")


def arn_type(c: Column) -> Column:
    """service:type of an ARN."""
    parts = F.split(c, ":")
    kind = F.split(F.get(parts, 5), "[/:]")
    return F.when(F.size(parts) >= 6, F.concat_ws(":", F.get(parts, 2), F.when(F.size(kind) > 1, F.get(kind, 0))))


def id_forms(c: Column) -> Column:
    """The forms by which an id may be referred to: whole, after the last colon, after the last slash."""
    return F.array_distinct(F.array(c, F.element_at(F.split(c, ":"), -1), F.element_at(F.split(c, "/"), -1)))


def find_ids(text: Column, pattern: str) -> Column:
    """All different ids of a pattern anywhere in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))


def resource_id(v: Column, fields: list[str]) -> Column:
    """The first configured id field, else 16 hex digits of the SHA-1 of the canonical JSON."""
    own = [F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")) for f in fields]
    return F.coalesce(*own, F.substring(F.sha1(F.to_json(v)), 1, 16))


def format_path(path: Column, style: str = "js") -> Column:
    """A walk path (a.b[0]) in js, jq or JMESPath form."""
    return {"js": F.concat(F.lit("$."), path), "jq": F.concat(F.lit("."), path), "jmes": path}[style]


def parse_path(text: Column) -> Column:
    """The steps (`.key`, `[n]`) of a path such as `a.b[0]`, `.a["x y"]`, `$.a.'0'` or `a.0`; NULL for other text."""
    rest = F.regexp_replace(F.trim(text), r"^[$@.]?(?=\.|\[|$)", "")
    name, number, quoted = r"\.?[A-Za-z_$][\w$-]*", r"\[\s*\d+\s*\]|\.\d+", r"""\.?\[\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')\s*\]|\.?"(?:[^"\\]|\\.)*\""""
    parts = F.regexp_extract_all(rest, F.lit(rf"\s*(?:{number}|{name}|{quoted})"), F.lit(0))
    inner = lambda p: F.regexp_extract(p, r"""(?s)^\s*\.?\[?\s*(["'].*["'])\s*\]?$""", 1)
    single = lambda p: F.regexp_replace(F.regexp_extract(inner(p), "(?s)^'(.*)'$", 1), r"\\'", "'")
    key = lambda p: F.when(inner(p).startswith("'"), single(p)).when(inner(p) != "", F.try_variant_get(F.try_parse_json(inner(p)), "$", "string")).otherwise(F.regexp_replace(p, r"^\s*\.?", ""))
    step = lambda p: F.when(p.rlike(rf"^\s*(?:{number})$"), F.concat(F.lit("["), F.regexp_replace(p, r"\D", ""), F.lit("]"))).otherwise(F.concat(F.lit("."), key(p)))
    return F.when(rest.isin("", "."), F.array().cast("array<string>")).when(F.array_join(parts, "") == rest, F.transform(parts, step))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def parse_embedded(text: Column) -> Column:
    """A string that itself holds JSON, URL-encoded or not, as a value; NULL for other text."""
    decoded = F.when(text.contains("%7B") | text.contains("%5B"), F.try_url_decode(text)).otherwise(text)
    return F.when(F.trim(decoded).rlike(r"^[\[{]"), F.try_parse_json(decoded))


def values_at(walked: Column, path: str) -> Column:
    """Whether a walk path is the dotted path, lists on the way gone through."""
    return F.regexp_replace(walked, r"\[\d+\]", "") == "." + path


def type_order(v: Column) -> Column:
    """Place of a value's kind in the total order null, false, true, number, string, array, object (§2.16)."""
    kind = json_type(v)
    truth = F.when(F.try_variant_get(v, "$", "boolean"), 2).otherwise(1)
    return F.when(kind == "null", 0).when(kind == "boolean", truth).when(kind == "number", 3).when(kind == "string", 4).when(kind == "array", 5).when(kind == "object", 6)
