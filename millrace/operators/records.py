"""Records of JSON documents: differences with matched lists, children of a node, descriptions and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cloud import record_key, record_key_sql
from ..functions.filters import ignore_regex
from ..functions.json import cell_text, json_type, preview
from ..sources.documents import explode_variant

# Keys that a tag may have.
TAG_KEYS = ("Key", "Value", "PropagateAtLaunch", "ResourceId", "ResourceType")


def _ids(s: str) -> str:
    """SQL for the ids of the elements of a list, NULL for those without; NULL for other values."""
    return f"transform(try_variant_get({s}, '$', 'array<variant>'), x -> ({record_key_sql('x')}).id)"


def _steps() -> str:
    """SQL for the parts (part, a, b, whole) that a pair w of unequal objects or lists a, b with ids `named` is compared by.

    Members of objects and values of tag lists go by key; lists of scalars are sets; lists of
    objects go by their ids if these are unique on both sides, else by place. `whole`: reported as it is.
    """
    part = lambda name, a, b, whole: f"named_struct('part', {name}, 'a', {a}, 'b', {b}, 'whole', {whole})"
    members = lambda s: f"try_variant_get({s}, '$', 'map<string,variant>')"
    items = lambda s: f"try_variant_get({s}, '$', 'array<variant>')"
    no = "CAST(NULL AS VARIANT)"
    kind = lambda x: f"schema_of_variant({x})"
    listed = ", ".join(f"'{k}'" for k in TAG_KEYS)
    tag = f"coalesce({kind('x')} LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(x, '$.Key', 'variant')) = 'STRING' AND size(array_except(map_keys({members('x')}), array({listed}))) = 0, false)"
    tags = lambda s: f"forall({items(s)}, x -> {tag})"
    plain = lambda s: f"forall({items(s)}, x -> NOT ({kind('x')} LIKE 'OBJECT%' OR {kind('x')} LIKE 'ARRAY%'))"
    objects = "transform(array_union(map_keys({a}), map_keys({b})), k -> {row})".format(a=members("w.a"), b=members("w.b"), row=part("'.' || k", f"try_element_at({members('w.a')}, k)", f"try_element_at({members('w.b')}, k)", "false"))

    key = "try_variant_get(x, '$.Key', 'string')"
    keys = lambda s: f"transform({items(s)}, x -> {key})"
    value = lambda s: f"try_variant_get(try_element_at(filter({items(s)}, x -> {key} = k), -1), '$.Value', 'variant')"
    tagged = f"transform(array_union({keys('w.a')}, {keys('w.b')}), k -> {part(chr(39) + '.' + chr(39) + ' || k', value('w.a'), value('w.b'), 'false')})"

    texts = lambda s: f"transform({items(s)}, x -> to_json(x))"
    more = f"transform(filter({items('w.b')}, x -> NOT array_contains({texts('w.a')}, to_json(x))), x -> {part(repr('[+]'), no, 'x', 'true')})"
    less = f"transform(filter({items('w.a')}, x -> NOT array_contains({texts('w.b')}, to_json(x))), x -> {part(repr('[-]'), 'x', no, 'true')})"

    ids = lambda s: {"w.a": "named.a_ids", "w.b": "named.b_ids"}[s]
    unique = lambda s: f"(forall({ids(s)}, i -> i IS NOT NULL) AND size(array_distinct({ids(s)})) = size({ids(s)}))"
    at = lambda s: f"try_element_at({items(s)}, CAST(array_position({ids(s)}, i) AS INT))"
    name = "try_variant_get(parse_json(to_json(named_struct('v', i))), '$.v', 'variant')"
    matched = f"transform(array_intersect({ids('w.b')}, {ids('w.a')}), i -> {part(repr('[') + ' || i || ' + repr(']'), at('w.a'), at('w.b'), 'false')})"
    added = f"transform(array_except({ids('w.b')}, {ids('w.a')}), i -> {part(repr('[+]'), no, name, 'true')})"
    removed = f"transform(array_except({ids('w.a')}, {ids('w.b')}), i -> {part(repr('[-]'), name, no, 'true')})"

    size = lambda s: f"size({items(s)})"
    here = f"n < {size('w.a')} AND n < {size('w.b')}"
    place = f"CASE WHEN {here} THEN '[' || n || ']' WHEN n >= {size('w.a')} THEN '[+]' ELSE '[-]' END"
    # An element on one side only is told by its id, if it has one.
    own = lambda s: f"get({items(s)}, n)"
    told = lambda s: f"CASE WHEN NOT ({here}) AND get({ids(s)}, n) IS NOT NULL THEN {name.replace('i)', f'get({ids(s)}, n))')} ELSE {own(s)} END"
    placed = f"transform(sequence(0, greatest({size('w.a')}, {size('w.b')}) - 1), n -> {part(place, told('w.a'), told('w.b'), f'NOT ({here})')})"
    return f"""CASE WHEN schema_of_variant(w.a) LIKE 'OBJECT%' THEN {objects}
      WHEN {tags('w.a')} AND {tags('w.b')} THEN {tagged}
      WHEN {plain('w.a')} AND {plain('w.b')} THEN concat({more}, {less})
      WHEN {unique('w.a')} AND {unique('w.b')} THEN concat({matched}, {added}, {removed})
      ELSE {placed} END"""


def record_diff(before: DataFrame, after: DataFrame, id_cols: list[str], value_col: str, ignore: list[str] | None = None) -> DataFrame:
    """(id..., path, old, new): fields that differ between two versions of a record.

    Objects are compared by key, tag lists as maps, lists of scalars as sets ([+], [-]), lists of
    objects by the ids of their elements ([sg-1]) where each has one of its own, else by place.
    Elements added or removed by place are told by their id, if they have one. Paths that match a
    pattern of `ignore` (as of `filters.ignored`) are left out with all below them. Rows on
    one side only are no difference here (`snapshot_diff` lists them). One recursive query over
    the pairs; equal parts are not followed.
    """
    ids = ", ".join(f"`{c}`" for c in id_cols)
    own = ", ".join(f"w.`{c}`" for c in id_cols)
    pairs = before.select(*id_cols, F.col(value_col).alias("a")).join(after.select(*id_cols, F.col(value_col).alias("b")), id_cols)
    path = "CASE WHEN w.path = '' AND e.part LIKE '.%' THEN substring(e.part, 2) ELSE w.path || e.part END"
    noisy = f"AND NOT ({path}) RLIKE :ignore" if ignore else ""
    open_pair = "(schema_of_variant(a) LIKE 'OBJECT%' AND schema_of_variant(b) LIKE 'OBJECT%' OR schema_of_variant(a) LIKE 'ARRAY%' AND schema_of_variant(b) LIKE 'ARRAY%')"
    before.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default counts rows of all records
    rows = before.sparkSession.sql(
        f"""
        WITH RECURSIVE w({ids}, path, a, b, followed) AS (
          SELECT {ids}, '', a, b, {open_pair} FROM {{pairs}} WHERE NOT to_json(a) <=> to_json(b)
          UNION ALL
          SELECT {own}, {path}, e.a, e.b, NOT e.whole AND coalesce({open_pair.replace('(a)', '(e.a)').replace('(b)', '(e.b)')}, false)
          FROM w, LATERAL (SELECT {_ids('w.a')} AS a_ids, {_ids('w.b')} AS b_ids) named, LATERAL inline({_steps()}) e(part, a, b, whole)
          WHERE w.followed AND NOT to_json(e.a) <=> to_json(e.b) {noisy})
        SELECT {ids}, path, a, b FROM w WHERE NOT followed""",
        {"ignore": ignore_regex(ignore)} if ignore else None,
        pairs=pairs,
    )
    return rows.select(*id_cols, "path", cell_text(F.col("a")).alias("old"), cell_text(F.col("b")).alias("new"))


def majority_key(df: DataFrame, value_col: str) -> DataFrame:
    """(id_key, n): the key that identifies most records; ties to the first by name."""
    keys = df.groupBy(record_key(value_col)["key"].alias("id_key")).agg(F.count(F.lit(1)).alias("n")).where("id_key IS NOT NULL")
    return keys.orderBy(F.desc("n"), "id_key").limit(1)


def children(df: DataFrame, id_cols: list[str], value_col: str, path: str = "$", offset: int = 0, limit: int = 500) -> DataFrame:
    """(id..., pos, key, type, preview, count, total): a page of what stands below a path of each document.

    key: member name or list index; count: members of an object or list; total: all children of the
    node. Members of objects come by name. Scalars and missing nodes have no children.
    """
    at = df.select(*id_cols, F.try_variant_get(F.col(value_col), path, "variant").alias("_node"))
    size = lambda v: F.when(json_type(v) == "array", F.array_size(F.try_variant_get(v, "$", "array<variant>"))).when(json_type(v) == "object", F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))))
    rows = explode_variant(at.withColumn("_total", size(F.col("_node"))), "d._node", [*id_cols, "_total"]).where((F.col("pos") >= offset) & (F.col("pos") < offset + limit))
    return rows.select(*id_cols, "pos", F.coalesce("key", F.col("pos").cast("string")).alias("key"), json_type(F.col("value")).alias("type"), preview(F.col("value")).alias("preview"), size(F.col("value")).alias("count"), F.col("_total").alias("total"))


# Fields that name a record and fields that hold a VPC's id, in order, and the form of generated ids.
NAME_FIELDS = ("Name", "name", "DisplayName", "GroupName")
VPC_FIELDS = ("VpcId", "vpcId", "VPCId")
GENERATED = r"^(?:[a-z]+(?:-[a-z]+)*-[0-9a-f]{8,17}|[0-9a-f-]{32,36}|[0-9a-f]{8,}|[A-Z0-9]{13,32})$"


def nearest_vpc(v: Column, depth: int = 3, without: tuple[str, ...] = ("_network", "_details")) -> Column:
    """The VPC id nearest to the top of a VARIANT, down to `depth` levels of members and lists; of one level, members by name."""
    listed = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
    members = lambda x, skip: F.coalesce(F.map_values(F.map_filter(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, _: ~k.isin(*skip) if skip else F.lit(True))), F.array().cast("array<variant>"))
    own = lambda x: F.coalesce(*[F.when(F.try_variant_get(x, f"$.{k}", "string").startswith("vpc-"), F.try_variant_get(x, f"$.{k}", "string")) for k in VPC_FIELDS])
    level, out = F.array(v), []
    for d in range(depth + 1):
        out.append(F.get(F.array_compact(F.transform(level, own)), 0))
        if d < depth:
            skip = without if d == 0 else ()
            below = F.flatten(F.transform(level, lambda x: F.when(json_type(x) == "array", listed(x)).when(json_type(x) == "object", members(x, skip)).otherwise(F.array().cast("array<variant>"))))  # noqa: B023
            level = F.filter(below, lambda x: json_type(x).isin("object", "array"))
    return F.coalesce(*out)


def describe(df: DataFrame, id_col: str, value_col: str, keep: list[str] = (), name_fields: tuple[str, ...] = NAME_FIELDS, key_fields: tuple[str, ...] = (), id_fields: tuple[str, ...] = ("Arn", "arn"), vpc_types: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., id, name, fields, default, vpc, parent, own, cidrs) of records (K1).

    name: the Name tag, a name field, or the id's last part if it is not a generated one and no key
    field is there; vpc: the nearest VPC id, null for the types in `vpc_types` (by a kept column
    `type`); own: the ids by which others may refer to the record: its own, the id fields, and every
    ARN of a member that ends in the id's last part or the name.
    """
    text = lambda k: F.nullif(F.try_variant_get(value_col, f"$.{k}", "string"), F.lit(""))
    tags = F.try_variant_get(value_col, "$.Tags", "array<struct<Key:string,Value:string>>")
    tag = F.nullif(F.get(F.filter(tags, lambda t: t["Key"] == "Name"), 0)["Value"], F.lit(""))
    named = F.coalesce(tag, *[text(k) for k in name_fields])
    fields = F.nullif(F.array_join(F.array(*[F.concat(F.lit(f"{k}="), text(k)) for k in key_fields]), ","), F.lit("")) if key_fields else F.lit(None).cast("string")
    segment = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "[/:]"), -1)
    candidate = F.when(F.col(id_col).rlike("^arn:|://"), segment(F.col(id_col))).otherwise(F.col(id_col))
    own_name = F.when(fields.isNull() & ~candidate.rlike(GENERATED) & ~candidate.contains("#"), candidate)
    name = F.coalesce(named, own_name)
    main = F.try_variant_get(value_col, "$.Associations", "array<struct<Main:boolean>>")
    default = F.coalesce(F.try_variant_get(value_col, "$.IsDefault", "boolean"), F.lit(False)) | F.coalesce(F.exists(main, lambda a: F.coalesce(a["Main"], F.lit(False))), F.lit(False))
    blocks = F.try_variant_get(value_col, "$.CidrBlockAssociationSet", "array<struct<CidrBlock:string>>")
    cidrs = F.coalesce(F.transform(blocks, lambda b: b["CidrBlock"]), F.array_compact(F.array(text("CidrBlock"))))
    vpc = nearest_vpc(F.col(value_col))
    vpc = F.when(~F.coalesce(F.col("type").isin(*vpc_types), F.lit(False)), vpc) if vpc_types else vpc
    strings = F.transform(F.map_values(F.try_variant_get(value_col, "$", "map<string,variant>")), lambda x: F.when(json_type(x) == "string", F.try_variant_get(x, "$", "string")))
    arns = F.filter(strings, lambda t: t.startswith("arn:") & ((segment(t) == segment(F.col(id_col))) | F.coalesce(segment(t) == name, F.lit(False))))
    own = F.concat(F.array(F.col(id_col), *[text(k) for k in id_fields]), F.coalesce(arns, F.array().cast("array<string>")))
    return df.select(
        *keep, F.col(id_col).alias("id"), name.alias("name"), fields.alias("fields"), default.alias("default"), vpc.alias("vpc"),
        text("_parent_id").alias("parent"), F.array_distinct(F.array_compact(own)).alias("own"), cidrs.alias("cidrs"),
    )


def identities(entries: DataFrame, parents: dict[str, str], vpc_type: str = "vpc", clean: Column | None = None) -> DataFrame:
    """`entries` and an identity that does not depend on generated ids (K3).

    entries: label, type, id, name, fields, default, vpc, parent, as of `describe` and optionally
    `parts`, text that stands for a missing name. `parents` names the parent type of a type. A
    record lies inside its parent's identity, else inside its VPC's (`vpc?` if unknown). A record
    whose parent has no identity has none, and so has one of a type whose parents form a loop.
    Types are settled from the top down, one equi-join each level.
    """
    def depth(kind: str) -> int:
        seen = [kind]
        while seen[-1] in parents:
            if parents[seen[-1]] in seen:
                return -1
            seen.append(parents[seen[-1]])
        return len(seen) - 1

    levels = {kind: depth(kind) for kind in parents}
    cleaned = F.lower("name") if clean is None else clean
    parts = F.col("parts") if "parts" in entries.columns else F.lit(None).cast("string")
    base = F.coalesce(cleaned, parts, F.col("fields"), F.when(F.col("default"), "default"))
    rows = entries.withColumn("_base", base)
    vpcs = rows.where(F.col("type") == vpc_type).select("label", F.col("id").alias("vpc"), F.col("_base").alias("_v"))
    rows = rows.join(vpcs, ["label", "vpc"], "left")
    inside = F.when(F.col("vpc").isNotNull() & (F.col("type") != vpc_type), F.concat(F.coalesce("_v", F.lit("vpc?")), F.lit("/"), "_base")).otherwise(F.col("_base"))
    rows = rows.withColumn("identity", inside)
    looped = [k for k, d in levels.items() if d < 0]
    child = F.col("type").isin(*levels) & F.col("parent").isNotNull()
    done = rows.where(~child)
    for level in range(1, max(levels.values(), default=0) + 1):
        kinds = {k: parents[k] for k, d in levels.items() if d == level}
        if not kinds:
            continue
        upper = done.where(F.col("type").isin(*kinds.values())).select("label", F.col("type").alias("_type"), F.col("id").alias("parent"), F.col("identity").alias("_above"))
        upper_type = F.coalesce(*[F.when(F.col("type") == k, p) for k, p in kinds.items()])
        own = rows.where(child & F.col("type").isin(*kinds)).withColumn("_type", upper_type)
        own = own.join(upper, ["label", "_type", "parent"], "left").withColumn("identity", F.concat("_above", F.lit("/"), "_base"))
        done = done.select(*rows.columns).unionByName(own.select(*rows.columns))
    if looped:
        done = done.unionByName(rows.where(child & F.col("type").isin(*looped)).withColumn("identity", F.lit(None).cast("string")))
    return done.select(*entries.columns, "identity")


def type_matches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(ours, theirs): type names of two catalogues that mean the same.

    Names are compared by letters and digits alone, ours also in singular; either may end in the
    other. Every ending of one side is joined with whole names of the other, so no pair is tried in vain.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    n = plain(F.col("ours"))
    singular = [F.when(n.endswith(end), F.concat(F.left(n, F.char_length(n) - len(end)), F.lit(new))) for end, new in (("s", ""), ("es", ""), ("ies", "y"))]
    forms = F.array(n, *singular)
    a = ours.select("ours").distinct().select("ours", F.explode(F.array_distinct(F.array_compact(forms))).alias("f")).where("f <> ''")
    b = theirs.select("theirs").distinct().select("theirs", plain(F.col("theirs")).alias("t")).where("t <> ''")
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(F.col(c), i, F.char_length(c))))
    one = a.select("ours", endings("f").alias("t")).join(b, "t")
    two = b.select("theirs", endings("t").alias("f")).join(a, "f")
    return one.select("ours", "theirs").union(two.select("ours", "theirs")).distinct()


def change_fields(changes: DataFrame, diffs: DataFrame) -> DataFrame:
    """(run, account, region, type, id, action, op, path, old, new): the field changes of change rows.

    A change without listed fields keeps one row with nulls. diffs: the five keys and op, path, old, new.
    """
    keys = ["run", "account", "region", "type", "id"]
    return changes.select(*keys, "action").join(diffs.select(*keys, "op", "path", "old", "new"), keys, "left")


def runs_with_changes(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Runs with a summary and those that only the change log knows, whose other columns are null (H6)."""
    logged = changes.select("run").distinct().join(runs, "run", "left_anti")
    return runs.unionByName(logged, allowMissingColumns=True)


def previous_text(changes: DataFrame, stored: DataFrame, key: str = "page_id") -> DataFrame:
    """Changes with previous_text and previous_version, both null where the stored text could not be read.

    stored: key, version, text, error (null or empty: readable).
    """
    readable = (F.coalesce("error", F.lit("")) == "") & F.col("text").isNotNull()
    s = stored.select(key, F.when(readable, F.col("text")).alias("previous_text"), F.when(readable, F.col("version")).alias("previous_version"))
    return changes.join(s, key, "left")


def library_stats(documents: DataFrame, opens: str, failed: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """One row: documents, opens, failed, and a count of each further table."""
    out = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(opens), F.lit(0)).alias("opens"))
    for name, df in {"failed": failed, **others}.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out
