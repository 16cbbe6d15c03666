"""Which tool a JSON document comes from, the table layout of its rows, and ids and pseudo-fields of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import cell_text, display_name, field, tags_map


def members(v: Column) -> Column:
    """An object's members as a map; NULL for other values."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def has(v: Column, key: str) -> Column:
    """Whether an object has a key, its value null or not."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def with_value(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v), with v computed once however often `f` uses it."""
    return F.get(F.transform(F.array(v), f), 0)


def _text(v: Column, path: str) -> Column:
    """The string at a path; NULL for other kinds."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def _filled(v: Column, path: str) -> Column:
    """Whether the value at a path is there and is none of null, false, 0 and ''."""
    at = F.try_variant_get(v, path, "variant")
    return F.coalesce(~F.to_json(at).isin("null", "false", "0", '""'), F.lit(False))


def sample_record(v: Column) -> Column:
    """The first object of `value`, of `items` or of the document, else the document itself if it is an object."""

    def first(at: Column) -> Column:
        object_ = lambda x: F.schema_of_variant(x).startswith("OBJECT")
        return F.coalesce(F.get(F.filter(F.try_variant_get(at, "$", "array<variant>"), object_), 0), F.when(object_(at), at))

    return F.coalesce(*[first(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("value", "items")], first(v))


def detect_source(v: Column) -> Column:
    """terraform, kubectl, azure, gcp, aws or unknown, the first that fits."""
    return F.when(v.isNull(), "unknown").otherwise(with_value(sample_record(v), lambda s: _source(v, s)))


def _source(v: Column, s: Column) -> Column:
    plan = has(v, "format_version") & (has(v, "values") | has(v, "planned_values") | has(v, "resource_changes"))
    kube = _filled(v, "$.apiVersion") & _filled(v, "$.kind") | _filled(s, "$.apiVersion") & _filled(s, "$.kind") & _filled(s, "$.metadata")
    azure = F.coalesce(_text(s, "$.id").startswith("/subscriptions/"), F.lit(False)) | F.coalesce(_text(v, "$.id").startswith("/subscriptions/"), F.lit(False))
    google = F.coalesce(_text(s, "$.selfLink").contains("googleapis.com"), F.lit(False)) | F.coalesce(_text(s, "$.kind").startswith("compute#"), F.lit(False))
    keys = F.map_keys(F.coalesce(members(v), members(s)))
    upper = F.size(F.filter(keys, lambda k: k.rlike("^[A-Z]")))
    capital = (F.size(keys) > 0) & (upper >= F.size(keys) * 0.8)
    arn = F.to_json(s).rlike(r'"arn:aws[\w-]*:')
    return (
        F.when(s.isNull(), "unknown").when(has(v, "terraform_version") | plan, "terraform").when(kube, "kubectl")
        .when(azure, "azure").when(google, "gcp").when(arn | capital, "aws").otherwise("unknown")
    )


# Table layouts in order, each with its columns.
TEMPLATES = {
    "EC2 instances": ("@name", "InstanceId", "State.Name", "InstanceType", "Placement.AvailabilityZone", "PrivateIpAddress", "PublicIpAddress", "LaunchTime"),
    "Azure VMs": ("name", "resourceGroup", "location", "hardwareProfile.vmSize", "provisioningState", "powerState"),
    "Security groups": ("GroupName", "GroupId", "VpcId", "Description"),
    "VPCs": ("@name", "VpcId", "CidrBlock", "State", "IsDefault", "OwnerId"),
    "Subnets": ("@name", "SubnetId", "VpcId", "CidrBlock", "AvailabilityZone", "AvailableIpAddressCount", "State"),
    "Volumes": ("@name", "VolumeId", "State", "Size", "VolumeType", "AvailabilityZone", "CreateTime"),
    "Kubernetes objects": ("metadata.name", "metadata.namespace", "kind", "status.phase", "metadata.creationTimestamp"),
    "Azure resources": ("name", "type", "resourceGroup", "location", "provisioningState"),
    "Terraform resources": ("address", "type", "name", "provider_name", "mode"),
    "CloudTrail events": ("eventTime", "eventName", "eventSource", "userIdentity.arn", "sourceIPAddress", "awsRegion", "errorCode"),
    "CloudTrail lookup": ("EventTime", "EventName", "Username", "EventSource", "EventId"),
    "CloudWatch log events": ("timestamp", "logStreamName", "message"),
    "Lambda functions": ("FunctionName", "Runtime", "Handler", "MemorySize", "Timeout", "LastModified"),
    "gcloud instances": ("name", "zone", "machineType", "status", "creationTimestamp"),
}


def table_template(v: Column) -> Column:
    """Name of the first table layout (a key of TEMPLATES) that a record fits; NULL for none."""
    both = lambda *keys: F.lit(True) if not keys else has(v, keys[0]) & both(*keys[1:])
    machine = has(F.try_variant_get(v, "$.hardwareProfile", "variant"), "vmSize") | F.coalesce(_text(v, "$.type").rlike("(?i)virtualMachines$"), F.lit(False))
    fits = {
        "EC2 instances": both("InstanceId", "InstanceType"),
        "Azure VMs": machine,
        "Security groups": both("GroupId", "IpPermissions"),
        "VPCs": both("VpcId", "CidrBlock") & ~has(v, "SubnetId"),
        "Subnets": has(v, "SubnetId"),
        "Volumes": both("VolumeId", "Size"),
        "Kubernetes objects": _filled(v, "$.metadata") & _filled(v, "$.kind"),
        "Azure resources": F.coalesce(_text(v, "$.id").startswith("/subscriptions/"), F.lit(False)),
        "Terraform resources": both("address", "type", "values"),
        "CloudTrail events": both("eventName", "eventSource"),
        "CloudTrail lookup": both("EventName", "EventId"),
        "CloudWatch log events": has(v, "message") & (has(v, "timestamp") | has(v, "ingestionTime")),
        "Lambda functions": both("FunctionName", "Runtime"),
        "gcloud instances": _text(v, "$.selfLink").isNotNull() & has(v, "machineType"),
    }
    return F.coalesce(*[F.when(fits[name], name) for name in TEMPLATES])


def cell(v: Column, name: str, key: Column | None = None, parent: Column | None = None) -> Column:
    """Text of a cell: @name, @key, @value, @parent and @tag:X, else the field of that name (B2)."""
    if name.startswith("@tag:"):
        return F.coalesce(F.try_element_at(tags_map(v), F.lit(name[5:])), F.lit(""))
    own = {"@name": display_name(v), "@key": key, "@value": cell_text(v), "@parent": parent}
    if name in own:
        return F.coalesce(own[name].cast("string"), F.lit("")) if own[name] is not None else F.lit("")
    return cell_text(field(v, name))


# Keys that identify a record, in order; keys that name another thing and never do.
ID_KEYS = ("InstanceId", "Arn", "ARN", "arn", "id", "Id", "ResourceId", "ResourceArn", "GroupId", "VolumeId", "ImageId",
           "NetworkInterfaceId", "DBInstanceIdentifier", "FunctionName", "BucketName")
REFERENCE_KEYS = ("OwnerId", "AccountId", "AvailabilityZoneId", "VpcId", "SubnetId", "ImageId", "KernelId", "RamdiskId",
                  "KmsKeyId", "KeyId", "KmsKeyArn", "DhcpOptionsId", "RequesterId", "ReservationId", "SnapshotId", "RoleArn", "OutpostArn",
                  "TenantId", "SubscriptionId", "ProjectId", "ParentId", "SourceArn", "TargetArn", "PolicyArn")


def record_key_sql(v: str) -> str:
    """SQL for (key, id) of the record `v`, an SQL expression of type VARIANT; NULL where nothing identifies it.

    As text, so that a recursive query can hold it. Keys that are not listed are tried by name.
    """
    get = lambda key: f"try_variant_get({v}, '$.{key}', 'variant')"
    kind = lambda at: f"schema_of_variant({at})"
    text = lambda at: f"try_variant_get({at}, '$', 'string')"

    def scalar(key: str) -> str:
        at = get(key)
        return f"CASE WHEN {kind(at)} = 'STRING' THEN nullif({text(at)}, '') WHEN {kind(at)} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' THEN {text(at)} END"

    def string(key: str) -> str:
        at = get(key)
        return f"CASE WHEN {kind(at)} = 'STRING' THEN nullif({text(at)}, '') END"

    def named(key: str, value: str) -> str:
        return f"CASE WHEN ({value}) IS NOT NULL THEN named_struct('key', '{key}', 'id', {value}) END"

    parts = [named(k, string(k) if k == "id" else scalar(k)) for k in ID_KEYS]
    size = f"size(map_keys(try_variant_get({v}, '$', 'map<string,variant>')))"
    parts.append(named("Name", f"CASE WHEN {get('CreationDate')} IS NOT NULL AND {size} <= 4 THEN {string('Name')} END"))
    parts.append(named("metadata.uid", scalar("metadata.uid")))
    parts.append(named("metadata.name", f"CASE WHEN ({scalar('metadata.name')}) IS NOT NULL THEN concat_ws('/', {string('metadata.namespace')}, {scalar('metadata.name')}) END"))
    parts += [named("address", string("address")), named("name", scalar("name")), named("Name", scalar("Name"))]
    listed = ", ".join(f"'{k}'" for k in REFERENCE_KEYS)
    entries = f"map_entries(try_variant_get({v}, '$', 'map<string,variant>'))"
    usable = f"e.key RLIKE '(Id|Arn)$' AND e.key NOT IN ({listed}) AND schema_of_variant(e.value) = 'STRING' AND {text('e.value')} <> ''"
    parts.append(f"get(transform(filter({entries}, e -> {usable}), e -> named_struct('key', e.key, 'id', {text('e.value')})), 0)")
    parts += [named(k, string(k)) for k in ("SubnetId", "VpcId")]
    return f"CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN coalesce({', '.join(parts)}) END"


def record_key(name: str) -> Column:
    """Struct (key, id) of the records in a VARIANT column: id keys in order, bucket, metadata, address, name, other ids."""
    return F.expr(record_key_sql(f"`{name}`"))
