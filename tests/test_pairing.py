"""Descriptions and identities of records: generated ids, nearest VPCs, references, loops."""

import json

from pyspark.sql import functions as F

from millrace.operators import pairing, records


def described(spark, rows, **kw):
    df = spark.createDataFrame([("e", k, i, json.dumps(v) if v is not None else None) for k, i, v in rows], "label string, type string, rid string, t string").withColumn("j", F.try_parse_json("t"))
    return df, records.describe(df, "rid", "j", ["label", "type"], vpc_types=("ec2/vpcs",), **kw)


def test_generated_ids_are_no_names(spark):
    ids = ["tgw-attach-0123456789abcdef0", "Z0123456789ABCDEFGHIJ", "AROAEXAMPLEID1234567", "dead-beef", "i-01234567", "0123456789ab", "11111111-2222-3333-4444-555555555555", "orders-queue", "web#2", "https://sqs/1/jobs", "arn:aws:x:eu:1:role/app/reader", "sg-0123", None]
    _, out = described(spark, [("t", i, {}) for i in ids])
    named = {"dead-beef": "dead-beef", "orders-queue": "orders-queue", "https://sqs/1/jobs": "jobs", "arn:aws:x:eu:1:role/app/reader": "reader", "sg-0123": "sg-0123"}
    assert {r.id: r.name for r in out.collect()} == {i: named.get(i) for i in ids}


def test_nearest_vpc_and_own_ids(spark):
    rows = [
        ("fn", "a", {"VpcConfig": {"VpcId": "vpc-12345678"}}), ("fn", "b", {"Z": {"vpcId": "vpc-2"}, "A": {"B": {"VpcId": "vpc-3"}}}), ("fn", "c", {"L": [1, [{"VPCId": "vpc-4"}]], "VpcId": "none"}),
        ("fn", "d", {"_details": {"VpcId": "vpc-5"}, "_network": {"VpcId": "vpc-6"}}), ("ec2/vpcs", "vpc-7", {"VpcId": "vpc-7"}), ("fn", "e", None), ("fn", "f", [1]),
        ("fn", "app", {"FunctionArn": "arn:aws:lambda:eu:1:function:app", "RoleArn": "arn:aws:iam::1:role/other", "Id": "x-1", "Tags": [{"Key": "Name", "Value": "other"}]}),
    ]
    _, out = described(spark, rows, id_fields=("Id",))
    got = {r.id: (r.vpc, sorted(r.own)) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "vpc-12345678", "b": "vpc-2", "c": "vpc-4", "d": None, "vpc-7": None, "e": None, "f": None, "app": None}
    assert got["app"][1] == ["app", "arn:aws:iam::1:role/other", "arn:aws:lambda:eu:1:function:app", "x-1"]


def identities(spark, rows, rules, parents):
    df, out = described(spark, rows)
    parts = df.select("type", F.col("rid").alias("id"), pairing.rule_parts(F.col("type"), F.col("j"), rules).alias("parts")).dropDuplicates(["type", "id"])
    return {r.id: r.identity for r in pairing.paired_identities(out.join(parts, ["type", "id"], "left"), parents).collect()}


def test_references_and_loops(spark):
    rules = {"ec2/subnets": ["cidr_in_vpc"], "eni": ["Kind", "ref:SubnetId", "ref:Hosts.Id", "=end"], "x": ["ref:To"], "acl": ["default", "ref:Assoc.SubnetId"], "none": []}
    rows = [
        ("ec2/vpcs", "vpc-00000001", {"Tags": [{"Key": "Name", "Value": "Main"}], "CidrBlockAssociationSet": [{"CidrBlock": "10.0.0.0/16"}, {"CidrBlock": "10.9.0.0/20"}]}),
        ("ec2/subnets", "subnet-00000001", {"VpcId": "vpc-00000001", "CidrBlock": "10.0.4.0/24"}), ("ec2/subnets", "subnet-00000002", {"VpcId": "vpc-00000001", "CidrBlock": "10.9.0.0/16"}), ("ec2/subnets", "subnet-00000003", {"VpcId": "vpc-99999999", "CidrBlock": "10.9.0.0/24"}),
        ("ec2/subnets", "subnet-00000004", {"VpcId": "vpc-00000001", "CidrBlock": "10.9.1.0/24", "Tags": [{"Key": "Name", "Value": "Named"}]}),
        ("eni", "eni-00000001", {"Kind": "A sg-01234567 deadbeef99", "SubnetId": "subnet-00000001", "Hosts": [{"Id": "subnet-00000004"}, {"Id": "i-00000009"}, {"Id": "subnet-00000002"}]}), ("eni", "eni-00000002", {"Kind": True, "SubnetId": None, "Hosts": 3}),
        ("x", "x-00000001", {"To": "x-00000002"}), ("x", "x-00000002", {"To": "x-00000001"}), ("x", "x-00000003", {"To": "x-00000001"}), ("x", "x-00000004", {"To": "x-00000004"}), ("x", "x-00000005", {"To": "eni-00000002"}), ("x", "x-00000006", {}), ("x", "x-00000007", {"To": "x-00000003"}),
        ("acl", "acl-00000001", {"IsDefault": True, "Assoc": [{"SubnetId": "subnet-00000003"}]}), ("none", "n-00000001", {}), ("kid", "Kid", {"_parent_id": "x-00000003"}), ("kid", "Orphan", {"_parent_id": "x-77777777"}), ("kid", "kid-00000001", {"_parent_id": "x-00000003", "IsDefault": True}),
        ("fn", "app", {"VpcConfig": {"VpcId": "vpc-00000001"}}), ("fn", "app", {"VpcConfig": {"VpcId": "vpc-00000001"}}),
    ]
    assert identities(spark, rows, rules, {"kid": "x"}) == {
        "vpc-00000001": "main", "subnet-00000001": "main/block1+1024/24", "subnet-00000002": "main/outside-vpc", "subnet-00000003": "vpc?/outside-vpc", "subnet-00000004": "main/named",
        "eni-00000001": "a * *|main/block1+1024/24|?+main/named+main/outside-vpc|end", "eni-00000002": "true|end",
        "x-00000001": "?", "x-00000002": "?", "x-00000003": "?", "x-00000004": "?", "x-00000005": "true|end", "x-00000006": None, "x-00000007": "?",
        "acl-00000001": "default|vpc?/outside-vpc", "n-00000001": None, "Kid": "?/kid", "Orphan": None, "kid-00000001": "?/default", "app": "main/app",
    }


def test_empty(spark):
    assert identities(spark, [], {"x": ["ref:To"]}, {}) == {}
