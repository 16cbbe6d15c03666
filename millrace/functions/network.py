"""Addresses, CIDR blocks, ports and protocols as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; NULL for other text."""
    parts = F.split(ip, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def ip_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def ip6_halves(ip: Column) -> Column:
    """An IPv6 address as struct(high, low) of unsigned halves in decimals; NULL for other text."""
    sides = F.split(ip, "::")
    left = F.filter(F.split(F.get(sides, 0), ":"), lambda x: x != "")
    right = F.filter(F.split(F.coalesce(F.get(sides, 1), F.lit("")), ":"), lambda x: x != "")
    fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    groups = F.concat(left, fill, right)
    half = lambda start: F.conv(F.array_join(F.transform(F.slice(groups, start, 4), lambda g: F.lpad(g, 4, "0")), ""), 16, 10).cast("decimal(20,0)")
    return F.when(ip.rlike(r"^[0-9a-fA-F:]+$") & ip.contains(":"), F.struct(half(1).alias("high"), half(5).alias("low")))


def cidr_low(cidr: Column) -> Column:
    """First address of an IPv4 block; a bare address is a block of its own."""
    size = block_size(cidr)
    n = ip_number(F.split(cidr, "/")[0])
    return n - F.pmod(n, size)


def prefix_length(cidr: Column) -> Column:
    return F.coalesce(F.get(F.split(cidr, "/"), 1).try_cast("int"), F.when(cidr.contains(":"), 128).otherwise(32))


def block_size(cidr: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - prefix_length(cidr))


def ip6_bits(ip: Column) -> Column:
    """An IPv6 address as 128 characters 0 and 1; NULL for other text."""
    halves = ip6_halves(ip)
    bits = lambda half: F.lpad(F.conv(half.cast("string"), 10, 2), 64, "0")
    return F.concat(bits(halves["high"]), bits(halves["low"]))


def network_key(address: Column, length: Column) -> Column:
    """Names the network of `length` bits that an address of either kind lies in; NULL for other text and impossible lengths."""
    n = ip_number(address)
    four = F.concat(F.lit("4/"), length.cast("string"), F.lit("/"), (n - F.pmod(n, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - length))).cast("string"))
    six = F.concat(F.lit("6/"), F.left(ip6_bits(address), length))
    return F.when(address.contains(":"), F.when(length.between(0, 128), six)).otherwise(F.when(length.between(0, 32), four))


def cidr_contains(cidr: Column, ip: Column) -> Column:
    """Whether an IPv4 or IPv6 block holds an address; never across the two kinds."""
    n = ip_number(ip)
    parts = F.split(cidr, "/")
    length = F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(128))
    six = F.left(ip6_bits(F.get(parts, 0)), length) == F.left(ip6_bits(ip), length)
    four = (n >= cidr_low(cidr)) & (n < cidr_low(cidr) + block_size(cidr))
    return F.when(cidr.contains(":"), F.coalesce(six, F.lit(False))).otherwise(four)


def address_in(cidr: Column, n: int = 10) -> Column:
    """A representative address: the n-th of the block, or its last."""
    low = cidr_low(cidr)
    return F.when(low.isNotNull(), ip_text(low + F.least(F.lit(n).cast("long"), block_size(cidr) - 1)))


def cidr_in_parent(cidr: Column, blocks: Column) -> Column:
    """Place of a block inside the first of its parent's blocks that holds it: block1+1024/24."""
    holds = lambda b: F.coalesce(cidr_contains(b, F.split(cidr, "/")[0]), F.lit(False)) & (prefix_length(cidr) >= prefix_length(b))
    index = F.array_position(F.transform(blocks, holds), True)
    offset = cidr_low(cidr) - cidr_low(F.try_element_at(blocks, index.cast("int")))
    return F.when(index > 0, F.concat(F.lit("block"), index.cast("string"), F.lit("+"), offset.cast("string"), F.lit("/"), prefix_length(cidr).cast("string")))


def ports_cover(ports: Column, port: Column) -> Column:
    """`all`, a number or lo-hi covers a port."""
    ends = F.split(ports, "-")
    low = F.get(ends, 0).try_cast("int")
    return (ports == "all") | F.coalesce((port >= low) & (port <= F.coalesce(F.get(ends, 1).try_cast("int"), low)), F.lit(False))


def protocol_ok(rule: Column, protocol: Column) -> Column:
    """`all`, -1, the same name, or its number."""
    number = F.when(protocol == "tcp", "6").when(protocol == "udp", "17").when(protocol == "icmp", "1")
    return rule.isin("all", "-1") | (F.lower(rule) == F.lower(protocol)) | F.coalesce(rule == number, F.lit(False))


def route_target(c: Column) -> Column:
    """Kind of a route's target by its id."""
    kinds = {"local": "^local$", "internet": "^igw-", "nat": "^nat-", "transit": "^tgw-", "firewall": "^vpce-fw", "endpoint": "^vpce-", "peering": "^pcx-", "vpn": "^vgw-", "interface": "^eni-"}
    out = F.when(c.isNull(), "none")
    for kind, pattern in kinds.items():
        out = out.when(c.rlike(pattern), kind)
    return out.otherwise("other")


def worst(rank: Column) -> Column:
    """Aggregate: FAIL, else UNKNOWN (also for no verdict), else PASS."""
    order = F.when(rank == "FAIL", 2).when(rank == "UNKNOWN", 1).when(rank == "PASS", 0)
    return F.element_at(F.array(F.lit("PASS"), F.lit("UNKNOWN"), F.lit("FAIL")), F.coalesce(F.max(order), F.lit(1)) + 1)
