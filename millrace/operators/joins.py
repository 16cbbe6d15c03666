"""Joins with the semantics of inventories, libraries and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.network import network_key, prefix_length
from .cut import written


def with_names(changes: DataFrame, resources: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Every change with its resource's name, or null, by a composite key."""
    return changes.join(resources.select(*keys, name), keys, "left")


def uses(links: DataFrame, resources: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """What each source refers to, with the target's row where it exists."""
    return links.join(resources, F.col(target) == F.col(key), "left")


def used_by(links: DataFrame, target: str, source: str) -> DataFrame:
    """(target, used_by, n): different sources that refer to each target."""
    return links.select(target, source).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("used_by"), F.min(source).alias("first"))


def only_matching(df: DataFrame, wanted: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows with a wanted key and no excluded one."""
    return df.join(wanted, key, "left_semi").join(excluded, key, "left_anti")


def pair_sides(source: DataFrame, target: DataFrame, keys: list[str], id_col: str, unlisted: DataFrame | None = None) -> DataFrame:
    """(keys..., source_id, target_id, status): both sides paired by key, the n-th of a repeated key with the n-th.

    status: paired, missing (not in the target), extra (not in the source); `not compared` for keys'
    first column in `unlisted`, which one side could not list.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))
    a = source.select(*keys, F.col(id_col).alias("source_id"), nth.alias("_n"))
    b = target.select(*keys, F.col(id_col).alias("target_id"), nth.alias("_n"))
    both = a.join(b, [*keys, "_n"], "full_outer")
    status = F.when(F.col("target_id").isNull(), "missing").when(F.col("source_id").isNull(), "extra").otherwise("paired")
    if unlisted is not None:
        both = both.join(unlisted.select(keys[0]).distinct().withColumn("_u", F.lit(True)), keys[0], "left")
        status = F.when(F.col("_u"), "not compared").otherwise(status)
    return both.select(*keys, "source_id", "target_id", status.alias("status"))


def _in_networks(cidrs: DataFrame, ips: DataFrame, ip: str, cidr: str, own: list[str]) -> DataFrame:
    """`ips` joined with the `cidrs` that hold them, IPv4 or IPv6; _len is the prefix.

    One equi-join over the prefix lengths that occur, at most 33 and 129 of the two kinds: an address
    has just one network of each length, so it meets no block that does not hold it.
    """
    r = cidrs.withColumns({"_len": prefix_length(F.col(cidr)), "_six": F.col(cidr).contains(":")})
    lengths = r.where("_len BETWEEN 0 AND IF(_six, 128, 32)").select("_six", "_len").distinct()
    r = r.withColumn("_net", network_key(F.split(cidr, "/")[0], F.col("_len"))).where("_net IS NOT NULL").drop("_len", "_six")
    a = ips.withColumn("_six", F.col(ip).contains(":")).join(F.broadcast(lengths), "_six").drop("_six")
    a = a.withColumn("_net", network_key(F.col(ip), F.col("_len")))
    return a.join(r, ["_net", *own]).drop("_net")


def networks_of(cidrs: DataFrame, ips: DataFrame, ip: str, cidr: str, own: list[str]) -> DataFrame:
    """Every address with every block of its `own` columns that holds it, IPv4 or IPv6."""
    return _in_networks(cidrs, ips, ip, cidr, own).drop("_len")


def join_cidr(ips: DataFrame, cidrs: DataFrame, ip: str, cidr: str) -> DataFrame:
    """Every address with every block that holds it, IPv4 or IPv6."""
    return networks_of(cidrs, ips, ip, cidr, [])


def longest_prefix(routes: DataFrame, ips: DataFrame, ip: str, cidr: str, table: str | None = None) -> DataFrame:
    """Every different address with the containing route of the largest prefix; for each route table, if `table` names its column; only the address's own one, if the addresses have it too (F8).

    Addresses and routes of both kinds may be mixed; they never meet across kinds.
    """
    own = [table] if table and table in ips.columns else []
    met = _in_networks(routes, ips, ip, cidr, own)
    best = F.row_number().over(Window.partitionBy(ip, *([table] if table else [])).orderBy(F.desc("_len"), cidr))
    return met.withColumn("_p", best).where("_p = 1").withColumn("prefix", F.col("_len")).drop("_p", "_len")


def coverage_gaps(listed: DataFrame, tokens: DataFrame, id_col: str, forms: Column, type_col: str, examples: int = 10) -> DataFrame:
    """(type, n, examples): listed ids none of whose forms is a stored token (F11). tokens: token."""
    met = listed.withColumn("token", F.explode(forms)).join(tokens.select("token").distinct(), "token", "left_semi").select(id_col).distinct()
    gaps = listed.join(met, id_col, "left_anti")
    nth = F.row_number().over(Window.partitionBy(type_col).orderBy(id_col))
    ranked = gaps.withColumn("_n", nth)
    return ranked.groupBy(type_col).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col(id_col)))), ",").alias("examples"))


def type_matches(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Type names that are equal in a singular or plural form (F12); equi-join on the forms."""
    forms = lambda c: F.array_distinct(F.array(F.lower(c), F.regexp_replace(F.lower(c), "s$", ""), F.regexp_replace(F.lower(c), "ies$", "y"), F.regexp_replace(F.lower(c), "es$", "")))
    x = a.select(left, F.explode(forms(F.col(left))).alias("_f"))
    y = b.select(right, F.explode(forms(F.col(right))).alias("_f"))
    return x.join(y, "_f").select(left, right).distinct()


def place(df: DataFrame, id_col: str, own: str, candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, place): own place, else the only candidate's, else the nearest placed ancestor's.

    candidates: (id, place) rows; parents: (id, parent). Rounds go on until no row gets a place any
    more: each takes the ancestor's place where there is one, and else doubles the way up.
    """
    only = candidates.groupBy(id_col).agg(F.collect_set("place").alias("_s")).where(F.size("_s") == 1).select(id_col, F.get("_s", 0).alias("_c"))
    first = df.join(only, id_col, "left").select(id_col, F.coalesce(own, "_c").alias("place"))
    out = written(first.join(parents.select(id_col, "parent"), id_col, "left"))
    known = -1
    while (now := out.agg(F.count("place"), F.count(F.when(F.col("place").isNull(), F.col("parent")))).first())[1] and now != known:
        known = now
        above = out.select(F.col(id_col).alias("parent"), F.col("place").alias("_up"), F.col("parent").alias("_further"))
        met = out.join(above, "parent", "left")
        further = F.when(F.col("place").isNull() & F.col("_up").isNull(), F.col("_further")).otherwise(F.col("parent"))
        out = written(met.select(id_col, F.coalesce("place", "_up").alias("place"), further.alias("parent")))
    return out.select(id_col, "place")


def resolve(asked: DataFrame, owners: DataFrame, key: str, tiers: list[tuple[Column, bool]], order: str) -> DataFrame:
    """The best owner of an ambiguous key: the first tier whose condition holds; a tier may ask that the owner is the only one.

    tiers: (condition over the joined columns, must be the only owner).
    """
    owned = owners.withColumn("_only", F.count(F.lit(1)).over(Window.partitionBy(key)) == 1)
    met = asked.join(owned, key)
    rank = F.lit(None).cast("int")
    for n, (condition, alone) in reversed(list(enumerate(tiers))):
        rank = F.when(condition & (F.col("_only") if alone else F.lit(True)), n).otherwise(rank)
    met = met.withColumn("_t", rank).where("_t IS NOT NULL")
    best = F.row_number().over(Window.partitionBy(*asked.columns).orderBy("_t", order))
    return met.withColumn("_p", best).where("_p = 1").withColumnRenamed("_t", "tier").drop("_p", "_only")


def first_reason(parts: list[tuple[str, DataFrame]], id_col: str) -> DataFrame:
    """(id, reason): ids of several semi-joins with the first reason in order."""
    rows = reduce(DataFrame.unionByName, [d.select(id_col).withColumns({"reason": F.lit(r), "_o": F.lit(n)}) for n, (r, d) in enumerate(parts)])
    return rows.groupBy(id_col).agg(F.min_by("reason", "_o").alias("reason"))


def by_keyword(df: DataFrame, name: str, keyword: str, shared: list[str]) -> DataFrame:
    """Rows whose name has the keyword, and shared ones without it, with their kind."""
    has = F.contains(F.lower(name), F.lit(keyword.lower()))
    common = reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in shared], F.lit(False))
    return df.withColumn("kind", F.when(has, "project").when(common, "shared")).where("kind IS NOT NULL")


def lb_targets(balancers: DataFrame, listeners: DataFrame, groups: DataFrame) -> DataFrame:
    """(lb, port, group, target) over default and rule actions (F16).

    listeners: lb, port, actions array<string> of group ids; groups: group, targets array<string>.
    """
    chosen = listeners.select("lb", "port", F.explode("actions").alias("group")).distinct()
    return balancers.join(chosen, "lb").join(groups.select("group", F.explode_outer("targets").alias("target")), "group", "left").select("lb", "port", "group", "target")


def record_targets(records: DataFrame, owners: list[tuple[str, DataFrame]], host: str) -> DataFrame:
    """Every DNS record with the first kind of owner of its host (F15). owners: (kind, frame of `host`)."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"^dualstack\.|\.$", "")
    rows = reduce(DataFrame.unionByName, [d.select(clean(F.col(host)).alias("_h")).withColumns({"_k": F.lit(k), "_o": F.lit(n)}) for n, (k, d) in enumerate(owners)])
    best = rows.groupBy("_h").agg(F.min_by("_k", "_o").alias("owner"))
    return records.withColumn("_h", clean(F.col(host))).join(best, "_h", "left").drop("_h").na.fill("unknown", ["owner"])


def twins(df: DataFrame, name: str, words: list[str]) -> DataFrame:
    """(a, b): accounts with one name once the environment words are gone."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(name)), r"\b(" + "|".join(words) + r")\b", ""), r"[^a-z0-9]+", " "))
    rows = df.select(F.col(name), plain.alias("_p"))
    a, b = rows.select(F.col(name).alias("a"), "_p"), rows.select(F.col(name).alias("b"), "_p")
    return a.join(b, "_p").where("a < b").select("a", "b")


def sidebar(projects: DataFrame, repos: DataFrame, documents: DataFrame, project: str, repo: str, ts: str) -> DataFrame:
    """(project, repo, documents, last): every project and repository with document counts, 0 without any."""
    counts = documents.groupBy(repo).agg(F.count(F.lit(1)).alias("documents"), F.max(ts).alias("last"))
    return projects.join(repos, project, "left").join(counts, repo, "left").na.fill(0, ["documents"])


def pr_trace(commits: DataFrame, pulls: DataFrame, activities: DataFrame) -> DataFrame:
    """(commit, pr, merged, reviewers): the pull request of each commit, its last merge and its reviewers in order.

    commits: commit, pr; pulls: pr, title; activities: pr, action, at, person.
    """
    own = commits.join(pulls, "pr").dropDuplicates(["commit", "pr"])
    merged = activities.where("action = 'MERGED'").groupBy("pr").agg(F.max("at").alias("merged"))
    review = activities.where("action <> 'MERGED'").groupBy("pr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "person"))), lambda x: x["person"].cast("string")), ",").alias("reviewers"))
    return own.join(merged, "pr", "left").join(review, "pr", "left").select("commit", "pr", "merged", F.coalesce("reviewers", F.lit("")).alias("reviewers"))


def attach_rules(resources: DataFrame, text: str, pattern: str, rules: DataFrame, id_col: str) -> DataFrame:
    """(resource, rule columns): rules of every group that a resource's text mentions (F10). rules: group, ..."""
    ids = resources.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))).alias("group"))
    return ids.join(rules, "group")
