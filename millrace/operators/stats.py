"""Counts, facets, people, rankings and roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    return long.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def change_counts(df: DataFrame, run_col: str, run, action: str = "action", account: str = "account") -> DataFrame:
    """(action, account, n): counts of one run by action, by account, and in all, by grouping sets."""
    own = df.where(F.col(run_col) == run)
    sets = own.groupingSets([[F.col(action)], [F.col(account)], []], F.col(action), F.col(account))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select(F.col(action).alias("action"), F.col(account).alias("account"), "level", "n")


def overview(resources: DataFrame, changes: DataFrame, denied: DataFrame, key: str = "account") -> DataFrame:
    """One row an account: resources, regions, changes by action, denied types."""
    a = resources.groupBy(key).agg(F.count(F.lit(1)).alias("resources"), F.count_distinct("region").alias("regions"))
    b = changes.groupBy(key).agg(*[F.count_if(F.col("action") == x).alias(x) for x in ("added", "modified", "removed")])
    c = denied.groupBy(key).agg(F.count_distinct("type").alias("denied_types"))
    out = a.join(b, key, "left").join(c, key, "left")
    return out.na.fill(0, ["added", "modified", "removed", "denied_types"])


def contributors(df: DataFrame, person: str, k: int = 20) -> DataFrame:
    """The k people with most rows, blanks left out."""
    own = df.where(F.trim(F.coalesce(F.col(person).cast("string"), F.lit(""))) != "")
    return own.groupBy(person).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), person).limit(k)


def people(df: DataFrame, repo: str, creator: str, author: str, commit: str) -> DataFrame:
    """(repo, person, files, commits): files written or last changed by a person, and different commits."""
    long = df.withColumn("person", F.explode(F.array_distinct(F.array(creator, author)))).where("person IS NOT NULL")
    return long.groupBy(repo, "person").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(commit).alias("commits"))


def people_by_identity(per_repo: DataFrame, repo: str) -> DataFrame:
    """(identity, repos, files): one row for each normalised name."""
    name = F.lower(F.regexp_replace(F.trim(F.col("person").cast("string")), r"[\s._-]+", " "))
    return per_repo.groupBy(name.alias("identity")).agg(F.count_distinct(repo).alias("repos"), F.sum("files").alias("files"))


def role_counts(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(person, one column a role): rows in each role; roles: name to column."""
    long = df.select(F.explode(F.array(*[F.struct(F.col(c).alias("person"), F.lit(r).alias("role")) for r, c in roles.items()])).alias("x")).select("x.*")
    return long.where("person IS NOT NULL").groupBy("person").agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles])


def bookmark_stats(df: DataFrame, now: str) -> DataFrame:
    """One row of totals: bookmarks, domains, opens, never viewed, added this month and last month (E16). Columns url, views, added."""
    day, today = F.col("added").cast("date"), F.lit(now).cast("date")
    month = F.date_trunc("month", today).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.parse_url("url", F.lit("HOST"))).alias("domains"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("opens"), F.count_if(F.col("views") == 0).alias("never_viewed"),
        F.count_if((day >= month) & (day < F.add_months(month, 1))).alias("this_month"),
        F.count_if((day >= F.add_months(month, -1)) & (day < month)).alias("last_month"),
    )


def activity(df: DataFrame, group: str, ts: str, start: str, end: str, k: int = 10) -> DataFrame:
    """The k groups with most rows in [start, end), with their last day."""
    day = F.col(ts).cast("date")
    own = df.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
    return own.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(day).alias("last_day")).orderBy(F.desc("n"), group).limit(k)


def env_words(df: DataFrame, name: str, words: list[str]) -> DataFrame:
    """(word, n, example, main): names that contain an environment word as a part; main: at least max(2, 20 % of the top)."""
    parts = F.array_distinct(F.split(F.lower(F.col(name)), r"[^a-z0-9]+"))
    long = df.select(name, F.explode(F.array_intersect(parts, F.array(*[F.lit(w) for w in words]))).alias("word"))
    counts = long.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("example"))
    return counts.withColumn("main", F.col("n") >= F.greatest(F.lit(2), F.max("n").over(Window.partitionBy()) * 0.2))


def denied(df: DataFrame, type_col: str = "type") -> DataFrame:
    """(type, regions): denied types with their regions (E19). Columns region, error."""
    return df.where("error = 'denied'").groupBy(type_col).agg(F.array_sort(F.collect_set("region")).alias("regions"))


def coverage_summary(df: DataFrame) -> DataFrame:
    """One row: accounts complete, with gaps, unchecked (E20). Columns checked, gaps."""
    checked = F.coalesce(F.col("checked"), F.lit(False))
    return df.agg(F.count_if(checked & (F.col("gaps") == 0)).alias("complete"), F.count_if(checked & (F.col("gaps") > 0)).alias("with_gaps"), F.count_if(~checked).alias("unchecked"))


def common_roles(df: DataFrame, role: str) -> DataFrame:
    """(role, n, rank): the most common role first, then others used more than once."""
    counts = df.groupBy(role).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), role))).where((F.col("rank") == 1) | (F.col("n") > 1))


def mean_durations(df: DataFrame, group: str, seconds: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("mean"))


def unread(changes: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """(page, n): unreviewed changes of every page, 0 where there is none."""
    counts = changes.where("NOT reviewed").groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    return pages.select(page).distinct().join(counts, page, "left").na.fill(0, ["n"])


def run_summary(changes: DataFrame, id_col: str, floor: int, kinds: list[str], items: DataFrame) -> DataFrame:
    """One row: a count for every kind since `floor`, unchanged = rows of `items` less all of them."""
    since = [F.count_if((F.col(id_col) > floor) & (F.col("kind") == k)).alias(k) for k in kinds]
    out = changes.agg(*since).crossJoin(items.agg(F.count(F.lit(1)).alias("_all")))  # one row each
    return out.select(*kinds, (F.col("_all") - sum((F.col(k) for k in kinds), F.lit(0))).alias("unchanged"))


def report_summary(df: DataFrame, verdict: str) -> DataFrame:
    return df.agg(*[F.count_if(F.col(verdict) == v).alias(v.lower()) for v in ("PASS", "FAIL", "UNKNOWN")])


def stored_bytes(df: DataFrame, owner: str, text: str) -> DataFrame:
    return df.groupBy(owner).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("n_bytes"))


def impact_counts(ids: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """(part, n): rows of every child table that belong to the ids."""
    parts = [c.join(ids, key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, c in children.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Environments in order, each with the words that may end a name.
ENVIRONMENTS = {
    "Non-prod": ["nonprod", "non-prod", "nonprd", "nonp", "np", "lower"],
    "Prod": ["prod", "production", "prd", "live", "prdn"],
    "Stage": ["stage", "staging", "stg", "preprod", "pre-prod", "pre", "uat", "mtf", "perf", "cert"],
    "Test": ["test", "testing", "tst", "qa", "sit", "int", "integration"],
    "Dev": ["dev", "develop", "development", "work"],
    "Sandbox": ["sandbox", "sbx", "lab", "poc", "demo"],
    "DR": ["dr", "disasterrecovery"],
}
OTHER = "Other accounts"
#: A short default; a full set of rules (category -> words, in order of priority) is the caller's to give.
CATEGORIES = {
    "Shared Services": ["shared", "centralized", "landingzone", "directory"], "Management & Billing": ["management", "billing", "payer", "governance"], "Security & Privacy": ["security", "audit", "kms", "vault", "compliance"],
    "Identity & Access": ["identity", "-iam", "iam-", "-sso", "sso-", "access"], "Networking": ["network", "egress", "ingress", "firewall", "transit", "dns", "vpn", "proxy"], "Logging & Monitoring": ["logging", "-logs", "-log-", "monitor"],
    "Backup & DR": ["backup", "recovery"], "Data & Analytics": ["data", "analytic", "lake", "warehouse"], "Databases": ["-db", "db-", "postgres", "mysql", "redis"], "Platform & DevOps": ["platform", "devops", "pipeline", "tools"],
    "Sandbox & Experiments": ["sandbox", "playground", "experiment"],
}


def _joined(name: Column) -> Column:
    """A name's parts in lower case joined by dashes, without a number at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[_.]", "-"), r"(?<=.)-\d+$", "")


def environment(name: Column) -> Column:
    """(name, base): the first environment one of whose words is the end of the name, and the name without it.

    An account number may follow the environment; longer words are tried first; a name that is just the
    word keeps it. `Other` without any.
    """
    joined = _joined(name)
    out = F.struct(F.lit("Other").alias("name"), joined.alias("base"))
    for env, words in reversed(ENVIRONMENTS.items()):
        end = "(?:^|-)(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")$"
        base = F.rtrim(F.regexp_replace(joined, end, ""), F.lit("-"))
        out = F.when(joined.rlike(end), F.struct(F.lit(env).alias("name"), F.when(base == "", joined).otherwise(base).alias("base"))).otherwise(out)
    return F.when(name.isNotNull(), out)


def category(name: Column, rules: dict[str, list[str]] = CATEGORIES, noise: str | None = None) -> Column:
    """The first category one of whose words stands anywhere in the name without its environment, else `Other accounts`.

    Dashes mark the name's edges, so that `-db` or `co-` match whole parts. noise: a pattern of words
    that say nothing, removed first.
    """
    base = environment(name)["base"]
    edged = F.concat(F.lit("-"), F.regexp_replace(base, noise, "") if noise else base, F.lit("-"))
    out = F.lit(OTHER)
    for kind, words in reversed(rules.items()):
        out = F.when(edged.rlike("|".join(map(re.escape, words))), kind).otherwise(out)
    return F.when(name.isNotNull(), out)


def accounts_by_category(df: DataFrame, name: str, rules: dict[str, list[str]] = CATEGORIES, noise: str | None = None, order: str | None = None) -> DataFrame:
    """(category, names): categories in order of their rules, the other last; names by environment, then the column `order` (None: the name alone), then name."""
    place = F.array_position(F.array(*[F.lit(e) for e in ENVIRONMENTS]), environment(F.col(name))["name"])
    kind = category(F.col(name), rules, noise)
    own = df.select(kind.alias("category"), F.struct(F.when(place == 0, len(ENVIRONMENTS) + 1).otherwise(place).alias("r"), *([F.col(order).alias("o")] if order else []), F.col(name).alias("name")).alias("x"))
    rank = F.array_position(F.array(*[F.lit(k) for k in rules]), F.col("category"))
    out = own.groupBy("category").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    return out.orderBy(F.when(rank == 0, len(rules) + 1).otherwise(rank))  # at most a row a rule
