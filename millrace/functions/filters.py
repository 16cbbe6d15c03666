"""The column filter language, string matching and other predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json import all_of, any_of


def _number(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


def filter_expr(c: Column, text: str) -> Column:
    """One column filter: contains, =x, !=x, >, >=, <, <=, a..b, empty, !empty.

    Comparisons are numeric if the target is a number (cells that are none never match), else by
    text; equality and contains ignore case. Missing counts as empty; empty never passes < or >.
    """
    cell = F.coalesce(c.cast("string"), F.lit(""))
    low = F.lower(cell)
    t = text.strip()
    if t == "":
        return F.lit(True)
    if t.lower() in ("empty", "!empty"):
        return (cell == "") if t.lower() == "empty" else (cell != "")
    for op in ("!=", ">=", "<=", "=", ">", "<"):
        if t.startswith(op):
            target = t[len(op) :].strip()
            number, n = _number(target), cell.try_cast("double")
            if op in ("=", "!="):
                same = (low == target.lower()) if number is None else F.coalesce(n == number, low == target.lower())
                return same if op == "=" else ~same
            left, right = (low, F.lit(target.lower())) if number is None else (n, F.lit(number))
            compared = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
            return F.coalesce(compared, F.lit(False)) & (cell != "")
    if (m := re.fullmatch(r"(.+?)\.\.(.+)", t)) and None not in (a := (_number(m[1]), _number(m[2]))):
        return F.coalesce(cell.try_cast("double").between(*a), F.lit(False))
    return F.contains(low, F.lit(t.lower()))


def filter_rows(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that pass every column's filter."""
    return df.where(all_of([filter_expr(F.col(k), v) for k, v in filters.items()]))


def matches(c: Column, query: str, case: bool = False, word: bool = False, regex: bool = False) -> Column:
    """Text match by literal or pattern, optionally whole words."""
    body = query if regex else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    body = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" if word else body
    return F.coalesce(c.rlike(("" if case else "(?iu)") + body), F.lit(False))


def normalise_separators(c: Column) -> Column:
    """Lower case, with _ - . / + as spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s_\-./+]+", " "))


def match_fields(columns: list[Column], query: str, together: bool = False) -> Column:
    """Any column holds any word of the query, or the query as a phrase (C11); a blank query keeps all."""
    words = re.sub(r"[\s_\-./+]+", " ", query.lower()).strip()
    if not words:
        return F.lit(True)
    terms = [words] if together else words.split()
    return any_of([F.contains(normalise_separators(c), F.lit(t)) for c in columns for t in terms])


def page_identity(url: Column) -> Column:
    """A page by its id in the URL, else by host and path without trailing slash or fragment."""
    page = F.regexp_extract(url, r"[?&/]page(?:s/|Id=)(\d+)", 1)
    plain = F.concat(F.lower(F.parse_url(url, F.lit("HOST"))), F.rtrim(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))
    return F.when(page != "", F.concat(F.lit("page:"), page)).otherwise(plain)


def ignore_regex(patterns: list[str]) -> str:
    """One pattern for paths: a bare last name, an exact path, * for one step, ** for any (C13); what lies below a match is ignored too."""
    out = []
    for p in patterns:
        body = "".join({"**": ".*", "*": r"[^.\[\]]+"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|[^*]+", p))
        head = r"(?:^|.*[.\]])" if re.fullmatch(r"[\w-]+", p) else "^"
        out.append(rf"{head}{body}(?:$|[.\[].*)")
    return "(?:" + "|".join(out) + ")" if out else r"(?!)"


def ignored(path: Column, patterns: list[str]) -> Column:
    return path.rlike(ignore_regex(patterns))


def inventory_filter(account: str | None = None, kind: str | None = None, region: str | None = None, columns: tuple[str, ...] = ("profile", "account", "type", "service", "region")) -> Column:
    """Rows of an inventory: an account by its profile or its number (with or without dashes), a kind as type or service, a region."""
    profile, number, type_, service, place = (F.col(c) for c in columns)
    out = F.lit(True)
    if account:
        out &= (profile == account) | (number == account.replace("-", ""))
    if kind:
        out &= (type_ == kind) | (service == kind)
    if region:
        out &= place == region
    return F.coalesce(out, F.lit(False))


def belongs_to(url: Column, base: str) -> Column:
    """Same scheme and host, and a path at or below the base's (C14)."""
    m = re.match(r"(\w+)://([^/]+)(/.*?)?/?$", base)
    scheme, host, path = m[1], m[2], m[3] or ""
    own = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    below = (own == path) | own.startswith(path + "/")
    return (F.lower(F.parse_url(url, F.lit("PROTOCOL"))) == scheme.lower()) & (F.lower(F.parse_url(url, F.lit("HOST"))) == host.lower()) & below


def within_days(c: Column, days: int, now: Column) -> Column:
    """At most `days` before now (C17)."""
    return c >= now - F.expr(f"INTERVAL {days} DAYS")


def in_group(df: DataFrame, groups: DataFrame, group: str, domain: str = "domain") -> DataFrame:
    """Rows whose domain is in the group's list; groups: (group_id, domains)."""
    own = groups.where(F.col("group_id") == group).select(F.explode("domains").alias(domain))
    return df.join(own, domain, "left_semi")


def filter_people(df: DataFrame, members: DataFrame | None = None, person: str | None = None, role: str = "any") -> DataFrame:
    """Rows that a person, or any of the members, wrote or updated (C7). Columns creator and author; members: person."""
    roles = {"wrote": ["creator"], "updated": ["author"], "any": ["creator", "author"]}[role]
    if person is not None:
        return df.where(any_of([F.col(r) == person for r in roles]))
    long = df.withColumn("_p", F.explode(F.array_distinct(F.array(*roles)))).join(members.select(F.col("person").alias("_p")), "_p", "left_semi")
    return long.drop("_p").distinct()
