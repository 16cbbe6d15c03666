"""Change capture: hashes, field and record differences, upserts, logs and merges."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json import cell_text, json_type
from ..sources.documents import walk


def content_hash(columns: list[str], volatile: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical JSON of known columns: sorted names, no volatile ones, list order ignored."""
    own = [F.array_sort(c).alias(c) if c in lists else F.col(c) for c in sorted(columns) if c not in volatile]
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def _canonical(value, path: str, volatile: re.Pattern):
    """JSON with sorted lists and without the members whose path (.a.b, lists as []) matches `volatile`."""
    if isinstance(value, dict):
        return {k: _canonical(v, f"{path}.{k}", volatile) for k, v in value.items() if not volatile.search(f"{path}.{k}")}
    if isinstance(value, list):
        return sorted((_canonical(v, path + "[]", volatile) for v in value), key=_text)
    return value


def _text(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda d: {"number": str(d)})


def document_hash(df: DataFrame, id_cols: list[str], value_col: str, volatile: str = "(?!)") -> DataFrame:
    """(id..., hash) of any JSON: SHA-256 of its canonical text, volatile keys dropped at any depth, list order ignored.

    Lists are sorted as wholes, so elements that swap inner fields change the hash. Built-in
    functions cannot recurse into values of unknown shape, so this is one Arrow-batched function of a
    row's own value: no shuffle.
    """
    pattern = re.compile(volatile)

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _text(_canonical(json.loads(t, parse_float=Decimal), "", pattern)))

    return df.select(*id_cols, F.sha2(canonical(F.to_json(value_col)), 256).alias("hash"))


def field_diff(before: DataFrame, after: DataFrame, id_cols: list[str], value_col: str, limit: int = 200, ignore: Column | None = None) -> DataFrame:
    """(id..., path, op, old, new): added, removed and changed values.

    Lists of equal length are compared by index, others whole; what lies below a value that differs
    in kind, length or presence is not listed again. The first `limit` paths of an id are kept.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        w = walk(df, id_cols, value_col).where("depth > 0")
        kind = json_type(F.col("v"))
        size = F.when(kind == "array", F.array_size(F.try_variant_get("v", "$", "array<variant>")))
        return w.select(*id_cols, "path", kind.alias(f"{name}_kind"), size.alias(f"{name}_size"), F.to_json("v").alias(f"{name}_json"), cell_text(F.col("v")).alias(f"{name}_text"))

    both = side(before, "old").join(side(after, "new"), [*id_cols, "path"], "full_outer")
    inner = (F.col("old_kind") == "object") & (F.col("new_kind") == "object") | (F.col("old_kind") == "array") & (F.col("new_kind") == "array") & (F.col("old_size") == F.col("new_size"))
    op = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").when(F.col("old_json") != F.col("new_json"), "changed")
    marked = both.withColumns({"inner": F.coalesce(inner, F.lit(False)), "op": op})
    reported = marked.where("op IS NOT NULL AND NOT inner").where(~ignore if ignore is not None else F.lit(True))
    # A path is dropped if one of its own prefixes is reported.
    prefixes = F.transform(F.filter(F.sequence(F.lit(2), F.char_length("path")), lambda i: F.substring("path", i, F.lit(1)).isin(".", "[")), lambda i: F.substring("path", F.lit(1), i - 1))
    parents = reported.select(*id_cols, "path", F.explode(prefixes).alias("above"))
    heads = reported.select(*id_cols, F.col("path").alias("above"))
    hidden = parents.join(heads, [*id_cols, "above"], "left_semi").select(*id_cols, "path").distinct()
    kept = reported.join(hidden, [*id_cols, "path"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*id_cols).orderBy("path"))
    return kept.withColumn("_n", nth).where(F.col("_n") <= limit).select(*id_cols, "path", "op", F.col("old_text").alias("old"), F.col("new_text").alias("new"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., status, changed): records added, removed, changed (with the changed columns) or unchanged."""
    a = before.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = after.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.select(*key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("changed"))


def record_id(candidates: list[Column]) -> Column:
    """The first non-blank of ordered id candidates."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])


def upsert_plan(stored: DataFrame, incoming: DataFrame, key: list[str], hash_col: str = "hash") -> DataFrame:
    """(key..., action): insert, update (hash missing or different), delete or keep."""
    a = stored.select(*key, F.col(hash_col).alias("_a"), F.lit(True).alias("_s"))
    b = incoming.select(*key, F.col(hash_col).alias("_b"), F.lit(True).alias("_i"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_i").isNull(), "delete").when(F.col("_a").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def apply_upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows after the plan: incoming rows replace and add, absent ones go."""
    return incoming.select(*stored.columns)


def detect_changes(before: DataFrame, after: DataFrame, key: list[str], group: str, failed: DataFrame, hash_col: str = "hash") -> DataFrame:
    """(key..., action): added, modified, removed; a group whose listing failed keeps its rows."""
    plan = upsert_plan(before, after, key, hash_col).where("action <> 'keep'")
    bad = failed.select(group).distinct().withColumn("_f", F.lit(True))
    plan = plan.join(bad, group, "left").where("action <> 'delete' OR _f IS NULL").drop("_f")
    name = F.when(F.col("action") == "insert", "added").when(F.col("action") == "update", "modified").otherwise("removed")
    return plan.withColumn("action", name)


def append_since(log: DataFrame, stored: DataFrame, run: str) -> DataFrame:
    """Log rows newer than the last stored run."""
    last = stored.agg(F.max(run).alias("_last"))
    return log.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(run) > F.col("_last"))).drop("_last")


def changed_since(changes: DataFrame, key: list[str], run: str, day: str) -> DataFrame:
    return changes.where((F.col(run) >= day) & F.col("action").isin("added", "modified")).select(*key).distinct()


def detect_page_changes(stored: DataFrame, pages: DataFrame, start: str) -> DataFrame:
    """(page_id, kind): new or updated pages since `start` whose fingerprint differs and is not older.

    stored: page_id, version, updated; pages: page_id, version, created, updated.
    """
    s = stored.select("page_id", F.col("version").alias("_v"), F.col("updated").alias("_u"))
    day = F.lit(start).cast("timestamp")
    met = pages.where(F.col("updated") >= day).join(s, "page_id", "left")
    differs = F.col("_v").isNull() | ((F.col("version") != F.col("_v")) | (F.col("updated") != F.col("_u"))) & (F.col("version") >= F.col("_v"))
    kind = F.when(F.col("_v").isNull() & (F.col("created") >= day), "new").otherwise("updated")
    return met.where(differs).select("page_id", kind.alias("kind"), "version")


def purge(pages: DataFrame, key: str, ts: str, now: str, days: int = 183) -> DataFrame:
    """Pages with activity in the last `days` days."""
    return pages.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def plan_file_changes(changes: DataFrame) -> DataFrame:
    """(path, action): refresh or drop; MOVE refreshes the new path and drops the source; a path both dropped and refreshed is kept."""
    refresh = changes.where("type IN ('ADD', 'MODIFY', 'MOVE', 'COPY')").select("path").distinct()
    drop = changes.where("type = 'DELETE'").select("path").union(changes.where("type = 'MOVE'").select("src_path")).distinct()
    return refresh.withColumn("action", F.lit("refresh")).union(drop.join(refresh, "path", "left_anti").withColumn("action", F.lit("drop")))


def refresh_documents(stored: DataFrame, incoming: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
    """(key..., outcome, kept...): new, unchanged by commit or by content, or updated; user fields stay.

    Both sides: commit_id, hash; stored also the kept columns.
    """
    s = stored.select(*key, F.col("commit_id").alias("_c"), F.col("hash").alias("_h"), *kept)
    both = incoming.select(*key, "commit_id", "hash").join(s, key, "left")
    outcome = F.when(F.col("_c").isNull(), "new").when((F.col("_c") == F.col("commit_id")) | (F.col("_h") == F.col("hash")), "unchanged").otherwise("updated")
    return both.select(*key, outcome.alias("outcome"), *kept)


def record_failures(stored: DataFrame, failed: DataFrame, succeeded: DataFrame, key: str) -> DataFrame:
    """(key, attempts, error): failures with one more attempt, cleared on success."""
    s = stored.select(key, "attempts", F.col("error").alias("_e"))
    both = s.join(failed.select(key, F.col("error").alias("_new")), key, "full_outer")
    out = both.select(key, (F.coalesce("attempts", F.lit(0)) + F.col("_new").isNotNull().cast("int")).alias("attempts"), F.coalesce("_new", "_e").alias("error"))
    return out.join(succeeded.select(key), key, "left_anti")


def count_events(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))


def refresh_candidates(status: DataFrame, hints: DataFrame, parents: DataFrame, rounds: int = 5) -> DataFrame:
    """Types due for listing: always on, hinted, never seen, with rows or failed, unless blocked by own or parent's permission; parents are added.

    status: type, always, rows, failed, blocked; hints: type; parents: type, parent.
    """
    up = parents.select("type", "parent")
    blocked = status.where("blocked").select("type")
    below = up.join(blocked.withColumnRenamed("type", "parent"), "parent", "left_semi").select("type")
    out = blocked.union(below).distinct()
    hinted = hints.select("type").distinct().withColumn("_h", F.lit(True))
    due = status.join(hinted, "type", "left").where("always OR _h OR rows IS NULL OR rows > 0 OR failed").join(out, "type", "left_anti").select("type")
    for _ in range(rounds):
        due = due.union(due.join(up, "type").select(F.col("parent").alias("type"))).distinct()
    return due


def merge_fields(stored: DataFrame, refreshed: DataFrame, key: str, owned: list[str], fields: list[str]) -> DataFrame:
    """Refreshed fields overwrite, user fields and deletions win (J20); deleted stored rows are absent from `stored`."""
    r = refreshed.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    return stored.join(r, key, "left").select(key, *owned, *[F.coalesce(f"_r_{f}", f).alias(f) for f in fields])


def mirror(stored: DataFrame, seen: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Seen pages replace, unseen go, failed keep their earlier copy."""
    earlier = stored.join(failed.select(key), key, "left_semi").join(seen.select(key), key, "left_anti")
    return seen.unionByName(earlier)


def stale(accounts: DataFrame, saved: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys whose saved state is newer than the stored one, or not stored at all."""
    a = accounts.select(key, F.col(ts).alias("_t"))
    return saved.join(a, key, "left").where(F.col("_t").isNull() | (F.col(ts) > F.col("_t"))).select(key)


def list_changes(before: Column, after: Column) -> Column:
    """[+] and [-] entries of lists compared as sets (H1, H2)."""
    plus = F.transform(F.array_sort(F.array_except(after, before)), lambda x: F.concat(F.lit("[+] "), x.cast("string")))
    minus = F.transform(F.array_sort(F.array_except(before, after)), lambda x: F.concat(F.lit("[-] "), x.cast("string")))
    return F.concat(plus, minus)


def only_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key..., side): keys on one side only (H3)."""
    left = a.select(*key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("source"))
    return left.union(b.select(*key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("target")))


def work_list(parts: list[DataFrame], deleted: DataFrame, key: str) -> DataFrame:
    """Union of change sets without the deleted (H4, H5)."""
    return reduce(DataFrame.union, [p.select(key) for p in parts]).distinct().join(deleted, key, "left_anti")
