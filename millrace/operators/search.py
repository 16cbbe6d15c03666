"""Token index, boolean and ranked search, relevance, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json import any_of
from .cut import written

SPLIT = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 10.0, "path": 2.0, "author": 3.0, "text": 1.0, "notes": 4.0}


def build_index(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, token) of the selected fields (M1); write it partitioned or bucketed by token for reuse."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("t")) for f in fields]))
    rows = df.select(id_col, parts.alias("p")).select(id_col, "p.field", F.posexplode(F.filter(F.split(F.lower("p.t"), SPLIT), lambda x: x != "")).alias("pos", "token"))
    return rows


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), lambda x: x != "")


def term_rows(df: DataFrame, id_col: str, fields: list[str], terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """((id, field, pos, token) of the terms alone, (id, len) of all documents), by one pass over the texts.

    The places of the terms are picked inside each row, so no other token is ever a row. Both come from
    one table in the shared folder. Ids must name the documents; repeated ids are one document.
    """
    wanted = list(dict.fromkeys(terms))
    parts = [F.struct(F.lit(f).alias("field"), _tokens(F.col(f)).alias("t")) for f in fields]
    rows = df.select(id_col, F.array(*parts).alias("p"))
    places = lambda p: F.filter(F.transform(p["t"], lambda x, i: F.struct(p["field"].alias("field"), i.alias("pos"), x.alias("token"))), lambda s: s["token"].isin(*wanted))
    length = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.size(p["t"]))
    kept = written(rows.select(id_col, length.alias("len"), F.flatten(F.transform("p", places)).alias("hits")))
    return kept.select(id_col, F.explode("hits").alias("h")).select(id_col, "h.field", "h.pos", "h.token"), kept.groupBy(id_col).agg(F.sum("len").alias("len")).where("len > 0")


def words_of(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[\W_]+", query.lower()) if w]


def having_terms(index: DataFrame, id_col: str, terms: list[str], all_of: bool = True) -> DataFrame:
    """(id): documents that hold all, or any, of the terms (M2)."""
    hits = index.where(F.col("token").isin(*terms)).groupBy(id_col).agg(F.count_distinct("token").alias("k"))
    return hits.where(F.col("k") >= (len(set(terms)) if all_of else 1)).select(id_col)


def having_phrase(index: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """(id): documents in one of whose fields the terms stand one after the other (M2)."""
    which = F.array(*[F.lit(t) for t in terms])
    own = index.where(F.col("token").isin(*terms)).withColumn("i", F.explode(F.filter(F.transform(which, lambda x, i: F.when(x == F.col("token"), i)), lambda i: i.isNotNull())))
    starts = own.groupBy(id_col, "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("k"))
    return starts.where(F.col("k") == len(terms)).select(id_col).distinct()


def tightest(index: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """(id, width): least number of tokens that hold all terms within one field."""
    own = index.where(F.col("token").isin(*terms))
    before = Window.partitionBy(id_col, "field").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for n, t in enumerate(terms):
        own = own.withColumn(f"_t{n}", F.max(F.when(F.col("token") == t, F.col("pos"))).over(before))
    lasts = [F.col(f"_t{n}") for n in range(len(terms))]
    least = F.least(*lasts) if len(lasts) > 1 else lasts[0]
    complete = own.where(~any_of([c.isNull() for c in lasts]))
    return complete.groupBy(id_col).agg(F.min(F.col("pos") - least + 1).alias("width"))


def bm25(index: DataFrame, id_col: str, terms: list[str], weights: dict[str, float] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(id, score): Okapi BM25 with field weights, idf at least 1e-6 (M5).

    Document lengths (id, len) and the average come from `lengths`, by default from the whole index;
    only matching postings are joined.
    """
    weight = F.coalesce(F.create_map(*[x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(v))])[F.col("field")], F.lit(1.0)) if weights else F.lit(1.0)
    lengths = index.groupBy(id_col).agg(F.count(F.lit(1)).alias("len")) if lengths is None else lengths
    totals = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    hits = index.where(F.col("token").isin(*terms)).groupBy(id_col, "token").agg(F.sum(weight).alias("tf"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "token").join(lengths, id_col).crossJoin(F.broadcast(totals))  # a row a term; one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy(id_col).agg(F.sum(part).alias("score"))


def ranked_matches(index: DataFrame, id_col: str, query: str, excluded: str = "", near: int = 10, weights: dict[str, float] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(id, tier, score): documents with all terms and no excluded one; tier 3 exact phrase, 2 all within `near` tokens, 1 all (M3, M4).

    index: (id, field, pos, token) of all tokens, or with `lengths` of these terms at least (`term_rows`, `postings.select`).
    """
    terms = list(dict.fromkeys(words_of(query)))
    found = having_terms(index, id_col, terms)
    if excluded:
        found = found.join(having_terms(index, id_col, words_of(excluded), all_of=False), id_col, "left_anti")
    phrase = having_phrase(index, id_col, words_of(query)).withColumn("_p", F.lit(True))
    rows = found.join(phrase, id_col, "left").join(tightest(index, id_col, terms), id_col, "left").join(bm25(index, id_col, terms, weights, lengths), id_col)
    tier = F.when(F.col("_p"), 3).when(F.col("width") - 1 <= near, 2).otherwise(1)
    return rows.select(id_col, tier.alias("tier"), "score")


def by_relevance(found: DataFrame, docs: DataFrame, id_col: str, title: str, recent: str | None = None, k: int = 20) -> DataFrame:
    """The first `k` of `ranked_matches` with their places: by tier, score, latest time if `recent` names one, then title and id."""
    order = [F.desc("tier"), F.desc("score"), *([F.desc_nulls_last(recent)] if recent else []), F.asc_nulls_last(title), F.asc(id_col)]
    rows = found.join(docs.select(id_col, title, *([recent] if recent else [])), id_col)
    top = rows.orderBy(*order).limit(k)  # a heap a task, then k rows in one
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def search_text(df: DataFrame, id_col: str, text: str, query: str, recency: str | None = None) -> DataFrame:
    """(id, hits): rows whose text holds every word as a substring (M6)."""
    low = F.lower(text)
    terms = query.lower().split()
    own = df.where(~any_of([~F.contains(low, F.lit(t)) for t in terms]))
    hits = sum((F.regexp_count(low, F.lit("\\Q" + t + "\\E")) for t in terms), F.lit(0))
    return own.select(id_col, hits.alias("hits"), *([recency] if recency else []))


def matched_paths(leaves: DataFrame, id_cols: list[str], terms: list[str], k: int = 3, width: int = 60) -> DataFrame:
    """(id..., path, value): the first k leaves that hold a term (M7)."""
    own = leaves.where(any_of([F.contains(F.lower("text"), F.lit(t.lower())) for t in terms]))
    nth = F.row_number().over(Window.partitionBy(*id_cols).orderBy("path"))
    return own.withColumn("_n", nth).where(F.col("_n") <= k).select(*id_cols, "path", F.substring("text", 1, width).alias("value"))


def keyword_hits(df: DataFrame, id_col: str, text: str, words: list[str], group: str, cap: int) -> DataFrame:
    """(group, word, id): at most `cap` hits of a word in a group; a row counts for its first word only (M8)."""
    word = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in words])
    own = df.select(group, word.alias("word"), id_col).where("word IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(group, "word").orderBy(id_col))
    return own.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")


def relevance(df: DataFrame, id_col: str, fields: dict[str, float], query: str, views: str, viewed: str, now: str) -> DataFrame:
    """(id, tier, score, matched): weighted word quality times idf, a title bonus and a usage bonus (M9).

    Quality: 1 for a whole word, 0.6 for the start of one, 0.25 inside. Tiers: 3 phrase, 2 all
    terms, 1 some. idf counts the documents that hold a term in any field.
    """
    terms = list(dict.fromkeys(words_of(query)))
    low = {f: F.regexp_replace(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), SPLIT, " ") for f in fields}
    quality = lambda f, t: F.when(F.concat(F.lit(" "), low[f], F.lit(" ")).contains(f" {t} "), 1.0).when(F.concat(F.lit(" "), low[f]).contains(f" {t}"), 0.6).when(low[f].contains(t), 0.25).otherwise(0.0)
    rows = df.select(
        id_col, *[F.greatest(*[quality(f, t) * w for f, w in fields.items()], F.lit(0.0)).alias(f"_q{n}") for n, t in enumerate(terms)],
        any_of([low[f].contains(" ".join(terms)) for f in fields]).alias("_phrase"), F.col(views).alias("_v"), F.col(viewed).alias("_w"),
    )
    found = [(F.col(f"_q{n}") > 0).cast("int") for n in range(len(terms))]
    rows = rows.withColumn("matched", sum(found, F.lit(0))).where("matched > 0")
    totals = rows.agg(F.count(F.lit(1)).alias("_docs"), *[F.count_if(F.col(f"_q{n}") > 0).alias(f"_d{n}") for n in range(len(terms))])
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    text = sum((F.col(f"_q{n}") * F.log(1 + F.col("_docs") / F.greatest(F.col(f"_d{n}"), F.lit(1))) for n in range(len(terms))), F.lit(0.0))
    usage = 6 * F.log2(1 + F.coalesce("_v", F.lit(0))) + F.when(F.col("_w") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 14 DAYS"), 5).otherwise(0)
    tier = F.when(F.col("_phrase"), 3).when(F.col("matched") == len(terms), 2).otherwise(1)
    return rows.select(id_col, tier.alias("tier"), (text * 10 + usage).alias("score"), "matched")


def snippet(text: Column, terms: list[str], width: int = 120) -> Column:
    """Text around the first match, terms between « and »."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms]
    at = F.least(*places) if len(places) > 1 else places[0]
    cut = F.substring(text, F.greatest(at - width // 3, F.lit(1)), F.lit(width))
    return F.when(at.isNotNull(), F.regexp_replace(cut, "(?i)(" + "|".join("\\Q" + t + "\\E" for t in terms) + ")", "«$1»"))


def search_long_text(leaves: DataFrame, id_cols: list[str], most: int = 200_000) -> DataFrame:
    """(id..., text): every leaf on a line, at most `most` characters."""
    parts = F.array_sort(F.collect_list(F.struct("path", "text")))
    return leaves.groupBy(*id_cols).agg(F.substring(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), 1, most).alias("text"))
