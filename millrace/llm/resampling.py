"""Importance resampling towards a target distribution of hashed word n-grams.

Texts are cut to words by Arrow kernels (ascii_lower, split_pattern_regex, list_flatten,
dictionary_encode), a bounded piece of a batch at a time. Shifted dictionary indices form the
n-grams, each distinct pair of a prefix and a next word is hashed once by CRC-32, and bucket numbers
and gains are taken by index and reduced over the rows' segments. Bucket counts of both tables are
sums that are combined in each task, at most `buckets` rows a task; the gains are one array of
`buckets` numbers. The draw is global: a histogram of whole-number scores gives the score of the
last place, and only rows from there on are sorted by range and numbered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

WORDS = 1  # longest n-gram
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
PIECE_BYTES = 16 << 20  # of texts cut to words at once; a longer text is a piece of its own
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PLACE_BITS = 33  # monotonically_increasing_id counts a partition's rows in the lower 33 bits


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """`texts` in runs of about PIECE_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // PIECE_BYTES
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield texts.slice(lo, hi - lo)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index of each word, first word of each row and the end, distinct words) of a piece."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATORS)
    encoded = pc.list_flatten(lists).dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    keep = np.array([len(w) > 0 for w in words], dtype=bool)[index] if len(index) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return index[keep], before[bounds - bounds[0]], words


def _grams(texts: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of 1 to n words: (bucket of each n-gram in text order, first n-gram of each row and the end)."""
    index, bounds, words = _words(texts)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts, codes = np.arange(len(index)), index
    crc = np.fromiter((zlib.crc32(w) for w in words), dtype=np.int64, count=len(words))
    for size in range(1, n + 1):
        if size > 1:
            whole = starts + size <= ends[starts]
            starts = starts[whole]
            pairs, codes = np.unique(codes[whole] * len(words) + index[starts + size - 1], return_inverse=True)
            prefix, word = np.divmod(pairs, max(1, len(words)))
            crc = np.fromiter((zlib.crc32(b" " + words[w], int(c)) for c, w in zip(crc[prefix], word, strict=True)), dtype=np.int64, count=len(pairs))
        yield np.take(crc % buckets, codes), np.searchsorted(starts, bounds)


def _count(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for piece in _pieces(batch.column(0)):
            for found, _ in _grams(piece, n, buckets):
                total += np.bincount(found, minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of 1 to `n` words of all texts fall in each bucket; buckets without one are left out."""
    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_count, n=n, buckets=buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, targets: DataFrame, text_col: str = "text", target_col: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, 1000 times the log of its smoothed share in `targets` over that in `docs`, floored."""
    counts = []
    for rows, col in ((docs, text_col), (targets, target_col)):
        found = bucket_counts(rows, col, n, buckets).toPandas()  # at most `buckets` rows, whatever the input
        counts.append(np.zeros(buckets))
        counts[-1][found["bucket"]] = found["n"]
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.empty((3, 0), dtype=np.int64)]
        for piece in _pieces(batch.column(batch.num_columns - 1)):
            part = np.zeros((3, len(piece)), dtype=np.int64)  # words, features, gains
            for size, (found, bounds) in enumerate(_grams(piece, n, len(gains)), 1):
                gained = np.concatenate([[0], np.cumsum(np.take(gains, found))])
                part[0] += np.diff(bounds) if size == 1 else 0
                part[1] += np.diff(bounds)
                part[2] += np.diff(gained[bounds])
            parts.append(part)
        words, features, gained = np.concatenate(parts, axis=1)
        weight = gained // np.maximum(features, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (words, features, weight))], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])


def importance(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row.

    weight is the floored mean gain of the row's n-grams, 0 without any; score adds a Gumbel variate
    made from the id and the seed, so that the highest scores are a draw without replacement by
    exp(weight / 1000). A null text has no words; a null id counts as an empty string in the variate.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(partial(_weigh, n=n, gains=gains), "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """`rows` with place: 1, 2, 3... in that order, by one shuffle by range.

    The offset of each part comes from the parts' counts, a table as long as there are partitions.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = written(sorted_rows)
    part = F.shiftright("_at", _PLACE_BITS)
    counts = sorted(map(tuple, sorted_rows.groupBy(part.alias("part")).count().collect()))
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    found = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, targets: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", n: int = WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Every row's (doc_id, n_words, n_features, weight, score, rank); rank is null for rows not drawn.

    Of the N rows with at least `min_words` words, floor(percent * N / 100) of highest score are
    drawn; ties go to the smaller id, then to fewer n-grams; rows without an id come last; rows equal
    in all that keep their order in the table. Repeated rows are rows of their own. Empty tables
    (either) are allowed: without targets all gains come from `docs` alone. Other columns are ignored,
    whatever their names. Texts of any length are read whole.
    """
    gains = bucket_gains(docs, targets, text_col, target_col, n, buckets)
    scored = written(importance(docs, gains, id_col, text_col, n, seed))
    able = F.col("n_words") >= min_words
    # Gains and variates are logarithms of 64-bit counts and 32-bit hashes, so there are under 300,000 different scores.
    by_score = scored.where(able).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    drawn = percent * int(by_score["count"].sum()) // 100
    reached = by_score["count"].cumsum() >= drawn
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    inside = able & (F.col("score") >= int(by_score.loc[reached, "score"].iloc[0]))
    top = scored.where(inside).withColumn("_row", F.monotonically_increasing_id())
    top = _numbered(top, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return top.select(*out, rank).union(scored.where(~inside).select(*out, F.lit(None).cast("long")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resampling": op11_resampling}
ORACLE = {
    "op11_resampling": r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
doc_words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counted AS (
  SELECT w, sum(s) AS s, sum(t) AS t FROM (
    SELECT w, 1 AS s, 0 AS t FROM doc_words UNION ALL SELECT w, 0, 1 FROM target_words) GROUP BY w),
hashed AS MATERIALIZED (
  SELECT w, s, t, xor(4294967295, list_reduce(
    list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM counted, crc_table),
buckets AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000)))) AS BIGINT) AS gain FROM buckets),
weights AS (
  SELECT rid, CAST(count(*) AS BIGINT) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM doc_words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN weights USING (rid)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed""",
}
