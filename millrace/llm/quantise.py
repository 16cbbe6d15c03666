"""Vector compression to product codes with exact integer arithmetic.

Components become whole numbers, vectors are cut into equal parts, and every part position has a
codebook that is refined by rounds of nearest entry and mean. Squared distances come from matrix
products in float64 BLAS: integers are broken into limbs so narrow that every product, summed over a
part, stays below 2^53 and is exact; the limbs' products are recombined in int64, and the first
smallest distance wins. A round is one pass over the vectors in which each task adds up sums and
counts for its rows; what leaves a task is as large as the codebooks, whatever its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_ROWS = 2048


def limb_bits(length: int) -> int:
    """Widest limbs of which `length` products add up to less than 2^53."""
    return (52 - int(length).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays, lowest first, of which x is the sum times powers of 2^bits; all but the last are 0 to 2^bits - 1."""
    found = []
    while True:
        if not len(x) or (x.min() >= -(1 << bits) and x.max() < 1 << bits):
            return [*found, x.astype(np.float64)]
        found.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def exact_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices whose true values fit int64, by float64 products of limbs."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    for i, a in enumerate(limbs(x.ravel(), bits)):
        for j, b in enumerate(limbs(y.ravel(), bits)):
            total += (a.reshape(x.shape) @ b.reshape(y.shape).T).astype(np.int64) << (bits * (i + j))
    return total


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest row of `book`, its squared distance) for every row of x."""
    d = (book * book).sum(1)[None, :] - 2 * exact_dots(x, book)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(1)


def _blocks(column: pa.Array, dim: int, width: int, scale: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, their whole numbers padded with zeros to `width` a row) in blocks."""
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)
    for i in range(0, len(column), BLOCK_ROWS):
        x = np.zeros((min(BLOCK_ROWS, len(column) - i), width), dtype=np.int64)
        x[:, :dim] = np.floor(flat[i : i + BLOCK_ROWS] * scale)
        yield slice(i, i + len(x)), x


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    parts, entries, length = books.shape
    total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        for _, x in _blocks(batch.column(0), dim, parts * length, scale):
            for p in range(parts):
                part = x[:, p * length : (p + 1) * length]
                at, _ = nearest_entries(part, books[p])
                for i in range(length):  # a block's sums stay far below 2^53
                    total[p, :, i] += np.bincount(at, weights=part[:, i], minlength=entries).astype(np.int64)
                count[p] += np.bincount(at, minlength=entries)
    p, e = np.nonzero(count)
    values = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * length, pa.array(total[p, e].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), values], names=["part", "entry", "n", "sums"])


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    parts, _, length = books.shape
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])], dtype=object)
    for batch in batches:
        code, error = np.full(batch.num_rows, "", dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
        for rows, x in _blocks(batch.column(batch.num_columns - 1), dim, parts * length, scale):
            for p in range(parts):
                at, d = nearest_entries(x[:, p * length : (p + 1) * length], books[p])
                code[rows] += digits[at]
                error[rows] += d
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error)], names=[*batch.schema.names[:-1], "code", "error"])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector holds finite components only."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def _able(dim: int, scale: int) -> F.Column:
    """Vectors of `dim` components so small that the sum of squared distances over all parts fits int64."""
    most = isqrt((1 << 61) // max(dim, 1)) / scale
    return (F.size("vector") == dim) & F.forall("vector", lambda x: F.abs(x) < F.lit(most))


def fit_codebooks(
    rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> np.ndarray:
    """Codebooks (part, entry, position) from `rows` (vec_id, vector), all of `dim` components within the integer bound.

    They start as the parts of the rows of smallest ids (rows without an id last, ties by vector) and
    are refined by `rounds` of nearest entry and componentwise floor of the mean over all rows.
    """
    length = -(-dim // parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()  # at most `entries` rows
    start = np.zeros((len(first), parts * length), dtype=np.int64)
    start[:, :dim] = np.floor(np.array([r["vector"] for r in first], dtype=np.float64).reshape(len(first), dim) * scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, length).transpose(1, 0, 2))
    if not len(first) or not length:
        return books
    for _ in range(rounds):
        found = rows.select("vector").mapInArrow(partial(_sums, books=books, dim=dim, scale=scale), "part long, entry long, n long, sums array<long>")
        places = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length)])
        books = books.copy()
        for r in places.collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(length)]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row with a finite vector.

    Rows whose vector is null or holds null or non-finite components are dropped. The dimension is
    that of the first vector in the codebooks' order; a row of another dimension, or with a component
    so large that squared distances leave int64, takes no part and has null code and error. A
    dimension that `parts` does not divide is padded with zeros, which stand in the codebooks too.
    Fewer rows than `entries` give shorter codebooks; empty tables give no rows. Repeated rows and ids
    are rows of their own. label_error adds the errors of equal labels, null labels together. Other
    columns are ignored. `entries` may be 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits a part")
    rows = whole_vectors(df, id_col, vector_col, label_col)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("dim")).first()
    dim = first["dim"] if first else 0
    able = _able(dim, scale)
    books = fit_codebooks(rows.where(able).select("vec_id", "vector"), dim, parts, entries, rounds, scale)
    kind = rows.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {kind}, code string, error long"
    coded = rows.where(able).mapInArrow(partial(_encode, books=books, dim=dim, scale=scale), out)
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    coded = written(coded.union(rows.where(~able).select("vec_id", "label", *none)))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumnRenamed("label", "of_label")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {"op13_codes": op13_codes}


def _assigned(books: str, name: str) -> str:
    """SQL: the nearest entry of every part, ties to the lower index."""
    return f"""{name} AS MATERIALIZED (
  SELECT vec_id, label, part, v, arg_min(entry, [d, entry]) AS entry, min(d) AS d FROM (
    SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN {books} b USING (part)) GROUP BY vec_id, label, part, v)"""


def _updated(books: str, assigned: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
      SELECT part, entry, pos, CAST(floor(sum(v[pos]) / count(*)) AS BIGINT) AS mean
      FROM {assigned}, (SELECT unnest(range(1, 5)) AS pos) GROUP BY part, entry, pos) GROUP BY part, entry) m
  USING (part, entry))"""


ORACLE = {
    "op13_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, x[4 * part + 1 : 4 * part + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
books0 AS MATERIALIZED (SELECT part, entry, v AS c FROM parts JOIN first USING (vec_id)),
{_assigned("books0", "near0")},
{_updated("books0", "near0", "books1")},
{_assigned("books1", "near1")},
{_updated("books1", "near1", "books2")},
{_assigned("books2", "near2")},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest""",
}
