"""Nearest neighbours by vantage-point trees, one tree per shard.

All rows are dealt evenly over shards of about `shard_rows`; a shard's tree is built where the shard
is and kept as one row of arrays. Query rows are packed in blocks, every block meets every shard by
an equi-join on the shard number, and a whole block descends a tree together. A subtree is left out
for a query if the triangle inequality puts its rows at least tau / factor away, tau being the
distance of the k-th nearest found so far: factor one is exact, larger factors prune more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SHARD_ROWS = 16384
SHARD_BYTES = 64 << 20  # of vectors in a shard, at most
BLOCK_ROWS = 1024
LEAF = 256
FACTOR = 1.0
SEED = 5

TREE = "dim int, shard int, ids binary, vectors binary, vantage binary, nodes binary, bounds binary"


def _distance(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in the order of the dimensions."""
    total = np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        d = q[:, i, None] - x[None, :, i]
        total += d * d
    return np.sqrt(total)


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = SEED) -> dict[str, np.ndarray]:
    """Arrays of a vantage-point tree; rows are permuted so that every node is a range of them.

    nodes: (from, to, inner child, outer child), children -1 in leaves. bounds: (largest distance to
    the vantage point inside, smallest outside). Halves are cut by rank, so equal rows cause no harm.
    """
    rng = np.random.default_rng(seed)
    order = np.arange(len(x))
    nodes, bounds, vantage = [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        nodes.append([lo, hi, -1, -1])
        bounds.append([0.0, 0.0])
        v = x[order[rng.integers(lo, hi)]]
        vantage.append(v)
        if hi - lo > leaf:
            d = _distance(v[None, :], x[order[lo:hi]])[0]
            half = (hi - lo) // 2
            cut = np.argpartition(d, half)
            order[lo:hi] = order[lo:hi][cut]
            bounds[at] = [d[cut[:half]].max(), d[cut[half:]].min()]
            todo += [(lo + half, hi, at, 1), (lo, lo + half, at, 0)]
    return {
        "ids": ids[order], "vectors": x[order], "vantage": np.array(vantage),
        "nodes": np.array(nodes, dtype=np.int64), "bounds": np.array(bounds),
    }


class Search:
    """A block of queries going down a tree; the k best found so far for each."""

    def __init__(self, tree: dict, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.t, self.query_ids, self.q, self.k, self.factor = tree, query_ids, q, k, factor
        self.best = np.full((len(q), k), np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = 0
        self.visit(0, np.arange(len(q)))

    def visit(self, node: int, who: np.ndarray) -> None:
        lo, hi, inner, outer = self.t["nodes"][node]
        if inner < 0:
            self.leaf(lo, hi, who)
            return
        most, least = self.t["bounds"][node]
        d = _distance(self.q[who], self.t["vantage"][node][None, :])[:, 0]
        near = d - most < least - d
        for first, mask in ((inner, near), (outer, ~near)):
            if mask.any():
                self.visit(first, who[mask])
        for second, mask, bound in ((outer, near, least - d), (inner, ~near, d - most)):
            mask = mask & (bound * self.factor <= self.best[who, -1])
            if mask.any():
                self.visit(second, who[mask])

    def leaf(self, lo: int, hi: int, who: np.ndarray) -> None:
        """Matrix products tell which rows can enter the best; those are measured exactly."""
        ids, x, q = self.t["ids"][lo:hi], self.t["vectors"][lo:hi], self.q[who]
        self.compared += len(q) * len(x)
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        rough = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
        rough[self.query_ids[who][:, None] == ids[None, :]] = np.inf
        limit = self.best[who, -1] ** 2
        if len(x) > self.k:
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
        error = 1e-9 * (qq + xx.max())  # far above the rounding of the products
        able = (rough <= (limit + error)[:, None]) & np.isfinite(rough)
        row, col = np.nonzero(able)
        if not len(row):
            return
        total = np.zeros(len(row))
        for i in range(q.shape[1]):
            d = q[row, i] - x[col, i]
            total += d * d
        place = (np.cumsum(able, axis=1) - 1)[row, col]
        d = np.full((len(q), int(place.max()) + 1), np.inf)
        i = np.full(d.shape, np.iinfo(np.int64).max)
        d[row, place], i[row, place] = np.sqrt(total), ids[col]
        all_d, all_i = np.concatenate([self.best[who], d], axis=1), np.concatenate([self.found[who], i], axis=1)
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.best[who] = np.take_along_axis(all_d, order, 1)
        self.found[who] = np.take_along_axis(all_i, order, 1)


def _vectors(t: pa.Table) -> np.ndarray:
    flat = t.column("vector").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, dtype=np.float64).reshape(t.num_rows, -1)


def _planter(leaf: int):
    def plant(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        tree = build_tree(t.column("vec_id").to_numpy(), _vectors(t), leaf)
        row = {"dim": [key[0].as_py()], "shard": [key[1].as_py()]} | {k: [v.tobytes()] for k, v in tree.items()}
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), *((k, pa.binary()) for k in tree)]))

    return plant


def _bundle(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    return pa.table(
        {"dim": pa.array([key[0].as_py()], pa.int32()), "query_ids": [t.column("vec_id").to_numpy().tobytes()], "queries": [_vectors(t).tobytes()]},
        schema=pa.schema([("dim", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())]),
    )


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            tree = {
                "ids": np.frombuffer(row["ids"], np.int64), "vectors": np.frombuffer(row["vectors"]).reshape(-1, dim),
                "vantage": np.frombuffer(row["vantage"]).reshape(-1, dim), "nodes": np.frombuffer(row["nodes"], np.int64).reshape(-1, 4),
                "bounds": np.frombuffer(row["bounds"]).reshape(-1, 2),
            }
            ids = np.frombuffer(row["query_ids"], np.int64)
            s = Search(tree, ids, np.frombuffer(row["queries"]).reshape(-1, dim), k, factor)
            real = np.isfinite(s.best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, real.sum(1))), pa.array(s.found[real]), pa.array(s.best[real]), pa.array(np.full(int(real.sum()), s.compared / max(1, real.sum())))],
                names=["query_id", "vec_id", "score", "compared"],
            )


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, dim) of rows with an id and a finite vector other than zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    factor: float = FACTOR, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, ties to smaller ids.

    A query's own row (its id) is no candidate. Vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of different lengths never meet. Of several query
    rows with one id the smallest vector asks; repeated candidate rows are rows of their own. Empty
    tables give no rows. Rows without an id take no part. Other columns are ignored.
    """
    all_rows = usable_vectors(rows, id_col, vector_col)
    found = all_rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    shards = max(1, -(-found["n"] // max(1, min(shard_rows, shard_bytes // (8 * found["dim"])))))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    trees = all_rows.withColumn("shard", spread).groupBy("dim", "shard").applyInArrow(_planter(leaf), TREE)
    asking = usable_vectors(queries, id_col, vector_col).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asking.count() // block_rows))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    bundles = asking.groupBy("dim", "block").applyInArrow(_bundle, "dim int, query_ids binary, queries binary")
    bundles = bundles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = bundles.join(trees, ["dim", "shard"])
    found = met.mapInArrow(partial(_search, k=k, factor=factor), "query_id long, vec_id long, score double, compared double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vptree(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op3_vptree": op3_vptree}
ORACLE = {
    "op3_vptree": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
WHERE rank <= 10""",
}
