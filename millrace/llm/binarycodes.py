"""Embedding near-duplicates by cosine: binary codes decide which pairs are computed exactly.

A vector is scaled to length one and turned by a random rotation (rounds of random signs and a
Walsh-Hadamard transform); its code is the signs, and next to it stands f, the inner product of the
vector with its own code. For any other unit vector q, <code, q> / f estimates <vector, q> without
bias, and misses it by sqrt(1 / f^2 - 1) * sqrt(1 - <vector, q>^2) * x, where x is a coordinate of a
random direction: at most 1 for certain, about 1 / sqrt(dimensions) as a rule. A pair whose estimate
lies so low that no x up to `sigmas` / sqrt(dimensions - 1), nor above 1, allows the threshold is no link; all
others are computed from the original vectors in double precision.

Exact copies are one vector with a count. Vectors are dealt to cells by their nearest pivot (a
bounded sample), cells are cut to tiles, and two tiles meet unless the angles between pivots, less
both cells' radii, exceed the threshold's angle: that cannot lose a link, and on vectors with structure it
keeps most tile pairs from being formed. A tile pair reports each vector's number of links and a
spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written, written_parts
from .components import connected_components

THRESHOLD = 0.9
SIGMAS = 8.0
SEED = 12
TILE_ROWS = 2048
TILE_BYTES = 8 << 20  # of vectors in a tile, at most
PIVOTS = 1024  # at most
ROUND_BYTES = 512 << 20  # of tiles that one round of tile pairs ships, or twice the tiles if that is more
PAIR_BLOCK = 1 << 15  # pairs computed exactly at once
_ROUNDING = 1e-4  # far above the rounding of float32 products of unit vectors

TILE = "dim int, cell int, chunk int, nodes binary, counts binary, vectors binary, codes binary, factors binary"
_BLOBS = ("nodes", "counts", "vectors", "codes", "factors")


@lru_cache(8)
def _signs(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (3, width))


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows of x, padded with zeros to a power of two, turned by the seed's rotation."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for signs in _signs(width, seed):
        y *= signs
        h = 1
        while h < width:
            pairs = y.reshape(len(x), -1, 2, h)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            h *= 2
        y /= np.sqrt(width)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    """Rows other than zero scaled to length one; a power of two first keeps squares within doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def encode(x: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, inner products with the own code) of the rows of x, which have length one."""
    y = rotate(x, seed)
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(y.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded rows with rotated unit rows (queries first)."""
    width = turned.shape[1]
    signs = 2 * np.unpackbits(codes, axis=1, count=width).astype(np.float32) - 1
    return turned.astype(np.float32) @ (signs / (np.sqrt(width) * factors[:, None]).astype(np.float32)).T


def lower_limits(factors: np.ndarray, width: int, threshold: float, sigmas: float) -> np.ndarray:
    """Estimates below these belong to no pair of `threshold` or more."""
    reach = min(1.0, sigmas / np.sqrt(max(width - 1, 1)))
    return threshold - reach * np.sqrt(np.maximum(1 / factors**2 - 1, 0)) * np.sqrt(1 - threshold**2) - _ROUNDING


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller node) links with the components of the links x - y, at most one a node."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:  # smallest label over the links, with jumps
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def tile_links(a: dict, b: dict, same: bool, threshold: float, sigmas: float, seed: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(links of each row of a, of each row of b, a spanning forest): copies count as often as they occur."""
    turned = rotate(a["unit"], seed)
    limit = lower_limits(b["factors"], turned.shape[1], threshold, sigmas).astype(np.float32)
    in_a, in_b = np.zeros(len(a["nodes"]), np.int64), np.zeros(len(b["nodes"]), np.int64)
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(turned), 512):
        p, q = np.nonzero(estimates(b["codes"], b["factors"], turned[i : i + 512]) >= limit)
        p += i
        if same:
            p, q = p[p < q], q[p < q]
        linked = np.empty(len(p), dtype=bool)
        for j in range(0, len(p), PAIR_BLOCK):
            k = slice(j, j + PAIR_BLOCK)
            linked[k] = np.einsum("ij,ij->i", a["unit"][p[k]], b["unit"][q[k]]) >= threshold
        p, q = p[linked], q[linked]
        in_a += np.bincount(p, weights=b["counts"][q], minlength=len(in_a)).astype(np.int64)
        in_b += np.bincount(q, weights=a["counts"][p], minlength=len(in_b)).astype(np.int64)
        x, y = _forest(a["nodes"][p], b["nodes"][q])
        xs.append(x)
        ys.append(y)
    return in_a, in_b, _forest(np.concatenate(xs), np.concatenate(ys))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(c.flatten(), dtype=np.float64) for c in chunks]
    return np.concatenate(flat).reshape(sum(map(len, chunks)), -1)


def _tiler(seed: int):
    def tile(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x = unit(_matrix(t.column("vector")))
        codes, factors = encode(x, seed)
        blobs = (t.column("node").to_numpy(), t.column("n").to_numpy(), x, codes, factors)
        numbers = zip(("dim", "cell", "chunk"), key, strict=True)
        fields = {k: pa.array([v.as_py()], pa.int32()) for k, v in numbers} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(_BLOBS, blobs, strict=True)}
        return pa.table(fields)

    return tile


def _opened(row: dict, side: str, dim: int) -> dict:
    kinds = {"nodes": np.int64, "counts": np.int64, "vectors": np.float64, "codes": np.uint8, "factors": np.float64}
    found = {k: np.frombuffer(row[f"{side}_{k}"], kind) for k, kind in kinds.items()}
    return found | {"unit": found["vectors"].reshape(-1, dim), "codes": found["codes"].reshape(len(found["nodes"]), -1)}


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, sigmas: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, other, n): of n links of a node, or, with n null, a link of the forest."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            a, b = _opened(row, "a", row["dim"]), _opened(row, "b", row["dim"])
            in_a, in_b, (x, y) = tile_links(a, b, row["same"], threshold, sigmas, seed)
            nodes, n = np.concatenate([a["nodes"], b["nodes"]]), np.concatenate([in_a, in_b])
            nodes, n = nodes[n > 0], n[n > 0]
            none = lambda size: pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes, x])), pa.concat_arrays([none(len(nodes)), pa.array(y)]), pa.concat_arrays([pa.array(n), none(len(x))])],
                names=["node", "other", "n"],
            )


def _dealer(pivots: dict[int, np.ndarray]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, node, n, vector, cell, angle): the nearest pivot of the row's dimension and the angle to it."""
        for batch in batches:
            dims, vectors = np.asarray(batch.column(0)), batch.column(3)
            cell, angle = np.full(len(dims), -1, dtype=np.int32), np.full(len(dims), np.pi)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    for i in range(0, len(at), 4096):
                        some = at[i : i + 4096]
                        near = unit(_matrix(pa.chunked_array([vectors.take(pa.array(some))]))) @ pivots[dim].T
                        cell[some] = near.argmax(1)
                        angle[some] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return deal


def cosine_links(distinct: DataFrame, threshold: float = THRESHOLD, sigmas: float = SIGMAS, seed: int = SEED, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Rows (node, other, n) over distinct vectors (dim, node, n, vector), n being how often a vector occurs.

    With `other` null: n links of the node counted by one tile pair, copies as often as they occur.
    With `n` null: a link of a spanning forest; all of them connect what the links connect. Tile pairs are
    compared in rounds, so that the disk holds the shipped tiles of one round and not of all pairs.
    """
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    wanted = max(1, min(pivots, (size["n"] or 0) // tile_rows))
    sample = distinct.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(wanted).select("dim", "vector").collect()  # at most `pivots` rows
    by_dim: dict[int, np.ndarray] = {d: unit(np.array([r["vector"] for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}
    schema = "dim int, node long, n long, vector array<double>, cell int, angle double"
    dealt = written(distinct.select("dim", "node", "n", "vector").mapInArrow(_dealer(by_dim), schema))
    rows_a_tile = F.least(F.lit(tile_rows), F.greatest(F.lit(1), F.floor(TILE_BYTES / (8 * F.col("dim")))))
    # As many rows as pivots and dimensions, whatever the input.
    cells = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / rows_a_tile).cast("int").alias("chunks"), F.max("angle").alias("radius"))
    cells = written(cells)
    rows = dealt.join(cells.select("dim", "cell", "chunks"), ["dim", "cell"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("chunks")).cast("int"))
    tiles = written(rows.select("dim", "cell", "chunk", "node", "n", "vector").groupBy("dim", "cell", "chunk").applyInArrow(_tiler(seed), TILE))
    between = []
    for dim, p in by_dim.items():
        apart = np.arccos(np.clip(p @ p.T, -1, 1))
        between += [(dim, i, j, float(apart[i, j])) for i in range(len(p)) for j in range(i, len(p))]
    between = distinct.sparkSession.createDataFrame(between, "dim int, cell int, other int, apart double")
    alone = cells.where("cell = -1").select("dim", "cell", F.lit(-1).alias("other"), F.lit(0.0).alias("apart"))
    sides = [cells.select("dim", F.col("cell").alias(k), F.col("chunks").alias(f"{k}_chunks"), F.col("radius").alias(f"{k}_radius")) for k in ("cell", "other")]
    met = between.union(alone).join(sides[0], ["dim", "cell"]).join(sides[1], ["dim", "other"])
    met = met.where(F.col("apart") <= F.col("cell_radius") + F.col("other_radius") + F.lit(float(np.arccos(threshold)) + 1e-6))
    met = met.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("cell_chunks") - 1)))
    met = met.withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1)))
    met = written(met.where("cell < other OR chunk <= other_chunk").select("dim", "cell", "chunk", "other", "other_chunk"))
    side = lambda k: [F.col(c).alias(f"{k}_{c}") for c in _BLOBS]
    left = tiles.select("dim", "cell", "chunk", *side("a"))
    right = tiles.select("dim", F.col("cell").alias("other"), F.col("chunk").alias("other_chunk"), *side("b"))
    same = F.expr("cell = other AND chunk = other_chunk").alias("same")

    def compared(some: DataFrame) -> DataFrame:
        pairs = some.join(left, ["dim", "cell", "chunk"]).join(right, ["dim", "other", "other_chunk"])
        pairs = pairs.select("dim", same, *[f"{k}_{c}" for k in "ab" for c in _BLOBS])
        return pairs.mapInArrow(partial(_compare, threshold=threshold, sigmas=sigmas, seed=seed), "node long, other long, n long")

    data = (size["n"] or 0) * (8 * (size["dim"] or 0) + 40)  # of all tiles, about; their pairs ship two tiles each
    count = cells.agg(F.sum("chunks")).first()[0] or 1
    rounds = max(1, math.ceil(met.count() * 2 * data / count / max(round_bytes, 2 * data, 1)))
    turn = F.pmod(F.xxhash64(*met.columns), F.lit(rounds))
    return written_parts(compared(met.where(turn == n)) for n in range(rounds)) if rounds > 1 else compared(met)


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, sigmas: float = SIGMAS,
    seed: int = SEED, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `df`.

    n_links counts the other rows whose cosine with this one is `threshold` (0 to 1) or more.
    component_id is the smallest id reachable by links, the row's own included; kept tells whether it
    is the row's own. Vectors that are null, empty, zero or hold null or non-finite components, and
    vectors of different lengths, have no links. Repeated rows and ids are rows of their own and
    linked like any other. component_id is null only where no row of the group has an id; such rows
    are kept. An empty table gives no rows. Other columns are ignored, whatever their names.

    Up to 65 components no link can be missed; beyond, an estimate would have to be off by more than
    `sigmas` standard deviations.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0, up to 1")
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).withColumn("good", good)
    marks = [F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")]
    good_rows = rows.where("good").select("vec_id", "vector", *marks)
    copies = good_rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    distinct = written(copies.select("h1", "h2", "n", "first_id", "vector", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")))
    links = written(cosine_links(distinct, threshold, sigmas, seed, tile_rows, pivots))
    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("found"))
    roots = connected_components(links.where("n IS NULL"), "node", "other").withColumnRenamed("node", "of")
    named = distinct.select("h1", "h2", "n", "first_id", "node").join(counts, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
    named = written(named.select("h1", "h2", "first_id", F.coalesce("component", "node").alias("root"), (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "n_links", "component_id")
    found = good_rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    found = found.union(rows.where("NOT good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_binary_codes(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_binary_codes": op12_binary_codes}
ORACLE = {
    "op12_binary_codes": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x) USING (vec_id)""",
}
