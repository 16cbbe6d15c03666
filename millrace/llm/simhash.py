"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile.

Distinct fingerprints are laid out in tiles by the population counts of their four 16-bit words. Two
fingerprints within Hamming distance r have count vectors within L1 distance r, so a tile meets only
the tiles whose counts differ by r in all; every other tile pair is skipped. A count vector with
many fingerprints is split into chunks, which are tiles of their own. Tiles that meet are compared
whole with numpy exclusive-or and bit counts. A tile pair reports a spanning forest of its links
(at most one link a member), so a large group of near copies never turns into all its pairs; the
forests of all tile pairs have the same connected components as all links together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table, written
from .components import connected_components

RADIUS = 2
WORDS = 3
SEED = 42
CHUNK = 4096  # fingerprints a tile, about
NEAR_WORDS = 5  # words a shingle for near copies by exact similarity
NEAR_RADIUS = 16  # differing bits up to which such a pair is compared
NEAR_CHUNK = 2048
SIMILARITY = 0.8
_SPACE = re.compile("[\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def word_shingles(text: str | None, words: int) -> list[str]:
    """All runs of `words` words of the text, or all its words if they are fewer; no word: none."""
    found = [w for w in _SPACE.split((text or "").translate(_UPPER)) if w]
    if len(found) < words:
        return [" ".join(found)] if found else []
    return list(map(" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles; no word: 0."""
    return _majority(word_shingles(text, words))


def _majority(shingles: list[str]) -> int:
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), words: int = WORDS) -> DataFrame:
    """(doc_id, keep..., fp) of every row; fp is the fingerprint as a signed 64-bit number; keep: bigint columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), "".join(f"{c} long, " for c in ("doc_id", *keep)) + "fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected by pairs within `radius` between (or in) the tiles."""
    x, y = [], []
    for i in range(0, len(a), 512):
        p, q = np.nonzero(np.bitwise_count(a[i : i + 512, None] ^ b[None, :]) <= radius)
        x.append(p + i)
        y.append(q)
    p, q = np.concatenate(x), np.concatenate(y)
    if same:
        p, q = p[p < q], q[p < q]
    nodes, at = np.unique(np.concatenate([a[p], b[q]]), return_inverse=True)
    p, q = at[: len(p)], at[len(p) :]
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


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = (batch.column(i) for i in range(3))
            xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                a, b = (np.asarray(c[i].values, dtype=np.int64).view(np.uint64) for c in (left, right))
                x, y = _forest(a, b, radius, same[i].as_py())
                xs.append(x.view(np.int64))
                ys.append(y.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within `radius`."""
    counts = F.array(*[F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)])
    code = lambda v: F.aggregate(v, F.lit(0), lambda acc, x: acc * 17 + x)
    rows = distinct.select("fp", code(counts.cast("array<int>")).alias("vector"))
    # At most 17^4 count vectors exist, whatever the input, so this table may be broadcast.
    chunks = rows.groupBy("vector").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(chunks), "vector").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiles = rows.groupBy("vector", "chunk").agg(F.collect_list("fp").alias("fps"), F.first("chunks").alias("chunks"))
    tiles = durable(tiles)
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    digits = F.array(*[(F.floor(F.col("vector") / 17**i) % 17).cast("int") for i in (3, 2, 1, 0)])
    near = tiles.select("vector", "chunk", digits.alias("digits")).select(
        "vector", "chunk", "digits",
        F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps])).alias("step"),
    )
    near = near.withColumn("other", F.zip_with("digits", "step", lambda x, s: x + s))
    near = near.where(F.forall("other", lambda x: x.between(0, 16))).withColumn("other", code(F.col("other")))
    near = near.where("vector <= other").join(F.broadcast(chunks.withColumnRenamed("vector", "other")), "other")
    near = near.select("vector", "chunk", "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other_chunk"))
    near = near.where("vector < other OR chunk <= other_chunk")
    left = tiles.select("vector", "chunk", F.col("fps").alias("left"))
    right = tiles.select(F.col("vector").alias("other"), F.col("chunk").alias("other_chunk"), F.col("fps").alias("right"))
    pairs = near.join(left, ["vector", "chunk"]).join(right, ["other", "other_chunk"])
    same = F.expr("vector = other AND chunk = other_chunk")
    return pairs.select("left", "right", same.alias("same")).mapInArrow(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, fingerprint) of every row of `docs`.

    component_id is the smallest doc_id reachable over links of `radius` or fewer differing bits,
    the row's own included; null only where the whole group has no id. Null, empty and blank texts
    have fingerprint zero and are linked like any other; repeated rows stay rows of their own; other
    columns are ignored. An empty table gives no rows.
    """
    rows = durable(fingerprints(docs, id_col, text_col))
    groups = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(fingerprint_links(groups.select("fp"), radius))
    roots = durable(groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with two hashes of the whole row, which name it whatever its id, and their names, which clash with no column."""
    plain = lambda f: not re.search("map<|variant|interval|udt", f.dataType.simpleString())  # noqa: E731  others have no hash of their own
    every = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    k1, k2 = f"{free}k1", f"{free}k2"
    return docs.select("*", F.xxhash64(*every).alias(k1), F.xxhash64(*every, F.lit(1)).alias(k2)), k1, k2


def _first_of(keyed: DataFrame, k1: str, k2: str, named: DataFrame) -> DataFrame:
    """The first row of each group by (doc_id, row key), ids before nulls; named: (doc_id, k1, k2, group)."""
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(k1), F.col(k2))
    heads = named.groupBy("group").agg(F.min_by(F.struct(k1, k2), place).alias("head")).select("head.*")
    found = keyed.join(heads, [k1, k2], "left_semi")
    return found.dropDuplicates([k1, k2]).drop(k1, k2)  # rows equal in every column


def _marks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sizes = [], []
        for text in batch.column(2).to_pylist():
            shingles = word_shingles(text, words)
            fps.append(_majority(shingles))
            sizes.append(len(set(shingles)))
        marks = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *marks], names=["t1", "t2", "fp", "n"])


def _near(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, hubs: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (p, q) of two tiles that can be similar and have different labels.

    With `hubs`, each member gives only the pair with that neighbour which has most neighbours.
    """
    for batch in batches:
        rows = [[np.asarray(c[i].values) for c in batch.columns[:8]] for i in range(batch.num_rows)]
        ps, qs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (a, an, al, ai, b, bn, bl, bi), same in zip(rows, batch.column(8).to_pylist(), strict=True):
            a, b = a.view(np.uint64), b.view(np.uint64)
            x, y = [], []
            for i in range(0, len(a), 256):
                p, q = np.nonzero(np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius)
                p += i
                ok = (al[p] != bl[q]) & (np.minimum(an[p], bn[q]) >= similarity * np.maximum(an[p], bn[q]))
                if same:
                    ok &= p < q
                x.append(p[ok].astype(np.int32))
                y.append(q[ok].astype(np.int32))
            p, q = np.concatenate(x), np.concatenate(y)
            if hubs and len(p):
                if same:
                    p, q = np.concatenate([p, q]), np.concatenate([q, p])
                most = np.bincount(p, minlength=len(a)), np.bincount(q, minlength=len(b))
                pairs = []
                for k, (own, other, degree) in enumerate(((p, q, most[1]), (q, p, most[0]))):
                    order = np.lexsort((other, -degree[other], own))
                    first = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
                    pairs.append((own[first], other[first]) if k == 0 else (other[first], own[first]))
                    if same:
                        break
                p, q = (np.concatenate(v) for v in zip(*pairs, strict=True))
            ps.append(ai[p])
            qs.append(bi[q])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ps)), pa.array(np.concatenate(qs))], names=["p", "q"])


def _near_pairs(marks: DataFrame, radius: int, similarity: float, chunk: int, hubs: bool) -> DataFrame:
    """Candidates (p, q) of marks (t1, fp, n, label): at most `radius` bits apart, of sizes that allow the similarity.

    Tiles are made by size: a class holds sizes within a factor of 1 / similarity, so only tiles of
    the same class and the next can hold a similar pair.
    """
    width = math.log(1 / similarity) * 1.0001 if similarity < 1 else 0.0001
    group = F.when(F.col("n") == 0, -10).otherwise(F.floor(F.log(F.greatest("n", F.lit(1))) / width)).cast("int")
    rows = marks.withColumn("class", group)
    # At most a few hundred classes exist, whatever the input, so this table may be broadcast.
    chunks = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(chunks), "class").withColumn("chunk", F.pmod(F.xxhash64("t1", F.lit(5)), F.col("chunks")).cast("int"))
    both = F.sort_array(F.collect_list(F.struct("fp", "n", "label", "t1"))).alias("m")
    tiles = rows.groupBy("class", "chunk").agg(both, F.first("chunks").alias("chunks"))
    tiles = durable(tiles.select("class", "chunk", *[F.col(f"m.{c}").alias(c) for c in ("fp", "n", "label", "t1")]))
    met = tiles.select("class", "chunk", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("other"))
    met = met.join(F.broadcast(chunks.withColumnRenamed("class", "other")), "other")
    met = met.select("class", "chunk", "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other_chunk"))
    met = met.where("class < other OR chunk <= other_chunk")
    side = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in ("fp", "n", "label", "t1")]
    left = tiles.select("class", "chunk", *side("a"))
    right = tiles.select(F.col("class").alias("other"), F.col("chunk").alias("other_chunk"), *side("b"))
    pairs = met.join(left, ["class", "chunk"]).join(right, ["other", "other_chunk"])
    same = F.expr("class = other AND chunk = other_chunk").alias("same")
    columns = [f"{x}_{c}" for x in "ab" for c in ("fp", "n", "label", "t1")]
    found = pairs.select(*columns, same).mapInArrow(partial(_near, radius=radius, similarity=similarity, hubs=hubs), "p long, q long")
    return found.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct() if hubs else found


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    shingles = lru_cache(64)(lambda text: frozenset(word_shingles(text, words)))
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = shingles(left), shingles(right)
            both = len(x & y)
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_copies(texts: DataFrame, words: int = NEAR_WORDS, radius: int = NEAR_RADIUS, similarity: float = SIMILARITY, chunk: int = NEAR_CHUNK) -> DataFrame:
    """(node, component) over texts whose exact Jaccard similarity of word shingles is `similarity` or more.

    texts: t1, t2, text, each text once; nodes are t1. Pairs up to `radius` bits apart are candidates.
    Each text is first compared with its best connected neighbours of each tile pair, so that a large
    group of copies comes together by few comparisons; every candidate pair that is still in
    different components is then compared. Texts without a word are all alike.
    """
    texts = texts.where("t1 IS NOT NULL")
    marks = durable(texts.mapInArrow(partial(_marks, words=words), "t1 long, t2 long, fp long, n long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(texts.select(F.col("t1").alias("p"), F.col("text").alias("left")), "p")
        met = met.join(texts.select(F.col("t1").alias("q"), F.col("text").alias("right")), "q").select("p", "q", "left", "right")
        return durable(met.mapInArrow(partial(_confirmed, words=words, similarity=similarity), "p long, q long"))

    links = confirmed(_near_pairs(marks.withColumn("label", F.col("t1")), radius, similarity, chunk, hubs=True))
    roots = connected_components(links, "p", "q")
    labelled = marks.join(roots, F.col("t1") == F.col("node"), "left").select("t1", "fp", "n", F.coalesce("component", "t1").alias("label"))
    rest = confirmed(_near_pairs(labelled, radius, similarity, chunk, hubs=False))
    return connected_components(links.union(rest), "p", "q")


def keep_one_per_group(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """One row of `docs` for each SimHash group: that of smallest doc_id, rows without an id last.

    Rows of a group that share the id are told apart by a hash of the whole row. Every group keeps
    exactly one row, whatever ids its rows have or share with other groups. With `similarity`, a link
    also needs that exact Jaccard similarity of the texts' shingles of `words` words; give a wide radius.
    Null texts count as empty, texts of any length are read whole, other columns may have any name and
    type, and an empty table gives no rows.
    """
    keyed, k1, k2 = _keyed(docs)
    if similarity is None:
        rows = durable(fingerprints(keyed, keep=(k1, k2), words=words))
        roots = connected_components(fingerprint_links(rows.select("fp").distinct(), radius))
        own = F.col("fp")
    else:
        text = F.coalesce("text", F.lit(""))
        rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), k1, k2, F.xxhash64(text).alias("t1"))
        texts = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))
        roots = near_copies(written(texts.dropDuplicates(["t1", "t2"])), words, radius, similarity)
        own = F.col("t1")
    named = rows.join(roots, own == F.col("node"), "left")
    return _first_of(keyed, k1, k2, named.select("doc_id", k1, k2, F.coalesce("component", own).alias("group")))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE: dict[str, str] = {}
