"""Exact repeated substrings: every byte covered by a `width`-byte string that also starts elsewhere.

1. Equal texts are counted by digest; a text that occurs twice is covered whole, and one copy of
   each different text goes on, into a table bucketed by its digest, so that later joins with the
   texts do not shuffle them again.
2. Each `width`-byte window is named by an anchor, its gram of least hash (the last one, on a tie).
   Equal windows have equal anchors, so only windows whose anchor occurs twice can repeat; the
   windows of one anchor place are the starts of one segment of text.
3. Segments meet by anchor. Their window starts are sorted as suffixes: by leading words while many
   agree, then by a mergesort that compares two suffixes by prefix polynomial hashes and a binary
   search for their common extension. Neighbours that agree over `width` bytes are verified byte by
   byte. An anchor with very many segments is split by window hash over several groups.
4. Covered ranges go back to the texts, where the remaining bytes are digested.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table

WIDTH = 400
GRAM = 32
PIECE = 1 << 22  # window starts whose anchors are found at a time
GROUP = 8192  # segments of one anchor in a group, about
BATCH_BYTES = 8 << 20
#: Ranges r, in order, with those that overlap or touch made one.
_MERGED = """aggregate(r, slice(r, 1, 0), (done, x) -> if(size(done) > 0 AND x.a <= element_at(done, -1).b,
  concat(slice(done, 1, size(done) - 1), array(named_struct('a', element_at(done, -1).a, 'b', greatest(element_at(done, -1).b, x.b)))),
  concat(done, array(x))))"""
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2**64


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes (a power of two) from each position."""
    h, power, size = _letters()[data], int(_BASE), 1
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor place: (hash of the anchor, first start of the run)."""
    hashes, starts = [], []
    windows = len(data) - width + 1
    span = width - gram + 1
    for at in range(0, max(0, windows), PIECE):
        g = gram_hashes(data[at : min(len(data), at + PIECE + width - 1)], gram)
        n = len(g) - span + 1
        place = np.arange(len(g), dtype=np.uint64)
        low = (g & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - place)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[span - size : span - size + n])
        at_gram = (np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at_gram[1:] != at_gram[:-1]]))
        hashes.append(g[at_gram[first]])
        starts.append(first + at)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes).view(np.int64), np.concatenate(starts)


class Suffixes:
    """Window starts over joined segments, compared by prefix polynomial hashes modulo 2**64."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        n = len(data) + 1
        power = np.full(n, _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum(_letters()[data] * power[:-1], out=self.prefix[1:])
        # The eight bytes from each place as one number, first byte highest.
        word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for size in (1, 2, 4):
            word = (word[:-size] << np.uint64(8 * size)) | word[size:]
        self.word = word

    def hashes(self, x: np.ndarray, length) -> np.ndarray:
        return (self.prefix[x + length] - self.prefix[x]) * self.inverse[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most width, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.width)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes(x, mid) == self.hashes(y, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        inside = np.minimum(n, self.width - 1)
        out = self.data[x + inside] < self.data[y + inside]
        return out | (n == self.width) if or_equal else out & (n < self.width)

    def mergesort(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """x with every class (first, size: its place, for each element) in suffix order.

        Runs of doubling length are merged for all classes at once: an element's new place is its
        place in its own run and the number of elements before it in the other run.
        """
        place = np.arange(len(x)) - first
        width, most = 1, int(size.max()) if len(size) else 0
        while width < most:
            pair = place // (2 * width) * (2 * width)
            right = place - pair >= width
            other = first + pair + np.where(right, 0, width)
            low = np.zeros(len(x), np.int64)
            high = np.clip(first + size - other, 0, width)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                y = x[other[open_] + mid]
                side = right[open_]
                before = np.empty(len(open_), bool)
                before[side] = self.less(y[side], x[open_][side], or_equal=True)
                before[~side] = self.less(y[~side], x[open_][~side], or_equal=False)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            to = first + pair + (place - pair - np.where(right, width, 0)) + low
            out = np.empty_like(x)
            out[to] = x
            x, width = out, width * 2
        return x

    def repeated(self, x: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Those of the starts x whose window occurs at another start (of the same group: equal windows always share it)."""
        for at in range(0, min(128, self.width - 7), 8):  # leading words, as long as they thin out large classes
            key = self.word[x + at] ^ (group.astype(np.uint64) * _MIX)
            order = np.argsort(key)
            x, key = x[order], key[order]
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]) - 1
            size = np.bincount(group, minlength=1)
            keep = size[group] > 1
            x, group = x[keep], group[keep]  # a class of its own is no repeat
            if not len(x) or size.max() <= 64:
                break
        if not len(x):
            return x
        new = np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        many = np.repeat(size > 2, size)  # two neighbours need no order
        own = size[size > 2]
        x[many] = self.mergesort(x[many], np.repeat(np.cumsum(own) - own, own), np.repeat(own, own))
        near = (group[1:] == group[:-1]) & (self.hashes(x[1:], self.width) == self.hashes(x[:-1], self.width))
        near &= self.verified(x[1:], x[:-1], near)
        hit = np.zeros(len(x), bool)
        hit[1:] |= near
        hit[:-1] |= near
        return x[hit]

    def verified(self, x: np.ndarray, y: np.ndarray, claimed: np.ndarray) -> np.ndarray:
        """Which claimed pairs have equal windows: the bytes decide, not the hashes.

        Pairs at one distance whose windows overlap are compared as one stretch; only where a
        stretch differs are its windows compared one by one.
        """
        at = np.flatnonzero(claimed)
        low, apart = np.minimum(x[at], y[at]), np.abs(x[at] - y[at])
        order = np.lexsort((low, apart))
        at, low, apart = at[order], low[order], apart[order]
        new = np.concatenate([[True], (apart[1:] != apart[:-1]) | (low[1:] - low[:-1] > self.width)])[: len(at)]
        ok, first, data = claimed.copy(), np.flatnonzero(new), self.data
        last = np.append(first[1:], len(at)) - 1
        for i, j, a, b, d in zip(first.tolist(), last.tolist(), low[first].tolist(), low[last].tolist(), apart[first].tolist(), strict=True):
            end = b + self.width
            if not np.array_equal(data[a:end], data[a + d : end + d]):
                for n in range(i, j + 1):
                    p = low[n]
                    ok[at[n]] = np.array_equal(data[p : p + self.width], data[p + d : p + d + self.width])
        return ok


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the ranges [a, b); touching ranges join."""
    order = np.argsort(a, kind="stable")
    a, end = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > end[:-1]])
    return a[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal rows (k1, k2, text) of a partition; no text is kept in memory."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = []
        for k in keys:
            fresh.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _with_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _texts(batches):
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            made = [anchors(np.frombuffer(t, np.uint8), width) for t in part.column(2).to_pylist()]
            lists = [pa.array([m[j] for m in made], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=["k1", "k2", "text", "h", "s"])


def _segments(batches: Iterator[pa.RecordBatch], width: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """Rows (h, sub, subs, g1, g2, k1, k2, s, seg): segments of repeated anchors, named by a 128-bit digest.

    With bytes, a segment that the task has met before gives at most one more row, so that what is
    sent of a segment in very many texts grows with the tasks and not with the texts.
    """
    met: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for row in batch.to_pylist():
            text = row["text"]
            for h, s, e, subs in row["runs"]:
                seg = text[s : e + width]
                d = xxhash.xxh3_128_digest(seg)
                g1, g2 = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                if with_bytes:
                    times = met.get((h, g1, g2), 0)
                    if times == 2:
                        continue
                    met[h, g1, g2] = times + 1
                for sub in range(subs if with_bytes else 1):
                    for c, v in zip(out, (h, sub, subs, g1, g2, row["k1"], row["k2"], s, seg if with_bytes else None), strict=True):
                        c.append(v)
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "sub", "subs", "g1", "g2", "k1", "k2", "s", "seg"]
        )


def _covered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Covered ranges (h, g1, g2, a, b) of segments, from rows in order of (h, sub)."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        h, sub, subs, g1, g2 = (t.column(c).to_numpy() for c in ("h", "sub", "subs", "g1", "g2"))
        order = np.lexsort((g2, g1, sub, h))
        h, sub, subs, g1, g2 = (v[order] for v in (h, sub, subs, g1, g2))
        new_group = np.concatenate([[True], (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])])
        new = new_group | np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(h)))
        group = (np.cumsum(new_group) - 1)[first]
        segs = [t.column("seg")[int(i)].as_py() for i in order[first]]
        size = np.array([len(s) for s in segs])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(segs), np.uint8)
        n = size - width + 1  # window starts of each segment
        alone = np.bincount(group, minlength=group.max() + 1)[group] == 1
        sort = ~alone  # a group's only segment can repeat as a whole alone
        x = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(np.arange(len(n)), n)
        use = sort[owner]
        x, owner = x[use], owner[use]
        hits = np.empty(0, np.int64)
        if len(x):
            s = Suffixes(data, width)
            if (subs[first] > 1).any():
                mine = s.hashes(x, width) % subs[first][owner].astype(np.uint64) == sub[first][owner].astype(np.uint64)
                x, owner = x[mine], owner[mine]
            hits = s.repeated(x, group[owner])
        twice = np.flatnonzero(times > 1)
        a = np.concatenate([hits, start[twice]])
        b = np.concatenate([hits + width, start[twice] + size[twice]])
        if len(a):
            # ranges of different segments must not join where they touch: leave a gap between segments
            which = np.searchsorted(start, a, side="right") - 1
            a, b = _merge(a + which, b + which)
            which = np.searchsorted(start + np.arange(len(start)), a, side="right") - 1
            a, b = a - which - start[which], b - which - start[which]
        else:
            which = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (h[first][which], g1[first][which], g2[first][which], a.astype(np.int64), b.astype(np.int64))],
            names=["h", "g1", "g2", "a", "b"],
        )

    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= BATCH_BYTES:
            t = pa.Table.from_batches(held)
            h, sub = t.column("h").to_numpy(), t.column("sub").to_numpy()
            last = np.flatnonzero((h != h[-1]) | (sub != sub[-1]))
            if len(last):  # the last group may go on
                cut = int(last[-1]) + 1
                yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield solve(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row in batch.to_pylist():
            a, b = _merge(np.array([r["a"] for r in row["ranges"]]), np.array([r["b"] for r in row["ranges"]]))
            text, digest, at = row["text"], hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                digest.update(text[at:x])
                at = y
            digest.update(text[at:])
            spans = [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            for c, v in zip(out, (row["k1"], row["k2"], int((b - a).sum()), len(a), digest.hexdigest(), spans), strict=True):
                c.append(v)
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "spans"]
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of `docs`.

    spans: the maximal runs [a, b) of bytes of the UTF-8 text that lie in a `width`-byte string which
    also starts anywhere else; kept_sha256: digest of all other bytes in order. Null counts as empty
    text. Texts below `width` bytes have no spans. Repeated rows are documents of their own, so their
    texts are covered whole (if long enough); other columns are ignored; an empty table gives no rows.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw)
    rows = rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"millrace_texts_{uuid.uuid4().hex}"
    long_texts = rows.where(F.col("n_bytes") >= width).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    stored = "k1 long, k2 long, text binary"
    distinct = long_texts.mapInArrow(_texts, stored).repartition(parts, "k1", "k2")
    distinct = distinct.mapInArrow(partial(_with_anchors, width=width), stored + ", h array<long>, s array<long>")
    distinct.write.bucketBy(parts, "k1", "k2").format("parquet").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    try:
        runs = texts.select("k1", "k2", F.octet_length("text").alias("n"), "h", "s")
        ends = F.transform("s", lambda x, i: F.coalesce(F.try_element_at("s", i + 2), F.col("n") - width + 1) - 1)
        runs = runs.select("k1", "k2", F.inline(F.arrays_zip("h", "s", ends.alias("e"))))
        hot = texts.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        hot = hot.select("h", F.ceil(F.col("times") / GROUP).cast("int").alias("subs"))
        by_text = runs.join(hot, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "s", "e", "subs")).alias("runs"))
        by_text = durable(by_text)
        found = by_text.join(texts.select("k1", "k2", "text"), ["k1", "k2"])
        shape = "h long, sub int, subs int, g1 long, g2 long, k1 long, k2 long, s long, seg binary"
        plain = found.select("k1", "k2", "text", F.transform("runs", lambda r: F.array(r["h"], r["s"], r["e"], r["subs"].cast("long"))).alias("runs"))
        segments = plain.mapInArrow(partial(_segments, width=width, with_bytes=True), shape).select("h", "sub", "subs", "g1", "g2", "seg")
        places = plain.mapInArrow(partial(_segments, width=width, with_bytes=False), shape).select("h", "g1", "g2", "k1", "k2", "s")
        ordered = segments.repartition(parts, "h", "sub").sortWithinPartitions("h", "sub")
        covered = ordered.mapInArrow(partial(_covered, width=width), "h long, g1 long, g2 long, a long, b long")
        # One row a segment, its ranges merged, so that the join below keeps one row a place.
        covered = durable(covered.groupBy("h", "g1", "g2").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("r")).withColumn("r", F.expr(_MERGED)))
        shifted = F.transform("r", lambda r: F.struct((F.col("s") + r["a"]).alias("a"), (F.col("s") + r["b"]).alias("b")))
        ranges = places.join(covered, ["h", "g1", "g2"]).select("k1", "k2", shifted.alias("r"))
        ranges = ranges.groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("ranges"))
        left = ranges.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).mapInArrow(
            _kept, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
        )
        left = durable(left)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    slim = rows.select("doc_id", "k1", "k2", "n_bytes", F.sha2("text", 256).alias("whole"))
    copies = slim.where(F.col("n_bytes") >= width).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    marks = copies.join(left, ["k1", "k2"], "full_outer")
    joined = slim.join(marks, ["k1", "k2"], "left")
    twice = F.col("copies").isNotNull()
    return joined.select(
        "doc_id", "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twice, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(twice, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))))
        .otherwise(F.coalesce("spans", F.array().cast("array<struct<a:long,b:long>>"))).alias("spans"),
    )


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE: dict[str, str] = {}
