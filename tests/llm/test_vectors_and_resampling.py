"""Importance resampling, embedding near-duplicates and vector codes against brute force, and on awkward input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import binarycodes, quantise, resampling

# 11 Importance resampling


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_resample(docs, targets, n=1, buckets=10_000, percent=10, min_words=20):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in targets for f in features(x))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(plain_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-r[4], r[0] is None, r[0] or 0, r[2], k) for k, r in enumerate(rows) if r[1] >= min_words)
    rank = {x[-1]: i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r, rank.get(k)) for k, r in enumerate(rows))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)] + ["ÄRGER", "naïve", "x-y", "Don't", "日本", "MiXed"])
    docs = [(i, " ".join(rng.choice(words, rng.integers(15, 60)))) for i in range(400)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (900, None), (901, ""), (902, " \n--"), (903, "A.b.C " * 5000), (904, docs[7][1] + "\x00end")]
    return docs, [" ".join(words[rng.integers(0, 40, 30)]) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (3, 97, 50), (2, 1000, 100)])
def test_resampling(spark, texts, n, buckets, percent):
    docs, targets = texts
    frame = spark.createDataFrame([(i, x, 0, "s", 7) for i, x in docs], "doc_id long, text string, _row int, score string, place int").repartition(5)
    aim = spark.createDataFrame([(x,) for x in targets], "text string")
    got = resampling.resample(frame, aim, n=n, buckets=buckets, percent=percent).collect()
    assert Counter(map(tuple, got)) == plain_resample(docs, targets, n, buckets, percent)


def test_resampling_pieces(monkeypatch, texts):
    """Texts are cut in pieces between documents only, and n-grams never cross documents."""
    import pyarrow as pa

    column = pa.array([x for _, x in texts[0]])
    counts = [sum(np.bincount(found, minlength=101) for piece in resampling._pieces(column) for found, _ in resampling._grams(piece, 2, 101))]
    monkeypatch.setattr(resampling, "PIECE_BYTES", 700)
    assert len(list(resampling._pieces(column))) > 20
    counts.append(sum(np.bincount(found, minlength=101) for piece in resampling._pieces(column) for found, _ in resampling._grams(piece, 2, 101)))
    assert (counts[0] == counts[1]).all()


def test_resampling_draws_towards_the_target(spark, texts):
    rows = [(i, " ".join(["plain other words here"] * 6) if i % 2 else " ".join(["wanted target text now"] * 6)) for i in range(200)]
    frame, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("wanted target text now",)] * 300, "text string")
    drawn = [r.doc_id for r in resampling.resample(frame, aim, percent=20, buckets=1000).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(i % 2 for i in drawn) < 4


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    assert [r["rank"] for r in resampling.resample(some, none).collect()] == [None, None]


# 12 Embedding near-duplicates


def plain_links(rows, threshold=0.9):
    good = [x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x in rows]
    links, scaled = [set() for _ in rows], [np.array(x) / max(map(abs, x)) if ok else None for (_, x), ok in zip(rows, good, strict=True)]
    for i, x in enumerate(scaled):
        for j, y in enumerate(scaled):
            if i != j and good[i] and good[j] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(links[i]), least, key == least))
    return Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 64))
    rows = [base[i % 12] + rng.standard_normal(64) * rng.choice([0.1, 0.33, 0.36, 0.5]) for i in range(160)] + list(rng.standard_normal((60, 64)))
    rows += [rows[3]] * 5 + [rows[4] * 1e-200, rows[4] * 1e200, -rows[4], np.zeros(64)]
    rows = [(i, list(map(float, x))) for i, x in enumerate(rows)]
    rows += [(500, None), (501, []), (502, [1.0, None] + [0.5] * 62), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (505, [1.0, 0.0]), (506, [0.95, 0.05])]
    rows += [(None, rows[8][1]), (None, [0.0, -1.0]), (7, rows[9][1]), (7, rows[9][1]), (507, [3.0]), (508, [2.0]), (509, [-2.0])]
    return rows


@pytest.mark.parametrize("tile_rows,pivots", [(2048, 1024), (16, 8), (7, 1)])
def test_near_vectors(spark, vectors, tile_rows, pivots):
    frame = spark.createDataFrame([(i, x, "h", 1, 2) for i, x in vectors], "vec_id long, embedding array<double>, h1 string, n int, node int").repartition(3)
    got = binarycodes.near_vectors(frame, tile_rows=tile_rows, pivots=pivots).collect()
    assert Counter(map(tuple, got)) == plain_links(vectors)


def test_near_vectors_high_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((10, 384))
    rows = [(i, list(map(float, base[i % 10] + rng.standard_normal(384) * rng.choice([0.2, 0.3, 0.34, 0.4])))) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, binarycodes.near_vectors(frame).collect())) == plain_links(rows)


def test_near_vectors_empty(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert binarycodes.near_vectors(frame.limit(0)).count() == 0
    assert [tuple(r) for r in binarycodes.near_vectors(frame.where("vec_id = 500")).collect()] == [(500, 0, 500, True)]


@pytest.mark.parametrize("dim", [1, 3, 48, 64, 300])
def test_binary_codes(dim):
    """The rotation keeps inner products, estimates are unbiased over rotations, and the certain limit holds."""
    rng = np.random.default_rng(dim)
    x = binarycodes.unit(rng.standard_normal((40, dim)))
    y = binarycodes.unit(x + rng.standard_normal((40, dim)) * 0.5 / math.sqrt(dim))
    true = y @ x.T
    assert np.allclose(binarycodes.rotate(y) @ binarycodes.rotate(x).T, true)
    found = []
    for seed in range(200):
        codes, f = binarycodes.encode(x, seed)
        found.append(binarycodes.estimates(codes, f, binarycodes.rotate(y, seed)))
        limit = np.sqrt(np.maximum(1 / f**2 - 1, 0))[None, :] * np.sqrt(1 - np.clip(true, -1, 1) ** 2)
        assert (np.abs(found[-1] - true) <= limit + 1e-4).all()
        assert (found[-1] >= binarycodes.lower_limits(f, binarycodes.rotate(x[:1]).shape[1], 0.9, 1e9))[true >= 0.9].all()
    if dim > 3:  # mean errors of single pairs in standard errors
        found = np.array(found)
        z = (found.mean(0) - true) / (found.std(0) / math.sqrt(len(found)) + 1e-6)
        assert abs(z.mean()) < 0.5 and z.std() < 2


def test_tiles_are_skipped():
    """Cells far apart never meet."""
    rng = np.random.default_rng(6)
    a, b = (binarycodes.unit(c + rng.standard_normal((50, 64)) * 0.01) for c in rng.standard_normal((2, 64)))
    radius = [np.arccos(np.clip(x @ x[0], -1, 1)).max() for x in (a, b)]
    assert np.arccos(a[0] @ b[0]) > sum(radius) + np.arccos(0.9)


# 13 Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * v) for v in x]) for i, label, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    m = -(-len(kept[0][2]) // parts)
    cut = [[(x + [0] * (m * parts - len(x)))[p * m : p * m + m] for p in range(parts)] for _, _, x in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [[min((distance(v, c), e) for e, c in enumerate(books[p])) for p, v in enumerate(x)] for x in cut]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [x[p] for x, n in zip(cut, near, strict=True) if n[p][1] == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    of = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        of[label] += e
    return Counter((i, label, "".join(f"{e:02x}" for _, e in n), d, of[label], digest) for (i, label, _), n, d in zip(kept, near, errors, strict=True))


@pytest.mark.parametrize("dim,size,scale", [(64, 150, 0.125), (64, 150, 1e5), (20, 30, 1.0), (16, 200, 2e5)])
def test_vector_codes(spark, dim, size, scale):
    rng = np.random.default_rng(dim + size)
    rows = [(i, None if i % 9 == 0 else i % 4, list(map(float, x))) for i, x in enumerate(rng.standard_normal((size, dim)) * scale)]
    rows += [(3, 1, rows[5][2]), (3, 1, rows[5][2]), (None, 2, rows[6][2]), (900, 1, None), (901, 1, [float("nan")] * dim), (902, None, [None] * dim), (903, 1, [float("-inf")] * dim)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, vector int").repartition(3)
    assert Counter(map(tuple, quantise.compress(frame).collect())) == plain_codes([r for r in rows])


def test_vector_codes_awkward(spark):
    some = [(1, 0, [0.5] * 16), (2, None, [1e300] * 16), (3, None, [1.0, 2.0]), (4, 0, [0.25] * 16)]
    frame = spark.createDataFrame(some, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in quantise.compress(frame).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: (None, None, None), 3: (None, None, None), 4: ("01" * 16, 0, 0)}
    assert quantise.compress(frame.limit(0)).count() == 0
    assert [(r.code, r.error) for r in quantise.compress(spark.createDataFrame([(1, 0, [])], frame.schema)).collect()] == [("00" * 16, 0)]


def test_exact_dots():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 20, 1 << 27):
        x, y = rng.integers(-most, most + 1, (30, 64)), rng.integers(-most, most + 1, (20, 64))
        x[0], y[0] = -most, most
        want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in y] for p in x]
        assert quantise.exact_dots(x, y).tolist() == want
    for length in (1, 4, 64, 1536):
        assert length * (1 << quantise.limb_bits(length)) ** 2 < 1 << 53
    big = rng.integers(-(1 << 40), 1 << 40, 50)
    assert (sum(v.astype(object) * (1 << (7 * i)) for i, v in enumerate(quantise.limbs(big, 7))) == big).all()


@pytest.mark.parametrize("module", [resampling, binarycodes, quantise])
def test_sql(module, same_as_oracle):
    for name in module.ORACLE:
        same_as_oracle(name, module.QUERIES, module.ORACLE)
