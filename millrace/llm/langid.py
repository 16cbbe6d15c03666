"""Language ID by error-correcting output codes.

Each language has a codeword; one regularised least-squares classifier per bit predicts it from
hashed byte n-grams of the lower-cased text. Decoding adds up each bit's hinge loss against every
codeword, weighted by how well the bit was predicted on left-out training rows, and takes the
codeword of least loss; two codewords of nearly equal loss flag an ambiguous text. The classifiers
are fitted in one task from a bounded sample of labelled rows (`sample_rows`), so that the driver
gets the finished model alone; prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

ORDERS = (2, 3)
BITS = 12  # hashed features an order: 2 ** BITS
SAMPLE_ROWS = 2000  # bound of the rows that the fit reads
RIDGE = 0.02
AMBIGUOUS = 0.05  # least difference of the two smallest losses, as a share of the largest loss
FOLDS = 5
SEED = 11
UND = "und"

_LETTER = re.compile("[A-Za-z]")
#: ASCII letters and all bytes of longer characters stay; every other byte becomes a space.
_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F}


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the relative n-gram frequencies, hashed; one block of 2**BITS for an order."""
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split())
    b = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    out = np.zeros((len(ORDERS), 1 << BITS), dtype=np.float32)
    for row, order in zip(out, ORDERS, strict=True):
        n = len(b) - order + 1
        if n > 0:
            gram = b[:n].copy()
            for i in range(1, order):
                gram |= b[i : i + n] << np.uint32(8 * i)
            at = (gram * np.uint32(_FACTORS[order])) >> np.uint32(32 - BITS)
            row[:] = np.sqrt(np.bincount(at, minlength=1 << BITS) / n)
    return out.ravel()


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to five languages: all splits of them; more: the best of seeded draws."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, -1.0, 1.0)
    rng = np.random.default_rng(SEED)
    width = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # bits
    ambiguous: float = AMBIGUOUS

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = x @ self.weights + self.bias
        loss = np.maximum(0, 1 - self.code * margin) @ self.trust
        order = np.argsort(loss, kind="stable")
        first, second = loss[order[0]], loss[order[1]]
        score = float(second / (first + second)) if second > 0 else 0.5
        return self.languages[order[0]], score, bool(second - first < self.ambiguous * 2 * self.trust.sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [zlib.compress(features(t).astype(np.float16).tobytes(), 1) for t in batch.column(1).to_pylist()]  # mostly zeros
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["lang", "x"])


def _fit(batches: Iterator[pa.RecordBatch], languages: list[str], code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (weights, bias, trust), as bytes, of the classifiers learnt from all rows (lang, x)."""
    sample = sorted(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    place = {k: i for i, k in enumerate(languages)}
    y = code[[place[lang] for lang, _ in sample]]
    x = np.empty((len(sample), len(ORDERS) << BITS), dtype=np.float32)
    for row, (_, packed) in zip(x, sample, strict=True):
        row[:] = np.frombuffer(zlib.decompress(packed), dtype=np.float16)
    mean = x.mean(0)
    x -= mean
    inverse = np.linalg.inv(x @ x.T + RIDGE * max(1.0, len(x) / 100) * np.eye(len(x), dtype=np.float32))
    bias = y.mean(0)
    dual = inverse @ (y - bias)
    left_out = dual / np.diag(inverse)[:, None]  # residual of each row when it is left out
    trust = 1 / (0.05 + (left_out**2).mean(0))
    weights = (x.T @ dual).astype(np.float32)
    made = (weights, bias - mean @ weights, trust / trust.max() if trust.size else trust)
    yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float64).tobytes()], pa.binary()) for v in made], names=["weights", "bias", "trust"])


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """The model learnt from rows with a text and a language; None if there is no such row.

    The fit reads an equal number of different texts for each language, about `sample_rows` in all and
    one at least, those of smallest hash; copies of a text count once. Only the model and one
    count for each language reach the driver.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    known = known.withColumns({"h": F.xxhash64("text", F.lit(SEED)), "h2": F.xxhash64("text")})
    texts = known.select("lang", "h", "h2").distinct()
    found = {r["lang"]: r for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()}
    if not found:
        return None
    languages = sorted(found)
    quota = max(1, sample_rows // len(languages))
    # Hashes are spread evenly, so those below this bound are about twice the quota: only they are ranked.
    bound = {k: max(r["least"], int(min(1.0, (2 * quota + 20) / r["n"]) * (2**64 - 1)) - 2**63) for k, r in found.items()}
    bounds = docs.sparkSession.createDataFrame([(k, min(v, 2**63 - 1)) for k, v in bound.items()], "lang string, bound long")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "h2"))
    low = texts.join(F.broadcast(bounds), "lang").where("h <= bound").drop("bound")  # one row a language
    chosen = low.withColumn("nth", nth).where(F.col("nth") <= quota).select("lang", "h", "h2")
    sample = known.join(F.broadcast(chosen), ["lang", "h", "h2"], "left_semi").dropDuplicates(["lang", "h", "h2"])  # about sample_rows keys
    code = codewords(len(languages))
    # The sample's bound does not depend on the input, so one task can hold it.
    sample = sample.select("lang", "text").mapInArrow(_features, "lang string, x binary").repartition(1)
    made = sample.mapInArrow(partial(_fit, languages=languages, code=code), "weights binary, bias binary, trust binary").first()
    weights, bias, trust = (np.frombuffer(v, np.float64) for v in made)
    return LanguageModel(languages, code, weights.reshape(len(ORDERS) << BITS, code.shape[1]).astype(np.float32), bias, trust)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            if model is None or text is None or not has_letter(text):
                found.append((UND, 0.0, True))
            else:
                found.append(model.decode(features(text)))
        lang, score, ambiguous = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
            names=["doc_id", "lang_pred", "score", "ambiguous"],
        )


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row, from the whole text alone.

    `und` with score 0 where the text is null or has no letter, or nothing could be learnt. Repeated
    rows give repeated results; null ids stay null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def _keep(batches: Iterator[pa.RecordBatch], model: LanguageModel | None, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text in batch.column(at).to_pylist():
            if model is None or text is None or not has_letter(text):
                kept.append(False)
            else:
                kept.append(not model.decode(features(text))[2])
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep_known_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is recognised: neither `und` nor ambiguous."""
    return docs.mapInArrow(partial(_keep, model=model, at=docs.columns.index(text_col)), docs.schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold() != 0))
    held_out = docs.select("doc_id", "text")
    found = predict_language(held_out, model)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_langid": op10_langid}
ORACLE: dict[str, str] = {}
