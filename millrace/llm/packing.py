"""Cost-balanced packing of tokenised documents into sequences of a fixed token capacity.

Each document is encoded whole and closed with an end id. Whole blocks of `capacity` ids become
sequences of their own; the remainders are collected into windows of `window` ids, and in a window
they are dealt, longest first, each to the sequence of least estimated cost (linear plus quadratic
attention cost of its pieces) that still has room for it. What finds no room is cut to fill the
gaps, so the closed sequences of a window are full; what is left starts the next window. The last
ids of a partition go to sequences whose lengths are powers of two, which need no padding.

All of this is local to an input partition: no shuffle, no group, memory bounded by a window plus
the longest document, and a lost task is simply run again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache, partial
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CAPACITY = 2048
END_ID = 1
WINDOW = 1 << 21  # ids in a packing window
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # cost of n ids in one piece: LINEAR * n + QUADRATIC * n * n
CACHED_WORDS = 600_000

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


#: A break before punctuation that follows a letter: there the vocabulary's own pattern always cuts.
_BREAK = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])(?=[!-/:-@])")
_LATIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, remembered by chunk.

    The vocabulary never joins anything over white space, so a text's ids are those of its chunks
    in turn. Chunks are cut at space, tab, line feed and carriage return, which every Unicode class
    of white space includes, and before punctuation that follows a Latin letter; other white space
    stays inside a chunk for the tokenizer. Texts are lower-cased first where that provably gives
    what the tokenizer's normalizer gives. A text that holds the name of an added token, which the
    tokenizer looks for before all else, goes to it as it is. Chunks of Latin letters alone are one word each and go to
    the tokenizer's model directly; all others are encoded many at a time, a NUL between them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.stop,) = self.tokenizer.encode("\0", add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        low = text.lower()
        if text.isascii() or ("\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
            text = _BREAK.sub(" ", low)
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, new: list[str]) -> None:
        mixed = []
        for w in new:
            if _LATIN.fullmatch(w):
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                self.known[w] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            elif "\0" in w:
                self.known[w] = self.whole(w)
            else:
                mixed.append(w)
        for i in range(0, len(mixed), 2048):
            part = mixed[i : i + 2048]
            ids = np.array(self.tokenizer.encode(" \0 ".join(part) + " \0", add_special_tokens=False).ids, dtype="<u4")
            start, raw = 0, ids.tobytes()
            for w, end in zip(part, np.flatnonzero(ids == self.stop).tolist(), strict=True):
                self.known[w] = raw[4 * start : 4 * end]
                start = end + 1

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {i: self.whole(t) for i, t in enumerate(texts) if any(a in t.lower() for a in self.added)}
        rows = [[] if i in whole else self.chunks(t) for i, t in enumerate(texts)]
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        self.learn(list(set().union(*rows).difference(self.known)))
        get = self.known.__getitem__
        return [whole.get(i) or b"".join(map(get, r)) for i, r in enumerate(rows)]


@cache
def encoder(path: str) -> WordEncoder:
    """One for each vocabulary and worker process, which may run many tasks."""
    return WordEncoder(path)


def deal(lengths: np.ndarray, capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of (piece, from, to) filled to `capacity`, and the parts that are left over.

    Longest first, each piece goes to the sequence of least cost with room; pieces without room
    are cut over the gaps. The left-over parts hold fewer than `capacity` ids.
    """
    n = int(lengths.sum()) // capacity
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)
    late = []
    for p in np.argsort(-lengths, kind="stable"):
        size = int(lengths[p])
        at = int(np.argmin(np.where(room >= size, cost, np.inf))) if n else 0
        if not n or room[at] < size:
            late.append((int(p), 0, size))
            continue
        sequences[at].append((int(p), 0, size))
        room[at] -= size
        cost[at] += LINEAR * size + QUADRATIC * size * size
    late.reverse()  # taken from the end: longest first
    for at in np.argsort(cost, kind="stable"):
        while room[at]:
            p, a, b = late.pop()
            cut = min(b, a + int(room[at]))
            sequences[at].append((p, a, cut))
            room[at] -= cut - a
            if cut < b:
                late.append((p, cut, b))
    return sequences, late[::-1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    base = TaskContext.get().partitionId() << 32
    count = 0
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    out: list[list] = [[] for _ in schema]
    held = 0
    waiting: list[tuple] = []  # (doc_id, first id, ids, ids of the document)
    pending = 0

    def put(sequence: list[tuple]) -> None:
        nonlocal count, held
        at = 0
        for doc_id, start, ids, total in sequence:
            size = len(ids) // 4
            for column, v in zip(out, (doc_id, start, size, ids, total, base + count, at), strict=True):
                column.append(v)
            at += size
            held += len(ids)
        count += 1

    def part(piece: tuple, a: int, b: int) -> tuple:
        doc_id, start, ids, total = piece
        return doc_id, start + a, ids[4 * a : 4 * b], total

    def close() -> None:
        nonlocal waiting, pending
        full, left = deal(np.array([len(x[2]) // 4 for x in waiting], dtype=np.int64), capacity)
        for s in full:
            put([part(waiting[p], a, b) for p, a, b in s])
        waiting = [part(waiting[p], a, b) for p, a, b in left]
        pending = sum(len(x[2]) // 4 for x in waiting)

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal out, held
        if held >= least and out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            out, held = [[] for _ in schema], 0

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), 256):
            for doc_id, ids in zip(doc_ids[i : i + 256], encode([t or "" for t in texts[i : i + 256]]), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for a in range(0, whole, capacity):
                    put([part((doc_id, 0, ids, total), a, a + capacity)])
                if whole < total:
                    waiting.append(part((doc_id, 0, ids, total), whole, total))
                    pending += total - whole
                if pending >= window:
                    close()
                yield from ready(8 << 20)
    close()
    while waiting:  # a power of two at a time
        size = 1 << (sum(len(x[2]) // 4 for x in waiting).bit_length() - 1)
        sequence, rest = [], []
        for x in waiting:
            n = len(x[2]) // 4
            cut = min(n, size)
            if cut:
                sequence.append(part(x, 0, cut))
            if cut < n:
                rest.append(part(x, cut, n))
            size -= cut
        put(sequence)
        waiting = rest
    yield from ready(0)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of `docs`.

    `ids` holds the piece's token ids as little-endian unsigned 32-bit numbers. Every row is a
    document of its own, repeated ids included; a null or empty text is the end id alone; a null id
    stays null. Other columns are ignored. An empty table gives no pieces. Ties in length keep the
    order of the input, so a rerun over the same files gives the same sequences.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_pack, path=tokenizer_path, capacity=capacity, end_id=end_id, window=window), PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
