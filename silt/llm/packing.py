"""Packing tokenised documents into fixed windows by concatenate and cut.

Pass one tokenises each input partition in order and writes the ids with their offset
in the partition's own token stream. A prefix sum over the partitions' totals turns
these into offsets in one global stream. Pass two cuts the stream at every multiple of
the window: each document gives one boundary record for each window it touches. No
text or id is ever shuffled; only one total for each partition is.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialize
from .words import as_utf8, slices, split

LENGTH = 2048
END_ID = 1
#: Texts of each task whose ids from the fast encoder are held against the tokenizer's.
PROBES = 8
#: Bytes of white space alone, or without any, beyond which the tokenizer itself makes a text's ids.
STRETCH = 5_000
#: Partition totals (16 bytes each) up to which they are broadcast, 32 MB.
BROADCAST_ROWS = 2_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """A function from an Arrow string array to lists of ids, special tokens not added.

    The tokenizer file defines the ids. With the same vocabulary as ranks, a faster
    encoder makes those of ordinary texts, for which the two are proved equal: every token
    of the vocabulary is its own encoding, merges and ranks have one order, and all code
    points part words alike (tests hold all three). Other texts go to the tokenizer: those
    with one of its special strings, and those with a stretch of over ``STRETCH`` bytes
    of white space alone or without any, which can exhaust the faster one's stack. The
    first texts of every task are encoded by both, so that files which disagree fail.
    """
    slow = _tokenizer(tokenizer_path)
    plain = lambda texts: [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]
    if not ranks_path:
        return lambda column: plain(column.to_pylist())
    fast = _ranks(ranks_path, pattern)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    probes = PROBES

    def encode(column: pa.Array) -> list[list[int]]:
        nonlocal probes
        out = []
        for t, long in zip(column.to_pylist(), stretched(column).tolist(), strict=True):
            out.append(plain([t])[0] if long or any(x in t for x in special) else fast.encode_ordinary(t))
        if probes:
            some = column.slice(0, probes).to_pylist()
            if out[: len(some)] != plain(some):
                raise ValueError("the ranks give other ids than the tokenizer file")
            probes -= len(some)
        return out

    return encode


def stretched(texts: pa.Array, limit: int = STRETCH) -> np.ndarray:
    """Whether each text has over ``limit`` bytes in a row of ASCII white space, or of other bytes."""
    out = np.zeros(len(texts), bool)
    for a, b in slices(texts):
        w = split(texts, a, b)
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + a : texts.offset + b + 1])
        if size.max(initial=0) <= limit:
            continue
        edge = np.cumsum(size)
        words, spaces = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        np.maximum.at(words, w.doc, w.end - w.start)
        # white space before each word, from the word or the text's start before it, and after a text's last word
        before = np.concatenate(([0], w.end[:-1])) if len(w.end) else w.end
        np.maximum.at(spaces, w.doc, w.start - np.maximum(before, (edge - size)[w.doc]))
        last = np.where(np.diff(w.first) > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, edge - size)
        out[a:b] = (words > limit) | (np.maximum(spaces, edge - last) > limit)
    return out


def _tokens(make_encoder, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = make_encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = encode(as_utf8(batch.column(1)))
            n = np.array([len(x) + 1 for x in ids], np.int64)
            raw = [np.array([*x, end_id], "<u4").tobytes() for x in ids]
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            parts = pa.array(np.full(len(n), part, np.int32))
            yield pa.RecordBatch.from_arrays([parts, batch.column(0), pa.array(start), pa.array(n), pa.array(_thin(raw), pa.binary())], names=["part", "id", "at", "n", "ids"])

    return run


def _thin(raw: list[bytes]) -> list[bytes]:
    """Byte planes of little-endian 32-bit ids: all lowest bytes, then all second ones, and so on.

    The upper planes are nearly constant, so that stored ids take little more than two bytes each.
    """
    return [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, 4).T).tobytes() for x in raw]


def _thick(planes: bytes) -> bytes:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).tobytes()


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(seq * length, at[row]) - at[row]
            end = np.minimum((seq + 1) * length, at[row] + n[row]) - at[row]
            raw = [_thick(x) for x in batch.column(3).to_pylist()]
            crc = [zlib.crc32(raw[r][4 * b : 4 * e]) for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True)]
            ids = [raw[r][4 * b : 4 * e] for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(at[row] + begin - seq * length), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``length`` ids.

    Columns: id, start (the document's ids before the piece), length, ids_crc32 (of the
    piece's little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (of the
    piece in its sequence) and ids (the piece's ids as those bytes). Every document ends
    with ``end_id``; null and empty texts are that id alone. Sequences are full but for
    the last, the only one to pad. Rows with a null or repeated id are packed like any
    other; an empty table gives no rows; other columns are ignored.
    """
    fresh(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    make = lambda: encoder(tokenizer_path, ranks_path, pattern)
    stream = materialize(rows.mapInArrow(_tokens(make, end_id), f"part int, id {kind}, at long, n long, ids binary"), "pack-ids")
    totals = stream.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(totals.select("part", before.cast("long").alias("base")), "pack-bases")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    placed = stream.join(bases, "part").select("id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    out = placed.mapInArrow(_cut(length), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)
