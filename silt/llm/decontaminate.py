"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = floor(m * error_rate) edits. Cut into
k + 1 pieces, at least one piece of it stands unedited in any such match, so exact
piece hits (one Aho-Corasick pass over each whole text) find every candidate. Each
candidate region is verified by Myers' bit-parallel edit distance.

Texts and items are compared lower-cased, with every run of white space one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh
from .words import as_utf8

ERROR_RATE = 0.08
#: Characters of items searched for in one pass over the texts; more take more passes.
PASS_CHARS = 8_000_000


def fold(text: str) -> str:
    """Lower-cased without changing the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalise(text: str | None) -> str:
    return " ".join(fold(text or "").split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """Bounds of errors + 1 pieces of an item, in order."""
    return [(j * length // (errors + 1), (j + 1) * length // (errors + 1)) for j in range(errors + 1)]


def ends(item: str, text: str, errors: int) -> Iterator[tuple[int, int]]:
    """(distance, end) wherever a substring of ``text`` ends within ``errors`` edits of ``item``.

    Myers' algorithm on one integer of as many bits as the item has characters.
    """
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    masks = dict(masks)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(zero | up) & full
        minus = up & zero
        if score <= errors:
            yield score, at + 1


def best(item: str, text: str, errors: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the least distant substring, the leftmost end, then the longest."""
    found = min(ends(item, text, errors), default=None)
    if found is None:
        return None
    distance, end = found
    back = max(e for d, e in ends(item[::-1], text[:end][::-1], distance) if d == distance) if distance < len(item) else 0
    return distance, end - back, end


class Matcher:
    """Finds the items of one pass in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for a, b in pieces(len(t), k):
                at[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def regions(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the merged stretches of ``text`` that a match could lie in, leftmost first."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(text):
            for n, a in where:
                _, item, k = self.items[n]
                low = last + 1 - size - a - k
                found[n].append([max(0, low), min(len(text), low + len(item) + 2 * k)])
        for n, spans in found.items():
            spans.sort()
            merged = [spans[0]]
            for s in spans[1:]:
                if s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(s)
            found[n] = merged
        return found

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of each item's best match in a normalised text."""
        out = []
        for n, spans in self.regions(text).items():
            key, item, k = self.items[n]
            hits = [(h[0], a + h[1], a + h[2]) for a, b in spans if (h := best(item, text[a:b], k))]
            if hits:
                out.append((key, *min(hits, key=lambda h: (h[0], h[2]))))
        return out


def _places(text: str) -> list[int]:
    """For each character of the normalised text, its place in ``text``; the end last."""
    out, at, low = [], 0, fold(text)
    for word in low.split():
        at = low.index(word, at)
        if out:
            out.append(out[-1] + 1)
        out.extend(range(at, at + len(word)))
        at += len(word)
    return [*out, out[-1] + 1 if out else 0]


def _search(items: tuple, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(list(items), error_rate)
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(as_utf8(batch.column(1)).to_pylist()):
                flat = normalise(text)
                if found := matcher.search(flat):
                    place = _places(text)
                    for key, distance, a, b in found:
                        rows.append(k)
                        out.append((key, distance, place[a], place[b - 1] + 1 if b > a else place[a]))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            ids = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n", "distance", "start", "end"])

    return run


def _passes(items: DataFrame, item_id_col: str, item_text_col: str, pass_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in passes of bounded size: (item id, normalised text), none empty."""
    fresh(items, item_id_col, item_text_col)
    wanted = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = wanted.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    passes = -(-chars // pass_chars) if chars else 0
    for p in range(passes):
        some = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).collect()
        if flat := [(r["item"], t) for r in some if (t := normalise(r["text"]))]:
            yield flat


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """(id, item_id, distance, start, end) for each item that a row's text holds.

    An item of m normalised characters is held where some substring is within
    floor(m * error_rate) edits; distance is the least, start and end are code points
    of the leftmost such place in the text. Items that are null or white space match
    nothing; equal items each match. Null and empty texts hold nothing; rows with a null
    or repeated id are searched like any other; empty tables give no rows; other columns
    are ignored. The items are read in passes of bounded size, never all at once.
    """
    fresh(docs, id_col, text_col)
    spark = docs.sparkSession
    bounded_batches(spark)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], f"{id_col} {id_kind}, item_id {item_kind}, distance long, start long, end long")
    for flat in _passes(items, item_id_col, item_text_col, pass_chars):
        texts = tuple((n, t) for n, (_, t) in enumerate(flat))
        names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(flat)], f"n long, item_id {item_kind}"))
        found = rows.mapInArrow(_search(texts, error_rate), f"id {id_kind}, n long, distance long, start long, end long")
        out = out.unionByName(found.join(names, "n").select(F.col("id").alias(id_col), "item_id", "distance", "start", "end"))
    return out


def clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """``docs`` without the rows whose text holds an item; no row is joined or moved."""
    fresh(docs, text_col)
    bounded_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema

    def holds_none(texts: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(list(texts), error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(normalise(t)) for t in as_utf8(batch.column(at)).to_pylist()], pa.bool_()))

        return run

    for flat in _passes(items, item_id_col, item_text_col, pass_chars):
        docs = docs.mapInArrow(holds_none(tuple(enumerate(t for _, t in flat))), schema)
    return docs
