"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Pairs of a preferred
(label 1) and another (label 0) labelled document are judged by the logistic of the
difference of their strengths; the weights minimise that logistic loss over all pairs of
all labelled rows. The loss needs strengths alone, so a pair costs nothing: rows meet the
other class as power sums in narrow bins of strength, whose series leaves out less than
1e-11 of a pair. The threshold is the quantile of all labelled rows' strengths that leaves
their share of label 0 below it, and scores are scaled so that it is ``CUT``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, materialize
from .labelled import fold
from .words import Words, as_utf8, hashes, lower_ascii, slices, split

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
#: Width of a bin of strengths, and the highest power of what strengths differ from their bins' middles.
BIN, ORDER = 1 / 16, 6
RIDGE = 1e-3
STEPS = 60
#: Partial results that are held before they are merged.
PARTS = 16

FEATURES = ["words", "word_length", "distinct", "repeats", "upper", "digits", "pipes", "marks", "shouts", "stops", "commas", "lines", "wide", "bare", "frequent", "junk_ends"]
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@^_`{}~\\/[]", np.uint8))


def features(texts: pa.Array, a: int, b: int) -> np.ndarray:
    """One row of FEATURES for each of texts a..b; zeros for texts without words."""
    w = split(texts, a, b)
    rows, n = b - a, np.diff(w.first).astype(float)
    one = np.maximum(n, 1)
    per_word = lambda x: np.bincount(w.doc, x, rows) / one
    size = w.end - w.start
    sums = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    inside = lambda flag: (lambda c: c[w.end] - c[w.start])(sums(flag))
    d = w.data
    chars = np.maximum(np.bincount(w.doc, size, rows), 1)
    share = lambda flag: np.bincount(w.doc, inside(flag), rows) / chars
    letters = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    h = hashes(Words(lower_ascii(d), w.start, w.end, w.first, w.doc))
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, w.doc[order][at], times)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    last = d[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    breaks = np.bincount(w.doc, np.concatenate((sums(d == 10)[w.start[1:]] - sums(d == 10)[w.end[:-1]], [0])) if len(h) else None, rows) if len(h) else np.zeros(rows)
    return np.column_stack([
        np.log1p(n),
        per_word(size),
        np.bincount(w.doc[order][at], minlength=rows) / one,
        per_word(again),
        share((d >= 65) & (d <= 90)),
        share((d >= 48) & (d <= 57)),
        share(d == 124),
        share(_MARKS[d]),
        share(d == 33),
        share(d == 46),
        share(d == 44),
        np.minimum(breaks / one, 1),
        share(d >= 128),
        per_word(inside(letters) == 0),
        most / one,
        per_word(_MARKS[last] | (last == 33) | (last == 124)),
    ])


class Ranker(NamedTuple):
    """A fitted model: strength = (features expanded - mean) / scale @ weights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (expand(x) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(x: np.ndarray) -> np.ndarray:
    """Features, and their square roots, which part small shares from none."""
    return np.hstack([x, np.sqrt(x)])


def _logistic(d: np.ndarray) -> list[np.ndarray]:
    """The logistic and its first ORDER derivatives, as polynomials of itself."""
    p, poly, out = 1 / (1 + np.exp(-np.clip(d, -700, 700))), np.array([0.0, 1.0]), []
    for _ in range(ORDER + 1):
        out.append(np.polynomial.polynomial.polyval(p, poly))
        poly = np.polynomial.polynomial.polymul(np.polynomial.polynomial.polyder(poly), [0, 1, -1])
    return out


def _places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each strength's bin, and what it differs from the bin's middle."""
    at = np.rint(s / BIN)
    return at, s - at * BIN


def _total(parts: list[dict]) -> dict:
    return {k: sum(p[k] for p in parts[1:]) + parts[0][k] if len(parts) > 1 else parts[0][k] for k in parts[0]}


def _joined(parts: list[tuple]) -> tuple:
    """Of each class (bins, sums of their rows), of equal bins added."""
    out = []
    for pairs in zip(*parts, strict=True):
        bins, at = np.unique(np.concatenate([b for b, _ in pairs]), return_inverse=True)
        rows = np.concatenate([r for _, r in pairs])
        sums = np.zeros((len(bins), rows.shape[1]))
        np.add.at(sums, at, rows)
        out.append((bins, sums))
    return tuple(out)


def _powers(t: np.ndarray) -> np.ndarray:
    return np.stack([t**k / factorial(k) for k in range(ORDER + 1)], axis=1)


def _gathered(y: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple:
    """Of each class (bins, [power sums of what strengths differ by, sums of z])."""
    at, t = _places(s)
    return _joined([tuple((at[y == c], np.hstack([_powers(t), z])[y == c]) for c in (0, 1))])


def _against(own: np.ndarray, bins: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each bin of ``own``: the derivatives, by minus its strength, of the summed logistic
    of how far those of the other class in ``bins`` are above it; last the first of them with
    all rows at their bins' middles."""
    out = np.zeros((len(own), ORDER + 2))
    for k in range(0, len(own), 256):
        f = _logistic((bins[None, :] - own[k : k + 256, None]) * BIN)
        for m in range(ORDER + 1):
            for power in range(ORDER + 1 - m):
                out[k : k + 256, m] += f[m + power] @ sums[:, power]
        out[k : k + 256, ORDER + 1] = f[1] @ sums[:, 0]
    return out


def _pulled(y: np.ndarray, s: np.ndarray, z: np.ndarray, tables: tuple) -> dict:
    """A block's part of the gradient, and of the squares in the curvature.

    The curvature takes all rows at their bins' middles, squares and products alike: so it is a
    sum over pairs, each to a fifteenth what it is, and steps close in on the minimum.
    """
    slope, curve = np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1]))
    for c, (bins, table) in enumerate(tables):
        sign = 1 if c else -1  # seen from label 0, strengths count downwards
        own, u = z[y == c], sign * s[y == c] / BIN
        at = np.clip(np.searchsorted(bins, u), 1, max(len(bins) - 1, 1))
        at = np.where(np.abs(bins[at - 1] - u) < np.abs(bins[np.minimum(at, len(bins) - 1)] - u), at - 1, np.minimum(at, len(bins) - 1))
        row = table[at]
        slope -= sign * ((row[:, : ORDER + 1] * _powers((bins[at] - u) * BIN)).sum(axis=1) @ own)
        curve += (own * row[:, ORDER + 1, None]).T @ own
    return {"slope": slope, "curve": curve}


def _keys(s: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values."""
    v = np.ascontiguousarray(s + 0.0).view(np.uint64)
    return np.where(v >> np.uint64(63), ~v, v | np.uint64(1 << 63))


def _ranked(passes: Callable, strength: Callable, ranks: list[int]) -> list[float]:
    """The strengths of the given ranks (from 0) among all, found by 16 bits at a time."""
    heads, left = [0] * len(ranks), list(ranks)
    for shift in (48, 32, 16, 0):

        def part(y: np.ndarray, x: np.ndarray) -> dict:
            high = _keys(strength(x)) >> np.uint64(shift)
            return {i: np.bincount((high[(high >> np.uint64(16)) == h] & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16) for i, h in enumerate(heads)}

        counts = passes(part, _total)
        for i, h in enumerate(heads):
            upto = np.cumsum(counts[i])
            k = int(np.searchsorted(upto, left[i], "right"))
            left[i] -= int(upto[k - 1]) if k else 0
            heads[i] = h << 16 | k
    found = np.array(heads, np.uint64)
    return np.where(found >> np.uint64(63), found ^ np.uint64(1 << 63), ~found).view(np.float64).tolist()


def blocks(*rows: tuple[np.ndarray, np.ndarray]) -> Callable:
    """Passes over blocks (labels, features) held in this process."""
    return lambda part, merge: merge([part(y, x) for y, x in rows]) if rows else None


def fit(passes: Callable) -> Ranker | None:
    """Bradley-Terry weights by Newton steps over all pairs; None without both classes.

    ``passes(part, merge)`` gives the merged results of ``part(labels, features)`` of all blocks.
    """
    got = passes(lambda y, x: {"n": np.array([(y == 0).sum(), (y == 1).sum()]), "z": expand(x).sum(axis=0)}, _total)
    if got is None or not got["n"].all():
        return None
    n = got["n"]
    mean = got["z"] / n.sum()
    scale = np.sqrt(passes(lambda y, x: {"z": ((expand(x) - mean) ** 2).sum(axis=0)}, _total)["z"] / n.sum())
    scale[scale < 1e-9] = 1
    pairs, weights = float(n[0]) * float(n[1]), np.zeros(len(mean))
    for _ in range(STEPS):

        def seen(x: np.ndarray, weights: np.ndarray = weights.copy()) -> tuple[np.ndarray, np.ndarray]:
            z = (expand(x) - mean) / scale
            return z @ weights, z

        (low, bad), (high, good) = passes(lambda y, x, seen=seen: _gathered(y, *seen(x)), _joined)
        turned = good[:, : ORDER + 1] * (-1.0) ** np.arange(ORDER + 1)
        tables = ((-low[::-1], _against(-low, -high, turned)[::-1]), (high, _against(high, low, bad)))
        sums = passes(lambda y, x, seen=seen, tables=tables: _pulled(y, *seen(x), tables), _total)
        cross = np.zeros_like(sums["curve"])
        for k in range(0, len(high), 256):
            cross += good[k : k + 256, ORDER + 1 :].T @ _logistic((low[None, :] - high[k : k + 256, None]) * BIN)[1] @ bad[:, ORDER + 1 :]
        curve = (sums["curve"] - cross - cross.T) / pairs + RIDGE * np.eye(len(weights))
        step = -np.linalg.solve(curve, sums["slope"] / pairs + RIDGE * weights)
        size = np.abs(step).max()
        weights = weights + step * min(1, 1 / size) if size else weights
        if size < 1e-6:
            break
    model = Ranker(mean, scale, weights, 0.0, 1.0)
    sums = passes(lambda y, x: {c: model.strength(x)[y == c].sum() for c in (0, 1)}, _total)
    low, high = _ranked(passes, model.strength, [int(n[0]) - 1, int(n[0])])
    return model._replace(threshold=(low + high) / 2, slope=8 / max(float(sums[1] / n[1] - sums[0] / n[0]), 1e-6))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_utf8(batch.column(1))
        x = np.vstack([features(texts, a, b) for a, b in slices(texts)]) if len(texts) else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])


def _passes(table: DataFrame) -> Callable:
    """Passes over a table (y, x); only merged results of its partitions come to the driver."""

    def over(part: Callable, merge: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for batch in batches:
                if batch.num_rows:
                    found.append(part(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)))
                if len(found) == PARTS:
                    found = [merge(found)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(merge(found))], pa.binary())], names=["part"])

        got = sorted(bytes(r["part"]) for r in table.mapInArrow(run, "part binary").collect())
        return merge([pickle.loads(r) for r in got]) if got else None

    return over


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker | None:
    """Fit on all labelled rows outside the held-out fold.

    Rows with a null key, or a label other than 0 and 1, are left out. Features are made
    before labels are joined, so no text is shuffled, and written once for all passes.
    """
    bounded_batches(docs.sparkSession)
    used = lambda df: df.where(F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    kind = docs.schema[id_col].dataType.simpleString()
    known = used(labels).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = used(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows, f"id {kind}, x array<double>")
    table = materialize(rows.join(known, "id").select("y", "x"), "labelled-features")
    model = fit(_passes(table))
    discard(table)
    return model


def score(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row from its text alone; 0.5 for all without a model.

    Null and empty texts get the score of a text without words; null and repeated ids
    are rows like any other; an empty table gives no rows; other columns are ignored.
    """
    fresh(docs, id_col, text_col)
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(1))
            s = [model.score(features(texts, a, b)) if model else np.full(b - a, 0.5) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Ranker | None, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score under ``cut``; all rows without a model."""
    fresh(docs, text_col)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_utf8(batch.column(at))
            s = [model.score(features(texts, a, b)) for a, b in slices(texts)]
            yield batch.filter(pa.array(np.concatenate(s) >= cut)) if s else batch

    return docs.mapInArrow(run, docs.schema) if model else docs
